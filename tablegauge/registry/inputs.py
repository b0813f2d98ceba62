"""Inputs of the registered queries.

The supplied tables have neither missing values nor duplicate rows.  The SQL below derives tables that have
them; it is written so that Spark and other engines give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablegauge.functions.missing import ident

DIRTY_BASE = """
 SELECT c_custkey k, c_name, c_nationkey, c_acctbal FROM {customer}
 UNION ALL
 SELECT c_custkey k, c_name, c_nationkey, c_acctbal FROM {customer} WHERE c_custkey % 40 = 7
"""

DIRTY = """
SELECT CASE WHEN k % 211 = 3 THEN NULL ELSE k END AS customer_id,
 CASE WHEN k % 101 = 5 THEN NULL WHEN k % 103 = 6 THEN '   ' WHEN k % 107 = 8 THEN 'X' ELSE c_name END AS name,
 CASE WHEN k % 53 = 9 THEN NULL WHEN k % 59 = 10 THEN 'bad-address'
      ELSE concat('user', CAST(k AS STRING), '@example.com') END AS email,
 CASE WHEN k % 61 = 11 THEN NULL WHEN k % 67 = 12 THEN '7777777' WHEN k % 71 = 13 THEN '12-34'
      WHEN k % 73 = 14 THEN 'n/a' ELSE concat('+1555', lpad(CAST(k AS STRING), 7, '0')) END AS phone,
 CASE WHEN k % 79 = 15 THEN NULL WHEN k % 83 = 16 THEN 'unknown' WHEN k % 89 = 17 THEN '150'
      ELSE CAST(k % 90 AS STRING) END AS age,
 CASE c_nationkey % 5 WHEN 0 THEN 'North' WHEN 1 THEN 'South' WHEN 2 THEN 'East'
      WHEN 3 THEN 'West' ELSE 'Central' END AS region,
 CASE WHEN k % 97 = 18 THEN c_acctbal * 100 WHEN k % 43 = 19 THEN NULL ELSE c_acctbal END AS acctbal
FROM {base}
"""
DIRTY_COLUMNS = ["customer_id", "name", "email", "phone", "age", "region", "acctbal"]

# Sixteen more columns with rising shares of missing values and of outliers.
WIDE_EXTRA = [
    f"CASE WHEN customer_id % {i + 2} = 1 THEN NULL WHEN customer_id % {30 + i} = 0 THEN acctbal * 1000 "
    f"ELSE customer_id % {50 + i} END AS m{i}" for i in range(16)
]
WIDE = "SELECT " + ", ".join(DIRTY_COLUMNS + WIDE_EXTRA) + " FROM {dirty}"
WIDE_COLUMNS = DIRTY_COLUMNS + [f"m{i}" for i in range(16)]

# A later delivery of the customer table: one column gone, one new, one no longer numeric throughout.
CHANGED_CUSTOMER = """
SELECT c_custkey, c_name, c_nationkey,
 CASE WHEN c_custkey % 97 = 18 THEN 'unknown' ELSE CAST(c_acctbal AS STRING) END AS c_acctbal,
 concat('+1555', lpad(CAST(c_custkey AS STRING), 7, '0'), 'x') AS c_phone
FROM {customer}
"""

# One profiling run per dataset and day, one "column" per event type.
_DAY = "CAST(date_trunc('day', ts) AS DATE)"
_SET = "concat('set-', CAST(user_id % 3 AS STRING))"
_MEAN = "(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) * 100 AS DOUBLE))"
_ERRORS = "(CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS DOUBLE) / CAST(count(*) AS DOUBLE))"
RUNS = f"""
SELECT dataset_name, concat(dataset_name, '/', CAST(run_timestamp AS STRING)) AS run_id,
 substring(md5(dataset_name), 1, 12) AS dataset_id,
 concat('upload-', CAST(run_timestamp AS STRING)) AS dataset_label, run_timestamp, row_count,
 CAST(6 AS INT) AS column_count, floor((100 - mean / 5) * 100 + 0.5) / 100 AS quality_score,
 floor((100 - errors * 100) * 100 + 0.5) / 100 AS completeness_pct, floor((mean / 10) * 100 + 0.5) / 100 AS duplicate_pct,
 floor((errors * 100) * 100 + 0.5) / 100 AS avg_null_pct
FROM (SELECT {_SET} AS dataset_name, {_DAY} AS run_timestamp, count(*) AS row_count,
       {_MEAN} AS mean, {_ERRORS} AS errors
      FROM {{events}} GROUP BY {_SET}, {_DAY}) d
"""
METRICS = f"""
SELECT concat({_SET}, '/', CAST({_DAY} AS STRING)) AS run_id, {_SET} AS dataset_name,
 event_type AS column_name, floor(({_MEAN} / 7) * 100 + 0.5) / 100 AS null_pct,
 floor(({_MEAN} / 9) * 100 + 0.5) / 100 AS outlier_pct, floor(({_MEAN} / 5) * 100 + 0.5) / 100 AS health_score
FROM {{events}} GROUP BY {_SET}, {_DAY}, event_type
"""
SNAPSHOTS = f"""
SELECT {_SET} AS dataset_name, {_DAY} AS snapshot_timestamp,
 concat('{{{{"event_id": "bigint", "value": "', CASE WHEN max(value) > 60 THEN 'double' ELSE 'bigint' END,
        '"}}}}') AS schema_json
FROM {{events}} GROUP BY {_SET}, {_DAY}
"""
# Event properties of mixed JSON kinds: numbers, texts, arrays, objects, nulls, and some that are not JSON at all.
MIXED_PROPS = """
SELECT event_id, event_type,
 CASE WHEN event_id % 97 = 0 THEN 'not json' WHEN event_id % 89 = 0 THEN NULL
      WHEN event_id % 83 = 0 THEN '[1, 2]'
      WHEN event_type = 'click' THEN concat('{{"k": ', CAST(user_id % 100 AS STRING), ', "v": ',
                                            CAST(CAST(round(value) AS BIGINT) AS STRING), '}}')
      WHEN event_type = 'view' THEN concat('{{"k": "u', CAST(user_id % 7 AS STRING), '", "tags": ["a", "b"]}}')
      WHEN event_type = 'purchase' THEN concat('{{"k": ', CAST(user_id % 100 AS STRING), '.5, "ok": true}}')
      WHEN event_type = 'error' THEN concat('{{"k": null, "e": {{"code": ', CAST(500 + user_id % 4 AS STRING), '}}}}')
      ELSE props END AS props
FROM {events}
"""

# A schema per dataset and day whose columns come and go and change their type: an event type is a column on a day
# when it has at least 8 events of the dataset, typed by the largest value.
SCHEMA_COLUMNS = f"""
SELECT concat('set-', CAST(user_id % 7 AS STRING)) AS dataset_name, CAST({_DAY} AS TIMESTAMP) AS snapshot_timestamp,
 event_type AS column_name,
 CASE WHEN max(value) > 300 THEN 'double' WHEN max(value) > 150 THEN 'bigint' ELSE 'int' END AS dtype
FROM {{events}} WHERE event_type IS NOT NULL GROUP BY user_id % 7, {_DAY}, event_type HAVING count(*) >= 8
"""
COLUMN_HISTORY = f"""
SELECT event_type AS column_name, {_DAY} AS run_timestamp,
 floor(({_MEAN} / 5) * 100 + 0.5) / 100 AS health_score
FROM {{events}} GROUP BY event_type, {_DAY}
"""

# A rule per part, so that the catalogue is as large as the table.
PART_RULES = """
SELECT concat('PART-', CAST(p_partkey AS STRING)) AS rule_id, p_type AS dimension, p_name AS rule_name,
 'p_retailprice' AS attribute, 'RANGE' AS rule_type, concat('[0, ', CAST(p_size AS STRING), ']') AS parameter,
 CASE p_size % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'ERROR' ELSE 'WARNING' END AS severity,
 CASE WHEN p_partkey % 7 = 0 THEN false WHEN p_partkey % 7 = 1 THEN NULL ELSE true END AS enabled,
 CASE WHEN p_partkey % 11 = 3 THEN NULL ELSE p_size END AS priority, p_partkey AS ordinal
FROM {part}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return spark.sql(DIRTY, base=spark.sql(DIRTY_BASE, customer=customer))


def wide_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(WIDE, dirty=dirty_customers(spark, sf_dir))


def derived(spark: SparkSession, sf_dir: str, sql: str, source: str) -> DataFrame:
    return spark.sql(sql, **{source: table(spark, sf_dir, source)})


def schema_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshots of ``SCHEMA_COLUMNS`` the way a history stores them: one JSON object a dataset and day."""
    columns = derived(spark, sf_dir, SCHEMA_COLUMNS, "events")
    entries = F.array_sort(F.collect_list(F.struct("column_name", "dtype")))
    return columns.groupBy("dataset_name", "snapshot_timestamp").agg(
        F.to_json(F.map_from_entries(entries)).alias("schema_json"))


def as_text(df: DataFrame) -> DataFrame:
    """All columns as text, the way a delimited file delivers them."""
    return df.selectExpr(*[f"cast({ident(c)} as string) as {ident(c)}" for c in df.columns])


def events_by_click(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    return events.where("event_type = 'click'"), events.where("event_type <> 'click'")


def orders_by_date(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    old = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    return orders.where(old), orders.where(~old)
