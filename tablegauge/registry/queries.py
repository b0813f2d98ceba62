"""The registered queries: every operator on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablegauge.functions.missing import ident, literal
from tablegauge.functions.rounding import round_even
from tablegauge.operators import catalog as c, drift, forecast, profile as p, results as r, views as v
from tablegauge.operators.catalog import Rule, customer_rules
from tablegauge.operators.checks import CHECKS
from tablegauge.operators.rules import apply_rules, rule_rollup
from tablegauge.operators.quantiles import approximate_quantiles, approximation_errors
from tablegauge.plans.profile import run_full_profile
from tablegauge.registry import inputs as i
from tablegauge.sources import history as h
from tablegauge.sources.inference import infer_types, normalize_missing
from tablegauge.sources.sampling import exact_sample
from tablegauge.sources.summary import dataset_summary, schema_fingerprint
from tablegauge.sources.variant import variant_fields, variant_kinds

Query = Callable[[SparkSession, str], DataFrame]

SAMPLE_ROWS = 1000
FIRST_RULES = 50
WORST = 5
HEALTH_THRESHOLD = 10.2
MISSING_ATTRIBUTE = Rule("X-001", "Validity", "Missing column", "fax", "NOT_NULL", None, "ERROR")
UNKNOWN_TYPE = Rule("X-002", "Validity", "Unknown type", "name", "SOUNDS_LIKE", None, "ERROR")
ORDER_RULES = [
    Rule("ORD-001", "Completeness", "Order key mandatory", "o_orderkey", "NOT_NULL", None, "CRITICAL"),
    Rule("ORD-002", "Uniqueness", "Order key unique", "o_orderkey", "UNIQUE", None, "CRITICAL"),
    Rule("ORD-003", "Uniqueness", "One order per customer", "o_custkey", "UNIQUE", None, "WARNING"),
    Rule("ORD-004", "Validity", "Price range", "o_totalprice", "RANGE", '{"min": 1000, "max": 400000}', "ERROR"),
    Rule("ORD-005", "Consistency", "Known status", "o_orderstatus", "ENUM", '["F", "O"]', "WARNING"),
    Rule("ORD-006", "Validity", "Priority format", "o_orderpriority", "REGEX", r"^[1-4]-[A-Z]+$", "ERROR"),
]
LINE_RULES = [
    Rule("LIN-001", "Completeness", "Order key mandatory", "l_orderkey", "NOT_NULL", None, "CRITICAL"),
    Rule("LIN-002", "Uniqueness", "One line per part", "l_partkey", "UNIQUE", None, "ERROR"),
    Rule("LIN-003", "Validity", "Quantity range", "l_quantity", "RANGE", '{"min": 1, "max": 45}', "ERROR"),
    Rule("LIN-004", "Consistency", "Known flag", "l_returnflag", "ENUM", '["A", "R"]', "WARNING"),
]
# Text that reads like a variable of the process is text like any other.
DOLLAR_REGION = Rule("X-003", "Validity", "Region as written", "region", "ENUM", '["${env:HOME}", "South"]', "ERROR")
OWN_CHECK = Rule("X-004", "Validity", "Even age", "age", "EVEN", None, "ERROR")
UNIQUE_VECTOR = Rule("EMB-001", "Uniqueness", "Vector unique", "embedding", "UNIQUE", None, "ERROR")
UNIQUE_TEXT = Rule("DOC-001", "Uniqueness", "Text Unique", "text", "UNIQUE", None, "ERROR")


def _dirty(query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: query(i.dirty_customers(spark, sf))


def _wide(query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: query(i.wide_customers(spark, sf))


def _on(name: str, query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: query(i.table(spark, sf, name))


QUARTILES = [0.25, 0.5, 0.75]


def _quantile_bounds(df: DataFrame) -> DataFrame:
    """Approximate quartiles in one pass, and whether each one ranks within the sketch's bound (counted exactly)."""
    numbers = p.numeric_values(df)
    found = approximation_errors(numbers, QUARTILES, approximate_quantiles(numbers, QUARTILES))
    return found.select("column", "prob", "n", "within_bound")


def _distinct_over_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct values of every column of orders over two deliveries, from their sketches alone, and whether each
    estimate lies within the stated bound of the exact count (counted here only to check it)."""
    old, new = i.orders_by_date(spark, sf)
    sketches = p.distinct_sketches(old).unionByName(p.distinct_sketches(new))
    united = p.united_cardinality(sketches)
    both = old.unionByName(new)
    exact = both.selectExpr(*[f"count(distinct {ident(c)}) as {ident(c)}" for c in both.columns]).selectExpr(
        f"stack({len(both.columns)}, {', '.join(f'{literal(c)}, {ident(c)}' for c in both.columns)}) as (column, exact)")
    error = F.abs(F.col("unique_count") - F.col("exact")) <= F.lit(p.DISTINCT_BOUND) * F.col("exact")
    return united.join(F.broadcast(exact), "column").select("column", "n_rows", error.alias("within_bound"))


def _derived(sql: str, source: str, query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: query(i.derived(spark, sf, sql, source))


# ---------------------------------------------------------------- sources

def _summary(df: DataFrame) -> DataFrame:
    return dataset_summary(df).withColumn("columns", F.array_join("columns", ","))


def _inferred(df: DataFrame) -> DataFrame:
    return infer_types(normalize_missing(i.as_text(df)))


def _old_and_new_schema(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    old = _inferred(i.table(spark, sf, "customer"))
    return old, _inferred(i.derived(spark, sf, i.CHANGED_CUSTOMER, "customer"))


def _fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _old_and_new_schema(spark, sf)
    return schema_fingerprint(
        old.withColumn("dataset", F.lit("before")).unionByName(new.withColumn("dataset", F.lit("after")))
        .unionByName(_inferred(i.dirty_customers(spark, sf)).withColumn("dataset", F.lit("dirty"))))


def _schemas(compare: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: compare(*_old_and_new_schema(spark, sf))


# ---------------------------------------------------------------- rules

def _rules_of(*types: str) -> list[Rule]:
    return [rule for rule in customer_rules() if rule.rule_type in types]


def _apply(rules: list[Rule]) -> Query:
    return _dirty(lambda df: apply_rules(df, rules, ["customer_id"]))


def _all_results(df: DataFrame) -> DataFrame:
    return apply_rules(df, customer_rules(), ["customer_id"])


def _even(cell, rule) -> str:
    """A check of one's own: NULL where there is no age, ERROR where it is not a number."""
    number = f"try_cast({cell.text} as bigint)"
    return (f"case when {cell.missing} then null when {number} is null then 'ERROR' "
            f"else cast({number} % 2 = 0 as string) end")


def _dollar_regions(df: DataFrame) -> DataFrame:
    written = df.withColumn("region", F.when(F.col("region") == "North", F.lit("${env:HOME}")).otherwise(F.col("region")))
    return apply_rules(written, [DOLLAR_REGION], ["customer_id"])


def _summaries(results: DataFrame, catalogue: str) -> DataFrame:
    return r.overall_rule_score(results).unionByName(
        r.exception_totals(results), allowMissingColumns=True).unionByName(
        r.summarize_by_dimension(results), allowMissingColumns=True).withColumn("catalogue", F.lit(catalogue))


def _no_results(df: DataFrame) -> DataFrame:
    """The summaries of a catalogue that has no rule for the table, beside those of the customer rules."""
    return _summaries(apply_rules(df, [], ["customer_id"]), "none").unionByName(
        _summaries(_all_results(df), "customer"))


def _quality_and_empty(df: DataFrame) -> DataFrame:
    """The quality of the whole table, beside that of none of its rows (NULL)."""
    return p.overall_quality_score(df).withColumn("rows", F.lit("all")).unionByName(
        p.overall_quality_score(df.where("false")).withColumn("rows", F.lit("none")))


def _rollup(df: DataFrame) -> DataFrame:
    return rule_rollup(df, customer_rules())


# ---------------------------------------------------------------- profile

def _rounded_statistics(df: DataFrame) -> DataFrame:
    measures = ["mean", "std", "min", "max", "median"]
    return p.statistical_profile(df).select("column", *[round_even(F.col(m), 4).alias(m) for m in measures])


def _column_metrics(df: DataFrame) -> DataFrame:
    profile = run_full_profile(df)
    return h.column_metrics(profile.nulls, profile.outliers, profile.column_health)


def _full_profile(df: DataFrame) -> DataFrame:
    """Every column-level result of the full profile in one table."""
    profile = run_full_profile(df)
    lines = profile.nulls.select("column", "null_count", "null_pct")
    for part in (profile.cardinality.select("column", "unique_count", "unique_ratio"),
                 profile.outliers.select("column", "outlier_count", "outlier_pct"),
                 profile.statistics.select("column", "min", "max", "median"), profile.column_health):
        lines = lines.join(F.broadcast(part), "column", "left")          # one line per column on either side
    return lines


def _with_infinities(df: DataFrame) -> DataFrame:
    """Account balances with infinities: one in a hundred, or in most rows."""
    return df.selectExpr(
        "case when c_custkey % 100 = 1 then double('Infinity') else c_acctbal end as few",
        "case when c_custkey % 4 > 0 then double('Infinity') else c_acctbal end as many")


# ---------------------------------------------------------------- history and forecasts

def _run_line(df: DataFrame) -> DataFrame:
    return h.run_line(run_full_profile(df))


def _snapshot_line(spark: SparkSession, sf: str) -> DataFrame:
    return h.snapshot_line(_inferred(i.dirty_customers(spark, sf)), "customers")


def _run_history_by_id(df: DataFrame) -> DataFrame:
    """The runs of the dataset whose fingerprint sorts first."""
    return h.get_run_history(df, dataset_id=df.agg(F.min("dataset_id")).first()[0])


def _metric_history(spark: SparkSession, sf: str) -> DataFrame:
    return h.get_column_metric_history(
        i.derived(spark, sf, i.METRICS, "events"), i.derived(spark, sf, i.RUNS, "events"))


def _trend(df: DataFrame) -> DataFrame:
    fitted = forecast.fit_trend(df, "health_score", ["column_name"])
    return fitted.select(
        "column_name", "runs", round_even(F.col("slope"), 6).alias("slope"),
        round_even(F.col("intercept"), 6).alias("intercept"), "last_value")


def _forecast(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return _derived(i.RUNS, "events", operator)


def registered() -> dict[str, Query]:
    return {
        # sources and schema
        "missing_tokens": _dirty(lambda df: normalize_missing(df)),
        "infer_types": _dirty(_inferred),
        "infer_types_lineitem": _on("lineitem", _inferred),
        "exact_sample": _on("orders", lambda df: exact_sample(df, SAMPLE_ROWS, ["o_orderkey"])),
        "exact_sample_most": lambda spark, sf: exact_sample(
            i.table(spark, sf, "orders"), i.table(spark, sf, "orders").count() * 3 // 5, ["o_orderkey"]),
        "dataset_summary": _dirty(_summary),
        "dataset_summary_documents": _on("documents", _summary),
        "schema_fingerprint": _fingerprints,
        # catalogue
        "catalog_ordered": _derived(i.PART_RULES, "part", lambda df: c.order_catalog(df, "ordinal")),
        "catalog_first_n": _derived(
            i.PART_RULES, "part", lambda df: c.enabled_rules(c.first_rules(df, FIRST_RULES, "ordinal"))),
        "catalog_enabled": _derived(i.PART_RULES, "part", c.enabled_rules),
        # rule types
        "rule_not_null": _apply(_rules_of("NOT_NULL")),
        "rule_unique": _apply(_rules_of("UNIQUE")),
        "rule_unique_documents": _on("documents", lambda df: apply_rules(df, [UNIQUE_TEXT], ["doc_id"])),
        "rule_regex": _apply(_rules_of("REGEX")),
        "rule_length": _apply(_rules_of("LENGTH")),
        "rule_range": _apply(_rules_of("RANGE")),
        "rule_enum": _apply(_rules_of("ENUM")),
        "rule_not_repeated_digits": _apply(_rules_of("NOT_REPEATED_DIGITS")),
        # rule execution and summaries
        "rule_results": _dirty(_all_results),
        "rule_missing_column": _apply([MISSING_ATTRIBUTE, *_rules_of("LENGTH")]),
        "rule_enum_dollar": _dirty(_dollar_regions),
        "rule_custom_error": _dirty(lambda df: apply_rules(df, [OWN_CHECK], ["customer_id"], {**CHECKS, "EVEN": _even})),
        "rule_unique_embeddings": _on("embeddings", lambda df: r.exception_totals(
            apply_rules(df.unionAll(df.where("vec_id % 7 = 0")), [UNIQUE_VECTOR], ["vec_id"]))),
        "rule_results_lineitem": _on("lineitem", lambda df: r.exception_totals(
            apply_rules(df, LINE_RULES, ["l_orderkey", "l_linenumber"]))),
        "rule_results_numbered": _on("orders", lambda df: r.exception_totals(apply_rules(df, ORDER_RULES))),
        "summary_of_nothing": _dirty(_no_results),
        "rule_unknown_type": _apply([UNKNOWN_TYPE, *_rules_of("LENGTH")]),
        "dimension_summary": _dirty(lambda df: r.summarize_by_dimension(_rollup(df))),
        "exceptions": _dirty(lambda df: r.get_exceptions(_all_results(df))),
        "overall_rule_score": _dirty(lambda df: r.overall_rule_score(_rollup(df))),
        "exception_totals": _dirty(lambda df: r.exception_totals(_all_results(df))),
        "rule_rollup_fused": _dirty(_rollup),
        "rule_rollup_orders": _on("orders", lambda df: rule_rollup(df, ORDER_RULES)),
        "exceptions_orders": _on(
            "orders", lambda df: r.exceptions(apply_rules(df, ORDER_RULES, ["o_orderkey"]))),
        # profile
        "null_analysis": _dirty(p.null_analysis),
        "duplicate_rows": _dirty(p.duplicate_detection),
        "duplicate_rows_lineitem": _on("lineitem", p.duplicate_detection),
        "duplicate_rows_embeddings": _on("embeddings", lambda df: p.duplicate_detection(
            df.unionAll(df.where("vec_id % 7 = 0")))),
        "cardinality_embeddings": _on("embeddings", p.cardinality_analysis),
        "cardinality": _dirty(p.cardinality_analysis),
        "cardinality_lineitem": _on("lineitem", p.cardinality_analysis),
        "cardinality_documents": _on("documents", p.cardinality_analysis),
        "pattern_validation": _dirty(p.pattern_validation),
        "statistical_profile": _dirty(_rounded_statistics),
        "statistical_profile_lineitem": _on("lineitem", _rounded_statistics),
        "outliers_iqr": _dirty(p.outlier_detection),
        "outliers_iqr_lineitem": _on("lineitem", p.outlier_detection),
        "outliers_iqr_documents": _on("documents", p.outlier_detection),
        "outliers_zscore": _dirty(lambda df: p.outlier_detection(df, "zscore")),
        "outliers_zscore_documents": _on("documents", lambda df: p.outlier_detection(df, "zscore")),
        "outliers_zscore_infinite": _on(
            "customer", lambda df: p.outlier_detection(_with_infinities(df), "zscore")),
        "outliers_iqr_infinite": _on("customer", lambda df: p.outlier_detection(_with_infinities(df))),
        "overall_quality_empty": _on("customer", _quality_and_empty),
        "completeness": _dirty(p.completeness_score),
        "column_health": _dirty(p.column_health_score),
        "overall_quality": _dirty(p.overall_quality_score),
        "full_profile": _dirty(_full_profile),
        "full_profile_lineitem": _on("lineitem", _full_profile),
        "quantile_bounds_lineitem": _on("lineitem", _quantile_bounds),
        "distinct_over_deliveries": _distinct_over_deliveries,
        "variant_kinds_events": _derived(i.MIXED_PROPS, "events", lambda df: variant_kinds(df, "props")),
        "variant_nulls_events": _derived(i.MIXED_PROPS, "events", lambda df: p.null_analysis(variant_fields(
            df, "props", {"k": ("$.k", "string"), "v": ("$.v", "bigint"), "code": ("$.e.code", "int")}).drop(
                "props", "event_type"))),
        # drift
        "schema_added": _schemas(drift.added_columns),
        "schema_removed": _schemas(drift.removed_columns),
        "schema_type_changes": _schemas(drift.type_changes),
        "schema_compare": _schemas(drift.compare_schemas),
        "schema_has_changes": _schemas(drift.has_changes),
        "schema_change_log": lambda spark, sf: drift.schema_change_log(i.schema_series(spark, sf)),
        "ks_drift": lambda spark, sf: drift.detect_data_drift(*i.events_by_click(spark, sf)),
        "ks_drift_orders": lambda spark, sf: drift.detect_data_drift(*i.orders_by_date(spark, sf)),
        # history
        "column_metrics": _dirty(_column_metrics),
        "run_line": _dirty(_run_line),
        "snapshot_line": _snapshot_line,
        "run_history_by_id": _derived(i.RUNS, "events", _run_history_by_id),
        "run_history": _derived(i.RUNS, "events", lambda df: h.get_run_history(df, "set-1")),
        "column_metric_history": _metric_history,
        "latest_schema": _derived(i.SNAPSHOTS, "events", h.get_latest_schema),
        "known_datasets": _derived(i.RUNS, "events", h.list_known_datasets),
        # forecasts
        "trend_fit": _derived(i.COLUMN_HISTORY, "events", _trend),
        "forecast_next": _derived(
            i.COLUMN_HISTORY, "events",
            lambda df: forecast.forecast_next_value(df, "health_score", 3, ["column_name"])),
        "forecast_quality": _forecast(forecast.predict_quality_score),
        "forecast_duplicates": _forecast(forecast.predict_duplicate_trend),
        "forecast_nulls": _forecast(forecast.predict_null_trend),
        "forecast_volume": _forecast(forecast.predict_volume_growth),
        "columns_at_risk": _derived(
            i.COLUMN_HISTORY, "events",
            lambda df: forecast.predict_columns_likely_to_fail(df, HEALTH_THRESHOLD)),
        # views
        "worst_health": _wide(lambda df: v.worst_health(p.column_health_score(df), WORST)),
        "worst_health_all": _wide(lambda df: v.worst_health(p.column_health_score(df))),
        "worst_nulls": _wide(lambda df: v.worst_nulls(p.null_analysis(df), WORST)),
        "worst_outliers": _wide(lambda df: v.worst_outliers(p.outlier_detection(df), WORST)),
        "quality_trend": _derived(i.RUNS, "events", v.quality_trend),
        "dimension_profile": _dirty(lambda df: v.dimension_profile(r.summarize_by_dimension(_rollup(df)))),
    }
