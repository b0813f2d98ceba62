"""Dataset summary and schema fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tablegauge.functions.missing import ident, literal
from tablegauge.functions.rounding import round_even
from tablegauge.functions.text import NESTED_TYPES
from tablegauge.operators.columns import column_types
from tablegauge.sources.inference import infer_schema

FINGERPRINT_DIGITS = 12

# Bytes of a value by type; other fixed-width types have 8, text and nested values their length.
WIDTHS = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}


def bytes_of(name: str, dtype: T.DataType) -> str:
    c = ident(name)
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return f"coalesce(sum(cast(octet_length({c}) as bigint)), 0L)"
    if isinstance(dtype, NESTED_TYPES):
        return f"coalesce(sum(cast(octet_length(to_json({c})) as bigint)), 0L)"
    return f"count({c}) * {WIDTHS.get(type(dtype), 8)}L"


def dataset_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, logical megabytes and column names; one row, one pass."""
    sizes = [bytes_of(c, t) for c, t in column_types(df).items()]
    counts = df.selectExpr("count(1) as row_count", f"{' + '.join(['0L', *sizes])} as bytes")
    return summary_line(counts, df.columns)


def summary_line(counts: DataFrame, columns: list[str]) -> DataFrame:
    """From a row ``(row_count, bytes)``."""
    names = f"cast(array({', '.join(map(literal, columns))}) as array<string>) as columns"
    return counts.select(
        "row_count", F.lit(len(columns)).alias("column_count"),
        round_even(F.col("bytes") / F.lit(1024.0 * 1024.0), 2).alias("memory_usage_mb"), F.expr(names))


def _json_text(col: Column) -> Column:
    """A text as a JSON string literal, quotes included."""
    return F.regexp_extract(F.to_json(F.struct(col.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)


def schema_json(schemas: DataFrame, by: str = "dataset") -> DataFrame:
    """Long schema tables ``(<by>, column, dtype)`` to one JSON text per dataset, columns in name order."""
    pair = F.concat(_json_text(F.col("column")), F.lit(": "), _json_text(F.col("dtype")))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("column"), pair.alias("pair"))))   # one entry per column
    text = F.concat(F.lit("{"), F.array_join(F.transform(ordered, lambda x: x["pair"]), ", "), F.lit("}"))
    return schemas.groupBy(by).agg(text.alias("schema_json"))


def schema_fingerprint(schemas: DataFrame, by: str = "dataset") -> DataFrame:
    """Short stable id per dataset, from column names and types only; column order does not matter."""
    digest = F.substring(F.sha2(F.col("schema_json"), 256), 1, FINGERPRINT_DIGITS)
    return schema_json(schemas, by).select(by, digest.alias("dataset_id"))


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """The fingerprint of one DataFrame, as one row."""
    named = infer_schema(df).withColumn("dataset", F.lit(""))
    return schema_fingerprint(named).select("dataset_id")
