"""Columns of JSON values of mixed types, as VARIANT.

A JSON text column is parsed once into Spark's VARIANT type; values of any shape stay in one column, and fields are
read from it by path with their type.  What kinds of value each top-level field holds is counted in one scan whose
aggregation combines on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tablegauge.functions.missing import quoted

KINDS_SCHEMA = "path string, kind string, n_values bigint"


def as_variant(column: Column) -> Column:
    """A JSON text (or a VARIANT already) as VARIANT; malformed text, and JSON with repeated keys, become NULL."""
    return F.try_parse_json(column)


def kind_of(value: Column) -> Column:
    """integer, number, string, boolean, null, object or array: the kind of a VARIANT value."""
    s = F.schema_of_variant(value)
    return (F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array")
            .when(s.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer")
            .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "number")
            .when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null")
            .otherwise(F.lower(s)))


def variant_kinds(df: DataFrame, column: str) -> DataFrame:
    """``(path, kind, n_values)``: how many values of each kind every top-level field of the column holds.

    Path ``$`` stands for the whole value where it is not an object: ``missing`` for NULL, ``invalid`` for text that
    is not JSON, or the kind of an array or scalar.  An object with no fields gives no line.
    """
    source = quoted(column)
    is_text = isinstance(df.schema[column].dataType, T.StringType)
    value = as_variant(source) if is_text else source
    rows = df.select(source.isNull().alias("missing"), value.alias("v"))
    fields = F.expr("try_cast(v as map<string,variant>)")
    whole = (F.when(F.col("missing"), "missing").when(F.col("v").isNull(), "invalid").otherwise(kind_of(F.col("v"))))
    lines = rows.select(F.when(fields.isNull(), F.array(F.struct(F.lit("$").alias("path"), whole.alias("kind"))))
                        .otherwise(F.transform(F.map_entries(fields),
                                               lambda e: F.struct(e["key"].alias("path"),
                                                                  kind_of(e["value"]).alias("kind"))))
                        .alias("lines"))
    return lines.select(F.inline("lines")).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n_values"))


def variant_fields(df: DataFrame, column: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with typed columns read from a JSON or VARIANT column: ``{name: (path, type)}``, e.g.
    ``{"code": ("$.e.code", "int")}``.  A missing path, or a value that does not fit the type, is NULL, so that the
    usual profile and rules apply to them."""
    source = quoted(column)
    value = as_variant(source) if isinstance(df.schema[column].dataType, T.StringType) else source
    return df.select("*", *[F.try_variant_get(value, path, kind).alias(name) for name, (path, kind) in fields.items()])
