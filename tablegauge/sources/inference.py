"""Missing-value tokens and type inference for text columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablegauge.functions.missing import ident, literal
from tablegauge.functions.text import INTEGER_TEXT, NAN_TEXT, NUMBER_TEXT
from tablegauge.operators.columns import empty_frame, per_column

# The texts a delimited file uses for "no value".
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# The texts that make a column boolean.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]

SCHEMA_TABLE = "column string, dtype string"


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def normalize_missing(df: DataFrame, tokens: Iterable[str] = tuple(MISSING_TOKENS)) -> DataFrame:
    """Turn missing-value tokens in text columns into NULL."""
    text, listed = set(_text_columns(df)), _listed(tokens)
    return df.selectExpr(*[
        f"case when {ident(c)} not in {listed} then {ident(c)} end as {ident(c)}" if c in text else ident(c)
        for c in df.columns
    ])


def _listed(tokens: Iterable[str]) -> str:
    return f"({', '.join(map(literal, tokens))})"


# The kinds of text, from narrow to wide; a boolean text is never a number.
_BIGINT, _DOUBLE, _BOOLEAN, _STRING = range(4)


def _kind(name: str) -> str:
    c = ident(name)
    # Patterns first: a cast that fails costs far more than a match.  19 digits may exceed a bigint.
    is_bigint = f"{c} rlike {literal(INTEGER_TEXT)} and (length({c}) < 19 or try_cast({c} as bigint) is not null)"
    return (f"case when {c} is null then null when {is_bigint} then {_BIGINT} "
            f"when {c} rlike {literal(NUMBER_TEXT)} then {_DOUBLE} "
            f"when {c} in {_listed(TRUE_TOKENS + FALSE_TOKENS)} then {_BOOLEAN} else {_STRING} end as {c}")


def infer_types(df: DataFrame, string_cols: Iterable[str] = ()) -> DataFrame:
    """``(column, dtype)`` with the narrowest of bigint, double, boolean, string for every text column.

    One pass classifies every value once and keeps the narrowest and the widest kind per column.  Columns that
    already have a type, and those named in ``string_cols``, keep theirs.  A column without values is a double.
    """
    keep = set(string_cols)
    candidates = [c for c in _text_columns(df) if c not in keep]
    kinds = per_column(df.selectExpr(*map(_kind, candidates)), candidates, {
        "least": lambda c, t: f"min({ident(c)})", "most": lambda c, t: f"max({ident(c)})",
    }, "column string, least int, most int")
    dtype = (
        f"case when most is null then 'double' when most = {_BIGINT} then 'bigint' "
        f"when most = {_DOUBLE} then 'double' when least = {_BOOLEAN} and most = {_BOOLEAN} then 'boolean' "
        f"else 'string' end as dtype")
    inferred = kinds.selectExpr("column", dtype)
    fixed = [f for f in df.schema.fields if f.name not in candidates]
    if not fixed:
        return inferred
    return inferred.unionByName(_schema_lines(df, fixed))


def _schema_lines(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    lines = [f"struct({literal(f.name)} as column, {literal(f.dataType.simpleString())} as dtype)" for f in fields]
    return df.sparkSession.range(1).selectExpr(f"inline(array({', '.join(lines)}))")


def cast_text(df: DataFrame, dtypes: dict[str, str]) -> DataFrame:
    """Cast text columns to the types found by `infer_types`."""
    def converted(name: str) -> str:
        c, wanted = ident(name), dtypes.get(name)
        if wanted == "bigint":
            return f"cast({c} as bigint) as {c}"
        if wanted == "double":
            # A signed "nan" counts as a number when types are inferred, but is none for a cast.
            return f"(case when {c} rlike {literal(NAN_TEXT)} then double('NaN') else cast({c} as double) end) as {c}"
        if wanted == "boolean":
            return f"{c} in {_listed(TRUE_TOKENS)} as {c}"
        return c
    text = set(_text_columns(df))
    return df.selectExpr(*[converted(c) if c in text else ident(c) for c in df.columns])


def infer_and_cast(df: DataFrame, string_cols: Iterable[str] = ()) -> DataFrame:
    """Missing tokens, inference and cast in a row.  Runs one job, whose result is one line per column."""
    clean = normalize_missing(df)
    dtypes = {r["column"]: r["dtype"] for r in infer_types(clean, string_cols).collect()}
    return cast_text(clean, dtypes)


def infer_schema(df: DataFrame) -> DataFrame:
    """``(column, dtype)`` of a typed DataFrame, for comparison with another version of the dataset."""
    if not df.columns:
        return empty_frame(df, SCHEMA_TABLE)
    return _schema_lines(df, df.schema.fields)
