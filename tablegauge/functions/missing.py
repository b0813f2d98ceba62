"""What counts as a missing value, and which columns count as numbers.

A value is missing when it is NULL or a floating-point NaN.  Spark groups, counts and orders NULL and NaN
apart, so every operator goes through these helpers instead of testing for NULL itself.

Expressions are built as SQL text: a wide table needs many of them, and each call of the Column API is several
round trips to the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
)


def ident(name: str) -> str:
    """A column by its literal name, dots and backticks included.

    A name that reads like a variable would be replaced when SQL text is parsed, and cannot be written in another
    way; the session then no longer replaces variables.
    """
    session = SparkSession.getActiveSession() if "${" in name else None
    if session is not None:
        session.conf.set("spark.sql.variable.substitute", "false")
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    return F.col(ident(name))


def literal(text: str | None) -> str:
    """A text constant; raw where possible, so that backslashes mean themselves."""
    if text is None:
        return "cast(null as string)"
    if "${" in text:
        # In one piece it would be taken for a variable of the session or the process.
        return "(" + " || ".join(literal(part) for part in re.split(r"(?<=\$)(?=\{)", text)) + ")"
    for quote in ("'", '"'):
        if quote not in text:
            return f"r{quote}{text}{quote}"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number_literal(x: float) -> str:
    """A double constant that reads back as the same value."""
    return f"double('{x!r}')" if x in (float("inf"), float("-inf")) or x != x else f"{float(x)!r}D"


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_numeric(dtype: T.DataType) -> bool:
    """Numbers only: a boolean is not numeric for profiling."""
    return isinstance(dtype, NUMERIC_TYPES)


def missing(name: str, dtype: T.DataType) -> str:
    c = ident(name)
    return f"({c} is null or isnan({c}))" if is_float(dtype) else f"({c} is null)"


def value_or_null(name: str, dtype: T.DataType) -> str:
    """NaN becomes NULL, so that grouping and aggregates see one kind of missing value."""
    c = ident(name)
    return f"(case when not isnan({c}) then {c} end)" if is_float(dtype) else c


def number(name: str, dtype: T.DataType) -> str:
    """A numeric (or boolean) column as DOUBLE, missing values as NULL."""
    if isinstance(dtype, T.BooleanType):
        return f"cast(cast({ident(name)} as int) as double)"
    return f"cast({value_or_null(name, dtype)} as double)"
