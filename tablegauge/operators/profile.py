"""Column and table profiling.

Everything that is one number per column comes from one wide aggregate (`per_column`).  Only duplicates and
cardinality shuffle, and they shuffle keys of bounded width that were combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tablegauge.functions.lineage import cut_lineage
from tablegauge.functions.missing import ident, is_numeric, literal, missing, number, number_literal, value_or_null
from tablegauge.functions.rounding import percent, ratio, round_even
from tablegauge.functions.text import (
    EMAIL_PATTERN, NESTED_TYPES, PHONE_PATTERN, cell_text, compact_key, encoded, matches_from_start,
)
from tablegauge.operators.columns import ROWS, column_types, empty_frame, name_at, name_lines, per_column
from tablegauge.operators.quantiles import column_quantiles, sketch_expression
from tablegauge.sources.summary import bytes_of

NULLS_SCHEMA = "column string, null_count bigint, null_pct double"
STATISTICS_SCHEMA = "column string, mean double, std double, min double, max double, median double"
OUTLIERS_SCHEMA = "column string, outlier_count bigint, outlier_pct double"
CARDINALITY_SCHEMA = "column string, unique_count bigint, unique_ratio double"
PATTERNS_SCHEMA = "column string, pattern string, match_pct double"
HEALTH_SCHEMA = "column string, health_score double"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


# ---------------------------------------------------------------- missing values and completeness

def missing_counts(df: DataFrame) -> DataFrame:
    return per_column(df, df.columns, {
        "n_rows": ROWS, "null_count": lambda c, t: f"count_if({missing(c, t)})",
    }, "column string, n_rows bigint, null_count bigint")


def null_analysis(df: DataFrame) -> DataFrame:
    """Missing values per column; the percentage is NULL for a table without rows."""
    return null_shares(missing_counts(df))


def null_shares(counts: DataFrame) -> DataFrame:
    """The same from `missing_counts`."""
    return counts.select("column", "null_count", percent(F.col("null_count"), F.col("n_rows")).alias("null_pct"))


def completeness_score(df: DataFrame) -> DataFrame:
    """Share of present cells in the whole table, one row."""
    return completeness(missing_counts(df))


def completeness(counts: DataFrame) -> DataFrame:
    """The same from `missing_counts`."""
    cells = counts.agg(
        F.sum(F.col("n_rows") - F.col("null_count")).alias("filled"), F.sum("n_rows").alias("cells"))
    return cells.select(F.coalesce(percent(F.col("filled"), F.col("cells")), F.lit(0.0)).alias("completeness_pct"))


# ---------------------------------------------------------------- duplicates and cardinality

def duplicate_detection(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row, one row with the count and the percentage.

    A row travels as one digest of 32 bytes, however wide it is; grouping combines equal ones before the shuffle.
    """
    cells = [encoded(value_or_null(c, t), t) for c, t in column_types(df).items()]
    row = f"unhex(sha2(concat({', '.join(cells)}), 256))" if cells else "cast('' as binary)"
    groups = df.selectExpr(f"{row} as row_key").groupBy("row_key").agg(F.count(F.lit(1)).alias("copies"))
    counts = groups.agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n_rows"),
    )
    share = F.coalesce(percent(F.col("duplicate_rows"), F.col("n_rows")), F.lit(0.0))
    return counts.select("duplicate_rows", share.alias("duplicate_pct"))


def cardinality_analysis(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct present values per column and their ratio to all rows.

    Exact by default: one scan stacks the columns, a field for each value type, and a two-level grouping counts
    them, the first level of which combines before it shuffles.  ``approximate=True`` uses one sketch per column instead and
    does not shuffle any values.
    """
    if approximate:
        counts = per_column(df, df.columns, {
            "n_rows": ROWS, "unique_count": lambda c, t: f"approx_count_distinct({compact_key(c, t)})",
        }, "column string, n_rows bigint, unique_count bigint")
    else:
        counts = _exact_cardinality(df)
    share = F.coalesce(ratio(F.col("unique_count"), F.col("n_rows")), F.lit(0.0))
    return counts.select("column", "unique_count", round_even(share, 4).alias("unique_ratio"))


# Distinct-value sketches (HLL, 2^SKETCH_LG_K registers): relative standard error about 1.04 / 2^(SKETCH_LG_K / 2),
# i.e. 0.8 %; DISTINCT_BOUND is three times that.
SKETCH_LG_K = 14
DISTINCT_BOUND = 3 * 1.04 / 2 ** (SKETCH_LG_K / 2)
SKETCHES_SCHEMA = "column string, n_rows bigint, sketch binary"


def _sketch_key(c: str, t: T.DataType) -> str:
    """Text (or bytes) equal exactly when the present values are; NULL for a missing value."""
    if isinstance(t, T.StringType):
        return ident(c)
    if isinstance(t, T.BinaryType):
        return ident(c)
    if isinstance(t, NESTED_TYPES):
        return f"cast({compact_key(c, t)} as string)"
    return f"(case when {value_or_null(c, t)} is not null then {encoded(ident(c), t)} end)"


def distinct_sketches(df: DataFrame) -> DataFrame:
    """``(column, n_rows, sketch)``: a mergeable HLL sketch of every column's present values, in one scan that
    shuffles no values.  Sketches of several deliveries are united by `united_cardinality` without reading the data
    again."""
    return per_column(df, df.columns, {
        "n_rows": ROWS, "sketch": lambda c, t: f"hll_sketch_agg({_sketch_key(c, t)}, {SKETCH_LG_K})",
    }, SKETCHES_SCHEMA)


def united_cardinality(sketches: DataFrame, by: Sequence[str] = ("column",)) -> DataFrame:
    """``(*by, n_rows, unique_count, unique_ratio)`` over all sketches of each group, e.g. all runs of a dataset.

    The estimate is within ``DISTINCT_BOUND`` of the exact count with very high probability; below a few thousand
    values it is exact.
    """
    united = sketches.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), F.hll_union_agg("sketch", True).alias("u"))
    share = F.coalesce(ratio(F.col("unique_count"), F.col("n_rows")), F.lit(0.0))
    return united.select(*by, "n_rows", F.hll_sketch_estimate("u").alias("unique_count")).withColumn(
        "unique_ratio", round_even(share, 4))


def _exact_cardinality(df: DataFrame) -> DataFrame:
    if not df.columns:
        return empty_frame(df, "column string, unique_count bigint, n_rows bigint")
    families = _value_families(df)
    fields = {family: f"v{i}" for i, family in enumerate(families)}
    cells = []
    for family, keys in families.items():
        for name, key in keys.items():
            values = [f"cast({key if family == f else 'null'} as {f}) as {v}" for f, v in fields.items()]
            cells.append(f"struct({len(cells) + 1} as c, {', '.join(values)})")
    names = [name for keys in families.values() for name in keys]
    values = df.selectExpr(f"inline(array({', '.join(cells)}))").groupBy("c", *fields.values()).agg(
        F.count(F.lit(1)).alias("rows"))
    present = " or ".join(f"{v} is not null" for v in fields.values())
    counts = values.groupBy("c").agg(F.expr(f"count_if({present})").alias("unique_count"), F.sum("rows").alias("n_rows"))
    # A table without rows still has one line per column; either side has one line per column.
    counted = F.broadcast(counts.selectExpr(f"{name_at(names, 'c')} as column", "unique_count", "n_rows"))
    return name_lines(df, df.columns).join(counted, "column", "left").select(
        "column", F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def _value_families(df: DataFrame) -> dict[str, dict[str, str]]:
    """Keys of the columns by the type they are compared in, so that numbers are never turned into text."""
    families: dict[str, dict[str, str]] = {}
    for name, t in column_types(df).items():
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            family = "bigint"
        elif isinstance(t, (T.FloatType, T.DoubleType)):
            family = "double"
        elif isinstance(t, (T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
            family = t.simpleString()
        else:
            family = "string"
        families.setdefault(family, {})[name] = compact_key(name, t)
    return families


# ---------------------------------------------------------------- patterns

def named_patterns(columns: Sequence[str]) -> dict[str, tuple[str, str]]:
    """Columns whose name suggests a pattern; an e-mail hint wins over a phone hint."""
    found = {}
    for name in columns:
        lowered = name.lower()
        if "email" in lowered:
            found[name] = ("email", EMAIL_PATTERN)
        elif "phone" in lowered:
            found[name] = ("phone", PHONE_PATTERN)
    return found


def pattern_validation(df: DataFrame) -> DataFrame:
    """Share of present values that match the pattern their column name suggests."""
    patterns = named_patterns(df.columns)
    if not patterns:
        return empty_frame(df, PATTERNS_SCHEMA)
    counts = per_column(df, list(patterns), {
        "pattern": lambda c, t: f"any_value({literal(patterns[c][0])})",
        "present": lambda c, t: f"count({value_or_null(c, t)})",
        "matched": lambda c, t: f"count_if(not {missing(c, t)} and "
                                f"{matches_from_start(cell_text(c, t), patterns[c][1])})",
    }, PATTERNS_SCHEMA)
    return pattern_shares(counts)


def pattern_shares(counts: DataFrame) -> DataFrame:
    """From lines ``(column, pattern, present, matched)``; columns without values have none."""
    return counts.where("pattern is not null and present > 0").select(
        "column", "pattern", percent(F.col("matched"), F.col("present")).alias("match_pct"))


# ---------------------------------------------------------------- statistics and outliers

def numeric_values(df: DataFrame) -> DataFrame:
    """The numeric columns only, as doubles with missing values as NULL."""
    types = column_types(df)
    return df.selectExpr(*[f"{number(c, types[c])} as {ident(c)}" for c in numeric_columns(df)])


def statistical_profile(df: DataFrame) -> DataFrame:
    """Mean, sample deviation, extremes and median of the numeric columns, unrounded.

    A table without rows gives no lines; a numeric column without values gives a line of NULLs.
    """
    numbers = numeric_values(df)
    return statistics(numbers, {c: q[0] for c, q in column_quantiles(numbers, [0.5]).items()})


def statistics(numbers: DataFrame, medians: dict[str, float]) -> DataFrame:
    moments = per_column(numbers, numbers.columns, {
        "n_rows": ROWS,
        "mean": lambda c, t: f"avg({ident(c)})",
        "std": lambda c, t: f"stddev_samp({ident(c)})",
        "min": lambda c, t: f"min({ident(c)})",
        "max": lambda c, t: f"max({ident(c)})",
        "median": lambda c, t: f"any_value({number_literal(medians[c]) if c in medians else 'double(null)'})",
    }, "n_rows bigint, " + STATISTICS_SCHEMA)
    return moments.where("n_rows > 0").drop("n_rows")


def outlier_detection(df: DataFrame, method: str = "iqr") -> DataFrame:
    """Outliers per numeric column.

    ``iqr``: outside the quartiles by more than 1.5 inter-quartile ranges.  Any other method: more than three
    population deviations from the mean.  Both find the limits first (a few numbers per column) and then count
    in one pass over the numeric columns.
    """
    numbers = numeric_values(df)
    if method == "iqr":
        return iqr_outliers(numbers, {c: (q[0], q[1]) for c, q in column_quantiles(numbers, [0.25, 0.75]).items()})
    return zscore_outliers(numbers)


def iqr_outliers(numbers: DataFrame, quartiles: dict[str, tuple[float, float]]) -> DataFrame:
    def test(column: str) -> str:
        q1, q3 = quartiles[column]
        spread, v = 1.5 * (q3 - q1), ident(column)
        tests = [f"{v} {sign} {number_literal(limit)}" for sign, limit in (("<", q1 - spread), (">", q3 + spread))
                 if limit == limit]                                  # infinite quartiles may leave no limit
        return " or ".join(tests) or "false"
    return _count_outliers(numbers, [c for c in numbers.columns if c in quartiles], test)


def zscore_outliers(numbers: DataFrame) -> DataFrame:
    found = per_column(numbers, numbers.columns, {
        "mean": lambda c, t: f"avg({ident(c)})",
        "deviation": lambda c, t: f"stddev_pop({ident(c)})",
    }, "column string, mean double, deviation double")
    moments = {r["column"]: (r["mean"], r["deviation"]) for r in found.collect() if r["mean"] is not None}

    def test(column: str) -> str:
        mean, deviation = moments[column]
        # With an infinity among the values nothing is a number of deviations away.
        if deviation == 0 or mean != mean or deviation != deviation:
            return "false"
        return f"abs(({ident(column)} - {number_literal(mean)}) / {number_literal(deviation)}) > 3.0D"
    return _count_outliers(numbers, [c for c in numbers.columns if c in moments], test)


def _count_outliers(numbers: DataFrame, columns: list[str], test: Callable[[str], str]) -> DataFrame:
    counts = per_column(numbers, columns, {
        "present": lambda c, t: f"count({ident(c)})",
        "outlier_count": lambda c, t: f"count_if({test(c)})",
    }, "column string, present bigint, outlier_count bigint")
    return counts.select(
        "column", "outlier_count", percent(F.col("outlier_count"), F.col("present")).alias("outlier_pct"))


# ---------------------------------------------------------------- everything one scan can tell

# Columns per aggregate here, where each column has a dozen of them.
FACT_BLOCK = 16
FACTS_SCHEMA = (
    "column string, n_rows bigint, null_count bigint, present bigint, bytes bigint, is_number boolean, mean double, "
    "std double, min double, max double, pattern string, matched bigint, sketch array<double>, distinct binary"
)


def column_facts(df: DataFrame) -> DataFrame:
    """All numbers per column that a single pass gives: missing values, size, moments, extremes, pattern matches."""
    patterns = named_patterns(df.columns)

    def moment(function: str) -> Callable[[str, T.DataType], str]:
        return lambda c, t: f"{function}({number(c, t)})" if is_numeric(t) else "double(null)"

    def matched(c: str, t: T.DataType) -> str:
        if c not in patterns:
            return "0L"
        return f"count_if(not {missing(c, t)} and {matches_from_start(cell_text(c, t), patterns[c][1])})"
    return per_column(df, df.columns, {
        "n_rows": ROWS,
        "null_count": lambda c, t: f"count_if({missing(c, t)})",
        "present": lambda c, t: f"count({value_or_null(c, t)})",
        "bytes": bytes_of,
        "is_number": lambda c, t: str(is_numeric(t)).lower(),
        "mean": moment("avg"), "std": moment("stddev_samp"), "min": moment("min"), "max": moment("max"),
        "pattern": lambda c, t: literal(patterns[c][0] if c in patterns else None),
        "matched": matched,
        "sketch": lambda c, t: sketch_expression(number(c, t)) if is_numeric(t) else "cast(null as array<double>)",
        "distinct": lambda c, t: f"hll_sketch_agg({_sketch_key(c, t)}, {SKETCH_LG_K})",
    }, FACTS_SCHEMA, FACT_BLOCK)


def statistics_of(facts: DataFrame, medians: dict[str, float]) -> DataFrame:
    """`statistical_profile` from `column_facts`."""
    known = ", ".join(f"{literal(c)}, {number_literal(m)}" for c, m in medians.items())
    median = f"try_element_at(map({known}), column)" if known else "double(null)"
    return facts.where("is_number and n_rows > 0").selectExpr(
        "column", "mean", "std", "min", "max", f"{median} as median")


# ---------------------------------------------------------------- scores

def column_health(nulls: DataFrame, outliers: DataFrame) -> DataFrame:
    """Health per column from its rounded missing and outlier percentages (weights 0.7 and 0.3).

    NULL for a table without rows.
    """
    penalty = (F.col("null_pct") * F.lit(0.7)
               + F.coalesce("outlier_pct", F.lit(0.0)) * F.lit(0.3))
    joined = nulls.join(F.broadcast(outliers), "column", "left")      # one row per column on either side
    return joined.select(
        "column", F.when(F.col("null_pct").isNotNull(), round_even(
            F.greatest(F.lit(100.0) - penalty, F.lit(0.0)), 2)).alias("health_score"))


def column_health_score(df: DataFrame) -> DataFrame:
    return column_health(null_analysis(df), outlier_detection(df))


def quality_score(completeness: Column, duplicate_pct: Column, average_health: Column) -> Column:
    """Weighted blend of completeness, absence of duplicates and average column health."""
    return round_even(
        completeness * F.lit(0.4) + (F.lit(100.0) - duplicate_pct) * F.lit(0.2) + average_health * F.lit(0.4), 2)


def overall_quality_score(df: DataFrame) -> DataFrame:
    """The table's quality from 0 to 100, one row; NULL for a table without rows."""
    counts = cut_lineage(missing_counts(df))                   # one line per column, used twice
    health = column_health(null_shares(counts), outlier_detection(df))
    return blend_quality(completeness(counts), duplicate_detection(df), health)


def blend_quality(completeness: DataFrame, duplicates: DataFrame, health: DataFrame) -> DataFrame:
    """Bring three one-line measures together by a union, not by a join without keys."""
    parts = (
        completeness.select("completeness_pct")
        .unionByName(duplicates.select("duplicate_pct"), allowMissingColumns=True)
        .unionByName(health.agg(F.avg("health_score").alias("average_health")), allowMissingColumns=True)
    )
    line = parts.agg(*[F.max(c).alias(c) for c in ("completeness_pct", "duplicate_pct", "average_health")])
    return line.select(
        quality_score(F.col("completeness_pct"), F.col("duplicate_pct"), F.col("average_health"))
        .alias("quality_score"))
