"""Schema comparison and two-sample distribution drift."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from tablegauge.functions.lineage import cut_lineage
from tablegauge.functions.missing import is_numeric, number
from tablegauge.functions.rounding import round_even
from tablegauge.operators.columns import column_types, empty_frame, name_at

# ---------------------------------------------------------------- schemas
# A schema is a table (column, dtype), see `sources.inference.infer_schema`.


def compare_schemas(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(change, column, old_type, new_type)`` with change in added, removed, type_changed."""
    before = old.select("column", F.col("dtype").alias("old_type"))
    after = new.select("column", F.col("dtype").alias("new_type"))
    change = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "type_changed")
    )
    joined = before.join(after, "column", "full_outer").select(change.alias("change"), "column", "old_type", "new_type")
    return joined.where("change is not null")


def added_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.join(old, "column", "left_anti").select("column")


def removed_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    return added_columns(new, old)


def type_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    return compare_schemas(old, new).where("change = 'type_changed'").drop("change")


def has_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: whether the two schemas differ."""
    return compare_schemas(old, new).agg((F.count(F.lit(1)) > 0).alias("has_changes"))


CHANGE_LOG_SCHEMA = ("dataset_name string, version int, snapshot_timestamp timestamp, previous_timestamp timestamp, "
                     "change string, column string, old_type string, new_type string")


def schema_change_log(snapshots: DataFrame) -> DataFrame:
    """Every change between consecutive schema snapshots of every dataset, from a history's ``schema_snapshots``.

    ``(dataset_name, version, snapshot_timestamp, previous_timestamp, change, column, old_type, new_type)`` with
    change in added, removed, type_changed.  ``version`` numbers the snapshots of a dataset from 1, oldest first;
    snapshots at the same moment are ordered by their text.  The first snapshot of a dataset has nothing to be
    compared with and gives no line, nor does a snapshot equal to the one before.  A snapshot whose text is not a
    JSON object, or null, counts as an empty schema.

    All datasets at once: the snapshots are dealt out by dataset and sorted by time once; each one is compared with
    the one before it by ``lag`` over the parsed maps, not by joining the table with itself.
    """
    parsed = F.coalesce(F.from_json("schema_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    order = Window.partitionBy("dataset_name").orderBy("snapshot_timestamp", "schema_json")
    versions = snapshots.select(
        "dataset_name", F.col("snapshot_timestamp").cast("timestamp").alias("snapshot_timestamp"),
        parsed.alias("new"), F.row_number().over(order).cast("int").alias("version"),
        F.lag(parsed).over(order).alias("old"), F.lag("snapshot_timestamp").over(order).cast("timestamp")
        .alias("previous_timestamp"))
    line = lambda change, k, old, new: F.struct(
        F.lit(change).alias("change"), k.alias("column"), old.alias("old_type"), new.alias("new_type"))
    gone = F.lit(None).cast("string")
    old, new = F.col("old"), F.col("new")
    changes = F.concat(
        F.transform(F.filter(F.map_keys("new"), lambda k: ~F.map_contains_key("old", k)),
                    lambda k: line("added", k, gone, new[k])),
        F.transform(F.filter(F.map_keys("old"), lambda k: ~F.map_contains_key("new", k)),
                    lambda k: line("removed", k, old[k], gone)),
        F.transform(F.filter(F.map_keys("new"), lambda k: F.map_contains_key("old", k) & ~old[k].eqNullSafe(new[k])),
                    lambda k: line("type_changed", k, old[k], new[k])))
    return versions.where(F.col("old").isNotNull()).select(
        "dataset_name", "version", "snapshot_timestamp", "previous_timestamp", F.explode(changes).alias("c")
    ).select("dataset_name", "version", "snapshot_timestamp", "previous_timestamp", "c.*")


# ---------------------------------------------------------------- distributions

_SEGMENTS = ("c int, n_old bigint, n_new bigint, first double, olds bigint, news bigint, "
             "highest double, lowest double")
DRIFT_SCHEMA = ("column string, n_old bigint, n_new bigint, ks_statistic double, p_value double, "
                "drift_detected boolean")


def _comparable(old: DataFrame, new: DataFrame) -> list[str]:
    """Columns that are numeric on both sides; booleans count as numbers here."""
    def numeric(df: DataFrame) -> list[str]:
        return [f.name for f in df.schema.fields if is_numeric(f.dataType) or isinstance(f.dataType, T.BooleanType)]
    other = set(numeric(new))
    return [c for c in numeric(old) if c in other]


def ks_distances(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(column, distance, n_old, n_new)``: the largest gap between the two distribution functions, per column.

    The values are counted per side first, so that a frequent value is one row from then on, and sorted by a
    range partitioning on (column, value), which splits a column over as many tasks as it needs.  Each task walks
    its sorted piece once and reports one line per column: how many values of either side it holds and how far
    the running difference goes up and down in it.  Putting the pieces one after the other needs only these lines.
    """
    columns = _comparable(old, new)
    if not columns:
        return empty_frame(old, "column string, distance double, n_old bigint, n_new bigint")
    counted = (
        _side(old, columns, 1).unionByName(_side(new, columns, 0)).groupBy("c", "v")
        .agg(F.sum("is_old").alias("olds"), F.count(F.lit(1)).alias("rows"))
    )
    # From the same counts: Spark shuffles them once for both.
    sizes = counted.groupBy("c").agg(F.sum("olds").alias("n_old"), F.sum(F.col("rows") - F.col("olds")).alias("n_new"))
    sizes = sizes.where("n_old >= 2 and n_new >= 2")
    ranged = (
        counted.join(F.broadcast(sizes), "c")                    # one line per column
        .select("c", "v", "olds", (F.col("rows") - F.col("olds")).alias("news"), "n_old", "n_new")
        .repartitionByRange(F.col("c"), F.col("v"))
        .sortWithinPartitions("c", "v")
    )
    segments = ranged.mapInPandas(_segment_walker(), _SEGMENTS)
    # One line per column and task from here on.
    earlier = Window.partitionBy("c").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.sum(part).over(earlier), F.lit(0)) / F.col(whole)
    start = share("olds", "n_old") - share("news", "n_new")
    placed = segments.select("c", "n_old", "n_new", "highest", "lowest", start.alias("start"))
    gap = F.greatest(F.abs(F.col("start") + F.col("highest")), F.abs(F.col("start") + F.col("lowest")))
    distances = placed.groupBy("c", "n_old", "n_new").agg(F.max(gap).alias("distance"))
    return distances.selectExpr(f"{name_at(columns, 'c')} as column", "distance", "n_old", "n_new")


def _side(df: DataFrame, columns: list[str], is_old: int) -> DataFrame:
    types = column_types(df)
    cells = [f"struct({i + 1} as c, {number(c, types[c])} as v)" for i, c in enumerate(columns)]
    return df.selectExpr(f"inline(array({', '.join(cells)}))", f"{is_old} as is_old").where("v is not null")


def _segment_walker() -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The walk over one sorted partition: one line per column in it.

    It is an inner function, so that it travels to the workers by value and they need not have this package.
    """
    def walk(batches):
        line = None
        for batch in batches:
            for c, piece in batch.groupby("c", sort=False):
                if line is None or c != line["c"]:
                    if line is not None:
                        yield pd.DataFrame([line])
                    line = {"c": c, "n_old": piece["n_old"].iloc[0], "n_new": piece["n_new"].iloc[0],
                            "first": piece["v"].iloc[0], "olds": 0, "news": 0,
                            "highest": float("-inf"), "lowest": float("inf")}
                olds = line["olds"] + piece["olds"].to_numpy().cumsum()
                news = line["news"] + piece["news"].to_numpy().cumsum()
                difference = olds / line["n_old"] - news / line["n_new"]
                line["highest"] = max(line["highest"], difference.max())
                line["lowest"] = min(line["lowest"], difference.min())
                line["olds"], line["news"] = int(olds[-1]), int(news[-1])
        if line is not None:
            yield pd.DataFrame([line])
    return walk


def ks_p_value(distance: Column, n_old: Column, n_new: Column) -> Column:
    """Two-sided p-value from the limiting distribution at the effective sample size.

    ``2 * sum (-1)^(k-1) exp(-2 k^2 x^2)`` with the finite-size argument of Vrbik (2018):
    ``x = sqrt(n) d + 1 / (6 sqrt(n)) + (sqrt(n) d - 1) / (4 n)``.
    """
    n = F.rint(n_old.cast("double") * n_new / (n_old + n_new))
    scaled = F.sqrt(n) * distance
    x = scaled + F.lit(1.0) / (F.lit(6.0) * F.sqrt(n)) + (scaled - F.lit(1.0)) / (F.lit(4.0) * n)
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(100)),
        lambda k: F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(F.lit(-2.0) * k * k * x * x))
    total = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    return F.when(distance <= 0, F.lit(1.0)).when(x < 0.2, F.lit(1.0)).otherwise(
        F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


# Fixed value: p-values are exact while neither sample has more values than this (the rule of the usual two-sample
# test's automatic method); beyond it they come from the limiting distribution.
EXACT_MOST = 10_000


def ks_exact_p(distance: float, n_old: int, n_new: int) -> float:
    """Exact two-sided p-value: the share of all orderings of the two samples (no ties) whose statistic is at least
    ``distance``.

    A uniformly random ordering is a random path through the (n_old + 1) x (n_new + 1) lattice; the probability of
    staying strictly inside the band ``|i * n_new - j * n_old| < distance * n_old * n_new`` is carried from one
    anti-diagonal to the next, so that the work is n_old * n_new steps on vectors and nothing overflows.
    """
    if distance <= 0:
        return 1.0
    n1, n2 = int(n_old), int(n_new)
    total, m = n1 + n2, round(distance * n1 * n2)
    prev, prev_lo = np.ones(1), 0
    for s in range(1, total + 1):
        lo, hi = max(0, s - n2), min(s, n1)
        i = np.arange(lo, hi + 1)
        cur = np.zeros(len(i))
        left = prev_lo + len(prev)
        # From (i - 1, j): a value of the first sample; from (i, j - 1): one of the second.
        come_x = (i - 1 >= prev_lo) & (i - 1 < left)
        cur[come_x] += prev[i[come_x] - 1 - prev_lo] * (n1 - i[come_x] + 1) / (total - s + 1)
        come_y = (i >= prev_lo) & (i < left)
        cur[come_y] += prev[i[come_y] - prev_lo] * (n2 - (s - 1 - i[come_y])) / (total - s + 1)
        cur[np.abs(i * n2 - (s - i) * n1) >= m] = 0.0
        prev, prev_lo = cur, lo
    return float(min(max(1.0 - prev[0], 0.0), 1.0))


def detect_data_drift(old: DataFrame, new: DataFrame, alpha: float = 0.05, method: str = "auto") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test for every column that is numeric on both sides.

    ``method="auto"`` gives exact p-values while neither side has more than `EXACT_MOST` values and those of the
    limiting distribution beyond (`ks_p_value`); ``"exact"`` and ``"asymp"`` choose one way for all columns.  The
    distances come from the distributed pass; the exact p-value needs only them and the two counts, one line per
    column.  ``n_old`` and ``n_new`` say how many values were compared.  Columns with fewer than two values on a
    side are left out.  The verdict uses the unrounded p-value.
    """
    if method not in ("auto", "exact", "asymp"):
        raise ValueError(f"unknown method {method!r}")
    tested = ks_distances(old, new)
    p = ks_p_value(F.col("distance"), F.col("n_old"), F.col("n_new"))
    if method != "asymp":
        tested = cut_lineage(tested)                     # one line per column
        exact = [(r["column"], ks_exact_p(r["distance"], r["n_old"], r["n_new"]))
                 for r in tested.select("column", "distance", "n_old", "n_new").collect()
                 if method == "exact" or max(r["n_old"], r["n_new"]) <= EXACT_MOST]
        if exact:
            found = tested.sparkSession.createDataFrame(exact, "column string, exact_p double")
            tested = tested.join(F.broadcast(found), "column", "left")
            p = F.coalesce(F.col("exact_p"), p)
    tested = tested.withColumn("p", p)
    return tested.select(
        "column", "n_old", "n_new", round_even(F.col("distance"), 4).alias("ks_statistic"),
        round_even(F.col("p"), 4).alias("p_value"), (F.col("p") < F.lit(alpha)).alias("drift_detected"))
