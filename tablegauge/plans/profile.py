"""The full profile of a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tablegauge.functions.lineage import cut_lineage
from tablegauge.operators import profile as p
from tablegauge.operators.quantiles import column_quantiles
from tablegauge.sources.summary import dataset_fingerprint, summary_line


@dataclass(frozen=True)
class Profile:
    """Every result of a profile.  All of them are as small as the schema."""

    summary: DataFrame
    fingerprint: DataFrame
    nulls: DataFrame
    duplicates: DataFrame
    cardinality: DataFrame
    patterns: DataFrame
    statistics: DataFrame
    outliers: DataFrame
    completeness: DataFrame
    column_health: DataFrame
    quality: DataFrame
    sketches: DataFrame           # (column, n_rows, sketch): distinct-value sketches, to be united over runs

    def as_dict(self) -> dict[str, DataFrame]:
        return dict(self.__dict__)


def run_full_profile(df: DataFrame) -> Profile:
    """Profile a table, computing every shared number once.

    One scan gives all facts that need no second look at the data, a quantile sketch of every numeric column among
    them; quartiles with the median (an exact count and the sort of what the sketch leaves), outliers, duplicates
    and distinct values each add their own.  These tables of a few rows are written to the checkpoint
    folder, and everything else is derived from them.
    """
    facts = cut_lineage(p.column_facts(df))
    numeric = facts.where("is_number").select("column", "present", "sketch").collect()
    present = {r["column"]: r["present"] for r in numeric}
    numbers = p.numeric_values(df)
    # The facts pass took a sketch of every numeric column: it proposes the first brackets of the quartiles.
    quartiles = column_quantiles(numbers, [0.25, 0.5, 0.75], present, {r["column"]: r["sketch"] for r in numeric})
    outliers = cut_lineage(p.iqr_outliers(numbers, {c: (q[0], q[2]) for c, q in quartiles.items()}))
    duplicates = cut_lineage(p.duplicate_detection(df))
    cardinality = cut_lineage(p.cardinality_analysis(df))

    nulls = p.null_shares(facts)
    completeness = p.completeness(facts)
    health = p.column_health(nulls, outliers)
    size = facts.agg(F.coalesce(F.max("n_rows"), F.lit(0)).alias("row_count"), F.sum("bytes").alias("bytes"))
    return Profile(
        summary=summary_line(size, df.columns), fingerprint=dataset_fingerprint(df), nulls=nulls,
        duplicates=duplicates, cardinality=cardinality, patterns=p.pattern_shares(facts),
        statistics=p.statistics_of(facts, {c: q[1] for c, q in quartiles.items()}), outliers=outliers,
        completeness=completeness, column_health=health,
        quality=p.blend_quality(completeness, duplicates, health),
        sketches=facts.select("column", "n_rows", F.col("distinct").alias("sketch")),
    )
