"""Ranked views over profile results; each line is a column, ties are broken by its name."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def worst_columns(measures: DataFrame, measure: str, ascending: bool, n: int | None = None) -> DataFrame:
    """The measured columns, worst first: the ``n`` worst, or all of them."""
    ranked = measures.orderBy(F.asc(measure) if ascending else F.desc(measure), F.asc("column"))
    return ranked if n is None else ranked.limit(n)


def worst_health(health: DataFrame, n: int | None = None) -> DataFrame:
    return worst_columns(health, "health_score", True, n)


def worst_nulls(nulls: DataFrame, n: int | None = None) -> DataFrame:
    return worst_columns(nulls, "null_pct", False, n)


def worst_outliers(outliers: DataFrame, n: int | None = None) -> DataFrame:
    return worst_columns(outliers, "outlier_pct", False, n)


def quality_trend(runs: DataFrame) -> DataFrame:
    """``(dataset_name, run_timestamp, quality_score)`` of datasets with more than one run, oldest first."""
    several = runs.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("dataset_name")
    return runs.join(several, "dataset_name", "left_semi").select(
        "dataset_name", "run_timestamp", "quality_score").orderBy("dataset_name", "run_timestamp")


def dimension_profile(summary: DataFrame) -> DataFrame:
    """The dimension summary as a view; it is sorted already."""
    return summary
