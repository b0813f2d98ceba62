"""Linear trends over the run history.

A trend is the least-squares line of a value on the position of its run (0, 1, 2 ...), whatever the time between
runs.  Any number of series is fitted in one go: the keys say which rows belong together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablegauge.functions.missing import missing, quoted
from tablegauge.functions.rounding import round_even

DEFAULT_HEALTH_THRESHOLD = 60.0


def run_positions(history: DataFrame, keys: Sequence[str], time_col: str, value_cols: Sequence[str]) -> DataFrame:
    """Adds ``run_index``, the position of a row in its series by time, starting at 0.

    A long series is numbered day by day and the days are put one after the other, so that no series has to fit
    into one task.
    """
    dated = history.withColumn("__day", quoted(time_col).cast("date"))
    parts = [*keys, "__day"]
    in_day = Window.partitionBy(*parts).orderBy(time_col, *value_cols)
    numbered = dated.withColumn("__in_day", F.row_number().over(in_day) - 1)
    per_day = dated.groupBy(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(parts)]).agg(
        F.count(F.lit(1)).alias("__rows"))
    series = [f"__p{i}" for i in range(len(keys))]
    before = (
        Window.partitionBy(*series).orderBy(f"__p{len(keys)}")                # one line per day
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_day.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
    same_day = [F.col(c).eqNullSafe(F.col(f"__p{i}")) for i, c in enumerate(parts)]
    return numbered.join(offsets, same_day, "inner").select(
        *history.columns, (F.col("__before") + F.col("__in_day")).alias("run_index"))


def fit_trend(history: DataFrame, value_col: str, keys: Sequence[str] = (), time_col: str = "run_timestamp") -> DataFrame:
    """``(<keys>, runs, slope, intercept, last_value)`` per series; points without a value are left out.

    Slope and intercept are NULL for a single run; a series without values has no line.
    """
    absent = missing(value_col, history.schema[value_col].dataType)
    present = history.where(f"not {absent}").select(*keys, time_col, value_col)
    points = run_positions(present, keys, time_col, [value_col]).withColumn("y", quoted(value_col).cast("double"))
    lines = points.groupBy(*keys) if keys else points.groupBy()
    fitted = lines.agg(
        F.count(F.lit(1)).alias("runs"),
        F.regr_slope("y", "run_index").alias("slope"),
        F.regr_intercept("y", "run_index").alias("intercept"),
        F.max_by("y", "run_index").alias("last_value"),
    )
    several = F.col("runs") >= 2
    return fitted.where("runs > 0").select(
        *keys, "runs", F.when(several, F.col("slope")).alias("slope"),
        F.when(several, F.col("intercept")).alias("intercept"), "last_value")


def prediction(steps_ahead: int) -> Column:
    """The line continued ``steps_ahead`` runs, two decimals; a single run predicts itself, unrounded."""
    ahead = F.col("intercept") + F.col("slope") * (F.col("runs") - 1 + F.lit(steps_ahead))
    return F.when(F.col("runs") == 1, F.col("last_value")).otherwise(round_even(ahead, 2))


def forecast_next_value(history: DataFrame, value_col: str, steps_ahead: int = 1, keys: Sequence[str] = (),
                        time_col: str = "run_timestamp") -> DataFrame:
    """``(<keys>, predicted)``; without runs there is no line."""
    return fit_trend(history, value_col, keys, time_col).select(*keys, prediction(steps_ahead).alias("predicted"))


def predict_quality_score(runs: DataFrame, keys: Sequence[str] = ("dataset_name",)) -> DataFrame:
    return forecast_next_value(runs, "quality_score", keys=keys)


def predict_duplicate_trend(runs: DataFrame, keys: Sequence[str] = ("dataset_name",)) -> DataFrame:
    return forecast_next_value(runs, "duplicate_pct", keys=keys)


def predict_null_trend(runs: DataFrame, keys: Sequence[str] = ("dataset_name",)) -> DataFrame:
    return forecast_next_value(runs, "avg_null_pct", keys=keys)


def predict_volume_growth(runs: DataFrame, keys: Sequence[str] = ("dataset_name",)) -> DataFrame:
    return forecast_next_value(runs, "row_count", keys=keys)


def predict_columns_likely_to_fail(column_history: DataFrame, health_threshold: float = DEFAULT_HEALTH_THRESHOLD,
                                   keys: Sequence[str] = (), time_col: str = "run_timestamp") -> DataFrame:
    """Current and predicted health per column, lowest prediction first, with an ``at_risk`` flag."""
    trends = fit_trend(column_history, "health_score", [*keys, "column_name"], time_col)
    predicted = prediction(1)
    return trends.select(
        *keys, F.col("column_name").alias("column"),
        round_even(F.col("last_value"), 2).alias("current_health_score"),
        predicted.alias("predicted_next_health_score"),
        (predicted < F.lit(health_threshold)).alias("at_risk"),
    ).orderBy("predicted_next_health_score", "column")
