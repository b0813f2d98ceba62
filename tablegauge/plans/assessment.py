"""From a dataset to its profile, rule results, history and forecasts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tablegauge.operators import drift, forecast, results
from tablegauge.operators.catalog import Rule, customer_rules
from tablegauge.operators.rules import apply_rules, rule_rollup
from tablegauge.plans.profile import Profile, run_full_profile
from tablegauge.sources.history import (
    History, get_column_metric_history, get_latest_schema, get_run_history, schema_table,
)
from tablegauge.sources.inference import infer_schema


@dataclass(frozen=True)
class RuleReport:
    rollup: DataFrame
    score: DataFrame
    dimensions: DataFrame
    exceptions: DataFrame


def run_rules(df: DataFrame, catalog: Sequence[Rule] | None = None,
              id_cols: Sequence[str] | None = None) -> RuleReport:
    """Score and dimensions from the fused roll-up, exceptions from the long results."""
    catalog = customer_rules() if catalog is None else catalog
    rollup = rule_rollup(df, catalog)
    return RuleReport(
        rollup=rollup,
        score=results.overall_rule_score(rollup),
        dimensions=results.summarize_by_dimension(rollup),
        exceptions=results.get_exceptions(apply_rules(df, catalog, id_cols)),
    )


@dataclass(frozen=True)
class Trends:
    run_history: DataFrame
    quality: DataFrame
    duplicates: DataFrame
    nulls: DataFrame
    volume: DataFrame
    columns_at_risk: DataFrame


def trends(history: History, dataset_name: str) -> Trends:
    runs = get_run_history(history.runs, dataset_name)
    return Trends(
        run_history=runs,
        quality=forecast.predict_quality_score(runs),
        duplicates=forecast.predict_duplicate_trend(runs),
        nulls=forecast.predict_null_trend(runs),
        volume=forecast.predict_volume_growth(runs),
        columns_at_risk=forecast.predict_columns_likely_to_fail(
            get_column_metric_history(history.metrics, history.runs, dataset_name)),
    )


def schema_changes(history: History, dataset_name: str, df: DataFrame) -> DataFrame | None:
    """Differences to the newest stored schema of the dataset; None on its first run."""
    snapshots = history.snapshots.where(F.col("dataset_name") == F.lit(dataset_name))
    if snapshots.isEmpty():
        return None
    return drift.compare_schemas(schema_table(get_latest_schema(snapshots)), infer_schema(df))


def record(history: History, dataset_name: str, df: DataFrame, label: str | None = None) -> tuple[str, Profile]:
    """Profile a dataset and append the run and its schema to the history; both appear together or not at all."""
    profile = run_full_profile(df)
    run_id = history.new_run_id()
    history.save_schema_snapshot(dataset_name, infer_schema(df), label, run_id=run_id)
    return history.save_profiling_run(dataset_name, profile, label, run_id=run_id), profile
