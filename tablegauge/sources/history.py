"""Append-only run history in Parquet.

Tables under one folder: ``profiling_runs``, ``column_metrics``, ``column_sketches`` and ``schema_snapshots``.
Every write of a run goes to a folder of its own, ``<table>/run=<run id>/dataset_name=<name>``, so that writers
never share a temporary folder and several of them can append at once; the history of one dataset is still found by
its directory.  A run becomes visible when its line in ``published_runs`` is written, after all its tables: a run
whose writing stopped half-way is never seen, and its folders can be removed at leisure.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablegauge.functions.rounding import round_even
from tablegauge.operators.columns import empty_frame
from tablegauge.sources.summary import schema_fingerprint, schema_json

# The columns of the three history tables.
RUNS_SCHEMA = (
    "run_id string, dataset_id string, dataset_label string, run_timestamp timestamp, row_count bigint, "
    "column_count int, quality_score double, completeness_pct double, duplicate_pct double, avg_null_pct double, "
    "dataset_name string"
)
METRICS_SCHEMA = (
    "run_id string, column_name string, null_pct double, outlier_pct double, health_score double, "
    "dataset_name string"
)
SNAPSHOTS_SCHEMA = (
    "dataset_id string, dataset_label string, snapshot_timestamp timestamp, schema_json string, "
    "dataset_name string"
)
SKETCHES_SCHEMA = "run_id string, column_name string, n_rows bigint, sketch binary, dataset_name string"
RUNS, METRICS, SNAPSHOTS = "profiling_runs", "column_metrics", "schema_snapshots"
SKETCHES = "column_sketches"
PUBLISHED_SCHEMA = "run_id string, published_at timestamp, dataset_name string"
PUBLISHED = "published_runs"


class History:
    """The history tables in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _scan(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema).withColumn("run", F.lit(None).cast("string"))

    def _read(self, table: str, schema: str) -> DataFrame:
        """The lines of published runs only."""
        published = self._scan(PUBLISHED, PUBLISHED_SCHEMA).select("run")
        return self._scan(table, schema).join(published, "run", "left_semi").drop("run")

    def _append(self, rows: DataFrame, table: str, schema: str, run: str) -> None:
        fields = empty_frame(rows, schema).schema.fields
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
        typed.write.mode("append").partitionBy("dataset_name").parquet(f"{self.folder}/{table}/run={run}")

    def _publish(self, run: str, dataset_name: str) -> None:
        line = self.spark.range(1).select(F.lit(run).alias("run_id"), F.current_timestamp().alias("published_at"),
                                          F.lit(dataset_name).alias("dataset_name"))
        self._append(line, PUBLISHED, PUBLISHED_SCHEMA, run)

    @staticmethod
    def new_run_id() -> str:
        return str(uuid.uuid4())

    @property
    def runs(self) -> DataFrame:
        return self._read(RUNS, RUNS_SCHEMA)

    @property
    def metrics(self) -> DataFrame:
        return self._read(METRICS, METRICS_SCHEMA)

    @property
    def snapshots(self) -> DataFrame:
        return self._read(SNAPSHOTS, SNAPSHOTS_SCHEMA)

    @property
    def sketches(self) -> DataFrame:
        """Distinct-value sketches of the columns of every run (see `operators.profile.united_cardinality`)."""
        return self._read(SKETCHES, SKETCHES_SCHEMA)

    def save_profiling_run(self, dataset_name: str, profile, dataset_label: str | None = None,
                           at: datetime | None = None, run_id: str | None = None) -> str:
        """Append one run, its column metrics and the distinct-value sketches of its columns, then publish the run;
        returns the run id.  ``profile`` is a `Profile`.  Lines written before under the same ``run_id`` (a schema
        snapshot, say) are published with it."""
        run_id = run_id or self.new_run_id()
        moment = F.lit(at or datetime.now(timezone.utc)).cast("timestamp")
        metrics = column_metrics(profile.nulls, profile.outliers, profile.column_health)
        self._append(
            metrics.select(F.lit(run_id).alias("run_id"), "*", F.lit(dataset_name).alias("dataset_name")),
            METRICS, METRICS_SCHEMA, run_id)
        sketches = getattr(profile, "sketches", None)
        if sketches is not None:
            self._append(sketches.select(F.lit(run_id).alias("run_id"), F.col("column").alias("column_name"),
                                         "n_rows", "sketch", F.lit(dataset_name).alias("dataset_name")),
                         SKETCHES, SKETCHES_SCHEMA, run_id)
        run = run_line(profile).select(
            F.lit(run_id).alias("run_id"), F.lit(dataset_label or dataset_name).alias("dataset_label"),
            moment.alias("run_timestamp"), "*", F.lit(dataset_name).alias("dataset_name"))
        self._append(run, RUNS, RUNS_SCHEMA, run_id)
        self._publish(run_id, dataset_name)
        return run_id

    def save_schema_snapshot(self, dataset_name: str, schema: DataFrame, dataset_label: str | None = None,
                             at: datetime | None = None, run_id: str | None = None) -> str:
        """Append a schema ``(column, dtype)`` with its fingerprint.  Without ``run_id`` it is published at once;
        with one it appears when that run is published."""
        own = run_id is None
        run_id = run_id or self.new_run_id()
        self._append(snapshot_line(schema, dataset_name).select(
            "dataset_id", F.lit(dataset_label or dataset_name).alias("dataset_label"),
            F.lit(at or datetime.now(timezone.utc)).cast("timestamp").alias("snapshot_timestamp"),
            "schema_json", "dataset_name",
        ), SNAPSHOTS, SNAPSHOTS_SCHEMA, run_id)
        if own:
            self._publish(run_id, dataset_name)
        return run_id


# ---------------------------------------------------------------- lines to append

def run_line(profile) -> DataFrame:
    """The run-level numbers of a profile as one row."""
    average = profile.nulls.agg(F.coalesce(round_even(F.avg("null_pct"), 2), F.lit(0.0)).alias("avg_null_pct"))
    parts = profile.summary.select("row_count", "column_count")
    for one_row in (profile.quality, profile.completeness, profile.duplicates.select("duplicate_pct"),
                    average, profile.fingerprint):
        parts = parts.unionByName(one_row, allowMissingColumns=True)
    names = ["row_count", "column_count", "quality_score", "completeness_pct", "duplicate_pct", "avg_null_pct",
             "dataset_id"]
    return parts.agg(*[F.max(c).alias(c) for c in names])


def snapshot_line(schema: DataFrame, dataset_name: str) -> DataFrame:
    """``(dataset_name, dataset_id, schema_json)`` of a schema ``(column, dtype)``."""
    named = schema.withColumn("dataset", F.lit(dataset_name))
    return schema_json(named).join(schema_fingerprint(named), "dataset").select(
        F.col("dataset").alias("dataset_name"), "dataset_id", "schema_json")


def column_metrics(nulls: DataFrame, outliers: DataFrame, health: DataFrame) -> DataFrame:
    """``(column_name, null_pct, outlier_pct, health_score)``; columns without outliers have 0.0."""
    return (
        health.join(F.broadcast(nulls.select("column", "null_pct")), "column", "left")      # one line per column
        .join(F.broadcast(outliers.select("column", "outlier_pct")), "column", "left")
        .select(F.col("column").alias("column_name"), "null_pct",
                F.coalesce("outlier_pct", F.lit(0.0)).alias("outlier_pct"), "health_score")
    )


# ---------------------------------------------------------------- queries

def _of(df: DataFrame, dataset_name: str | None, dataset_id: str | None) -> DataFrame:
    """Lines of a dataset by its name, by the fingerprint of its schema, by both, or all of them."""
    for column, value in (("dataset_name", dataset_name), ("dataset_id", dataset_id)):
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def get_run_history(runs: DataFrame, dataset_name: str | None = None, dataset_id: str | None = None) -> DataFrame:
    return _of(runs, dataset_name, dataset_id).orderBy("run_timestamp")


def get_column_metric_history(metrics: DataFrame, runs: DataFrame, dataset_name: str | None = None,
                              dataset_id: str | None = None) -> DataFrame:
    """Metrics with the time of their run, oldest first; of one dataset, or of all."""
    metrics, runs = _of(metrics, dataset_name, None), _of(runs, dataset_name, dataset_id)
    timed = runs.select("run_id", "run_timestamp", "dataset_name", "dataset_id")
    return (
        metrics.drop("dataset_name").join(timed, "run_id")
        .select("run_timestamp", "dataset_name", "dataset_id", "column_name", "null_pct", "outlier_pct",
                "health_score")
        .orderBy("run_timestamp", "column_name")
    )


def get_latest_schema(snapshots: DataFrame, dataset_name: str | None = None,
                      dataset_id: str | None = None) -> DataFrame:
    """``(dataset_name, schema_json)`` of the newest snapshot of every dataset, or of one."""
    return _of(snapshots, dataset_name, dataset_id).groupBy("dataset_name").agg(
        F.max_by("schema_json", F.struct("snapshot_timestamp", "schema_json")).alias("schema_json"))


def list_known_datasets(runs: DataFrame, by: str = "dataset_name") -> DataFrame:
    """Every dataset with the label of its last run, when that was, and how many runs there are; newest first.

    ``by="dataset_id"`` tells datasets apart by the fingerprint of their schema.
    """
    return runs.groupBy(by).agg(
        F.max_by("dataset_label", F.struct("run_timestamp", "dataset_label")).alias("dataset_label"),
        F.max("run_timestamp").alias("last_run"),
        F.count(F.lit(1)).alias("run_count"),
    ).orderBy(F.desc("last_run"), F.asc(by))


def schema_table(latest: DataFrame) -> DataFrame:
    """A stored ``schema_json`` back to ``(column, dtype)``, one line per column."""
    parsed = F.from_json("schema_json", "map<string,string>")
    return latest.select(F.explode(parsed).alias("column", "dtype"))
