"""Folders that every executor can reach, for tables an operator writes and reads again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tablegauge.functions.lineage import cut_lineage, ensure_checkpoint_dir

__all__ = ["cut_lineage", "new_folder", "table", "is_small"]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for a new table below the folder named in ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_small(df: DataFrame, limit: int) -> bool:
    """Whether a table has at most ``limit`` rows; reads no more than it needs to tell."""
    return df.limit(limit + 1).count() <= limit
