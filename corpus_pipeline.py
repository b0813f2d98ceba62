"""From raw documents to packed token sequences: the stages, and all of them in a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablegauge.llm import decontaminate, nearjoin, packing, secrets, toxicity
from tablegauge.llm.queries import word_tokenizer
from tablegauge.llm.shared import new_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return nearjoin.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark question, verbatim or with other values, go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"),
                                       options=decontaminate.Templates(verbatim=True))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secrets.redact(docs, ["doc_id"])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of token sequences."""
    return packing.pack_documents(docs, word_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]
# The field's weights, the signatures and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage works on what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "corpus")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
