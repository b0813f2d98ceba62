"""The registered queries on the smallest tables: contract columns, one row a document, SQL twins."""

import pytest

import __spark_entry__ as driver
import corpus_pipeline
from compare import SF_DIR, differences, engine

QUERIES = driver.queries()
NAMES = [n for n in QUERIES if n.startswith("op") or n == "pipeline"]
COLUMNS = {
    1: ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"], 2: ["doc_id", "n_words", "n_removed", "kept_sha256"],
    4: ["doc_id", "class_id", "n_links"], 5: ["doc_id", "held_out", "score", "predicted"],
    6: ["query_id", "rank", "vec_id", "score"],
    7: ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    9: ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], 10: ["doc_id", "held_out", "lang_pred", "score"],
    11: ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    12: ["doc_id", "start", "n_tokens", "ids_crc32"],
    13: ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
}


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES if n != "pipeline") == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near duplicates", "benchmark decontamination", "secret scans", "best-fit packing"]


@pytest.mark.parametrize("n", sorted(COLUMNS))
def test_columns(spark, n):
    name = next(x for x in NAMES if x.startswith(f"op{n}_"))
    df = QUERIES[name](spark, SF_DIR)
    assert df.columns[: len(COLUMNS[n])] == COLUMNS[n]
    rows = df.collect()
    if n in (1, 2, 4, 5, 10, 12):
        ids = [r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect()]
        assert sorted(r.doc_id for r in rows) == sorted(ids)


def test_secret_scan_against_sql(spark):
    assert differences(spark, engine(), QUERIES["op1_secret_scan"], driver.oracle_sql()["op1_secret_scan"], SF_DIR) == []


@pytest.mark.parametrize("name", ["op11_hard_negatives"])
def test_against_sql(spark, name):
    assert differences(spark, engine(), QUERIES[name], driver.oracle_sql()[name], SF_DIR) == []


def test_stages_hand_on_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before
