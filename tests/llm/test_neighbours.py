import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import SF_DIR
from tablegauge.llm.neighbours import Index, nearest, rotations

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, query, k=20):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    q = x[ids == query][0]
    score = (x * q).sum(axis=1)
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != query][:k]
    return [(int(ids[i]), float(score[i])) for i in order]


def test_recall_and_scores(spark):
    df = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {}
    for r in nearest(df, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    scores = {}
    for query, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, len(found) + 1))
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(found, found[1:]))
        want = brute(rows, query)
        scores = dict(brute(rows, query, len(rows)))
        assert all(abs(scores[i] - s) < 1e-12 for _, i, s in found)
        hits += len({i for i, _ in want} & {x[1] for x in found})
        total += len(want)
    assert len(got) == sum(i % 20 == 0 for i, _ in rows) and hits / total >= 0.9


def test_edge_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=6) * (1 + i % 7)], 0) for i in range(60)]
    rows += [(100 + i, rows[0][1], 0) for i in range(40)]
    bad = [(200, None, 0), (201, [0.0] * 6, 0), (202, [float("nan")] + [1.0] * 5, 0), (203, [float("inf")] + [1.0] * 5, 0),
           (204, [None] + [1.0] * 5, 0), (None, [1.0] * 6, 0), (205, [], 0), (206, [1.0] * 3, 0)]
    df = spark.createDataFrame(rows + bad, SCHEMA).select("*", F.lit(1).alias("id"), F.lit(2).alias("v"))
    index = Index(tables=8, probes=16, block=8, query_block=3)
    got = {}
    for r in nearest(df, F.col("id") % 20 == 0, index=index).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    stored = [(i, np.float32(v).astype(float)) for i, v, _ in rows]
    assert set(got) == {0, 20, 40, 100, 120}
    for query, found in got.items():
        assert found == brute(stored, query), query


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nearest(empty, F.col("id") % 20 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0, 2.0], 0)], SCHEMA)
    assert nearest(one, F.col("id") % 20 == 0).collect() == []


def test_few_candidates_are_all_found(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=64)], 0) for i in range(21)]
    got = nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") == 0).collect()
    assert sorted(r.vec_id for r in got) == list(range(1, 21))


def recall(spark, x, k=20):
    df = spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in enumerate(x)], SCHEMA).repartition(4)
    got = {}
    for r in nearest(df, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = [(i, row) for i, row in enumerate(np.float32(x).astype(float))]
    assert all(len(got[q]) == k for q in range(0, len(x), 20))
    return np.mean([len({i for i, _ in brute(rows, q)} & got[q]) / k for q in range(0, len(x), 20)])


@pytest.mark.parametrize("norms", ["uniform", "lognormal", "outlier", "both"])
def test_recall_where_norms_differ(spark, norms):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if norms == "uniform":
        x *= rng.uniform(0.5, 1.5, (len(x), 1))
    if norms in ("lognormal", "both"):
        x *= rng.lognormal(0, 0.5, (len(x), 1))
    if norms in ("outlier", "both"):
        x[301] *= 10 if norms == "outlier" else 1000
    assert recall(spark, x) >= 0.95


def test_small_tables_give_all_rows_asked_for(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=64)], 0) for i in range(24)]
    stored = [(i, np.float32(v).astype(float)) for i, v, _ in rows]
    got = {}
    for r in nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == {0, 20} and all(len(x) == 20 for x in got.values())
    assert all({i for i, _ in found} <= {i for i, _ in brute(stored, q, 23)} for q, found in got.items())


def test_each_length_is_searched(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.normal(size=6 if i % 3 else 4)], 0) for i in range(90)]
    got = {}
    for r in nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q in range(0, 90, 20):
        assert len(got[q]) == 20 and all((i % 3 == 0) == (q % 3 == 0) for i in got[q])


def test_rotations_keep_lengths():
    x = np.random.default_rng(1).normal(size=(10, 37))
    for turned in rotations(x, Index()):
        assert np.allclose((turned ** 2).sum(axis=1), (x ** 2).sum(axis=1))
