import math
import random

import pytest
from pyspark.sql import functions as F

from tablegauge.llm import negatives
from tablegauge.llm.negatives import Mining

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, m=Mining()):
    """The contract written out: every anchor against every row."""
    usable = {}
    for vec_id, vec, label in rows:
        if vec_id is None or label is None or not vec or any(
                x is None or not math.isfinite(x) or abs(math.floor(m.scale * x)) >= negatives.LIMIT for x in vec):
            continue
        label = (label + 1) % m.labels if vec_id % m.shift_every == 0 else label
        usable[(vec_id, label, tuple(vec))] = (vec_id, label, [math.floor(m.scale * float(x)) for x in vec])
    rows = list(usable.values())
    out = []
    for a_id, a_label, a_q in rows:
        if a_id % m.anchor_every:
            continue
        scored = sorted(((sum(x * y for x, y in zip(a_q, q)), i, lab) for i, lab, q in rows
                         if i != a_id and len(q) == len(a_q)), key=lambda t: (-t[0], t[1]))
        pos = [t for t in scored if t[2] == a_label][:m.positives]
        for ps, pid, _ in pos:
            neg = [t for t in scored if t[2] != a_label and m.low * ps <= 100 * t[0] <= m.high * ps][:m.negatives]
            out += [(a_id, pid, r + 1, nid, ps, ns) for r, (ns, nid, _) in enumerate(neg)]
    return sorted(out)


def rows_of(seed, n, dims=6, spread=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        vec = [rng.randint(-spread, spread) / 256 + rng.choice([0, 0.001]) for _ in range(dims)]
        rows.append((i, vec, rng.randrange(4)))
    rows += [rows[10], (None, [0.1] * dims, 1), (n, None, 1), (n + 1, [0.1, None] + [0.0] * (dims - 2), 1),
             (n + 2, [float("nan")] * dims, 1), (n + 3, [0.5] * dims, None), (n + 4, [], 2), (n + 5, [0.0] * dims, 2),
             (n + 6, [1e9] * dims, 1), (n + 7, [0.2] * 3, 1), (n + 8, [0.0] * dims, 3)]
    return rows


def result(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                                              "negative_score").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force_with_ties_nulls_and_repeats(spark, seed):
    m = Mining(anchor_every=9, rows_per_block=50, anchors_per_block=7)
    rows = rows_of(seed, 300)
    got = result(negatives.mine(spark.createDataFrame(rows, SCHEMA), m))
    assert got == brute(rows, m)
    assert got


def test_production_parameters_and_zero_windows(spark):
    rows = rows_of(3, 700, dims=4, spread=1)
    got = result(negatives.mine(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(empty).count() == 0
    rows = rows_of(4, 200)
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.select("*", *[F.lit(1).alias(c) for c in ("q", "anchor_id", "score", "ab", "rb", "windows", "v")])
    m = Mining(anchor_every=11)
    assert result(negatives.mine(clash, m)) == brute(rows, m)
