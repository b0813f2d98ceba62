import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tablegauge.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, heads=9, group=5):
    """Every prefix of every rebuilt conversation, counted directly."""
    seen = {(c, t, r or "", x or "") for c, t, r, x in rows if c is not None}
    convs = {}
    for c, t, r, x in sorted(seen, key=lambda v: (v[0], v[1] is not None, v[1] or 0, v[2], v[3])):
        convs.setdefault(c, []).append((r, x))
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        head = c - (abs(c) % group) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(convs.get(head, [])[:h] + own[h:])
    nodes = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    out = []
    for p, members in nodes.items():
        kids = [q for q in nodes if len(q) == len(p) + 1 and q[:len(p)] == p]
        sub = [q for q in nodes if q[:len(p)] == p]
        leaves = sum(1 for q in sub if not any(len(z) == len(q) + 1 and z[:len(q)] == q for z in nodes))
        saved = sum((len(nodes[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in sub)
        ends = sorted(c for c in members if len(rebuilt[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), leaves, saved,
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def fixture(seed, n=80):
    rng = random.Random(seed)
    texts = ["hello", "", "é 漢字 😀", "how are you", "fine", "x" * 300, None]
    rows = []
    for c in range(n):
        for t in range(rng.choice([0, 1, 2, 3, 5, 12])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)))
    rows += [(3, None, "user", "first"), (4, 1, "user", "tie a"), (4, 1, "user", "tie b"), rows[0], rows[0],
             (None, 0, "user", "orphan"), (200, 0, "user", "alone"), (-7, 0, "user", "negative")]
    rows += [(300 + i, t, "user", f"same {t}") for i in range(40) for t in range(4)]
    return rows


def collected(df):
    return sorted((tuple(r) for r in df.select(*[c.split()[0] for c in prefixtrie.NODES.split(", ")]).collect()), key=str)


@pytest.mark.parametrize("seed,parts", [(1, 4), (2, 7)])
def test_against_brute_force(spark, seed, parts):
    rows = fixture(seed)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = collected(prefixtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute(rows)


def test_one_shard_per_list_and_clashing_columns(spark):
    rows = fixture(3, 30)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        df = df.select("*", *[F.lit(1).alias(c) for c in ("ids", "key", "nbytes", "tid", "head", "h", "n", "first")])
        assert collected(prefixtrie.prefix_trie(df)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_and_turnless(spark):
    assert prefixtrie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(11, 0, "user", "a")]  # crc32("11") % 9 takes its turn away: the head 10 is absent
    assert collected(prefixtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
