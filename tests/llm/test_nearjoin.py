import random
from collections import Counter

import pytest

import edge
from tablegauge.llm.components import components
from tablegauge.llm.nearjoin import Forest, keep_one, near_duplicates


def grams(text):
    w = (text or "").split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def expected(rows):
    sets = [grams(r[1]) for r in rows]
    parent, links = list(range(len(rows))), Counter()

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-12:
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return Counter((r[0], least.get(top(i)) if links[i] else r[0], links[i]) for i, r in enumerate(rows))


def result(df, **kwargs):
    return Counter((r.doc_id, r.class_id, r.n_links) for r in near_duplicates(df, **kwargs).collect())


@pytest.fixture(scope="module")
def crowd(spark):
    """One large group of near copies, some far from others, with copies among them."""
    rng = random.Random(4)
    base = edge.words(rng, 110).split()
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randrange(5)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(text)))
    rows += [(200 + i, rows[0][1]) for i in range(40)] + [(300 + i, edge.words(rng, 80)) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()


def test_against_brute_force(docs):
    assert result(edge.with_clashing(docs)) == expected(docs.collect())


@pytest.mark.parametrize("options", [Forest(), Forest(node=8, block_rows=8), Forest(node=4, depth=4, block_rows=16)])
def test_crowd(crowd, options):
    assert result(crowd, options=options) == expected(crowd.collect())


@pytest.fixture(scope="module")
def forms(spark):
    """Filled-in forms: all share more than half of their words, and 150 pairs differ in two of them."""
    rng = random.Random(8)
    form, rows = [f"b{i}" for i in range(65)], []
    for i in range(200):
        text = form + [f"u{i}.{j}" for j in range(35)]
        rows.append((2 * i, " ".join(text)))
        if i < 150:
            text[rng.randrange(4, 40)], text[rng.randrange(50, 95)] = f"x{i}", f"y{i}"
            rows.append((2 * i + 1, " ".join(text)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()


@pytest.mark.parametrize("options", [Forest(trees=10, depth=12, node=2),
                                     Forest(trees=10, depth=12, node=2, block_sigs=16)])
def test_large_nodes_are_compared_whole(forms, options):
    assert result(forms, options=options) == expected(forms.collect())


def test_one_of_each_group_stays(docs):
    kept = keep_one(edge.with_clashing(docs))
    want = {i for i, c, _ in expected(docs.collect()) if i is None or i == c}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i in want if i is not None)
    assert kept.columns == edge.with_clashing(docs).columns


def test_one_of_each_pair_in_large_nodes_stays(forms):
    kept = keep_one(forms, options=Forest(trees=10, depth=12, node=2))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 400, 2))


def test_recall_of_the_start():
    f = Forest()
    assert 1 - (1 - 0.8 ** f.shortest) ** f.trees >= f.recall


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 105), (105, 103), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 103: 100, 105: 100}


def test_empty(no_docs):
    assert near_duplicates(no_docs).collect() == [] and keep_one(no_docs).collect() == []
