import re

import edge
from tablegauge.llm import substrings
from tablegauge.llm.substrings import Sketch, remove_repeated_windows


def expected(rows, window=20):
    first, out = {}, {}
    order = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    for none, i, text in order:
        w = re.findall(r"[^\x20\x09-\x0d]+", text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first.setdefault(tuple(w[k:k + window]), (none, i, text, k)) != (none, i, text, k):
                gone[k:k + window] = [True] * window
        out[none, i, text] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return sorted((r[0] is None, r[0] or 0, *out[r[0] is None, r[0] or 0, r[1] or ""]) for r in rows)


def result(df, **kwargs):
    rows = remove_repeated_windows(df, **kwargs).collect()
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in rows)


def test_against_brute_force(docs):
    assert result(edge.with_clashing(docs)) == expected(docs.collect())


def test_a_sketch_that_is_full_loses_nothing(docs):
    assert result(docs, sketch=Sketch(rows=1, min_bits=20, max_bits=20)) == expected(docs.collect())


def test_small_windows_and_partitions(docs, monkeypatch):
    monkeypatch.setattr(substrings, "_FLUSH", 200)
    assert result(docs.repartition(7), window=5) == expected(docs.collect(), 5)


def test_periodic_text(spark):
    rows = [(1, "a " * 21), (2, "a b " * 30), (3, "a " * 20)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


def test_empty(no_docs):
    assert remove_repeated_windows(no_docs).collect() == []
