import random

import numpy as np
import pyarrow as pa
import pytest

import edge
from tablegauge.llm import toxicity
from tablegauge.llm.toxicity import Training, _marginals, fit, reject_toxic, tag_toxicity


def labelled(n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = edge.words(rng, rng.choice([5, 40, 150])).split()
        bad = i % 6 == 0
        for _ in range(rng.randrange(1, 4) if bad else 0):
            text.insert(rng.randrange(len(text) + 1), rng.choice(["Vile", "nasty!", "vilest", "nastier"]))
        rows.append((" ".join(text), bad))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = labelled()
    return fit([t for t, _ in rows], [b for _, b in rows])


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    emission, trans, start = rng.normal(size=(1, 5)), rng.normal(size=(2, 2)), rng.normal(size=2)
    real = np.array([[True, True, True, True, False]])
    total, one, pairs = 0.0, np.zeros(5), np.zeros((2, 2))
    for k in range(16):
        y = [(k >> i) & 1 for i in range(4)]
        p = np.exp(start[y[0]] + sum(emission[0, i] * y[i] for i in range(4)) + sum(trans[y[i], y[i + 1]] for i in range(3)))
        total += p
        for i in range(4):
            one[i] += p * y[i]
        for i in range(3):
            pairs[y[i], y[i + 1]] += p
    got, got_pairs = _marginals(emission, real, trans, start)
    assert np.allclose(got[0, :4], one[:4] / total) and np.allclose(got_pairs, pairs / total)


def test_held_out_accuracy_and_spans(spark, model):
    rows = [(i, t, b) for i, (t, b) in enumerate(labelled(200, 9))]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in tag_toxicity(df, model).collect()}
    assert sum(got[i].predicted == int(b) for i, _, b in rows) >= 196
    text = "fine é😀 words, then NASTY ones and more"
    row = tag_toxicity(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [text[s["start"]:s["end"]] for s in row.spans] == ["NASTY"]


def test_edge_rows(docs, model):
    rows = tag_toxicity(edge.with_clashing(docs), model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (70, 71, 72)}) == 1


def test_one_class_or_none(spark, docs):
    assert tag_toxicity(docs, fit([], [])).agg({"score": "max"}).first()[0] == 0.0
    assert tag_toxicity(docs, fit(["a"], [True])).agg({"score": "min"}).first()[0] == 1.0


def test_stage(spark, no_docs):
    rows = labelled(300)
    docs = edge.with_clashing(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(None, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, int(b)) for i, (_, b) in enumerate(rows)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    kept = reject_toxic(docs, labels)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and None in ids
    wrong = [i for i, (_, b) in enumerate(rows) if (i in ids) == b]
    assert len(wrong) <= 5
    assert reject_toxic(no_docs, labels).count() == 0


def test_stage_judges_a_stretch_of_text_at_a_time(spark, monkeypatch):
    """Each text goes to the workers once and comes back with the megabyte it was judged in."""
    rows = labelled(300)
    docs = spark.createDataFrame([(i, t, "own") for i, (t, _) in enumerate(rows)], "doc_id long, text string, __text string")
    labels = spark.createDataFrame([(i, int(b)) for i, (_, b) in enumerate(rows)], "doc_id long, toxic int")
    sent, send = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **k: sent.append((self.columns, f)) or send(self, f, *a, **k))
    kept = reject_toxic(docs, labels).collect()
    assert {r["__text"] for r in kept} == {"own"} and 200 < len(kept) < 300
    (columns, judge), = sent
    assert columns == docs.columns
    long = " ".join(t for t, _ in rows if "nast" not in t.lower() and "vile" not in t.lower())
    long *= 400_000 // len(long) + 1
    batch = pa.record_batch({"doc_id": range(10), "text": [long] * 10, "__text": ["own"] * 10})
    parts = list(judge(iter([batch])))
    assert len(parts) >= 4 and sum(p.num_rows for p in parts) == len({p for x in parts for p in x.column("doc_id").to_pylist()})
    assert all(x.schema == batch.schema and x.column("text").nbytes < 1_200_000 for x in parts)


@pytest.mark.parametrize("kind", ["string", "binary"])
def test_stage_reads_the_named_column(spark, kind):
    rows = labelled(300)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, Body string")
    labels = spark.createDataFrame([(i, int(b)) for i, (_, b) in enumerate(rows)], "doc_id long, toxic int")
    same = docs.withColumnRenamed("Body", "text")
    want = {r.doc_id for r in reject_toxic(same, labels).collect()}
    model = toxicity.train(same, labels)
    typed = docs.selectExpr("doc_id", f"cast(Body as {kind}) Body")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(toxicity, "train", lambda *a, **k: model)
        kept = reject_toxic(typed, labels, text_col="body")
        assert kept.schema == typed.schema and {r.doc_id for r in kept.collect()} == want


def test_training_rows(spark):
    rows = labelled(100)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(b)) for i, (_, b) in enumerate(rows)], "doc_id long, toxic int")
    texts, toxic = toxicity.training_sample(docs, labels, Training(toxic_rows=5, clean_rows=20))
    assert len(texts) == 25 and toxic.sum() == 5
    again, _ = toxicity.training_sample(docs.repartition(9), labels, Training(toxic_rows=5, clean_rows=20))
    assert again == texts
