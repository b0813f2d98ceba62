import itertools

import numpy as np
from pyspark.sql import functions as F

import edge
from compare import SF_DIR
from tablegauge.llm import language
from tablegauge.llm.language import identify, train, viterbi

EN = "the quick brown fox and the other thing that was there with them when this happened again "
DE = "der schnelle braune Fuchs und das andere Ding das dort war als dies wieder geschah "
RU = "быстрая коричневая лиса и другая вещь которая была там когда это случилось снова "


def fixture(spark):
    rows = [(i, t * 3, lang) for i, (t, lang) in enumerate([(EN, "en"), (DE, "de"), (RU, "ru")] * 5)]
    return spark.createDataFrame(rows + [(90, None, "en"), (91, EN, None)], "doc_id long, text string, lang string")


def test_viterbi_against_enumeration():
    rng = np.random.default_rng(5)
    lengths = [0, 6, 1, 4, 0]
    owner = np.repeat(np.arange(5), lengths)
    e = rng.normal(size=(len(owner), 3)) * 2
    got = viterbi(e, owner, 5, 1.5)
    for text in range(5):
        part = e[owner == text]
        best = max(itertools.product(range(3), repeat=len(part)), default=(), key=lambda y: sum(
            part[i, s] for i, s in enumerate(y)) - 1.5 * sum(a != b for a, b in zip(y, y[1:])))
        assert tuple(got[owner == text]) == best


def test_spans_of_mixed_text(spark):
    model = train(fixture(spark))
    assert model.languages == ["de", "en", "ru"]
    text = "😀 " + EN * 3 + DE * 2 + RU
    row = identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [s["lang"] for s in row.spans] == ["en", "de", "ru"] and row.lang_pred == "en" and 0 < row.score < 1
    assert text[row.spans[2]["start"]:row.spans[2]["end"]] == RU.strip()


def test_nothing_to_tell(spark):
    model = train(fixture(spark))
    rows = [(1, None), (2, ""), (3, "123 !? 😀"), (4, "漢字"), (None, EN), (5, "Ω")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(edge.with_clashing(
        spark.createDataFrame(rows, "doc_id long, text string")), model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[None][0] == "en" and got[4][0] in model.languages and got[5][0] in model.languages


def test_no_training_rows(spark, docs, no_docs):
    model = train(no_docs)
    rows = identify(docs, model).collect()
    assert len(rows) == docs.count() and {r.lang_pred for r in rows} == {"und"}
    assert identify(no_docs, model).collect() == []


def test_edge_rows(spark, docs):
    rows = identify(edge.with_clashing(docs), train(fixture(spark))).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = train(docs.filter(~language.held_out()))
    test = docs.filter(language.held_out())
    found = identify(test, model).join(test.select("doc_id", "lang"), "doc_id")
    right, n = found.agg(F.sum(F.expr("int(lang = lang_pred)")), F.count("*")).first()
    assert right >= 0.95 * n
