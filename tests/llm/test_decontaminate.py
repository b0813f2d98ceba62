import corpus_pipeline
import edge
from tablegauge.llm import queries
from tablegauge.llm.decontaminate import Templates, contaminated, decontaminate, leaks

ITEMS = [
    (1, "A train leaves Boston at 60 km per hour and Alice waits for 3 hours at the old station near the river."),
    (2, "words that nobody else would put in this particular order for any reason at all"),
    (3, None), (4, ""), (5, "short item here"), (6, "12 13 14 15 16 17 18 19 20"), (2, "words that nobody else would put in this"),
]
PLAIN = "nothing of this is in any question that was ever asked by anyone in this test of ours"
DOCS = [
    (10, "Some text, then in A train leaves Boston at 60 km per hour and Alice waits for 3 hours at the old station."),
    (11, "A train leaves Denver at 75 miles per hour and Carol waits for 9 hours at the old station near the river."),
    # Two names where the question has one twice would be consistent; one name for two different ones is not.
    (12, PLAIN), (13, None), (14, ""), (15, "x " * 30 + "words THAT nobody, else would put in THIS particular order " + "y " * 30),
    (16, "short item here"), (17, "a short item here too"), (18, "12 13 14 15 16 17 18 19 20"), (10, PLAIN), (None, "so: words that nobody else would put in this particular order"),
]


def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def found(spark, docs, **kwargs):
    return {(r.doc_id, r.item) for r in contaminated(docs, items(spark), **kwargs).collect()}


def test_verbatim_and_changed_questions(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    want = {(10, 1), (11, 1), (16, 5), (None, 2)}
    assert found(spark, docs) == want
    assert found(spark, docs, options=Templates(broadcast_rows=0)) == want
    changed = {r.doc_id: r.n_changed for r in contaminated(docs, items(spark)).collect()}
    assert changed[11] > 0 and changed[10] == 0


def test_slots_must_correspond(spark):
    item = [(1, "first we give Anna five red apples and then Anna and Berta count them once more again")]
    docs = [(1, "first we give Clara five red apples and then Clara and Dora count them once more again"),
            (2, "first we give Clara five red apples and then Dora and Emil count them once more again"),
            (3, "first we give Clara five red apples and then Clara and Clara count them once more again")]
    benchmark = spark.createDataFrame(item, "item_id long, text string")
    rows = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), benchmark, options=Templates(words=17)).collect()
    assert [(r.doc_id, r.n_changed) for r in rows] == [(1, 1)]


def test_stage_keeps_rows_and_columns(spark):
    docs = edge.with_clashing(spark.createDataFrame(DOCS + [DOCS[2]], "doc_id long, text string"))
    out = decontaminate(docs, items(spark))
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [10, 12, 12, 13, 14, 15, 17, 18]


def test_names_units_and_capitals(spark):
    docs = spark.createDataFrame([(1, "Words that nobody else would put in this particular order")], "doc_id long, text string")
    assert found(spark, docs) == {(1, 2)}


VERBATIM = [
    (1, "12 13 14 15 16 17 18 19 20"), (2, "short item here"), (3, "Anna Berta Clara Dora Emil Frida Georg Hans Ida"),
    (4, "The Quick Brown Fox Jumps Over The Lazy Dog"), (5, "水的沸点是多少"), (6, "What is 3 + 4 * 5 - 6 / 7 + 8 * 9 ?"),
    (7, "日本の 首都"), (8, "7 x 8"),
]
COPIES = [
    (1, "so 11 12 13 14 15 16 17 18 19 20 21", {1}), (2, "a short item here too", {2}), (3, "a short item there", set()),
    (4, "hello Anna Berta Clara Dora Emil Frida Georg Hans Ida and others", {3}),
    (5, "he wrote: The Quick Brown Fox Jumps Over The Lazy Dog, twice", {4}), (6, "请问水的沸点是多少呢", {5}),
    (7, "please: what is 3 + 4 * 5 - 6 / 7 + 8 * 9 ? none", {6}), (8, "12 13 14 15 16 17 18 19 20", {1}),
    (9, "22 23 24 25 26 27 28 29 30", set()), (10, "Karl Berta Clara Dora Otto Frida Georg Hans Ida and others", set()),
    (11, "it is 7 x 8, is it", {8}), (12, "it is 7 x 9, is it", set()), (13, "今日の日本の 首都は", {7}), (14, "", set()), (15, None, set()),
    (16, "水的沸点", set()),
]


def test_verbatim_copies_are_always_found(spark):
    benchmark = spark.createDataFrame(VERBATIM, "item_id long, text string")
    docs = spark.createDataFrame([c[:2] for c in COPIES], "doc_id long, text string")
    for rows in (500_000, 0):
        out = contaminated(docs, benchmark, options=Templates(verbatim=True, broadcast_rows=rows)).collect()
        assert {(r.doc_id, r.item) for r in out} == {(i, item) for i, _, items in COPIES for item in items}
        assert all(r.n_windows > 0 and r.n_changed == 0 for r in out)
    left = decontaminate(docs, benchmark, options=Templates(verbatim=True))
    assert sorted(r.doc_id for r in left.collect()) == [i for i, _, items in COPIES if not items]


def test_verbatim_keeps_the_template_rule(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert found(spark, docs, options=Templates(verbatim=True)) == {(10, 1), (11, 1), (16, 5), (17, 5), (18, 6), (None, 2)}


def test_registered_query_finds_verbatim_copies(spark, tmp_path):
    spark.createDataFrame([c[:2] for c in COPIES], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(VERBATIM, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    out = queries.op3_benchmark_decontamination(spark, f"file://{tmp_path}").collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(i, item) for i, _, items in COPIES for item in items}
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)["benchmark decontamination"](spark, docs, f"file://{tmp_path}")
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, items in COPIES if not items]


def test_empty(spark, no_docs):
    assert leaks(no_docs, items(spark)).collect() == []
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert leaks(docs, items(spark).limit(0)).collect() == []
    assert decontaminate(docs, items(spark).limit(0)).count() == len(DOCS)


def test_long_number_series_do_not_stop_the_job(spark):
    """A CSV-like page of 200,000 numbers is one long value, found like any other text."""
    series = ",".join(map(str, range(200_000)))
    docs = spark.createDataFrame([(1, series), (2, series + " " + ITEMS[0][1]), (3, "1.2.3 " * 50_000)],
                                 "doc_id long, text string")
    assert found(spark, docs) == {(2, 1)}
    assert found(spark, docs, options=Templates(verbatim=True)) == {(2, 1)}
