"""Profiling against pandas and numpy on hand-made frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablegauge.operators import profile as p, quantiles as q, views
from tablegauge.operators.columns import COLUMN_BLOCK
from tablegauge.plans.profile import run_full_profile
from tablegauge.sources.summary import dataset_fingerprint, dataset_summary

NAN = float("nan")


def frame(spark, partitions=2):
    rows = [
        (1, 1.0, "a@b.co", True, None), (2, NAN, "bad", None, None), (2, NAN, "bad", None, None),
        (3, None, None, False, None), (4, 100.0, "é@x.yz", True, None), (5, -0.0, "a@b.co", True, None),
        (6, 0.0, "c d@e.fg", True, None),
    ]
    schema = "id int, x double, user_email string, flag boolean, nothing double"
    return spark.createDataFrame(rows, schema).repartition(partitions)


def by_column(df):
    return {r["column"]: r.asDict() for r in df.collect()}


def test_null_analysis(spark):
    found = by_column(p.null_analysis(frame(spark)))
    assert [found[c]["null_count"] for c in ("id", "x", "user_email", "flag", "nothing")] == [0, 3, 1, 2, 7]
    assert found["x"]["null_pct"] == 42.86 and found["nothing"]["null_pct"] == 100.0
    empty = by_column(p.null_analysis(frame(spark).where("false")))
    assert empty["id"]["null_count"] == 0 and empty["id"]["null_pct"] is None


def test_duplicates_treat_missing_values_as_equal(spark):
    assert tuple(p.duplicate_detection(frame(spark)).first()) == (1, 14.29)
    same = spark.createDataFrame([(NAN, 1), (None, 1), (0.0, 2), (-0.0, 2)], "a double, b int")
    assert tuple(p.duplicate_detection(same).first()) == (2, 50.0)
    assert tuple(p.duplicate_detection(same.where("false")).first()) == (0, 0.0)


def test_duplicates_of_long_and_nested_values(spark):
    long = "y" * 1000
    df = spark.createDataFrame([(long + "1", [1, 2], {"a": 1}), (long + "2", [1, 2], {"a": 1}),
                                (long + "1", [1, 2], {"a": 1}), (long + "1", [1, None], {"a": 1})],
                               "t string, l array<int>, m map<string,int>")
    assert p.duplicate_detection(df).first()["duplicate_rows"] == 1
    assert {k: v["unique_count"] for k, v in by_column(p.cardinality_analysis(df)).items()} == {
        "t": 2, "l": 2, "m": 1}


def test_cardinality(spark):
    found = by_column(p.cardinality_analysis(frame(spark)))
    assert {c: found[c]["unique_count"] for c in found} == {
        "id": 6, "x": 3, "user_email": 4, "flag": 2, "nothing": 0}
    assert found["id"]["unique_ratio"] == 0.8571
    empty = by_column(p.cardinality_analysis(frame(spark).where("false")))
    assert empty["id"]["unique_count"] == 0 and empty["id"]["unique_ratio"] == 0.0
    close = by_column(p.cardinality_analysis(frame(spark), approximate=True))
    assert {c: close[c]["unique_count"] for c in close} == {c: found[c]["unique_count"] for c in found}


def test_patterns(spark):
    found = by_column(p.pattern_validation(frame(spark)))
    assert set(found) == {"user_email"}
    assert found["user_email"]["pattern"] == "email" and found["user_email"]["match_pct"] == 50.0
    df = spark.createDataFrame([(None, "+15551234", 5551234)], "email_a string, emailPhone string, PHONE int")
    found = by_column(p.pattern_validation(df))
    assert found["emailPhone"]["pattern"] == "email" and found["emailPhone"]["match_pct"] == 0.0
    assert found["PHONE"]["match_pct"] == 100.0 and "email_a" not in found
    assert p.pattern_validation(df.select(F.lit(1).alias("n"))).count() == 0


def test_statistics_match_pandas(spark):
    df = frame(spark)
    pdf = df.select("id", "x", "nothing").toPandas()
    want = pdf.describe().T
    found = by_column(p.statistical_profile(df))
    assert set(found) == {"id", "x", "nothing"}                       # booleans are not numbers
    for c in ("id", "x"):
        assert found[c]["mean"] == pytest.approx(want.loc[c, "mean"])
        assert found[c]["std"] == pytest.approx(want.loc[c, "std"])
        assert (found[c]["min"], found[c]["max"]) == (want.loc[c, "min"], want.loc[c, "max"])
        assert found[c]["median"] == want.loc[c, "50%"]
    assert all(v is None for k, v in found["nothing"].items() if k != "column")
    assert p.statistical_profile(df.where("false")).count() == 0
    assert p.statistical_profile(df.select("flag")).count() == 0


def test_outliers(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=500), [50.0, -50.0, 8.0]])
    pdf = pd.DataFrame({"x": values, "constant": 7.0, "none": np.nan})
    df = spark.createDataFrame(pdf)
    q1, q3 = pdf["x"].quantile(0.25), pdf["x"].quantile(0.75)
    want = int(((pdf["x"] < q1 - 1.5 * (q3 - q1)) | (pdf["x"] > q3 + 1.5 * (q3 - q1))).sum())
    found = by_column(p.outlier_detection(df))
    assert set(found) == {"x", "constant"}
    assert found["x"]["outlier_count"] == want and found["constant"]["outlier_count"] == 0
    z = (pdf["x"] - pdf["x"].mean()) / pdf["x"].std(ddof=0)
    found = by_column(p.outlier_detection(df, "anything"))
    assert found["x"]["outlier_count"] == int((z.abs() > 3).sum()) and found["constant"]["outlier_count"] == 0


def test_scores(spark):
    df = frame(spark)
    assert p.completeness_score(df).first()[0] == 62.86
    health = {k: v["health_score"] for k, v in by_column(p.column_health_score(df)).items()}
    assert health["id"] == 100.0 and health["nothing"] == 30.0
    assert health["x"] == round(100 - (42.86 * 0.7 + 25.0 * 0.3), 2)
    mean = np.mean(list(health.values()))
    assert p.overall_quality_score(df).first()[0] == pytest.approx(
        round(62.86 * 0.4 + (100 - 14.29) * 0.2 + mean * 0.4, 2))
    assert p.completeness_score(df.where("false")).first()[0] == 0.0


@pytest.fixture
def small_brackets(monkeypatch):
    for name, value in (("SORTED_LEAST", 5), ("SORTED_MOST", 5), ("SKETCHED_LEAST", 60), ("SKETCHED_MOST", 60)):
        monkeypatch.setattr(q, name, value)


def quantile_frame():
    rng = np.random.default_rng(5)
    n = 3000
    third = np.where(rng.random(n) < 0.34, 42.0, rng.normal(50, 30, n))
    return pd.DataFrame({
        "smooth": rng.normal(size=n), "ties": rng.integers(0, 4, n).astype(float), "hot": third,
        "wide": np.exp(rng.normal(0, 40, n)), "constant": 1.5,
        "infinite": np.where(rng.random(n) < 0.4, np.inf, np.where(rng.random(n) < 0.3, -np.inf, rng.random(n))),
    })


@pytest.mark.parametrize("partitions", [1, 7])
def test_bracketed_quantiles_are_exact(spark, small_brackets, partitions):
    pdf = quantile_frame()
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = q.column_quantiles(spark.createDataFrame(pdf).repartition(partitions), probs)
    for c in pdf:
        with np.errstate(invalid="ignore"):
            want = np.quantile(pdf[c], probs)
        if c != "infinite":
            assert found[c] == pytest.approx(list(want), rel=1e-15), c
        else:
            ordered = np.sort(pdf[c])
            assert all(found[c][i] in (-np.inf, np.inf) or found[c][i] in ordered or 0 <= found[c][i] <= 1
                       for i in range(len(probs)))


@pytest.mark.parametrize("partitions", [1, 7])
def test_quantiles_from_a_sketch_of_the_facts_pass_stay_exact(spark, small_brackets, partitions):
    pdf = quantile_frame().drop(columns=["infinite"])
    df = spark.createDataFrame(pdf).repartition(partitions)
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]
    sketches = dict(zip(pdf.columns, df.selectExpr(*[q.sketch_expression(c) for c in pdf.columns]).first()))
    # A sketch that proposes nonsense costs a round more, never the exactness.
    sketches["ties"] = [0.5] * (q.GRID + 1)
    found = q.column_quantiles(df, probs, sketches=sketches)
    for c in pdf:
        assert found[c] == pytest.approx(list(np.quantile(pdf[c], probs)), rel=1e-15), c


def test_approximate_quantiles_keep_their_bound(spark):
    pdf = quantile_frame().drop(columns=["infinite"])
    df = spark.createDataFrame(pdf).repartition(5)
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    found = q.column_quantiles(df, probs, approximate=True)
    assert sorted(found) == sorted(pdf.columns)
    checked = q.approximation_errors(df, probs, found).collect()
    assert len(checked) == len(probs) * len(pdf.columns) and all(r.within_bound for r in checked)
    assert q.approximation_errors(df, probs, {"smooth": [100.0] * 5}).first().within_bound is False
    assert q.column_quantiles(df.where("false"), probs, approximate=True) == {}


def test_quantiles_of_one_two_and_no_values(spark):
    df = spark.createDataFrame([(1.0, 3.0, None), (2.0, None, None)], "a double, b double, c double")
    assert q.column_quantiles(df, [0.25, 0.5]) == {"a": [1.25, 1.5], "b": [3.0, 3.0]}


def test_tables_wider_than_a_block(spark):
    width = COLUMN_BLOCK * 2 + 3
    df = spark.range(4).select(*[(F.col("id") + i).cast("double").alias(f"c{i}") for i in range(width)])
    assert p.null_analysis(df).count() == width
    found = by_column(p.statistical_profile(df))
    assert all(found[f"c{i}"]["median"] == 1.5 + i for i in range(width))
    assert p.outlier_detection(df).count() == width


def test_full_profile_equals_the_single_operators(spark):
    df = frame(spark)
    profile = run_full_profile(df)

    def rows(x):
        return sorted(map(str, x.select(*sorted(x.columns)).collect()))
    for got, want in ((profile.summary, dataset_summary(df)), (profile.fingerprint, dataset_fingerprint(df)),
                      (profile.nulls, p.null_analysis(df)), (profile.duplicates, p.duplicate_detection(df)),
                      (profile.cardinality, p.cardinality_analysis(df)), (profile.patterns, p.pattern_validation(df)),
                      (profile.statistics, p.statistical_profile(df)), (profile.outliers, p.outlier_detection(df)),
                      (profile.completeness, p.completeness_score(df)),
                      (profile.column_health, p.column_health_score(df)),
                      (profile.quality, p.overall_quality_score(df))):
        assert rows(got) == rows(want)
    assert set(profile.as_dict()) >= {"summary", "fingerprint", "nulls", "quality"}
    empty = run_full_profile(df.where("false"))
    assert empty.statistics.count() == 0 and empty.summary.first()["row_count"] == 0
    assert rows(empty.quality) == rows(p.overall_quality_score(df.where("false")))


def test_views(spark):
    measures = spark.createDataFrame([(f"c{i:02}", float(i % 7)) for i in range(18)], "column string, null_pct double")
    worst = views.worst_nulls(measures, 4).collect()
    assert [(x["column"], x["null_pct"]) for x in worst] == [("c06", 6.0), ("c13", 6.0), ("c05", 5.0), ("c12", 5.0)]
    assert views.worst_nulls(measures).count() == 18
    assert views.worst_nulls(measures.limit(15), 4).count() == 4
