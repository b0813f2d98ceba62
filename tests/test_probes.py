"""Inputs that are far from tidy: nested keys, infinities, variables in text, malformed files."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tablegauge import exact_sample, load_dataset
from tablegauge.operators import profile as p
from tablegauge.operators.catalog import Rule
from tablegauge.operators.checks import CHECKS
from tablegauge.operators.drift import detect_data_drift
from tablegauge.operators.rules import apply_rules, rule_rollup
from tablegauge.sources.inference import infer_and_cast
from tablegauge.sources.readers import read_csv, read_json

UNIQUE = Rule("N-1", "Uniqueness", "Unique", "v", "UNIQUE", None, "ERROR")


def counts(df):
    """Distinct values, duplicate rows and statuses of UNIQUE for a table of one column."""
    return (p.cardinality_analysis(df).first()["unique_count"], p.duplicate_detection(df).first()["duplicate_rows"],
            sorted(r["status"] for r in apply_rules(df, [UNIQUE]).collect()))


@pytest.mark.parametrize("kind, values, distinct", [
    ("array<timestamp>", [[dt.datetime(2020, 1, 1, 0, 0, 0, 1)], [dt.datetime(2020, 1, 1, 0, 0, 0, 2)]], 2),
    ("array<double>", [[0.0], [-0.0]], 1),
    ("array<double>", [[float("nan"), 1.0], [float("nan"), 1.0]], 1),
    ("struct<m:map<string,int>>", [({"a": 1, "b": 2},), ({"b": 2, "a": 1},)], 1),
    ("map<string,array<int>>", [{"a": [1], "b": []}, {"b": [], "a": [1]}], 1),
    ("array<string>", [["a", "b"], ["ab", ""]], 2),
    ("array<string>", [["a,b"], ["a", "b"]], 2),
    ("array<string>", [[None], ["-"]], 2),
    ("array<string>", [[], [None]], 2),
    ("array<array<string>>", [[["a"], ["b"]], [["a", "b"]]], 2),
    ("struct<a:string,b:string>", [("x", None), (None, "x")], 2),
    ("array<binary>", [[b"\x00"], [b"\x01"]], 2),
])
def test_nested_values_are_equal_exactly_when_they_are(spark, kind, values, distinct):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    want = (distinct, 2 - distinct, ["PASS", "PASS"] if distinct == 2 else ["FAIL", "FAIL"])
    assert counts(df) == want


def test_a_row_is_one_digest_in_the_shuffle(spark):
    df = spark.createDataFrame([(1, "a" * 500, [1.5]), (1, "a" * 500, [1.5]), (2, None, None)], "a int, b string, c array<double>")
    found = p.duplicate_detection(df)
    assert found.first()["duplicate_rows"] == 1
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [row_key" in plan


def test_missing_values_are_one_in_duplicates(spark):
    df = spark.createDataFrame([(float("nan"), "x"), (None, "x"), (0.0, "y"), (-0.0, "y")], "a double, b string")
    assert p.duplicate_detection(df).first()["duplicate_rows"] == 2


def test_infinities_are_no_outliers_by_deviation(spark):
    values = [float(i) for i in range(20)] + [math.inf]
    df = spark.createDataFrame([(v, math.inf if i % 3 else v) for i, v in enumerate(values)], "a double, b double")
    assert [tuple(r) for r in p.outlier_detection(df, "zscore").orderBy("column").collect()] == [("a", 0, 0.0), ("b", 0, 0.0)]
    assert {r["column"]: r["outlier_count"] for r in p.outlier_detection(df).collect()} == {"a": 1, "b": 0}


def test_nothing_is_claimed_for_a_table_without_rows(spark):
    df = spark.createDataFrame([], "a double, b string")
    assert [r["health_score"] for r in p.column_health_score(df).collect()] == [None, None]
    assert p.overall_quality_score(df).first()["quality_score"] is None


def test_signed_nan_text(spark):
    df = infer_and_cast(spark.createDataFrame([("1.5",), ("+nan",), ("-NAN",), (" nan ",)], "a string"))
    assert df.dtypes == [("a", "double")]
    assert [math.isnan(r["a"]) for r in df.collect()] == [False, True, True, True]


def test_variables_in_text_and_names(spark):
    df = spark.createDataFrame([("${env:HOME}",), ("/root",), ("$",)], "a string")
    def statuses(kind, parameter):
        rule = Rule("V-1", "Validity", "${env:HOME}", "a", kind, parameter, "ERROR")
        lines = apply_rules(df, [rule], ["a"]).collect()
        assert {r["rule_name"] for r in lines} == {"${env:HOME}"}
        return {r["value"]: r["status"] for r in lines}
    assert statuses("ENUM", '["${env:HOME}"]') == {"${env:HOME}": "PASS", "/root": "FAIL", "$": "FAIL"}
    assert statuses("REGEX", r"^\\$\\{env:HOME\\}$".replace("\\\\", "\\"))["${env:HOME}"] == "PASS"
    assert statuses("REGEX", "^${env:HOME}$") == {None: "ERROR"}       # not a pattern Java knows
    try:
        odd = df.withColumnRenamed("a", "${env:HOME}")
        assert p.null_analysis(odd).first()["column"] == "${env:HOME}"
        assert p.cardinality_analysis(odd).first()["unique_count"] == 3
    finally:
        spark.conf.unset("spark.sql.variable.substitute")


def test_a_check_of_ones_own_may_report_an_error(spark):
    df = spark.createDataFrame([("1",), ("2",), ("x",), (None,)], "a string")
    rule = Rule("O-1", "Validity", "Odd", "a", "ODD", None, "WARNING")
    text = "case when {c} is null then null when try_cast({c} as int) is null then 'ERROR' else cast({c} % 2 = 1 as string) end"
    for check in (lambda cell, rule: text.format(c=cell.text), lambda cell, rule: F.expr(text.format(c=cell.text)),
                  lambda cell, rule: (F.col("a").try_cast("int") % 2 == 1)):
        checks = {**CHECKS, "ODD": check}
        got = {r["value"]: r["status"] for r in apply_rules(df, [rule], ["a"], checks).collect()}
        assert got["1"] == "PASS" and got["2"] == "WARNING" and got[None] == "NOT_APPLICABLE"
        assert rule_rollup(df, [rule], checks).first()["total"] == 4
    assert got["x"] == "NOT_APPLICABLE"                     # plain booleans know no error


def test_sizes_beside_the_p_value(spark):
    old = spark.createDataFrame([(float(i),) for i in range(3)], "a double")
    line = detect_data_drift(old, old.selectExpr("a + 100 as a")).first()
    assert (line["n_old"], line["n_new"], line["ks_statistic"]) == (3, 3, 1.0)


@pytest.mark.parametrize("n", [0, 1, 50, 550, 899, 900])
def test_any_share_can_be_sampled_without_a_sort(spark, n, monkeypatch):
    from tablegauge.sources import sampling

    monkeypatch.setattr(sampling, "_DIGITS", 1)
    monkeypatch.setattr(sampling, "_FEW", 3)
    df = spark.range(300).selectExpr("id", "id % 7 as v").unionAll(spark.range(600).selectExpr("id + 300", "id % 5"))
    sample = exact_sample(df, n, ["id"])
    order = df.orderBy(F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit("42"))), "id")
    assert sorted(r["id"] for r in sample.collect()) == sorted(r["id"] for r in order.limit(n).collect())
    assert "TakeOrdered" not in sample._jdf.queryExecution().executedPlan().toString()


def test_sample_of_repeated_ids(spark):
    df = spark.range(100).selectExpr("1 as id", "id as v")
    assert exact_sample(df, 60, ["id"]).count() == 60


# ---------------------------------------------------------------- malformed files

def written(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / name.replace("_", ".")).write_text(text, encoding="utf-8")
    return str(tmp_path)


@pytest.mark.parametrize("text", ["a,b\n1,2\n4,5,,x\n", "a,b\n1,2\n4,5,6\n", 'a,b\n"x\ny",2\n4,5,6\n'])
def test_surplus_fields_are_rejected(spark, tmp_path, text):
    folder = written(tmp_path, x_csv=text)
    for schema in (None, "a string, b string"):
        with pytest.raises(ValueError, match="does not fit"):
            read_csv(spark, f"{folder}/x.csv", schema=schema)
    assert read_csv(spark, f"{folder}/x.csv", strict=False).count() == 2


def test_cells_that_do_not_fit_a_schema_are_rejected(spark, tmp_path):
    folder = written(tmp_path, x_csv="a,b\n1,2\nx,3\n")
    with pytest.raises(ValueError, match="does not fit"):
        read_csv(spark, f"{folder}/x.csv", schema="a int, b int")
    assert [tuple(r) for r in read_csv(spark, f"{folder}/x.csv", schema="a string, b int").collect()] == [("1", 2), ("x", 3)]


def test_short_records_are_filled(spark, tmp_path):
    folder = written(tmp_path, x_csv="a,b,c\n1,2,3\n4\n")
    assert [tuple(r) for r in load_dataset(spark, f"{folder}/x.csv").collect()] == [(1, 2, 3), (4, None, None)]


def test_files_of_a_folder_need_one_header(spark, tmp_path):
    folder = written(tmp_path, x_csv="a,b\n1,x\n", y_csv="b,a\ny,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, folder).collect()


def test_only_files_with_open_quotes_are_read_whole(spark, tmp_path):
    folder = written(tmp_path, x_csv='a,b\n1,"two\nlines"\n', y_csv="a,b\n2,plain\n")
    rows = read_csv(spark, folder)
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "two\nlines"), (2, "plain")]
    pipe = written(tmp_path / "..", z_csv='a,b\n1,5" pipe\n')
    assert read_csv(spark, f"{pipe}/z.csv").first()["b"] == '5" pipe'


def test_malformed_json_is_an_error(spark, tmp_path):
    folder = written(tmp_path, x_json='{"a": 1}\n{"a": \n{"a": 3}\n')
    for schema in (None, "a int"):
        with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
            read_json(spark, f"{folder}/x.json", schema=schema).collect()
        rows = read_json(spark, f"{folder}/x.json", schema=schema, strict=False)
        assert rows.columns == ["a"] and sorted(r["a"] for r in rows.collect()) == [1, 3]


def test_rows_of_files_are_named_by_their_place(spark, tmp_path):
    path = f"file://{tmp_path}/rows"
    spark.range(10).selectExpr("id % 7 as v").repartition(2).write.parquet(path)
    stored = spark.read.parquet(path)
    lines = apply_rules(stored.where("v >= 0"), [UNIQUE], None).collect()
    assert len({r["row_index"] for r in lines}) == 10 and all("#" in r["row_index"] for r in lines)
    assert sorted(r["value"] for r in lines if r["status"] == "FAIL") == ["0", "0", "1", "1", "2", "2"]
    both = apply_rules(stored.unionAll(stored), [UNIQUE], None).collect()
    assert len({r["row_index"] for r in both}) == 20 and {r["status"] for r in both} == {"FAIL"}
