"""Rule types, execution and summaries on hand-made rows, against a per-value computation in plain Python."""

import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tablegauge.operators import results as r
from tablegauge.operators import uniqueness
from tablegauge.operators.catalog import Rule, customer_rules, load_rule_catalog, select_rules
from tablegauge.operators.checks import CHECKS
from tablegauge.operators.rules import RESULT_SCHEMA, apply_rules, rollup_results, rule_rollup

NAN = float("nan")


def rule(kind, parameter=None, severity="ERROR", attribute="v", **other):
    return Rule.of({"rule_id": "T", "dimension": "D", "rule_name": "n", "attribute": attribute, "rule_type": kind,
                    "parameter": parameter, "severity": severity, **other})


def statuses(spark, values, kind, parameter=None, dtype="string", severity="ERROR", checks=CHECKS):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"id int, v {dtype}")
    found = apply_rules(df, [rule(kind, parameter, severity)], ["id"], checks).collect()
    by_id = {int(x["row_index"]): x["status"] for x in found}
    return [by_id[i] for i in range(len(values))]


def test_not_null_rejects_every_kind_of_blank(spark):
    values = ["a", "", "  ", "\t\n", " ", " x ", None]
    assert statuses(spark, values, "NOT_NULL") == ["PASS", "FAIL", "FAIL", "FAIL", "FAIL", "PASS", "FAIL"]
    assert statuses(spark, [1.0, NAN, None], "NOT_NULL", dtype="double") == ["PASS", "FAIL", "FAIL"]
    assert statuses(spark, [None], "NOT_NULL", severity="WARNING") == ["WARNING"]


def test_unique_fails_every_member_and_ignores_severity(spark):
    assert statuses(spark, ["a", "b", "a", None], "UNIQUE", severity="WARNING") == ["FAIL", "PASS", "FAIL", "PASS"]
    assert statuses(spark, [None, None, "x"], "UNIQUE") == ["FAIL", "FAIL", "PASS"]
    # NaN and NULL are the same missing value, and so are the two zeros.
    assert statuses(spark, [NAN, None, 0.0, -0.0, 1.0], "UNIQUE", dtype="double") == ["FAIL"] * 4 + ["PASS"]


def test_unique_long_text_is_compared_in_full(spark):
    long = "x" * 500
    assert statuses(spark, [long + "a", long + "b", long + "a"], "UNIQUE") == ["FAIL", "PASS", "FAIL"]


@pytest.mark.parametrize("broadcast_keys", [0, 1_000_000])
def test_unique_with_hot_keys(spark, monkeypatch, broadcast_keys):
    monkeypatch.setattr(uniqueness, "BROADCAST_KEYS", broadcast_keys)
    monkeypatch.setattr(uniqueness, "HOT_KEYS", 5)
    monkeypatch.setattr(uniqueness, "HOT_COPIES", 3)
    values = ["h"] * 40 + [None] * 30 + ["a", "a", "b", "c", "c", "c"]
    expected = ["FAIL"] * 72 + ["PASS"] + ["FAIL"] * 3
    assert statuses(spark, values, "UNIQUE") == expected


@pytest.mark.parametrize("broadcast_keys", [0, 1_000_000])
def test_unique_rules_are_marked_together(spark, monkeypatch, broadcast_keys):
    """Several UNIQUE rules share one key count and one marking; the text stays out of every shuffle if the
    repeated keys are few enough to be broadcast."""
    monkeypatch.setattr(uniqueness, "BROADCAST_KEYS", broadcast_keys)
    rows = [(i, f"t{i % 7}" if i % 3 else f"u{i}", i % 5 if i % 4 else None, "long text " * 40 + str(i % 2))
            for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a string, b int, c string")
    rules = [rule("UNIQUE", attribute=name, rule_id=name) for name in ("a", "b", "c", "id")]
    found = apply_rules(df, rules, ["id"])
    got = {(int(x["row_index"]), x["attribute"]): x["status"] for x in found.collect()}
    for k, name in enumerate(("id", "a", "b", "c")):
        values = [r[k] for r in rows]
        for i, v in enumerate(values):
            assert got[(i, name)] == ("FAIL" if values.count(v) > 1 else "PASS")
    plan = found._jdf.queryExecution().executedPlan().toString()
    if broadcast_keys:
        assert "hashpartitioning" not in plan
    rolled = {x["rule_id"]: (x["total"], x["failed"]) for x in rule_rollup(df, rules).collect()}
    assert rolled == {name: (60, sum(1 for i in range(60) if [r[k] for r in rows].count(rows[i][k]) > 1))
                      for k, name in enumerate(("id", "a", "b", "c"))}


def test_regex_is_anchored_at_the_start_only(spark):
    assert statuses(spark, ["abc", "xab", None], "REGEX", "ab") == ["PASS", "FAIL", "NOT_APPLICABLE"]
    assert statuses(spark, ["xb", "ab", "cb"], "REGEX", "x|a") == ["PASS", "PASS", "FAIL"]
    # Unicode digits count as digits; a pattern may contain quotes.
    assert statuses(spark, ["٣٤", "ab"], "REGEX", r"^\d+$") == ["PASS", "FAIL"]
    assert statuses(spark, ["it's \"x\"", "its"], "REGEX", "it's \"x\"") == ["PASS", "FAIL"]
    assert statuses(spark, [12, 7], "REGEX", r"\d{2}$", dtype="int") == ["PASS", "FAIL"]


PATTERNS = [r"^[^@\s]+@[^@\s]+\.[^@\s]+$", r"^\+?\d{7,15}$", r"\w+\s?\d*$", "a.b"]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab1@. \n\t+-é٣", max_size=8), min_size=1, max_size=60))
def test_regex_agrees_with_python(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "id int, v string")
    rules = [Rule(str(i), "D", "n", "v", "REGEX", pattern, "ERROR") for i, pattern in enumerate(PATTERNS)]
    for line in apply_rules(df, rules, ["id"]).collect():
        matched = re.match(PATTERNS[int(line["rule_id"])], values[int(line["row_index"])])
        assert line["status"] == ("PASS" if matched else "FAIL")


def test_length_counts_code_points(spark):
    values = ["", "é", "😀😀", "abc", None]
    assert statuses(spark, values, "LENGTH", {"min": 1, "max": 2}) == [
        "FAIL", "PASS", "PASS", "FAIL", "NOT_APPLICABLE"]
    assert statuses(spark, ["", "x"], "LENGTH", {}) == ["PASS", "PASS"]


def python_range(value, low, high):
    try:
        number = float(value)
    except ValueError:
        return "ERROR"
    return "PASS" if low <= number <= high else "FAIL"


def test_range_on_text(spark):
    values = ["5", " 12 ", "1_000", "1e2", ".5", "5.", "inf", "-Infinity", "nan", "1.0d", "1.0f", "0x10", "abc",
              "", "_1", "1__0", "+3", "--3", "1e", "1\n", "12 3"]
    want = [python_range(v, 0, 120) for v in values]
    assert statuses(spark, values, "RANGE", {"min": 0, "max": 120}) == want
    assert statuses(spark, values, "RANGE", {}) == [python_range(v, float("-inf"), float("inf")) for v in values]
    assert statuses(spark, [None], "RANGE", {}) == ["NOT_APPLICABLE"]


def test_range_on_other_types(spark):
    assert statuses(spark, [0, 121, None], "RANGE", {"min": 0, "max": 120}, "int") == [
        "PASS", "FAIL", "NOT_APPLICABLE"]
    assert statuses(spark, [NAN, 1.5], "RANGE", {"min": 0}, "double") == ["NOT_APPLICABLE", "PASS"]
    assert statuses(spark, [True, None], "RANGE", {"max": 0}, "boolean") == ["FAIL", "NOT_APPLICABLE"]
    df = spark.sql("select 1 as id, date'2024-01-01' as v")
    assert [x["status"] for x in apply_rules(df, [rule("RANGE", {})], ["id"]).collect()] == ["ERROR"]


def test_enum(spark):
    assert statuses(spark, ["N", "n", "", None], "ENUM", ["N", "S"], severity="WARNING") == [
        "PASS", "WARNING", "WARNING", "NOT_APPLICABLE"]
    assert statuses(spark, [True, False], "ENUM", ["True"], "boolean") == ["PASS", "FAIL"]
    assert statuses(spark, [1, 2], "ENUM", ["1"], "int") == ["PASS", "FAIL"]
    assert statuses(spark, [1, 2], "ENUM", [1, 2], "int") == ["FAIL", "FAIL"]
    assert statuses(spark, ["it's", "x"], "ENUM", ["it's", 'q"'], "string") == ["PASS", "FAIL"]


def test_not_repeated_digits(spark):
    values = ["123", "111", "1-1-1", "7", "n/a", "", None, "+1 (2)"]
    assert statuses(spark, values, "NOT_REPEATED_DIGITS") == [
        "PASS", "FAIL", "FAIL", "FAIL", "NOT_APPLICABLE", "NOT_APPLICABLE", "NOT_APPLICABLE", "PASS"]


@pytest.mark.parametrize("kind,parameter", [
    ("REGEX", None), ("REGEX", "(?P<x>a"), ("REGEX", "["), ("LENGTH", None), ("LENGTH", {"min": "a"}),
    ("RANGE", None), ("RANGE", {"max": None}), ("ENUM", None), ("ENUM", "North"), ("NO_SUCH_TYPE", None)])
def test_broken_rules_give_one_error_line(spark, kind, parameter):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    good = rule("NOT_NULL")
    lines = apply_rules(df, [rule(kind, parameter), good], ["id"]).collect()
    single = [x for x in lines if x["row_index"] is None]
    assert [(x["status"], x["value"], x["record_id"]) for x in single] == [("ERROR", None, None)]
    assert len(lines) == 3


def test_missing_column_wins_over_unknown_type(spark):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    lines = apply_rules(df, [rule("NO_SUCH_TYPE", attribute="gone")], ["id"]).collect()
    assert [(x["status"], x["row_index"]) for x in lines] == [("NOT_APPLICABLE", None)]


def test_disabled_rules_emit_nothing(spark):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    assert apply_rules(df, [rule("NOT_NULL", enabled=False)], ["id"]).count() == 0
    assert apply_rules(df, [rule("NOT_NULL", enabled=None)], ["id"]).count() == 1


def test_custom_rule_type_as_column(spark):
    checks = {**CHECKS, "EVEN": lambda cell, r_: cell.column % 2 == 0}
    assert statuses(spark, [2, 3, None], "EVEN", dtype="int", checks=checks) == ["PASS", "FAIL", "NOT_APPLICABLE"]


def test_custom_rule_type_as_pandas_udf(spark):
    @F.pandas_udf("boolean")
    def long_word(v):
        return v.str.len() > 3
    checks = {**CHECKS, "LONG_WORD": lambda cell, r_: long_word(cell.column)}
    assert statuses(spark, ["abcd", "ab"], "LONG_WORD", checks=checks) == ["PASS", "FAIL"]


def customers(spark, partitions=3):
    rows = [(1, "Ann", "a@b.co", "+15551234", "30", "North"), (1, "B", "bad", "7777777", "x", "Centre"),
            (None, None, None, None, None, None), (3, "Cy", "c@d.e", "12", "150", "West")]
    schema = "customer_id int, name string, email string, phone string, age string, region string"
    return spark.createDataFrame(rows, schema).repartition(partitions)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("partitions", [1, 7])
def test_rollup_equals_long_results(spark, partitions):
    df = customers(spark, partitions)
    catalog = [*customer_rules(), rule("NOT_NULL", attribute="gone"), rule("WHAT", attribute="name"),
               rule("ENUM", None, attribute="name")]
    results = apply_rules(df, catalog, ["customer_id"])
    fused = rule_rollup(df, catalog)
    assert rows(fused) == rows(rollup_results(results).select(*fused.columns))
    assert rows(r.summarize_by_dimension(fused)) == rows(r.summarize_by_dimension(results))
    assert rows(r.overall_rule_score(fused)) == rows(r.overall_rule_score(results))


def test_summaries(spark):
    df = customers(spark)
    results = apply_rules(df, customer_rules(), ["customer_id"])
    by_dimension = {x["dimension"]: x for x in r.summarize_by_dimension(results).collect()}
    assert by_dimension["Uniqueness"]["pass_rate_pct"] == 50.0
    assert by_dimension["Completeness"]["total_checks"] == 16
    assert by_dimension["Consistency"].asDict() == {
        "dimension": "Consistency", "pass_rate_pct": 66.67, "total_checks": 4, "failed": 0, "warnings": 1}
    score = r.overall_rule_score(results).first()
    assert score["rules_executed"] == 11 and score["critical_issues"] == 3
    exceptions = r.get_exceptions(results).collect()
    assert [x["severity"] for x in exceptions] == sorted(x["severity"] for x in exceptions)
    assert r.exception_totals(results).first()["violations"] == len(exceptions)
    assert r.exception_totals(results).first()["records"] == 2           # ids 1 and 3; the missing id is not counted


def test_dimension_without_applicable_checks_has_full_rate(spark):
    df = spark.createDataFrame([(1, None)], "id int, v string")
    results = apply_rules(df, [rule("ENUM", ["a"]), rule("ENUM", ["a"], dimension=None)], ["id"])
    assert [tuple(x) for x in r.summarize_by_dimension(results).collect()] == [("D", 100.0, 1, 0, 0)]


def test_empty_results(spark):
    nothing = spark.createDataFrame([], RESULT_SCHEMA)
    assert r.summarize_by_dimension(nothing).columns == [
        "dimension", "pass_rate_pct", "total_checks", "failed", "warnings"]
    assert r.summarize_by_dimension(nothing).count() == 0
    assert tuple(r.overall_rule_score(nothing).first()) == (0, 0, 0, 0, 0)
    assert r.get_exceptions(nothing).count() == 0
    assert tuple(r.exception_totals(nothing).first()) == (0, 0)
    empty = customers(spark).where("false")
    assert apply_rules(empty, customer_rules(), ["customer_id"]).count() == 0
    assert rule_rollup(empty, customer_rules()).count() == 0


def test_rows_are_numbered_without_id_columns(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "v string")
    lines = apply_rules(df, [rule("UNIQUE"), rule("NOT_NULL")]).collect()
    by_row = {}
    for x in lines:
        by_row.setdefault(x["row_index"], set()).add(x["value"])
    assert len(by_row) == 3 and all(len(v) == 1 for v in by_row.values())
    assert all(x["record_id"] == x["row_index"] for x in lines)


def test_numbered_rows_keep_what_the_rules_need(spark):
    """Without id columns a UNIQUE rule writes the numbered rows out, with the columns the rules look at."""
    df = customers(spark).withColumn("other", F.lit(7))
    lines = apply_rules(df, customer_rules())
    assert lines.count() == 44
    checks = {**CHECKS, "OTHER": lambda cell, r_: F.col("other") == 7}
    found = apply_rules(df, [rule("UNIQUE", attribute="name"), rule("OTHER", attribute="name")], checks=checks)
    assert sorted(x["status"] for x in found.collect()) == ["PASS"] * 8


def test_columns_with_odd_names(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], ["id", "x.y `z`"])
    lines = apply_rules(df, [rule("NOT_NULL", attribute="x.y `z`"), rule("UNIQUE", attribute="x.y `z`")], ["id"])
    assert sorted(x["status"] for x in lines.collect()) == ["FAIL", "PASS", "PASS", "PASS"]


def test_catalogue_file(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text("""[
      {"rule_id": "b", "dimension": "D", "rule_name": "n", "attribute": "v", "rule_type": "ENUM",
       "parameter": ["x", "y"], "severity": "ERROR"},
      {"rule_id": "a", "dimension": "D", "rule_name": "n", "attribute": "v", "rule_type": "REGEX",
       "parameter": "^\\\\d+$", "severity": "ERROR", "enabled": false, "priority": 2},
      {"rule_id": "c", "dimension": "D", "rule_name": "n", "attribute": "v", "rule_type": "LENGTH",
       "parameter": {"min": 2}, "severity": "ERROR", "priority": 1},
      {"rule_id": "d", "dimension": "D", "rule_name": "n", "attribute": "v", "rule_type": "NOT_NULL",
       "parameter": null, "severity": "ERROR"}]""")
    catalog = load_rule_catalog(spark, str(path))
    assert [x.rule_id for x in catalog] == ["c", "a", "b", "d"]
    assert [x.parsed for x in catalog] == [{"min": 2}, None, ["x", "y"], None]
    assert catalog[1].parameter == r"^\d+$" and not catalog[1].enabled and catalog[2].enabled
    # Selecting counts disabled rules.
    df = spark.createDataFrame([(1, "x")], "id int, v string")
    assert {x["rule_id"] for x in apply_rules(df, select_rules(catalog, 2), ["id"]).collect()} == {"c"}
