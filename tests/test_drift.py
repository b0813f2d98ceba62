"""Schema comparison and the two-sample test, against numpy."""

import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest

from compare import SF_DIR
from tablegauge.operators import drift

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def schema(spark, pairs):
    return spark.createDataFrame(pairs, "column string, dtype string")


def test_schema_changes(spark):
    old = schema(spark, [("a", "bigint"), ("b", "string"), ("c", "double")])
    new = schema(spark, [("a", "bigint"), ("b", "double"), ("d", "string")])
    assert sorted(map(tuple, drift.compare_schemas(old, new).collect())) == [
        ("added", "d", None, "string"), ("removed", "c", "double", None), ("type_changed", "b", "string", "double")]
    assert [r[0] for r in drift.added_columns(old, new).collect()] == ["d"]
    assert [r[0] for r in drift.removed_columns(old, new).collect()] == ["c"]
    assert [tuple(r) for r in drift.type_changes(old, new).collect()] == [("b", "string", "double")]
    assert drift.has_changes(old, new).first()[0] is True
    assert drift.has_changes(old, old).first()[0] is False


def test_schema_change_log_over_history(spark):
    from datetime import datetime

    day = lambda d: datetime(2024, 1, d)
    rows = [
        ("s", day(1), '{"a": "bigint", "b": "string"}'),
        ("s", day(2), '{"a": "bigint", "b": "string"}'),          # unchanged: no line
        ("s", day(3), '{"a": "double", "c": "string"}'),
        ("s", day(4), None),                                        # no schema: all removed
        ("s", day(4), "not json"),                                  # same moment, ordered by text after null
        ("s", day(5), '{"x": "int"}'),
        ("t", day(2), '{"a": "int"}'),                              # first of its dataset: no line
        ("t", day(1), '{"a": "bigint"}'),
    ]
    snaps = spark.createDataFrame(rows, "dataset_name string, snapshot_timestamp timestamp, schema_json string")
    got = sorted(tuple(r) for r in drift.schema_change_log(snaps).select(
        "dataset_name", "version", "change", "column", "old_type", "new_type").collect())
    assert got == [
        ("s", 3, "added", "c", None, "string"), ("s", 3, "removed", "b", "string", None),
        ("s", 3, "type_changed", "a", "bigint", "double"),
        ("s", 4, "removed", "a", "double", None), ("s", 4, "removed", "c", "string", None),
        ("s", 6, "added", "x", None, "int"),
        ("t", 2, "type_changed", "a", "bigint", "int"),
    ]
    assert drift.schema_change_log(snaps.limit(0)).count() == 0
    plan = drift.schema_change_log(snaps)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def distance(a, b):
    a, b = np.sort(a[~np.isnan(a)]), np.sort(b[~np.isnan(b)])
    points = np.concatenate([a, b])
    return np.max(np.abs(np.searchsorted(a, points, "right") / len(a) - np.searchsorted(b, points, "right") / len(b)))


def samples():
    rng = np.random.default_rng(11)
    old = pd.DataFrame({
        "smooth": rng.normal(size=900), "shifted": rng.normal(size=900), "ties": rng.integers(0, 3, 900) * 1.0,
        "hot": np.where(rng.random(900) < 0.4, 5.0, rng.normal(5, 3, 900)), "whole": rng.integers(0, 50, 900),
        "flag": rng.random(900) < 0.5, "gaps": np.where(rng.random(900) < 0.3, np.nan, rng.random(900)), "text": "x"})
    new = pd.DataFrame({
        "smooth": rng.normal(size=700), "shifted": rng.normal(0.3, 1, size=700), "ties": rng.integers(0, 3, 700) * 1.0,
        "hot": np.where(rng.random(700) < 0.3, 5.0, rng.normal(5, 3, 700)), "whole": rng.integers(0, 50, 700),
        "flag": rng.random(700) < 0.7, "gaps": np.where(rng.random(700) < 0.3, np.nan, rng.random(700)), "text": "x",
        "only_new": 1.0})
    return old, new


@pytest.mark.parametrize("partitions,shuffle", [(1, 1), (5, 7), (3, 16)])
def test_distances_match_numpy(spark, partitions, shuffle):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    try:
        old, new = samples()
        found = {r["column"]: r for r in drift.ks_distances(
            spark.createDataFrame(old).repartition(partitions), spark.createDataFrame(new)).collect()}
        assert set(found) == {"smooth", "shifted", "ties", "hot", "whole", "flag", "gaps"}
        for c, r in found.items():
            assert r["distance"] == pytest.approx(distance(old[c].astype(float), new[c].astype(float)), abs=1e-12), c
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_verdicts(spark):
    old, new = map(spark.createDataFrame, samples())
    found = {r["column"]: r for r in drift.detect_data_drift(old, new).collect()}
    assert found["shifted"]["drift_detected"] and found["flag"]["drift_detected"]
    assert not found["smooth"]["drift_detected"]
    strict = {r["column"]: r for r in drift.detect_data_drift(old, new, alpha=0.0).collect()}
    assert not any(r["drift_detected"] for r in strict.values())
    itself = drift.detect_data_drift(old, old).collect()
    assert all((r["ks_statistic"], r["p_value"], r["drift_detected"]) == (0.0, 1.0, False) for r in itself)


@pytest.mark.parametrize("n,critical", [(50, 0.18841), (100, 0.13403)])
def test_p_value_at_published_critical_points(spark, n, critical):
    """Five-percent points of the one-sample statistic for an effective size of ``n``."""
    df = spark.createDataFrame([(critical, 2 * n, 2 * n)], "d double, a bigint, b bigint")
    p = df.select(drift.ks_p_value(df["d"], df["a"], df["b"])).first()[0]
    assert p == pytest.approx(0.05, abs=5e-4)


def test_small_and_missing_columns(spark):
    one = spark.createDataFrame([(1.0, 1.0, None)], "a double, b double, c double")
    many = spark.createDataFrame([(1.0, 2.0, None), (2.0, None, None), (3.0, None, None)], "a double, b double, c double")
    assert drift.detect_data_drift(one, many).count() == 0
    assert [r["column"] for r in drift.detect_data_drift(many, many).collect()] == ["a"]
    assert drift.detect_data_drift(one.selectExpr("'x' as t"), many).count() == 0


def test_workers_do_not_need_the_package(tmp_path):
    """Run outside the repository, with the package on the driver's path only."""
    script = (
        f"import sys; sys.path.insert(0, {REPO!r})\n"
        "import __spark_entry__ as driver\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        f"print('lines', driver.queries()['ks_drift'](spark, {SF_DIR!r}).count())\n")
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=clean, capture_output=True, text=True,
                          timeout=300)
    assert "lines 3" in done.stdout, done.stderr[-2000:]


def _enumerated_p(a, b):
    """The share of all splits of the pooled values whose statistic reaches the observed one."""
    from itertools import combinations

    pooled, n1 = a + b, len(a)

    def stat(xs, ys):
        return max(abs(sum(x <= v for x in xs) / len(xs) - sum(y <= v for y in ys) / len(ys)) for v in pooled)

    d = stat(a, b)
    splits = [stat([pooled[k] for k in idx], [pooled[k] for k in range(len(pooled)) if k not in idx])
              for idx in combinations(range(len(pooled)), n1)]
    return d, sum(x >= d - 1e-12 for x in splits) / len(splits)


@pytest.mark.parametrize("n1,n2", [(3, 2), (4, 4), (6, 5), (2, 9), (7, 7)])
def test_exact_p_value_against_enumeration(n1, n2):
    rng = np.random.default_rng(n1 * 10 + n2)
    values = [float(x) for x in rng.permutation(1000)[: n1 + n2]]
    d, want = _enumerated_p(values[:n1], values[n1:])
    assert drift.ks_exact_p(d, n1, n2) == pytest.approx(want, abs=1e-12)
    assert drift.ks_exact_p(0.0, n1, n2) == 1.0


def test_exact_and_limiting_p_values_in_the_drift_test(spark):
    """Small samples get the exact p-value by default, large ones the limiting distribution's."""
    rng = np.random.default_rng(4)
    old = spark.createDataFrame(pd.DataFrame({"x": rng.normal(0, 1, 40)}))
    new = spark.createDataFrame(pd.DataFrame({"x": rng.normal(0.6, 1, 30)}))
    line = drift.detect_data_drift(old, new).first()
    d = drift.ks_distances(old, new).first()["distance"]
    assert line.p_value == pytest.approx(round(drift.ks_exact_p(d, 40, 30), 4))
    limiting = drift.detect_data_drift(old, new, method="asymp").first().p_value
    assert limiting != line.p_value
    assert drift.detect_data_drift(old, new, method="exact").first().p_value == line.p_value
    with pytest.raises(ValueError):
        drift.detect_data_drift(old, new, method="other")
