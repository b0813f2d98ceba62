"""History tables, forecasts and the whole flow."""

from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablegauge import History, customer_rules, record, run_rules, schema_changes, trends
from tablegauge.operators import forecast, views
from tablegauge.plans.profile import run_full_profile
from tablegauge.sources import history as h

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def runs(spark, values, dataset="d", step=timedelta(hours=7)):
    rows = [(dataset, START + i * step, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "dataset_name string, run_timestamp timestamp, quality_score double")


@pytest.mark.parametrize("step", [timedelta(minutes=5), timedelta(hours=7), timedelta(days=40)])
def test_forecast_is_a_line_over_run_positions(spark, step):
    rng = np.random.default_rng(1)
    values = [round(float(v), 2) for v in 80 + rng.normal(size=40).cumsum()]
    slope, intercept = np.polyfit(range(40), values, 1)
    df = runs(spark, values, step=step).orderBy(F.rand(3))
    for ahead in (1, 5):
        want = intercept + slope * (39 + ahead)
        got = forecast.forecast_next_value(df, "quality_score", ahead, ["dataset_name"]).first()
        assert got["predicted"] == pytest.approx(want, abs=0.00501)
    assert forecast.forecast_next_value(df, "quality_score").first()["predicted"] == pytest.approx(
        intercept + slope * 40, abs=0.00501)


def test_short_series(spark):
    def predicted(values):
        return [r["predicted"] for r in forecast.predict_quality_score(runs(spark, values)).collect()]
    assert predicted([]) == []
    assert predicted([1.2345]) == [1.2345]                   # a single run predicts itself, unrounded
    assert predicted([1.0, 2.0]) == [3.0]
    assert predicted([1.0, None, 2.0]) == [3.0]              # a run without a value is no point of the line
    assert predicted([None]) == []
    assert predicted([float("nan"), 4.0]) == [4.0]


def test_many_series_at_once(spark):
    df = runs(spark, [1.0, 2.0, 3.0], "up").unionByName(runs(spark, [9.0, 7.0], "down"))
    found = {r["dataset_name"]: r["predicted"] for r in forecast.predict_quality_score(df).collect()}
    assert found == {"up": 4.0, "down": 5.0}
    assert views.quality_trend(df.unionByName(runs(spark, [1.0], "once"))).count() == 5


def test_columns_at_risk(spark):
    rows = [(c, START + timedelta(days=i), v) for c, vs in (
        ("bad", [80.0, 70.0, 60.0]), ("good", [90.0, 90.0]), ("new", [59.994]), ("none", [None])) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "column_name string, run_timestamp timestamp, health_score double")
    found = [tuple(r) for r in forecast.predict_columns_likely_to_fail(df).collect()]
    assert found == [("bad", 60.0, 50.0, True), ("new", 59.99, 59.994, True), ("good", 90.0, 90.0, False)]
    assert forecast.predict_columns_likely_to_fail(df.where("false")).count() == 0


def customers(spark, defects):
    rows = [(i, "Ann" if i >= defects else None, f"u{i}@b.co", f"+1555{i:07}", str(20 + i), "North") for i in range(20)]
    return spark.createDataFrame(
        rows, "customer_id int, name string, email string, phone string, age string, region string")


def test_history_round_trip(spark, tmp_path):
    history = History(spark, str(tmp_path / "history"))
    assert history.runs.count() == 0 and h.list_known_datasets(history.runs).count() == 0
    assert schema_changes(history, "customers", customers(spark, 0)) is None
    ids = []
    for i in range(3):
        profile = run_full_profile(customers(spark, i * 4))
        ids.append(history.save_profiling_run("customers", profile, f"file-{i}", START + timedelta(days=i)))
    history.save_profiling_run("2024", run_full_profile(customers(spark, 0)), None, START + timedelta(days=9))
    assert len(set(ids)) == 3

    found = h.get_run_history(history.runs, "customers").collect()
    assert [r["run_id"] for r in found] == ids
    assert [r["dataset_label"] for r in found] == ["file-0", "file-1", "file-2"]
    assert [(r["row_count"], r["column_count"]) for r in found] == [(20, 6)] * 3
    assert [r["avg_null_pct"] for r in found] == [0.0, 3.33, 6.67]
    assert found[2]["completeness_pct"] == 93.33 and found[0]["quality_score"] == 100.0

    metrics = h.get_column_metric_history(history.metrics, history.runs, "customers")
    assert metrics.count() == 18
    assert [r["null_pct"] for r in metrics.where("column_name = 'name'").orderBy("run_timestamp").collect()] == [
        0.0, 20.0, 40.0]
    assert [tuple(r)[0::3] for r in h.list_known_datasets(history.runs).collect()] == [("2024", 1), ("customers", 3)]
    assert h.list_known_datasets(history.runs).collect()[1]["dataset_label"] == "file-2"

    outlook = trends(history, "customers")
    assert outlook.run_history.count() == 3
    assert outlook.nulls.first()["predicted"] == 10.0
    assert outlook.volume.first()["predicted"] == 20.0
    first = outlook.columns_at_risk.first()
    assert (first["column"], first["predicted_next_health_score"], first["at_risk"]) == ("name", 58.0, True)


def test_record_and_schema_changes(spark, tmp_path):
    history = History(spark, str(tmp_path / "history"))
    run_id, profile = record(history, "customers", customers(spark, 0), "first")
    assert history.runs.first()["run_id"] == run_id
    assert schema_changes(history, "customers", customers(spark, 0)).count() == 0
    later = customers(spark, 0).drop("region").withColumn("age", F.col("age").cast("int")).withColumn("fax", F.lit("x"))
    changes = schema_changes(history, "customers", later).collect()
    assert sorted((r["change"], r["column"]) for r in changes) == [
        ("added", "fax"), ("removed", "region"), ("type_changed", "age")]
    record(history, "customers", later, "second")
    assert schema_changes(history, "customers", later).count() == 0
    assert h.get_latest_schema(history.snapshots).count() == 1


def test_run_rules(spark):
    report = run_rules(customers(spark, 3), customer_rules(), ["customer_id"])
    assert report.score.first()["rules_executed"] == 11
    assert [r["record_id"] for r in report.exceptions.where("rule_id = 'CUST-010'").collect()] == ["0", "1", "2"]
    assert {r["dimension"]: r["pass_rate_pct"] for r in report.dimensions.collect()}["Uniqueness"] == 100.0


def test_distinct_values_over_runs_from_their_sketches(spark, tmp_path):
    """Each run keeps a sketch per column; the union over runs needs no second look at the data."""
    from tablegauge.operators import profile as p

    history = History(spark, str(tmp_path / "history"))
    first = spark.range(0, 30_000).selectExpr("id % 20000 as k", "cast(id % 7 as string) as s", "cast(null as double) as x")
    second = spark.range(10_000, 50_000).selectExpr("id % 20000 + 15000 as k", "cast(id % 9 as string) as s",
                                                     "-0.0 * id as x")
    record(history, "d", first)
    record(history, "d", second)
    assert history.sketches.select("run_id").distinct().count() == 2
    got = {r["column"]: r for r in p.united_cardinality(
        history.sketches.withColumnRenamed("column_name", "column")).collect()}
    exact = {"k": 35_000, "s": 9, "x": 1}
    for column, count in exact.items():
        assert got[column].n_rows == 70_000
        assert abs(got[column].unique_count - count) <= p.DISTINCT_BOUND * count, column
    assert got["s"].unique_count == 9 and got["x"].unique_count == 1   # few values: exact; both zeros are one
    empty = p.united_cardinality(p.distinct_sketches(first.where("false")))
    assert {r["column"]: r.unique_count for r in empty.collect()} == {"k": 0, "s": 0, "x": 0}


def test_a_run_stopped_half_way_is_never_seen(spark, tmp_path, monkeypatch):
    history = History(spark, str(tmp_path / "history"))
    record(history, "d", customers(spark, 0), "complete")
    written = []

    def stop_at_runs(self, rows, table, schema, run):
        if table == h.RUNS:
            raise RuntimeError("executor lost")
        written.append(table)
        return original(self, rows, table, schema, run)

    original = History._append
    monkeypatch.setattr(History, "_append", stop_at_runs)
    with pytest.raises(RuntimeError):
        record(history, "d", customers(spark, 0).drop("region"), "broken")
    monkeypatch.setattr(History, "_append", original)
    assert written == [h.SNAPSHOTS, h.METRICS, h.SKETCHES]
    # Snapshot, metrics and sketches of the broken run are on disk but not in the history.
    assert [r.dataset_label for r in history.runs.collect()] == ["complete"]
    assert history.snapshots.count() == 1
    assert history.metrics.select("run_id").distinct().count() == 1
    assert history.sketches.select("run_id").distinct().count() == 1


def test_writers_at_the_same_time_do_not_collide(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    folder = str(tmp_path / "history")
    df = customers(spark, 0)
    with ThreadPoolExecutor(3) as pool:
        ids = list(pool.map(lambda i: record(History(spark, folder), f"d{i % 2}", df, f"w{i}")[0], range(3)))
    history = History(spark, folder)
    assert sorted(r.run_id for r in history.runs.collect()) == sorted(ids)
    assert history.snapshots.count() == 3
    assert {r.dataset_name: r.run_count for r in h.list_known_datasets(history.runs).collect()} == {"d0": 2, "d1": 1}
