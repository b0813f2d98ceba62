"""Readers, inference, samples, fingerprints."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tablegauge import exact_sample, load_dataset
from tablegauge.sources import sampling
from tablegauge.sources.inference import infer_schema, infer_types, normalize_missing
from tablegauge.sources.readers import read_csv
from tablegauge.sources.summary import dataset_fingerprint, dataset_summary, schema_fingerprint


def dtypes(df):
    return dict(df.dtypes)


def test_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,name,score,flag,day,none\n'
                    '1,"Ann, A",1.5,True,2024-01-01,NA\n'
                    '2,"say ""hi""",N/A,False,2024-01-02,\n'
                    '3,null, 2 ,True,2024-01-03,nan\n', encoding="utf-8")
    df = load_dataset(spark, str(path))
    assert dtypes(df) == {"id": "bigint", "name": "string", "score": "double", "flag": "boolean", "day": "string",
                          "none": "double"}
    rows = df.orderBy("id").collect()
    assert [r["name"] for r in rows] == ["Ann, A", 'say "hi"', None]
    assert [r["score"] for r in rows] == [1.5, None, 2.0]


def test_csv_records_over_several_lines(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,text\n1,"two\nlines"\n2,x\n', encoding="utf-8")
    assert [r["text"] for r in load_dataset(spark, str(path)).orderBy("id").collect()] == ["two\nlines", "x"]
    typed = read_csv(spark, str(path), schema="id int, text string")
    assert dtypes(typed) == {"id": "int", "text": "string"} and typed.count() == 2


def test_csv_with_short_and_long_records(spark, tmp_path):
    short = tmp_path / "short.csv"
    short.write_text("a,b,c\n1,2,3\n4,5\n", encoding="utf-8")
    assert sorted(map(tuple, load_dataset(spark, str(short)).collect())) == [(1, 2, 3), (4, 5, None)]
    surplus = tmp_path / "long.csv"
    surplus.write_text("a,b\n1,2\n4,5,6\n", encoding="utf-8")
    with pytest.raises(ValueError, match="does not fit its 2 columns"):
        load_dataset(spark, str(surplus))


def test_csv_with_long_quoted_fields_in_odd_records(spark, tmp_path):
    """A record one field short with a very long quoted field, doubled quotes in it, does not stop the reader."""
    long = "x" * 30_000 + '""q"", 1' * 2_000
    path = tmp_path / "long_field.csv"
    path.write_text(f'a,b,c\n1,"{long}",3\n2,"{long}"\n', encoding="utf-8")
    rows = sorted(map(tuple, load_dataset(spark, str(path)).collect()), key=str)
    assert rows == [(1, long.replace('""', '"'), 3), (2, long.replace('""', '"'), None)]
    surplus = tmp_path / "long_surplus.csv"
    surplus.write_text(f'a,b\n1,"{long}",3\n', encoding="utf-8")
    with pytest.raises(ValueError, match="does not fit its 2 columns"):
        load_dataset(spark, str(surplus))


def test_text_columns_can_be_kept(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("phone,zip\n+15551234567,00120\n", encoding="utf-8")
    assert tuple(load_dataset(spark, str(path)).first()) == (15551234567, 120)
    kept = load_dataset(spark, str(path), string_cols=["phone", "zip"])
    assert tuple(kept.first()) == ("+15551234567", "00120")


def test_json(spark, tmp_path):
    document = tmp_path / "in.json"
    document.write_text('[\n {"a": 1, "b": "x"},\n {"a": 2, "b": null}\n]', encoding="utf-8")
    lines = tmp_path / "in.jsonl"
    lines.write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": null}\n', encoding="utf-8")
    for path in (document, lines):
        assert sorted(map(tuple, load_dataset(spark, str(path)).collect())) == [(1, "x"), (2, None)]


def test_parquet_and_unknown_types(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "t.parquet"))
    assert load_dataset(spark, str(tmp_path / "t.parquet")).count() == 5
    with pytest.raises(ValueError, match="Unsupported file type"):
        load_dataset(spark, "/nowhere/report.docx")
    with pytest.raises(ValueError, match="id_cols"):
        load_dataset(spark, str(tmp_path / "t.parquet"), sample_size=3)
    assert load_dataset(spark, str(tmp_path / "t.parquet"), sample_size=3, id_cols=["id"]).count() == 3


@pytest.mark.parametrize("values,dtype", [
    (["1", " 2 ", "+3", "-4"], "bigint"), (["1", "2.5"], "double"), (["1e3", "inf"], "double"),
    (["9223372036854775808"], "double"), (["True", "false", "TRUE"], "boolean"), (["t", "yes"], "string"),
    (["1.0d"], "string"), (["1_000"], "string"), (["1", "x"], "string"), ([None, None], "double"),
    (["1", None], "bigint"), (["2024-01-01"], "string"), (["1", "True"], "string")])
def test_inference(spark, values, dtype):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [tuple(r) for r in infer_types(df).collect()] == [("v", dtype)]


def test_inference_keeps_typed_columns(spark):
    df = spark.createDataFrame([("1", 2, "3")], "a string, b int, c string")
    assert {r["column"]: r["dtype"] for r in infer_types(df, ["c"]).collect()} == {
        "a": "bigint", "b": "int", "c": "string"}


def test_missing_tokens(spark):
    df = spark.createDataFrame([("NA", 1), ("", 2), ("n/a", 3), (" NA", 4), (None, 5), ("none", 6)], "v string, n int")
    assert [r["v"] for r in normalize_missing(df).orderBy("n").collect()] == [None, None, None, " NA", None, "none"]


@pytest.mark.parametrize("n", [7, 300, 999])
def test_exact_sample_equals_full_sort(spark, n):
    df = spark.range(1000).repartition(5)
    digest = F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit("42")))
    want = {r["id"] for r in df.orderBy(digest, "id").limit(n).collect()}
    assert {r["id"] for r in exact_sample(df, n, ["id"]).collect()} == want
    assert exact_sample(df, 1000, ["id"]).count() == 1000
    assert exact_sample(df, 5000, ["id"]).count() == 1000


def test_sample_survives_a_cut_that_is_too_sharp(spark, monkeypatch):
    # One id holds most rows, so the cut on the digest may leave too few; the full sort takes over.
    df = spark.range(4000).select(F.when(F.col("id") < 3900, F.lit(-1)).otherwise(F.col("id")).alias("id"))
    assert exact_sample(df, 200, ["id"]).count() == 200
    assert exact_sample(df, 30, ["id"]).count() == 30
    assert 0 < sampling.fraction_sample(df, 400).count() < 900


def test_summary(spark):
    df = spark.createDataFrame([(1, "é", True), (None, None, None)], "a bigint, b string, c boolean")
    row = dataset_summary(df).first()
    assert tuple(row) == (2, 3, 0.0, ["a", "b", "c"])
    big = spark.range(300_000)
    assert dataset_summary(big).first()["memory_usage_mb"] == 2.29


def test_fingerprint(spark):
    df = spark.createDataFrame([(1, "x")], 'b bigint, `a"q` string')
    want = hashlib.sha256(json.dumps({"b": "bigint", 'a"q': "string"}, sort_keys=True).encode()).hexdigest()[:12]
    assert dataset_fingerprint(df).first()[0] == want
    assert dataset_fingerprint(df.select('`a"q`', "b")).first()[0] == want
    assert dataset_fingerprint(df.withColumn("b", F.col("b").cast("int"))).first()[0] != want
    schemas = infer_schema(df).withColumn("dataset", F.lit("d"))
    assert tuple(schema_fingerprint(schemas).first()) == ("d", want)


def test_catalogue_table_with_partition_pruning(spark, tmp_path):
    location = tmp_path / "events_table"
    spark.range(0, 60).selectExpr("id", "cast(id % 3 as int) as part", "concat('v', id) as v").write.partitionBy(
        "part").parquet(str(location))
    name = f"events_{abs(hash(str(tmp_path))) % 10**8}"
    spark.sql(f"CREATE TABLE {name} (id bigint, v string, part int) USING parquet PARTITIONED BY (part) "
              f"LOCATION '{location}'")
    try:
        spark.sql(f"MSCK REPAIR TABLE {name}")
        df = load_dataset(spark, table=name, where="part = 1")
        assert sorted(r.id for r in df.collect()) == list(range(1, 60, 3))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters" in plan and "part" in plan.split("PartitionFilters")[1][:200]
        assert dict(df.dtypes) == {"id": "bigint", "v": "string", "part": "int"}
        assert load_dataset(spark, table=name).count() == 60
        with pytest.raises(ValueError):
            load_dataset(spark, "x.csv", table=name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_variant_kinds_and_fields(spark):
    from tablegauge.sources.variant import variant_fields, variant_kinds

    rows = [('{"k": 1, "v": 2.5, "s": "x", "n": null, "o": {"a": 1}, "l": [1], "b": true}',), ("not json",), (None,),
            ("[1, 2]",), ("{}",), ('{"k": "one"}',), ('"text"',), ('{"k": 1, "k": 2}',)]
    df = spark.createDataFrame(rows, "p string")
    got = sorted(tuple(r) for r in variant_kinds(df, "p").collect())
    assert got == [("$", "array", 1), ("$", "invalid", 2), ("$", "missing", 1), ("$", "string", 1),
                   ("b", "boolean", 1), ("k", "integer", 1), ("k", "string", 1), ("l", "array", 1), ("n", "null", 1),
                   ("o", "object", 1), ("s", "string", 1), ("v", "number", 1)]
    typed = variant_fields(df, "p", {"k": ("$.k", "int"), "a": ("$.o.a", "bigint"), "s": ("$.s", "string")})
    assert [(r.k, r.a, r.s) for r in typed.collect()][:2] == [(1, 1, "x"), (None, None, None)]
    assert typed.where("k is not null").count() == 1          # "one" does not fit an int
    assert variant_kinds(df.where("false"), "p").count() == 0


def test_csv_with_a_header_only_and_with_text_columns_kept(spark, tmp_path):
    """The surplus check rides on the inference pass, and also works where there is nothing to infer."""
    empty = tmp_path / "empty.csv"
    empty.write_text("a,b\n", encoding="utf-8")
    assert load_dataset(spark, str(empty)).count() == 0
    kept = tmp_path / "kept.csv"
    kept.write_text("a,b\n1,2\n3,4,5\n", encoding="utf-8")
    with pytest.raises(ValueError, match="does not fit its 2 columns"):
        load_dataset(spark, str(kept), string_cols=["a", "b"])
