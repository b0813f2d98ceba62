"""Run a registered query and its SQL twin on the same tables and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def engine(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def _sorted(rows):
    return sorted((tuple(_plain(v) for v in row) for row in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


def differences(spark, con, query, sql: str, sf_dir: str = SF_DIR) -> list[str]:
    """What differs; an empty list if the two agree in columns, row count and values."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = _sorted(df.select(*[f"`{n}`" for n in names]).collect())
    relation = con.sql(sql)
    if sorted(relation.columns) != names:
        return [f"columns {names} vs {sorted(relation.columns)}"]
    positions = [relation.columns.index(n) for n in names]
    want = _sorted(tuple(row[p] for p in positions) for row in relation.fetchall())
    if len(got) != len(want):
        return [f"{len(got)} rows vs {len(want)}"]
    kinds = [f"{n}: {type(a).__name__} vs {type(b).__name__}" for n, a, b in zip(names, got[0], want[0])
             if a is not None and b is not None and type(a) is not type(b)] if got else []
    return kinds + [f"{a} vs {b}" for a, b in zip(got, want) if a != b][:5]
