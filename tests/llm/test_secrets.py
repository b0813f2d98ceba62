import hashlib
import re

import pytest
from pyspark.sql import functions as F

import edge
from tablegauge.llm import secrets

ASSIGN = re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def expected(text):
    text, out = text or "", []
    for m in ASSIGN.finditer(text):
        if len(m.group(1)) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    for rank, kind, pattern, least in ((1, "access", r"AKIA[A-Z0-9]+", 20), (2, "hex", r"[0-9a-f]+", 24)):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(out)


TEXTS = [
    None, "", "token = 'abcdef' x", "😀 Password:\"Zz9/+_.=-\" ñ api_key=short apikey = longer1",
    "secret=token: abcdefgh", "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "AKIA" + "C" * 20, "f" * 23 + "g" + "0a" * 12,
    "password=" + "ab12" * 10 + " token:" + "AKIA" + "Z" * 16, "paſſword=abcdefgh toKen=abcdefgh",
    "-----BEGIN RSA PRIVATE KEY----- eyJabcdefgh.abcdefgh12.abcdefgh", "token=abcdef " * 3000, "x" * 100_000,
]


@pytest.fixture(scope="module")
def versions(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2]), (None, TEXTS[3]), (99, TEXTS[3])]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_base_spans_of_every_row(versions):
    found = secrets.scan_secrets(edge.with_clashing(versions), ["doc_id"]).collect()
    assert len(found) == versions.count()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.blob, [tuple(s)[:4] for s in r.spans if s["rank"] < 3]) for r in found)
    want = sorted((i is None, i or 0, hashlib.sha256((t or "").encode()).hexdigest(), expected(t))
                  for i, t in versions.toLocalIterator())
    assert got == want


def test_more_kinds(versions):
    row = secrets.scan_secrets(versions.filter("doc_id = 9"), ["doc_id"]).first()
    assert [s["kind"] for s in row.spans] == ["pem", "jwt"]


def test_ledger_scans_only_unseen_pairs(spark, versions, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    first = secrets.scan_secrets(versions, ["doc_id"], ledger=ledger, rules=secrets.BASE_RULES[:1]).count()
    assert first == versions.count()
    n = spark.read.parquet(ledger).count()
    assert n == len(set(t or "" for t in TEXTS))
    secrets.scan_secrets(versions, ["doc_id"], ledger=ledger, rules=secrets.BASE_RULES[:1]).count()
    assert spark.read.parquet(ledger).count() == n
    more = versions.unionAll(spark.createDataFrame([(500, "new token=abcdefgh")], versions.schema))
    found = secrets.scan_secrets(more, ["doc_id"], ledger=ledger, rules=secrets.BASE_RULES).collect()
    rows = spark.read.schema(secrets.LEDGER).parquet(ledger).collect()
    assert sum(len(r.versions) for r in rows) == n + 2 * n + 3
    assert {r.doc_id: [tuple(s)[:4] for s in r.spans] for r in found}[7] == expected(TEXTS[7])
    assert {r.doc_id: len(r.spans) for r in found}[500] == 1


def test_redaction_keeps_rows_and_lengths(versions):
    docs = edge.with_clashing(versions)
    out = secrets.redact(docs, ["doc_id"])
    assert out.columns == docs.columns and out.count() == docs.count()
    for r in out.select("doc_id", "text").toLocalIterator():
        if r.doc_id == 7:
            assert set(r.text) <= set("* ")
        assert r.text is None or not expected(r.text)


def test_empty(no_docs):
    assert secrets.scan_secrets(no_docs, ["doc_id"]).count() == 0
    assert secrets.redact(no_docs, ["doc_id"]).select(F.count("*")).first()[0] == 0
