import base64
import hashlib

import pytest
from pyspark.sql import functions as F

import edge
from tablegauge.llm import warc
from tablegauge.llm.warc import Archives, dechunked, read_archives, write_archives

PAGES = [(i, f"http://x/{i}\r\nEvil: 1" if i == 2 else f"http://x/{i}", t) for i, t in enumerate(
    ["<p>é😀</p>", None, "", "WARC/1.1\r\n\r\n0\r\n\r\n" * 50, "<p>é😀</p>", "y" * 100_000, "y" * 100_000, "\r\n", "ü" * 5_000])]
PAGES += [(None, None, "lone"), (4, "http://x/4", "<p>é😀</p>"), (None, "http://n", "<p>é😀</p>")]


def expected():
    out = []
    for i, _, t in PAGES:
        body = (t or "").encode()
        same = [j for j, _, u in PAGES if (u or "").encode() == body and j is not None]
        first = min(same, default=None)
        again = first is not None and i != first
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((str("" if i is None else i), "revisit" if again else "response", len(body), digest,
                    str(first) if again else None, None if again else body))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [Archives(), Archives(segment=700, chunk=64, archive=9000)])
def test_round_trip(spark, tmp_path, options):
    pages = edge.with_clashing(spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3))
    path = f"file://{tmp_path}/warc"
    write_archives(pages, path, options=options)
    rows = read_archives(spark, path).collect()
    assert all(r.intact for r in rows)
    got = sorted(((r.page, r.record_type, r.payload_bytes, r.payload_digest, r.refers,
                   None if r.payload is None else bytes(r.payload)) for r in rows), key=repr)
    assert got == expected()
    assert max(r.n_segments for r in rows) == (7 if options == Archives() else max(r.n_segments for r in rows))


def test_lost_and_repeated_segments(spark):
    out = list(warc.page_records(1, "u", 0, b"z" * 3000, base64.b32encode(hashlib.sha1(b"z" * 3000).digest()).decode(), None,
                                 Archives(segment=1000, chunk=100)))
    rows = [r for x in out for b in warc._segment_rows(x + b"\r\n", False) for r in b.to_pylist()]
    assert len(rows) == 4
    whole = warc._put_together(rows)
    assert whole[-1] and whole[2] == b"z" * 3000
    assert not warc._put_together(rows[:-1])[-1] and not warc._put_together(rows[:1] + rows[2:])[-1]


def test_broken_framing():
    assert dechunked(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        dechunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    write_archives(pages, f"file://{tmp_path}/none")
    assert read_archives(spark, f"file://{tmp_path}/none").select(F.count("*")).first()[0] == 0
