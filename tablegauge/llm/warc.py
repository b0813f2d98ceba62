"""WARC archives with segmented records: writing pages, and reassembling them.

A record that is larger than a segment is written as a first record and continuation records, which name the first one
as their origin.  Reading groups the segments by origin, orders them by number, verifies the total length, and undoes
the chunked transfer framing of the HTTP message.  Archives are text files with CRLF line ends as Spark writes them, so
that they can lie in any store that Spark reaches.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablegauge.functions.missing import quoted

_DATE = "2024-01-01T00:00:00Z"
_TYPE = "application/http; msgtype=response"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


@dataclass(frozen=True)
class Archives:
    """Records are cut into segments of ``segment`` bytes, HTTP bodies are framed in chunks of ``chunk`` bytes.

    An archive is closed after about ``archive`` bytes, so that a task can hold one.
    """

    segment: int = 16 << 10
    chunk: int = 4 << 10
    archive: int = 32 << 20
    #: Payloads shorter than this are always written in full.
    revisit_from: int = 0


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the CRLF that follows its last one: the writer of text files adds that."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n"


def _chunked(body: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(body[i: i + size]), body[i: i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def _uri(*key: object) -> str:
    return f"<{uuid.uuid5(_NAMESPACE, '/'.join(map(str, key))).urn}>"


def _header_text(value: object) -> str:
    return "" if value is None else str(value).replace("\r", "%0D").replace("\n", "%0A")


def page_records(page_id: object, target: str | None, row: int, body: bytes, digest: str, first: object, options: Archives):
    """The records of one page: a response in one or more segments, or a revisit of the page ``first``."""
    key = _uri(page_id, row)
    common = [("WARC-Date", _DATE), ("WARC-Target-URI", _header_text(target)), ("X-Page-Id", _header_text(page_id)),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(body)))]
    if first is not None:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Body-Length: {len(body)}\r\n\r\n".encode()
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", key), *common, ("WARC-Profile", profile),
                       ("X-Refers-To-Page", str(first)), ("Content-Type", _TYPE)], head)
        return
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = head + _chunked(body, options.chunk)
    cuts = [block[i: i + options.segment] for i in range(0, len(block), options.segment)]
    for number, part in enumerate(cuts, 1):
        headers = [("WARC-Type", "response" if number == 1 else "continuation"),
                   ("WARC-Record-ID", key if number == 1 else _uri(page_id, row, number)), *common,
                   ("Content-Type", _TYPE)]
        if len(cuts) > 1:
            headers.append(("WARC-Segment-Number", str(number)))
            if number > 1:
                headers.append(("WARC-Segment-Origin-ID", key))
            if number == len(cuts):
                headers.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record(headers, part)


def _write(options: Archives):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            columns = [batch.column(c) for c in ("id", "row", "url", "digest", "first", "body")]
            for i in range(batch.num_rows):
                page, row, url, digest, first, body = (c[i].as_py() for c in columns)
                digest = base64.b32encode(bytes.fromhex(digest)).decode()
                for record in page_records(page, url, row, body.encode(), digest, first, options):
                    out.append(record)
                    size += len(record)
                if size > 1 << 20:
                    yield pa.record_batch({"record": pa.array(out, pa.binary())})
                    out, size = [], 0
            if out:
                yield pa.record_batch({"record": pa.array(out, pa.binary())})

    return run


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", options: Archives = Archives()) -> None:
    """Write a record for each row to gzipped archives below ``path``.

    Of rows with equal payloads (a null one is empty) those with the smallest id are responses and the others revisits;
    null ids come last.  Rows that share an id and a payload are told apart by their row number in the archives.
    """
    body = F.coalesce(quoted(html_col).cast("string"), F.lit(""))
    rows = pages.select(quoted(id_col).alias("id"), quoted(url_col).cast("string").alias("url"), body.alias("body"))
    hashed = rows.select("*", F.monotonically_increasing_id().alias("row"), F.sha1("body").alias("digest"))
    order = F.struct(F.isnull("id").alias("last"), "id")
    first = (hashed.select("digest", order.alias("place")).groupBy("digest")
             .agg(F.min("place").alias("place"), F.count("*").alias("n"))
             .filter("n > 1").select(F.reverse("digest").alias("key"), F.col("place.id").alias("origin")))
    # The changed key makes Spark deal both sides out, so that a very common payload can be split.
    told = hashed.withColumn("key", F.reverse("digest")).join(first, "key", "left")
    later = F.col("origin").isNotNull() & ~F.col("id").eqNullSafe(F.col("origin"))
    long_enough = F.octet_length("body") >= options.revisit_from
    told = told.withColumn("first", F.when(later & long_enough, F.col("origin")))
    records = told.select("id", "row", "url", "digest", "first", "body").mapInArrow(_write(options), "record binary")
    # A file holds a bounded number of segments, and so a bounded number of bytes.
    per_file = max(1, options.archive // (options.segment + 1024))
    records.select(F.col("record").cast("string").alias("value")).write.option("maxRecordsPerFile", per_file).option(
        "lineSep", "\r\n").option("compression", "gzip").text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive."""
    at = 0
    while at < len(data):
        if data[at: at + 2] == b"\r\n":
            at += 2
            continue
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:stop].decode().split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
        size = int(headers["content-length"])
        block = data[stop + 4: stop + 4 + size]
        if len(block) < size:
            raise ValueError(f"record at byte {at} is cut short")
        yield headers, block
        at = stop + 4 + size


def _segments(whole: bool):
    """Records of archives: those that are whole, or else the segments of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from _segment_rows(content.as_py(), whole)

    return run


def _segment_rows(raw: bytes, whole: bool) -> Iterator[pa.RecordBatch]:
    names = ("origin", "number", "total", "kind", "page", "digest", "bytes", "refers", "block")
    data = zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw
    rows, size = [], 0
    for h, block in parse_records(data):
        if h["warc-type"] not in ("response", "revisit", "continuation") or whole == ("warc-segment-number" in h):
            continue
        rows.append((h.get("warc-segment-origin-id", h["warc-record-id"]), int(h.get("warc-segment-number", 1)),
                     int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None,
                     h["warc-type"], h.get("x-page-id", ""), h.get("warc-payload-digest", ""),
                     int(h.get("x-payload-length", -1)), h.get("x-refers-to-page"), block))
        size += len(block)
        if size > 1 << 20:
            yield _rows_batch(names, rows)
            rows, size = [], 0
    if rows:
        yield _rows_batch(names, rows)


def _rows_batch(names, rows) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    return pa.record_batch({n: pa.array(c, k) for n, c, k in zip(names, zip(*rows), kinds)})


def dechunked(body: bytes) -> bytes:
    """The payload behind chunked transfer framing."""
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        size = int(body[at:stop].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[stop + 2: stop + 2 + size])
        if len(out[-1]) < size or body[stop + 2 + size: stop + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = stop + 4 + size


def _payload(kind: str, block: bytes) -> bytes | None:
    head, _, body = block.partition(b"\r\n\r\n")
    if kind == "revisit":
        return None
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _put_together(held: list[dict]) -> tuple:
    first, block = held[0], b"".join(x["block"] for x in held)
    total = held[-1]["total"]
    fine = first["kind"] != "continuation" and [x["number"] for x in held] == list(range(1, len(held) + 1))
    fine = fine and (total == len(block) if total is not None else len(held) == 1)
    try:
        payload = _payload(first["kind"], block) if fine else None
    except ValueError:
        payload, fine = None, False
    stated, size = first["digest"].removeprefix("sha1:"), first["bytes"]
    digest = stated
    if payload is not None:
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        fine = digest == stated and len(payload) == size
        size = len(payload)
    return first["page"], first["kind"], payload, size, digest, first["refers"], len(held), fine


_WHOLE = (("page", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
          ("payload_digest", pa.string()), ("refers", pa.string()), ("n_segments", pa.int32()), ("intact", pa.bool_()))


def _whole_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch({n: pa.array(c, k) for (n, k), c in zip(_WHOLE, zip(*rows))})


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by origin and number; one record, and about a megabyte of finished ones, is held at a time."""
    held: list[dict] = []
    done: list[tuple] = []
    size = 0
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["origin"] != row["origin"]:
                done.append(_put_together(held))
                size += len(done[-1][2] or b"")
                held = []
                if size > 1 << 20:
                    yield _whole_batch(done)
                    done, size = [], 0
            # A segment that was read twice counts once.
            if not held or held[-1]["number"] != row["number"]:
                held.append(row)
    if held:
        done.append(_put_together(held))
    if done:
        yield _whole_batch(done)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below ``path``, put together again.

    Columns: ``page`` (text), ``record_type``, ``payload`` (null for revisits), ``payload_bytes``, ``payload_digest``,
    ``refers`` (page a revisit refers to), ``n_segments``, ``intact``: whether all segments are there, the total length
    is right, and length and digest of the payload are as stated.
    """
    kinds = ("origin string, number int, total long, kind string, page string, digest string, bytes long, "
             "refers string, block binary")
    files = spark.read.format("binaryFile").load(path).select("content")
    single = files.mapInArrow(_segments(True), kinds)
    several = files.mapInArrow(_segments(False), kinds)
    several = several.repartition("origin").sortWithinPartitions("origin", "number")
    out = ("page string, record_type string, payload binary, payload_bytes long, payload_digest string, refers string, "
           "n_segments int, intact boolean")
    return single.mapInArrow(_reassemble, out).unionAll(several.mapInArrow(_reassemble, out))
