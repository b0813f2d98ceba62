"""Token ids in length-delimited binary records, with a separate offset index.

Documents are dealt out by ranges of their id and sorted within each range, so that the files hold them in ascending
order.  Each document's ids (unsigned 32-bit, little-endian, the end id appended) form one record, framed as

    length      8 bytes, unsigned little-endian: bytes of the ids
    length CRC  4 bytes: masked CRC-32 of the 8 length bytes
    ids         length bytes
    ids CRC     4 bytes: masked CRC-32 of the ids

where ``masked(c) = ((c >> 15) | (c << 17)) + 0xA282EAD8`` (32 bits).  The layout is that of TFRecord files, but the
checksum is CRC-32 as zlib computes it, not CRC-32C, which no installed library provides.

Ids come from the word-level tokenizer through the word table that packing uses too (each distinct word is
tokenized once); texts that may hold a special token's name are given to the tokenizer whole.

Executors write only through Spark, so the byte stream is stored in blocks of consecutive records (``blocks``: range,
block, data, and the entries of the block) of about ``block_bytes``; a longer record is a block of its own.  The index
(``index``: doc_id, range, block, offset, n_tokens, start) is a table apart, so that a reader can fetch any record by
its place without scanning the others, e.g. in a shuffled order.  ``start`` counts the ids of all documents before it.

Defined cases: a null text is empty and gives the end id alone; documents are ordered by id with null ids last and
repeated ids by text; an empty table writes empty tables; extra input columns are not read.  Reading checks every
length and checksum and fails on any mismatch.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablegauge.functions.missing import quoted
from tablegauge.llm.packing import _token_batches as token_ids
from tablegauge.llm.textarrays import chunks


@dataclass(frozen=True)
class Framing:
    end_id: int = 2
    block_bytes: int = 2 << 20
    row_group_bytes: int = 16 << 20
    chunk_bytes: int = 2 << 20      # text tokenized at a time: fewer, larger updates of the word table


ENTRY = "struct<doc_id: bigint, offset: bigint, n_tokens: bigint, local_start: bigint>"
BLOCKS = f"range int, block int, data binary, entries array<{ENTRY}>"
READ = "range int, block int, offset long, n_tokens long, ids_crc32 long"


def masked(crc: int) -> int:
    return ((((crc >> 15) | (crc << 17)) & 0xFFFFFFFF) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record around ``payload``."""
    length = struct.pack("<Q", len(payload))
    return (length + struct.pack("<I", masked(zlib.crc32(length))) + payload
            + struct.pack("<I", masked(zlib.crc32(payload))))


def records(data: bytes) -> Iterator[tuple[int, bytes, int]]:
    """Offset, payload and the payload's CRC-32 of each record of a byte stream; raises on a cut or damaged
    record."""
    at, size = 0, len(data)
    while at < size:
        if at + 12 > size:
            raise ValueError(f"record at byte {at} is cut short")
        head = data[at: at + 8]
        (length,), (check,) = struct.unpack("<Q", head), struct.unpack("<I", data[at + 8: at + 12])
        if masked(zlib.crc32(head)) != check:
            raise ValueError(f"length checksum differs at byte {at}")
        stop = at + 12 + length
        if stop + 4 > size:
            raise ValueError(f"record at byte {at} is cut short")
        payload = data[at + 12: stop]
        crc = zlib.crc32(payload)
        if masked(crc) != struct.unpack("<I", data[stop: stop + 4])[0]:
            raise ValueError(f"data checksum differs at byte {at}")
        yield at, payload, crc
        at = stop + 4


def _encoder(tokenizer_path: str, options: Framing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        block, buffer, entries, used, start = 0, [], [], 0, 0

        def flush():
            nonlocal block, buffer, entries, used
            out = pa.RecordBatch.from_pydict({"range": [part], "block": [block], "data": [b"".join(buffer)],
                                              "entries": [entries]}, schema=_BLOCKS_SCHEMA)
            block, buffer, entries, used = block + 1, [], [], 0
            return out

        for piece, text in chunks(batches, "text", options.chunk_bytes):
            ids = piece.column("doc_id").to_pylist()
            for doc_id, tokens in zip(ids, token_ids(text, tokenizer_path)):
                record = frame(np.append(tokens, options.end_id).astype("<u4").tobytes())
                if buffer and used + len(record) > options.block_bytes:
                    yield flush()
                n = len(tokens) + 1
                entries.append({"doc_id": doc_id, "offset": used, "n_tokens": n, "local_start": start})
                buffer.append(record)
                used += len(record)
                start += n
        if buffer:
            yield flush()

    return run


_BLOCKS_SCHEMA = pa.schema([("range", pa.int32()), ("block", pa.int32()), ("data", pa.binary()),
                           ("entries", pa.list_(pa.struct([("doc_id", pa.int64()), ("offset", pa.int64()),
                                                           ("n_tokens", pa.int64()), ("local_start", pa.int64())])))])


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, options: Framing = Framing(),
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """``path``/blocks and ``path``/index for every document of ``docs``, in ascending id order."""
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(_encoder(tokenizer_path, options), BLOCKS).write.option(
        "parquet.block.size", options.row_group_bytes).parquet(f"{path}/blocks")
    spark = docs.sparkSession
    entries = spark.read.parquet(f"{path}/blocks").select("range", "block", F.explode("entries").alias("e")).select(
        "range", "block", "e.*")
    # One line per range: where its ids begin.  A range is a task, so this table has as many lines as there are tasks.
    totals = entries.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("base"))
    index = entries.join(F.broadcast(bases), "range").select(
        "doc_id", "range", "block", "offset", "n_tokens", (F.col("base") + F.col("local_start")).alias("start"))
    index.write.parquet(f"{path}/index")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {"range": [], "block": [], "offset": [], "n_tokens": [], "ids_crc32": []}
        blocks = batch.column("data")
        for row, (part, block) in enumerate(zip(batch.column("range").to_pylist(), batch.column("block").to_pylist())):
            for offset, payload, crc in records(blocks[row].as_py()):
                if len(payload) % 4:
                    raise ValueError(f"record at byte {offset} of block {part}/{block} is not a list of 32-bit ids")
                for name, value in zip(out, (part, block, offset, len(payload) // 4, crc)):
                    out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
            ("range", pa.int32()), ("block", pa.int32()), ("offset", pa.int64()), ("n_tokens", pa.int64()),
            ("ids_crc32", pa.int64())]))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every record, parsed from the blocks and placed by the index."""
    found = spark.read.parquet(f"{path}/blocks").select("range", "block", "data").mapInArrow(_reader, READ)
    index = spark.read.parquet(f"{path}/index")
    placed = found.join(index.select("range", "block", "offset", "doc_id", "start",
                                     F.col("n_tokens").alias("indexed")), ["range", "block", "offset"], "full")
    # A record without an index line, or the reverse, has a null on one side: the files do not belong together.
    broken = F.col("start").isNull() | F.col("ids_crc32").isNull() | (F.col("n_tokens") != F.col("indexed"))
    return placed.select("doc_id", "start", "n_tokens", "ids_crc32", broken.alias("broken"))
