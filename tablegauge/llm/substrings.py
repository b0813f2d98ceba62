"""Removal of repeated word windows with a count-min prefilter.

First pass: each partition counts the anchors of its windows in a count-min sketch, and the sketches are merged.  The
anchor of a window is the smallest hash among its 8-word grams, so equal windows have equal anchors and the count of an
anchor never falls short of the count of a window that has it.  Second pass: only windows whose anchor is estimated to
occur again are grouped, by 128-bit hashes of all their words, and every occurrence but the first is removed.  A sketch
that is too small for its input lets more windows through, but loses none.

Before the shuffle a task keeps the first of its own occurrences of a window only: the others are repeated for certain
and travel as runs.  So a window that a third of all documents hold comes once from each task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tablegauge.functions.missing import quoted
from tablegauge.llm.textarrays import Texts, chunks, grams, mixed

_CELL_BITS = 20
_FLUSH = 4_000_000
_ROWS = 50_000


@dataclass(frozen=True)
class Sketch:
    """``rows`` hash functions; the width of a row is a power of two between the limits, about 8 cells an anchor.

    One bit a cell is sent to the executors, so the broadcast is at most rows * 2**max_bits / 8 bytes (32 MB).
    """

    rows: int = 2
    min_bits: int = 20
    max_bits: int = 27


def _anchors(text: Texts, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each window: anchor hash, anchor position, first word; then the hashes and owners of all words."""
    starts, ends, owner = text.words()
    words = text.hashes(starts, ends)
    n = len(words)
    if n < window:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, words, owner
    g, base = np.empty(n - gram + 1, np.uint64), np.uint64(0x9E3779B97F4A7C15)
    g[:] = words[: n - gram + 1]
    for j in range(1, gram):
        g = g * base + words[j: n - gram + 1 + j]
    g = mixed(g)
    # The leftmost place of the smallest value: the place stands in the low bits while minima are taken.
    low = np.uint64(max(1, int(n).bit_length()))
    best = ((g >> low) << low) | np.arange(len(g), dtype=np.uint64)
    width, done = window - gram + 1, 1
    while done < width:
        step = min(done, width - done)
        best = np.minimum(best[:-step], best[step:])
        done += step
    at = np.flatnonzero(owner[: n - window + 1] == owner[window - 1:])
    place = (best[at] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    return g[place], place, at, words, owner


def _cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mixed(anchors, 101 + row) >> np.uint64(64 - bits)).astype(np.int64)


def _partial_sketches(bits: int, rows: int, window: int, gram: int):
    def flush(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        anchors = np.concatenate(found)
        for row in range(rows):
            cells, n = np.unique(_cells(anchors, row, bits), return_counts=True)
            value = ((cells & ((1 << _CELL_BITS) - 1)) | ((n > 1).astype(np.int64) << 31)).astype(np.uint32)
            block = cells >> _CELL_BITS
            cut = np.flatnonzero(np.diff(block, prepend=-1))
            parts = [p.tobytes() for p in np.split(value, cut[1:])] if len(cut) else []
            yield pa.record_batch({"row": pa.array([row] * len(cut), pa.int32()),
                                   "block": pa.array(block[cut], pa.int32()), "cells": pa.array(parts, pa.binary())})

    def run(batches):
        found, size = [], 0
        for _, text in chunks(batches, "body"):
            anchors, place, *_ = _anchors(text, window, gram)
            # Neighbouring windows share an anchor: it is counted once for each place where it stands.
            found.append(anchors[np.flatnonzero(np.diff(place, prepend=-1))])
            size += len(found[-1])
            if size > _FLUSH:
                yield from flush(found)
                found, size = [], 0
        if size:
            yield from flush(found)

    return run


def _merge_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block; one block of counters (0, 1, more) is held at a time."""
    now, counts = None, np.zeros(1 << _CELL_BITS, np.uint8)

    def bits():
        return pa.record_batch({"row": pa.array([now[0]], pa.int32()), "block": pa.array([now[1]], pa.int32()),
                                "repeated": pa.array([np.packbits(counts > 1).tobytes()], pa.binary())})

    for batch in batches:
        for row, block, cells in zip(*(batch.column(c).to_pylist() for c in ("row", "block", "cells"))):
            if now != (row, block):
                if now is not None:
                    yield bits()
                now = (row, block)
                counts[:] = 0
            value = np.frombuffer(cells, np.uint32)
            cell = value & np.uint32((1 << _CELL_BITS) - 1)
            counts[cell] = np.minimum(counts[cell] + 1 + (value >> np.uint32(31)).astype(np.uint8), 2)
    if now is not None:
        yield bits()


def _repeated_windows(sketch, bits: int, rows: int, window: int, gram: int):
    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """First occurrences one by one, and runs of the others; ids of several chunks in the order of the table."""
        h1, h2, at = (np.concatenate([x[i] for x in held]) for i in range(3))
        ids, ties = pa.concat_arrays([x[3] for x in held]), np.concatenate([x[4] for x in held])
        shift = np.cumsum([0] + [len(x[3]) for x in held[:-1]])
        text = np.concatenate([x[5] + n for x, n in zip(held, shift)])
        # Texts in the order of the result: by id, nulls last, then by the hash.
        by_id = np.asarray(pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense"))
        order = np.lexsort((ties, by_id))
        step = np.ones(len(ids), np.int64)
        step[1:] = (by_id[order][1:] != by_id[order][:-1]) | (ties[order][1:] != ties[order][:-1])
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.cumsum(step)
        order = np.lexsort((at, rank[text], h2, h1))
        h1, h2, at, text = h1[order], h2[order], at[order], text[order]
        new = np.ones(len(at), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        # In the order of the texts, neighbouring rows share their id, which compresses well.
        kept = np.flatnonzero(new)
        kept = kept[np.lexsort((at[kept], text[kept]))]
        for i in range(0, len(kept), _ROWS):
            part = kept[i: i + _ROWS]
            yield rows_of(h1[part], h2[part], ids, ties, text[part], at[part], np.zeros(len(part), np.int32))
        # A repeated row is the same place once more.
        first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        other = (at != at[first]) | (rank[text] != rank[text[first]])
        text, at = text[other], at[other]
        if len(at):
            order = np.lexsort((at, text))
            text, at = text[order], at[order]
            cut = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(at, prepend=-2) > 1))
            length = np.diff(np.append(cut, len(at))).astype(np.int32)
            key = mixed(at[cut].astype(np.uint64) ^ ties[text[cut]].view(np.uint64)).view(np.int64)
            yield rows_of(key, key, ids, ties, text[cut], at[cut], length)

    def rows_of(h1, h2, ids, ties, text, at, length):
        return pa.record_batch({
            "h1": pa.array(h1), "h2": pa.array(h2), "id": ids.take(pa.array(text)), "tie": pa.array(ties[text]),
            "start": pa.array(at.astype(np.int32)), "run": pa.array(length)})

    def run(batches):
        held, size = [], 0
        for part, text in chunks(batches, "body"):
            anchors, _, at, words, owner = _anchors(text, window, gram)
            maybe = np.ones(len(anchors), bool)
            for row in range(rows):
                cell = _cells(anchors, row, bits)
                maybe &= ((sketch.value[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1).astype(bool)
            if not maybe.any():
                continue
            begins = np.searchsorted(owner, np.arange(len(text)))
            h1, h2 = (grams(words, owner, window, seed)[0][maybe].view(np.int64) for seed in (1, 2))
            at = at[maybe]
            used, of = np.unique(owner[at], return_inverse=True)
            picked = pa.array(used)
            held.append((h1, h2, at - begins[owner[at]], part.column("id").take(picked),
                         np.asarray(part.column("tie").take(picked)), of))
            size += len(at)
            if size > _FLUSH // 4:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by window and place: all but the first of each window, and the runs that are repeated for certain."""
    last, first = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, tie, start, run = (np.asarray(batch.column(c)) for c in ("h1", "h2", "tie", "start", "run"))
        new = np.ones(len(h1), bool)
        new[0] = last != (h1[0], h2[0])
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        # The place of each window's first row, which may lie in an earlier batch.
        at = np.maximum.accumulate(np.where(new, np.arange(len(h1)), -1))
        first_tie, first_start = tie[at], start[at]
        if not new[0]:
            first_tie[at < 0], first_start[at < 0] = first
        later = ~new & ((tie != first_tie) | (start != first_start))
        last, first = (h1[-1], h2[-1]), (first_tie[-1], first_start[-1])
        yield batch.filter(pa.array(later | (run > 0))).select(["id", "tie", "start", "run"])


def _strip(window: int):
    def run(batches):
        for part, text in chunks(batches, "body"):
            starts, ends, owner = text.words()
            n_words = np.bincount(owner, minlength=len(text))
            begins = np.cumsum(n_words) - n_words
            lists = part.column("runs")
            of = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            inner = lists.flatten()
            first = np.repeat(begins, of) + np.asarray(inner.field("start")).astype(np.int64)
            covered = np.maximum(np.asarray(inner.field("run")), 1) - 1 + window
            edge = np.zeros(len(starts) + 1, np.int64)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + covered, -1)
            kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
            n_kept = np.bincount(owner[kept], minlength=len(text))
            # Each kept word with the blank behind it, without that blank for the last one of a text.
            data = np.append(text.data, np.uint8(0x20))
            stop = ends[kept] + 1
            last = np.flatnonzero(np.diff(owner[kept], append=-1))
            stop[last] -= 1
            edge = np.zeros(len(data) + 1, np.int32)
            edge[starts[kept]] += 1
            edge[stop] -= 1
            inside = np.cumsum(edge[:-1]) > 0
            data[np.delete(ends[kept], last)] = 0x20
            size = np.bincount(owner[kept], weights=stop - starts[kept], minlength=len(text)).astype(np.int64)
            offsets = np.append(0, np.cumsum(size)).astype(np.int64)
            body = pa.LargeStringArray.from_buffers(
                len(text), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[inside].tobytes()))
            yield pa.record_batch({"id": part.column("id"), "n_words": pa.array(n_words, pa.int64()),
                                   "n_removed": pa.array(n_words - n_kept, pa.int64()),
                                   "kept": body.cast(pa.string())})

    return run


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
                            sketch: Sketch = Sketch(), gram: int = 8) -> DataFrame:
    """The id, ``n_words``, ``n_removed`` and ``kept`` (the remaining words, joined by one space) of each row.

    A word is removed if a window of ``window`` words that covers it also starts earlier: in a smaller id, or before it
    in the same text.  Null and empty texts have no words.  Null ids come after all others.  Rows equal in id and text
    are one document and all get its result; different texts under one id follow each other in the order of a hash.
    Only the two columns are read, so other columns may have any name.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    body = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    docs = docs.select(quoted(id_col).alias("id"), F.xxhash64(quoted(id_col), body).alias("tie"), body.alias("body"))
    kind = docs.schema["id"].dataType.simpleString()
    gram = min(gram, window)

    size = docs.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    # About a sixth of the bytes are words, and one word in (window - gram + 2) / 2 is an anchor.
    anchors = max(1, size // 6 * 2 // (window - gram + 2))
    bits = min(max(sketch.min_bits, (8 * anchors - 1).bit_length()), sketch.max_bits)
    merged = (
        docs.select("body").mapInArrow(_partial_sketches(bits, sketch.rows, window, gram),
                                       "row int, block int, cells binary")
        .repartition("row", "block").sortWithinPartitions("row", "block")
        .mapInArrow(_merge_sketches, "row int, block int, repeated binary")
    )
    repeated = np.zeros((sketch.rows, 1 << (bits - 3)), np.uint8)
    step = 1 << (_CELL_BITS - 3)
    for row in merged.toLocalIterator():
        repeated[row["row"], row["block"] * step: (row["block"] + 1) * step] = np.frombuffer(row["repeated"], np.uint8)
    shared = spark.sparkContext.broadcast(repeated)

    place = f"id {kind}, tie long, start int, run int"
    found = docs.mapInArrow(_repeated_windows(shared, bits, sketch.rows, window, gram), f"h1 long, h2 long, {place}")
    again = (
        found.repartition("h1", "h2").sortWithinPartitions("h1", "h2", F.asc_nulls_last("id"), "tie", "start")
        .mapInArrow(_later, place)
        .groupBy("tie", F.col("id").alias("of")).agg(F.collect_list(F.struct("start", "run")).alias("runs"))
    )
    both = docs.join(again, (docs["tie"] == again["tie"]) & docs["id"].eqNullSafe(again["of"]), "left")
    return both.select(docs["id"], "body", "runs").mapInArrow(
        _strip(window), f"id {kind}, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)
