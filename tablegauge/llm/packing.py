"""Best-fit packing of documents into sequences by hierarchical residual packing.

Each partition packs its own pieces best-fit.  Bins that are nearly full are final; the others become items of the next
round, in which fewer partitions pack them again, until one round at the root has seen all that is left.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablegauge.functions.missing import quoted
from tablegauge.llm.shared import cut_lineage, new_folder
from tablegauge.llm.textarrays import Texts, chunks

# Punctuation that the word tokenizer never joins to a letter or digit before it.
_TAIL = b".,!?;:"
CACHE_WORDS = 1_500_000


@dataclass(frozen=True)
class Packing:
    """``capacity`` tokens a sequence; a bin is nearly full when at most ``slack`` tokens are free.

    A round merges the bins of up to ``fan_in`` partitions; a task packs at most ``batch`` items at a time, and there are
    as many tasks as the items left ask for, so that no task ever gets more than about ``batch`` of them.
    """

    capacity: int = 4096
    slack: int = 8
    fan_in: int = 8
    batch: int = 50_000


class WordTokenizer:
    """Token ids of texts under a tokenizer that never joins across blanks; each distinct word is tokenized once.

    Words, without case and with closing punctuation apart, are looked up in a bounded table kept by the worker.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.keys, self.at, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Add words; ``keys`` are sorted, distinct and not in the table yet."""
        if len(self.keys) + len(keys) > CACHE_WORDS and len(self.keys):
            self.keys, self.at, self.size, self.ids = self.keys[:0], self.at[:0], self.size[:0], self.ids[:0]
        lists = [e.ids for e in self.encoder.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for x in lists for i in x), np.uint32, int(size.sum()))
        where = np.searchsorted(self.keys, keys)
        self.at = np.insert(self.at, where, len(self.ids) + np.cumsum(size) - size)
        self.size = np.insert(self.size, where, size)
        self.keys = np.insert(self.keys, where, keys)
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, text: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of ids of each text."""
        lower = text.data.copy()
        capital = (lower >= 0x41) & (lower <= 0x5A)
        lower[capital] += 32
        text = Texts(lower, text.offsets)
        starts, ends, owner = text.words()
        # Where closing punctuation follows an ASCII letter or digit, it is a unit of its own.
        tail = np.isin(lower, np.frombuffer(_TAIL, np.uint8))
        plain = ((lower >= 0x30) & (lower <= 0x39)) | ((lower >= 0x61) & (lower <= 0x7A))
        other = np.flatnonzero(~tail)
        cut = other[np.searchsorted(other, ends) - 1] + 1 if len(other) else starts
        split = (cut > starts) & (cut < ends)
        split[split] = plain[cut[split] - 1]
        extra = np.flatnonzero(split)
        unit_starts = np.insert(starts, extra + 1, cut[extra])
        unit_ends = np.insert(ends, extra, cut[extra])
        unit_owner = np.insert(owner, extra, owner[extra])
        keys = text.hashes(unit_starts, unit_ends)
        distinct, one = np.unique(keys, return_index=True)
        place = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == distinct[inside]
        if not known.all():
            if len(self.keys) + int((~known).sum()) > CACHE_WORDS:
                known[:] = False
                self.keys, self.at, self.size, self.ids = self.keys[:0], self.at[:0], self.size[:0], self.ids[:0]
            raw, pick = lower.tobytes(), one[~known]
            self._learn(distinct[~known], [raw[s:e].decode() for s, e in zip(unit_starts[pick].tolist(), unit_ends[pick].tolist())])
        at = np.searchsorted(self.keys, keys)
        size, begin = self.size[at], self.at[at]
        total = np.cumsum(size)
        n = int(total[-1]) if len(total) else 0
        ids = self.ids[np.repeat(begin - (total - size), size) + np.arange(n)]
        return ids, np.bincount(unit_owner, weights=size, minlength=len(text)).astype(np.int64)


_tokenizers: dict[str, WordTokenizer] = {}


def _token_batches(text: Texts, path: str) -> Iterator[np.ndarray]:
    """The ids of each text.  A text that may hold a special token's name is given to the tokenizer whole."""
    tokenizer = _tokenizers.setdefault(path, None) or WordTokenizer(path)
    _tokenizers[path] = tokenizer
    ids, n = tokenizer.encode(text)
    stops = np.cumsum(n)
    raw = text.data.tobytes()
    special = b"<|" in raw
    for i in range(len(text)):
        body = raw[text.offsets[i]: text.offsets[i + 1]] if special else b""
        if b"<|" in body:
            yield np.array(tokenizer.encoder.encode(body.decode(), add_special_tokens=False).ids, np.uint32)
        else:
            yield ids[stops[i] - n[i]: stops[i]]


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        for part, text in chunks(batches, "body"):
            rows, numbers, starts, lengths, sums = [], [], [], [], []
            for i, ids in enumerate(_token_batches(text, path)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k in range(0, len(ids), capacity):
                    rows.append(i)
                    numbers.append(k // capacity)
                    starts.append(k)
                    lengths.append(min(capacity, len(ids) - k))
                    sums.append(zlib.crc32(ids[k: k + capacity].tobytes()))
            yield pa.record_batch({
                "id": part.column("id").take(pa.array(rows, pa.int64())), "piece": pa.array(numbers, pa.int32()),
                "start": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int64()),
                "ids_crc32": pa.array(sums, pa.int64())})

    return run


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices by bin: largest items first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = bisect_left(free, (sizes[i], -1))
        if k == len(free):
            bins.append([i])
            b, left = len(bins) - 1, capacity - sizes[i]
        else:
            left, b = free.pop(k)
            bins[b].append(i)
            left -= sizes[i]
        if left:
            insort(free, (left, b))
    return bins


def _pack(options: Packing):
    """Bins of items, an item being the bins' members so far; ``done`` marks nearly full bins."""

    def packed(table: pa.Table) -> pa.Table:
        sizes = table.column("used").to_pylist()
        bins = best_fit(sizes, options.capacity)
        members = table.column("members").combine_chunks()
        order = np.fromiter((i for b in bins for i in b), np.int64, len(sizes))
        inner = members.take(pa.array(order))
        n = inner.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.append(0, np.cumsum(n))
        ends = np.cumsum([len(b) for b in bins])
        offsets = np.append(0, bounds[ends]).astype(np.int32)
        used = [sum(sizes[i] for i in b) for b in bins]
        done = [options.capacity - u <= options.slack for u in used]
        return pa.table({"used": pa.array(used, pa.int64()), "done": pa.array(done),
                         "members": pa.ListArray.from_arrays(pa.array(offsets), inner.flatten())})

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= options.batch:
                yield from packed(pa.Table.from_batches(held)).to_batches()
                held, n = [], 0
        if n:
            yield from packed(pa.Table.from_batches(held)).to_batches()

    return run


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of each document: id, piece, start, length, ids_crc32."""
    docs = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("body"))
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(_pieces(tokenizer, capacity, end_id),
                           f"id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, options: Packing = Packing()) -> DataFrame:
    """Each piece with ``sequence_id`` and its ``offset`` in the sequence.

    Pieces need a positive ``length`` of at most the capacity; other columns are carried along.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    kind = pieces.select(F.struct(*map(quoted, names)).alias("x")).schema["x"].dataType.simpleString()
    schema = f"used long, done boolean, members array<{kind}>"
    items = pieces.select(F.col("length").cast("long").alias("used"), F.array(F.struct(*map(quoted, names))).alias("members"))
    folder, level = new_folder(spark, "packed"), 0
    n, before = max(1, items.rdd.getNumPartitions()), None
    while True:
        path = f"{folder}/level-{level}"
        items.mapInArrow(_pack(options), schema).write.parquet(path)
        open_bins = spark.read.schema(schema).parquet(path).filter("not done")
        left = open_bins.count()
        # The root has seen them all, or a round has merged next to nothing: no later one would.
        if left == 0 or (level and (n == 1 or left > 0.99 * before)):
            break
        n, level, before = min(n, max(1, n // options.fan_in, -(-left // options.batch))), level + 1, left
        items = open_bins.select("used", "members").repartition(n)
    read = lambda k: spark.read.schema(schema).parquet(f"{folder}/level-{k}")
    whole = read(level)
    for k in range(level):
        whole = whole.unionAll(read(k).filter("done"))
    numbered = whole.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    placed = numbered.select("sequence_id", F.expr("""transform(members, (m, i) -> named_struct('m', m, 'offset',
        aggregate(slice(members, 1, i), 0L, (a, x) -> a + x.length)))""").alias("members"))
    return placed.select("sequence_id", F.explode("members").alias("x")).select(
        *[F.col("x.m")[c].alias(c) for c in names], "sequence_id", F.col("x.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   options: Packing = Packing(), end_id: int = 1) -> DataFrame:
    """Every document's tokens, with ``end_id`` behind them, in sequences of at most ``options.capacity`` tokens.

    Only longer documents are cut.  A null text is an empty one (one token).  Null and repeated ids and repeated rows
    are packed as documents of their own; other columns are ignored.  An empty table gives an empty result.
    """
    pieces = cut_lineage(token_pieces(docs, tokenizer, id_col, text_col, options.capacity, end_id))
    return pack(pieces, options).withColumnRenamed("id", id_col)
