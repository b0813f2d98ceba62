"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are split into bands of similar norm.  The longest ones are compared with every query.  In the other bands their
directions are turned by fast Hadamard pseudo-rotations and hashed to the nearest signed axis; each table has a rotation
of its own.  Queries probe band and axis in the order of the band's longest norm times their own coordinate on the axis;
what they find is ranked again by the exact inner product of the original vectors.  A query that finds too few that way
is compared with all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablegauge.functions.missing import quoted
from tablegauge.llm.nearjoin import _groups
from tablegauge.llm.shared import cut_lineage


@dataclass(frozen=True)
class Index:
    """``tables`` rotations; a query looks at ``probes`` of the 2 * dimensions axes of each, or, where there are several
    bands, at as many buckets as hold that share of the rows.

    Norms in a band differ by at most ``ratio``.  The longest bands are looked at whole as long as they hold no more than
    ``head`` of the rows; at most ``bands`` others are told apart, the last one takes all shorter vectors.  The recall that a choice reaches is measured by the tests.  A bucket is dealt out in blocks of about ``block``
    vectors, so that a bucket of any size is split; ``query_block`` bounds the queries compared with it at a time.
    """

    tables: int = 6
    probes: int = 24
    k: int = 20
    rounds: int = 3
    block: int = 4096
    query_block: int = 512
    seed: int = 17
    ratio: float = 1.5
    head: float = 0.25
    bands: int = 16


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n = x.shape[1]
    h = 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotations(x: np.ndarray, index: Index) -> np.ndarray:
    """Pseudo-rotated rows for each table: random signs and a Hadamard transform, a few times over."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    rng = np.random.default_rng(index.seed)
    out = np.empty((index.tables, len(x), width))
    for table in range(index.tables):
        y = np.zeros((len(x), width))
        y[:, : x.shape[1]] = x
        for _ in range(index.rounds):
            y = _hadamard(y * rng.choice([-1.0, 1.0], width))
        out[table] = y
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def _directions(column: pa.Array) -> np.ndarray:
    x = _matrix(column)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _alike(batch: pa.RecordBatch, keys: np.ndarray, most) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each key, at most ``most(key)`` at a time."""
    for key in np.unique(keys).tolist():
        at = np.flatnonzero(keys == key)
        for first in range(0, len(at), most(key)):
            yield key, batch.take(pa.array(at[first: first + most(key)]))


def _rows(batch: pa.RecordBatch, table: int, at: np.ndarray, part: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows ``at`` of a batch with the bucket they go to, in portions of bounded size."""
    most = max(256, (1 << 20) // len(batch.column("v")[0]))
    for first in range(0, len(at), most):
        take = pa.array(at[first: first + most])
        yield pa.record_batch({
            "table": pa.array(np.full(len(take), table, np.int32)),
            "part": pa.array(part[first: first + most].astype(np.int32)),
            "bucket": pa.array(bucket[first: first + most].astype(np.int32)),
            "id": batch.column("id").take(take), "v": batch.column("v").take(take)})


@dataclass(frozen=True)
class _Part:
    """The vectors of one length in one band; those of a ``whole`` part are not hashed."""

    length: int
    whole: bool
    rows: int
    longest: float


def _stored(index: Index, parts: list[_Part]):
    """Rows table, part, bucket, id, v: one bucket a table, or one in all for a part that is looked at whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in _alike(batch, np.asarray(batch.column("part")), lambda _: 2048):
                every, same = np.arange(rows.num_rows), np.full(rows.num_rows, part)
                if parts[part].whole:
                    yield from _rows(rows, 0, every, same, np.zeros(rows.num_rows))
                    continue
                for table, turned in enumerate(rotations(_directions(rows.column("v")), index)):
                    yield from _rows(rows, table, every, same, np.argmax(np.hstack([turned, -turned]), axis=1))

    return run


def _asked(index: Index, parts: list[_Part], filled: dict[tuple[int, int], list[int]], everything: bool):
    """Rows table, part, bucket, id, v: the buckets with rows that a query looks at.

    ``filled`` has the buckets with rows of each table and part.  ``everything`` asks for all of one table, so that
    every row is met once.
    """
    by_length: dict[int, list[int]] = {}
    for i, part in enumerate(parts):
        by_length.setdefault(part.length, []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Bounds what is sorted at a time.
        most = lambda n: max(1, min(2048, (1 << 20) // (len(by_length[n]) * 4 * n)))
        for batch in batches:
            for length, rows in _alike(batch, np.asarray(batch.column("v").value_lengths()), most):
                every = np.arange(rows.num_rows)
                hashed = [i for i in by_length[length] if not parts[i].whole]
                for i in by_length[length]:
                    if parts[i].whole or everything:
                        for bucket in filled.get((0, i), ()):
                            yield from _rows(rows, 0, every, np.full(len(every), i), np.full(len(every), bucket))
                if everything or not hashed:
                    continue
                count = np.array([parts[i].rows for i in hashed], np.float64)
                longest = np.array([parts[i].longest for i in hashed])
                for table, turned in enumerate(rotations(_directions(rows.column("v")), index)):
                    both = np.hstack([turned, -turned])
                    axes = both.shape[1]
                    full = np.zeros((len(hashed), axes), bool)
                    for k, i in enumerate(hashed):
                        full[k, filled.get((table, i), [])] = True
                    reach = (both[:, None, :] * (longest / longest.max())[None, :, None]).reshape(len(both), -1)
                    order = np.argsort(-reach, axis=1, kind="stable")
                    cost = np.cumsum(count[order // axes], axis=1) - count[order // axes]
                    at, where = np.nonzero((cost < index.probes * count.sum()) & full.ravel()[order])
                    chosen = order[at, where]
                    yield from _rows(rows, table, at, np.array(hashed)[chosen // axes], chosen % axes)

    return run


def best(query: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int):
    """Positions and exact scores of the k best rows of x for each query, never its own id; ties to the smaller id.

    A matrix product finds who may be among them; their scores are then summed in one order, so that equal vectors
    get equal scores wherever they stand.
    """
    rough = query @ x.T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    slack = 1e-9 * (1 + np.abs(x).sum(axis=1).max(initial=0) * np.abs(query).max(initial=0))
    out = []
    for i in range(len(query)):
        least = np.partition(rough[i], -k)[-k] - slack if rough.shape[1] > k else -np.inf
        at = np.flatnonzero((rough[i] >= least) & (rough[i] > -np.inf))
        score = (x[at] * query[i]).sum(axis=1)
        order = np.lexsort((ids[at], -score))[:k]
        out.append((at[order], score[order]))
    return out


def _search(index: Index):
    """One block of a bucket at a time: its candidates, then the queries that probe it in bounded portions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        held: list[pa.RecordBatch] = []
        x = ids = None
        for batch in batches:
            for part in _portions(batch, index.query_block):
                key = tuple(part.column(c)[0].as_py() for c in ("table", "part", "bucket", "block"))
                if key != now:
                    now, held, x = key, [], None
                if not part.column("is_query")[0].as_py():
                    held.append(part)
                    x = None
                    continue
                if not held:
                    continue
                if x is None:
                    table = pa.Table.from_batches(held)
                    x = _matrix(table.column("v").combine_chunks())
                    ids = table.column("id").to_numpy()
                own = part.column("id").to_numpy()
                found = best(_matrix(part.column("v")), own, x, ids, index.k)
                keep = [i for i, (at, _) in enumerate(found) if len(at)]
                yield pa.record_batch({
                    "query_id": pa.array(own[keep]),
                    "found": pa.array([ids[found[i][0]].tolist() for i in keep], pa.list_(pa.int64())),
                    "scores": pa.array([found[i][1].tolist() for i in keep], pa.list_(pa.float64()))})

    return run


def _portions(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of one block and one side, of at most ``most`` rows."""
    if not batch.num_rows:
        return
    keys = [np.asarray(batch.column(c)) if c != "is_query" else np.array(batch.column(c).to_pylist())
            for c in ("table", "part", "bucket", "block", "is_query")]
    change = np.zeros(batch.num_rows, bool)
    for c in keys:
        change[1:] |= c[1:] != c[:-1]
    cuts = np.append(np.flatnonzero(change), batch.num_rows)
    first = 0
    for stop in cuts:
        for at in range(first, stop, most):
            yield batch.slice(at, min(most, stop - at))
        first = stop


def _merge(k: int):
    """The best of each query, from lists sorted by query: what is held are the lists of one query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ("query_id",)):
            ids = np.concatenate([np.asarray(x.flatten()) for x in group.column("found").chunks])
            score = np.concatenate([np.asarray(x.flatten()) for x in group.column("scores").chunks])
            ids, at = np.unique(ids, return_index=True)
            score = score[at]
            order = np.lexsort((ids, -score))[:k]
            yield pa.record_batch({
                "query_id": pa.array(np.full(len(order), group.column("query_id")[0].as_py())),
                "rank": pa.array(np.arange(1, len(order) + 1, dtype=np.int32)),
                "id": pa.array(ids[order]), "score": pa.array(score[order])})

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v`` of the rows that take part: an id, and a vector of finite components that are not all zero."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    v = quoted(vector_col).cast(kind if kind == "array<float>" else "array<double>")
    rows = vectors.select(quoted(id_col).cast("long").alias("id"), v.alias("v"))
    finite = ("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) "
              "and exists(v, x -> x != 0)")
    return rows.filter(F.col("id").isNotNull() & F.expr(finite))


def _parts(bands: list, index: Index) -> tuple[list[_Part], list[tuple[int, int, int]]]:
    """Parts from the rows and longest norm of each length and band, and which part each length and band belongs to."""
    parts, places = [], []
    for length in sorted({r["n"] for r in bands}):
        rest = sorted((r for r in bands if r["n"] == length), key=lambda r: r["band"])
        total, seen, head = sum(r["rows"] for r in rest), 0, 0
        while head < len(rest) and seen + rest[head]["rows"] <= index.head * total:
            seen += rest[head]["rows"]
            head += 1
        single = head + index.bands - 1
        groups = [rest[:head], *([r] for r in rest[head:single]), rest[single:]]
        for g in filter(None, groups):
            places += [(length, r["band"], len(parts)) for r in g]
            parts.append(_Part(length, g is groups[0], sum(r["rows"] for r in g), max(r["longest"] for r in g)))
    return parts, places


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding",
            index: Index = Index()) -> DataFrame:
    """``query_id``, ``rank`` (from 1), the neighbour's id and ``score`` (inner product) for each query row.

    ``is_query`` is a condition on ``id``.  Candidates are all rows but the query's own id; ties go to the smaller id.
    Rows without id, and vectors that are null, empty, zero or not finite take no part.  Rows with equal ids are one
    vector if they agree, or else each stands for the id.  Vectors are compared with those of their own length.
    A query has k rows, or all candidates where there are fewer.
    """
    spark = vectors.sparkSession
    norm = F.expr("least(greatest(sqrt(aggregate(v, 0D, (a, x) -> a + double(x) * double(x))), 1e-300D), 1e300D)")
    rows = usable(vectors, id_col, vector_col).select("id", "v", F.size("v").alias("n"))
    measured = rows.withColumn("norm", norm)
    # One line a length of vectors, then one a length and band.
    longest = F.broadcast(cut_lineage(measured.groupBy("n").agg(F.max("norm").alias("longest"))))
    banded = measured.join(longest, "n").withColumn(
        "band", F.expr(f"cast(floor(ln(longest / norm) / ln({index.ratio}D)) as int)"))
    bands = banded.groupBy("n", "band").agg(F.count("*").alias("rows"), F.max("norm").alias("longest")).collect()
    schema = "query_id long, rank int, id long, score double"
    if not bands:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    parts, places = _parts(bands, index)
    placed = banded.join(F.broadcast(spark.createDataFrame(places, "n int, band int, part int")), ["n", "band"])
    shape = f"table int, part int, bucket int, id long, v {rows.schema['v'].dataType.simpleString()}"
    stored = lambda ix: placed.select("id", "v", "part").mapInArrow(_stored(ix, parts), shape)
    key = ["table", "part", "bucket"]
    sizes = cut_lineage(stored(index).groupBy(key).agg(F.count("*").alias("n")).select(
        *key, F.expr(f"cast(ceil(n / {index.block}) as int)").alias("blocks")))
    # One line a table, part and axis: a fixed number for each length, whatever the data.
    filled: dict[tuple[int, int], list[int]] = {}
    for r in sizes.collect():
        filled.setdefault((r["table"], r["part"]), []).append(r["bucket"])
    sizes = F.broadcast(sizes)

    def search(queries: DataFrame, ix: Index, everything: bool) -> DataFrame:
        held = stored(ix).join(sizes, key).select(
            *key, F.expr("cast(pmod(xxhash64(id), blocks) as int)").alias("block"), F.lit(False).alias("is_query"), "id", "v")
        asked = queries.select("id", "v").mapInArrow(_asked(ix, parts, filled, everything), shape).join(sizes, key).select(
            *key, F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(True).alias("is_query"), "id", "v")
        both = held.unionAll(asked).repartition(*key, "block").sortWithinPartitions(*key, "block", "is_query")
        found = both.mapInArrow(_search(ix), "query_id long, found array<long>, scores array<double>")
        return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merge(ix.k), schema)

    queries = rows.filter(is_query)
    found = cut_lineage(search(queries, index, False))
    served = found.groupBy("query_id").count().filter(F.col("count") >= index.k).select(F.col("query_id").alias("id"))
    few = cut_lineage(queries.join(served, "id", "left_anti"))
    if not few.isEmpty():
        # All rows are met in the first table.
        short = few.select(F.col("id").alias("query_id")).distinct()
        found = found.join(short, "query_id", "left_anti").unionAll(search(few, replace(index, tables=1), True))
    return found.withColumnRenamed("id", id_col)
