"""Hard negatives for anchors, by a secondary-sort shuffle.

Every row is scored against every anchor (the inner product of its components as integers, ``floor(256 * x)``) in
blocks of anchors and rows.  The scored pairs are dealt out by anchor and sorted within their partitions by the packed
key (anchor, descending score, id), the way ``repartitionAndSortWithinPartitions`` sorts.  One iterator then walks each
partition once: the first rows of the anchor's label open positive windows, and rows of other labels whose score falls
into an open window are emitted as its negatives, until the window is full.  An anchor's rows are never gathered.

Before the shuffle each block keeps only what can still be returned: the first positives of every anchor in the block
(a first pass), and for each window that those positives open, its first negatives in the block (the second pass).
The global first rows are among the first rows of some block, so the iterator sees every row it returns.

Defined cases:

* A row takes no part if its id or label is null, its vector is null or empty, or a component is null, not finite,
  or so large that ``|floor(256 x)|`` reaches ``2**26`` (scores would no longer fit a long).  An empty table gives no
  rows; so does one without anchors.
* Rows that are equal in id, label and vector count once.  Rows sharing an id with the anchor are never its partners.
* Ties of score go to the smaller id.  A positive with a score below 0 opens no window, one with 0 the window [0, 0].
* Vectors of another length than the anchor's are not compared with it.
* Extra columns of the input are ignored; their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablegauge.functions.missing import quoted
from tablegauge.llm.shared import cut_lineage


@dataclass(frozen=True)
class Mining:
    """Production parameters: anchors are rows whose id is divisible by ``anchor_every``; an anchor has at most
    ``positives`` positives, each at most ``negatives`` negatives with ``low * p <= 100 * n <= high * p`` for positive
    score p and negative score n.  Rows whose id is divisible by ``shift_every`` have their label moved by one (of
    ``labels``) first.  Blocks hold about ``rows_per_block`` rows and ``anchors_per_block`` anchors."""

    anchor_every: int = 100
    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    shift_every: int = 7
    labels: int = 10
    scale: int = 256
    rows_per_block: int = 8192
    anchors_per_block: int = 1024


LIMIT = 2 ** 26

RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
PAIR = "anchor_id long, vec_id long, label int, score long"


def prepared(vectors: DataFrame, options: Mining = Mining(), id_col: str = "vec_id", vector_col: str = "embedding",
             label_col: str = "label") -> DataFrame:
    """``vec_id``, ``label`` (shifted) and ``q`` (components as integers) of the rows that take part."""
    v = quoted(vector_col).cast("array<double>")
    rows = vectors.select(quoted(id_col).cast("long").alias("vec_id"), quoted(label_col).cast("long").alias("label"),
                          v.alias("v"))
    usable = (f"vec_id is not null and label is not null and size(v) > 0 and forall(v, x -> x is not null and "
              f"not isnan(x) and abs(floor({options.scale} * x)) < {LIMIT})")
    shifted = F.when(F.col("vec_id") % options.shift_every == 0,
                     F.pmod(F.col("label") + 1, F.lit(options.labels))).otherwise(F.col("label"))
    return (rows.filter(F.expr(usable)).dropDuplicates(["vec_id", "label", "v"])
            .select("vec_id", shifted.cast("int").alias("label"),
                    F.expr(f"transform(v, x -> cast(floor({options.scale} * x) as long))").alias("q")))


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products; doubles where every product sum stays below 2**53."""
    top = max(int(np.abs(anchors).max(initial=0)), int(np.abs(rows).max(initial=0)))
    if top * top * max(1, anchors.shape[1]) < 2 ** 53:
        return np.rint(anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return anchors @ rows.T


def _matrix(column: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Positions and stacked vectors of each length."""
    lengths = column.map(len).to_numpy()
    out = {}
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        out[int(n)] = (at, np.stack(column.iloc[at].to_numpy()).astype(np.int64).reshape(len(at), int(n)))
    return out


def _first(order_score: np.ndarray, ids: np.ndarray, mask: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` rows under ``mask``, higher scores first and ties by smaller id."""
    at = np.flatnonzero(mask)
    if len(at) > k:
        cut = np.argpartition(-order_score[at], k - 1)[:k]
        edge = order_score[at][cut].min()
        at = at[order_score[at] >= edge]
    order = np.lexsort((ids[at], -order_score[at]))
    return at[order][:k]


def _block_pass(options: Mining, windows: bool):
    """Scores one block of anchors against one block of rows and keeps what may still be returned."""

    def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(anchors):
            by_length = _matrix(rows["q"])
            for n, (a_at, a_q) in _matrix(anchors["aq"]).items():
                if n not in by_length:
                    continue
                r_at, r_q = by_length[n]
                ids, labels = rows["vec_id"].to_numpy()[r_at], rows["label"].to_numpy()[r_at]
                scores = _scores(a_q, r_q)
                for i, a in enumerate(a_at):
                    anchor, label = int(anchors["anchor_id"].iat[a]), int(anchors["anchor_label"].iat[a])
                    s = scores[i]
                    other = ids != anchor
                    keep = [_first(s, ids, other & (labels == label), options.positives)]
                    if windows:
                        different = other & (labels != label)
                        for p in anchors["windows"].iat[a]:
                            inside = different & (options.low * p <= 100 * s) & (100 * s <= options.high * p)
                            keep.append(_first(s, ids, inside, options.negatives))
                    at = np.unique(np.concatenate(keep))
                    out.append(pd.DataFrame({"anchor_id": anchor, "vec_id": ids[at], "label": labels[at],
                                             "score": s[at]}))
        if not out:
            return pd.DataFrame({"anchor_id": pd.Series([], "int64"), "vec_id": pd.Series([], "int64"),
                                 "label": pd.Series([], "int32"), "score": pd.Series([], "int64")})
        found = pd.concat(out, ignore_index=True)
        return found.astype({"anchor_id": "int64", "vec_id": "int64", "label": "int32", "score": "int64"})

    return run


def _blocked(rows: DataFrame, anchors: DataFrame, options: Mining, windows: bool) -> DataFrame:
    """Pairs of anchors and rows, scored in blocks; each block keeps its first positives (and negatives)."""
    n_rows, n_anchors = rows.count(), anchors.count()
    r_blocks = max(1, -(-n_rows // options.rows_per_block))
    a_blocks = max(1, -(-n_anchors // options.anchors_per_block))
    rows_x = rows.select(F.explode(F.sequence(F.lit(0), F.lit(a_blocks - 1))).alias("ab"),
                         F.expr(f"cast(pmod(xxhash64(vec_id), {r_blocks}) as int)").alias("rb"), "vec_id", "label", "q")
    extra = ["windows"] if windows else []
    anchors_x = anchors.select(F.expr(f"cast(pmod(xxhash64(anchor_id), {a_blocks}) as int)").alias("ab"),
                               F.explode(F.sequence(F.lit(0), F.lit(r_blocks - 1))).alias("rb"), "anchor_id",
                               "anchor_label", "aq", *extra)
    return (rows_x.groupBy("ab", "rb").cogroup(anchors_x.groupBy("ab", "rb"))
            .applyInPandas(_block_pass(options, windows), PAIR))


def _walk(options: Mining):
    """The streaming iterator over partitions sorted by (anchor, descending score, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = label = None
        opened: list[list[int]] = []  # positive id, score, emitted
        n_pos, zeros = 0, []
        out = {name: [] for name in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                                     "negative_score")}

        def emit(window, vec_id, score):
            window[2] += 1
            for name, value in zip(out, (anchor, window[0], window[2], vec_id, window[1], score)):
                out[name].append(value)

        for batch in batches:
            columns = batch.to_pydict()
            for a, vec_id, row_label, score, a_label in zip(columns["anchor_id"], columns["vec_id"], columns["label"],
                                                            columns["score"], columns["anchor_label"]):
                if a != anchor:
                    anchor, label, opened, n_pos, zeros = a, a_label, [], 0, []
                if row_label == label:
                    if n_pos < options.positives:
                        n_pos += 1
                        if score >= 0:
                            window = [vec_id, score, 0]
                            opened.append(window)
                            if score == 0:
                                for z in zeros[:options.negatives]:
                                    emit(window, z, 0)
                    continue
                for window in opened:
                    p = window[1]
                    if window[2] < options.negatives and options.low * p <= 100 * score <= options.high * p:
                        emit(window, vec_id, score)
                if score == 0 and len(zeros) < options.negatives:
                    zeros.append(vec_id)
            if len(out["anchor_id"]) >= 65536:
                yield pa.RecordBatch.from_pydict(out, schema=_RESULT_SCHEMA)
                out = {name: [] for name in out}
        yield pa.RecordBatch.from_pydict(out, schema=_RESULT_SCHEMA)

    return run


_RESULT_SCHEMA = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()),
                            ("negative_id", pa.int64()), ("positive_score", pa.int64()),
                            ("negative_score", pa.int64())])


def mine(vectors: DataFrame, options: Mining = Mining(), id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label") -> DataFrame:
    """For each anchor and each of its positives, the first negatives in the positive's window (see the module)."""
    rows = cut_lineage(prepared(vectors, options, id_col, vector_col, label_col))
    anchors = rows.filter(F.col("vec_id") % options.anchor_every == 0).select(
        F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("q").alias("aq"))
    # First pass: the positives, so that every block knows the windows they open.
    first = _blocked(rows, anchors, options, windows=False).join(anchors.select("anchor_id", "anchor_label"),
                                                                "anchor_id")
    order = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "vec_id")
    positives = cut_lineage(first.filter(F.col("label") == F.col("anchor_label"))
                            .withColumn("place", F.row_number().over(order))
                            .filter(F.col("place") <= options.positives).drop("place", "anchor_label"))
    windows = positives.groupBy("anchor_id").agg(F.collect_list("score").alias("windows"))
    with_windows = anchors.join(windows, "anchor_id", "left").select(
        "anchor_id", "anchor_label", "aq", F.coalesce("windows", F.array().cast("array<long>")).alias("windows"))
    # Second pass: the first negatives of each window in each block.
    candidates = _blocked(rows, with_windows, options, windows=True)
    pairs = (candidates.unionByName(positives).dropDuplicates(["anchor_id", "vec_id"])
             .join(anchors.select("anchor_id", "anchor_label"), "anchor_id"))
    # The secondary sort: dealt by anchor, sorted by (anchor, descending score, id) within each partition.
    sorted_pairs = (pairs.repartition("anchor_id")
                    .sortWithinPartitions("anchor_id", F.col("score").desc(), "vec_id"))
    return sorted_pairs.mapInArrow(_walk(options), RESULT)
