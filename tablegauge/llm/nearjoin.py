"""N-gram Jaccard self-join of documents with a MinHash LSH forest and exact verification.

1. Each text becomes the set of its word n-grams and a MinHash signature.  Texts with equal sets are one class.
2. A tree of the forest orders the classes by a stretch of the signature; a node of its trie is a common prefix.
   The nodes are those of the longest prefix that reaches the target recall at the threshold.
3. In each node signatures are compared, all pairs of a small node at once and those of a large one block by block;
   classes that may be similar are linked, a forest of links for each comparison.  The components of all links are
   neighbourhoods.
4. In each neighbourhood the exact similarity of all pairs is computed, block by block where it is large, so that pairs
   are never written out: only a count for each class and a forest of the exact links leave a block.
5. The components of the exact links are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablegauge.functions.missing import quoted
from tablegauge.llm.components import components
from tablegauge.llm.shared import cut_lineage
from tablegauge.llm.textarrays import Texts, chunks, mixed


@dataclass(frozen=True)
class Forest:
    """``trees`` of ``depth`` hashes each.

    A pair at the threshold shares a prefix of k hashes in some tree with probability 1 - (1 - threshold**k)**trees;
    the longest k that reaches ``recall`` makes the nodes.  Nodes of more than ``node`` classes are compared in blocks
    of about ``block_sigs`` classes.  ``margin``: how far an estimated similarity may lie below the threshold (5 standard errors at 120 hashes).
    """

    ngram: int = 5
    threshold: float = 0.8
    trees: int = 20
    depth: int = 6
    recall: float = 0.9999
    node: int = 256
    margin: float = 0.2
    block_sigs: int = 2048
    #: Classes and n-grams that a block of step 4 has on average.
    block_rows: int = 128
    block_grams: int = 500_000

    @property
    def hashes(self) -> int:
        return self.trees * self.depth

    @property
    def shortest(self) -> int:
        reached = [k for k in range(1, self.depth + 1)
                   if 1 - (1 - self.threshold ** k) ** self.trees >= self.recall]
        return max(reached, default=1)


def gram_sets(text: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted, and their texts.  A shorter text with words is one n-gram."""
    starts, ends, owner = text.words()
    words = text.hashes(starts, ends)
    per_text = np.bincount(owner, minlength=len(text))
    begins = np.cumsum(per_text) - per_text
    base = np.uint64(0xD6E8FEB86659FD93)
    h = words.copy()
    for j in range(1, n):
        # Behind the last word of a text nothing is added, which gives short texts their one n-gram.
        more = np.flatnonzero(owner[j:] == owner[: len(owner) - j]) if len(owner) > j else np.empty(0, np.int64)
        h[more] = h[more] * base + words[more + j]
    place = np.arange(len(words)) - begins[owner]
    use = (place <= per_text[owner] - n) | ((place == 0) & (per_text[owner] < n))
    grams, of = mixed(h[use]), owner[use]
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    return grams[new], of[new]


def _set_names(grams: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit name of each set: two sums of mixed members."""
    names = []
    for seed in (11, 12):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(grams, seed))])
        stop = np.searchsorted(of, np.arange(n), side="right")
        start = np.searchsorted(of, np.arange(n), side="left")
        names.append((total[stop] - total[start]).view(np.int64))
    return names[0], names[1]


def _signatures(options: Forest):
    keys = mixed(np.arange(1, options.hashes + 1, dtype=np.uint64), 21)
    factors = mixed(keys, 22) | np.uint64(1)

    def run(batches):
        for part, text in chunks(batches, "body"):
            grams, of = gram_sets(text, options.ngram)
            size = np.bincount(of, minlength=len(text))
            full = np.flatnonzero(size)
            if not len(full):
                continue
            name1, name2 = _set_names(grams, of, len(text))
            begins = (np.cumsum(size) - size)[full]
            sig = np.empty((len(full), options.hashes), np.uint32)
            for j in range(options.hashes):
                sig[:, j] = np.minimum.reduceat(((grams ^ keys[j]) * factors[j]) >> np.uint64(32), begins)
            picked = pa.array(full)
            yield pa.record_batch({
                "key": part.column("key").take(picked), "name1": pa.array(name1[full]), "name2": pa.array(name2[full]),
                "n": pa.array(size[full].astype(np.int64)),
                "sig": pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(4 * options.hashes), len(full), [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())})

    return run


def _sig_matrix(column: pa.Array, hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), hashes)


def _prefixes(options: Forest, length: int):
    """Hashed prefixes of the given length, of all trees."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _sig_matrix(batch.column("sig"), options.hashes)
            which = np.repeat(np.arange(options.trees), len(sig))
            rows = np.tile(np.arange(len(sig)), options.trees)
            h = mixed(which.astype(np.uint64), 31)
            for d in range(length):
                h = mixed(h ^ sig[rows, which * options.depth + d].astype(np.uint64), 32 + d)
            yield pa.record_batch({"cls": batch.column("cls").take(pa.array(rows)),
                                   "tree": pa.array(which.astype(np.int32)), "node": pa.array(h.view(np.int64))})

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by the keys; what is held is the last group and one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change)
        first = tuple(c[0] for c in columns)
        if last is not None and first != last:
            yield pa.Table.from_batches(held)
            held = []
        if len(cuts):
            held.append(batch.slice(0, cuts[0]))
            yield pa.Table.from_batches(held)
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield pa.Table.from_batches([batch.slice(a, b - a)])
            held = [batch.slice(cuts[-1])]
        else:
            held.append(batch)
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a symmetric matrix of links: nodes and the first node of their component, without the first ones."""
    n = len(linked)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] >= 0:
            continue
        root[i], front = i, linked[i]
        while True:
            new = front & (root < 0)
            if not new.any():
                break
            root[new] = i
            front = linked[new].any(axis=0)
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def _node_links(options: Forest):
    least = int((options.threshold - options.margin) * options.hashes)

    def run(batches):
        out: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for group in _groups(batches, ("tree", "node")):
            cls, at = np.unique(group.column("cls").to_numpy(), return_index=True)
            if len(cls) < 2:
                continue
            sig = _sig_matrix(group.column("sig").combine_chunks().take(pa.array(at)), options.hashes)
            linked = np.zeros((len(cls), len(cls)), bool)
            for i in range(len(cls)):
                linked[i] = (sig == sig[i]).sum(axis=1) >= least
            a, b = _spanning(linked)
            out.append((cls[a], cls[b]))
            size += len(a)
            if size > 50_000:
                yield _link_batch(out)
                out, size = [], 0
        if size:
            yield _link_batch(out)

    return run


def _link_batch(out) -> pa.RecordBatch:
    return pa.record_batch({"a": pa.array(np.concatenate([x for x, _ in out])),
                            "b": pa.array(np.concatenate([x for _, x in out]))})


def _low_bytes(options: Forest):
    """The lowest byte of each hash: equal hashes have equal ones, so that comparing these misses nothing."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            low = _sig_matrix(batch.column("sig"), options.hashes).astype(np.uint8)
            yield pa.record_batch({
                **{c: batch.column(c) for c in ("tree", "node", "cls", "n")},
                "low": pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(options.hashes), len(low), [None, pa.py_buffer(low.tobytes())]).cast(pa.binary())})

    return run


def _cell_links(options: Forest):
    """Links of each cell, the pairs across two blocks of a large node or within one."""
    least = int((options.threshold - options.margin) * options.hashes)
    counter = np.uint8 if options.hashes < 256 else np.uint16
    tile = 64

    def one(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        cls, block = group.column("cls").to_numpy(), group.column("block").to_numpy()
        first, second = int(group.column("first")[0].as_py()), int(group.column("second")[0].as_py())
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        low = np.frombuffer(b"".join(group.column("low").to_pylist()), np.uint8).reshape(len(cls), options.hashes)
        low = np.ascontiguousarray(low.T)
        root = cls.copy()
        for at in range(0, len(left), tile):
            some, others = left[at: at + tile], left[at:] if first == second else right
            # What is linked already need not be compared.
            if (root[some] == root[some[0]]).all():
                others = others[root[others] != root[some[0]]]
            if not len(others):
                continue
            equal = np.zeros((len(some), len(others)), counter)
            for mine, theirs in zip(low[:, some], low[:, others]):
                equal += mine[:, None] == theirs
            near = (equal >= least) & (root[some][:, None] != root[others])
            for i in np.flatnonzero(near.any(axis=1)):
                joined = np.unique(np.append(root[others[near[i]]], root[some[i]]))
                if len(joined) > 1:
                    root[np.isin(root, joined)] = joined[0]
        moved = np.flatnonzero(root != cls)
        return cls[moved], root[moved]

    def run(batches):
        for group in _groups(batches, ("tree", "node", "first", "second")):
            a, b = one(group)
            if len(a):
                yield _link_batch([(a, b)])

    return run


def _candidate_links(classes: DataFrame, options: Forest) -> DataFrame:
    """Links a, b that join all classes of a node whose estimated similarity comes near the threshold."""
    sigs = classes.select("cls", "sig")
    rows = sigs.mapInArrow(_prefixes(options, options.shortest), "cls long, tree int, node long")
    counts = rows.groupBy("tree", "node").agg(F.count("*").alias("n")).filter("n > 1")
    # The changed key makes Spark deal both sides out, so that a very common prefix can be split.
    counts = counts.select("tree", F.expr("node ^ 1").alias("k"), "n")
    sized = cut_lineage(rows.withColumn("k", F.expr("node ^ 1")).join(counts, ["tree", "k"]).drop("k"))
    small = (sized.filter(F.col("n") <= options.node).select("tree", "node", "cls").join(sigs, "cls")
             .repartition("tree", "node").sortWithinPartitions("tree", "node")
             .mapInArrow(_node_links(options), "a long, b long"))
    low = (sized.filter(F.col("n") > options.node).join(sigs, "cls")
           .mapInArrow(_low_bytes(options), "tree int, node long, cls long, n long, low binary"))
    blocks = F.expr(f"cast(ceil(n / {options.block_sigs}) as int)")
    cells = low.withColumn("blocks", blocks).withColumn("block", F.expr("cast(pmod(xxhash64(cls), blocks) as int)"))
    cells = cells.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "tree", "node", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"),
        "block", "cls", "low")
    cell = ["tree", "node", "first", "second"]
    large = cells.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_cell_links(options), "a long, b long")
    return cut_lineage(small.unionByName(large).distinct())


def _shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common members of each left set and each right set."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in right] for i in left])
    used = np.unique(np.concatenate([left, right]))
    flat = np.concatenate([sets[i] for i in used])
    of = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    _, member, times = np.unique(flat, return_inverse=True, return_counts=True)
    common = times[member] > 1
    member, of = member[common], of[common]
    _, member = np.unique(member, return_inverse=True)
    order = np.argsort(member, kind="stable")
    member, of = member[order], of[order]
    a, b = np.searchsorted(used, left), np.searchsorted(used, right)
    total = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for first in range(0, int(member[-1]) + 1 if len(member) else 0, width):
        lo, hi = np.searchsorted(member, [first, first + width])
        has = np.zeros((len(used), width), np.float32)
        has[of[lo:hi], member[lo:hi] - first] = 1
        total += has[a] @ has[b].T
    return total.astype(np.int64)


def _block_links(options: Forest):
    """Exact links of each block: weighted counts for each class, and a spanning forest of the links."""

    def one(group: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
        cls, at = np.unique(group.column("cls").to_numpy(), return_index=True)
        group = group.take(pa.array(at))
        block, weight = group.column("block").to_numpy(), group.column("weight").to_numpy()
        first, second = int(group.column("first")[0].as_py()), int(group.column("second")[0].as_py())
        sets = [np.frombuffer(x, np.uint64) for x in group.column("grams").to_pylist()]
        n = np.array([len(x) for x in sets])
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        if not len(left) or not len(right):
            return
        both = _shared_counts(sets, left, right)
        similar = both >= options.threshold * (n[left][:, None] + n[right][None, :] - both) - 1e-9
        if first == second:
            np.fill_diagonal(similar, False)
        linked = np.zeros((len(cls), len(cls)), bool)
        linked[np.ix_(left, right)] = similar
        linked |= linked.T
        found = np.zeros(len(cls), np.int64)
        found[left] += similar @ weight[right]
        if first != second:
            found[right] += similar.T @ weight[left]
        root = cls.copy()
        a, b = _spanning(linked)
        root[a] = cls[b]
        some = found > 0
        yield cls[some], root[some], found[some]

    def run(batches):
        out = []
        for group in _groups(batches, ("hood", "first", "second")):
            out.extend(one(group))
            if sum(len(x[0]) for x in out) > 50_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out):
        return pa.record_batch({n: pa.array(np.concatenate([x[i] for x in out]))
                                for i, n in enumerate(("cls", "root", "links"))})

    return run


def _gram_rows(ngram: int):
    def run(batches):
        for part, text in chunks(batches, "body"):
            grams, of = gram_sets(text, ngram)
            name1, name2 = _set_names(grams, of, len(text))
            bounds = np.searchsorted(of, np.arange(len(text) + 1))
            # A row whose set is not the one its key stands for met the key by chance.
            fits = np.flatnonzero((name1 == np.asarray(part.column("name1"))) & (name2 == np.asarray(part.column("name2"))))
            rows = part.take(pa.array(fits))
            yield pa.record_batch({**{c: rows.column(rows.schema.get_field_index(c)) for c in ("cls", "hood", "weight", "blocks")},
                                   "grams": pa.array([grams[bounds[i]: bounds[i + 1]].tobytes() for i in fits], pa.binary())})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: Forest = Forest()) -> DataFrame:
    """The id, ``class_id`` and ``n_links`` of each row.

    ``class_id`` is the smallest id of the row's group: the documents it is linked to by steps of similarity of at
    least the threshold.  ``n_links`` counts the other rows whose similarity to it is at least the threshold, copies
    included.  A text with fewer words than an n-gram has one n-gram, all its words; texts without words (null ones
    too) have no links, and neither class nor link is shared by them.  Null ids take part; they are no class id unless
    a group has no other.  Repeated rows are copies of each other.  Only the two columns are read, whatever the others
    are called.  An empty table gives an empty result.
    """
    body = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    docs = docs.select(quoted(id_col).alias("id"), body.alias("body"))
    docs = docs.select("id", "body", F.xxhash64("id", "body").alias("key"))
    # One row for each document that has words; ids come back at the end by key.
    base = cut_lineage(docs.select("key", "body").mapInArrow(
        _signatures(options), "key long, name1 long, name2 long, n long, sig binary"))
    named = base.groupBy("name1", "name2").agg(F.min("key").alias("cls"), F.count("*").alias("weight"))
    named = cut_lineage(named)
    first = base.select(F.col("key").alias("cls"), "name1", "name2", "n", "sig")
    classes = first.join(named.select("cls", "weight", "name1", "name2"), ["cls", "name1", "name2"]).dropDuplicates(["cls"])
    classes = cut_lineage(classes)

    hoods = components(_candidate_links(classes, options))
    sized = (
        hoods.join(classes.select("cls", "n", "weight", "name1", "name2"), hoods["node"] == F.col("cls"))
        .select("cls", "n", "weight", "name1", "name2", F.col("root").alias("hood"))
    )
    blocks = sized.groupBy("hood").agg(F.count("*").alias("rows"), F.sum("n").alias("grams")).select(
        "hood", F.expr(f"cast(ceil(greatest(rows / {2 * options.block_rows}, grams / {2 * options.block_grams})) as int)"
                       ).alias("half"))
    # Up to two blocks' worth is compared at once.
    blocks = blocks.select("hood", F.expr("if(half <= 1, 1, 2 * half)").alias("blocks"))
    active = cut_lineage(sized.join(blocks, "hood"))
    grams = docs.select("key", "body").join(active.withColumnRenamed("cls", "key"), "key").select(
        F.col("key").alias("cls"), "hood", "weight", "blocks", "name1", "name2", "body")
    grams = grams.mapInArrow(_gram_rows(options.ngram), "cls long, hood long, weight long, blocks int, grams binary")
    dealt = grams.select("*", F.expr("cast(pmod(xxhash64(cls), blocks) as int)").alias("block")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("cls", "hood", "weight", "block", F.least("block", "other").alias("first"),
                         F.greatest("block", "other").alias("second"), "grams")
    exact = (dealt.repartition("hood", "first", "second").sortWithinPartitions("hood", "first", "second")
             .mapInArrow(_block_links(options), "cls long, root long, links long"))
    exact = cut_lineage(exact)
    counts = exact.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = components(exact.select(F.col("cls").alias("a"), F.col("root").alias("b")).filter("a != b").distinct())

    members = (
        named.join(counts, "cls", "left").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
        .select("name1", "name2", F.coalesce("root", "cls").alias("root"),
                (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    )
    # The changed keys make Spark deal both sides out, so that a very common text can be split.
    told = base.select("key", F.expr("name1 ^ 1").alias("k1"), F.expr("name2 ^ 1").alias("k2")).join(
        members.select(F.expr("name1 ^ 1").alias("k1"), F.expr("name2 ^ 1").alias("k2"), "root", "links"), ["k1", "k2"])
    told = told.select("key", "root", "links").distinct()
    result = docs.select("id", "key").join(told, "key", "left")
    result = cut_lineage(result.select("id", "root", F.coalesce("links", F.lit(0)).alias("n_links")))
    smallest = result.groupBy("root").agg(F.min("id").alias("class_id")).filter("root is not null")
    smallest = smallest.select(F.expr("root ^ 1").alias("r"), "class_id")
    out = result.withColumn("r", F.expr("root ^ 1")).join(smallest, "r", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("root").isNull(), F.col("id")).otherwise(
        F.col("class_id")).alias("class_id"), F.col("n_links").cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: Forest = Forest()) -> DataFrame:
    """One row of each group (that of the class id), all columns as they were.

    Of repeated rows one stays; rows with a null id stay, for nothing tells them apart.
    """
    found = cut_lineage(near_duplicates(docs, id_col, text_col, options))
    gone = found.filter(F.col("class_id").isNotNull() & (F.col("class_id") != F.col(id_col)))
    gone = gone.select(F.col(id_col).alias("__gone")).distinct()
    left = docs.join(gone, quoted(id_col) == F.col("__gone"), "left_anti")
    repeated = found.groupBy(id_col).agg(F.count("*").alias("n")).filter(F.col("n") > 1).filter(F.col(id_col).isNotNull())
    repeated = cut_lineage(repeated.select(F.col(id_col).alias("__twice")))
    if repeated.isEmpty():
        return left
    same = quoted(id_col) == F.col("__twice")
    return left.join(repeated, same, "left_anti").unionByName(
        left.join(repeated, same, "left_semi").dropDuplicates([id_col, text_col]))
