"""Shared prefixes of conversations, as a trie of turns built from ternary search trees.

Turns are dictionary-encoded: every distinct (role, text) gets an id, kept in a written table so that a recomputed
task sees the same ids.  Each conversation becomes the list of its turn ids.  Equal lists are combined first, so that
a conversation repeated a million times is one list with a count.  The distinct lists are dealt out by ranges of
their sorted order; each range shard inserts its lists into a ternary search tree, in median order so that the tree is
balanced, and one iterative post-order traversal gives every node of the trie its members, children, leaves and the
bytes that its shared turns save.

A node whose members all lie in one shard is complete there.  Only the nodes on the paths of a shard's first and last
list can have members in other shards; these boundary nodes are merged by their key (the SHA-256 of their turn ids)
afterwards, and their subtree sums are put together from the complete subtrees hanging below them.

Defined cases: turns are ordered by turn number with nulls first, then by role and text; a null role or text is empty;
repeated equal rows of a conversation count once; rows with a null conversation id take no part; a conversation
without turns is a member of the root only; an empty table gives no rows.  Extra input columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablegauge.functions.missing import quoted
from tablegauge.llm.shared import cut_lineage

NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string")
SHARD = ("key binary, parent binary, depth long, nbytes long, n long, first long, n_children long, n_leaves long, "
         "saved long, boundary boolean, ancestors array<binary>")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Rebuild:
    """Conversation c takes the first ``crc32(c) % heads`` turns of conversation ``c - c % group`` and its own after
    them."""

    heads: int = 9
    group: int = 5


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text: nulls of role and text empty, repeated rows once, null conversations left out."""
    return conversations.select(
        quoted(conv_col).cast("long").alias("conv_id"), quoted(turn_col).cast("long").alias("turn"),
        F.coalesce(quoted(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"),
    ).filter(F.col("conv_id").isNotNull()).dropDuplicates()


def encoded(turn_rows: DataFrame) -> DataFrame:
    """conv_id, ids (turn ids in order) and nbytes (UTF-8 bytes of each text) of every conversation."""
    dictionary = cut_lineage(turn_rows.select("role", "text").distinct().select(
        "role", "text", F.monotonically_increasing_id().alias("tid"), F.octet_length("text").cast("long").alias("nb")))
    place = F.struct(F.col("turn").isNotNull().alias("later"), "turn", "role", "text", "tid", "nb")
    ordered = F.array_sort(F.collect_list(place))
    return turn_rows.join(dictionary, ["role", "text"]).groupBy("conv_id").agg(ordered.alias("t")).select(
        "conv_id", F.col("t.tid").alias("ids"), F.col("t.nb").alias("nbytes"))


def rebuilt(convs: DataFrame, options: Rebuild = Rebuild()) -> DataFrame:
    """conv_id, ids, nbytes of every conversation after taking the first turns of its group's head."""
    own = convs.select("*", (F.col("conv_id") - F.col("conv_id") % options.group).alias("head"),
                       (F.crc32(F.col("conv_id").cast("string")) % options.heads).cast("int").alias("h"))
    heads = convs.select(F.col("conv_id").alias("head"), F.col("ids").alias("head_ids"),
                         F.col("nbytes").alias("head_nbytes"))
    joined = own.join(heads, "head", "left")
    first = lambda c: F.coalesce(F.slice(c, 1, F.col("h")), F.array().cast("array<long>"))
    rest = lambda c: F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(first(F.col("head_ids")), rest(F.col("ids"))).alias("ids"),
                         F.concat(first(F.col("head_nbytes")), rest(F.col("nbytes"))).alias("nbytes"))


def sequence_key(ids) -> F.Column:
    """SHA-256 of the decimal turn ids joined by commas: the key of the node that the list ends in."""
    return F.unhex(F.sha2(F.array_join(F.transform(ids, lambda x: x.cast("string")), ","), 256))


def _digest_of(members: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the members of each key, numerically ascending and comma-joined, streamed over sorted rows."""
    key, state, sep = None, None, b""
    keys, digests = [], []
    for batch in members:
        for k, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if k != key:
                if key is not None:
                    keys.append(key)
                    digests.append(state.hexdigest())
                key, state, sep = k, hashlib.sha256(), b""
            state.update(sep + str(conv).encode())
            sep = b","
        if len(keys) >= 4096:
            yield pa.RecordBatch.from_pydict({"key": keys, "ends_sha256": digests})
            keys, digests = [], []
    if key is not None:
        keys.append(key)
        digests.append(state.hexdigest())
    yield pa.RecordBatch.from_pydict({"key": keys, "ends_sha256": digests},
                                     schema=pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())]))


class _Tree:
    """A ternary search tree of turn-id lists; node t holds one turn id and the count of lists that end in it."""

    def __init__(self):
        self.split, self.nbytes, self.lo, self.eq, self.hi = [], [], [], [], []
        self.end_n, self.end_first = [], []
        self.top = -1
        self.root_n, self.root_first = 0, None

    def _new(self, tid: int, nb: int) -> int:
        for column, value in ((self.split, tid), (self.nbytes, nb), (self.lo, -1), (self.eq, -1), (self.hi, -1),
                              (self.end_n, 0), (self.end_first, None)):
            column.append(value)
        return len(self.split) - 1

    def insert(self, ids: list[int], nbytes: list[int], n: int, first: int) -> None:
        if not ids:
            self.root_n += n
            self.root_first = first if self.root_first is None else min(self.root_first, first)
            return
        if self.top < 0:
            self.top = self._new(ids[0], nbytes[0])
        t, i = self.top, 0
        while True:
            c = ids[i]
            if c < self.split[t]:
                if self.lo[t] < 0:
                    self.lo[t] = self._new(c, nbytes[i])
                t = self.lo[t]
            elif c > self.split[t]:
                if self.hi[t] < 0:
                    self.hi[t] = self._new(c, nbytes[i])
                t = self.hi[t]
            else:
                i += 1
                if i == len(ids):
                    self.end_n[t] += n
                    self.end_first[t] = first if self.end_first[t] is None else min(self.end_first[t], first)
                    return
                if self.eq[t] < 0:
                    self.eq[t] = self._new(ids[i], nbytes[i])
                t = self.eq[t]

    def children(self, start: int) -> list[int]:
        """The trie children below a node: the tree nodes reachable from ``start`` by lo and hi links."""
        out, stack = [], [start] if start >= 0 else []
        while stack:
            t = stack.pop()
            out.append(t)
            stack.extend(x for x in (self.lo[t], self.hi[t]) if x >= 0)
        return out

    def path(self, ids: list[int]) -> list[int]:
        """Tree nodes of the trie nodes along ``ids``."""
        out, t = [], self.top
        for c in ids:
            while t >= 0 and c != self.split[t]:
                t = self.lo[t] if c < self.split[t] else self.hi[t]
            out.append(t)
            t = self.eq[t]
        return out


def _median_order(n: int) -> Iterator[int]:
    """Positions of a sorted list in the order that keeps a search tree balanced: middles first."""
    ranges = [(0, n)]
    while ranges:
        more = []
        for lo, hi in ranges:
            if lo < hi:
                mid = (lo + hi) // 2
                yield mid
                more += [(lo, mid), (mid + 1, hi)]
        ranges = more


def _shard() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {"ids": [], "nbytes": [], "n": [], "first": []}
        for batch in batches:
            for name in rows:
                rows[name] += batch.column(name).to_pylist()
        out = {name: [] for name in ("key", "parent", "depth", "nbytes", "n", "first", "n_children", "n_leaves",
                                     "saved", "boundary", "ancestors")}
        if rows["ids"]:
            tree = _Tree()
            for at in _median_order(len(rows["ids"])):
                tree.insert(rows["ids"][at], rows["nbytes"][at], rows["n"][at], rows["first"][at])
            edge = {-1, *tree.path(rows["ids"][0]), *tree.path(rows["ids"][-1])}
            _traverse(tree, edge, out)
        yield pa.RecordBatch.from_pydict(out, schema=_SHARD_SCHEMA)

    return run


def _traverse(tree: _Tree, edge: set[int], out: dict) -> None:
    """Post-order over the trie (node -1 is the root), without recursion."""
    root_state = hashlib.sha256()
    info = {-1: (root_state, None, 0, [root_state.digest()])}  # hash state, parent key, depth, ancestors
    stack = [(-1, False)]
    total: dict[int, tuple[int, object, int, int, int]] = {}  # n, first, leaves, saved, is boundary
    kids: dict[int, list[int]] = {}
    while stack:
        t, done = stack.pop()
        state, parent, depth, ancestors = info[t]
        if not done:
            kids[t] = tree.children(tree.top if t < 0 else tree.eq[t])
            stack.append((t, True))
            for c in kids[t]:
                s = state.copy()
                s.update((b"," if depth else b"") + str(tree.split[c]).encode())
                key = s.digest()
                info[c] = (s, state.digest(), depth + 1, ancestors + [key] if c in edge else None)
                stack.append((c, False))
            continue
        end_n = tree.root_n if t < 0 else tree.end_n[t]
        end_first = tree.root_first if t < 0 else tree.end_first[t]
        nb = 0 if t < 0 else tree.nbytes[t]
        n, firsts = end_n, [] if end_first is None else [end_first]
        inner = [c for c in kids[t] if c not in edge]
        leaves = sum(total[c][2] for c in inner)
        saved = sum(total[c][3] for c in inner)
        for c in kids[t]:
            n += total[c][0]
            firsts.append(total[c][1])
        first = min(firsts)
        boundary = t in edge
        if not boundary:
            leaves = leaves if kids[t] else 1
            saved += (n - 1) * nb
        total[t] = (n, first, leaves, saved)
        values = (state.digest(), parent, depth, nb, n, first, len(inner) if boundary else len(kids[t]), leaves,
                  saved, boundary, ancestors if boundary else None)
        for name, value in zip(out, values):
            out[name].append(value)
        for c in kids[t]:
            del info[c], total[c]
        del kids[t]


_SHARD_SCHEMA = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()),
                           ("nbytes", pa.int64()), ("n", pa.int64()), ("first", pa.int64()),
                           ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()),
                           ("boundary", pa.bool_()), ("ancestors", pa.list_(pa.binary()))])


def prefix_trie(conversations: DataFrame, options: Rebuild = Rebuild(), conv_col: str = "conv_id",
                turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node of the trie of rebuilt conversations (see the module), with the columns of ``NODES``."""
    convs = cut_lineage(rebuilt(encoded(turns(conversations, conv_col, turn_col, role_col, text_col)), options)
                        .select("conv_id", "ids", "nbytes", sequence_key(F.col("ids")).alias("key")))
    # Equal lists are combined before anything is dealt out by them.
    distinct = convs.groupBy("key").agg(F.first("ids").alias("ids"), F.first("nbytes").alias("nbytes"),
                                        F.count("*").alias("n"), F.min("conv_id").alias("first"))
    shards = distinct.repartitionByRange("ids").sortWithinPartitions("ids")
    nodes = cut_lineage(shards.mapInArrow(_shard(), SHARD))
    inner = nodes.filter(~F.col("boundary")).select(
        "key", "parent", "depth", F.col("first").alias("conv_id"), F.col("n").alias("n_convs"), "n_children",
        F.col("n_leaves"), F.col("saved").alias("saved_tokens"))
    merged = nodes.filter("boundary").groupBy("key").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("nbytes").alias("nbytes"),
        F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("n_children").alias("inner_children"),
        F.sum("n_leaves").alias("inner_leaves"), F.sum("saved").alias("inner_saved"),
        F.first("ancestors").alias("ancestors"))
    edge_children = merged.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("edge_children"))
    merged = merged.join(edge_children, "key", "left").withColumn(
        "n_children", F.col("inner_children") + F.coalesce("edge_children", F.lit(0)))
    own = merged.select(
        F.explode("ancestors").alias("key"),
        (F.when(F.col("n_children") == 0, 1).otherwise(0) + F.col("inner_leaves")).alias("leaves"),
        ((F.col("n") - 1) * F.col("nbytes") + F.col("inner_saved")).alias("saved"))
    subtree = own.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    outer = merged.join(subtree, "key").select(
        "key", "parent", "depth", F.col("first").alias("conv_id"), F.col("n").alias("n_convs"), "n_children",
        "n_leaves", "saved_tokens")
    every = inner.unionByName(outer)
    members = convs.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    ends = members.mapInArrow(_digest_of, "key binary, ends_sha256 string")
    parents = every.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return every.join(ends, "key", "left").join(parents, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
