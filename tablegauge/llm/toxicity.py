"""Toxic spans and document scores from a linear-chain conditional random field.

Only documents are labelled, so the labels of training tokens come from them: a token of a toxic document is taken for
toxic if one of its features is found in toxic documents so often, and in clean ones so rarely, that chance does not
explain it; further rounds relabel toxic documents with the marginals of the one before.  The field has two states and
hashed features of the word (whole, beginnings, end).  Forward-backward gives the marginal of each token; the document
score is a logistic function of their maximum and sum, and runs of probable tokens are the offending spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from tablegauge.functions.missing import quoted
from tablegauge.llm.textarrays import Texts, chunks

PREFIXES = (3, 4, 5, 6)


@dataclass(frozen=True)
class Training:
    """The sample: at most ``toxic_rows`` and ``clean_rows`` labelled texts of at most ``max_chars`` characters.

    It is what the driver holds: 36 MB of text at most, and about 30 times the text in tokens and features.  Training uses at most ``segments`` stretches of
    ``segment`` tokens; longer texts are chains of that many tokens one after another.
    """

    toxic_rows: int = 1500
    clean_rows: int = 4500
    max_chars: int = 6_000
    bits: int = 18
    segment: int = 64
    segments: int = 8_000
    epochs: int = 3
    rounds: int = 3
    chance: float = 1e-4


@dataclass
class Model:
    weights: np.ndarray
    transition: np.ndarray
    start: np.ndarray
    document: np.ndarray
    bits: int
    segment: int
    constant: float | None = None


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes in lower case as far as that keeps their number: ASCII and the Latin-1 letters."""
    out = data.copy()
    out[(data >= 0x41) & (data <= 0x5A)] += 32
    if len(data) > 1:
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[second] += 0x20
    return out


_inside = np.zeros(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _inside[_low: _high + 1] = True


def features(text: Texts, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends, owners, and the feature numbers of each word (whole, beginnings, end)."""
    low = Texts(lowered(text.data), text.offsets)
    starts, ends, owner = low.runs(_inside[low.data])
    spans = [(starts, ends, 0)] + [(starts, np.minimum(starts + k, ends), k) for k in PREFIXES]
    spans.append((np.maximum(ends - 3, starts), ends, 9))
    out = np.empty((len(starts), len(spans)), np.int32)
    for column, (a, b, kind) in enumerate(spans):
        h = low.hashes(a, b) + np.uint64(kind * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        out[:, column] = (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).astype(np.int32)
    return starts, ends, owner, out


def _segments(owner: np.ndarray, n_texts: int, length: int) -> np.ndarray:
    """Token numbers in rows of ``length``, -1 behind the last one; no row holds tokens of two texts."""
    count = np.bincount(owner, minlength=n_texts)
    begins = np.cumsum(count) - count
    rows = -(-count // length)
    first = np.repeat(begins, rows) + length * (np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows))
    last = np.repeat(begins + count, rows)
    at = first[:, None] + np.arange(length)
    return np.where(at < last[:, None], at, -1)


def _marginals(emission: np.ndarray, real: np.ndarray, transition: np.ndarray, start: np.ndarray):
    """Marginals of the toxic state and expected transitions, for rows of log potentials of that state.

    Forward-backward on two states with scaled probabilities; ``real`` marks tokens, which fill the left of each row.
    """
    n, length = emission.shape
    potential = np.ones((n, length, 2))
    potential[:, :, 1] = np.exp(np.clip(np.where(real, emission, 0), -30, 30))
    step = np.exp(transition)
    alpha = np.empty((n, length, 2))
    alpha[:, 0] = np.exp(start) * potential[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        a = (alpha[:, t - 1] @ step) * potential[:, t]
        a /= a.sum(axis=1, keepdims=True)
        alpha[:, t] = np.where(real[:, t, None], a, alpha[:, t - 1])
    beta = np.ones((n, length, 2))
    pairs = np.zeros((2, 2))
    for t in range(length - 2, -1, -1):
        ahead = beta[:, t + 1] * potential[:, t + 1]
        b = ahead @ step.T
        b /= b.sum(axis=1, keepdims=True)
        beta[:, t] = np.where(real[:, t + 1, None], b, 1.0)
        joint = alpha[:, t, :, None] * step[None] * ahead[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        pairs += joint[real[:, t + 1]].sum(axis=0)
    both = alpha * beta
    return both[:, :, 1] / both.sum(axis=2), pairs


def token_probabilities(model: Model, feats: np.ndarray, owner: np.ndarray, n_texts: int) -> np.ndarray:
    """The marginal of the toxic state of each token."""
    if not len(owner):
        return np.empty(0)
    rows = _segments(owner, n_texts, model.segment)
    out = np.empty(len(owner))
    for first in range(0, len(rows), 2048):
        part = rows[first: first + 2048]
        real = part >= 0
        score = np.zeros(part.shape)
        score[real] = model.weights[feats[part[real]]].sum(axis=1) + model.weights[-1]
        p, _ = _marginals(score, real, model.transition, model.start)
        out[part[real]] = p[real]
    return out


def _document_values(p: np.ndarray, owner: np.ndarray, n_texts: int) -> np.ndarray:
    """Maximum and sum of the marginals; those below a tenth would only add up to the length of a text."""
    top = np.zeros(n_texts)
    np.maximum.at(top, owner, p)
    total = np.bincount(owner, weights=np.where(p > 0.1, p, 0), minlength=n_texts)
    count = np.bincount(owner, minlength=n_texts)
    return np.stack([top, np.log1p(total), np.log1p(count) / 10, np.ones(n_texts)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        w -= np.linalg.solve(hessian, x.T @ (p - y) + 0.1 * w)
    return w


def _weak_labels(feats: np.ndarray, owner: np.ndarray, toxic: np.ndarray, bits: int, chance: float) -> np.ndarray:
    """Tokens of toxic texts with a feature that chance does not explain."""
    n = len(toxic)
    share = toxic.sum() / n
    in_toxic, in_clean = np.zeros(1 << bits), np.zeros(1 << bits)
    for column in range(feats.shape[1]):
        pair = np.unique(feats[:, column].astype(np.int64) * n + owner)
        f, d = pair // n, pair % n
        in_toxic += np.bincount(f[toxic[d]], minlength=1 << bits)
        in_clean += np.bincount(f[~toxic[d]], minlength=1 << bits)
    least = max(3, int(np.ceil(np.log(chance) / np.log(share))))
    telling = (in_toxic >= least) & (in_clean <= 0.01 * in_toxic)
    return telling[feats].any(axis=1) & toxic[owner]


def _train_field(feats, label, rows, options: Training, rng) -> Model:
    """Adam on the conditional likelihood of the labelled rows."""
    size = 1 << options.bits
    w, trans, start = np.zeros(size + 1), np.zeros((2, 2)), np.zeros(2)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, trans, start)]
    step = 0
    for _ in range(options.epochs):
        order = rng.permutation(len(rows))
        for first in range(0, len(rows), 256):
            part = rows[order[first: first + 256]]
            real = part >= 0
            at = np.where(real, part, 0)
            f = feats[at]
            p, pairs = _marginals(w[f].sum(axis=2) + w[-1], real, trans, start)
            y = label[at].astype(float)
            error = np.where(real, y - p, 0.0)
            g = np.bincount(f.ravel(), weights=np.repeat(error.ravel(), f.shape[2]), minlength=size + 1)
            g[-1] += error.sum()
            seen = np.zeros((2, 2))
            both = real[:, 1:]
            np.add.at(seen, (y[:, :-1][both].astype(int), y[:, 1:][both].astype(int)), 1)
            begin = np.array([1 - y[:, 0], y[:, 0]]).sum(axis=1) - np.array([1 - p[:, 0], p[:, 0]]).sum(axis=1)
            step += 1
            for x, grad, (m, v) in zip((w, trans, start), (g, seen - pairs, begin), moments):
                grad = grad / len(part) - 1e-4 * x
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                x += 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
    return Model(w, trans, start, np.zeros(4), options.bits, options.segment)


def fit(texts: list[str], toxic: np.ndarray, options: Training = Training()) -> Model:
    """A model from labelled texts; with one class only (or none) every score is the share of toxic texts."""
    toxic = np.asarray(toxic, bool)
    if not len(texts) or toxic.all() or not toxic.any():
        share = float(toxic.mean()) if len(texts) else 0.0
        return Model(np.zeros((1 << options.bits) + 1), np.zeros((2, 2)), np.zeros(2), np.zeros(4), options.bits,
                     options.segment, share)
    rng = np.random.default_rng(7)
    feats, owner, n = [], [], 0
    for part, text in chunks(iter([pa.record_batch({"body": pa.array(texts)})]), "body"):
        _, _, own, f = features(text, options.bits)
        feats.append(f)
        owner.append(own + n)
        n += len(text)
    feats, owner = np.concatenate(feats), np.concatenate(owner)
    label = _weak_labels(feats, owner, toxic, options.bits, options.chance)
    rows = _segments(owner, n, options.segment)
    model = None
    for number in range(options.rounds):
        marked = np.where(rows >= 0, label[rows], False).any(axis=1)
        other = np.flatnonzero(~marked & ~toxic[owner[rows[:, 0]]])
        marked = np.flatnonzero(marked)
        half = options.segments // 2
        used = np.concatenate([rng.permutation(marked)[:half], rng.permutation(other)[: options.segments - half]])
        model = _train_field(feats, label, rows[used], options, rng)
        p = token_probabilities(model, feats, owner, n)
        label = (p > 0.5) & toxic[owner]
        if number + 2 < options.rounds:
            # On the way, a toxic text without a probable token has its likeliest ones: rarer words are found by them.
            top = np.zeros(n)
            np.maximum.at(top, owner, p)
            has = np.bincount(owner[label], minlength=n) > 0
            label |= toxic[owner] & ~has[owner] & (p >= top[owner]) & (p > 0.05)
    model.document = _logistic(_document_values(p, owner, n), toxic.astype(float))
    return model


def training_sample(docs: DataFrame, labels: DataFrame, options: Training = Training(), id_col: str = "doc_id",
                    text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], np.ndarray]:
    """Labelled texts for ``fit``, the same ones whatever the partitioning; equal texts count once.

    Rows without text or label teach nothing.
    """
    known = labels.select(quoted(id_col).alias("id"), quoted(label_col).alias("label")).dropna().dropDuplicates()
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("body")).dropna()
    rows = rows.filter(F.length("body") <= options.max_chars)
    rows = rows.select("id", "body", F.xxhash64("body").alias("h"))
    # Only hashes are matched and sorted; the texts of the chosen ones are fetched after that.
    keys = rows.select("id", "h").join(known, "id").select("label", "h").distinct()
    chosen: dict[int, bool] = {}
    for label, most in ((0, options.clean_rows), (1, options.toxic_rows)):
        for row in keys.filter(F.col("label") == label).orderBy("h").limit(most).collect():
            chosen[row["h"]] = bool(label)
    picked = docs.sparkSession.createDataFrame([(h,) for h in chosen], "h long")      # at most all rows of the sample
    texts = rows.select("h", "body").join(F.broadcast(picked), "h").groupBy("h").agg(F.min("body").alias("body"))
    found = sorted(texts.collect())
    return [r["body"] for r in found], np.array([chosen[r["h"]] for r in found], bool)


def _runs(hit: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last tokens of runs of marked tokens in one text."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (np.diff(owner[at]) > 0)
    return at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]


def _scored(model: Model, text: Texts):
    """Word starts, ends and owners, the marginal of each word and the score of each text."""
    starts, ends, owner, feats = features(text, model.bits)
    if model.constant is not None:
        return starts, ends, owner, np.zeros(len(owner)), np.full(len(text), model.constant)
    p = token_probabilities(model, feats, owner, len(text))
    values = _document_values(p, owner, len(text))
    return starts, ends, owner, p, 1 / (1 + np.exp(-np.clip(values @ model.document, -30, 30)))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for part, text in chunks(batches, "body"):
            starts, ends, owner, p, score = _scored(model, text)
            first, last = _runs(p > 0.5, owner)
            points = np.append(0, np.cumsum((text.data & 0xC0) != 0x80))
            origin = points[text.offsets[:-1]][owner[first]]
            worst = np.maximum.reduceat(p, first) if len(first) else np.empty(0)
            offsets = np.append(0, np.cumsum(np.bincount(owner[first], minlength=len(text)))).astype(np.int32)
            spans = pa.StructArray.from_arrays(
                [pa.array((points[starts[first]] - origin).astype(np.int64)),
                 pa.array((points[ends[last]] - origin).astype(np.int64)), pa.array(worst)],
                names=["start", "end", "probability"])
            yield pa.record_batch({"id": part.column("id"), "score": pa.array(score),
                                   "spans": pa.ListArray.from_arrays(pa.array(offsets), spans)})

    return run


def tag_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) and ``spans`` of each row.

    A span is a run of tokens whose marginal exceeds one half, in code points, end exclusive, with the largest marginal
    from its first token on.  Null and empty texts are scored as texts without tokens.  Ids are only carried along; other
    columns are ignored, whatever their names.  An empty table gives an empty result.
    """
    body = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    rows = docs.select(quoted(id_col).alias("id"), body.alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = rows.mapInArrow(_score(shared), f"id {kind}, score double, "
                            "spans array<struct<start:long,end:long,probability:double>>")
    return found.select(F.col("id").alias(id_col), "score", F.expr("if(score >= 0.5, 1, 0)").alias("predicted"), "spans")


def held_out(id_col: str = "doc_id"):
    """Rows kept from training: a fifth, by the CRC-32 of the id's text."""
    return F.crc32(quoted(id_col).cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, options: Training = Training()) -> Model:
    """A model from all labelled rows but the held-out ones."""
    return fit(*training_sample(docs.filter(~held_out()), labels.filter(~held_out()), options), options)


def _kept(shared, names: list[str], place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            # By place, for the text may stand under any name.
            numbered = batch.rename_columns([str(i) for i in range(batch.num_columns)])
            for part, text in chunks(iter([numbered]), str(place)):
                *_, score = _scored(model, text)
                kept = part.filter(pa.array(score < 0.5))
                yield pa.RecordBatch.from_arrays(kept.columns[: len(names)], names=names)

    return run


def reject_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", options: Training = Training()) -> DataFrame:
    """The rows whose text is not predicted toxic, all columns as they were.

    Rows are judged and handed back about a megabyte of text at a time.  A string column is read where it stands; of
    any other a text is made beside it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, options))
    names = docs.columns
    place = len(names)
    if isinstance(docs.select(quoted(text_col)).schema[0].dataType, StringType):
        place = min(range(place), key=lambda i: (names[i] != text_col, names[i].lower() != text_col.lower()))
        rows = docs
    else:
        free = "_" * (1 + max(map(len, names)))
        rows = docs.select("*", quoted(text_col).cast("string").alias(free))
    return rows.mapInArrow(_kept(shared, names, place), docs.schema)
