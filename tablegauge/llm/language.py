"""Language identification with script ranges and Viterbi over words.

The script of a word, told by ranges of code points, narrows the languages that come into question.  Each word is scored
under each of them by its byte trigrams; Viterbi with a penalty for switching labels the words, so that passages in
another language come out as spans.  The language of a document is the one with the most bytes of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablegauge.functions.missing import quoted
from tablegauge.llm.textarrays import Texts, chunks
from tablegauge.llm.toxicity import lowered

# Scripts by ranges of code points; what is in none of them is "other".
SCRIPTS = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FFFF))),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
)
UNKNOWN = "und"


@dataclass(frozen=True)
class Identifier:
    """``penalty`` (nats) for changing the language between two words.

    A language comes into question for a script in which at least ``script_share`` of its words are written.
    """

    bits: int = 16
    penalty: float = 8.0
    script_share: float = 0.005


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray
    allowed: np.ndarray
    penalty: float


_letter = np.zeros(256, bool)
for _low, _high in ((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _letter[_low: _high + 1] = True
_edges = np.array(sorted({e for _, ranges in SCRIPTS for low, high in ranges for e in (low, high + 1)}))
_script_of = np.full(len(_edges) + 1, len(SCRIPTS))
for _number, (_, _ranges) in enumerate(SCRIPTS):
    for _low, _high in _ranges:
        _script_of[np.searchsorted(_edges, _low, side="right"): np.searchsorted(_edges, _high, side="right") + 1] = _number


def _first_points(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The code point at each place."""
    padded = np.append(data, np.zeros(4, np.uint8)).astype(np.int64)
    b0, b1, b2, b3 = (padded[starts + i] for i in range(4))
    two, three = ((b0 & 0x1F) << 6) | (b1 & 0x3F), ((b0 & 0x0F) << 12) | ((b1 & 0x3F) << 6) | (b2 & 0x3F)
    four = ((b0 & 0x07) << 18) | ((b1 & 0x3F) << 12) | ((b2 & 0x3F) << 6) | (b3 & 0x3F)
    return np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, four)))


def word_features(text: Texts, bits: int):
    """Starts, ends, owners and scripts of the words, and the trigram number at each byte of the text.

    A trigram is centred on its byte; a word is seen with one blank at either end.
    """
    low = lowered(text.data)
    letter = _letter[low]
    starts, ends, owner = text.runs(letter)
    script = _script_of[np.searchsorted(_edges, _first_points(text.data, starts), side="right")]
    plain = np.where(letter, low, 0x20).astype(np.uint32)
    before, after = np.append(np.uint32(0x20), plain[:-1]), np.append(plain[1:], np.uint32(0x20))
    before[starts], after[ends - 1] = 0x20, 0x20
    code = (before << np.uint32(16)) | (plain << np.uint32(8)) | after
    grams = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    return starts, ends, owner, script, grams


def _counts(bits: int):
    """Trigram and script counts of each language in a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for part, text in chunks(batches, "body"):
            _, _, owner, script, gram = word_features(text, bits)
            letter = _letter[text.data]
            names, of_text = np.unique(np.array(part.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            of_byte = np.repeat(of_text, np.diff(text.offsets))
            for k, name in enumerate(names):
                g = np.bincount(gram[letter & (of_byte == k)], minlength=1 << bits)
                s = np.bincount(script[of_text[owner] == k], minlength=len(SCRIPTS) + 1)
                grams[name] = grams.get(name, 0) + g
                scripts[name] = scripts.get(name, 0) + s
        if grams:
            yield pa.record_batch({"lang": pa.array(list(grams)),
                                   "grams": pa.array([x.astype("<i8").tolist() for x in grams.values()], pa.list_(pa.int64())),
                                   "scripts": pa.array([x.tolist() for x in scripts.values()], pa.list_(pa.int64()))})

    return run


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", options: Identifier = Identifier()) -> Model:
    """Counts over all rows that have a text and a language; the model holds a table for each language."""
    rows = docs.select(quoted(text_col).cast("string").alias("body"), quoted(lang_col).cast("string").alias("lang")).dropna()
    counts = rows.mapInArrow(_counts(options.bits), "lang string, grams array<long>, scripts array<long>")
    both = counts.select("lang", F.posexplode(F.concat("scripts", "grams")).alias("at", "n")).filter("n > 0")
    total = both.groupBy("lang", "at").agg(F.sum("n").alias("n"))
    # A row for each language, of bounded width: its counts that are not zero.
    lists = total.groupBy("lang").agg(F.collect_list(F.struct("at", "n")).alias("x")).select("lang", "x.at", "x.n")
    return _model({r["lang"]: (np.array(r["at"]), np.array(r["n"], float)) for r in lists.toLocalIterator()}, options)


def _model(counts: dict[str, tuple[np.ndarray, np.ndarray]], options: Identifier) -> Model:
    languages = sorted(counts)
    width, n_scripts = 1 << options.bits, len(SCRIPTS) + 1
    grams, scripts = np.zeros((width, len(languages))), np.zeros((n_scripts, len(languages)))
    for k, name in enumerate(languages):
        at, n = counts[name]
        scripts[at[at < n_scripts], k] = n[at < n_scripts]
        grams[at[at >= n_scripts] - n_scripts, k] = n[at >= n_scripts]
    allowed = scripts >= options.script_share * np.maximum(scripts.sum(axis=0), 1)
    allowed &= scripts > 0
    allowed[~allowed.any(axis=1)] = True
    # Smoothing holds a thousandth of what a language has; what all languages share tells nothing and is left out.
    smooth = grams + 0.001 * np.maximum(grams.sum(axis=0), 1) / width + 0.01
    scores = np.log(smooth / smooth.sum(axis=0))
    if languages:
        scores -= scores.max(axis=1, keepdims=True)
    return Model(languages, scores.astype(np.float32), allowed, options.penalty)


def viterbi(emission: np.ndarray, owner: np.ndarray, n_texts: int, penalty: float) -> np.ndarray:
    """The best state of each word.  All texts take their steps together, the longest first, so that those still under
    way at a step are the first rows."""
    n, k = emission.shape
    count = np.bincount(owner, minlength=n_texts)
    begins = np.cumsum(count) - count
    rank = np.empty(n_texts, np.int64)
    by_length = np.argsort(-count, kind="stable")
    rank[by_length] = np.arange(n_texts)
    place = np.arange(n) - begins[owner]
    order = np.lexsort((rank[owner], place))
    steps = np.bincount(place)
    bounds = np.append(0, np.cumsum(steps))
    ordered = emission[order]
    moved, source = np.empty((n, k), bool), np.empty(n, np.int64)
    value = ordered[: bounds[1]].copy()
    final = np.empty(n_texts, np.int64)
    for t in range(1, len(steps)):
        m = steps[t]
        ending = value[m:]
        final[m: m + len(ending)] = ending.argmax(axis=1)
        value = value[:m]
        best = value.argmax(axis=1)
        jump = value[np.arange(m), best][:, None] - penalty
        lo, hi = bounds[t], bounds[t + 1]
        source[lo:hi] = best
        moved[lo:hi] = jump > value
        value = np.maximum(value, jump) + ordered[lo:hi]
    final[: len(value)] = value.argmax(axis=1)
    label = np.empty(n, np.int64)
    state = np.empty(0, np.int64)
    for t in range(len(steps) - 1, -1, -1):
        m = steps[t]
        if t + 1 < len(steps):
            lo, hi = bounds[t + 1], bounds[t + 2]
            state = np.where(moved[lo:hi][np.arange(len(state)), state], source[lo:hi], state)
        state = np.concatenate([state, final[len(state): m]])
        label[bounds[t]: bounds[t + 1]] = state
    out = np.empty(n, np.int64)
    out[order] = label
    return out


def _label(shared, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        k = len(model.languages)
        for part, text in chunks(batches, "body", 4 << 20):
            n = len(text)
            starts, ends, owner, script, grams = word_features(text, bits)
            share, best = np.zeros(n), np.full(n, -1)
            first = last = label = np.empty(0, np.int64)
            if k and len(starts):
                sums = np.empty((len(starts), k), np.float32)
                edges = np.stack([starts, ends], axis=1).ravel()
                for j in range(k):
                    column = np.append(model.scores[:, j][grams], np.float32(0))
                    sums[:, j] = np.add.reduceat(column, edges)[::2]
                sums[~model.allowed[script]] = -1e6
                label = viterbi(sums.astype(np.float64), owner, n, model.penalty)
                weight = np.bincount(owner * k + label, weights=ends - starts, minlength=n * k).reshape(n, k)
                some = weight.sum(axis=1) > 0
                best[some] = weight[some].argmax(axis=1)
                share[some] = weight[some].max(axis=1) / weight[some].sum(axis=1)
                new = np.ones(len(starts), bool)
                new[1:] = (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(starts)) - 1
            names = np.array([*model.languages, UNKNOWN], object)
            points = np.append(0, np.cumsum((text.data & 0xC0) != 0x80))
            origin = points[text.offsets[:-1]][owner[first]]
            offsets = np.append(0, np.cumsum(np.bincount(owner[first], minlength=n))).astype(np.int32)
            spans = pa.StructArray.from_arrays(
                [pa.array((points[starts[first]] - origin).astype(np.int64)),
                 pa.array((points[ends[last]] - origin).astype(np.int64)), pa.array(names[label[first]], pa.string())],
                names=["start", "end", "lang"])
            yield pa.record_batch({"id": part.column("id"), "letters": part.column("letters"),
                                   "lang_pred": pa.array(names[best], pa.string()), "score": pa.array(share),
                                   "spans": pa.ListArray.from_arrays(pa.array(offsets), spans)})

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             options: Identifier = Identifier()) -> DataFrame:
    """The id, ``lang_pred``, ``score`` (share of the words' bytes in that language) and ``spans`` of each row.

    ``lang_pred`` is ``und``, the score 0 and the spans none where the text is null or has no letter, and everywhere if
    the model knows no language.  Ties go to the language first in the alphabet.  Spans are runs of words with one
    label, in code points, end exclusive.  Other columns are ignored; an empty table gives an empty result.
    """
    body = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    rows = docs.select(quoted(id_col).alias("id"), body.alias("body"), body.rlike(r"\p{L}").alias("letters"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = rows.mapInArrow(_label(shared, options.bits), f"id {kind}, letters boolean, lang_pred string, score double, "
                            "spans array<struct<start:long,end:long,lang:string>>")
    known = lambda value, other: F.when(F.col("letters"), value).otherwise(other)
    return found.select(F.col("id").alias(id_col), known(F.col("lang_pred"), F.lit(UNKNOWN)).alias("lang_pred"),
                        known(F.col("score"), F.lit(0.0)).alias("score"),
                        known(F.col("spans"), F.filter("spans", lambda s: F.lit(False))).alias("spans"))


def held_out(id_col: str = "doc_id"):
    """Rows kept from training: a quarter, by the CRC-32 of the id's text."""
    return F.crc32(quoted(id_col).cast("string")) % 4 == 2
