"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question with other values keeps its template.  Windows
of templates are compared by hash join; a match counts if the values that fill the placeholders correspond one to one,
which holds for a verbatim copy as well as for a question asked again with other parameters.  On request, what has too
few plain words for a template is looked for word by word.  DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tablegauge.functions.missing import quoted
from tablegauge.llm.shared import cut_lineage, is_small

# Words that count as a unit when they follow a number.
UNITS = ("km", "cm", "mm", "m", "mi", "miles", "mile", "ft", "feet", "inches", "inch", "kg", "g", "mg", "lb", "lbs",
         "pounds", "tons", "s", "sec", "seconds", "min", "minutes", "h", "hours", "hour", "days", "day", "weeks", "week",
         "months", "years", "year", "l", "ml", "litres", "liters", "mph", "kmh", "percent", "dollars", "euros", "cents",
         "usd", "eur", "degrees", "c", "f", "w", "kw", "v", "hz", "mb", "gb")
# Scripts without blanks between words: where whole items are looked for, each character is a word.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\u30FC\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
# Control characters that mark a placeholder: a number, a name, a unit.
NUMBER, NAME, UNIT = r"\u0001", r"\u0002", r"\u0003"


@dataclass(frozen=True)
class Templates:
    """A window has ``words`` words; ``plain`` of them at least are neither number, name nor unit.

    With ``verbatim``, windows with fewer plain words are found where all words and values are equal, and so is the whole
    of an item with fewer words than a window or in a script without blanks, wherever it stands.
    """

    words: int = 8
    plain: int = 5
    verbatim: bool = False
    #: Benchmark windows up to this number go to every executor (about 20 bytes each); more are joined by shuffle.
    broadcast_rows: int = 500_000


def tokens(text: str, values: bool) -> str:
    """Words of a text (SQL), placeholders alone or followed by the value they stand for.

    A name is a capitalised word after another word or a comma on the same line.  A unit is a listed word after a
    number.  Case and punctuation are dropped, and so are the marks themselves where a text holds them.
    """
    keep = "$0" if values else ""
    t = rf"regexp_replace({text}, r'[\x01-\x03]', '')"
    t = rf"regexp_replace({t}, r'(?<=[\p{{L}},;)]\x20)\p{{Lu}}[\p{{L}}\p{{M}}]*', '{NAME}{keep}')"
    # Possessive: Java's matcher loops instead of recursing once per repetition, so a series of a million numbers
    # is one value, not a stack overflow; with nothing after it, the match is the same as the greedy one.
    t = rf"regexp_replace(lower({t}), r'[0-9]++(?:[.,:/][0-9]++)*+', ' {NUMBER}{keep} ')"
    after = r"(?<=\x01[0-9.,:/]{0,60}\x20{1,2})" if values else r"(?<=\x01\x20{1,2})"
    t = rf"regexp_replace({t}, r'{after}(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])', '{UNIT}{keep}')"
    t = rf"regexp_replace({t}, r'[^\p{{L}}\p{{M}}\p{{N}}\x20\x09-\x0D\x01-\x03]+', '')"
    return rf"filter(split({t}, r'[\x20\x09-\x0D]+'), x -> x != '')"


def words(text: str, unspaced: bool) -> str:
    """Words and values of a text (SQL), as many as ``tokens``, or with each ``UNSPACED`` character a word."""
    t = rf"regexp_replace({text}, r'[\x01-\x03]', '')"
    t = rf"regexp_replace(lower({t}), r'[0-9]++(?:[.,:/][0-9]++)*+', ' $0 ')"
    t = rf"regexp_replace({t}, r'[^\p{{L}}\p{{M}}\p{{N}}\x20\x09-\x0D]+', '')"
    if unspaced:
        t = rf"regexp_replace({t}, r'{UNSPACED}', ' $0 ')"
    return rf"filter(split({t}, r'[\x20\x09-\x0D]+'), x -> x != '')"


def shape(token: str) -> str:
    """A placeholder without its value, any other word as it is."""
    return f"if(ascii({token}) between 1 and 3, left({token}, 1), {token})"


def _window(words: int, array: str, i: str) -> str:
    return f"xxhash64({', '.join(f'{array}[{i} + {j}]' for j in range(words))})"


def _few(options: Templates, array: str, i: str) -> str:
    """Whether a window has too few plain words.  Its first word, whose kind depends on the word before it, is not counted."""
    return " + ".join(f"{array}[{i} + {j}]" for j in range(1, options.words)) + f" < {options.plain}"


def windows(df: DataFrame, key: str, text: str, options: Templates, few: bool = False, sizes: tuple[int, ...] = ()) -> DataFrame:
    """``key``, ``at`` (from 0) and ``h`` of each window.  A text with fewer words is one window of all it has.

    With ``few`` also the windows with few plain words as they are, with ``sizes`` also those of so many words.
    """
    n = options.words
    listed = df.select(key, F.expr(tokens(text, values=False)).alias("tokens"),
                       *([F.expr(words(text, False)).alias("w")] if few else []),
                       *([F.expr(words(text, True)).alias("u")] if sizes else []))
    hashes = (f"case when size(tokens) >= {n} then transform(sequence(0, size(tokens) - {n}), "
              f"i -> {_window(n, 'tokens', 'i')}) "
              "when size(tokens) > 0 then array(xxhash64(concat_ws(' ', tokens))) end")
    if not few and not sizes:
        return listed.select(key, F.posexplode(F.expr(hashes)).alias("at", "h"))
    parts = [f"coalesce(transform({hashes}, (h, i) -> named_struct('at', i, 'h', h)), array())"]
    if few:
        listed = listed.withColumn("p", F.expr("transform(tokens, x -> if(ascii(x) > 3, 1, 0))"))
        parts.append(f"if(size(tokens) >= {n} and size(w) = size(tokens), transform(filter(sequence(0, size(tokens) - {n}), i -> {_few(options, 'p', 'i')}), "
                     f"i -> named_struct('at', i, 'h', xxhash64(0, {_window(n, 'w', 'i')}))), array())")
    for size in sizes:
        parts.append(f"if(size(u) >= {size}, transform(sequence(0, size(u) - {size}), "
                     f"i -> named_struct('at', i, 'h', xxhash64({size}, {_window(size, 'u', 'i')}))), array())")
    return listed.select(key, F.explode(F.expr(f"concat({', '.join(parts)})")).alias("x")).select(key, "x.at", "x.h")


def _benchmark_windows(items: DataFrame, options: Templates) -> DataFrame:
    """``item``, ``at``, ``h``, ``kind``, ``size`` of windows with enough plain words (kind 0).

    The first word of an item appears a second time as a name: inside another sentence it would be taken for one.
    With ``verbatim`` also windows with few plain words (kind 1), and the first words of items to be found whole (kind 2).
    """
    listed = items.select("item", "body", F.expr(tokens("body", values=False)).alias("tokens"))
    renamed = listed.select("item", F.expr(f"concat(array('{NAME}'), slice(tokens, 2, size(tokens)))").alias("tokens"))
    both = listed.select("item", "tokens", F.lit(False).alias("renamed")).unionAll(
        renamed.filter("size(tokens) > 0").select("item", "tokens", F.lit(True)))
    n = f"least({options.words}, size(tokens))"
    cut = both.select("item", "renamed", "tokens", F.expr(
        f"if(renamed, array(0), sequence(0, size(tokens) - {n}))").alias("starts"))
    cut = cut.filter("size(tokens) > 0").select("item", F.explode("starts").alias("at"), "tokens")
    cut = cut.select("item", "at", F.expr(f"slice(tokens, at + 1, {options.words})").alias("w"))
    enough = f"size(filter(w, x -> ascii(x) > 3)) >= least({options.plain}, size(w))"
    found = cut.filter(enough).select("item", "at", F.expr(
        f"case when size(w) >= {options.words} then {_window(options.words, 'w', '0')} "
        "else xxhash64(concat_ws(' ', w)) end").alias("h"), F.lit(0).alias("kind"), F.lit(options.words).alias("size")).distinct()
    if not options.verbatim:
        return found
    as_is = listed.select("item", "tokens", F.expr(words("body", False)).alias("w"), F.expr(words("body", True)).alias("u"))
    few = as_is.filter(f"size(tokens) >= {options.words} and size(w) = size(tokens)").select(
        "item", "tokens", "w", F.explode(F.expr(f"sequence(0, size(tokens) - {options.words})")).alias("at"))
    few = few.filter(f"size(filter(slice(tokens, at + 1, {options.words}), x -> ascii(x) > 3)) < {options.plain}").select(
        "item", "at", F.expr(f"xxhash64(0, {_window(options.words, 'w', 'at')})").alias("h"), F.lit(1), F.lit(options.words))
    whole = as_is.filter(f"size(u) > 0 and (size(tokens) < {options.words} or size(u) != size(tokens))")
    first = "case " + " ".join(
        f"when least(size(u), {options.words}) = {size} then xxhash64({size}, {_window(size, 'u', '0')})"
        for size in range(1, options.words + 1)) + " end"
    return found.unionAll(few).unionAll(whole.select(
        "item", F.lit(0), F.expr(first), F.lit(2), F.expr(f"least(size(u), {options.words})")))


def leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", options: Templates = Templates()) -> DataFrame:
    """Each text that holds a window of a benchmark item: ``text_key`` (xxhash64 of the text), ``item``, ``n_windows``,
    ``n_changed`` (windows whose placeholders hold other values than the item's).

    Null and empty texts and items leak nothing.  Repeated texts are one row, repeated items are one, and of several
    texts under one item id the one with the most windows counts.  An item with fewer words than a window is found only as
    a whole text, and windows with few plain words are not looked for, unless ``verbatim`` asks for both.  An item found
    as a whole counts as a window where no window of it is found.  Empty tables give no rows.
    """
    body = docs.select(quoted(text_col).cast("string").alias("body"))
    body = body.select(F.xxhash64("body").alias("text_key"), "body").filter("body != ''")
    items = benchmark.select(quoted(item_col).alias("id"), quoted(item_text_col).cast("string").alias("body"))
    items = items.filter("body != ''").select(F.xxhash64("id", "body").alias("item"), "id", "body").distinct()
    wanted = cut_lineage(_benchmark_windows(items, options))
    # At most one line a kind and size.
    extra = wanted.filter("kind > 0").select("kind", "size").distinct().collect() if options.verbatim else []
    few, sizes = any(r.kind == 1 for r in extra), tuple(sorted(r["size"] for r in extra if r.kind == 2))
    wanted = wanted.drop("size")
    if is_small(wanted, options.broadcast_rows):
        wanted = F.broadcast(wanted)
    hits = (
        windows(body, "text_key", "body", options, few, sizes).join(wanted.withColumnRenamed("at", "q"), "h")
        .groupBy("text_key", "item").agg(F.collect_set(F.struct("at", "q", "kind")).alias("hits"))
    )
    hits = cut_lineage(hits)
    keys = hits.select("text_key").distinct()
    # Rows with one key are copies (or differ, and then the check below settles it).
    texts = body.join(keys, "text_key").dropDuplicates(["text_key", "body"])
    valued = lambda df, key, name: df.select(
        key, F.expr(tokens("body", values=True)).alias(name),
        F.expr(words("body", False) if few else "array('')").alias(f"{name}w"),
        F.expr(words("body", True) if sizes else "array('')").alias(f"{name}u"))
    paired = (hits.join(valued(texts, "text_key", "d"), "text_key")
              .join(valued(items, "item", "b"), "item"))
    span = f"sequence(0, least({options.words}, size(b)) - 1)"
    at_start = f"if(m.q + j = 0, regexp_replace(get(d, m.at + j), '^{NAME}', ''), get(d, m.at + j))"
    same = f"forall({span}, j -> {shape(at_start)} <=> {shape('get(b, m.q + j)')})"
    slots = (f"transform(filter({span}, j -> ascii(get(b, m.q + j)) between 1 and 3), "
             "j -> named_struct('b', get(b, m.q + j), 'd', get(d, m.at + j)))")
    checked = paired.select("text_key", "item", F.expr(
        f"transform(filter(hits, m -> m.kind = 0 and {same}), m -> {slots})").alias("slots"), F.expr(
        f"size(filter(hits, m -> m.kind = 1 and slice(dw, m.at + 1, {options.words}) = slice(bw, m.q + 1, {options.words})))"
        ).alias("as_is"), F.expr(
        "size(filter(hits, m -> m.kind = 2 and slice(du, m.at + 1, size(bu)) = bu))").alias("wholes"))
    one_to_one = ("size(array_distinct(s)) = size(array_distinct(s.b)) and "
                  "size(array_distinct(s)) = size(array_distinct(s.d))")
    return (
        checked.select("text_key", "item", F.expr(f"filter(slots, s -> {one_to_one})").alias("ok"), "as_is", "wholes")
        .select("text_key", "item", F.expr("if(size(ok) + as_is > 0, size(ok) + as_is, wholes)").cast("long").alias("n_windows"),
                F.expr("size(filter(ok, s -> exists(s, x -> x.b != x.d)))").cast("long").alias("n_changed"))
        .filter("n_windows > 0").join(items.select("item", "id"), "item")
        .groupBy("text_key", F.col("id").alias("item")).agg(F.max("n_windows").alias("n_windows"), F.max("n_changed").alias("n_changed"))
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **kwargs) -> DataFrame:
    """``leaks`` for each row of documents that has any: id, item, windows, changed windows."""
    found = leaks(docs, benchmark, **kwargs)
    text = quoted(kwargs.get("text_col", "text")).cast("string")
    rows = docs.select(quoted(id_col).alias(id_col), F.xxhash64(text).alias("text_key"))
    return rows.join(found, "text_key").drop("text_key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **kwargs) -> DataFrame:
    """The rows of documents without a leak, all columns as they were."""
    found = leaks(docs, benchmark, text_col=text_col, **kwargs).select("text_key").distinct()
    key = F.xxhash64(quoted(text_col).cast("string"))
    return docs.join(found, key == found["text_key"], "left_anti")
