"""Registered queries of the operators in this package, each over its whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablegauge.llm import (
    decontaminate, language, nearjoin, negatives, neighbours, packing, prefixtrie, preference, secrets, substrings, tokenfiles, toxicity,
    warc,
)
from tablegauge.llm.shared import new_folder, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE_RULES))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(rule.kind).alias(f"n_{rule.kind}") for rule in secrets.BASE_RULES],
        F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeated_windows(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                      options=decontaminate.Templates(verbatim=True)).select(
        "doc_id", F.col("item").alias("item_id"), "n_windows", "n_changed")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    found = toxicity.tag_toxicity(docs, model)
    # A null id has no remainder; such a row could not have been matched to a label either.
    return found.select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score", "predicted",
                        F.size("spans").alias("n_spans"))


def op6_cross_polytope_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_tokenizer()).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = preference.conversations(table(spark, sf_dir, "conversations"))
    alike = preference.paired_turns(convs, preference.reference_pairs(convs))
    return preference.format_pairs(preference.swapped_replies(convs).unionAll(alike))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select(
        F.expr("try_cast(page as long)").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.expr("try_cast(refers as long)").alias("refers_to"), "n_segments", "intact")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(~language.held_out()))
    found = language.identify(docs, model)
    return found.select("doc_id", F.coalesce(language.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score",
                        F.size("spans").alias("n_spans"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    tokenfiles.write_token_files(table(spark, sf_dir, "documents"), path, word_tokenizer())
    return tokenfiles.read_token_files(spark, path)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))


def _secret_sql() -> str:
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = []
    for rank, rule in enumerate(secrets.RULES):
        p = quote(rule.pattern)
        kinds.append(
            f"SELECT doc, {rank} AS rank, '{rule.kind}' AS kind, i, "
            "list_sum(list_transform(gaps[1:i], lambda x: length(x))) "
            "+ coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s, "
            f"length(hits[i]) AS n, length(vals[i]) >= {rule.least} AS ok FROM ("
            "SELECT doc, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS i FROM ("
            f"SELECT doc, regexp_split_to_array(body, {p}) AS gaps, regexp_extract_all(body, {p}, 0) AS hits, "
            f"regexp_extract_all(body, {p}, {rule.group}) AS vals FROM docs WHERE regexp_matches(body, {p})))")
    text = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT)"
    n_base = len(secrets.BASE_RULES)
    counts = ", ".join(f"count(CASE WHEN kind = '{r.kind}' THEN 1 END) AS n_{r.kind}" for r in secrets.BASE_RULES)
    return (
        "WITH docs AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS body FROM documents), "
        f"found AS ({' UNION ALL '.join(kinds)}) "
        f"SELECT any_value(doc_id) AS doc_id, {counts}, "
        f"sha256(coalesce(string_agg({text}, ',' ORDER BY s, rank) FILTER (WHERE rank < {n_base}), '')) AS base_sha256, "
        f"coalesce(string_agg({text}, ',' ORDER BY s, rank), '') AS spans "
        "FROM docs LEFT JOIN (SELECT * FROM found WHERE ok) f USING (doc) GROUP BY doc")


def _negatives_sql() -> str:
    m = negatives.Mining()
    return f"""
WITH r AS (SELECT DISTINCT vec_id, label AS raw, embedding FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(
             embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(floor({m.scale} * x::DOUBLE)) < {negatives.LIMIT}))),
u AS (SELECT vec_id, CASE WHEN vec_id % {m.shift_every} = 0 THEN ((raw + 1) % {m.labels} + {m.labels}) % {m.labels}
             ELSE raw END AS label, list_transform(embedding, lambda x: floor({m.scale} * x::DOUBLE)::BIGINT) AS q FROM r),
s AS (SELECT a.vec_id AS anchor_id, a.label AS al, b.vec_id, b.label,
             list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
      FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % {m.anchor_every} = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS ps FROM (
        SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE label = al)
      WHERE k <= {m.positives}),
n AS (SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.ps, s.score AS ns,
             row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.al
                   AND {m.low} * p.ps <= 100 * s.score AND 100 * s.score <= {m.high} * p.ps)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, ps AS positive_score, ns AS negative_score
FROM n WHERE rank <= {m.negatives}"""


def _preference_sql() -> str:
    t = preference.Template()
    line = lambda x: x.replace("\n", "' || chr(10) || '")
    turn = f"'{line(t.before)}' || x.role || '{line(t.after)}' || x.text || '{line(t.end)}'"
    text = lambda a: f"array_to_string(list_transform({a}, lambda x: {turn}), '')"
    fixed, end = len(t.before) + len(t.after), len(t.end)
    before = lambda a: (f"coalesce(list_sum(list_transform({a}[1:i - 1], lambda y: "  # noqa: E731
                        f"{fixed + end} + length(y.role) + length(y.text))), 0)::BIGINT")
    mask = lambda a: (
        f"array_to_string(list_transform(list_filter(range(1, len({a}) + 1), lambda i: {a}[i].role = '{t.learned}'), "
        f"lambda i: ({before(a)} + {fixed} + length({a}[i].role)) || ':' || "
        f"({before(a)} + {fixed + end} + length({a}[i].role) + length({a}[i].text))), ',')")
    return f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS turns
      FROM t GROUP BY conv_id),
k AS (SELECT conv_id, turns, min(conv_id) OVER (PARTITION BY turns[1]) AS head FROM c),
s AS (SELECT conv_id, turns, list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = '{t.learned}') AS pos FROM c),
b AS (SELECT conv_id AS chosen_id, conv_id AS rejected_id, turns[1:pos[-1]] AS c,
             list_concat(turns[1:pos[-1] - 1], [turns[pos[-2]]]) AS r
      FROM s WHERE len(pos) > 1 AND turns[pos[-1]] <> turns[pos[-2]]
      UNION ALL SELECT k.head, k.conv_id, a.turns, k.turns FROM k JOIN c a ON a.conv_id = k.head WHERE k.conv_id <> k.head),
n AS (SELECT *, list_min(list_filter(range(0, least(len(c), len(r)) + 1), lambda i: i = least(len(c), len(r))
             OR c[i + 1] IS DISTINCT FROM r[i + 1])) AS n FROM b),
m AS (SELECT chosen_id, rejected_id, n, c[1:n] AS p, c[n + 1:] AS c, r[n + 1:] AS r FROM n)
SELECT chosen_id, rejected_id, n AS n_prompt, {text('p')} AS prompt, {text('c')} AS chosen, {mask('c')} AS chosen_mask,
       {text('r')} AS rejected, {mask('r')} AS rejected_mask FROM m"""


def registered() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_secret_scan, op2_substring_dedup, op3_benchmark_decontamination, op4_ngram_jaccard_join, op5_toxicity,
                                   op6_cross_polytope_neighbours, op7_best_fit_packing, op8_preference_formatting, op9_warc, op10_language_id,
                                   op11_hard_negatives, op12_token_files,
                                   op13_prefix_trie)}


def oracles() -> dict[str, str]:
    return {"op1_secret_scan": _secret_sql(), "op8_preference_formatting": _preference_sql(),
            "op11_hard_negatives": _negatives_sql()}
