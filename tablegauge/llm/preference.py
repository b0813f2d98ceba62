"""Preference pairs of conversations as one prompt and two masked completions.

The prompt is the longest common prefix of turns, rendered once; what follows is rendered for either side.  The mask of
a completion marks the text that assistants wrote: only that is learned.  DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tablegauge.functions.missing import quoted


@dataclass(frozen=True)
class Template:
    """How a turn reads: ``<|role|>`` and a line break, the text, and the end mark with a line break."""

    before: str = "<|"
    after: str = "|>\n"
    end: str = "<|end|>\n"
    learned: str = "assistant"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """``conv`` and ``turns``, an array of role and text in the order of the turn numbers (null ones first).

    A null role reads ``user``, a null text is empty; rows without an id belong to no conversation.  Turns with one
    number are ordered by role and text; a row that is there twice counts once.
    """
    rows = turns.filter(quoted(id_col).isNotNull()).select(
        quoted(id_col).alias("conv"), quoted(turn_col).alias("turn"),
        F.coalesce(quoted(role_col).cast("string"), F.lit("user")).alias("role"),
        F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    listed = rows.groupBy("conv").agg(F.array_sort(F.array_distinct(
        F.collect_list(F.struct("turn", "role", "text")))).alias("t"))
    return listed.select("conv", F.expr("transform(t, x -> named_struct('role', x.role, 'text', x.text))").alias("turns"))


def reference_pairs(convs: DataFrame) -> DataFrame:
    """Pairs among conversations that open alike: the one with the smallest id is chosen over each other.

    As many pairs as conversations, less one for each opening.
    """
    keyed = convs.select("conv", F.sha2(F.to_json(F.expr("named_struct('r', turns[0].role, 't', turns[0].text)")), 256).alias("opening"))
    first = keyed.groupBy("opening").agg(F.min("conv").alias("chosen"))
    # The changed key makes Spark deal both sides out, so that a very common opening can be split.
    first = first.select(F.reverse("opening").alias("k"), "chosen")
    return keyed.withColumn("k", F.reverse("opening")).join(first, "k").filter("conv != chosen").select(
        "chosen", F.col("conv").alias("rejected"))


def _rendered(turns: str, template: Template) -> str:
    """The turns of an array (SQL) one after another."""
    return (f"array_join(transform({turns}, x -> concat('{template.before}', x.role, '{template.after}', x.text, "
            f"'{template.end}')), '')").replace("\n", "\\n")


def _mask(turns: str, template: Template) -> str:
    """``start:end`` of what is learned in the rendered turns (SQL), in code points: the text and its end mark."""
    fixed = len(template.before) + len(template.after)
    end = len(template.end)
    return f"""aggregate({turns}, named_struct('at', 0, 'spans', cast(array() as array<string>)),
        (acc, x) -> named_struct(
            'at', acc.at + {fixed + end} + length(x.role) + length(x.text),
            'spans', if(x.role = '{template.learned}', array_append(acc.spans, concat(
                acc.at + {fixed} + length(x.role), ':', acc.at + {fixed + end} + length(x.role) + length(x.text))),
                acc.spans)),
        acc -> array_join(acc.spans, ','))"""


def swapped_replies(convs: DataFrame, template: Template = Template()) -> DataFrame:
    """Pairs from single conversations: the last reply as it is, or the latest earlier reply that differs from it instead.

    ``chosen_id``, ``rejected_id`` (the same), and the turns of both; conversations with fewer than two different
    replies give none.
    """
    at = f"filter(sequence(1, size(turns)), i -> turns[i - 1].role = '{template.learned}')"
    two = convs.filter("size(turns) > 0").select("conv", "turns", F.expr(at).alias("at")).filter("size(at) > 1")
    two = two.select("conv", "turns", "at", F.expr("at[size(at) - 1]").alias("last"))
    other = "array_max(filter(at, i -> turns[i - 1] != turns[last - 1]))"
    two = two.select("conv", "turns", "last", F.expr(other).alias("other"))
    return two.filter("other is not null").select(
        F.col("conv").alias("chosen_id"), F.col("conv").alias("rejected_id"), F.expr("slice(turns, 1, last)").alias("c"),
        F.expr("concat(slice(turns, 1, last - 1), array(turns[other - 1]))").alias("r"))


def paired_turns(convs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``chosen_id``, ``rejected_id`` and the turns of both, for pairs of conversations.

    Pairs that name an unknown conversation give no row; a repeated pair gives repeated rows.
    """
    # The hash beside the id makes Spark deal both sides out, so that one that is often chosen can be split.
    left = convs.select(F.xxhash64("conv").alias("h"), F.col("conv").alias("chosen_id"), F.col("turns").alias("c"))
    right = convs.select(F.col("conv").alias("rejected_id"), F.col("turns").alias("r"))
    return (pairs.select(F.col("chosen").alias("chosen_id"), F.col("rejected").alias("rejected_id"))
            .join(right, "rejected_id").withColumn("h", F.xxhash64("chosen_id")).join(left, ["h", "chosen_id"]).select("chosen_id", "rejected_id", "c", "r"))


def format_pairs(both: DataFrame, template: Template = Template()) -> DataFrame:
    """A row for each pair of ``paired_turns``: ``chosen_id``, ``rejected_id``, ``n_prompt`` (turns), ``prompt``,
    ``chosen``, ``chosen_mask``, ``rejected``, ``rejected_mask``.

    A conversation that the other one continues has an empty completion and mask.
    """
    # The prefix ends before the first place where the two differ.
    shorter = "least(size(c), size(r))"
    common = (f"coalesce(array_min(filter(sequence(0, {shorter}), i -> i = {shorter} or not (get(c, i) <=> get(r, i)))), 0)")
    cut = both.select("chosen_id", "rejected_id", "c", "r", F.expr(common).alias("n"))
    cut = cut.select("chosen_id", "rejected_id", "n", F.expr("slice(c, 1, n)").alias("p"),
                     F.expr("slice(c, n + 1, size(c))").alias("c"), F.expr("slice(r, n + 1, size(r))").alias("r"))
    return cut.select(
        "chosen_id", "rejected_id", F.col("n").cast("long").alias("n_prompt"), F.expr(_rendered("p", template)).alias("prompt"),
        F.expr(_rendered("c", template)).alias("chosen"), F.expr(_mask("c", template)).alias("chosen_mask"),
        F.expr(_rendered("r", template)).alias("rejected"), F.expr(_mask("r", template)).alias("rejected_mask"))

