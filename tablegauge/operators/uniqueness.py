"""Repeated values of a column, without gathering the copies of a value in one task.

The keys are counted first; counting combines on the map side, so a value that fills a third of the table is
one row per task after it.  Keys that hold more than 1 / `HOT_KEYS` of the rows are then handled by a broadcast
join (there are fewer than `HOT_KEYS` of them, of at most 65 bytes each), the rest by a shuffle join in which
no key is frequent any more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tablegauge.functions.lineage import cut_lineage
from tablegauge.functions.missing import ident, quoted, value_or_null
from tablegauge.functions.text import NESTED_TYPES, compact_key, encoded

#: Repeated keys of all UNIQUE rules together up to this many (about 45 bytes each) are broadcast, so that no row
#: and no text is shuffled to be marked; beyond it the lines are marked by a shuffle join.
BROADCAST_KEYS = 1_000_000
HOT_KEYS = 10_000
HOT_COPIES = 1_000
SPREAD = 1_000_003
_KEY, _COPIES = "__key", "__copies"


def key_counts(df: DataFrame, name: str) -> DataFrame:
    """``(__key, __copies)`` for every value of the column; missing values are one key."""
    keyed = df.selectExpr(f"{compact_key(name, df.schema[name].dataType)} as {_KEY}")
    return keyed.groupBy(_KEY).agg(F.count(F.lit(1)).alias(_COPIES))


def mark_repeated(df: DataFrame, name: str, flag: str) -> DataFrame:
    """``df`` with a boolean ``flag``: the value of ``name`` occurs more than once.

    The rows are read and shuffled once.  Rows with a hot key are marked by the broadcast join; for the shuffle join
    they get a key of their own that spreads them by their other columns and matches nothing.
    """
    counts = key_counts(df, name)
    repeated = counts.where(F.col(_COPIES) > 1)
    # From the key counts, whose shuffle Spark uses again.
    frequent = counts.selectExpr(
        f"greatest({HOT_COPIES}L, cast(coalesce(sum({_COPIES}), 0) / {HOT_KEYS} as bigint))").scalar()
    hot = repeated.where(F.col(_COPIES) > frequent).select(F.col(_KEY).alias("__hot"), F.lit(True).alias("__is_hot"))
    others = [quoted(c) for c in df.columns if c != name]
    spread = F.pmod(F.xxhash64(*others), F.lit(SPREAD)) + 1 if others else F.lit(1)
    rows = (
        df.selectExpr("*", f"{compact_key(name, df.schema[name].dataType)} as {_KEY}")
        .join(F.broadcast(hot), F.col(_KEY).eqNullSafe(F.col("__hot")), "left")
        .withColumn("__spread", F.when(F.col("__is_hot"), spread).otherwise(F.lit(0)))
    )
    cold = repeated.select(F.col(_KEY).alias("__cold"), F.lit(0).cast("bigint").alias("__none"), F.lit(True).alias("__seen"))
    same = F.col(_KEY).eqNullSafe(F.col("__cold")) & (F.col("__spread") == F.col("__none"))
    marked = F.coalesce("__is_hot", "__seen", F.lit(False)).alias(flag)
    return rows.join(cold, same, "left").select(*map(quoted, df.columns), marked)


# ---------------------------------------------------------------- all UNIQUE rules at once

def digest_key(name: str, dtype: T.DataType) -> Column:
    """32 bytes equal exactly when the values are (SHA-256 of an exact text of the value); null for a missing value.

    Texts and nested values use their grouping key; other types their exact encoding, in which both zeros are one
    value and timestamps keep their microseconds whatever the session's time zone.
    """
    if isinstance(dtype, (T.StringType, T.BinaryType, *NESTED_TYPES)):
        text = f"cast({compact_key(name, dtype)} as string)"
    else:
        text = f"(case when {value_or_null(name, dtype)} is not null then {encoded(ident(name), dtype)} end)"
    return F.unhex(F.sha2(F.expr(text), 256))


def rule_key_counts(lines: DataFrame) -> DataFrame:
    """``(rule, key, __copies)`` from lines ``(rule, key, ...)`` of any number of rules: one shuffle for all of them,
    combined on the map side, so a key that fills a third of the table is one row per task after it."""
    return lines.groupBy("rule", "key").agg(F.count(F.lit(1)).alias(_COPIES))


def mark_repeated_lines(lines: DataFrame, flag: str, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``lines`` (rule, key and anything else) with a boolean ``flag``: the rule's key occurs more than once.

    The keys are counted once for all rules.  If the repeated keys are at most ``broadcast_keys``, they are broadcast
    and the lines are marked where they are: no line is shuffled.  Otherwise the keys with more than 1 / `HOT_KEYS`
    of the lines of all rules are broadcast, and the rest are joined by a shuffle of the lines in which no key is
    frequent any more.  Missing values are one key.
    """
    counts = rule_key_counts(lines.select("rule", "key"))
    repeated = cut_lineage(counts.where(F.col(_COPIES) > 1))
    found = repeated.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum(_COPIES), F.lit(0)).alias("lines")).first()
    same = lambda r, k: (F.col("rule") == F.col(r)) & F.col("key").eqNullSafe(F.col(k))
    names = [quoted(c) for c in lines.columns]
    if found["keys"] <= broadcast_keys:
        marks = repeated.select(F.col("rule").alias("__rule"), F.col("key").alias("__rkey"), F.lit(True).alias("__seen"))
        return lines.join(F.broadcast(marks), same("__rule", "__rkey"), "left").select(
            *names, F.coalesce("__seen", F.lit(False)).alias(flag))
    total = counts.agg(F.sum(_COPIES)).first()[0]
    frequent = max(HOT_COPIES, total // HOT_KEYS)
    hot = repeated.where(F.col(_COPIES) > frequent).select(
        F.col("rule").alias("__hrule"), F.col("key").alias("__hot"), F.lit(True).alias("__is_hot"))
    others = [quoted(c) for c in lines.columns if c not in ("rule", "key")]
    spread = F.pmod(F.xxhash64(*others), F.lit(SPREAD)) + 1 if others else F.lit(1)
    rows = lines.join(F.broadcast(hot), same("__hrule", "__hot"), "left").withColumn(
        "__spread", F.when(F.col("__is_hot"), spread).otherwise(F.lit(0)))
    cold = repeated.where(F.col(_COPIES) <= frequent).select(
        F.col("rule").alias("__crule"), F.col("key").alias("__cold"), F.lit(0).cast("bigint").alias("__none"),
        F.lit(True).alias("__seen"))
    joined = rows.join(cold, same("__crule", "__cold") & (F.col("__spread") == F.col("__none")), "left")
    return joined.select(*names, F.coalesce("__is_hot", "__seen", F.lit(False)).alias(flag))
