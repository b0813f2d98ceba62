"""Repeatable samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tablegauge.functions.missing import quoted

DEFAULT_SAMPLE = 200_000
DEFAULT_SEED = 42
_DIGITS = 4                        # hex digits counted at a time
_FEW = 10_000                      # digests that are sorted on the driver


def exact_sample(df: DataFrame, n: int, id_cols: Sequence[str], seed: int = DEFAULT_SEED) -> DataFrame:
    """Exactly ``n`` rows (all of them if there are no more), the same ones on every run.

    The sample holds the rows with the smallest digests of their ids.  The largest digest that belongs to it is
    found by counting: rows per beginning of the digest, then per longer beginning within the one where the sample
    ends, until few are left.  Taking the rows up to it is a filter, whatever the size of the sample.  Of rows with
    equal ids at the very end, any fill it up.
    """
    if n <= 0:
        return df.limit(0)
    digest = F.md5(F.concat_ws("-", *[quoted(c).cast("string") for c in id_cols], F.lit(str(seed))))
    keyed = df.withColumn("__digest", digest)
    prefix, wanted = "", n
    while True:
        start = F.substring("__digest", 1, len(prefix) + _DIGITS)
        inside = keyed.where(F.col("__digest").startswith(prefix)) if prefix else keyed
        # At most 16 ** _DIGITS lines.
        counts = sorted(inside.groupBy(start.alias("start")).agg(F.count(F.lit(1)).alias("rows")).collect())
        if not prefix and sum(r["rows"] for r in counts) <= n:
            return df
        for line in counts:
            if line["rows"] >= wanted:
                break
            wanted -= line["rows"]
        prefix = line["start"]
        if line["rows"] <= _FEW or len(prefix) >= 32:
            break
    inside = keyed.where(F.col("__digest").startswith(prefix))
    if line["rows"] == wanted or len(prefix) >= 32:
        last, ties, wanted = prefix + "g" * (32 - len(prefix)), 0, wanted
        if len(prefix) >= 32:
            last, ties = prefix, line["rows"]
    else:
        tail = sorted(r[0] for r in inside.select("__digest").collect())
        last = tail[wanted - 1]
        ties, wanted = tail.count(last), wanted - sum(d < last for d in tail)
    below = keyed.where(F.col("__digest") < F.lit(last))
    if ties:
        equal = keyed.where(F.col("__digest") == F.lit(last))
        below = below.unionByName(equal if ties == wanted else equal.limit(wanted))
    return below.drop("__digest")


def fraction_sample(df: DataFrame, n: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """About ``n`` rows without a sort; the size is approximate."""
    total = df.count()
    return df if total <= n else df.sample(fraction=n / total, seed=seed)
