"""Connected components of a link table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablegauge.llm.shared import cut_lineage


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """One step of the alternating star contraction.

    Every node hands its neighbours to the smallest of them and itself: the larger neighbours only, or else the
    smaller ones and itself.  Both keep the components and shorten the paths.
    """
    if larger:
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            least.select("a", F.col("m").alias("b")))
    return moved.filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of a link.

    ``links`` has longs ``a`` and ``b``.  The number of rounds grows with the logarithm of the longest path.
    """
    links = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    while True:
        links = cut_lineage(_star(_star(links, larger=True), larger=False))
        # At rest when every node points to one root: the links are then the same as a round before.
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        roots.select("node", F.col("node").alias("root")))
