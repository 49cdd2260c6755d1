"""Connected components by repeated hooking to smaller neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import join_hot, stored

MAX_ROUNDS = 60


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least_neighbours(links: DataFrame) -> DataFrame:
    """``a``, the least of itself and its neighbours, and its number of neighbours."""
    least = F.min("b").alias("least")
    return links.groupBy("a").agg(least, F.count(F.lit(1)).alias("degree")).withColumn("least", F.least("a", "least"))


def _round(links: DataFrame) -> DataFrame:
    """Large star, then small star: larger neighbours, then smaller ones, are linked to the least instead."""
    both = _both_ways(links)
    large = join_hot(both.filter("b > a"), _least_neighbours(both), ["a"], "degree", 2 * links.count(), "inner")
    large = large.select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a > b").distinct()
    large = stored(large, "large-star")
    smaller = large.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("degree"))
    small = join_hot(large, smaller, ["a"], "degree", large.count(), "inner")
    hooked = small.filter("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return hooked.unionByName(smaller.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``a, root`` for every linked ``a`` that is not the least of its component; links are pairs ``a, b``.

    Each round is stored, so a lost executor costs a round. The driver sees two numbers a round. Links of a node to
    itself and repeated links change nothing; without links there are no rows.
    """
    current = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = stored(current.distinct(), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            return current.select("a", F.col("b").alias("root"))
        before = mark
        current = stored(_round(current), "links")
    raise RuntimeError("components did not settle")
