"""Connected components of a graph given by its links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import held


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root``: for each node of ``links`` (columns ``a``, ``b``) that is not the smallest of its component, that smallest node.

    Each round points a node's larger neighbours, then its smaller ones, at the smallest of them.
    Only minima are gathered (combined before the shuffle), never a node's neighbours, so a node
    may have any number of links. Each half round ends in a checkpoint. Links with a null end or
    from a node to itself are ignored; repeated links count once; no links give no rows.
    """
    state = held(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = None
    while (now := _mark(state)) != before:
        before = now
        state = held(_small_star(held(_large_star(state))))
    return state.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("_least"))
    return (
        both.where("b > a").join(least, "a")
        .select(F.col("b").alias("a"), F.col("_least").alias("b"))
        .where("a <> b").distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("_least"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("_least").alias("b"))
    return moved.union(least).where("a <> b").distinct()
