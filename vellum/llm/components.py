"""Connected components by alternating large and small stars, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vellum.llm.common import written


def _settled(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges as a table, with their count and a checksum, both taken while it is written."""
    seen = Observation()
    table = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("sum")))
    return table, (seen.get["n"], seen.get["sum"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b): each node of the undirected ``edges`` (a, b) but the smallest of its component, with that smallest.

    A round sends each node's larger neighbours, then its smaller ones, to the smallest; distances shrink by halves,
    so the rounds grow with the logarithm of the longest chain. Each round is written to the shared folder, and only
    a count and a checksum reach the driver. Loops and null ends are no edges; an empty table gives an empty one.
    """
    now, before = _settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        if not before[0]:
            return now
        both = now.unionAll(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        now, after = _settled(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b"))).distinct())
        if after == before:
            return now
        before = after
    raise RuntimeError(f"components are not settled after {rounds} rounds")
