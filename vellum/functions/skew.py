"""Keys that hold a great share of a table's rows: found by bounded summaries, and joined spread over tasks."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMMARY = "key string, n bigint, total bigint"


def _summarise(most: int) -> Callable:
    """A partition's rows to at most ``most`` counters (Misra and Gries), and one row with the count of all rows.

    A batch's counts are added at once; then the count next after the ``most`` greatest is taken off all, so that each key
    loses at most one ``most + 1``-th of the partition's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        total = 0
        for b in batches:
            total += b.num_rows
            for x in pc.value_counts(b.column(0).drop_null()).to_pylist():
                held[x["values"]] = held.get(x["values"], 0) + x["counts"]
            if len(held) > most:
                off = heapq.nlargest(most + 1, held.values())[-1]
                held = {k: n - off for k, n in held.items() if n > off}
        keys = list(held)
        yield pa.RecordBatch.from_arrays([pa.array([*keys, None], pa.string()), pa.array([*(held[k] for k in keys), 0], pa.int64()), pa.array([0] * len(keys) + [total], pa.int64())], names=["key", "n", "total"])

    return run


def _candidates(rows: DataFrame, key: str, share: float) -> DataFrame:
    """(key, n, total): keys that may hold more than ``share`` of all rows, at most 2 / share of them; n is a lower bound.

    A key above the share keeps more than half of it, as all summaries together lose at most half of the share."""
    if not 0 < share <= 1:
        raise ValueError("share must lie above 0 and be at most 1")
    parts = rows.select(F.col(key).cast("string").alias("key")).mapInArrow(_summarise(int(2 / share)), SUMMARY)
    sums = parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    total = sums.where("key IS NULL").select(F.col("total").alias("all"))  # one row
    return sums.where("key IS NOT NULL").crossJoin(F.broadcast(total)).where(F.col("n") > F.col("all") * (share / 2)).select("key", "n", F.col("all").alias("total"))


def hot_keys(rows: DataFrame, key: str, share: float = 0.01) -> list[str]:
    """Every key that holds more than ``share`` of the rows, null ones counted; some above half of it may come too.

    At most 2 / share keys, so the list may go to the driver. An empty table has none."""
    return sorted(r["key"] for r in _candidates(rows, key, share).select("key").collect())


def frequent_keys(rows: DataFrame, key: str, share: float = 0.01) -> DataFrame:
    """(key, n): the keys, as strings, that hold more than ``share`` of all rows, with their exact counts.

    Only rows of the summaries' candidates are counted, of which there are at most 2 / share; these are broadcast."""
    some = F.broadcast(_candidates(rows, key, share).select("key", "total"))
    exact = rows.select(F.col(key).cast("string").alias("key")).join(some, "key").groupBy("key", "total").agg(F.count(F.lit(1)).alias("n"))
    return exact.where(F.col("n") > F.col("total") * share).select("key", "n")


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: Sequence[str], by: Sequence[str], how: str = "inner", ways: int = 64) -> DataFrame:
    """left joined with right on ``key``, the rows of a hot key spread over ``ways`` by a hash of left's columns ``by``.

    right's rows of a hot key are repeated for each way, all others join as they are, in the same exchange. The rows are
    those of a plain join, whatever ``hot`` names. right should have few rows a key. how: inner or left."""
    if how not in ("inner", "left"):
        raise ValueError("a spread join is inner or left")
    if not hot:
        return left.join(right, key, how)
    way = "way"
    while way in {*left.columns, *right.columns}:
        way += "_"
    of_hot = F.coalesce(F.col(key).cast("string").isin(list(hot)), F.lit(False))
    dealt = left.withColumn(way, F.when(of_hot, F.pmod(F.xxhash64(*by), F.lit(ways))).otherwise(0).cast("int"))
    copies = right.withColumn(way, F.explode(F.when(of_hot, F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [key, way], how).drop(way)
