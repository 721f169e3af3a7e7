"""Running sums over groups of any length: chunks are summed, a second small scan carries the sums, chunks finish on their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = 1 << 16


def running_sum(rows: DataFrame, key: str, order: str, value: Column, before: str, total: str, chunk: int = CHUNK) -> DataFrame:
    """rows with the sum of ``value`` over the rows of their key that come earlier, and over all of them.

    ``order`` is a whole number, different in each row of a key. A key's rows are dealt to tasks by chunks of ``chunk`` numbers,
    so the longest key bounds no task; only a chunk's sum is carried on. One exchange of the rows serves both scans."""
    dealt = rows.withColumn("_chunk", F.floor(F.col(order) / chunk)).withColumn("_value", value).repartition(key, "_chunk")
    sums = dealt.groupBy(key, "_chunk").agg(F.coalesce(F.sum("_value"), F.lit(0)).alias("_sum"))
    along = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(key, "_chunk", F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy(key)).alias(total))
    inside = Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn("_within", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    joined = within.join(carried, [key, "_chunk"]).withColumn(before, F.col("_before") + F.col("_within"))
    return joined.select(*rows.columns, before, total)
