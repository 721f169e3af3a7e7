"""Runs stored by hash buckets with a tree of digests over them, so that a comparison reads only the buckets that differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.release import manifest_diff

#: Hex digits of an ID's digest that name its bucket: 256 of them; each level of the tree drops one.
DIGITS = 2


def _bucket(work_id: Column | str) -> Column:
    return F.substring(F.sha2(work_id, 256), 1, DIGITS)


def digest_tree(records: DataFrame) -> DataFrame:
    """(level, node, digest): a node for each bucket at the lowest level, from digests of whole records in order; then one
    for each prefix of its name, the root last. Nulls and absent records have digests of their own."""
    digest = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256).alias("digest")
    whole = F.sha2(F.to_json(F.struct(*sorted(records.columns)), {"ignoreNullFields": "false"}), 256)
    level = records.groupBy(_bucket("work_id").alias("node")).agg(digest(whole))
    tree = level.select(F.lit(DIGITS).alias("level"), "node", "digest")
    for n in range(DIGITS - 1, -1, -1):
        level = level.groupBy(F.substring("node", 1, n).alias("node")).agg(digest(F.concat_ws("=", "node", "digest")))
        tree = tree.unionByName(level.select(F.lit(n).alias("level"), "node", "digest"))
    return tree


def write_bucketed_run(records: DataFrame, path: str) -> None:
    """The records in folders by bucket, and their tree, in place of what was there. The tree is written last."""
    dealt = records.withColumn("bucket", F.concat(F.lit("x"), _bucket("work_id"))).repartition("bucket").sortWithinPartitions("bucket", "work_id")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/records")
    digest_tree(records).coalesce(1).write.mode("overwrite").parquet(f"{path}/tree")


def differing_buckets(spark: SparkSession, old: str, new: str) -> list[str]:
    """The buckets of two stored runs that differ, found from the root down: a node is looked at only below one that
    differs. At most as many names as there are buckets reach the driver."""
    a, b = (spark.read.parquet(f"{p}/tree").withColumnRenamed("digest", d) for p, d in ((old, "a"), (new, "b")))
    found = [""]
    for level in range(DIGITS + 1):
        nodes = a.where(F.col("level") == level).join(b.where(F.col("level") == level), ["level", "node"], "full")
        below = nodes.where(F.substring("node", 1, max(level - 1, 0)).isin(found) & ~F.col("a").eqNullSafe(F.col("b")))
        found = sorted(r["node"] for r in below.select("node").collect())
        if not found:
            break
    return found


def read_buckets(spark: SparkSession, path: str, buckets: list[str]) -> DataFrame:
    """The records of some buckets of a stored run; no other folder is read."""
    # folders' names begin with a letter, so none is taken for a number
    return spark.read.parquet(f"{path}/records").where(F.col("bucket").isin([f"x{b}" for b in buckets])).drop("bucket")


def stored_diff(spark: SparkSession, old: str, new: str) -> DataFrame:
    """manifest_diff of two stored runs, from the buckets that differ."""
    buckets = differing_buckets(spark, old, new)
    return manifest_diff(read_buckets(spark, old, buckets), read_buckets(spark, new, buckets))


def frozen_buckets(spark: SparkSession, lock: str, fetched: str) -> DataFrame:
    """(lock, fetched) rows, side by side by ID, of the buckets that differ: what a check of frozen inputs has to look at."""
    buckets = differing_buckets(spark, lock, fetched)
    a, b = (read_buckets(spark, p, buckets).select("work_id", F.col("raw_sha256").alias(n), F.lit(True).alias(f"in_{n}")) for p, n in ((lock, "a"), (fetched, "b")))
    j = a.join(b, "work_id", "full")
    problem = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return j.select("work_id", problem.alias("problem")).where("problem IS NOT NULL")
