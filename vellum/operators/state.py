"""The tables that one run leaves to the next, bucketed by work_id, and the next run's decisions from them without an exchange."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import runs

KEY = "work_id"


def _plain(name: str) -> str:
    if not re.fullmatch(r"[a-z][a-z0-9_]*", name):
        raise ValueError(f"a table's name must be plain: {name}")
    return name


def write_state(rows: DataFrame, name: str, root: str, buckets: int = 256) -> DataFrame:
    """rows as the table ``name`` in a new folder of ``root``, a sorted file for each bucket of work_id; the table.

    Tables that are to join without an exchange need the same number of buckets, which should grow with the table: a file of
    some 200 MB a bucket. The number is written last, so a folder that lacks it is not whole and attach_state refuses it."""
    spark, folder = rows.sparkSession, f"{root.rstrip('/')}/{_plain(name)}"
    dealt = rows.repartition(buckets, KEY).write.format("parquet").bucketBy(buckets, KEY).sortBy(KEY).option("path", f"{folder}/rows")
    spark.sql(f"DROP TABLE IF EXISTS {name}")  # only the name: the folder of an earlier table stays
    dealt.mode("errorifexists").saveAsTable(name)
    spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.json(f"{folder}/buckets")
    return spark.table(name)


def attach_state(spark: SparkSession, name: str, root: str) -> DataFrame:
    """The table that an earlier session wrote, under the same name in this session's catalog.

    Its number of buckets is read from the folder: with another one, rows would be looked for in the wrong files."""
    folder = f"{root.rstrip('/')}/{_plain(name)}"
    buckets = spark.read.schema("buckets int").json(f"{folder}/buckets").first()["buckets"]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{folder}/rows").schema)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    place = f"{folder}/rows".replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def next_run(targets: DataFrame, previous: DataFrame, intact: DataFrame, fetched: DataFrame) -> DataFrame:
    """(work_id, decision, pending, path, outcome, attempts): a row a target, with what is reused, whether it is still to do,
    and which source was taken once its fetches are known (null before).

    Over tables bucketed alike it is one stage: each task reads a bucket of every table."""
    decided = runs.reuse_previous(targets, previous, intact).select(KEY, "decision")
    left = runs.pending_targets(targets.select(KEY), previous, intact).select(KEY, F.lit(True).alias("pending"))
    picked = runs.pick_source(runs.fetch_outcome(fetched, targets, previous))
    j = decided.join(left, KEY, "left").join(picked, KEY, "left")
    return j.select(KEY, "decision", F.coalesce("pending", F.lit(False)).alias("pending"), "path", "outcome", "attempts")
