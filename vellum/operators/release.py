"""How a candidate differs from what is out, and whether it may go out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators.catalog import FREE


def manifest_diff(previous: DataFrame, candidate: DataFrame) -> DataFrame:
    """(work_id, change, old_bytes, new_bytes) in ID order; digests are compared, no text is carried."""
    cols = ["status", "work_sha256", "work_bytes", "flag", "converter"]
    old = previous.select("work_id", *(F.col(c).alias(f"old_{c}") for c in cols), F.lit(True).alias("was"))
    new = candidate.select("work_id", *cols, F.lit(True).alias("now"))
    j = old.join(new, "work_id", "full")
    change = (
        F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("flag") != F.col("old_flag"), "rights")
        .when((F.col("old_status") == "converted") & (F.col("status") == "failed"), "new-failure").when((F.col("old_status") == "failed") & (F.col("status") == "converted"), "repaired")
        .when(F.col("converter") != F.col("old_converter"), "converter").when(~F.col("work_sha256").eqNullSafe(F.col("old_work_sha256")), F.when(F.col("work_bytes") != F.col("old_work_bytes"), "size").otherwise("content"))
    )
    return j.select("work_id", change.alias("change"), F.col("old_work_bytes").alias("old_bytes"), F.col("work_bytes").alias("new_bytes")).where("change IS NOT NULL").orderBy("work_id")


def tombstones(previous: DataFrame, candidate: DataFrame) -> DataFrame:
    """(work_id, title, author, reason): works that were shippable and no longer are."""
    live = candidate.where((F.col("flag") == FREE) & (F.col("status") == "converted"))
    gone = previous.where((F.col("flag") == FREE) & (F.col("status") == "converted")).join(live, "work_id", "left_anti")
    j = gone.select("work_id", "title", "author").join(candidate.select("work_id", "flag", "status"), "work_id", "left")
    return j.select("work_id", "title", "author", F.when(F.col("flag") != FREE, "rights").when(F.col("status") == "failed", "failed").otherwise("removed").alias("reason"))


def validate_release(files: DataFrame, refs: DataFrame, most_files: int = 20_000, most_bytes: int = 25 << 20) -> DataFrame:
    """(problem, path, value): what keeps files (path, bytes) and refs (path, target) from release; none: it passes."""
    many = files.agg(F.count(F.lit(1)).alias("value")).where(F.col("value") >= most_files).select(F.lit("too-many-files").alias("problem"), F.lit(None).cast("string").alias("path"), "value")
    large = files.where(F.col("bytes") > most_bytes).select(F.lit("file-too-large").alias("problem"), "path", F.col("bytes").alias("value"))
    lost = refs.join(files.select(F.col("path").alias("target")), "target", "left_anti").groupBy(F.col("target").alias("path")).agg(F.count(F.lit(1)).alias("value")).select(F.lit("missing").alias("problem"), "path", "value")
    return many.unionByName(large).unionByName(lost)


def feature_now(features: DataFrame, day: str) -> DataFrame:
    """(feature_id, place): the features of a day (a date in the reader's zone), else the evergreen ones; ended ones go to the archive.

    features: (feature_id, start, end, evergreen); dates are inclusive."""
    d = F.lit(day).cast("date")
    dated = features.where("NOT evergreen")
    current = dated.where((F.col("start") <= d) & (d <= F.col("end"))).select("feature_id", F.lit("current").alias("place"), "start")
    lasting = features.where("evergreen").join(current.select(F.lit(True).alias("any")).limit(1), F.lit(True), "left_anti").select("feature_id", F.lit("evergreen").alias("place"), "start")
    ended = dated.where(F.col("end") < d).select("feature_id", F.lit("archive").alias("place"), "start")
    return current.unionByName(lasting).unionByName(ended).orderBy("place", F.desc("start"), "feature_id").select("feature_id", "place")
