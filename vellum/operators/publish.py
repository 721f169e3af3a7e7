"""Size-bounded shards, and releases that are there whole or not at all.

A release is staged under a folder of its attempt, checked from the files as they lie there, and committed by one row in the
table of releases. Readers go by that table, so an attempt that dies at any point changes nothing; what it left is swept later.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.operators.release import validate_release
from vellum.sources.scratch import fresh_folder

RELEASE = "release bigint, attempt string, files bigint, bytes bigint, digest string"
FILES = "path string, bytes bigint, sha256 string"


class Refused(Exception):
    """A staged release that may not go out; the problems are in its text."""


def bounded_shards(rows: DataFrame, order: str, value: Column, limit: int) -> DataFrame:
    """(order, value, bytes, shard, code): texts dealt in order to shards whose lines, line ends included, are ``limit`` bytes at most.

    A shard takes the texts that begin within its stretch of the running total. A stretch is as much shorter than the limit as
    the longest text is long, so the one that goes over a stretch's end still fits. A text beyond the limit is ``too-large``
    and in no shard; a null text is an empty line. Numbers may have gaps where texts are nearly as long as the limit. Texts of equal order keep one place by their content; an order may be null.

    Two levels of sums: within ranges of the order, and over the ranges, of which there are as many as partitions."""
    text = F.coalesce(value, F.lit(""))
    sized = rows.select(F.col(order).alias("o"), text.alias("value")).withColumn("bytes", F.octet_length("value").cast("long") + 1)
    spark, path = rows.sparkSession, fresh_folder(rows.sparkSession)
    # ranges are sampled, so the rows are written with theirs once, and both sums read the same
    sized.repartitionByRange(F.col("o"), F.col("value")).withColumn("r", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path).withColumn("code", F.when(F.col("bytes") > limit, "too-large"))
    good = F.when(F.col("code").isNull(), F.col("bytes")).otherwise(F.lit(0))
    sums = dealt.groupBy("r").agg(F.sum(good).alias("sum"), F.max(good).alias("longest"))
    before = F.coalesce(F.sum("sum").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    ranges = sums.select("r", before.alias("before"), F.max("longest").over(Window.partitionBy()).alias("longest"))
    inside = F.coalesce(F.sum(good).over(Window.partitionBy("r").orderBy("o", "value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("inside", inside).join(ranges, "r")
    shard = F.when(F.col("code").isNull(), F.expr(f"(before + inside) div ({int(limit)} - longest + 1)"))
    return placed.select(F.col("o").alias(order), "value", "bytes", shard.alias("shard"), "code")


def write_shards(shards: DataFrame, order: str, path: str) -> None:
    """bounded_shards' texts, one a line, in a folder and a file for each shard, in order; texts with a code are left out."""
    sound = shards.where("code IS NULL")
    sound.repartition("shard").sortWithinPartitions("shard", order, "value").select("shard", "value").write.partitionBy("shard").text(path)


def stage(files: dict[str, DataFrame], root: str) -> str:
    """Write each part of a release, (folder, value), as gzip texts in a new attempt's folder; its name is returned.

    ``folder`` names the file: the rows of one are one task's and one file's, in the order of their value."""
    attempt = uuid.uuid4().hex
    for part, rows in files.items():
        if not re.fullmatch(r"[a-z][a-z0-9-]*", part):
            raise ValueError(f"a part's name must be plain: {part}")
        lines = rows.select("folder", "value").repartition("folder").sortWithinPartitions("folder", "value")
        lines.write.partitionBy("folder").option("compression", "gzip").text(f"{root}/attempts/{attempt}/{part}")
    return attempt


def staged_files(spark: SparkSession, root: str, attempt: str) -> DataFrame:
    """(path, bytes, sha256) of an attempt's files as they lie there, compressed; paths begin at the part."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/attempts/{attempt}")
    name = F.element_at(F.split("path", f"/attempts/{attempt}/"), -1)
    return found.select(name.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _releases(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(RELEASE).json(f"{root}/releases")


def commit(spark: SparkSession, root: str, attempt: str, refs: DataFrame | None = None, most_files: int = 20_000, most_bytes: int = 25 << 20) -> int:
    """Check a staged attempt and make it the current release; its number is returned, Refused is raised with the problems.

    The list of files is written into the attempt, and the commit is the one row that names it: a job with one task, whose
    file appears when the job ends or not at all. refs: (path, target), files that the release's texts point to. Commits of
    one root are made one after the other; of two at once the later row by attempt is read."""
    folder = f"{root}/attempts/{attempt}"
    staged_files(spark, root, attempt).write.json(f"{root}/manifests/{attempt}")
    files = spark.read.schema(FILES).json(f"{root}/manifests/{attempt}")
    none = spark.createDataFrame([], "path string, target string")
    problems = validate_release(files, refs if refs is not None else none, most_files, most_bytes)
    first = problems.orderBy("problem", "path").limit(20).collect()
    if first:
        raise Refused(f"{folder}: " + ", ".join(f"{p['problem']} {p['path'] or ''} {p['value']}" for p in first))
    bucket = F.pmod(F.xxhash64("path"), F.lit(1 << 16))
    digests = files.groupBy(bucket.alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "path", "sha256"))), "\n"), 256).alias("d"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    whole = digests.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "\n"), 256).alias("digest"))
    last = current(spark, root)
    number = (last["release"] if last else 0) + 1
    row = whole.select(F.lit(number).cast("long").alias("release"), F.lit(attempt).alias("attempt"), "files", "bytes", "digest").coalesce(1)
    row.write.mode("append").json(f"{root}/releases")
    return number


def current(spark: SparkSession, root: str):
    """The row of the current release, or None before the first."""
    try:
        rows = _releases(spark, root).orderBy(F.desc("release"), F.desc("attempt")).limit(1).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return rows[0] if rows else None


def read_release(spark: SparkSession, root: str, part: str) -> DataFrame:
    """(folder, value) of a part of the current release."""
    row = current(spark, root)
    if row is None:
        raise LookupError(f"no release in {root}")
    return spark.read.schema("value string, folder string").text(f"{root}/attempts/{row['attempt']}/{part}")


def check_current(spark: SparkSession, root: str) -> DataFrame:
    """(path, problem): files of the current release that are ``missing``, ``extra`` or ``changed`` against its list."""
    row = current(spark, root)
    listed = spark.read.schema(FILES).json(f"{root}/manifests/{row['attempt']}")
    there = staged_files(spark, root, row["attempt"])
    j = listed.select("path", F.col("sha256").alias("a")).join(there.select("path", F.col("sha256").alias("b")), "path", "full")
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed")
    return j.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def orphans(spark: SparkSession, root: str, keep: int = 2) -> DataFrame:
    """(attempt, files, bytes): attempts that no row of the last ``keep`` releases names, by an anti-join; these may be swept.

    Run it while no attempt is being staged: one that isn't committed yet is an orphan."""
    rows = _releases(spark, root)
    named = rows.orderBy(F.desc("release"), F.desc("attempt")).limit(keep).select("attempt")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/attempts").select("path", "length")
    each = found.groupBy(F.regexp_extract("path", "/attempts/([0-9a-f]{32})/", 1).alias("attempt")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    return each.join(F.broadcast(named), "attempt", "left_anti")  # named: ``keep`` rows


#: What a failed work is told, by code; others give their own name.
MESSAGES = {
    "images-too-large": "the pictures of the work are too large together",
    "image-too-large": "a picture does not fit into a part",
    "too-many-parts": "the pictures of the work need too many parts",
    "work-too-large": "the document does not fit into its file",
    "missing-image": "a picture of the work was not found",
    "invalid-image": "a picture of the work can't be used",
    "invalid-url": "a picture's URL may not be used",
    "file-too-large": "a file of the work is too large as compressed",
    "missing-file": "a file of the work was not written",
}


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"^works/(.*)\.json\.gz$", 1)


def stage_assets(packed: DataFrame, root: str) -> str:
    """Write pack_assets' files, each as a gzip file in a folder of its name; the name of the attempt is returned.

    Bytes are shuffled once, by file. Names of files are those of works and their parts, which are told apart."""
    return stage({"works": packed.select(_name(F.col("path")).alias("folder"), "value")}, root)


def failed_works(budget: DataFrame, files: DataFrame) -> DataFrame:
    """(work_id, code, url): one row a work that can't be packed. budget: image_budget's rows, whose fault goes first; files:
    asset_files' rows."""
    first = budget.where("code IS NOT NULL").select("work_id", F.struct(F.lit(0).alias("rank"), "code", "url").alias("f"))
    then = files.where("code IS NOT NULL").select("work_id", F.struct(F.lit(1).alias("rank"), "code", F.lit(None).cast("string").alias("url")).alias("f"))
    return first.unionByName(then).groupBy("work_id").agg(F.min("f").alias("f")).select("work_id", "f.code", "f.url")


def asset_results(staged: DataFrame, files: DataFrame, failed: DataFrame, most_bytes: int = 25 << 20) -> DataFrame:
    """(work_id, path, images, bytes, sha256, code, message, url): a row for each file as it lies there, compressed, and one for
    each work that failed, which has no path.

    staged: staged_files' rows; files: asset_files' rows; failed: failed_works'. A work of which a file is larger than
    ``most_bytes``, or isn't there, fails as a whole: its files are not listed, and the fault is that of its first such file."""
    there = staged.select(F.regexp_extract("path", "^works/folder=([^/]+)/", 1).alias("name"), "bytes", "sha256")
    sound = files.where("code IS NULL").join(failed.select("work_id"), "work_id", "left_anti")
    j = sound.select("work_id", "n", "path", F.size("urls").alias("images"), _name(F.col("path")).alias("name")).join(there, "name", "left")
    fault = F.when(F.col("sha256").isNull(), "missing-file").when(F.col("bytes") > most_bytes, "file-too-large")
    per = j.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("n", "path", "images", "bytes", "sha256"))).alias("e"), F.min(F.when(fault.isNotNull(), F.struct("n", fault.alias("code")))).alias("f"))
    listed = per.where("f IS NULL").select("work_id", F.explode("e").alias("e")).select("work_id", "e.path", "e.images", "e.bytes", "e.sha256")
    late = per.where("f IS NOT NULL").select("work_id", "f.code", F.lit(None).cast("string").alias("url"))
    message = F.coalesce(*(F.when(F.col("code") == k, v) for k, v in MESSAGES.items()), F.col("code"))
    wrong = failed.select("work_id", "code", "url").unionByName(late).withColumn("message", message)
    return listed.unionByName(wrong, allowMissingColumns=True).select("work_id", "path", "images", "bytes", "sha256", "code", "message", "url")
