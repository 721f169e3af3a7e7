"""A stored index of the search catalog: positional postings of characters and character pairs, beside the works themselves.

Both tables are partitioned: postings by a checksum of the gram, works by one of the ID. A search reads the partitions
of its own grams, and of the works it found.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields that are searched, in order of rank; the title's three ranks tell how much of it a query is.
FIELDS = ("title", "subtitle", "people", "title_reading", "readings")
RANKS = (3, 4, 5, 6, 6)
SORTS = {"relevance": ["rank"], "title": ["sort_reading"], "author": ["people"]}


def _bucket(c: Column | str, buckets: int) -> Column:
    return (F.crc32(c) % buckets).cast("int")


def postings(catalog: DataFrame) -> DataFrame:
    """(gram, field, work_id, at, size): each character and each pair of neighbours of a field, where it stands from 0, and how long the field is."""

    def grams(c: Column) -> Column:
        chars = F.split(c, "")
        one = F.transform(chars, lambda g, i: F.struct(g.alias("gram"), i.alias("at"), F.size(chars).alias("size")))
        two = F.transform(F.arrays_zip(chars.alias("a"), F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))).alias("b")), lambda p, i: F.struct(F.concat(p["a"], p["b"]).alias("gram"), i.alias("at"), F.size(chars).alias("size")))
        return F.concat(one, F.filter(two, lambda g: g["gram"].isNotNull()))

    each = F.array(*(F.struct(F.lit(i).cast("tinyint").alias("field"), F.col(c).alias("text")) for i, c in enumerate(FIELDS)))
    rows = catalog.select("work_id", F.explode(each).alias("f")).select("work_id", "f.*").where("text <> ''")
    return rows.select("work_id", "field", F.explode(grams(F.col("text"))).alias("g")).select("g.gram", "field", "work_id", "g.at", "g.size")


def write_search_index(catalog: DataFrame, path: str, buckets: int = 64, files: int = 4) -> None:
    """The index of a search catalog under a path, in place of one that was there.

    A bucket's postings are dealt to ``files`` tasks by work, so a character that stands in every title fills no task alone;
    within a file they are sorted by gram, so that files are skipped inside a bucket too.
    """
    dealt = postings(catalog).withColumn("bucket", _bucket("gram", buckets)).repartition("bucket", F.pmod(F.xxhash64("work_id"), F.lit(files)))
    dealt.sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    works = catalog.withColumn("part", _bucket("work_id", buckets))
    works.repartition("part").sortWithinPartitions("part", "work_id").write.mode("overwrite").partitionBy("part").option("compression", "zstd").parquet(f"{path}/works")


def index_hits(spark: SparkSession, path: str, query: str, buckets: int = 64) -> DataFrame:
    """(work_id, rank) of the works that hold the query in a field.

    A place holds the query where each of its pairs stands at its own distance from there, so the intersection of the
    posting lists is exact and no text is read."""
    text = query.strip()
    grams = [text] if len(text) == 1 else [text[i : i + 2] for i in range(len(text) - 1)]
    read = spark.read.parquet(f"{path}/postings")
    if not grams:
        return read.where("false").select("work_id", F.lit(0).alias("rank"))
    places: dict[str, list[int]] = {}
    for i, g in enumerate(grams):
        places.setdefault(g, []).append(i)
    wanted = sorted({zlib.crc32(g.encode()) % buckets for g in places})
    offsets = F.coalesce(*(F.when(F.col("gram") == g, F.array(*map(F.lit, at))) for g, at in places.items()))
    mine = read.where(F.col("bucket").isin(wanted) & F.col("gram").isin([*places]))
    starts = mine.select("work_id", "field", "size", F.col("at"), F.explode(offsets).alias("i")).withColumn("start", F.col("at") - F.col("i"))
    whole = starts.groupBy("work_id", "field", "start").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size")).where(F.col("n") == len(grams))
    of_title = F.when((F.col("start") == 0) & (F.col("size") == len(text)), 1).when(F.col("start") == 0, 2).otherwise(3)
    rank = F.when(F.col("field") == 0, of_title).otherwise(F.element_at(F.array(*map(F.lit, RANKS)), F.col("field") + 1))
    return whole.groupBy("work_id").agg(F.min(rank).alias("rank"))


def search_index(spark: SparkSession, path: str, query: str, *, author: str | None = None, orthography: str | None = None, classification: str | None = None, sort: str = "relevance", k: int = 50, buckets: int = 64) -> DataFrame:
    """search_catalog's rows from a stored index of ``buckets`` buckets."""
    hits = index_hits(spark, path, query, buckets).withColumn("part", _bucket("work_id", buckets))
    found = spark.read.parquet(f"{path}/works").join(hits, ["part", "work_id"])
    if author is not None:
        found = found.where(F.exists(F.split("people", r"\|"), lambda p: p == f"author:{author}"))
    for c, v in (("orthography", orthography), ("classification", classification)):
        if v is not None:
            found = found.where(F.col(c) == v)
    return found.orderBy(*SORTS[sort], "sort_reading", "work_id").limit(k).select("rank", "work_id", "title", "people")
