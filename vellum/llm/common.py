"""What the operators share: table reading, cut lineage, renamed columns, bounded labelled samples."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without; it gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: later reads don't need df's own lineage, and survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/vellum-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shielded(df: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """df with its columns named like any of ``names`` (in any case) renamed, and what selects all of df's columns again.

    An operator that only passes a caller's rows on can so use these names itself, and no column of the caller is lost."""
    taken, used = {n.lower() for n in names}, {c.lower() for c in df.columns}

    def free(c: str) -> str:
        while c.lower() in taken or c.lower() in used:
            c += "_"
        used.add(c.lower())
        return c

    now = {c: free(c) if c.lower() in taken else c for c in df.columns}
    return df.select(*(F.col(f"`{c}`").alias(n) for c, n in now.items())), [F.col(f"`{n}`").alias(c) for c, n in now.items()]


def hashed_low(rows: int, n: int, ample: int) -> Column:
    """Whether a doc_id's hash is among the lowest, for about ``ample`` times ``rows`` of ``n`` ids."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, ample * rows / max(n, 1)) * (1 << 30))


def chosen(ids: DataFrame, rows: int, n: int, ample: int = 4) -> DataFrame:
    """At most ``rows`` of the doc_ids, those with the smallest hashes.

    Hashes beyond ``ample`` times the share that is needed of ``n`` ids are left out first, so that the tasks
    together send about that many ids to be ordered, however large the table is."""
    return ids.where(hashed_low(rows, n, ample)).orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id").limit(rows)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable, rows: int, text_bytes: int) -> list[tuple[str, int]]:
    """At most ``rows`` texts of at most ``text_bytes`` bytes with their label, chosen by a hash of doc_id.

    ``usable`` is the condition on doc_id under which a label may be learnt from. Half of the rows at most go to
    each label, so a rare label isn't crowded out. Only this bounded sample reaches the driver; where a label has
    too few short texts among those chosen, its part is smaller.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    # text lengths are bounded after the join, so a quarter more ids are taken than rows are needed
    half = max(rows // 2, 1)
    picked = [chosen(known.where(F.col("label") == k), half + half // 4 + 8, counts[k]) for k in (0, 1) if k in counts]
    if not picked:
        return []
    ids = picked[0].unionAll(picked[1]) if len(picked) > 1 else picked[0]
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").where(F.octet_length("text") <= text_bytes)
    got: dict[int, list[str]] = {0: [], 1: []}
    for r in found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        got[r["label"]].append(r["text"])
    return [(t, k) for k in (0, 1) for t in got[k][:half]]


def appended(df: DataFrame, ddl: str, make: Callable[[], Callable[[pa.RecordBatch], list]], rows: int = 256) -> DataFrame:
    """df with the columns of ``ddl``, computed over Arrow batches; columns of df with those names are replaced.

    ``make`` runs once a task and gives a function from a batch of at most ``rows`` rows to the new columns (lists
    or Arrow arrays). Other columns pass through untouched, so nulls and large integers keep their value.
    """
    new = StructType.fromDDL(ddl)
    taken = {n.lower() for n in new.names}
    kept = [f for f in df.schema if f.name.lower() not in taken]
    types = [f.type for f in to_arrow_schema(new)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                piece = batch.slice(at, rows)
                made = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(function(piece), types, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in names] + made, names=[*names, *new.names])

    return df.mapInArrow(run, StructType(kept + list(new)))
