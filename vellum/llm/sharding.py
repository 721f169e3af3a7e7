"""Rendezvous hashing of stable keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType
from pyspark.sql.window import Window

from vellum.llm.common import shielded, written


def rendezvous_shard(key: Column | str, weights: Sequence[float]) -> Column:
    """The shard, 0 to len(weights) - 1, whose score is highest for this key.

    A shard's score is -weight / ln(u), u in (0, 1) from a hash of key and shard number. A shard that joins only
    takes keys for which it scores highest; all others stay where they are. A null key hashes like any other value.
    Ties, which need equal 53-bit hashes, go to the lower shard.
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("every shard needs a positive weight")
    key = F.col(key) if isinstance(key, str) else key

    def score(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(float(2**53))
        return F.struct((F.lit(-float(weight)) / F.ln(u)).alias("score"), F.lit(-shard).alias("shard"))

    best = F.greatest(*(score(s, w) for s, w in enumerate(weights))) if len(weights) > 1 else score(0, weights[0])
    return (-best["shard"]).cast("int")


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], *, shard: str = "shard", slot: str = "slot", buckets: int = 1024) -> DataFrame:
    """df with its shard and a gapless slot, from 0, in that shard.

    Slots are numbered inside ``buckets`` hash buckets a shard and shifted by the rows of the buckets before, so no
    shard is sorted in one task, and slots don't depend on the session. A bucket is chosen by a whole row, so rows
    with a null or frequent key spread; only rows that are equal in every column must share one. df is written once
    with its places, and read from there. An empty df gives an empty result. Columns of df that are named like the
    results are replaced; columns that Spark can't order (maps, variants) are passed on but don't order rows.
    """
    kept = [c for c in df.columns if c.lower() not in (shard.lower(), slot.lower())]
    rows, back = shielded(df.select(*(f"`{c}`" for c in kept)), "_bucket", "_n", "_start", "_at", shard, slot)
    ordered = [f"`{f.name}`" for f in rows.schema if _orderable(f.dataType)]
    part = F.pmod(F.xxhash64(*ordered, F.lit("slot")), F.lit(buckets)).cast("int")
    placed = written(rows.select("*", rendezvous_shard(back[kept.index(key)], weights).alias(shard), part.alias("_bucket")))
    starts = (
        placed.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy(shard, "_bucket").orderBy(*ordered)) - 1
    return placed.withColumn("_at", inside).join(starts, [shard, "_bucket"]).select(*back, shard, (F.col("_start") + F.col("_at")).cast("long").alias(slot))


def _orderable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_orderable(f.dataType) for f in kind)
    return _orderable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, MapType | VariantType)


def shard_documents(docs: DataFrame, shards: int = 40, weights: Sequence[float] | None = None) -> DataFrame:
    """Where each document goes: doc_id, size, text_crc32, law, shard, slot and grown_shard (with one shard more).

    Law ``key``: doc_id and the shard count decide. Size is the text's UTF-8 bytes (null: none) plus 16.
    """
    weights = list(weights or [1.0] * shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous_shard("doc_id", [*weights, 1.0]).alias("grown_shard"),
    )
    return assign_shards(rows, "doc_id", weights).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
