"""Incremental, reversible line dedup: sharded cuckoo filters in front of exact reference counts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from vellum.llm.common import appended, shielded, written

STRIP = b" \t\n\v\f\r"
SLOTS = 4


class CuckooFilter:
    """16-bit fingerprints in buckets of four; each key has two buckets, the other known from one and the fingerprint.

    ``insert`` says whether there was room (callers then grow); ``delete`` needs a key that was inserted.
    """

    def __init__(self, buckets: int = 16, data: bytes | None = None):
        self.table = np.frombuffer(data, np.uint16).copy() if data is not None else np.zeros(buckets * SLOTS, np.uint16)
        self.mask = len(self.table) // SLOTS - 1

    @staticmethod
    def _print(key: int) -> int:
        return (key >> 48 & 0xFFFF) or 1

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _at(self, bucket: int, mark: int) -> int:
        for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if self.table[i] == mark:
                return i
        return -1

    def insert(self, key: int, kicks: int = 200) -> bool:
        mark, bucket = self._print(key), key & self.mask
        for b in (bucket, self._other(bucket, mark)):
            if (i := self._at(b, 0)) >= 0:
                self.table[i] = mark
                return True
        undo = []
        for k in range(kicks):
            i = bucket * SLOTS + (mark + k) % SLOTS
            undo.append((i, int(self.table[i])))
            self.table[i], mark = mark, int(self.table[i])
            bucket = self._other(bucket, mark)
            if (j := self._at(bucket, 0)) >= 0:
                self.table[j] = mark
                return True
        for i, old in reversed(undo):
            self.table[i] = old
        return False

    def delete(self, key: int) -> bool:
        mark, bucket = self._print(key), key & self.mask
        for b in (bucket, self._other(bucket, mark)):
            if (i := self._at(b, mark)) >= 0:
                self.table[i] = 0
                return True
        return False

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys (unsigned 64 bits) may have been inserted; none that was is left out."""
        marks = (keys >> np.uint64(48)).astype(np.int64)
        marks[marks == 0] = 1
        first = (keys & np.uint64(self.mask)).astype(np.int64)
        second = (first ^ (marks * 0x5BD1E995)) & self.mask
        rows = self.table.reshape(-1, SLOTS)
        return (rows[first] == marks[:, None]).any(1) | (rows[second] == marks[:, None]).any(1)

    def room(self, load: float = 0.8) -> int:
        """How many more keys it takes up to that load."""
        return max(0, int(load * len(self.table)) - int(np.count_nonzero(self.table)))

    def extend(self, keys: np.ndarray) -> np.ndarray:
        """Inserts keys: which of them found room. Most are placed at once, the rest one by one."""
        taken, table = np.zeros(len(keys), bool), self.table.reshape(-1, SLOTS)
        marks = (keys >> np.uint64(48)).astype(np.int64)
        marks[marks == 0] = 1
        for second in (False, True):
            left = np.flatnonzero(~taken)
            at = (keys[left] & np.uint64(self.mask)).astype(np.int64)
            if second:
                at = (at ^ (marks[left] * 0x5BD1E995)) & self.mask
            order = np.argsort(at, kind="stable")
            at, left = at[order], left[order]
            nth = np.arange(len(at)) - np.searchsorted(at, at)
            free = np.argsort(table[at] != 0, axis=1, kind="stable")  # a bucket's free slots first
            fits = nth < (table[at] == 0).sum(1)
            table[at[fits], free[fits, nth[fits]]] = marks[left[fits]]
            taken[left[fits]] = True
        for i in np.flatnonzero(~taken).tolist():
            taken[i] = self.insert(int(keys[i]))
        return taken

    @classmethod
    def of(cls, keys: np.ndarray, buckets: int = 16) -> CuckooFilter:
        """A filter of all the keys, at a load of at most four fifths."""
        while True:
            new = cls(buckets)
            if len(keys) <= new.room() and new.extend(keys).all():
                return new
            buckets *= 2


BATCH_COLUMNS = ["shard", "hi", "lo", "refs", "first_doc", "last_doc"]
BATCH = "shard int, hi bigint, lo bigint, refs bigint, first_doc bigint, last_doc bigint"
KEYS = "keys array<struct<hi:bigint,lo:bigint>>, n_lines bigint"


def _normal(text: str | None) -> list[bytes]:
    """Each line's key: stripped of ASCII white space, A-Z lower-cased."""
    return [line.strip(STRIP) for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]


def _long(key: bytes, least: int) -> bool:
    """Whether the key has at least ``least`` code points."""
    return len(key) >= least and (key.isascii() or len(key) >= 4 * least or len(key.decode("utf-8", "surrogatepass")) >= least)


def _digest(key: str) -> tuple[int, int]:
    """The two halves of a key's digest, as the index holds them."""
    d = xxh3_128_digest(key.encode("utf-8", "surrogatepass"))
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _key_batch(texts: list[str | None], least: int) -> list:
    """The columns of KEYS: a text's distinct keys by their digests, and how many lines it has."""
    ends, digests, lines = [0], [], []
    for text in texts:
        keys = _normal(text)
        lines.append(len(keys))
        digests += [xxh3_128_digest(k) for k in set(keys) if _long(k, least)]
        ends.append(len(digests))
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    pairs = pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["hi", "lo"])
    return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs), lines]


def document_keys(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, hi, lo): the 128-bit digests of each document's distinct line keys of at least ``least`` code points."""
    made = appended(docs.select("doc_id", "text"), KEYS, lambda: lambda b: _key_batch(b.column("text").to_pylist(), least))
    return made.select("doc_id", F.explode("keys").alias("k")).select("doc_id", "k.hi", "k.lo")


@dataclass
class LineIndex:
    """What has been inserted: references (hi, lo, doc_id), exact counts (hi, lo, refs, first_doc, last_doc) and one
    cuckoo filter per shard of the key space (shard, filters: a full one is followed by a larger one). places (hi, lo,
    place) says in which of its shard's filters a key is.

    A batch's keys ask the filters first; only those that may be there are looked up in the counts, all others are
    new. Every key that the counts did not hold goes into a filter, also one that was taken for known. Deleting documents takes their references off; keys without any leave counts and filters, so that later
    decisions are those of an index that never saw them.
    """

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    least: int
    places: DataFrame
    bare: bool = False  # nothing has been inserted yet

    @classmethod
    def empty(cls, spark: SparkSession, shards: int | None = None, least: int = 10) -> LineIndex:
        """One task holds one shard's keys at a time, so shards should grow with the keys that are expected (see shards_for)."""
        shards = shards or 64
        return cls(
            spark.createDataFrame([], "doc_id bigint, hi bigint, lo bigint"),
            spark.createDataFrame([], "hi bigint, lo bigint, refs bigint, first_doc bigint, last_doc bigint"),
            spark.createDataFrame([], "shard int, filters array<binary>"),
            shards,
            least,
            spark.createDataFrame([], "hi bigint, lo bigint, place int"),
            bare=True,
        )

    def _shard(self):
        return F.pmod("hi", F.lit(self.shards)).cast("int")

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with these documents' lines. Rows without doc_id hold no reference; a repeated row is one reference more."""
        return self.insert_keys(written(document_keys(docs.where(F.col("doc_id").isNotNull()), self.least)))

    def insert_keys(self, refs: DataFrame) -> LineIndex:
        """The same from the documents' keys (doc_id, hi, lo), a table that is read more than once."""
        batch = refs.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).select(self._shard().alias("shard"), "hi", "lo", "refs", "first_doc", "last_doc")
        if self.bare:  # every key is new
            added = self._added(batch)
            return LineIndex(refs, _keys_of(added), _filters_of(added), self.shards, self.least, _places_of(added))
        keys = written(batch.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_probe, f"{BATCH}, known boolean"))
        old = self.counts.select("hi", "lo", F.col("refs").alias("r"), F.col("first_doc").alias("f"), F.col("last_doc").alias("l"))
        met = written(keys.where("known").join(old, ["hi", "lo"], "left"))
        fresh = keys.where("NOT known").drop("known").unionByName(met.where("r IS NULL").select(*batch.columns))
        added = self._added(fresh)
        more = met.where("r IS NOT NULL").select("hi", "lo", (F.col("refs") + F.col("r")).alias("refs"), F.least("first_doc", "f").alias("first_doc"), F.greatest("last_doc", "l").alias("last_doc"))
        same = self.counts.join(more.select("hi", "lo"), ["hi", "lo"], "left_anti")
        counts = written(_keys_of(added).unionByName(more).unionByName(same.select(*more.columns)))
        return LineIndex(self.refs.unionByName(refs), counts, _filters_of(added), self.shards, self.least, self.places.unionByName(_places_of(added)))

    def _added(self, fresh: DataFrame) -> DataFrame:
        return written(fresh.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_add, f"{BATCH}, place int, filters array<binary>"))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index without these documents; ids that it never saw change nothing."""
        gone = doc_ids.select("doc_id").distinct()
        refs = written(self.refs.join(gone, "doc_id", "left_anti"))
        touched = written(self.refs.join(gone, "doc_id", "left_semi").select("hi", "lo").distinct())
        again = refs.join(touched, ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        counts = written(self.counts.join(touched, ["hi", "lo"], "left_anti").unionByName(again))
        lost = written(touched.join(counts, ["hi", "lo"], "left_anti").join(self.places, ["hi", "lo"]).withColumn("shard", self._shard()))
        filters = written(lost.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_forget, "shard int, filters array<binary>"))
        places = written(self.places.join(lost, ["hi", "lo"], "left_anti"))
        return LineIndex(refs, counts, filters, self.shards, self.least, places)

    def dropped(self) -> DataFrame:
        """(doc_id, keys): the keys whose lines a document loses, as another document holds them first."""
        twice = self.counts.where("first_doc < last_doc").select("hi", "lo", "first_doc")
        return self.refs.join(twice, ["hi", "lo"]).where("doc_id > first_doc").groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias("_keys"))

    def clean(self, docs: DataFrame) -> DataFrame:
        """docs with kept_text, n_lines and n_dropped. A null or empty text is one empty line; rows without doc_id keep all lines."""
        least = self.least
        rows, back = shielded(docs, "_keys")

        def make():
            def apply(batch):
                out = []
                for text, keys in zip(batch.column("text").to_pylist(), batch.column("_keys").to_pylist(), strict=True):
                    lines = (text or "").split("\n")
                    gone = {k["hi"].to_bytes(8, "little", signed=True) + k["lo"].to_bytes(8, "little", signed=True) for k in keys or ()}
                    kept = [x for x, k in zip(lines, _normal(text), strict=True) if not _long(k, least) or xxh3_128_digest(k) not in gone] if gone else lines
                    out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
                return list(zip(*out, strict=True))

            return apply

        made = appended(rows.join(self.dropped(), "doc_id", "left"), CLEANED, make)
        return made.select(*(c for c, name in zip(back, docs.columns, strict=True) if name.lower() not in CLEANED_NAMES), *CLEANED_NAMES)


CLEANED = "kept_text string, n_lines bigint, n_dropped bigint"
CLEANED_NAMES = ("kept_text", "n_lines", "n_dropped")


def _unsigned(t: pa.Table) -> np.ndarray:
    """The low halves of the digests: the high ones chose the shard."""
    return t.column("lo").to_numpy().view(np.uint64)


def _load(filters: pa.Table) -> list[CuckooFilter]:
    return [CuckooFilter(data=x) for x in filters.column("filters")[0].as_py()] if filters.num_rows else []


def _shard_of(keys: pa.Table, filters: pa.Table) -> int:
    return (keys if keys.num_rows else filters).column("shard")[0].as_py()


def _probe(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """Whether each key of a shard may be known."""
    marks = _unsigned(keys)
    known = np.zeros(len(marks), bool)
    for f in _load(filters):
        known |= f.maybe(marks)
    return pa.table({c: keys.column(c) for c in BATCH_COLUMNS} | {"known": pa.array(known, pa.bool_())})


def _add(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """A shard's new keys with the place of the filter that took each, and as a last row the shard's filters.

    Keys that a full filter can't take go to a further one, at least twice as large."""
    new, old = _unsigned(keys), _load(filters)
    places = np.full(len(new), len(old), np.int32)
    if old:
        fit = np.arange(min(old[-1].room(), len(new)))
        places[fit[old[-1].extend(new[fit])]] = len(old) - 1
    rest = new[places == len(old)]
    if len(rest) or not old:
        old.append(CuckooFilter.of(rest, 2 * (old[-1].mask + 1) if old else 16))
    last = lambda column, kind: pa.concat_arrays([*column.chunks, pa.nulls(1, kind)])
    out = {"shard": pa.array(np.full(len(new) + 1, _shard_of(keys, filters), np.int32))}
    out |= {c: last(keys.column(c), pa.int64()) for c in BATCH_COLUMNS[1:]}
    out["place"] = pa.concat_arrays([pa.array(places), pa.nulls(1, pa.int32())])
    out["filters"] = pa.concat_arrays([pa.nulls(len(new), pa.list_(pa.binary())), pa.array([[f.table.tobytes() for f in old]], pa.list_(pa.binary()))])
    return pa.table(out)


def _forget(lost: pa.Table, filters: pa.Table) -> pa.Table:
    """The shard's filters without keys that no document holds any more, each taken from the filter that holds it."""
    old = _load(filters)
    for k, place in zip(_unsigned(lost).tolist(), lost.column("place").to_pylist(), strict=True):
        old[place].delete(int(k))
    return pa.table({"shard": pa.array([_shard_of(lost, filters)], pa.int32()), "filters": pa.array([[f.table.tobytes() for f in old]], pa.list_(pa.binary()))})


def _keys_of(added: DataFrame) -> DataFrame:
    return added.where("filters IS NULL").select("hi", "lo", "refs", "first_doc", "last_doc")


def _filters_of(added: DataFrame) -> DataFrame:
    return added.where("filters IS NOT NULL").select("shard", "filters")


def _places_of(added: DataFrame) -> DataFrame:
    return added.where("filters IS NULL").select("hi", "lo", "place")


def shards_for(keys: int, each: int = 250_000) -> int:
    """Shards of at most about ``each`` keys, so that what one task holds doesn't grow with the table."""
    return max(16, -(-keys // each))


def dedup_lines(docs: DataFrame, least: int = 10, shards: int | None = None, batches: int = 2) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped: keys that at least two documents hold stay only in the first.

    A key is a line, stripped and with A-Z lower-cased, of at least ``least`` code points; a key's lines all stay in
    the smallest doc_id that holds it. The documents go into the index in ``batches`` by a hash of doc_id: what the
    filters don't know is new, only what they may know is looked up in the counts. Empty tables give no rows; columns
    of docs named like the results are replaced.
    """
    spark = docs.sparkSession
    refs = written(document_keys(docs.where(F.col("doc_id").isNotNull()), least).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))))
    index = LineIndex.empty(spark, shards or shards_for(refs.count()), least)
    for b in range(batches):
        index = index.insert_keys(refs.where(F.col("batch") == b).drop("batch"))
    return index.clean(docs)


def drop_repeated_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """docs whose texts are without the lines that dedup_lines drops; other columns stay as they are, whatever their names."""
    rows, back = shielded(docs, *CLEANED_NAMES)
    return dedup_lines(rows, least).withColumn("text", F.col("kept_text")).select(*back)
