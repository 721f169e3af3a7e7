"""Phrases whose words keep together, from exact counts of n-grams in counting quotient filters."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import written
from vellum.llm.quotient import Filter, permuted

#: A byte that no UTF-8 text holds stands for what parts pieces.
BREAK = b"\xff"
#: A-Z to lower case, what parts pieces to BREAK, a tab to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 255 if c in b".,;:!?\n\v\f\r" else 32 if c == 9 else c for c in range(256))
#: Text is taken apart in blocks of about so many bytes, and filters are built from so many n-grams.
BLOCK, FLUSH = 1 << 22, 1 << 21
#: A filter shard is meant for so many n-grams.
SHARD = 1 << 20
#: Bits of the maps of frequent words and n-grams: 16 MB, however many there are.
MAP_BITS = 27
WORD_COLUMN, WIDTHS, SALTS = "word", range(40, 72, 8), 8


def blocks(text: bytes, overlap: int) -> Iterator[bytes]:
    """text in blocks cut where pieces end, or else between words, where the last ``overlap`` words come again."""
    at = 0
    while len(text) - at > BLOCK:
        end = text.rfind(BREAK, at, at + BLOCK)
        if end > at:
            yield text[at:end]
            at = end
            continue
        end = new = at
        while new <= at and end >= 0:  # until the block holds more than the words that come again
            end = new = text.find(b" ", max(at + BLOCK, end + 1))
            for _ in range(overlap if end >= 0 else 0):  # back over the spaces before a word and the word
                while new > at and text[new - 1] == 32:
                    new -= 1
                new = max(text.rfind(b" ", at, new), text.rfind(BREAK, at, new), at - 1) + 1
        if end < 0:
            break
        yield text[at:end]
        at = new
    yield text[at:]


def words_in(batch: pa.RecordBatch, overlap: int) -> Iterator[tuple[str, list[bytes]]]:
    """The words of each language's texts, with BREAK between pieces, in blocks."""
    texts: dict[str, list[bytes]] = defaultdict(list)
    held = 0

    def taken():
        for lang, parts in texts.items():
            for block in blocks(BREAK.join(parts), overlap):
                yield lang, block.replace(BREAK, b" \xff ").split()
        texts.clear()

    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
        raw = text.as_py()
        if raw:
            raw = raw.encode().translate(FOLD)
            texts["und" if lang is None else lang].append(raw)
            held += len(raw)
            if held >= BLOCK:
                yield from taken()
                held = 0
    yield from taken()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f): how often each word stands in a language's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)

        def rows():
            for lang, counts in seen.items():
                counts.pop(BREAK, None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "f"])
            seen.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for lang, words in words_in(batch.slice(at, 256), 0):
                    seen[lang].update(words)
                if sum(map(len, seen.values())) > 400_000:
                    yield from rows()
        yield from rows()

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def bitmap(places: DataFrame) -> np.ndarray:
    """The map of the places (from 1) in column ``at``; in the driver it has 2^MAP_BITS bits at most."""
    chunks = places.groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    for r in chunks.toLocalIterator():
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def marked(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the places (from 1) are in the map."""
    at = at.astype(np.int64) - 1
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def gram_places(columns: list[np.ndarray]) -> np.ndarray:
    """Where n-grams stand in a map."""
    h = np.zeros(len(columns[0]), np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return (h & np.uint64((1 << MAP_BITS) - 1)) + np.uint64(1)


def _salted(word: Column | str, salt: int) -> Column:
    """The word's hash; no word holds a tab, so salted words are different words."""
    return F.xxhash64(F.concat(word, F.lit("\t" * salt)))


def word_ids(words: DataFrame, least: int) -> tuple[int, int, np.ndarray]:
    """(width, salt, map): word ids of so many bits of a salted hash, and the map of words that are frequent in a language.

    No word that the map lets pass shares its id with another, which is counted, not assumed."""
    frequent = words.where(F.col("f") >= least)
    for salt in range(SALTS):
        place = (_salted("word", salt).bitwiseAND((1 << MAP_BITS) - 1) + 1).alias("at")
        bits = bitmap(frequent.select(place).distinct())
        passed = written(words.select("word", place).join(frequent.select(place).distinct(), "at", "left_semi").select("word").distinct())
        n = passed.count()
        for width in WIDTHS:
            if n * n < 1 << (width - 3) or width == WIDTHS[-1]:
                if not passed.groupBy(_id(width, salt)).count().where("count > 1").take(1):
                    return width, salt, bits
    raise RuntimeError("word ids collide under every salt")


def _id(width: int, salt: int) -> Column:
    return F.greatest(F.shiftrightunsigned(_salted("word", salt), 64 - width), F.lit(1)) if width < 64 else F.when(_salted("word", salt) == 0, 1).otherwise(_salted("word", salt))


def gram_counts(docs: DataFrame, n: int, width: int, salt: int, words: np.ndarray, grams: np.ndarray | None, shard_bits: int, least: int) -> DataFrame:
    """(lang, key, a, at): the n-grams that stand at least ``least`` times within pieces, and their place in a map.

    Only windows whose words, and whose shorter n-grams, may be frequent are counted. A task sorts them into filters and
    sends each shard's part away; a shard merges its sorted filters. Both are sized by numbers of n-grams, not by keys,
    and a frequent n-gram is one counter in each filter."""
    known = docs.sparkSession.sparkContext.broadcast((words, grams))
    size, tail = -(-width // 8), b"\t" * salt

    class Ids(dict):
        def __missing__(self, word: bytes) -> int:
            h, bits = xxhash.xxh64_intdigest(word + tail, 42), known.value[0]
            at = h & ((1 << MAP_BITS) - 1)
            found = max(h >> (64 - width), 1) if word != BREAK and bits[at >> 3] >> (at & 7) & 1 else 0
            if len(self) < 1 << 20:
                self[word] = found
            return found

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, grams = Ids(), known.value[1]
        held: dict[str, list[list[np.ndarray]]] = defaultdict(list)
        sizes: Counter[str] = Counter()

        def rows(lang: str) -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held.pop(lang), strict=True)]
            del sizes[lang]
            made = Filter.of(permuted(columns, width), width).shards(shard_bits)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(made), pa.string()), pa.array([s for s, _ in made], pa.int32()), pa.array([f.to_bytes(shard_bits) for _, f in made], pa.binary())], names=["lang", "shard", "filter"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for lang, tokens in words_in(batch.slice(at, 256), n - 1):
                    row = np.fromiter(map(ids.__getitem__, tokens), np.uint64, len(tokens))
                    if len(row) < n:
                        continue
                    some = row != 0
                    if grams is None:
                        good = np.logical_and.reduce([some[i : len(row) - n + 1 + i] for i in range(n)])
                        begins = np.flatnonzero(good)
                    else:
                        whole = np.flatnonzero(np.logical_and.reduce([some[i : len(row) - n + 2 + i] for i in range(n - 1)]))
                        passed = np.zeros(len(row) - n + 2, bool)
                        passed[whole[marked(grams, gram_places([row[whole + i] for i in range(n - 1)]))]] = True
                        begins = np.flatnonzero(passed[:-1] & passed[1:])
                    if len(begins):
                        held[lang].append([row[begins + i] for i in range(n)])
                        sizes[lang] += len(begins)
                        if sizes[lang] >= FLUSH:
                            yield rows(lang)
                while sizes.total() >= 2 * FLUSH:
                    yield rows(max(sizes, key=sizes.get))
        for lang in sorted(held):
            yield rows(lang)

    def merge(table: pa.Table) -> pa.Table:
        langs, total = table.column("lang"), None
        waiting: list[Filter] = []
        for raw in table.column("filter"):
            waiting.append(Filter.from_bytes(raw.as_py()))
            if sum(len(f.counts) for f in waiting) >= SHARD:
                total = Filter.merged([*([total] if total else []), *waiting])
                waiting = []
        if waiting:
            total = Filter.merged([*([total] if total else []), *waiting])
        columns, counts = total.at_least(least)
        raw = np.concatenate([c.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - size :] for c in columns], axis=1).tobytes()
        step = size * n
        return pa.table({
            "lang": pa.array([langs[0].as_py()] * len(counts), pa.string()), "key": pa.array([raw[i : i + step] for i in range(0, len(raw), step)], pa.binary()),
            "a": pa.array(counts, pa.int64()), "at": pa.array(gram_places(columns).astype(np.int64), pa.int64()),
        })

    sent = docs.select("lang", "text").mapInArrow(count, "lang string, shard int, filter binary")
    return sent.groupBy("lang", "shard").applyInArrow(merge, "lang string, key binary, a bigint, at bigint")


def score(a: Column | str, both: Column) -> Column:
    """floor(2000000 a / both), exactly: decimals hold the product."""
    whole = lambda c: F.col(c).cast("decimal(19,0)") if isinstance(c, str) else c.cast("decimal(20,0)")
    return F.call_function("div", whole(a) * F.lit(2_000_000).cast("decimal(7,0)"), whole(both))


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, within: int = 80, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to ``longest`` words that stands a >= ``least`` times has for each cut the score floor(2000000 a / (l + r)), l and
    r being the counts of its parts; its lowest cut counts. It goes if a longer such phrase that holds it has at least
    ``within`` percent of its count. Words are counted first, then n-grams of each length among those whose shorter
    n-grams are frequent; each level is a written table, and what the tasks know of a level is a bit map of fixed size,
    whose false hits only cost counters.

    A null lang is ``und``, a null text empty; null doc_ids and repeated rows count as any; an empty table gives no
    phrases; other columns are ignored.
    """
    docs = docs.select("lang", "text")
    words = written(word_counts(docs))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    width, salt, bits = word_ids(words, least)
    size = -(-width // 8)
    n_words = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    shard_bits = max(6, int(n_words // SHARD).bit_length())
    key = F.unhex(F.lpad(F.hex(_id(width, salt)), 2 * size, "0"))
    levels = {1: written(words.where(F.col("f") >= least).select("lang", key.alias("key"), F.col("f").alias("a"), F.col("word").alias("phrase")))}
    grams, found = None, []
    for n in range(2, longest + 1):
        counted = written(gram_counts(docs, n, width, salt, bits, grams, shard_bits, least))
        row = counted.select("lang", "key", "a")
        for k in range(1, n):
            first, rest = levels[k], levels[n - k]
            row = row.withColumn("_l", F.expr(f"substring(key, 1, {k * size})")).withColumn("_r", F.expr(f"substring(key, {k * size + 1}, {(n - k) * size})"))
            row = row.join(first.select("lang", F.col("key").alias("_l"), F.col("a").alias("l"), F.col("phrase").alias("_p")), ["lang", "_l"])
            row = row.join(rest.select("lang", F.col("key").alias("_r"), F.col("a").alias("r"), F.col("phrase").alias("_q")), ["lang", "_r"])
            cut = F.struct(score("a", F.col("l").cast("decimal(19,0)") + F.col("r")).alias("score"), F.lit(k).alias("k"), F.col("l"), F.col("r"))
            row = row.withColumn("cut", cut if k == 1 else F.least("cut", cut))
            if k == 1:
                row = row.withColumn("phrase", F.concat_ws(" ", "_p", "_q"))
            row = row.select("lang", "key", "a", "phrase", "cut")
        levels[n] = written(row)
        found.append(levels[n].withColumn("m", F.lit(n)))
        if n < longest:
            grams = bitmap(counted.select("at").distinct())
    every = found[0]
    for f in found[1:]:
        every = every.unionAll(f)
    inner = [(n, m, i) for n in range(3, longest + 1) for m in range(2, n) for i in range(n - m + 1)]
    if inner:
        parts = F.filter(F.array(*(F.when(F.col("m") == n, F.expr(f"substring(key, {i * size + 1}, {m * size})")) for n, m, i in inner)), lambda x: x.isNotNull())
        holders = every.where("m > 2").select("lang", F.explode(parts).alias("key"), "a").groupBy("lang", "key").agg(F.max("a").alias("longer"))
        every = every.join(holders, ["lang", "key"], "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * within))
    best = (F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase").asc())
    # the best of each of 64 parts of a language first, so that no task orders all phrases of one language
    some = every.withColumn("_n", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("key"), F.lit(64))).orderBy(*best))).where(F.col("_n") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
