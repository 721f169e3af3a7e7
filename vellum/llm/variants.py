"""Spelling variants: words one edit apart, found by grams of variable length."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vellum.llm.common import written

#: Latin-1 bytes: A-Z to lower case, what is no letter (a-z, from 0xC0 on) to a space. Other characters become `?` before.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: What stands before and after a word in its grams; no word holds them.
HEAD, TAIL = "\x02", "\x03"
#: Gram frequencies are kept by so many buckets, and long texts taken apart in so many characters.
BUCKETS, BLOCK = 1 << 18, 1 << 22
#: A task's counters are sent on when they hold so many words or grams.
HELD = 400_000


def _runs(text: str) -> Iterator[bytes]:
    """The lower-cased runs of letters, as Latin-1; a block ends where a run does."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text):
            while end < len(text) and (text[end].isascii() and text[end].isalpha() or "\xc0" <= text[end] <= "\xff"):
                end += 1
        yield from text[at:end].encode("latin-1", "replace").translate(FOLD).split()
        at = end


def _counted(df: DataFrame, ddl: str, kind: pa.DataType, add) -> DataFrame:
    """Sums by the first column of ``ddl``: ``add`` counts a batch into a task's counter, which is sent on when it is large."""
    names = [x.split()[0] for x in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                add(seen, batch.slice(at, 256))
                if len(seen) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), kind), pa.array(list(seen.values()), pa.int64())], names=names)
                    seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), kind), pa.array(list(seen.values()), pa.int64())], names=names)

    return df.mapInArrow(run, ddl).groupBy(names[0]).agg(F.sum(names[1]).alias(names[1]))


def spelled_words(docs: DataFrame, least_length: int = 5, least_count: int = 3, rare: int = 97) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased; where crc32 of `<doc_id>:<run>` is divisible by ``rare``, the run lacks the
    character at that number modulo its length. Words have ``least_length`` characters and ``least_count`` occurrences or more."""

    def add(seen: Counter, batch: pa.RecordBatch) -> None:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py()
            if not text:
                continue
            begin = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
            for run, k in Counter(_runs(text)).items():
                if len(run) < least_length:
                    continue
                h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begin)
                if h % rare == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < least_length:
                        continue
                seen[run.decode("latin-1")] += k

    return _counted(docs.select("doc_id", "text"), "word string, n bigint", pa.string(), add).where(F.col("n") >= least_count)


class Grams:
    """A dictionary of grams of ``shortest`` to ``longest`` characters: a gram is extended while it is frequent.

    Each place of a word, the head before it included, begins one gram, whose length is told by its own characters only. So
    an edit changes the grams that cover it and no other, and the most that any one place is covered bounds what is affected.
    """

    def __init__(self, frequent: set[str], shortest: int = 2, longest: int = 5):
        self.frequent, self.shortest, self.longest = frequent, shortest, longest

    def __call__(self, word: str) -> list[str]:
        """The word's gram at each place."""
        s, out = HEAD + word + TAIL * (self.longest - 1), []
        for p in range(len(word) + 1):
            e = p + self.shortest
            while e < p + self.longest and s[p:e] in self.frequent:
                e += 1
            out.append(s[p:e])
        return out

    @staticmethod
    def affected(grams: list[str]) -> int:
        """The most grams that one inserted, deleted or replaced character can change."""
        cover = [0] * (len(grams) + 1)
        for p, g in enumerate(grams):
            cover[p] += 1
            if p + len(g) < len(cover):
                cover[p + len(g)] -= 1
        most = now = 0
        for c in cover[: len(grams)]:
            now += c
            most = max(most, now)
        return most


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


def near_words(words: DataFrame, budget: int = 1 << 15, shortest: int = 2, longest: int = 5) -> DataFrame:
    """(word, n, other, m): each pair of different words exactly one edit apart, both ways, with their counts.

    A gram is frequent if it stands in the words more than 1/``budget`` of all places, and 16 times, so the dictionary has at
    most ``budget`` frequent grams of each length. A word whose edit affects at most t grams keeps all others, so its t + 1
    rarest grams are its lists: near words share one of them, at places that are equal or, behind an insertion, one apart.
    Lists are keyed by gram, length and place; words that meet in one are verified, and pairs that meet twice merged.
    Rarity is by counts of gram hashes in a fixed number of buckets. Words must be different and have ``longest`` or more characters.
    """
    if shortest < 2 or longest < shortest:
        raise ValueError("grams have two characters at least")
    spark = words.sparkSession

    def prefixes(seen: Counter, batch: pa.RecordBatch) -> None:
        for w in batch.column("word").to_pylist():
            s = HEAD + w + TAIL * (longest - 1)
            seen.update(s[p : p + k] for k in range(shortest, longest) for p in range(len(w) + 1))

    size = words.agg(F.coalesce(F.sum(F.char_length("word") + 1), F.lit(0)).alias("s"), F.min(F.char_length("word")).alias("least")).first()
    if size["least"] is not None and size["least"] < longest:
        raise ValueError("a word is shorter than the longest gram")
    least = max(size["s"] // budget, 16)
    only = words.select("word")
    frequent = {r[0] for r in _counted(only, "gram string, k bigint", pa.string(), prefixes).where(F.col("k") > least).select("gram").collect()}
    grams = spark.sparkContext.broadcast(Grams(frequent, shortest, longest))

    def whole(seen: Counter, batch: pa.RecordBatch) -> None:
        for w in batch.column("word").to_pylist():
            seen.update(map(_bucket, grams.value(w)))

    counts = np.zeros(BUCKETS, np.int64)
    for r in _counted(only, "bucket int, k bigint", pa.int32(), whole).collect():
        counts[r[0]] = r[1]
    rarity = spark.sparkContext.broadcast(counts)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, frequency = grams.value, rarity.value
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                piece = batch.slice(start, 4096)
                rows = []
                for w, n in zip(piece.column("word").to_pylist(), piece.column("n").to_pylist(), strict=True):
                    own = dictionary(w)
                    # any order that both words of a pair share will do; ties by place
                    rare = sorted((int(frequency[_bucket(g)]), g, p) for p, g in enumerate(own))[: dictionary.affected(own) + 1]
                    for _, g, p in rare:
                        rows += [(g, len(w), p, False, w, n), (g, len(w) + 1, p, True, w, n), (g, len(w) + 1, p + 1, True, w, n)]
                types = [pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int64()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["gram", "len", "place", "longer", "word", "n"])

    listed = written(words.select("word", "n").mapInArrow(lists, "gram string, len int, place int, longer boolean, word string, n bigint"))
    other = listed.where("NOT longer").select("gram", "len", "place", F.col("word").alias("other"), F.col("n").alias("m"))
    met = listed.join(other, ["gram", "len", "place"]).where((F.col("longer") | (F.col("word") < F.col("other"))) & (F.levenshtein("word", "other", 1) == 1))
    pairs = written(met.select("word", "n", "other", "m").distinct())
    return pairs.unionAll(pairs.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of ``forms`` (word, form) lead in the end. Forms have larger counts, at least twice, so
    chains are short and have no loops; each round doubles what a word has followed."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        seen = Observation()
        joined = now.join(after, "root", "left")
        step = written(joined.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_went")).observe(seen, F.count_if("_went").alias("n")))
        now = step.select("word", "root")
        if not seen.get["n"]:
            return now


def spelling_variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, rare: int = 97, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the texts (see ``spelled_words``).

    A word's form is its near word of the largest n, ties to the smallest word, if that is at least ``ratio`` times its own n;
    root is the last of the forms. A null or empty text has no words; a null doc_id is empty before the colon; repeated
    rows count as often as they come; an empty table gives no words; other columns are ignored.
    """
    words = written(spelled_words(docs, least_length, least_count, rare))
    near = near_words(words, longest=min(5, least_length))
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    formed = F.when(-F.col("best.m") >= F.col("n") * ratio, F.col("best.other"))
    found = written(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), formed.alias("form"), F.when(formed.isNotNull(), -F.col("best.m")).alias("form_n")))
    ends = roots(found.where(F.col("form").isNotNull()))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
