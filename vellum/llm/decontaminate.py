"""Benchmark decontamination: a broadcast set of normalised n-grams against every window of every document."""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import appended, shielded, written

#: ASCII letters to lower case; what parts words (ASCII that is neither letter nor digit) to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: The same, but letters keep their case: to find where words lie in the text.
PART = bytes(c if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each window of n ids."""
    h = np.zeros(len(ids) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = h * FACTOR + ids[k : len(ids) - n + 1 + k]
            h ^= h >> np.uint64(29)
    return h


class Windows:
    """All windows of n consecutive words of the items; an item of fewer words, but not none, is one window.

    Kept in arrays: the items' words as numbers in one row, and for each length of window the sorted hashes of the
    different windows, where in that row each is found for verification, and the items that hold it. That is some 30
    bytes a word of the items, besides each different word itself.
    """

    def __init__(self, items: list[tuple[int, str | None]], n: int):
        self.words: dict[bytes, int] = {}
        texts = [(item, words_of(text)) for item, text in items]
        texts = [(item, [self.words.setdefault(w, len(self.words) + 1) for w in words]) for item, words in texts if words]
        self.row = np.array([i for _, ids in texts for i in ids], np.uint32)
        lengths = np.array([len(ids) for _, ids in texts], np.int64)
        begins, named = np.cumsum(lengths) - lengths, np.array([item is not None for item, _ in texts], bool)
        owners = np.array([item or 0 for item, _ in texts], np.int64)
        self.tables: dict[int, tuple[np.ndarray, ...]] = {}
        for k in sorted(set(np.minimum(lengths, n).tolist())):
            own = np.flatnonzero(np.minimum(lengths, n) == k)
            counts = lengths[own] - k + 1
            at = np.repeat(begins[own] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            grams = self.row[at[:, None] + np.arange(k)]
            order = np.lexsort((*grams.T[::-1], hashes := _rolling(self.row.astype(np.uint64), k)[at]))
            at, grams, hashes = at[order], grams[order], hashes[order]
            new = np.concatenate(([True], (grams[1:] != grams[:-1]).any(1)))
            which = np.cumsum(new) - 1
            held = np.column_stack([which, np.repeat(owners[own], counts)[order]])
            held = np.unique(held[np.repeat(named[own], counts)[order]], axis=0)
            # a window's hash and place, and where its items begin in the list of items
            self.tables[k] = (hashes[new], at[new], np.searchsorted(held[:, 0], np.arange(new.sum() + 1)), held[:, 1])

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are inside an occurrence of a window, and the items whose windows occur."""
        ids = np.fromiter(map(self.words.get, words, repeat(0)), np.uint64, len(words))
        inside, items = np.zeros(len(ids) + 1, np.int32), set()
        known = ids != 0
        for k, (hashes, places, begins, held) in self.tables.items():
            if len(ids) < k:
                continue
            sums = np.concatenate(([0], np.cumsum(known)))
            starts = np.flatnonzero(sums[k:] - sums[:-k] == k)
            if not len(starts):
                continue
            if len(starts) * 4 < len(ids):
                h = _rolling(ids[starts[:, None] + np.arange(k)].ravel(), k)[::k]
            else:
                h = _rolling(ids, k)[starts]
            at = np.searchsorted(hashes, h)
            while len(starts):  # more than once only where different windows share a hash
                there = np.flatnonzero(at < len(hashes))
                there = there[hashes[at[there]] == h[there]]
                starts, at, h = starts[there], at[there], h[there]
                same = (ids[starts[:, None] + np.arange(k)] == self.row[places[at][:, None] + np.arange(k)]).all(1)  # a verified hit
                np.add.at(inside, starts[same], 1)
                np.add.at(inside, starts[same] + k, -1)
                for w in np.unique(at[same]).tolist():
                    items.update(held[begins[w] : begins[w + 1]].tolist())
                starts, at, h = starts[~same], at[~same] + 1, h[~same]
        return np.cumsum(inside[:-1]) > 0, items


HITS = "n_words bigint, n_hit bigint, items array<bigint>, clean_text string"
HIT_NAMES = ("n_words", "n_hit", "items", "clean_text")


def _cut(text: str, hit: np.ndarray) -> str:
    """The text without the hit words; what stands between two hit words goes with them."""
    raw = text.encode("utf-8", "surrogatepass")
    sep = np.frombuffer(raw.translate(PART), np.uint8) == 32
    edges = np.flatnonzero(np.diff(np.concatenate(([True], sep, [True])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    keep, last = [], 0
    turns = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
        keep.append(raw[last : starts[a]])
        last = ends[b - 1]
    keep.append(raw[last:])
    return b"".join(keep).decode("utf-8", "surrogatepass")


#: What parts words, as a pattern of Spark's.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_words: int = 2_000_000, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """docs with n_words, n_hit, items (sorted ids of items with occurring windows) and clean_text (hit spans removed).

    The windows of a benchmark of at most ``broadcast_words`` words and ``broadcast_bytes`` bytes go to every task as one set,
    about 60 MB of arrays besides its different words at that bound; docs are then read once, without a shuffle. A larger
    benchmark, by either measure (a text without ASCII separators is one word), is joined on the windows' hashes
    instead, and what meets is verified word by word, with the same result.

    A null text has no words and stays null; items without words have no window; repeated items count once each by
    their id, those without id only in the hit words; an empty benchmark hits nothing. Columns of docs named like the
    results are replaced.
    """
    asked = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    size = asked.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(APART.replace("[", "[^", 1) + "+"))), F.lit(0)).alias("words"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes")).first()
    if size["words"] > broadcast_words or size["bytes"] > broadcast_bytes:
        return _joined(docs, asked, n)
    shared = docs.sparkSession.sparkContext.broadcast(Windows([(r[0], r[1]) for r in asked.collect()], n))

    def make():
        windows = shared.value

        def scan(batch):
            rows = [_row(text, *windows.hits(words_of(text))) for text in batch.column("text").to_pylist()]
            return list(zip(*rows, strict=True))

        return scan

    return appended(docs, HITS, make)


def _row(text: str | None, hit: np.ndarray, items: set[int]) -> tuple:
    n_hit = int(hit.sum())
    return len(hit), n_hit, sorted(items), _cut(text, hit) if n_hit else text


def _joined(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """The same where the windows are too many for a task: each item's and document's windows meet by hash.

    Different windows of the items are one row each, so a window that many items and documents share meets each of a
    document's occurrences once; the items are joined to a document's different windows only. A hash that is met is no hit
    before the words are the same."""
    shielded_docs, back = shielded(docs, "_row", "_w", "_k", "_at", "_g", "_hits", "_items", *HIT_NAMES)
    rows = written(shielded_docs.withColumn("_row", F.monotonically_increasing_id()))
    least = F.least(F.size("_w"), F.lit(n))
    words = lambda df, *ids: appended(df.select(*ids, "text"), "_w array<binary>", lambda: lambda b: [[words_of(t) for t in b.column("text").to_pylist()]]).drop("text")
    gram = lambda k: F.array_join(F.transform(F.slice("_w", F.col("_at"), k), F.hex), " ")
    places = F.explode(F.sequence(F.lit(1), F.size("_w") - F.col("_k") + 1))
    items = written(words(benchmark, "item_id").where("size(_w) > 0").withColumn("_k", least).withColumn("_at", places).select("item_id", "_k", gram(F.col("_k")).alias("_g")).distinct())
    lengths = [r[0] for r in items.select("_k").distinct().collect()]  # at most n of them
    seen = words(rows, "_row").withColumn("_k", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"))).where("size(_w) >= _k")
    seen = seen.withColumn("_at", places).select("_row", "_k", "_at", F.xxhash64(gram(F.col("_k"))).alias("_h"))
    # documents' windows go by hash; the words of those that meet are looked at again
    asked = items.select("_k", F.xxhash64("_g").alias("_h")).distinct()
    near = seen.join(asked, ["_k", "_h"], "left_semi").groupBy("_row").agg(F.collect_list(F.struct("_at", "_k")).alias("_hits"))
    again = words(rows.join(near, "_row"), "_row", "_hits").select("_row", "_w", F.inline("_hits")).select("_row", "_k", "_at", gram(F.col("_k")).alias("_g"))
    met = written(again.join(items.select("_k", "_g").distinct(), ["_k", "_g"], "left_semi"))
    hits = met.groupBy("_row").agg(F.collect_list(F.struct("_at", "_k")).alias("_hits"))
    held = met.select("_row", "_k", "_g").distinct().join(items, ["_k", "_g"]).groupBy("_row").agg(F.array_sort(F.collect_set("item_id")).alias("_items"))

    def make():
        def mark(batch):
            out = []
            for text, hits, items in zip(*(batch.column(c).to_pylist() for c in ("text", "_hits", "_items")), strict=True):
                inside = np.zeros(len(words_of(text)), bool)
                for h in hits or ():
                    inside[h["_at"] - 1 : h["_at"] - 1 + h["_k"]] = True
                out.append(_row(text, inside, set(items or ())))
            return list(zip(*out, strict=True))

        return mark

    marked = appended(rows.join(hits, "_row", "left").join(held, "_row", "left"), HITS, make)
    kept = [c for c, name in zip(back, docs.columns, strict=True) if name.lower() not in HIT_NAMES]
    return marked.select(*kept, *HIT_NAMES)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from find_contamination's result."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, drop_share: float = 0.5) -> DataFrame:
    """docs with hit spans removed from the texts; documents of which at least ``drop_share`` of the words are hit go.

    Other columns of docs stay as they are, whatever their names."""
    rows, back = shielded(docs, *HIT_NAMES)
    found = find_contamination(rows, benchmark, n)
    kept = found.where((F.col("n_hit") == 0) | (F.col("n_hit") < drop_share * F.col("n_words")))
    return kept.withColumn("text", F.col("clean_text")).select(*back)
