"""Best-fit packing by patterns: the length histogram is fitted by few-document patterns, what is left is packed by best fit."""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import written
from vellum.llm.packing import Encoder, tokenizer_path

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, nth bigint"
#: Ranks of pieces among those of their length are below 2 to this power.
RANK_BITS = 44


def pieces_of(docs: DataFrame, tokenizer: str | None, window: int, end_id: int, with_ids: bool) -> DataFrame:
    """The pieces of each document: only documents longer than ``window`` are cut, and only their first piece may be shorter.

    part and nth say which partition a piece is from and how many of its length came before it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer or tokenizer_path())
        stop = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        seen: Counter[int] = Counter()
        names = [x.split()[0] for x in PIECE.split(", ")]
        types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]

        def batch_of(rows: list[tuple], ids: list[np.ndarray]) -> pa.RecordBatch:
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            extra = [pa.array(ids, pa.list_(pa.int64()))] if with_ids else []
            return pa.RecordBatch.from_arrays(arrays + extra, names=names + ["ids"] * with_ids)

        for batch in batches:
            rows, ids = [], []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                raw, doc = encoder.encode(text.as_py() or "") + stop, doc_id.as_py()
                tokens, start, piece = len(raw) // 4, 0, 0
                end = tokens % window or window
                while start < tokens:
                    own = raw[4 * start : 4 * end]
                    rows.append((doc, piece, start, end - start, zlib.crc32(own), part, seen[end - start]))
                    if with_ids:
                        ids.append(np.frombuffer(own, "<u4").astype(np.int64))
                    seen[end - start] += 1
                    start, end, piece = end, end + window, piece + 1
                if len(rows) >= 2048:
                    yield batch_of(rows, ids)
                    rows, ids = [], []
            if rows:
                yield batch_of(rows, ids)

    return docs.select("doc_id", "text").mapInArrow(run, PIECE + (", ids array<bigint>" if with_ids else ""))


def patterns(lengths: np.ndarray, window: int, slack: int) -> np.ndarray:
    """Rows of up to three of the ``lengths``, descending and filled up by zeros, whose sum is at most ``slack`` below the window.

    Two lengths are completed by the longest third that fits, so there is a row at most for each pair of lengths."""
    lengths = np.unique(lengths)
    rows = [np.column_stack([full := lengths[lengths >= window - slack], full * 0, full * 0])]
    for a in lengths.tolist():
        b = lengths[(lengths <= a) & (lengths <= window - a)]
        left = window - a - b
        two = b[left <= slack]
        rows.append(np.column_stack([two * 0 + a, two, two * 0]))
        at = np.searchsorted(lengths, np.minimum(left, b), "right") - 1
        b, left, c = b[at >= 0], left[at >= 0], lengths[at[at >= 0]]
        good = (left > slack) & (left - c <= slack)
        rows.append(np.column_stack([b[good] * 0 + a, b[good], c[good]]))
    return np.concatenate(rows)


def fit(rows: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """How often each pattern is used, at least zero, so that the lengths used come nearest to ``counts`` in squares,
    which count as much as their length: a long document that is left over costs more.

    Accelerated projected gradients; a pattern's column has three entries, so products are gathers and counts."""
    size, rows = len(counts), rows.astype(np.intp)
    used = lambda x: np.bincount(rows.ravel(), np.repeat(x, 3), size)
    goal, weight = counts.astype(float), np.arange(size) / (size - 1)
    x = y = np.zeros(len(rows))
    reach = used(np.ones(len(rows))) * weight
    # the largest row sum of the weighted A'A bounds its norm
    limit, t = float(reach[rows].sum(1).max()), 1.0
    for _ in range(rounds):
        off = (used(y) - goal) * weight
        new = np.maximum(y - off[rows].sum(1) / limit, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def plan(counts: np.ndarray, window: int, slack: int | None = None) -> list[tuple[dict[int, int], int]]:
    """Patterns (how often each length) with their repeats, which use up exactly ``counts`` (by length, from 0).

    Patterns may waste ``slack`` tokens, a 512th of the window if none is given. Their fitted repeats are rounded down, the largest
    come first; what is left is packed by best fit on the histogram: the longest takes the longest that still fit, as often
    as there are enough of all.
    """
    slack = window >> 9 if slack is None else slack
    left, out = counts.astype(np.int64).copy(), []
    left[0] = 0
    rows = patterns(np.flatnonzero(left), window, slack)
    if len(rows):
        x = fit(rows, left)
        order = np.argsort(-x, kind="stable")
        order = order[x[order] >= 1]
        have = left.tolist()
        for row, most in zip(rows[order].tolist(), np.floor(x[order]).astype(np.int64).tolist(), strict=True):
            pattern = dict(Counter(v for v in row if v))
            repeats = min(most, *(have[v] // k for v, k in pattern.items()))
            if repeats > 0:
                out.append((pattern, repeats))
                for v, k in pattern.items():
                    have[v] -= repeats * k
        left = np.array(have, np.int64)
    there = np.flatnonzero(left).tolist()
    while there:
        space, pattern, at = window, {}, len(there)
        while at and space:
            at = bisect.bisect_right(there, space, 0, at) - 1
            if at < 0:
                break
            v = there[at]
            pattern[v] = min(space // v, int(left[v]))
            space -= v * pattern[v]
        repeats = min(int(left[v]) // k for v, k in pattern.items())
        out.append((pattern, repeats))
        for v, k in pattern.items():
            left[v] -= k * repeats
        there = [v for v in there if left[v]]
    return out


class Places:
    """Where the pieces of each length go, in order of their rank among those of the same length."""

    def __init__(self, found: list[tuple[dict[int, int], int]]):
        taken, rows, sequence = Counter(), [], 0
        for pattern, repeats in found:
            offset = 0
            for v, k in sorted(pattern.items(), reverse=True):
                rows.append(((v << RANK_BITS) + taken[v], v, k, sequence, offset))
                taken[v] += k * repeats
                offset += v * k
            sequence += repeats
        table = np.array(sorted(rows) or [(0, 0, 1, 0, 0)], np.int64)
        self.first, self.length, self.each, self.sequence, self.offset = table.T.copy()

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << RANK_BITS) + rank
        at = np.searchsorted(self.first, key, "right") - 1
        k = key - self.first[at]
        return self.sequence[at] + k // self.each[at], self.offset[at] + k % self.each[at] * self.length[at]


def pack_by_patterns(docs: DataFrame, tokenizer: str | None = None, window: int = 2048, end_id: int = 0, slack: int | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in as few sequences of at most ``window`` tokens as patterns and best fit give: doc_id, piece,
    start, length, ids_crc32, sequence_id, offset, and the ids themselves if asked for.

    Only the histogram of lengths, ``window`` numbers, reaches the driver, and only the plan made of it, at most a
    pattern for each pair of lengths, goes to the tasks; both are bounded by the window, whatever the corpus. Ranks among
    pieces of one length are counts within a partition plus the sums before it, so a length that a third of all
    pieces have needs no task of its own. Texts are read once; pieces are a written table after that.

    A null text is empty; null doc_ids and repeated rows are documents like others; an empty table gives no pieces;
    other columns are ignored.
    """
    if not 0 < window < 1 << 16:
        raise ValueError("a window must have 1 to 65535 tokens")
    pieces = written(pieces_of(docs, tokenizer, window, end_id, with_ids))
    counts = written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    histogram = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    places = docs.sparkSession.sparkContext.broadcast(Places(plan(histogram, window, slack)))
    ranked = pieces.join(counts.select("part", "length", before.alias("before")), ["part", "length"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth, start = (batch.column(c).to_numpy() for c in ("length", "nth", "before"))
            made = places.value(length, nth + start)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(x, pa.int64()) for x in made], names=[*names, "sequence_id", "offset"])

    kinds = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(run, kinds)
