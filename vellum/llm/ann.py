"""Nearest neighbours by inner product over randomly rotated one-bit codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rotation(dim: int, bits: int, seed: int = 7) -> np.ndarray:
    """Rows of a random orthogonal matrix that turn vectors of dim components into at least ``bits``, a multiple of 64."""
    size = -(-max(dim, bits) // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:dim]


class Codes:
    """One-bit codes of unit vectors after a rotation, with what estimates of inner products need.

    bits: a sign per rotated component, packed; norm: the vector's length; align: the inner product of the unit
    vector with its code (a unit vector of components +-1/sqrt(D)). For a unit query q, <q, code> / align estimates
    <q, vector> without bias, with an error beyond epsilon * sqrt((1 - align^2) / align^2 / (D - 1)) only rarely.
    """

    def __init__(self, vectors: np.ndarray, turn: np.ndarray):
        size = turn.shape[1]
        self.norm = np.linalg.norm(vectors, axis=1)
        rotated = (vectors / self.norm[:, None]) @ turn
        self.bits = np.packbits(rotated > 0, axis=1)
        self.align = np.abs(rotated).sum(1) / np.sqrt(size)
        self.spread = np.sqrt(np.maximum(0, 1 - self.align**2)) / self.align / np.sqrt(max(size - 1, 1))

    def estimate(self, queries: np.ndarray, levels: int = 4) -> np.ndarray:
        """Estimates of the inner products of rotated queries, kept at 2^levels steps, with all vectors (row: query).

        The sum over the set bits is taken plane by plane of the query's digits, by counts of common bits.
        """
        size = queries.shape[1]
        low, high = queries.min(1), queries.max(1)
        step = np.maximum((high - low) / (2**levels - 1), 1e-30)
        digits = np.rint((queries - low[:, None]) / step[:, None]).astype(np.uint8)
        words = self.bits.view(np.uint64)
        ones = np.bitwise_count(words).sum(1, dtype=np.int32)
        sums = np.zeros((len(queries), len(words)), np.float32)
        for k in range(levels):
            plane = np.packbits(digits >> k & 1, axis=1).view(np.uint64)
            for w in range(words.shape[1]):
                sums += np.float32(1 << k) * np.bitwise_count(plane[:, w, None] & words[None, :, w])
        inside = sums * step[:, None].astype(np.float32) + np.outer(low, ones).astype(np.float32)  # the query's components where bits are set
        total = (digits * step[:, None] + low[:, None]).sum(1)
        return (2 * inside - total[:, None].astype(np.float32)) / np.float32(np.sqrt(size)) * (self.norm / self.align).astype(np.float32)


def nearest_in_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, codes: Codes, turn: np.ndarray, k: int, epsilon: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query its k nearest among the vectors, its own id left out: (ids, scores) in double precision.

    A vector is scored exactly if its upper bound reaches the k-th largest lower bound of the query.
    """
    out = []
    lengths = np.linalg.norm(queries, axis=1)
    rotated = queries @ turn
    rounding = (rotated.max(1) - rotated.min(1)) / 15 / np.sqrt(12)  # of a query kept at 16 steps
    for at in range(0, len(queries), 128):
        part = slice(at, at + 128)
        guess = codes.estimate(rotated[part])
        reach = epsilon * (lengths[part, None] * codes.spread + rounding[part, None] / codes.align) * codes.norm
        own = query_ids[part, None] == ids[None, :]
        lower, upper = np.where(own, -np.inf, guess - reach), np.where(own, -np.inf, guess + reach)
        n = min(k, len(ids))
        floor = np.partition(lower, len(ids) - n, axis=1)[:, len(ids) - n]
        for q in range(len(guess)):
            near = np.flatnonzero((upper[q] >= floor[q]) & ~own[q])
            score = np.ascontiguousarray((vectors[near] * queries[at + q]).T).sum(0)  # component after component
            best = np.lexsort((ids[near], -score))[:k]
            out.append((ids[near][best], score[best]))
    return out


def usable(vector: str):
    """Whether a vector takes part: not null, not empty, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _blocks(rows: DataFrame, size: int, salt: str, name: str, n: int) -> DataFrame:
    """rows (id, vector) as bounded blocks: one row a block, with its ids and vectors.

    Blocks are dealt by a hash of id, vector and place in the table, so neither equal vectors nor repeated rows meet in one block."""
    count = max(1, -(-n // size))
    spread = rows.withColumn("_at", F.pmod(F.xxhash64("id", "vector", F.lit(salt), F.monotonically_increasing_id()), F.lit(count)).cast("int"))
    return spread.groupBy("_at").agg(F.collect_list(F.struct("id", "vector")).alias(name)).withColumnRenamed("_at", f"{name}_no")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, *, key: str = "vec_id", vector: str = "embedding", epsilon: float = 2.5, bits: int = 256, block: int = 4096, seed: int = 7) -> DataFrame:
    """Each query's k nearest of ``vectors`` by inner product, other than itself: query_id, rank, vec_id, score.

    Both sides are dealt in blocks of about ``block`` rows. Each pair of a query block and a vector block is one
    row: vectors are rotated into ``bits`` components, kept as one bit each, and their inner products estimated from the packed bits
    and two numbers a vector; error bounds, ``epsilon`` deviations wide, choose what is scored exactly in double
    precision. Each pair gives k rows a query at most, and these are ranked. Every vector is indexed and searched.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null keys or
    vectors of another length than the queries'. Ties go to the smaller id. Rows of the query's own id are left out;
    repeated rows are candidates each. An empty side gives no rows; other columns are ignored.
    """
    side = lambda df: df.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("vector"))
    base, asked = side(vectors), side(queries)
    n, m = base.count(), asked.count()
    count = lambda rows: F.sequence(F.lit(0), F.lit(max(1, -(-rows // block)) - 1))
    left = _blocks(asked, block, "q", "asked", m).withColumn("base_no", F.explode(count(n)))
    right = _blocks(base, block, "v", "base", n).withColumn("asked_no", F.explode(count(m)))
    pairs = right.join(left, ["asked_no", "base_no"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                for (q, qi), (v, vi) in _same_length(batch.column("asked"), batch.column("base"), i):
                    if q.shape[1] not in turns:
                        turns[q.shape[1]] = rotation(q.shape[1], bits, seed)
                    turn = turns[q.shape[1]]
                    found = nearest_in_block(q, qi, v, vi, Codes(v, turn), turn, k, epsilon)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(qi, [len(x) for x, _ in found])), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([s for _, s in found]))],
                        names=["query_id", "vec_id", "score"],
                    )

    near = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _same_length(asked: pa.Array, base: pa.Array, i: int):
    """The blocks of row i as matrices, by vector length where lengths differ."""
    sides = []
    for column in (asked, base):
        rows = column[i].values
        vectors = rows.field("vector")
        lengths, ids = vectors.value_lengths().to_numpy(zero_copy_only=False), rows.field("id").to_numpy(zero_copy_only=False)
        flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(lengths)
        if len(set(lengths.tolist())) == 1:
            sides.append({int(lengths[0]): (flat.reshape(len(ids), -1), ids)})
        else:
            parts = np.split(flat, ends[:-1])
            sides.append({int(d): (np.stack([p for p, x in zip(parts, lengths, strict=True) if x == d]), ids[lengths == d]) for d in set(lengths.tolist())})
    return [(sides[0][d], sides[1][d]) for d in sides[0] if d in sides[1]]
