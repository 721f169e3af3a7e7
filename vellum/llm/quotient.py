"""A counting quotient filter that loses nothing: exact counters of packed n-grams, without the n-grams themselves.

An n-gram is a row of word ids of ``width`` bits. An invertible permutation makes of it a row whose first number is evenly
spread: its top bits name a shard, the next ones are the quotient, and all other bits are kept as the remainder. So the
n-gram is read back from where its counter stands and from its remainder, and no two n-grams share a counter.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def _mixed(x: np.ndarray, step: int, mask: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (x + U(0x9E3779B97F4A7C15 * (step + 1) & (1 << 64) - 1)) * U(0xBF58476D1CE4E5B9)
        h ^= h >> U(29)
        h *= U(0x94D049BB133111EB)
        return (h ^ (h >> U(32))) & mask


def permuted(columns: list[np.ndarray], width: int, back: bool = False) -> list[np.ndarray]:
    """The n-grams' ids, a column a word, permuted or permuted ``back``: each step adds to a column what another gives."""
    n = len(columns)
    if n < 2:
        raise ValueError("an n-gram has two words at least")
    mask, columns = U((1 << width) - 1), list(columns)
    steps = [*range(n), 0]
    with np.errstate(over="ignore"):
        for step, i in reversed([*enumerate(steps)]) if back else enumerate(steps):
            h = _mixed(columns[i - 1], step, mask)
            columns[i] = (columns[i] - h if back else columns[i] + h) & mask
    return columns


def _ordered(columns: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """What sorts the rows, and where in that order a new row begins."""
    key = columns[0]
    if width < 64:
        more = min(64 - width, width)
        key = (key << U(64 - width)) | (columns[1] >> U(width - more)) << U(64 - width - more)
    order = np.argsort(key, kind="stable")
    key = key[order]
    near = key[1:] == key[:-1]
    new = np.concatenate(([True], ~near))[: len(order)]
    rest = columns[1:]
    other = np.zeros(len(near), bool)
    for c in rest:
        c = c[order]
        other |= near & (c[1:] != c[:-1])
    if other.any():  # rows of one key that differ later: sorted within the key
        runs = np.cumsum(new) - 1
        some = np.flatnonzero(np.isin(runs, np.unique(runs[1:][other])))
        order[some] = order[some][np.lexsort([*(c[order[some]] for c in reversed(rest)), runs[some]])]
        for c in rest:
            c = c[order]
            new[1:] |= c[1:] != c[:-1]
    return order, np.flatnonzero(new)


def _bytes_of(x: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


class Filter:
    """Sorted counters of permuted n-grams. ``columns`` are permuted, sorted and different; ``counts`` are at least one."""

    def __init__(self, columns: list[np.ndarray], counts: np.ndarray, width: int):
        self.columns, self.counts, self.width = columns, counts, width

    @classmethod
    def of(cls, columns: list[np.ndarray], width: int, counts: np.ndarray | None = None) -> Filter:
        """Counts of permuted n-grams in any order."""
        if not len(columns[0]):
            return cls(columns, np.zeros(0, np.int64), width)
        order, first = _ordered(columns, width)
        ones = np.diff(np.append(first, len(order))) if counts is None else np.add.reduceat(counts[order], first)
        return cls([c[order[first]] for c in columns], ones, width)

    @classmethod
    def merged(cls, filters: list[Filter]) -> Filter:
        """One filter with the sums of all: sorted runs, merged."""
        width, n = filters[0].width, len(filters[0].columns)
        return cls.of([np.concatenate([f.columns[i] for f in filters]) for i in range(n)], width, np.concatenate([f.counts for f in filters]))

    def shards(self, bits: int) -> list[tuple[int, Filter]]:
        """The filter by the top ``bits`` of its first number."""
        edges = np.searchsorted(self.columns[0], np.arange(1 << bits, dtype=np.uint64) << U(self.width - bits)).tolist() + [len(self.counts)]
        return [(s, Filter([c[a:b] for c in self.columns], self.counts[a:b], self.width)) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]

    def to_bytes(self, shard_bits: int) -> bytes:
        """One bit for each quotient (whether it has a run), one for each entry (whether it ends one), remainders, counters."""
        n, rest = len(self.counts), self.width - shard_bits
        q = min(rest, max(n.bit_length() - 1, 0))
        first = self.columns[0] & U((1 << rest) - 1)
        quotient = (first >> U(rest - q)).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        ends = np.append(quotient[1:] != quotient[:-1], True)
        more = self.counts > 1
        counts = self.counts[more] - 2
        return b"".join([
            np.array([n, q, shard_bits, self.width, len(self.columns), int(self.columns[0][0] >> U(rest)), int(more.sum())], "<i8").tobytes(),
            np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), np.packbits(more).tobytes(),
            _bytes_of(first & U((1 << (rest - q)) - 1), -(-(rest - q) // 8)), *(_bytes_of(c, -(-self.width // 8)) for c in self.columns[1:]),
            np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255].astype("<i8").tobytes(),
        ])

    @classmethod
    def from_bytes(cls, raw: bytes) -> Filter:
        n, q, shard_bits, width, words, shard, many = np.frombuffer(raw, "<i8", 7).tolist()
        at = 56

        def taken(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(raw, np.uint8, size, at - size)

        def bits(size: int) -> np.ndarray:
            return np.unpackbits(taken(-(-size // 8)), count=size).astype(bool)

        def numbers(size: int) -> np.ndarray:
            out = np.zeros((n, 8), np.uint8)
            out[:, :size] = taken(n * size).reshape(n, size)
            return out.view("<u8").ravel().astype(np.uint64)

        occupied, ends, more = bits(1 << q), bits(n), bits(n)
        rest = width - shard_bits
        quotient = np.flatnonzero(occupied)[np.concatenate(([0], np.cumsum(ends)[:-1]))].astype(np.uint64)
        first = numbers(-(-(rest - q) // 8)) | quotient << U(rest - q) | U(shard << rest)
        columns = [first, *(numbers(-(-width // 8)) for _ in range(words - 1))]
        small = taken(many).astype(np.int64)
        small[small == 255] = np.frombuffer(raw, "<i8", int((small == 255).sum()), at)
        counts = np.ones(n, np.int64)
        counts[more] = small + 2
        return cls(columns, counts, width)

    def at_least(self, least: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The n-grams' own ids and counts, of those with so many."""
        some = self.counts >= least
        return permuted([c[some] for c in self.columns], self.width, back=True), self.counts[some]
