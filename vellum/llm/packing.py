"""Order-preserving packing of token streams into windows, cut by dynamic programming."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: The tokenizer's own rule of pieces, and Unicode's white space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\t-\r \x85\xa0  -     　"
#: White space that the tokenizer's rule of pieces is not asked about: it would look back from every character of it.
WIDE = re.compile(f"[{SPACE}]{{1000,}}")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others shifted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of a byte-level BPE vocabulary file, as unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        table = byte_of()
        ranks = {bytes(table[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.bpe = tiktoken.Encoding(name="own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.whole = tiktoken.Encoding(name="whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*ranks.values(), *self.special.values()]) + 1
        self.ends, self.starts = np.zeros(size, bool), np.zeros(size, bool)
        for token, i in ranks.items():
            self.ends[i] = token[-1:] in (b".", b"!", b"?", b"\n")
            self.starts[i] = token[:1].isspace()

    def ids(self, text: str) -> list[int]:
        """Ids of text without special tokens. Of wide white space all but the last character is one piece."""
        out, at = [], 0
        for m in WIDE.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += self.bpe.encode_ordinary(text[at : m.start()]) + self.whole.encode_ordinary(text[m.start() : end])
            at = end
        return out + self.bpe.encode_ordinary(text[at:]) if out else self.bpe.encode_ordinary(text)

    def encode(self, text: str) -> bytes:
        if self.parts is None or not any(s in text for s in self.special):
            return array("I", self.ids(text)).tobytes()
        return b"".join(array("I", [self.special[x]] if x in self.special else self.ids(x)).tobytes() for x in self.parts.split(text))


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, starts: np.ndarray, sentence: int, other: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream may be cut, ascending, and what each cut costs.

    Document ends are free and sentence ends cost little; where neither comes for long, cuts at steps cost more."""
    n = len(ids)
    after = np.ones(n, bool)
    after[:-1] = starts[ids[1:]]
    cost = np.full(n + 1, -1, np.int64)
    cost[1:][ends[ids] & after] = sentence
    cost[doc_ends] = 0
    cost[n] = 0
    cost[0] = 0
    at = np.flatnonzero(cost >= 0)
    gaps = np.diff(at)
    for a, g in zip(at[:-1][gaps > 4 * step].tolist(), gaps[gaps > 4 * step].tolist(), strict=True):
        cost[np.arange(a + step, a + g, step)] = other
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def cut(at: list[int], cost: list[int], window: int, other: int) -> list[int]:
    """Cuts, from 0 to the stream's end, with the least padding plus cut costs; no window is longer than ``window``.

    Cut j after cut i costs cost[j] + window - (at[j] - at[i]), so the best i is the least of total[i] + at[i] among
    those at most a window back: a queue kept ascending gives it in constant time. The last window may be parted into
    powers of two, which need no padding, at ``other`` a cut.
    """
    best, back = [0] * len(at), [0] * len(at)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # value, position, index
    for j in range(1, len(at)):
        p = at[j]
        while queue[0][1] < p - window:
            queue.popleft()
        value, _, back[j] = queue[0]
        best[j] = value = value + cost[j] + window - p
        value += p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, p, j))
    end, cuts = len(at) - 1, []
    if end > 0:  # the last window again, as it may end in powers of two
        n, i, choice = at[-1], end - 1, (best[end], back[end])
        while i >= 0 and at[i] >= n - window:
            choice = min(choice, (best[i] + other * ((n - at[i]).bit_count() - 1), i))
            i -= 1
        i, rest = choice[1], n - at[choice[1]]
        if choice[0] < best[end] or rest.bit_count() == 1:
            p = at[i]
            while rest:
                size = 1 << (rest.bit_length() - 1)
                p, rest = p + size, rest - size
                cuts.append(p)
        else:
            cuts.append(n)
        while i > 0:
            cuts.append(at[i])
            i = back[i]
    return sorted({0, *cuts})


PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = 1024, end_id: int = 0, block: int = 1 << 19, sentence: int = 4, other: int = 16, step: int = 8, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` tokens: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and the ids themselves if asked for.

    Each partition of docs is one stream in its own order, each document ended by ``end_id``. Cuts are chosen over
    blocks of ``block`` tokens, wherever documents end; the last four windows of a block are cut again with the next,
    so a block's end costs no padding. Cuts may differ from those of the whole stream cut at once. Memory is bounded however long texts are, and nothing is shuffled. sequence_id holds the
    partition's number in its upper bits; a task that runs again gives the same rows. A null text is empty; null
    doc_ids and repeated rows are documents like others; an empty table gives no pieces; other columns are ignored.
    """
    if block < 8 * window:
        raise ValueError("a block must hold several windows")
    schema = PIECE + (", ids array<bigint>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer or tokenizer_path())
        stop = np.array([end_id], "<u4").tobytes()
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        held: list[tuple[int | None, int, int]] = []  # doc_id, start in the document, the document's tokens
        parts: list[bytes] = []
        size = 0

        def flush(last: bool) -> pa.RecordBatch:
            """The sequences of the block; unless it is the last, its end is left to the next, which cuts it again."""
            nonlocal sequence, held, parts, size
            raw = b"".join(parts)
            ids, lengths = np.frombuffer(raw, "<u4"), np.array([len(p) // 4 for p in parts])
            doc_ends = np.cumsum(lengths)
            at, cost = candidates(ids, doc_ends, encoder.ends, encoder.starts, sentence, other, step)
            cuts = np.array(cut(at.tolist(), cost.tolist(), window, other))
            if not last:
                cuts = cuts[: np.searchsorted(cuts, len(ids) - 4 * window, "right")]
            end = int(cuts[-1])
            edges = np.union1d(cuts, doc_ends[doc_ends < end])
            lo, hi = edges[:-1], edges[1:]
            doc, seq = np.searchsorted(doc_ends, lo, "right"), np.searchsorted(cuts, lo, "right") - 1
            begin = doc_ends - lengths
            columns = [
                [held[d][0] for d in doc.tolist()], [held[d][1] + a for d, a in zip(doc.tolist(), (lo - begin[doc]).tolist(), strict=True)], (hi - lo).tolist(),
                [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)],
                [held[d][2] for d in doc.tolist()], (sequence + seq).tolist(), (lo - cuts[seq]).tolist(),
            ]
            names = [x.split()[0] for x in PIECE.split(", ")]
            arrays = [pa.array(c, pa.int64()) for c in columns]
            if with_ids:
                names.append("ids")
                arrays.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.list_(pa.int64())))
            sequence += len(cuts) - 1
            first = int(np.searchsorted(doc_ends, end, "right"))  # the first document of which something is left
            skip = np.maximum(end - begin[first:], 0).tolist()
            parts = [p[4 * n :] for p, n in zip(parts[first:], skip, strict=True)]
            held = [(i, start + n, tokens) for (i, start, tokens), n in zip(held[first:], skip, strict=True)]
            size = len(ids) - end
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                raw = encoder.encode(text.as_py() or "") + stop
                tokens, at = len(raw) // 4, 0
                while at < tokens:
                    take = min(block - size, tokens - at)
                    held.append((doc_id.as_py(), at, tokens))
                    parts.append(raw[4 * at : 4 * (at + take)])
                    at, size = at + take, size + take
                    if size >= block:
                        yield flush(False)
        if size:
            yield flush(True)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
