"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import appended, labelled_sample
from vellum.llm.crf import Chains, logistic, marginals, train

CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)), b".,;:", b"!?", b"|", b" \t\r\v\f")
KIND = np.full(256, len(CLASSES), np.uint8)
for _k, _chars in enumerate(CLASSES):
    KIND[list(_chars)] = _k


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a row of features per line, lines per text, bytes per line).

    Shares of byte classes, length, mean word length, how far words repeat in the line and next to each other,
    whether it ends a sentence; then the means of the same over the neighbouring lines.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    per_text = np.array([r.count(b"\n") + 1 for r in raw], np.int64)
    whole = b"\n".join(raw)
    lines = whole.split(b"\n") if raw else []
    sizes = np.array([len(x) for x in lines], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if lines else np.zeros(0, np.int64)
    kinds = KIND[np.frombuffer(whole + b"\n", np.uint8)]
    shares = [np.add.reduceat(kinds == k, starts, dtype=np.int64) - (k == len(CLASSES)) if lines else sizes for k in range(len(CLASSES) + 1)]
    more = np.zeros((len(lines), 4))
    for i, line in enumerate(lines):
        if words := line.split():
            n = len(words)
            more[i] = n, len(set(words)) / n, sum(map(eq, words, words[1:])) / n, line[-1:] in b".!?"
    some = np.maximum(sizes, 1)
    n_words = np.maximum(more[:, 0], 1)
    own = np.column_stack([*(s / some for s in shares), np.log1p(sizes), np.minimum(sizes / n_words, 40) / 10, np.log1p(more[:, 0]), *more[:, 1:].T, more[:, 1] * np.log1p(more[:, 0])])
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    if lines:
        ends = np.cumsum(per_text)
        before[ends - per_text], after[ends - 1] = own[ends - per_text], own[ends - 1]
    return np.column_stack([own, (before + after) / 2]), per_text, sizes


@dataclass
class Grader:
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    bias: float
    change: np.ndarray
    scale: tuple[float, float]

    def grade(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
        """Each text's marginals of a good line, and the length-weighted logits of their means."""
        rows, per_text, sizes = line_features(texts)
        scores = ((rows - self.mean) / self.deviation) @ self.weights + self.bias
        p = marginals(scores, self.change, Chains(per_text))[0]
        at = np.cumsum(per_text) - per_text
        share = np.add.reduceat(p * (sizes + 1), at) / np.add.reduceat(sizes + 1, at) if len(texts) else p
        return np.split(p, at[1:]) if len(texts) else [], np.log((share + 1e-4) / (1 - share + 1e-4))

    def scores(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * logits + self.scale[1], -30, 30)))


def fit(sample: list[tuple[str, int]], rounds: int = 150) -> Grader:
    """A grader from texts with document labels: a line's label in training is its document's.

    With one label only, or none, every text gets the labels' mean (one half without labels)."""
    texts, labels = [t for t, _ in sample], np.array([y for _, y in sample], np.int64)
    rows, per_text, _ = line_features(texts)
    if len(set(labels.tolist())) < 2:
        p = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
        width = line_features([""])[0].shape[1]
        return Grader(np.zeros(width), np.ones(width), np.zeros(width), 0.0, np.zeros((2, 2)), (0.0, float(np.log(p / (1 - p)))))
    mean, deviation = rows.mean(0), rows.std(0) + 1e-6
    truth = np.repeat(labels, per_text)
    w, bias, change = train((rows - mean) / deviation, None, rows.shape[1], truth, Chains(per_text), rounds, rate=0.1)
    grader = Grader(mean, deviation, w, bias, change, (1.0, 0.0))
    slope, offset = logistic(grader.grade(texts)[1][:, None], labels.astype(float)).tolist()
    grader.scale = (max(slope, 0.05), offset)
    return grader


GRADED = "quality_score double, line_good array<double>"


def grade_documents(docs: DataFrame, grader: Grader) -> DataFrame:
    """docs with quality_score (0 to 1) and line_good (each line's marginal of being good).

    A text is one chain of all its lines, and each counts with its length; a null or empty text is one empty line. Columns of docs with the
    results' names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grader)

    def make():
        model = shared.value

        def apply(batch):
            lines, logits = model.grade(batch.column("text").to_pylist())
            return [model.scores(logits).tolist(), lines]

        return apply

    return appended(docs, GRADED, make)


def held_out() -> Column:
    """Rows whose label no quality model may see: crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = 3000, text_bytes: int = 20_000) -> Grader:
    """A grader from at most ``rows`` labelled texts of at most ``text_bytes`` bytes each (see labelled_sample)."""
    return fit(labelled_sample(docs, labels, "quality", ~held_out(), rows, text_bytes))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted (score at least ``threshold``) for every document."""
    graded = grade_documents(docs.select("doc_id", "text"), fit_on(docs, labels)).drop("line_good")
    return graded.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
