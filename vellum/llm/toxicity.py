"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import appended, labelled_sample, shielded
from vellum.llm.crf import Chains, logistic, marginals, train
from vellum.llm.decontaminate import FOLD, PART


def features_of(word: bytes) -> tuple[bytes, ...]:
    return (b"=" + word, b"<" + word[:4], b"<" + word[:5], b"<" + word[:6], b">" + word[-4:])


def lines_of(text: str | None) -> list[list[bytes]]:
    """The words of each line, ASCII letters lower-cased."""
    return [line.translate(FOLD).split() for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def indicators(docs: list[list[list[bytes]]], labels: list[int], chance: float = 0.5, precision: float = 0.88) -> set[bytes]:
    """Word features that stand much more often in toxic documents, in too many of them to be there by chance.

    precision is the share of toxic documents among those with the feature, if both labels were as frequent. The number
    of features that pass by chance is below ``chance``: a binomial's tail is bounded by its divergence from the labels' share.
    """
    seen = (Counter(), Counter())
    for lines, label in zip(docs, labels, strict=True):
        seen[label].update({f for w in {w for line in lines for w in line} for f in features_of(w)})
    toxic = sum(labels)
    if not 0 < toxic < len(labels):
        return set()
    share = toxic / len(labels)
    needed = np.log(max(len(seen[1]), 1) / chance)

    def tail(n: int, m: int) -> float:
        """At least this many times less likely than certain: n toxic ones among n + m."""
        return n * np.log(n / (n + m) / share) + (m * np.log(m / (n + m) / (1 - share)) if m else 0.0)

    return {f for f, n in seen[1].items() if n >= precision * (n + (m := seen[0][f]) * share / (1 - share)) and tail(n, m) >= needed}


@dataclass
class Tagger:
    """Feature weights and transitions of the field, and what turns a document's marginals to its score: weights of the
    strongest marginal's logit and of the logarithm of one plus their sum, and a bias."""

    weights: dict[bytes, float]
    bias: float
    change: np.ndarray
    scale: tuple[float, float, float]

    def emissions(self) -> dict[bytes, float]:
        weights, bias = self.weights, self.bias

        class Cache(dict):
            def __missing__(self, word):
                if len(self) >= 300_000:
                    self.clear()
                self[word] = score = sum(weights.get(f, 0.0) for f in features_of(word)) + bias
                return score

        return Cache()

    def tag(self, docs: list[list[list[bytes]]], cache: dict[bytes, float]) -> list[np.ndarray]:
        """Each document's marginals, word by word."""
        sizes = [sum(map(len, lines)) for lines in docs]
        scores = np.array([cache[w] for lines in docs for line in lines for w in line])
        chains = Chains(np.array([len(line) for lines in docs for line in lines], np.int64))
        return np.split(marginals(scores, self.change, chains)[0], np.cumsum(sizes)[:-1]) if docs else []

    def score(self, p: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(np.dot(self.scale[:2], _evidence(p)) + self.scale[2]))))


def _evidence(p: np.ndarray) -> tuple[float, float]:
    """What a document's marginals say: how sure the surest is, and how many words there are in all."""
    return (float(_logit(p.max())), float(np.log1p(p.sum()))) if len(p) else (float(_logit(0.0)), 0.0)


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(sample: list[tuple[str, int]], share: float | None = None, rounds: int = 40) -> Tagger:
    """A tagger from texts with document labels.

    Token labels come from the documents': a word of a toxic document is toxic if it has an indicator; other words
    aren't. share: toxic documents' share where the sample's isn't the corpus's.
    """
    docs, labels = [lines_of(t) for t, _ in sample], [y for _, y in sample]
    marks = indicators(docs, labels)
    words = [w for lines in docs for line in lines for w in line]
    lengths = np.array([len(line) for lines in docs for line in lines], np.int64)
    if not marks or not words:
        p = np.clip(sum(labels) / len(labels) if labels else 0.0, 0.01, 0.5)
        return Tagger({}, -10.0, np.zeros((2, 2)), (0.0, 0.0, float(_logit(share or p))))
    number: dict[bytes, int] = {}
    word = np.array([number.setdefault(w, len(number)) for w in words])
    count = Counter(f for w in number for f in features_of(w))
    ids: dict[bytes, int] = {}
    table = np.array([[ids.setdefault(f, len(ids)) if count[f] > 1 or f in marks else -1 for f in features_of(w)] for w in number])
    marked = np.array([any(f in marks for f in features_of(w)) for w in number])
    toxic_doc = np.repeat(np.array(labels, bool), [sum(map(len, lines)) for lines in docs])
    truth = (marked[word] & toxic_doc).astype(np.int64)
    chains = Chains(lengths)
    w, bias, change = train(None, (word, table), len(ids), truth, chains, rounds)
    tagger = Tagger({f: float(w[i]) for f, i in ids.items() if abs(w[i]) > 0.02}, bias, change, (1.0, 0.0, 0.0))
    seen = np.array([_evidence(p) for p in tagger.tag(docs, tagger.emissions())])
    top, amount, offset = logistic(seen, np.array(labels, float)).tolist()
    tagger.scale = (top, amount, offset + (float(_logit(share) - _logit(sum(labels) / len(labels))) / 2 if share else 0.0))
    return tagger


def _spans(text: str, p: np.ndarray, least: float) -> list[dict]:
    """Runs of words with a marginal of at least ``least``, in code points, end exclusive, with their largest."""
    raw = text.encode("utf-8", "surrogatepass")
    apart = np.frombuffer(raw.translate(PART), np.uint8) == 32
    edges = np.flatnonzero(np.diff(np.concatenate(([True], apart, [True])).astype(np.int8)))
    before = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))  # code points before a byte
    runs = np.flatnonzero(np.diff(np.concatenate(([False], p >= least, [False])).astype(np.int8)))
    return [{"start": int(before[edges[2 * a]]), "end": int(before[edges[2 * b - 1]]), "p": float(p[a:b].max())} for a, b in zip(runs[::2].tolist(), runs[1::2].tolist(), strict=True)]


SCORED = "toxic_score double, toxic_spans array<struct<start:bigint,end:bigint,p:double>>"


def tag_documents(docs: DataFrame, tagger: Tagger, least: float = 0.5) -> DataFrame:
    """docs with toxic_score (0 to 1) and toxic_spans (offsets of runs of words with a marginal of at least ``least``).

    Every word of a text is tagged; a line is a chain, however long. A null, empty or wordless text has no
    span and the score of a marginal of none. Columns of docs with the results' names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def make():
        model = shared.value
        cache = model.emissions()

        def apply(batch):
            texts = batch.column("text").to_pylist()
            tagged = model.tag([lines_of(t) for t in texts], cache)
            return [[model.score(p) for p in tagged], [_spans(t, p, least) if len(p) and p.max() >= least else [] for t, p in zip(texts, tagged, strict=True)]]

        return apply

    return appended(docs, SCORED, make)


def held_out() -> Column:
    """Rows whose label no toxicity model may see: crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, usable: Column | None = None, rows: int = 2400, text_bytes: int = 20_000) -> Tagger:
    """A tagger from at most ``rows`` labelled texts of at most ``text_bytes`` bytes each (see labelled_sample).

    Scores are for odds half-way, by their geometric mean, between those of the sample, in which the labels are about as
    frequent, and those of all labels that may be learnt from: a toxic document that is missed counts more than a wrong alarm."""
    usable = ~held_out() if usable is None else usable
    share = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    return fit(labelled_sample(docs, labels, "toxic", usable, rows, text_bytes), share)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted (score at least ``threshold``) for every document."""
    scored = tag_documents(docs.select("doc_id", "text"), fit_on(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= threshold).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs without those that score at least ``threshold``; columns of docs stay as they are, whatever their names."""
    rows, back = shielded(docs, "toxic_score", "toxic_spans")
    return tag_documents(rows, fit_on(docs, labels)).where(F.col("toxic_score") < threshold).select(*back)
