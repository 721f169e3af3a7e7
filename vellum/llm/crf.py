"""A linear-chain conditional random field with two labels, in numpy."""

from __future__ import annotations

import numpy as np


class Chains:
    """Sequences laid out one after the other, in blocks of at most ``block`` positions.

    A step touches all blocks that are that long at once. Blocks of a longer sequence hand their messages on, so the
    results are those of whole sequences, and a single long one costs few steps.
    """

    def __init__(self, lengths: np.ndarray, block: int = 512):
        lengths = np.asarray(lengths, np.int64)
        lengths = lengths[lengths > 0]
        pieces = -(-lengths // block)
        sizes = np.full(int(pieces.sum()), block, np.int64)
        last = np.cumsum(pieces) - 1
        sizes[last] = lengths - (pieces - 1) * block
        starts = np.cumsum(sizes) - sizes
        #: Where sequences begin.
        self.first = starts[last - pieces + 1]
        order = np.argsort(-sizes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.starts, self.sizes = starts[order], sizes[order]
        #: Runs of blocks that are one sequence, by place in that order.
        self.long = [place[e - n + 1 : e + 1] for e, n in zip(last[pieces > 1].tolist(), pieces[pieces > 1].tolist(), strict=True)]
        self.longest = int(sizes.max()) if len(sizes) else 0
        # how many blocks have a position t
        self.alive = np.searchsorted(-self.sizes, -np.arange(self.longest), "left").tolist()

    def messages(self, weight: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each block the odds of label 1 just before it, and those that come back to its end from behind.

        A block is a product of two-by-two matrices, and a long sequence a product of its blocks. Blocks that nothing
        precedes or follows have odds that have no effect: -1 before, 1 behind.
        """
        before, behind = np.full(len(self.starts), -1.0), np.ones(len(self.starts))
        if not self.long:
            return before, behind
        of = np.sort(np.concatenate(self.long))  # longest first, as all blocks are
        begin = np.isin(of, [run[0] for run in self.long])
        m = np.broadcast_to(np.eye(2), (len(of), 2, 2)).copy()
        for t in range(self.longest):
            n = int(np.searchsorted(-self.sizes[of], -t, "left"))
            step = m[:n] @ e if t else np.where(begin[:, None, None], m, m @ e)
            step = step * np.stack([np.ones(n), weight[self.starts[of[:n]] + t]], 1)[:, None, :]
            m[:n] = step / step.sum((1, 2), keepdims=True)
        at = {int(k): i for i, k in enumerate(of)}
        for run in self.long:
            v = np.ones(2)
            for k, after in zip(run[:-1].tolist(), run[1:].tolist(), strict=True):
                v = v @ m[at[k]]
                v /= v.sum()
                before[after] = v[1] / v[0]
            v = np.ones(2)
            for k, after in zip(run[-2::-1].tolist(), run[:0:-1].tolist(), strict=True):
                v = m[at[after]] @ v
                v /= v.sum()
                behind[k] = v[1] / v[0]
        return before, behind


def marginals(scores: np.ndarray, change: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward: (p of label 1 at each position, forward odds, backward odds).

    scores: label 1's score less label 0's at each position. change[a, b]: score of label b after label a.
    Messages are kept as odds of label 1 to label 0, which is all that two labels need.
    """
    weight = np.exp(np.clip(scores, -30, 30))
    e = np.exp(change)
    forward, backward = np.empty(len(scores)), np.ones(len(scores))
    before, behind = chains.messages(weight, e)
    for t, n in enumerate(chains.alive):
        at = chains.starts[:n] + t
        r = forward[at - 1] if t else np.maximum(before, 0)
        forward[at] = weight[at] * ((e[0, 1] + r * e[1, 1]) / (e[0, 0] + r * e[1, 0]))
        if t == 0:
            forward[at[before < 0]] = weight[at[before < 0]]
    backward[chains.starts + chains.sizes - 1] = behind
    for t in range(chains.longest - 2, -1, -1):
        at = chains.starts[: chains.alive[t + 1]] + t
        r = weight[at + 1] * backward[at + 1]
        backward[at] = (e[1, 0] + r * e[1, 1]) / (e[0, 0] + r * e[0, 1])
    odds = forward * backward
    return odds / (1 + odds), forward, backward


def pair_expectations(scores: np.ndarray, change: np.ndarray, chains: Chains, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """Expected counts of (label, next label) over all neighbours."""
    out = np.zeros((2, 2))
    first = np.zeros(len(scores), bool)
    first[chains.first] = True
    at = np.flatnonzero(~first)
    r, s = forward[at - 1], np.exp(np.clip(scores[at], -30, 30)) * backward[at]
    e = np.exp(change)
    p = np.stack([e[0, 0] * np.ones_like(r), e[0, 1] * s, r * e[1, 0], r * s * e[1, 1]])
    p /= p.sum(0)
    out[:] = p.sum(1).reshape(2, 2)
    return out


def train(rows: np.ndarray | None, groups: tuple[np.ndarray, np.ndarray] | None, size: int, labels: np.ndarray, chains: Chains, rounds: int = 60, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights, bias, change) by gradient ascent on the log-likelihood, with steps scaled by past gradients.

    A position's features are a dense row of ``rows``, or, by ``groups`` = (position's word, word's feature ids with
    -1 for none), the set features of its word.
    """
    w, bias, change = np.zeros(size), 0.0, np.zeros((2, 2))
    seen = [np.full(size, 1e-8), 1e-8, np.full((2, 2), 1e-8)]
    first = np.zeros(len(labels), bool)
    first[chains.first] = True
    at = np.flatnonzero(~first)
    truth = np.bincount(labels[at - 1] * 2 + labels[at], minlength=4).reshape(2, 2).astype(float)
    n = max(len(labels), 1)
    if groups is not None:
        word, features = groups
        there, of = features >= 0, np.repeat(np.arange(len(features)), features.shape[1]).reshape(features.shape)
    for _ in range(rounds):
        if groups is not None:
            scores = (np.where(there, w[features], 0).sum(1) + bias)[word]
        else:
            scores = rows @ w + bias
        p, forward, backward = marginals(scores, change, chains)
        miss = labels - p
        if groups is not None:
            by_word = np.bincount(word, miss, len(features))
            slope = np.bincount(features[there], by_word[of[there]], size)
        else:
            slope = rows.T @ miss
        slopes = [slope / n - decay * w, miss.sum() / n, (truth - pair_expectations(scores, change, chains, forward, backward)) / n - decay * change]
        for k in range(3):
            seen[k] = 0.9 * seen[k] + 0.1 * slopes[k] ** 2
        w = w + rate * slopes[0] / (np.sqrt(seen[0]) + 1e-6)
        bias = bias + rate * slopes[1] / (np.sqrt(seen[1]) + 1e-6)
        change = change + rate * slopes[2] / (np.sqrt(seen[2]) + 1e-6)
        rate *= 0.97
    return w, float(bias), change


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 300, decay: float = 1e-3) -> np.ndarray:
    """Weights (last: bias) of a logistic regression of y on the columns of x, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(min(rounds, 30)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + (decay * len(x) + 1e-6) * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, x.T @ (y - p) - decay * len(x) * w), -5, 5)
    return w
