"""Personal data: exact base patterns, and more spans by a character-level bidirectional LSTM with CRF transitions."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import appended, chosen, hashed_low

KINDS = ("email", "ip", "card", "phone")
#: What the network tells apart: the base kinds in any writing, and keys, tokens and passwords.
FOUND = (*KINDS, "secret")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: A match can only begin at the first digit of a run, as one before can only end at the last of a run.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")

Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base patterns' matches, leftmost and non-overlapping per kind, in time linear in the text."""
    found: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        if at >= done:
            start = at
            while start > done and not NOT_LOCAL.match(text, start - 1):
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                found.append((start, m.end(), 0))
                done = m.end()
            else:
                done = max(done, at + 1)  # no match can reach over this sign
        at = text.find("@", at + 1)
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), m.end(), 3))
    found.sort(key=lambda s: (s[0], s[2]))
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{FOUND[k]}:{a}:{b}" for a, b, k in spans)


#: What the network sees of a character: its class, or itself for marks that patterns use.
MARKS = "@.+-_()%/:,;!?#&*\"'|<>=[]{}\\\n\t "
ALPHABET = 5 + len(MARKS)
LABELS = len(FOUND) + 1  # 0: none


def _class(c: str) -> int:
    c = chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else c  # full width
    if c in MARKS:
        return 5 + MARKS.index(c)
    return 3 if c.isdigit() else 2 if c.isupper() else 1 if c.isalpha() else 4 if c.isprintable() else 0


TABLE = np.array([_class(chr(i)) for i in range(1 << 16)] + [4], np.uint8)  # last: all beyond


def encoded(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return TABLE[np.minimum(points, 1 << 16)]


def _squash(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """x / (1 + |x|): the network's tanh, at a sixth of its cost; a gate is half of it and a half more."""
    size = np.abs(x)
    size += 1
    return np.divide(x, size, out=out)


class Lstm:
    """One direction of the network; inputs are character codes, so the input product is a table row."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.hidden = hidden
        self.inputs = rng.normal(0, 0.5, (ALPHABET, 4 * hidden)).astype(np.float32)
        self.inner = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
        self.inputs[:, hidden : 2 * hidden] += 2.0  # forget gates open at first

    def run(self, codes: np.ndarray, alive: list[int], keep: bool = False):
        """codes: (time, rows), of which at each time the first alive[t] are there. Hidden states (time, hidden, rows),
        and what the gradient needs."""
        (steps, rows), n = codes.shape, self.hidden
        h, c = np.zeros((n, rows), np.float32), np.zeros((n, rows), np.float32)
        out = np.zeros((steps, n, rows), np.float32)
        inputs, inner = np.ascontiguousarray(self.inputs.T), np.ascontiguousarray(self.inner.T)
        buffers = [np.empty((k * n, rows), np.float32) for k in (4, 4, 1)]
        tape = []
        for t, m in enumerate(alive):
            z, x, tc = (b[:, :m] for b in buffers)
            now = c[:, :m]
            np.take(inputs, codes[t, :m], axis=1, out=x, mode="clip")
            np.matmul(inner, h[:, :m], out=z)
            z += x
            _squash(z, z)
            if keep:
                tape.append((h, c.copy(), z.copy()))
            gates = z[: 3 * n]
            gates *= 0.5
            gates += 0.5
            i, f, o, g = z[:n], z[n : 2 * n], z[2 * n : 3 * n], z[3 * n :]
            now *= f
            i *= g
            now += i
            _squash(now, tc)
            np.multiply(o, tc, out=out[t, :, :m])
            h = out[t]
        return out, tape

    def slopes(self, codes: np.ndarray, tape: list, dout: np.ndarray) -> list[np.ndarray]:
        n = self.hidden
        dinputs, dinner = np.zeros_like(self.inputs), np.zeros_like(self.inner)
        dh, dc, one = np.zeros_like(dout[0]), np.zeros_like(dout[0]), np.eye(ALPHABET, dtype=np.float32)
        for t in range(len(codes) - 1, -1, -1):
            h, c, s = tape[t]
            i, f, o = (0.5 * s[k * n : (k + 1) * n] + 0.5 for k in range(3))
            g = s[3 * n :]
            tc = _squash(f * c + i * g)
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - np.abs(tc)) ** 2
            dz = np.concatenate([0.5 * dc * g, 0.5 * dc * c, 0.5 * dh * tc, dc * i]) * (1 - np.abs(s)) ** 2
            dinputs += one[codes[t]].T @ dz.T
            dinner += h @ dz.T
            dh, dc = self.inner @ dz, dc * f
        return [dinputs, dinner]


@dataclass
class Finder:
    ahead: Lstm
    back: Lstm
    out: np.ndarray  # (2 hidden + 1, labels)
    change: np.ndarray  # (labels, labels)

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.inputs, self.ahead.inner, self.back.inputs, self.back.inner, self.out, self.change]

    def emissions(self, codes: np.ndarray, sizes: np.ndarray | None = None, keep: bool = False):
        """codes: (time, rows), rows with the given sizes, the longest first. Scores (time, labels, rows)."""
        steps, rows = codes.shape
        alive = np.searchsorted(-sizes, -np.arange(steps), "left").tolist() if sizes is not None else [rows] * steps
        a, tape_a = self.ahead.run(codes, alive, keep)
        b, tape_b = self.back.run(codes[::-1], alive[::-1], keep)
        b, n = b[::-1], self.ahead.hidden
        w = self.out.T
        scores = np.matmul(np.ascontiguousarray(w[:, :n]), a)
        scores += np.matmul(np.ascontiguousarray(w[:, n : 2 * n]), b)
        scores += w[:, -1:]
        return scores, (a, b, tape_a, tape_b)


def posteriors(scores: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label marginals (time, rows, labels) and expected transitions, by forward-backward scaled at each step."""
    w, e = np.exp(scores - scores.max(2, keepdims=True)), np.exp(change)
    f, b, sums = np.empty_like(w), np.ones_like(w), np.empty((*w.shape[:2], 1))
    for t in range(len(w)):
        f[t] = (f[t - 1] @ e if t else 1) * w[t]
        sums[t] = f[t].sum(1, keepdims=True)
        f[t] /= sums[t]
    for t in range(len(w) - 2, -1, -1):
        b[t] = (w[t + 1] * b[t + 1] / sums[t + 1]) @ e.T
    return f * b, e * np.tensordot(f[:-1], w[1:] * b[1:] / sums[1:], ((0, 1), (0, 1)))


def train(windows: np.ndarray, labels: np.ndarray, hidden: int = 6, rounds: int = 10, batch: int = 200, rate: float = 0.06, seed: int = 5) -> Finder:
    """The network from windows of character codes and their labels (rows, time), by likelihood with Adam steps."""
    rng = np.random.default_rng(seed)
    model = Finder(Lstm(hidden, rng), Lstm(hidden, rng), np.zeros((2 * hidden + 1, LABELS), np.float32), np.zeros((LABELS, LABELS), np.float32))
    model.out[:-1] = rng.normal(0, 0.3, (2 * hidden, LABELS))
    model.out[-1, 0] = 2.0
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in model.parameters()]
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            codes, truth = np.ascontiguousarray(windows[rows].T), labels[rows].T
            scores, (a, b, tape_a, tape_b) = model.emissions(codes, keep=True)
            p, pairs = posteriors(scores.transpose(0, 2, 1).astype(np.float64), model.change.astype(np.float64))
            wanted = np.bincount((truth[:-1] * LABELS + truth[1:]).ravel(), minlength=LABELS**2).reshape(LABELS, LABELS)
            n = codes.size
            miss = ((np.eye(LABELS)[truth] - p) / n).transpose(0, 2, 1).astype(np.float32)  # (time, labels, rows)
            dboth = np.matmul(model.out[:-1], miss)
            dout = np.concatenate([np.einsum("thr,tlr->hl", a, miss), np.einsum("thr,tlr->hl", b, miss), miss.sum((0, 2))[None]])
            slopes = [*model.ahead.slopes(codes, tape_a, dboth[:, :hidden]), *model.back.slopes(codes[::-1], tape_b, dboth[::-1, hidden:]), dout, (wanted - pairs) / n]
            step += 1
            for p_, s, m in zip(model.parameters(), slopes, moments, strict=True):
                m[0] = 0.9 * m[0] + 0.1 * s
                m[1] = 0.99 * m[1] + 0.01 * s * s
                p_ += (rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-9)).astype(p_.dtype)
        rate *= 0.8
    return model


def may_hold(scores: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Which rows of scores (time, labels, rows) can have any label but none on their best path.

    The most that a run of other labels can gain over none: its best scores, and the best changes into, inside and out
    of it. Where no run gains anything the best path is none throughout, and needs no search."""
    gain = scores[:, 1:].max(1) - scores[:, 0]
    into, out, inside = change[0, 1:].max() - change[0, 0], change[1:, 0].max() - change[0, 0], change[1:, 1:].max() - change[0, 0]
    run = gain[0].copy()
    best = run + out
    for t in range(1, len(gain)):
        np.maximum(run + inside, into, out=run)
        run += gain[t]
        np.maximum(best, run + out, out=best)
    return np.maximum(best, run) > 0


def viterbi(scores: np.ndarray, change: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The best labels (time, rows) of scores (time, labels, rows); a row ends after its size."""
    steps, _, rows = scores.shape
    back = np.zeros((steps, rows, LABELS), np.int8)
    best = scores[0].T.astype(np.float64)
    for t in range(1, steps):
        options = best[:, :, None] + change
        on = t < sizes
        back[t] = options.argmax(1)
        best = np.where(on[:, None], options.max(1) + scores[t].T, best)
    labels, now, all_rows = np.zeros((steps, rows), np.int64), best.argmax(1), np.arange(rows)
    for t in range(steps - 1, -1, -1):
        on = t < sizes
        labels[t] = np.where(on, now, 0)
        now = np.where(on, back[t, all_rows, now], now) if t else now
    return labels


def reconciled(spans: list[Span]) -> list[Span]:
    """A text's spans from all of its windows: those of a kind that overlap are one, and of different kinds the longest stays."""
    whole: list[Span] = []
    for k in range(len(FOUND)):
        last = None
        for a, b, _ in sorted(s for s in spans if s[2] == k):
            if last and a < last[1]:
                last = (last[0], max(b, last[1]), k)
                whole[-1] = last
            else:
                whole.append(last := (a, b, k))
    out: list[Span] = []
    for s in sorted(whole, key=lambda s: (s[0] - s[1], s)):
        if not any(s[0] < o[1] and o[0] < s[1] for o in out):
            out.append(s)
    return sorted(out)


def found_spans(model: Finder, texts: list[str], window: int = 384, overlap: int = 32, least: int = 6, rows: int = 1024) -> list[list[Span]]:
    """The network's spans in each text, all of which is read.

    Windows overlap by ``overlap`` characters; each is decoded, and what they find is reconciled over the text. Spans
    lose white space and sentence marks at their ends; those shorter than ``least`` are no personal data and go.
    """
    codes = [encoded(t) for t in texts]
    cut = [(i, at, min(window, len(c) - at)) for i, c in enumerate(codes) for at in range(0, max(len(c) - overlap, 1), window - overlap) if len(c)]
    cut.sort(key=lambda w: -w[2])  # short ones together, as all of a batch take as many steps as its longest
    found: list[list[Span]] = [[] for _ in texts]
    for at in range(0, len(cut), rows):
        part = cut[at : at + rows]
        sizes = np.array([size for _, _, size in part])
        grid = np.zeros((len(part), part[0][2]), np.int64)
        for k, (i, lo, size) in enumerate(part):
            grid[k, :size] = codes[i][lo : lo + size]
        scores = model.emissions(np.ascontiguousarray(grid.T), sizes)[0]
        some = np.flatnonzero(may_hold(scores, model.change))
        if not len(some):
            continue
        labels = viterbi(scores[:, :, some], model.change, sizes[some])
        for k, row in zip(some.tolist(), labels.T, strict=True):
            if row.any():
                i, lo, _ = part[k]
                edges = np.flatnonzero(np.diff(np.concatenate(([0], row, [0]))))
                found[i] += [(lo + a, lo + b, int(row[a]) - 1) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if row[a]]
    return [[s for s in reconciled([_whole(t, _trimmed(t, s)) for s in reconciled(spans)]) if s[1] - s[0] >= least] for t, spans in zip(texts, found, strict=True)]


def _whole(text: str, span: Span) -> Span:
    """A secret is all of the token that it touches; other spans stay. What else was found in the token goes with it."""
    a, b, k = span
    if FOUND[k] == "secret" and a < b:
        sign = lambda c: c.isascii() and (c.isalnum() or c in "_-+/")
        while a > 0 and sign(text[a - 1]) and sign(text[a]):
            a -= 1
        while b < len(text) and sign(text[b]) and sign(text[b - 1]):
            b += 1
    return a, b, k


def _trimmed(text: str, span: Span) -> Span:
    a, b, k = span
    while a < b and (text[a].isspace() or text[a] in "\"',;:=<|"):
        a += 1
    while a < b and (text[b - 1].isspace() or text[b - 1] in "\"',;:.!?>|"):
        b -= 1
    return a, b, k


def with_found(base: list[Span], found: list[Span]) -> list[Span]:
    """Base spans, and those found ones that touch none of them or hold all that they touch and more."""
    new = [s for s in found if all(b[1] <= s[0] or s[1] <= b[0] or (s[0] <= b[0] and b[1] <= s[1] and s[1] - s[0] > b[1] - b[0] + 1) for b in base)]
    return sorted(base + new, key=lambda s: (s[0], s[2], s[1]))


def invented(rng: np.random.Generator, kind: int) -> tuple[str, str]:
    """(what stands before it, personal data of a kind) in one of its usual writings, also such as no base pattern matches."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    some = lambda chars, lo, hi: "".join(pick(chars) for _ in range(int(rng.integers(lo, hi + 1))))
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    if kind == 0:
        name = some(low, 2, 9) + pick(["", "", ".", "_", "-"]) + some(low + digits, 1, 8)
        host = [some(low + digits, 2, 9), *([some(low, 3, 8)] if rng.random() < 0.4 else []), pick(["com", "org", "net", "de", "fr", "example", "co.uk"])]
        at, dot = pick([("@", "."), ("@", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", "."), (" @ ", "."), ("＠", "."), ("{at}", "{dot}")])
        return pick(["", "", "mail ", "mailto:", "<"]), name + at + dot.join(host)
    if kind == 1:
        if rng.random() < 0.25:
            return pick(["", "ip ", "from "]), ":".join(some("0123456789abcdef", 1, 4) for _ in range(int(rng.integers(4, 9))))
        return pick(["", "", "ip ", "host "]), pick([".", ".", ".", "[.]", " . ", "(.)", "．"]).join(str(int(rng.integers(0, 256))) for _ in range(4))
    if kind == 2:
        gap = pick([" ", "-", "", ".", "/", "  ", "_"])
        return pick(["", "", "card ", "card: "]), gap.join(some(digits, 4, 4) for _ in range(4))
    if kind == 3:
        a, b, c = some(digits, 3, 3), some(digits, 3, 4), some(digits, 4, 4)
        return pick(["", "", "tel ", "call ", "tel. "]), pick([f"+{some(digits, 1, 2)} ({a}) {b}-{c}", f"+{some(digits, 1, 3)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"0{a} {b} {c}", f"00{some(digits, 2, 2)} {a} {b}{c}", f"{a}.{b}.{c}", f"0{a}/{b}{c}"])
    chars = pick(["0123456789abcdef", low + low.upper() + digits, low + low.upper() + digits + "+/", low.upper() + digits, low + digits + "-_"])
    value = pick(["", "", "", "sk-", "ghp_", "AKIA", "key-", "xoxb-", "eyJ"]) + some(chars, 16, 64)
    word = pick(["token", "key", "secret", "password", "api_key", "apikey", "access_token", "pwd", "auth", "Authorization: Bearer"])
    return pick([f"{word} = \"", f"{word}=", f"{word}: ", f"\"{word}\": \"", f"{word.upper()}=", ""]), value


def ordinary(rng: np.random.Generator) -> str:
    """A number that is no personal data: a year, count, price, date, time or the like."""
    a, b, c = (int(x) for x in rng.integers(1, 60, 3))
    return [str(a), str(1900 + b + c), f"{a}.{b}", f"{a},{100 + 7 * b}", f"{a % 24}:{b:02}", f"20{b:02}-{a % 12 + 1:02}-{c % 28 + 1:02}", f"{a}/{b}/{1950 + c}", f"{a}%", f"{a} or {b}", f"{a}-{b}", f"v{a}.{b}.{c}", f"({a})", f"{a * b * 997}"][int(rng.integers(13))]


def fit(texts: list[str], window: int = 96, windows: int = 4000, seed: int = 5) -> Finder:
    """The network from windows of the texts.

    Labelled are the base patterns' matches in them and invented spans (see invented), one or two of which are put
    between the words of three windows in five; some windows also get ordinary numbers, which are not labelled."""
    rng = np.random.default_rng(seed)
    texts = [t for t in texts if t] or [" "]
    held: dict[int, np.ndarray] = {}
    x, y = np.zeros((windows, window), np.int64), np.zeros((windows, window), np.int64)
    for w in range(windows):
        i = int(rng.integers(len(texts)))
        if i not in held:
            held[i] = np.zeros(len(texts[i]), np.int64)
            for a, b, k in base_spans(texts[i]):
                held[i][a:b] = k + 1
        at = int(rng.integers(max(len(texts[i]) - window, 0) + 1))
        text, labels = texts[i][at : at + window], held[i][at : at + window]
        for _ in range(int(rng.integers(1, 4)) if rng.random() < 0.3 else 0):
            gaps = [g for g in range(len(text)) if text[g].isspace() and not labels[g]] or [0]
            g, number = gaps[int(rng.integers(len(gaps)))], " " + ordinary(rng)
            text, labels = text[:g] + number + text[g:], np.concatenate([labels[:g], np.zeros(len(number), np.int64), labels[g:]])
        for _ in range(int(rng.integers(1, 3)) if rng.random() < 0.6 else 0):
            gaps = [g for g in range(len(text)) if text[g].isspace() and not labels[g]] or [0]
            g, k = gaps[int(rng.integers(len(gaps)))], int(rng.integers(len(FOUND)))
            before, span = invented(rng, k)
            after = str(rng.choice(["", ".", ",", '"' if before.endswith('"') else ""]))
            text = f"{text[:g]} {before}{span}{after}{text[g:]}"
            labels = np.concatenate([labels[:g], np.zeros(1 + len(before), np.int64), np.full(len(span), k + 1), np.zeros(len(after), np.int64), labels[g:]])
        if len(text) > window:
            spot = np.flatnonzero(labels)
            lo = min(max(int(rng.choice(spot)) - int(rng.integers(window)), 0), len(text) - window) if len(spot) else 0
            text, labels = text[lo : lo + window], labels[lo : lo + window]
        x[w, : len(text)], y[w, : len(text)] = encoded(text), labels
    return train(x, y, seed=seed)


def fit_on(docs: DataFrame, rows: int = 1500, chars: int = 2000) -> Finder:
    """The network from a stretch of at most ``chars`` characters of each of at most ``rows`` texts, both chosen by hash of doc_id."""
    some = docs.where(F.col("doc_id").isNotNull() & (F.char_length("text") > 0)).select("doc_id", "text")
    low = hashed_low(rows, n := docs.count(), 8)  # first, so that few texts are touched
    ids = chosen(some.where(low).select("doc_id"), rows, n, ample=8)
    start = F.pmod(F.xxhash64("doc_id", F.lit("start")), F.greatest(F.char_length("text") - chars, F.lit(0)) + 1).cast("int")
    found = some.where(low).select("doc_id", F.substring("text", start + 1, F.lit(chars)).alias("text")).join(F.broadcast(ids.distinct()), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return fit([r["text"] for r in found.orderBy(F.xxhash64("doc_id"), "doc_id").collect()])


SPANS = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, secrets string, n_spans bigint, redacted string"


def redact(text: str, spans: list[Span]) -> str:
    """The text with each stretch that spans cover replaced by its first span's kind."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{FOUND[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, model: Finder | None = None) -> DataFrame:
    """docs with counts of base spans by kind, their digest, all spans of the base kinds, secrets, the number of both, and
    the text with spans replaced.

    Base spans are the patterns' matches; the network reads every whole text and adds spans of the base kinds, and
    secrets, whole tokens, unless they only repeat base ones (see with_found). Offsets are code points, end
    exclusive. A null text is empty. Columns of docs with the results' names are replaced; an empty table trains on
    nothing and gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit_on(docs))

    def make():
        finder = shared.value

        def apply(batch):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = []
            for text, found in zip(texts, found_spans(finder, texts), strict=True):
                base = base_spans(text)
                spans = with_found(base, found)
                rows.append((*(sum(s[2] == k for s in base) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined([s for s in spans if s[2] < 4]), joined([s for s in spans if s[2] >= 4]), len(spans), redact(text, spans)))
            return list(zip(*rows, strict=True))

        return apply

    return appended(docs, SPANS, make)
