"""Pattern packing, spelling variants and collocations: brute force, exact round trips and odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vellum.llm import collocations, pattern_packing, variants
from vellum.llm.quotient import Filter, permuted

DOCS = "doc_id bigint, text string, lang string, word string, sequence_id string, piece string, n string, key string"


def docs_of(spark, rows):
    """Documents (doc_id, text, lang) with extra columns whose names clash with results."""
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], DOCS)


ODD = [(None, "no id of mine", "en"), (1, None, "en"), (2, "", None), (3, " \t\n", "en"), (4, "same words here", "fr"), (4, "same words here", "fr"), (5, "word " * 30_000, None)]


# 11 pattern packing
def test_patterns_and_plan():
    rng = np.random.default_rng(5)
    for window, n, high in ((12, 40, 12), (64, 500, 40), (64, 2000, 64), (100, 3, 100), (2048, 4000, 2048), (16, 1, 16)):
        counts = np.bincount(rng.integers(1, high + 1, n), minlength=window + 1)
        rows = pattern_packing.patterns(np.flatnonzero(counts), window, 2)
        assert ((rows.sum(1) <= window) & (rows.sum(1) >= window - 2)).all() and len({tuple(r) for r in rows.tolist()}) == len(rows)
        found = pattern_packing.plan(counts, window)
        used = Counter()
        for pattern, repeats in found:
            assert repeats > 0 and sum(v * k for v, k in pattern.items()) <= window
            used.update({v: k * repeats for v, k in pattern.items()})
        assert used == Counter({v: k for v, k in enumerate(counts.tolist()) if k})
        total = int((counts * np.arange(window + 1)).sum())
        assert sum(r for _, r in found) <= max(-(-total // window) * 1.02 + 2, counts[window // 2 + 1 :].sum() * 1.02 + 2)
    assert pattern_packing.plan(np.zeros(9, np.int64), 8) == []


def test_fit_is_the_least_squares():
    """The fitted repeats against conditions that hold at the optimum only."""
    rng = np.random.default_rng(6)
    counts = np.bincount(rng.integers(1, 21, 300), minlength=21)
    rows = pattern_packing.patterns(np.arange(1, 21), 20, 2)
    x = pattern_packing.fit(rows, counts, 20000)
    a = np.zeros((21, len(rows)))
    for j, r in enumerate(rows):
        for v in r[r > 0]:
            a[v, j] += 1
    slope = a.T @ (np.arange(21) / 20 * (a @ x - np.append(0, counts[1:])))
    assert (x >= 0).all() and (slope > -0.05).all() and np.abs(slope[x > 0.01]).max() < 0.05


@pytest.mark.parametrize("window", [8, 2048])
def test_pattern_packing(spark, window):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(pattern_packing.tokenizer_path())
    rng = random.Random(2)
    texts = {100 + i: " ".join(rng.choices(["one", "two three", "é", "naïve", "4", "."], k=rng.choice([0, 1, 3, 9, 200]))) for i in range(150)}
    rows = ODD + [(i, t, "en") for i, t in texts.items()] + [(9000 + i, "copy", "en") for i in range(60)]
    docs = docs_of(spark, rows).repartition(5)
    got = pattern_packing.pack_by_patterns(docs, window=window, with_ids=True).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    want = defaultdict(list)
    for i, t, _ in rows:
        want[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    assert by.keys() == want.keys()
    for i, whole in want.items():
        pieces = sorted(by[i], key=lambda r: (r["piece"], r["start"]))
        if len(whole) == 1:
            assert [x for r in pieces for x in r["ids"]] == whole[0]
            assert [r["piece"] for r in pieces] == list(range(len(pieces)))
            assert [r["start"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces)])[:-1].tolist()
            assert all(r["length"] == window for r in pieces[1:]) and 0 < pieces[0]["length"] <= window
        else:
            assert sum(r["length"] for r in pieces) == sum(map(len, whole))
    for pieces in sequences.values():
        pieces = sorted(pieces, key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces)])[:-1].tolist()
        assert sum(r["length"] for r in pieces) <= window
    total = sum(r["length"] for r in got)
    assert len(sequences) <= total / window * 1.02 + 1
    assert pattern_packing.pack_by_patterns(docs_of(spark, [])).count() == 0


# 12 spelling variants
def plain_words(rows, least_length=5, least_count=3, rare=97):
    seen = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % rare == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= least_length and n >= least_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    return any(a[:i] + a[i + (len(a) == len(b)) :] == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain_variants(words):
    near, out = defaultdict(list), {}
    masks = defaultdict(set)
    for w in words:  # every pair is compared that could be near: they share a word with one place left out
        for i in range(len(w)):
            masks[w[:i] + w[i + 1 :]].add(w)
        masks[w].add(w)
    for group in masks.values():
        for a in group:
            near[a] += [b for b in group if one_edit(a, b)]
    for w, n in words.items():
        mine = set(near[w])
        best = min(mine, key=lambda x: (-words[x], x), default=None)
        out[w] = [best if best and words[best] >= 2 * n else None, n, len(mine)]
    for w in words:
        end = w
        while out[end][0]:
            end = out[end][0]
        out[w].append(end)
    return {w: (f, r, n, k, words.get(f)) for w, (f, n, k, r) in out.items()}


def test_one_edit_by_brute_force():
    rng = random.Random(1)
    some = ["".join(rng.choices("ab", k=rng.randint(3, 5))) for _ in range(60)]
    for a in some:
        edits = {a[:i] + c + a[i + k :] for i in range(len(a) + 1) for c in ("", *"ab") for k in (0, 1)} - {a}
        assert all(one_edit(a, b) == (b in edits) for b in some)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnopéü"])
def test_spelling_variants(spark, alphabet):
    rng = random.Random(7)
    base = ["".join(rng.choices(alphabet, k=rng.randint(5, 11))) for _ in range(150)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa"]
    def spoilt(w):
        i, c = rng.randrange(len(w) + 1), rng.choice(alphabet)
        return rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w, w, w])
    rows = [(i, " ".join(spoilt(rng.choice(base)).capitalize() + rng.choice(["", ",", "—x", "\n"]) for _ in range(60)), "en") for i in range(200)] + ODD
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants.spelling_variants(docs_of(spark, rows).repartition(3)).collect()}
    want = plain_variants(plain_words(rows))
    assert got == want and sum(v[0] is not None for v in want.values()) > 20
    assert len(alphabet) > 2 or any(want[v[0]][0] for v in want.values() if v[0])


def test_near_words_with_frequent_grams(spark):
    """A dictionary with grams of all lengths, words of one character and a crowd about one word."""
    rng = random.Random(8)
    words = {"".join(rng.choices("abc", weights=[8, 1, 1], k=rng.randint(5, 9))): rng.randint(1, 90) for _ in range(3000)} | {"a" * k: k for k in range(5, 40)}
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = {(r["word"], r["other"], r["n"], r["m"]) for r in variants.near_words(table, budget=200).collect()}
    assert got == {(a, b, words[a], words[b]) for a in words for b in words if abs(len(a) - len(b)) < 2 and one_edit(a, b)}


def test_words_of_long_and_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK", 50)
    rng = random.Random(9)
    text = "".join(rng.choices("abcàÿ×ŁA 1—", weights=[9, 9, 9, 9, 9, 1, 1, 1, 3, 1, 1], k=3000))
    assert [r.decode("latin-1") for r in variants._runs(text)] == ["".join(c.lower() if "A" <= c <= "Z" else c for c in r) for r in re.findall("[A-Za-zÀ-ÿ]+", text)]
    assert variants.spelling_variants(docs_of(spark, [])).count() == 0
    with pytest.raises(ValueError):
        variants.near_words(spark.createDataFrame([("abc", 1)], "word string, n bigint")).count()


def test_affected_grams_bound_every_edit():
    rng = random.Random(10)
    grams = variants.Grams({"ab", "aba", "abab", "ba", "bab", "\x02a", "b\x03", "aa"})
    for _ in range(300):
        w = "".join(rng.choices("abc", k=rng.randint(5, 9)))
        i, c = rng.randrange(len(w)), rng.choice("abc")
        own = grams(w)
        for other in (w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:], w + c, c + w):
            assert sum((Counter(own) - Counter(grams(other))).values()) <= grams.affected(own)


# 13 collocations
def plain_collocations(rows, least, top=2000, longest=4, within=80):
    f, n = Counter(), Counter()
    for _, t, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    by = defaultdict(list)
    some = {k: a for k, a in f.items() if a >= least}
    for (lang, w), a in some.items():
        if len(w) > 1:
            cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
            s, k = min(cuts)
            held = any(100 * b >= within * a for (g, v), b in some.items() if g == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))))
            if not held:
                by[lang].append((-s, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in by.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])}


def corpus(rng):
    words = ["the", "of", "New", "york", "ünï", "x\x1cy", "a'b", "(c)", "—", "d-e", "😀"]
    make = lambda: " ".join(rng.choice(["New York City", "hong  kong\t", "of the", rng.choice(words), rng.choice(words)]) + rng.choice(["", "", "", ",", ".\n", "\r"]) for _ in range(rng.randint(0, 40)))
    return [(i, make(), rng.choice(["en", "fr", None])) for i in range(300)] + ODD


@pytest.mark.parametrize(("least", "top"), [(30, 2000), (3, 25)])
def test_collocations(spark, monkeypatch, least, top):
    for name, value in (("BLOCK", 300), ("FLUSH", 500)):
        monkeypatch.setattr(collocations, name, value)
    rows = corpus(random.Random(3))
    got = {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations.collocations(docs_of(spark, rows).repartition(3), least, top=top).collect()}
    want = plain_collocations(rows, least, top)
    assert got == want and len(want) > 20
    assert collocations.collocations(docs_of(spark, []), least).count() == 0


def test_blocks_lose_no_words(monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 30)
    rng = random.Random(4)
    for _ in range(300):
        text = b"".join(rng.choices([b"a", b"bc", b" ", b"  ", b"\xff", b"d" * 40], weights=[9, 9, 6, 2, 1, 1], k=120))
        grams = lambda words, n: Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1) if collocations.BREAK not in words[i : i + n])
        split = lambda t: t.replace(collocations.BREAK, b" \xff ").split()
        for n in (1, 2, 3, 4):
            assert sum((grams(split(b), n) for b in collocations.blocks(text, n - 1)), Counter()) == grams(split(text), n)


def test_scores_are_exact(spark):
    big = 1 << 61
    got = spark.createDataFrame([(big + 1, 2 * big, big + 5)], "a bigint, l bigint, r bigint").select(collocations.score("a", __import__("pyspark").sql.functions.expr("cast(l as decimal(19,0)) + r")).alias("s")).first()["s"]
    assert got == 2_000_000 * (big + 1) // (3 * big + 5)


# the counting quotient filter
@pytest.mark.parametrize("width", [8, 40, 56, 64])
@pytest.mark.parametrize("n", [2, 3, 4])
def test_filters_lose_nothing(width, n):
    rng = np.random.default_rng(width + n)
    pool = rng.integers(0, 1 << min(width, 62), (n, 60), dtype=np.uint64)
    pool[:, :20] = pool[:, 20:40]
    pool[n - 1, :20] ^= np.uint64(1)  # rows that differ in their last word only
    take = lambda k: list(pool[:, rng.integers(0, 60, k)])
    parts = [take(k) for k in (1, 700, 3000, 50)]
    want = Counter(tuple(int(c[i]) for c in p) for p in parts for i in range(len(p[0])))
    shards = defaultdict(list)
    for p in parts:
        moved = permuted(p, width)
        assert all((a == b).all() for a, b in zip(permuted(moved, width, back=True), p, strict=True))
        for s, f in Filter.of(moved, width).shards(3):
            shards[s].append(f.to_bytes(3))
    got = Counter()
    for blobs in shards.values():
        columns, counts = Filter.merged([Filter.from_bytes(b) for b in blobs]).at_least(1)
        got.update({tuple(int(c[i]) for c in columns): int(k) for i, k in enumerate(counts)})
    assert got == want


def test_keys_that_meet_are_told_apart():
    """Rows whose sort keys are equal and whose last numbers differ, and counts of every size."""
    a, b = np.array([7, 7, 7, 7, 9], np.uint64), np.array([1, 1, 1, 1, 1], np.uint64)
    c = np.array([5, 4, 5, 4, 5], np.uint64)
    f = Filter.of([a, b, c], 40)
    assert [x.tolist() for x in f.columns] == [[7, 7, 9], [1, 1, 1], [4, 5, 5]] and f.counts.tolist() == [2, 2, 1]
    g = Filter(f.columns, np.array([1, 2, 1 << 40]), 40)
    back = Filter.from_bytes(g.to_bytes(0))
    assert back.counts.tolist() == [1, 2, 1 << 40] and all((x == y).all() for x, y in zip(back.columns, g.columns, strict=True))
    g = Filter(f.columns, np.array([256, 257, 258]), 40)
    assert Filter.from_bytes(g.to_bytes(0)).counts.tolist() == [256, 257, 258]
