"""SimHash near-dedup by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.llm.common import appended, written
from vellum.llm.components import components

BITS = 64
#: The fingerprint of a shingle set: as many symbols, each the least of the set's hashes under a permutation of 32 bits.
BANDS, SYMBOLS = 14, 11
TIMES, PLUS = (np.random.default_rng(42).integers(0, 1 << 32, (2, BANDS * SYMBOLS), np.uint32) | np.array([[1], [0]], np.uint32))
PLACES = np.arange(1, BANDS * SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The majority, bit by bit, of the XXH64 of all word shingles, as a signed 64-bit number.

    A-Z are lower-cased; words lie between ASCII white space; repeated shingles count each time. Fewer words than a
    shingle takes are one shingle; no words, as in null and empty texts, give zero.
    """
    votes, n = _votes(text, words, seed, 1)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def _votes(text: str | None, words: int, seed: int, lanes: int) -> tuple[np.ndarray, int]:
    """How many shingle hashes set each of 64 * lanes bits, and how many shingles there are; further lanes mix the hash."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    votes = np.zeros(BITS * lanes, np.int64)
    if not found:
        return votes, 0
    joined, hash_of = b" ".join(found), xxhash.xxh64_intdigest
    n = max(1, len(found) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[len(found) - n :].tolist()
    for at in range(0, n, 1 << 15):  # bounded memory for very long texts
        h = np.array([hash_of(joined[i:j], seed) for i, j in zip(starts[at : at + (1 << 15)], stops[at : at + (1 << 15)], strict=True)], "<u8")
        for lane in range(lanes):
            if lane:
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * lane)
                h ^= h >> np.uint64(29)
            votes[BITS * lane : BITS * (lane + 1)] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return votes, n


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs with their fingerprint (a column of that name is replaced)."""
    return appended(docs, "fingerprint bigint", lambda: lambda b: [[fingerprint(t, words) for t in b.column("text").to_pylist()]])


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """rows over all shuffle partitions: few bytes here become many rows in the next step."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): pairs of different fingerprints at ``radius`` or fewer bits that connect all that such pairs connect.

    Two fingerprints at up to ``radius`` bits share a variant at half the radius from both, so each emits its whole
    ball of that size. All that meet on a variant lie within the radius of each other, and at most one ball of them
    can meet; each is linked to the smallest of them, which loses no connection. Pairs are deduplicated and verified.
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even: half of it is the size of the balls")
    masks = [sum(1 << b for b in bits) for k in range(radius // 2 + 1) for bits in combinations(range(BITS), k)]
    signed = [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]
    ball = F.explode(F.array(*(F.col("fingerprint").bitwiseXOR(F.lit(m)) for m in signed)) if len(masks) < 100 else F.transform(F.lit(signed), lambda m: F.col("fingerprint").bitwiseXOR(m)))
    met = _spread(prints.select("fingerprint").distinct(), "fingerprint").select("fingerprint", ball.alias("variant"))
    least = F.min("fingerprint").over(Window.partitionBy("variant"))
    pairs = met.select(F.col("fingerprint").alias("a"), least.alias("b")).where("a <> b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest doc_id that links reach, the document's own included.

    Exact copies share a fingerprint, so that only distinct fingerprints are linked and any number of copies costs
    one row. Rows without doc_id stay and take the component's smallest other id (null where there is none).
    Repeated rows come out as often as they go in; an empty table gives no rows.
    """
    marks = written(fingerprints(docs.select("doc_id", "text"), words).select("doc_id", "fingerprint"))
    firsts = marks.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    roots = components(links(marks, radius)).select(F.col("a").alias("fingerprint"), F.col("b").alias("root"))
    groups = _named(firsts, roots, "fingerprint")
    return marks.join(groups, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _named(firsts: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """(key, component_id): the smallest ``first`` of each component, which partial minima find however large it is."""
    rooted = firsts.join(roots, key, "left").withColumn("root", F.coalesce("root", key))
    return rooted.select(key, "root").join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select(key, "component_id")


def hexadecimal(fingerprints_column: str = "fingerprint"):
    return F.lower(F.lpad(F.hex(fingerprints_column), 16, "0"))


def shingle_set(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct XXH64 hashes of all word shingles, sorted: words and short texts as in fingerprint, none for no words."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    joined, hash_of = b" ".join(found), xxhash.xxh64_intdigest
    n = max(1, len(found) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    return np.unique(np.fromiter((hash_of(joined[i:j], seed) for i, j in zip(starts, ends[len(found) - n :].tolist(), strict=True)), np.uint64, n))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def symbols(shingles: np.ndarray) -> np.ndarray:
    """The fingerprint of a shingle set: (bands, symbols)."""
    h, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(BANDS * SYMBOLS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 1 << 10):  # bounded memory for very long texts
        np.minimum(least, (TIMES[:, None] * h[None, at : at + (1 << 10)] + PLUS[:, None]).min(1), out=least)
    return least.reshape(BANDS, SYMBOLS)


def balls(shingles: np.ndarray) -> list[int]:
    """A signed 64-bit hash of each variant of each band of the fingerprint: the band with any one symbol left open.

    Two bands share a variant if, and only if, they differ in one symbol at most; if they differ in none they share all."""
    return _balls(shingles)[0]


def _balls(shingles: np.ndarray) -> tuple[list[int], list[int]]:
    """(balls, a hash of each whole band)."""
    if not len(shingles):
        return [], []
    each = _mixed(symbols(shingles).astype(np.uint64) + PLACES.reshape(BANDS, SYMBOLS))
    whole = each.sum(1, dtype=np.uint64)
    return _mixed((whole[:, None] - each).ravel() + PLACES).view(np.int64).tolist(), _mixed(whole).view(np.int64).tolist()


def sketches(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs with id (a hash of the shingle set), size (its shingles), balls and bands (hashes of whole bands)."""

    def make():
        def apply(batch):
            sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            ids = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            return [ids.tolist(), [len(s) for s in sets], *map(list, zip(*map(_balls, sets), strict=True))]

        return apply

    return appended(docs, "id bigint, size bigint, balls array<bigint>, bands array<bigint>", make)


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, ...) whose shingle sets are that similar: common shingles by all of both, exactly."""
    of = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"{c}_set"))
    common = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(common + 1e-9 >= similarity * (F.size("a_set") + F.size("b_set") - common)).select(*pairs.columns)


WORDS = 4


def _member(size: Column, shared: Column, words: list[Column]) -> Column:
    """A set in comparisons: its shingles, how many of them another can have, and a bitmap of those by their hashes."""
    return F.struct("id", size.alias("size"), shared.alias("shared"), *(w.alias(f"w{i}") for i, w in enumerate(words)))


def _met(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b, a_root, b_root) from (m, root, o, o_root) that nothing has connected yet.

    Sets of which too few shingles can be common for that similarity are left out: no more are than either has to share,
    less those whose bit the other's bitmap lacks."""
    lacks = lambda x, y: sum(F.bit_count(F.col(f"{x}.w{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}.w{i}")))) for i in range(WORDS))
    most = F.least(F.col("m.shared") - lacks("m", "o"), F.col("o.shared") - lacks("o", "m"))
    alike = most + 1e-9 >= similarity * (F.col("m.size") + F.col("o.size") - most)
    return rows.where((F.col("root") != F.col("o_root")) & alike).select(F.col("m.id").alias("a"), F.col("o.id").alias("b"), F.col("root").alias("a_root"), F.col("o_root").alias("b_root"))


def _exploded(held: DataFrame) -> DataFrame:
    """(ball, whole, m, root): held's members by the variants that they share."""
    return held.select("m", "root", F.explode("balls").alias("x")).select("x.ball", "x.whole", "m", "root")


def _shared_sizes(held: DataFrame, sets: DataFrame) -> DataFrame:
    """held, whose members know how many of their shingles a set of another component holds, with a bitmap of these: no
    two that are still to be compared can have others in common."""
    here = sets.join(held.select("m.id", "root"), "id").select("id", "root", F.explode("shingles").alias("shingle"))
    own = here.groupBy("shingle").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low = _high").select("shingle")
    bit = F.expr("shiftleft(1L, CAST(pmod(shingle, 64) AS INT))")
    word = F.pmod(F.shiftright("shingle", 6), F.lit(WORDS))
    known = here.join(own, "shingle", "left_anti").groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"), *(F.coalesce(F.bit_or(F.when(word == i, bit)), F.lit(0).cast("long")).alias(f"_w{i}") for i in range(WORDS)))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    joined = held.select("m.id", "m.size", "root", "balls").join(known, F.expr("id = _id"), "left")
    return joined.select(_member(F.col("size"), none("_n"), [none(f"_w{i}") for i in range(WORDS)]).alias("m"), "root", "balls")


def _chosen_pairs(apart: DataFrame, similarity: float, k: int) -> DataFrame:
    """(a, b, a_root, b_root): pairs of ids to compare in round k.

    All that meet on a variant are met by one of them. Of what it meets so, in the first round each set compares one
    pair, with the same one as its neighbours where it can: the first by a common order. Later rounds compare one pair of
    each two components, that which shares most variants."""
    group = Window.partitionBy("ball")
    centre = F.min(F.struct(F.xxhash64("m.id", F.lit(k)).alias("h"), "m", "root")).over(group)
    met = _met(apart.withColumn("c", centre).select("m", "root", F.col("c.m").alias("o"), F.col("c.root").alias("o_root")), similarity)
    if k == 0:
        first = F.min(F.struct(F.xxhash64("b", F.lit(k)).alias("h"), "b", "a_root", "b_root")).alias("p")
        return met.groupBy("a").agg(first).select("a", "p.b", "p.a_root", "p.b_root")
    often = met.groupBy(*met.columns).agg(F.count(F.lit(1)).alias("n"))
    most = F.max(F.struct("n", *met.columns)).alias("p")
    return often.groupBy(F.least("a_root", "b_root"), F.greatest("a_root", "b_root")).agg(most).select(*(f"p.{c}" for c in met.columns))


def _roots(held: DataFrame, sets: DataFrame, similarity: float, rounds: int = 2) -> DataFrame:
    """(id, root) of all that similar pairs connect that share a variant (held: m, root, balls); other ids are their own.

    Only pairs that nothing has connected yet need comparing. While these are many, rounds compare few pairs of each
    component (see _chosen_pairs), and components shrink to their roots; then each pair that is left is compared.
    Members are one row each, with the variants they share; roots are joined to members, not to variants.
    """
    joined, group, last = [], Window.partitionBy("ball"), False
    for k in range(rounds + 1):
        apart = _exploded(held)
        if last:
            other = apart.select("ball", F.col("whole").alias("o_whole"), F.col("m").alias("o"), F.col("root").alias("o_root"))
            met = apart.join(other, "ball").where("m.id < o.id AND (whole = 0 OR whole <> o_whole)")
            pairs = _met(met, similarity).dropDuplicates(["a", "b"])
        else:
            pairs = _chosen_pairs(apart, similarity, k)
        links = _similar(pairs, sets, similarity)
        joined.append(components(links.select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))))
        if last:
            break
        held = held.join(joined[-1].select(F.col("a").alias("root"), F.col("b").alias("_root")), "root", "left").select("m", F.coalesce("_root", "root").alias("root"), "balls")
        still = _exploded(held).withColumn("_l", F.min("root").over(group)).withColumn("_h", F.max("root").over(group)).where("_l <> _h")
        held = written(still.groupBy("m", "root").agg(F.collect_list(F.struct("ball", "whole")).alias("balls")))
        counts = _exploded(held).groupBy("ball", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("ball").agg(F.sum("n").alias("n"), F.expr("sum(double(n) * n)").alias("s"))
        members, left = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.expr("sum(double(n) * n - s) / 2"), F.lit(0.0))).first()
        if not left:
            break
        last = left <= 4 * members or k + 1 == rounds
        held = written(_shared_sizes(held, sets)) if last else held
    roots = joined[0].select(F.col("a").alias("id"), F.col("b").alias("root"))
    for more in joined[1:]:  # a root that was joined later passes its members on
        step = more.select(F.col("a").alias("root"), F.col("b").alias("_root"))
        passed = roots.join(step, "root", "left").select("id", F.coalesce("_root", "root").alias("root"))
        roots = passed.unionAll(step.select(F.col("root").alias("id"), F.col("_root").alias("root")))
    return roots


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) by shingles of five words: a pair is linked if its sets' similarity is 0.8 or more.

    Ball hashing over another fingerprint than near_duplicates', as majority bits can't serve here: at 0.8 two texts
    differ in about 15 of 100 of them, far beyond any ball that can be listed. This fingerprint has BANDS bands of
    SYMBOLS symbols, minima of the hashed set, which differ in 20 of 100 then but are so rich that two that agree do
    so for a reason. In each band every text emits all variants with one symbol left open; texts that meet on a
    variant differ in one symbol of that band at most. Of pairs with a similarity s, 1 - (1 - s^11 - 11 s^10 (1 - s))^14
    meet: all but four in a thousand at 0.8, one in a hundred at 0.4. Pairs are deduplicated and verified by the exact
    similarity of the whole sets (common shingles by all of both). Texts without a common shingle don't meet, so
    meetings don't grow with the square of the texts.

    Of all that meet on variants a few pairs of each component are compared, round by round, and in the end all pairs
    that these comparisons have not connected, but for pairs that can't be similar by their sizes or by the shingles that
    no other set holds. So a family of copies costs a few pairs a member; only texts that meet without being similar, and
    consist of shared passages, cost the square of their number.

    Equal sets, as of exact copies, are one id. Null and empty texts are alike; rows without doc_id are treated as in
    near_duplicates.
    """
    marks = written(sketches(docs.select("doc_id", "text"), words).select("doc_id", F.xxhash64("text").alias("mark"), "id", "size", "balls", "bands"))
    firsts = marks.groupBy("id").agg(F.min("doc_id").alias("first"))
    at = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "mark")
    different = written(marks.groupBy("id").agg(F.first("size").alias("size"), F.first("balls").alias("balls"), F.first("bands").alias("bands"), F.min(at).alias("at")))
    met = _spread(different.select("id", "balls"), "id").select("id", F.explode("balls").alias("ball"))
    group = Window.partitionBy("ball")
    met = met.withColumn("low", F.min("id").over(group)).withColumn("high", F.max("id").over(group)).where("low <> high")
    mine = met.groupBy("id").agg(F.collect_list("ball").alias("mine"))
    # sets that share a whole band share all its variants, and need to meet on the first only, which a zero stands for
    whole = F.transform("balls", lambda b, i: F.struct(b.alias("ball"), F.when(i % SYMBOLS == 0, 0).otherwise(F.get("bands", F.floor(i / SYMBOLS).cast("int"))).alias("whole")))
    held = F.filter(whole, lambda x: F.array_contains("mine", x["ball"])).alias("balls")
    shared = written(mine.join(different, "id").select(_member(F.col("size"), F.col("size"), [F.lit(-1).cast("long")] * WORDS).alias("m"), F.col("id").alias("root"), held))
    wanted = shared.select("m.id").join(different, "id").select("id", F.col("at.doc_id").alias("_doc"), F.col("at.mark").alias("_mark"))
    found = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_mark"))).select("id", "text")
    sets = written(appended(found, "shingles array<bigint>", lambda: lambda b: [[shingle_set(t, words).view(np.int64) for t in b.column("text").to_pylist()]]).select("id", "shingles").dropDuplicates(["id"]))
    roots = _roots(shared, sets, similarity)
    groups = _named(firsts, roots, "id")
    return marks.select("doc_id", "id").join(groups, "id").select("doc_id", "component_id")


def deduplicate(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = similar_documents) -> DataFrame:
    """docs of which one of each group of near copies stays: the one with the smallest doc_id, with all its rows.

    ``groups`` gives each document's component: similar_documents or near_duplicates. Rows without doc_id can't be
    told apart and stay."""
    kept = groups(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
