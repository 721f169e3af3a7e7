"""Search index, positions by context, CSV by ranges, all faults of a work, nested sections: against plain versions and on crowded data."""

import csv
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from vellum.functions.scan import running_sum
from vellum.operators import anchors, blocks, catalog, markup, merkle, notation, release, runs, search_index
from vellum.sources import csv_ranges, readers


def lines_of(spark, *works):
    return spark.createDataFrame([(i, n, t) for i, w in enumerate(works) for n, t in enumerate(w)], "work_id bigint, no int, line string")


# the search index
LIGHT = "work_id string, title string, title_reading string, sort_reading string, subtitle string, orthography string, classification string, people string, readings string"


@pytest.fixture(scope="module")
def searched(spark, tmp_path_factory):
    rng = random.Random(5)
    word = lambda k: "".join(rng.choices("aab𠮷é あ", k=k)) or None
    rows = [(f"{i:06}", word(rng.randint(0, 9)), word(5), word(2), word(rng.choice([0, 6])), rng.choice("xy"), word(1), "|".join(f"{r}:{word(3)}" for r in ["author", "editor"][: rng.randint(1, 2)]), word(6)) for i in range(400)]
    rows += [("100000", "needle", "n", "a", None, "x", None, "author:q", "r"), ("100001", "needle two", "n", "a", None, "x", None, "author:q", "r"), ("100002", "a needle", "n", "a", None, "y", None, "author:q", "r")]
    rows += [("100003", "t", "n", "a", "sub needle", "x", None, "author:q", "r"), ("100004", "t", "n", "a", None, "x", None, "author:needle", "r"), ("100005", "t", "needle", "a", None, "x", None, "author:q", "r"), ("100006", None, None, None, None, None, None, None, "needle")]
    table = spark.createDataFrame(rows, LIGHT)
    path = str(tmp_path_factory.mktemp("index"))
    search_index.write_search_index(table, path, buckets=16)
    return table, path


@pytest.mark.parametrize("query", ["needle", " a", "aa", "aaa", "ab a", "𠮷", "a𠮷", "𠮷𠮷", "あ", "author:", "|editor:", "zz", "", "needle two three"])
def test_index_finds_what_a_scan_finds(spark, searched, query):
    table, path = searched
    for more in ({}, {"orthography": "x"}, {"author": "q"}, {"sort": "title", "k": 7}, {"sort": "author"}):
        got = search_index.search_index(spark, path, query, buckets=16, **more).collect()
        assert got == catalog.search_catalog(table, query, **more).collect()
    if query == "needle":
        assert [(r["rank"], r["work_id"]) for r in got][:0] == []
        ranks = {r["work_id"]: r["rank"] for r in search_index.index_hits(spark, path, query, 16).collect()}
        assert ranks == {"100000": 1, "100001": 2, "100002": 3, "100003": 4, "100004": 5, "100005": 6, "100006": 6}


def test_a_search_reads_its_own_partitions(spark, searched):
    plan = search_index.index_hits(spark, searched[1], "needle", 16)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[bucket#\d+ IN \([\d,]+\)\]", plan) and "PushedFilters: [In(gram" in plan
    files = {r["f"] for r in search_index.index_hits(spark, searched[1], "needle", 16).sparkSession.read.parquet(f"{searched[1]}/postings").where(F.col("gram") == "ne").select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    assert len(files) <= 4


# positions by context
def plain_context(saved, texts):
    """Positions whose context stands at one place of all blocks of their work."""
    out = {}
    for position, work, before, after in saved:
        needle = before + after
        places = [(b, m.start()) for b, t in texts if b[0] == work for m in re.finditer(f"(?={re.escape(needle)})", t)]
        if len(needle.encode("utf-16-le")) // 2 >= 6 and len(places) == 1:
            out[position] = (places[0][0], len(dict(texts)[places[0][0]][: places[0][1]].encode("utf-16-le")) // 2 + len(before.encode("utf-16-le")) // 2)
    return out


BLOCK = "work_id bigint, block_no int, block_id string, text string, at bigint, size bigint, total bigint"
SAVED = "position_id bigint, work_id bigint, block_id string, offset bigint, before string, after string, percent double"


def test_contexts_by_their_rarest_run(spark):
    rng = random.Random(6)
    texts = [((w, i), "".join(rng.choices("abc𠮷", weights=[5, 3, 1, 1], k=rng.choice([0, 2, 5, 30, 60])))) for w in range(4) for i in range(40)]
    texts += [((w, 90 + i), "equal text here") for w in range(4) for i in range(3)] + [((5, 0), "")]
    saved = []
    for p in range(600):
        (w, _), t = rng.choice(texts)
        i = rng.randint(0, len(t))
        before, after = t[max(0, i - rng.randint(0, 12)) : i], t[i : i + rng.randint(0, 12)]
        saved.append((p, w, before if rng.random() < 0.8 else before + "z", after))
    blocks_ = spark.createDataFrame([(w, i, f"{w}-{i}", t, 0, 0, 0) for (w, i), t in texts], BLOCK)
    frame = spark.createDataFrame([(p, w, "b", 10**6, b, a, 0.5) for p, w, b, a in saved], SAVED)
    got = {r["position_id"]: (r["block_id"], r["offset"]) for r in anchors.restore_context(frame, blocks_).collect()}
    assert got == {p: (f"{b[0]}-{b[1]}", o) for p, (b, o) in plain_context(saved, texts).items()} and len(got) > 50
    assert anchors.restore_context(frame.limit(0), blocks_).count() == 0 == anchors.restore_context(frame, blocks_.limit(0)).count()


def test_a_work_of_many_blocks_and_positions(spark):
    """50,000 positions in a work of 50,000 blocks: what meets is in proportion to them, and one text that thousands share is one."""
    n = 50_000
    text = F.when(F.col("id") % 5 == 0, F.lit("the same words again and again")).otherwise(F.concat(F.lit("chapter "), F.sha2(F.col("id").cast("string"), 256)))
    made = spark.range(n).select(F.lit(1).cast("long").alias("work_id"), F.col("id").cast("int").alias("block_no"), F.concat(F.lit("p-"), "id").alias("block_id"), text.alias("text"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("total"))
    saved = made.select(F.col("block_no").cast("long").alias("position_id"), "work_id", "block_id", F.lit(20).cast("long").alias("offset"), F.substring("text", 1, 20).alias("before"), F.substring("text", 21, 20).alias("after"), F.lit(0.5).alias("percent"))
    got = anchors.restore_context(saved, made)
    assert got.count() == n * 4 // 5 and got.where("block_id <> concat('p-', position_id) OR offset <> 20").count() == 0


# CSV by ranges
def plain_records(text):
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_csv_by_ranges(spark, tmp_path, end):
    rng = random.Random(7)
    want = {}
    for f in ("a.csv", "b.csv", "c.csv"):
        rows = [["h1", "h\n2"]] + [["".join(rng.choices(["x", '"', "\n", ",", "é", " "], weights=[9, 2, 2, 1, 1, 1], k=rng.choice([0, 3, 20, 200]))) for _ in range(2)] for _ in range({"a.csv": 400, "b.csv": 0, "c.csv": 90}[f])]
        plain = lambda v: v if v and not set(v) & set('",\n') and rng.random() < 0.5 else '"' + v.replace('"', '""') + '"'
        (tmp_path / f).write_bytes("".join(",".join(map(plain, r)).replace("\n", end) + end * rng.choice([1, 1, 2]) for r in rows).encode())
        want[f] = rows
    sizes = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "500"}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        found = csv_ranges.csv_records(spark, str(tmp_path))
        got = [(r["head"], plain_records(r["record"])[0]) for r in sorted(found.collect())]
        assert got == [(i == 0, row) for f in sorted(want) for i, row in enumerate(want[f])]
        assert csv_ranges._lines(spark, str(tmp_path)).select("file", "at").distinct().count() > 40
    finally:
        for k in sizes:
            spark.conf.unset(k)


def test_csv_refusals(spark, tmp_path):
    for i, bad in enumerate(['a,b\n"x,y\n', 'a,b\nx"y,z\n', 'a,b\n"x"y,z\n', 'a,b\n"x\n', 'a,b\n"1","2"\n"3""\n']):
        path = tmp_path / f"{i}.csv"
        path.write_text(bad)
        with pytest.raises(Exception, match="quote"):
            csv_ranges.csv_records(spark, str(path)).count()
    (tmp_path / "w.csv").write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception):  # noqa: B017
        readers.read_catalog_csv(spark, str(tmp_path / "w.csv"), {"a": "x", "b": "y"}).collect()
    (tmp_path / "ok.csv").write_text('a,b\n"1\n2",3\n')
    assert [tuple(r)[1:] for r in readers.read_catalog_csv(spark, str(tmp_path / "ok.csv"), {"b": "y", "a": "x"}).collect()] == [("3", "1\n2")]


# all faults of a work
FAULTY = [
    (["abc［＃「xyz」に傍点］"], (0, 3, "unknown-notation")), (["abc［＃「xyz」は太字］"], (0, 3, "unknown-notation")), (["ok", "［＃ここから２字下げ］", "x"], (1, 0, "unclosed-notation")), (["［＃ここで地付き終わり］"], (0, 0, "unclosed-notation")),
    (["前の見出し［＃「見出し」は大見出し］"], (0, 5, "unsupported-construct")), (["𠮷説明［＃「説明」はキャプション］"], (0, 4, "unsupported-construct")), (["［＃キャプション］説明［＃キャプション終わり］"], (0, 0, "unsupported-construct")), (["［＃傍点］x"], (0, 0, "unclosed-notation")),
    (["《よみ》"], (0, 0, "ruby-base")), (["a〔cafe´〕"], (0, 1, "unknown-notation")), (["※［＃「x」、第3水準2-1-1］"], (0, 0, "unknown-notation")), (["plain"], None),
]


def test_no_fault_passes(spark):
    got = {r["work_id"]: r for r in runs.first_failure(notation.line_faults(lines_of(spark, *(w for w, _ in FAULTY))), notation.MESSAGES).collect()}
    assert {i: (r["line"], r["column"], r["code"]) for i, r in got.items()} == {i: f for i, (_, f) in enumerate(FAULTY) if f}
    assert all(r["message"] == notation.MESSAGES[r["code"]] for r in got.values())


def test_faults_of_whole_texts(spark):
    head = ["T", "A", "-" * 30, notation.LEGEND, "-" * 30]
    works = [[*head, "body", "底本：x"], [*head, "a［＃謎］", "底本：x", "［＃謎］"], ["a［＃謎］"], [*head, "b", notation.END_MARK, notation.END_MARK], [*head, "［＃謎", "底本：x"]]
    got = {r["work_id"]: (r["line"], r["column"], r["code"]) for r in runs.first_failure(notation.work_faults(lines_of(spark, *works))).collect()}
    assert got == {1: (5, 1, "unknown-notation"), 2: (-1, 0, "missing-section"), 3: (-1, 0, "unsupported-construct"), 4: (5, 0, "unclosed-notation")}


# sections
def test_sections_are_a_stack(spark):
    pages = [
        "<article><p>one</p><nav>x</nav><p>two</p></article><footer>f</footer>", '<article>a<div class="ad">b<div>c</div>d</div>e<div>g</div>h</article><footer>f</footer>',
        "<article>a<nav>b<p>c</article>out<footer>f</footer>", "<article>a<nav>b<nav>c</nav>d</nav>e</article></nav><footer>f<nav>n</nav>g</footer>", "<nav><article>a</article>b</nav><article>c",
    ]
    nodes = markup.html_nodes(spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string"))
    rows = markup.html_sections(nodes).where("kind = 'text'").orderBy("page_id", "node_no").collect()
    got = ["".join(f"{r['token']}:{(r['section'] or '-')[0]} " for r in rows if r["page_id"] == i).strip() for i in range(len(pages))]
    assert got == ["one:m x:i two:m f:b", "a:m b:i c:i d:i e:m g:m h:m f:b", "a:m b:i c:i out:- f:b", "a:m b:i c:i d:i e:m f:b n:i g:b", "a:m b:i c:m"]
    assert [r["line"] for r in markup.html_lines(nodes).where("page_id = 0").orderBy("line_no").collect()] == ["one", "two"]
    assert {r["page_id"] for r in markup.section_faults(nodes).collect()} == {2, 4}


# pictures
def test_picture_bytes_cross_no_exchange(spark):
    jpeg = lambda w, h: b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x01\x00\x00\x00\xff\xd9"
    rows = [("a", jpeg(3, 4)), ("a", jpeg(5, 6)), ("b", b"GIF89a" + (7).to_bytes(2, "little") + (8).to_bytes(2, "little") + b";"), ("c", b"no picture"), ("d", None), ("e", jpeg(0, 4))]
    found = readers.image_inventory(spark.createDataFrame(rows, "url string, content binary"))
    assert sorted((r["url"], r["width"] or 0, r["height"] or 0, r["code"] or "") for r in found.collect()) == [("a", 3, 4, ""), ("a", 5, 6, ""), ("b", 7, 8, ""), ("c", 0, 0, "invalid-image"), ("d", 0, 0, "invalid-image"), ("e", 0, 0, "invalid-image")]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


# scans by chunks
def test_running_sums_by_chunks(spark):
    rng = random.Random(12)
    rows = [(k, i, rng.choice([None, 0, 1, 7])) for k in ("a", "b", None) for i in rng.sample(range(-50, 400), 200)]
    got = running_sum(spark.createDataFrame(rows, "key string, no int, v int"), "key", "no", F.col("v"), "at", "total", chunk=16)
    want = set()
    for k in ("a", "b"):
        at = 0
        for _, no, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            want.add((k, no, v, at, sum(r[2] or 0 for r in rows if r[0] == k)))
            at += v or 0
    assert {tuple(r) for r in got.where("key IS NOT NULL").collect()} == want


def test_a_long_work_is_many_tasks(spark):
    """A work of 120,000 blocks, 40,000 of them empty in one run: IDs and offsets by small chunks as by one."""
    n = 120_000
    text = F.when(F.col("id").between(50_000, 90_000) | (F.col("id") % 7 == 3), "").otherwise(F.concat(F.lit("line "), F.col("id") % 1000))
    made = spark.range(n).select(F.lit(1).cast("long").alias("work_id"), F.col("id").cast("int").alias("block_no"), F.lit("paragraph").alias("kind"), F.lit(None).cast("string").alias("url"), text.alias("text"))
    by = [blocks.block_offsets(blocks.block_ids(made, c), c) for c in (1000, n)]
    digest = [r.agg(F.count(F.lit(1)), F.sum(F.xxhash64("block_no", "block_id", "at", "size", "total").cast("decimal(20,0)"))).first() for r in by]
    assert digest[0] == digest[1] and digest[0][0] == n
    assert by[0].select("block_id").distinct().count() == n


# stored runs
def test_a_diff_reads_the_buckets_that_differ(spark, tmp_path):
    cols = "work_id string, status string, work_sha256 string, work_bytes bigint, flag string, converter string, raw_sha256 string"
    old = [(f"{i:06}", "converted", f"h{i}", i, "f", "v1", f"r{i}") for i in range(5000)]
    new = [r for r in old if r[0] != "000007"] + [("N00001", "converted", "h", 1, "f", "v1", "r")]
    new = [(*r[:2], "changed", *r[3:6], "other") if r[0] == "000123" else r for r in new]
    a, b = (spark.createDataFrame(rows, cols) for rows in (old, new))
    pa, pb, pc = (str(tmp_path / x) for x in "abc")
    for frame, path in ((a, pa), (b, pb), (a.repartition(3).orderBy(F.desc("work_id")), pc)):
        merkle.write_bucketed_run(frame, path)
    buckets = merkle.differing_buckets(spark, pa, pb)
    assert len(buckets) <= 3 and merkle.differing_buckets(spark, pa, pc) == []
    found = merkle.stored_diff(spark, pa, pb)
    assert found.collect() == release.manifest_diff(a, b).collect() and found.count() == 3
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN", found._jdf.queryExecution().toString())
    assert {tuple(r) for r in merkle.frozen_buckets(spark, pa, pb).collect()} == {tuple(r) for r in runs.frozen_input_check(a, b).collect()}
    assert merkle.stored_diff(spark, pa, pc).count() == 0
