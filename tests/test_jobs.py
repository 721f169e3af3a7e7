"""Small hand-made cases: each rejection code, strict readers, positions over revisions, runs that change nothing."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum.operators import anchors, blocks, catalog, images, notation, runs
from vellum.sources import readers

HOST = "https://library.example"


def base(n="000001", row=0, **extra):
    k = n.lstrip("0") or "0"
    row = dict(
        row_no=row, work_id=n, title="T", title_reading="t", sort_reading="t", subtitle="", subtitle_reading="", original_title="", first_publication="", classification="", orthography="新字新仮名", work_copyright="なし",
        published="2020-01-01", updated="2020-01-02", card_url=f"{HOST}/cards/000879/card{k}.html", text_url=f"{HOST}/cards/000879/files/{k}_ruby_1.zip", text_updated="2020-01-02", text_encoding="ShiftJIS",
        xhtml_url=f"{HOST}/cards/000879/files/{k}_1.html", xhtml_updated="2020-01-02", xhtml_encoding="ShiftJIS", person_id="000879", surname="S", given="G", surname_reading="s", given_reading="g", role="著者", person_copyright="なし",
    )
    return row | extra


def frame(spark, rows):
    return spark.createDataFrame(rows, "row_no bigint, " + ", ".join(f"{c} string" for c in catalog.COLUMNS))


CASES = [
    ({"work_id": "12"}, "invalid-field", "work_id"),
    ({"work_copyright": "?"}, "unknown-copyright-flag", "work_copyright"),
    ({"title": " 　"}, "invalid-field", "title"),
    ({"orthography": ""}, "invalid-field", "orthography"),
    ({"card_url": f"{HOST}/cards/000879/card2.html"}, "invalid-field", "card_url"),
    ({"published": "2025-02-31"}, "invalid-field", "published"),
    ({"updated": None}, "invalid-field", "updated"),
    ({"role": "朗読者"}, "unknown-role", "people"),
    ({"person_id": "x"}, "invalid-field", "people"),
    ({"person_id": "000880"}, "invalid-field", "card_person"),
]


@pytest.mark.parametrize("change,code,detail", CASES)
def test_each_rejection(spark, change, code, detail):
    got = catalog.validate_works(catalog.trim_rows(frame(spark, [base(**change)]))).collect()
    assert [(r["code"], r["detail"]) for r in got] == [(code, detail)]


def test_disagreeing_rows_and_names_in_both_orders(spark):
    for flip in (0, 1):
        rows = [base(row=flip), base(row=1 - flip, given="H"), base("000002", row=flip), base("000002", row=1 - flip, title="U")]
        got = {r["work_id"]: r["code"] for r in catalog.validate_works(frame(spark, rows)).collect()}
        assert got == {"000001": "inconsistent-rows", "000002": "inconsistent-rows"}


def test_selection(spark):
    rows = [base(), base("000002", work_copyright="あり"), base("000003", text_url="", xhtml_url=""), base("000004", xhtml_url=f"{HOST}/cards/000879/files/5_1.html"), base("000005", xhtml_encoding="EUC", text_updated="soon")]
    valid = catalog.validate_works(frame(spark, rows)).where("code IS NULL")
    got = {r["work_id"]: (r["outcome"], r["sources"]) for r in catalog.select_bodies(valid).collect()}
    assert got == {"000001": ("fetch", "xhtml,text"), "000002": ("copyright-active", ""), "000003": ("no-body", ""), "000004": ("fetch", "text"), "000005": ("no-body", "")}


def write(tmp_path, text, name="c.csv"):
    p = tmp_path / name
    p.write_bytes(text.encode())
    return str(p)


def csv_of(rows, end="\r\n"):
    head = list(readers.LABELS)
    quoted = lambda v: '"' + v.replace('"', '""') + '"'
    return end.join(",".join(map(quoted, r)) for r in [head, *([r[readers.LABELS[h]] for h in head] for r in rows)]) + end


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_catalog_csv(spark, tmp_path, end):
    rows = [base(title='a,"b"\nc'), base("000002", row=1)]
    got = readers.read_catalog_csv(spark, write(tmp_path, "﻿" + csv_of(rows, end))).orderBy("row_no").collect()
    assert [r["title"] for r in got] == ['a,"b"\nc', "T"] and got[0]["subtitle"] == "" and got[0]["work_id"] == "000001"


def test_csv_is_strict(spark, tmp_path):
    good = csv_of([base()])
    with pytest.raises(ValueError, match="missing"):
        readers.read_catalog_csv(spark, write(tmp_path, good.replace("作品名読み", "別", 1)))
    for bad in (good + '"1",a"b\r\n', good + '"1","2"\r\n'):
        with pytest.raises(Exception):  # noqa: B017
            readers.read_catalog_csv(spark, write(tmp_path, bad)).collect()


def test_bodies(spark):
    def zipped(files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k, v in files.items():
                z.writestr(k, v)
        return out.getvalue()

    rows = [
        (1, "text", "ShiftJIS", zipped({"a.txt": "底本".encode("cp932")})), (2, "text", "ShiftJIS", zipped({"a.txt": b"x", "b.txt": b"y"})), (3, "text", "UTF-8", b"no zip"),
        (4, "xhtml", "UTF-8", "é".encode()), (5, "xhtml", "UTF-8", b"\xff"), (6, "xhtml", "EUC", b"x"), (7, "xhtml", "UTF-8", None),
    ]
    got = {r["work_id"]: (r["text"], r["error"]) for r in readers.decode_bodies(spark.createDataFrame(rows, "work_id int, path string, encoding string, content binary")).collect()}
    assert got == {1: ("底本", None), 4: ("é", None), **{k: (None, "decode-error") for k in (2, 3, 5, 6, 7)}}


def test_assets_round_trip(spark, tmp_path):
    works = spark.createDataFrame([("1", "{}"), ("2", "{}")], "work_id string, json string")
    pictures = spark.createDataFrame([("1", "u2", "image/png", 1, 2, "QQ=="), ("1", "u1", "image/png", 1, 2, "QQ==")], "work_id string, url string, mime string, width int, height int, data string")
    readers.write_assets(works, pictures, str(tmp_path / "a"), 4)
    got = {r["work_id"]: [i["url"] for i in r["images"]] for r in readers.read_assets(spark, str(tmp_path / "a")).collect()}
    assert got == {"1": ["u1", "u2"], "2": []}


def test_write_run_is_the_same_for_any_order(spark, tmp_path):
    cols = [f.split()[0] for f in runs.RECORD.split(", ")]
    rows = [tuple(f"{c}{i}" for c in cols[:-1]) + (i,) for i in range(20)]
    got = []
    for k, some in enumerate((rows, rows[::-1])):
        runs.write_run(spark.createDataFrame(some, runs.RECORD).repartition(3), str(tmp_path / f"r{k}"))
        got.append(spark.read.parquet(str(tmp_path / f"r{k}")).orderBy("work_id").collect())
    assert got[0] == got[1] and len(got[0]) == 20


def work(spark, texts, kind="paragraph"):
    return blocks.block_offsets(blocks.block_ids(spark.createDataFrame([(1, i, kind, None, t) for i, t in enumerate(texts)], "work_id bigint, block_no int, kind string, url string, text string")))


def test_ids_stay_when_a_block_is_put_in(spark):
    a = {r["text"]: r["block_id"] for r in work(spark, ["one", "", "two", "two"]).collect()}
    b = work(spark, ["new", "one", "", "two", "two", ""]).collect()
    assert [r["block_id"] for r in b if r["text"] == "one"] == [a["one"]] and a[""] in [r["block_id"] for r in b]
    twos = [r["block_id"] for r in sorted(b, key=lambda r: r["block_no"]) if r["text"] == "two"]
    assert twos[1] == twos[0] + "-2"


def test_positions_follow_revisions(spark):
    old = work(spark, ["alpha beta gamma delta", "same", "same", "the last block of all 😀 here"])
    ids = [r["block_id"] for r in old.orderBy("block_no").collect()]
    want = spark.createDataFrame([(i, 1, ids[i], o) for i, o in enumerate([6, 2, 2, 25])], "position_id bigint, work_id bigint, block_id string, offset bigint")
    saved = anchors.make_positions(old, want)
    assert {r["position_id"]: r["before"] for r in saved.collect()}[3].endswith("😀 ")
    new = work(spark, ["put in", "alpha beta gamma delta!", "same", "same", "the last block of all 😀 here"])
    got = {r["position_id"]: (r["how"], r["block_id"], r["offset"]) for r in anchors.restore_positions(saved, new).collect()}
    now = [r["block_id"] for r in new.orderBy("block_no").collect()]
    assert got[0] == ("context", now[1], 6) and got[3] == ("exact", now[4], 25) and got[1][0] == "context"
    broken = saved.withColumn("before", F.lit("x" * 30))
    assert {r["how"] for r in anchors.restore_positions(broken, new).collect()} == {"percent"}
    assert anchors.restore_positions(saved, work(spark, [""])).count() == 0


def test_notation_faults(spark):
    texts = ["［＃太字］a［＃太字終わり］", "［＃太字］a［＃傍点終わり］", "［＃太字］［＃太字終わり］", "《r》", "漢《》", "［＃何か］", "［＃ open", "※［＃「x」、第3水準2-1-1］"]
    lines = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "work_id bigint, no int, line string")
    got = {r["work_id"]: r["code"] for r in runs.first_failure(notation.line_faults(lines)).collect()}
    assert got == {1: "unclosed-notation", 2: "unsupported-construct", 3: "ruby-base", 4: "ruby-base", 5: "unknown-notation", 6: "unclosed-notation", 7: "unknown-notation"}


def test_second_run_reuses_everything(spark):
    rec = spark.createDataFrame([(f"{i:06}", "xhtml", f"u{i}", "2020-01-01", f"h{i}", "r", "v1", "converted", None, "w", 1) for i in range(9)], runs.RECORD)
    got = runs.reuse_previous(rec, rec, rec.select("work_id"))
    assert [r["decision"] for r in got.collect()] == ["reuse"] * 9
    assert runs.pending_targets(rec, rec, rec.select("work_id")).count() == 0
    assert [r["decision"] for r in runs.reuse_previous(rec, rec, rec.select("work_id"), revalidate=True).collect()] == ["revalidate"] * 9


def test_commit_gate(spark):
    rec = lambda failed: spark.range(100).select(F.when(F.col("id") < failed, "failed").otherwise("converted").alias("status"))
    none = spark.range(0)
    outcome = lambda *a: runs.commit_gate(*a).first()["outcome"]
    assert [outcome(rec(2), none, none), outcome(rec(3), none, none), outcome(rec(0), spark.range(1), none), outcome(rec(0), none, spark.range(1)), outcome(rec(0).limit(0), none, none)] == ["ok", "too-many-failed", "integrity", "unfinished", "empty"]


def test_image_urls(spark):
    urls = [f"{HOST}/gaiji/1-85/1-85-54.png", f"{HOST}/cards/000879/files/a.gif", f"{HOST}/gaiji/../x.png", f"{HOST}/cards/000879/files/a.png?x", "http://other/gaiji/a.png", None]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(images.allowed_url(F.col("url")).alias("ok")).collect()
    assert [r["ok"] for r in got] == [True, True, False, False, False, False]


def lines_of(spark, *works):
    return spark.createDataFrame([(i, n, t) for i, w in enumerate(works) for n, t in enumerate(w)], "work_id bigint, no int, line string")


def test_characters_beyond_sixteen_bits(spark):
    tokens = notation.tokenize_lines(lines_of(spark, ["𠮷abc［＃「abc」に傍点］𠮷［＃謎］"]))
    notes = notation.notes_of(tokens)
    assert [(r["text"], r["code"]) for r in notation.emphasis_spans(notes).collect()] == [("abc", None)]
    assert [(r["col"], r["at"]) for r in tokens.where("kind = 'note'").orderBy("token_no").collect()] == [(5, 4), (18, 16)]
    between = notation.notes_of(notation.tokenize_lines(lines_of(spark, ["𠮷［＃太字］𠮷a［＃太字終わり］b"])))
    assert [r["text"] for r in notation.container_spans(between).collect()] == ["𠮷a"]


def test_faults_stand_where_they_are(spark):
    works = [["x［＃謎の注記］ tail 《よみ》"], ["𠮷 tail 《よみ》"], ["ok", "a［＃太字］b［＃傍点終わり］"], ["［＃ここから２字下げ］", "［＃３字下げ］x", "［＃ここで字下げ終わり］"], ["［＃２字下げ］［＃地付き］x"], ["［＃太字］a"]]
    got = {r["work_id"]: (r["line"], r["column"], r["code"]) for r in runs.first_failure(notation.line_faults(lines_of(spark, *works))).collect()}
    assert got == {0: (0, 1, "unknown-notation"), 1: (0, 8, "ruby-base"), 2: (1, 7, "unclosed-notation"), 3: (1, 0, "unsupported-construct"), 4: (0, 0, "unsupported-construct"), 5: (0, 0, "unclosed-notation")}


HEADING_LINES = [
    ("見出し［＃「見出し」は大見出し］", "large", "見出し", None), ("［＃中見出し］見出し［＃中見出し終わり］　", "medium", "見出し", None), ("［＃３字下げ］［＃小見出し］漢字《かんじ》［＃小見出し終わり］", "small", "漢字", None),
    ("x［＃大見出し］見出し［＃大見出し終わり］", "large", "見出し", "unsupported-construct"), ("［＃大見出し］見出し［＃大見出し終わり］x", "large", "見出し", "unsupported-construct"), ("［＃大見出し］見出し", "large", "", "unclosed-notation"),
    ("［＃大見出し］見出し［＃小見出し終わり］", "large", "", "unclosed-notation"), ("前の見出し［＃「見出し」は大見出し］", "large", "見出し", "unsupported-construct"), ("見出し［＃「見出し」は大見出し］後", "large", "見出し", "unsupported-construct"),
]


def test_headings_in_both_forms(spark):
    lines = lines_of(spark, *([x[0]] for x in HEADING_LINES))
    got = {r["work_id"]: (r["level"], r["text"], r["code"]) for r in notation.headings(notation.notes_of(notation.tokenize_lines(lines))).collect()}
    assert got == {i: x[1:] for i, x in enumerate(HEADING_LINES)}
    blocks_ = {r["work_id"]: (r["kind"], r["level"]) for r in notation.to_blocks(lines).where("work_id < 3").collect()}
    assert blocks_ == {0: ("heading", "large"), 1: ("heading", "medium"), 2: ("heading", "small")}


def test_captions(spark):
    figure, pair = "［＃図（a.png、横1×縦1）入る］", "［＃キャプション］説明［＃キャプション終わり］"
    got = notation.attach_captions(lines_of(spark, [figure, pair], ["text", pair], [figure, "［＃キャプション］説明"], [figure, pair + "x"], [figure, "［＃３字下げ］" + pair], [figure, "説明［＃「説明」はキャプション］"]))
    assert {r["work_id"]: (r["figure_no"], r["caption"], r["code"]) for r in got.collect()} == {
        0: (0, "説明", None), 1: (None, "説明", "unsupported-construct"), 2: (None, "", "unclosed-notation"), 3: (None, "説明", "unsupported-construct"), 4: (None, "", "unsupported-construct"), 5: (0, "説明", None),
    }


def test_markup_fails_closed(spark):
    from vellum.operators import markup

    page = "<html><body><article><p title=\"a > b\">x</p><a href='javascript:go()' onclick=go()>y</a><a HREF=\"java\tscript:x\">z</a><svg/onload=go()></svg><ruby class=\"r\"><RB>b</RB><rt> </rt></ruby></article><aside>?</aside><footer>f</footer></body></html>"
    pages = spark.createDataFrame([(1, page), (2, "<article>a</article><footer>b</footer>")], "page_id bigint, html string")
    nodes = markup.html_nodes(pages)
    assert sorted(r["name"] for r in markup.active_attributes(nodes).collect()) == ["href", "href", "onclick", "onload"]
    assert [(r["page_id"], r["code"]) for r in markup.section_faults(nodes).collect()] == [(1, "unknown-section")]
    assert [(r["base"], r["code"]) for r in markup.html_ruby(pages).collect()] == [("b", "ruby-base")]
    assert "a > b" in {r["value"] for r in markup.attributes(nodes).collect()}


def test_urls_beside_the_host(spark):
    urls = [f"{HOST}/gaiji/.png", f"{HOST}/cards/000001/files/b/a.gif", "https://libraryXexample/gaiji/a.png", f"{HOST}/gaiji/a%2e.png", f"{HOST}/gaiji/a.PNG", f"{HOST}/gaiji//a.png", f"{HOST}/gaiji/d/a.jpeg"]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(images.allowed_url(F.col("url")).alias("ok")).collect()
    assert [r["ok"] for r in got] == [False] * 6 + [True]
    body = lambda url: catalog.owned_body(F.lit(url), F.lit(f"{HOST}/cards/000879/card1.html"), F.lit("000001"), "html")
    row = spark.range(1).select(*(body(u).alias(str(i)) for i, u in enumerate([f"{HOST}/cards/000879/files/1_a.html", f"{HOST}/cards/000879/files/1_a b.html", "https://libraryXexample/cards/000879/files/1.html"]))).first()
    assert list(row) == [True, False, False]


def test_entry_size_is_that_of_the_json(spark):
    import base64
    import json

    row = (f"{HOST}/gaiji/a.png", "image/png", 10, 20000, b"x" * 101)
    entry = json.dumps([row[0], {"mime": row[1], "width": row[2], "height": row[3], "data": base64.b64encode(row[4]).decode()}], separators=(",", ":"))
    got = spark.createDataFrame([(*row[:4], len(row[4]))], "url string, mime string, width int, height int, byte_length bigint").select(images.entry_size().alias("n")).first()["n"]
    assert got == len(entry) + 1


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from vellum.sources import scratch

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None, set=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    assert scratch.fresh_folder(session("local[4]"))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.fresh_folder(session(master))
