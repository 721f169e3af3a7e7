"""Cases that the queries once got wrong or could not bear, as the third review found them."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F
from test_jobs import base

from vellum.operators import anchors, blocks, catalog, documents, notation
from vellum.plans import catalogue
from vellum.sources import adapters, csv_ranges


def same_as_sql(spark, folder, name, **tables):
    """Whether a query gives its SQL's rows over small tables written to a folder."""
    duck = duckdb.connect()
    for table, rows in tables.items():
        rows.write.parquet(f"{folder}/{table}.parquet")
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = catalogue.QUERIES[name](spark, str(folder))
    cols = sorted(got.columns)
    rows = sorted(tuple(map(repr, r)) for r in got.select(*(f"`{c}`" for c in cols)).collect())
    want = duck.sql(catalogue.ORACLE[name]).select(*(f'"{c}"' for c in cols)).fetchall()
    return rows == sorted(tuple(map(repr, r)) for r in want), rows


@pytest.mark.parametrize("name", ["asset_files", "pack_assets", "asset_results"])
def test_sizes_of_long_pages_are_long(spark, tmp_path, name):
    """A page of 50,000 characters counted 50,000 times is beyond 32 bits."""
    pages = spark.createDataFrame([(i, f"https://example.org/{i}", "x" * 50_000 + f'<a href="/p{i}">') for i in range(8)], "page_id bigint, url string, html string")
    documents = spark.createDataFrame([(i, "a\nb") for i in range(8)], "doc_id bigint, text string")
    same, rows = same_as_sql(spark, tmp_path, name, pages=pages, documents=documents)
    assert same and rows


def test_columns_are_compared_without_a_sort_of_texts(spark):
    """Minima of texts sort all rows of a task; digests are aggregated in place."""
    rows = spark.createDataFrame([("1", "a", "x"), ("1", "a", "y"), ("2", "b", "z")], "work_id string, title string, subtitle string")
    rows = rows.select("work_id", *(F.col(c) if c in ("title", "subtitle") else F.lit("").alias(c) for c in catalog.WORK_COLUMNS if c != "work_id"))
    found = catalog.inconsistent_columns(rows)
    assert [tuple(r) for r in found.collect()] == [("1", "subtitle")]
    assert "SortAggregate" not in found._jdf.queryExecution().toString()


def test_wide_rows_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """The catalog's rows come from narrow ones, whose bytes tell too few tasks."""
    spark.range(400).select(F.col("id").alias("l_orderkey"), *(F.lit(1).alias(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(400).select(F.col("id").alias("o_orderkey"), F.lit("1").alias("o_orderpriority"), F.lit("2020-01-01").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(adapters, "ROWS_A_TASK", 10)
    rows = catalog.validate_works(catalog.trim_rows(adapters.catalog_rows(spark, str(tmp_path))), tasks=adapters.catalog_tasks(spark, str(tmp_path)))
    assert rows.rdd.getNumPartitions() == 40 and rows.count() == 400


def test_the_search_catalog_sorts_no_wide_rows(spark):
    """Ranges of the catalog's own rows make them twice; only the light works are sorted."""
    rows = catalog.trim_rows(spark.createDataFrame([base(f"{i:06d}") for i in range(1, 30)], "row_no bigint, " + ", ".join(f"{c} string" for c in catalog.COLUMNS)))
    found = catalog.search_catalog_of(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Scan parquet" in plan and [r["work_id"] for r in found.collect()] == [f"{i:06d}" for i in range(1, 30)]


def test_ids_beyond_six_digits_are_not_repeated(spark, tmp_path):
    documents = spark.createDataFrame([(1_000_000 + i, "a", "s") for i in range(40)], "doc_id bigint, text string, source string")
    same, rows = same_as_sql(spark, tmp_path, "read_manifest", documents=documents)
    assert same and rows


def _works(spark):
    texts = ["alpha beta gamma", "", "the same words", "the same words", "𠮷 short", "the same words", ""]
    rows = [(w, i, "paragraph", None, t if i % 2 else f"{t} of {w}") for w in range(3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "work_id bigint, block_no int, kind string, url string, text string")


def _saved(spark, placed):
    want = placed.where("block_no <> 4").select((F.col("work_id") * 10 + F.col("block_no")).cast("long").alias("position_id"), "work_id", "block_id", F.least("size", F.lit(9)).cast("long").alias("offset"))
    return anchors.make_positions(placed, want)


def test_few_contexts_need_no_runs(spark, monkeypatch):
    """A row for each run of each text was about thirty times the texts; where a work has few contexts there is none."""
    placed = blocks.block_offsets(blocks.block_ids(_works(spark)))
    saved = _saved(spark, placed)
    many = sorted(map(tuple, anchors.restore_context(saved, placed, few=0).collect()))
    monkeypatch.setattr(anchors, "_grams", None)
    assert sorted(map(tuple, anchors.restore_context(saved, placed).collect())) == many and many


def test_places_move_no_texts(spark):
    """IDs and offsets are scans over digests and sizes."""
    made = _works(spark)
    places = blocks.block_places(made)
    plan = places._jdf.queryExecution().optimizedPlan().toString()
    want = blocks.block_offsets(blocks.block_ids(made))
    assert "text#" not in plan and sorted(map(tuple, places.collect())) == sorted(map(tuple, want.select(*places.columns).collect()))
    assert sorted(map(tuple, blocks.with_texts(places, made).collect())) == sorted(map(tuple, want.select("work_id", "block_no", "kind", "text", "block_id", "size", "at", "total").collect()))


@pytest.mark.parametrize("foreign", [False, True])
def test_twins_are_found_by_their_ids(spark, foreign):
    """Texts were dealt by themselves for all blocks; IDs of another make still need it."""
    placed = blocks.block_offsets(blocks.block_ids(_works(spark)))
    if foreign:
        placed = placed.withColumn("block_id", F.concat(F.lit("x"), "block_no"))
    found = anchors.restore_exact(_saved(spark, placed), placed)
    got = {r["position_id"]: (r["how"], r["block_id"]) for r in found.collect()}
    ids = {r["work_id"] * 10 + r["block_no"]: r["block_id"] for r in placed.collect()}
    assert set(got) == {k for k in ids if k % 10 != 4}
    # the texts of 3 and 5 are equal, as are those of 1 for all works; 2 has its work's number
    assert got == {k: ("context" if k % 10 in (3, 5) else "exact", ids[k]) for k in got}
    assert bool(re.search(r"text#\d+ = text#\d+", found._jdf.queryExecution().optimizedPlan().toString())) == foreign


def test_positions_of_repeated_names(spark):
    """Two saved rows of one name and offset are told together, as SQL does."""
    placed = blocks.block_offsets(blocks.block_ids(_works(spark)))
    saved = _saved(spark, placed).where("work_id = 0")
    twice = saved.where("position_id IN (0, 2)").withColumn("position_id", F.lit(7).cast("long"))
    assert [(r["position_id"], r["how"]) for r in anchors.restore_exact(twice, placed).collect()] == [(7, "context")]


def test_restored_positions_are_sqls(spark, tmp_path):
    documents = spark.createDataFrame([(i, "\n".join(f"line {j % 5} of {i % 7} and so on" if j % 6 else "" for j in range(i % 40))) for i in range(80)] + [(90, None)], "doc_id bigint, text string")
    same, rows = same_as_sql(spark, tmp_path, "restore_positions", documents=documents)
    assert same and rows


def test_a_glyph_is_read_once(spark):
    """A filter on the code of a glyph repeated its patterns for every rule that asks for them, beyond what is compiled."""
    lines = spark.createDataFrame([(1, 0, "※［＃「x」、第3水準1-85-54］ ※［＃「y」、U+5433、12-3］ ※［＃「z」、U+110000］ ※［＃「q」、12-3］")], "work_id bigint, no int, line string")
    found = notation.gaiji_refs(notation.tokenize_lines(lines))
    assert [(r["url"] is not None, r["character"], r["code"]) for r in sorted(found.collect(), key=lambda r: r["token_no"])] == [(True, None, None), (False, "吳", None), (False, None, "unknown-notation"), (False, None, None)]
    plan = found.where("code IS NOT NULL").select("code")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 8


def test_notes_are_told_once(spark):
    """Every job on notes tried all their forms again on every note, in its filter and its columns."""
    lines = spark.createDataFrame([(1, 0, "［＃太字］a［＃謎］"), (1, 1, "［＃ここから２字下げ］")], "work_id bigint, no int, line string")
    found = notation.line_faults(lines)
    assert {(r["line"], r["code"]) for r in found.collect()} == {(0, "unclosed-notation"), (0, "unknown-notation"), (1, "unclosed-notation")}
    assert notation.NOTES["center"] not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_documents_nodes_come_from_two_generators(spark):
    """Every node went through a generator for each level, whether or not it holds any."""
    deep = '{"kind":"text","text":"x"}'
    for _ in range(9):
        deep = '{"kind":"strong","children":[' + deep + "]}"
    texts = spark.createDataFrame([(1, '{"blocks":[{"kind":"paragraph","inline":[{"kind":"ruby","base":[' + deep + ']}]},{"kind":"figure","caption":[{"kind":"text","text":"y"}]}]}')], "work_id bigint, json string")
    found = documents._flattened(texts.select("work_id", F.try_parse_json("json").alias("v")))
    rows = sorted((r["depth"], r["path"], r["ruby"]) for r in found.select("depth", "path", "ruby").collect())
    ruby = "$.blocks[0].inline[0]"
    want = [(-1, "$", None), (0, "$.blocks[0]", None), (0, "$.blocks[1]", None), (1, ruby, None), (1, "$.blocks[1].caption[0]", None)]
    assert rows == sorted(want + [(2 + i, f"{ruby}.base[0]" + ".children[0]" * i, ruby) for i in range(8)], key=lambda r: r[:2])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 2


def test_sound_ranges_write_no_records(spark, tmp_path):
    """All records were written to a table before any was read, though only those over a range's end need it."""
    (tmp_path / "a.csv").write_text('a,b\n"1\n2",3\n4,5\n')
    found = csv_ranges.csv_records(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and "Union" not in plan and found.count() == 3
    state = lambda *inside: {("f", i): (x, 0, 0) for i, x in enumerate(inside)}
    assert csv_ranges._broken(state(False, True, True, False, False)) == [("f", 0), ("f", 1), ("f", 2)] and not csv_ranges._broken(state(False, False))
