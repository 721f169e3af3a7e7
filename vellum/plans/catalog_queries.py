"""Queries of the catalog jobs, each with SQL for the same rows."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from vellum.functions.text import is_calendar_date
from vellum.operators import catalog as c
from vellum.operators.search_index import search_index as index_of
from vellum.operators.search_index import write_search_index
from vellum.sources.adapters import CATALOG, catalog_rows, catalog_tasks, oracle, read, view
from vellum.sources.scratch import fresh_folder, kept

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _rows(spark, sf):
    return c.trim_rows(catalog_rows(spark, sf))


WHITE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_own = [x for x in c.WORK_COLUMNS if x != "work_id"]
_trim = ", ".join(f"regexp_replace(coalesce({x}, ''), '^[{WHITE}]+|[{WHITE}]+$', '', 'g') AS {x}" for x in c.COLUMNS)
_role = "CASE role WHEN '著者' THEN 'author' WHEN '翻訳者' THEN 'translator' WHEN '編者' THEN 'editor' WHEN '校訂者' THEN 'reviser' WHEN 'その他' THEN 'other' END"
_card = r"regexp_extract(card_url, '^https://library\.example/cards/([0-9]{6})/card([0-9]+)\.html$', 1)"
_date = lambda x: f"(regexp_full_match({x}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast({x} AS DATE) IS NOT NULL)"
_number = "regexp_replace(work_id, '^0+', '')"
_owned_card = rf"({_card} <> '' AND regexp_extract(card_url, '/card([0-9]+)\.html$', 1) = {_number})"
BASE = f"""WITH raw AS ({oracle(CATALOG, lineitem="lineitem", orders="orders")}),
t AS (SELECT row_no, {_trim} FROM raw),
works AS (SELECT work_id, min(row_no) AS first_row, count(*) AS n_rows, {", ".join(f"arg_min({x}, row_no) AS {x}" for x in _own)} FROM t GROUP BY work_id),
inc AS (SELECT * FROM (SELECT work_id, CASE {" ".join(f"WHEN min({x}) <> max({x}) THEN '{x}'" for x in _own)} END AS "column" FROM t GROUP BY work_id) WHERE "column" IS NOT NULL),
named AS (SELECT work_id, row_no, person_id, role, surname || given AS name, surname_reading || given_reading AS reading FROM t),
firsts AS (SELECT *, first_value(name) OVER w AS name1, first_value(reading) OVER w AS reading1, row_number() OVER w AS nth FROM named WINDOW w AS (PARTITION BY work_id, person_id, role ORDER BY row_no)),
faulty AS (SELECT *, CASE WHEN {_role} IS NULL THEN 'unknown-role' WHEN NOT regexp_full_match(person_id, '[0-9]{{6}}') OR name = '' THEN 'invalid-field' WHEN name <> name1 OR reading <> reading1 THEN 'inconsistent-rows' END AS fault FROM firsts),
pf AS (SELECT work_id, arg_min(fault, row_no) FILTER (fault IS NOT NULL) AS person_fault, list(person_id) AS ids FROM faulty GROUP BY work_id),
checked AS (SELECT w.*, CASE
  WHEN NOT regexp_full_match(w.work_id, '[0-9]{{6}}') THEN 'invalid-field/work_id' WHEN i."column" IS NOT NULL THEN 'inconsistent-rows/' || i."column"
  WHEN work_copyright NOT IN ('なし', 'あり') THEN 'unknown-copyright-flag/work_copyright' WHEN title = '' THEN 'invalid-field/title' WHEN orthography = '' THEN 'invalid-field/orthography'
  WHEN NOT {_owned_card.replace("work_id", "w.work_id")} THEN 'invalid-field/card_url' WHEN NOT {_date("published")} THEN 'invalid-field/published' WHEN NOT {_date("updated")} THEN 'invalid-field/updated'
  WHEN person_fault IS NOT NULL THEN person_fault || '/people' WHEN NOT list_contains(ids, {_card}) THEN 'invalid-field/card_person' END AS broken
  FROM works w LEFT JOIN inc i USING (work_id) JOIN pf USING (work_id)),
refs AS (SELECT work_id, path, url, updated, encoding, CASE
  WHEN NOT (regexp_extract(url, pat, 1) = {_card} AND {_card} <> '' AND regexp_extract(url, pat, 2) = {_number}) THEN 'external-body-url' WHEN NOT {_date("updated")} THEN 'invalid-body-date' WHEN encoding NOT IN ('ShiftJIS', 'UTF-8') THEN 'unsupported-encoding' END AS note
  FROM (SELECT work_id, card_url, 'xhtml' AS path, xhtml_url AS url, xhtml_updated AS updated, xhtml_encoding AS encoding, '^https://library\\.example/cards/([0-9]{{6}})/files/([0-9]+)(?:_[A-Za-z0-9_.-]+)?\\.html$' AS pat FROM checked WHERE broken IS NULL
    UNION ALL SELECT work_id, card_url, 'text', text_url, text_updated, text_encoding, '^https://library\\.example/cards/([0-9]{{6}})/files/([0-9]+)(?:_[A-Za-z0-9_.-]+)?\\.zip$' FROM checked WHERE broken IS NULL) WHERE url <> ''),
sel AS (SELECT work_id, CASE WHEN work_copyright <> 'なし' THEN 'copyright-active' WHEN s IS NULL THEN 'no-body' ELSE 'fetch' END AS outcome, CASE WHEN work_copyright = 'なし' THEN coalesce(s, '') ELSE '' END AS sources
  FROM checked LEFT JOIN (SELECT work_id, string_agg(path, ',' ORDER BY path DESC) AS s FROM refs WHERE note IS NULL GROUP BY work_id) USING (work_id) WHERE broken IS NULL),
people AS (SELECT work_id, row_number() OVER (PARTITION BY work_id ORDER BY row_no) AS position, person_id, {_role} AS role, name, reading FROM firsts WHERE nth = 1),
search AS (SELECT work_id, title, nullif(title_reading, '') AS title_reading, nullif(sort_reading, '') AS sort_reading, nullif(subtitle, '') AS subtitle, orthography, nullif(classification, '') AS classification, people, readings
  FROM checked JOIN sel USING (work_id) JOIN (SELECT work_id, string_agg(role || ':' || name, '|' ORDER BY position) AS people, string_agg(reading, '|' ORDER BY position) AS readings FROM people GROUP BY work_id) USING (work_id) WHERE outcome = 'fetch')
"""


def query(name: str, sql: str):
    """Registers a query with what follows BASE's names in SQL."""

    def put(f):
        QUERIES[name] = f
        ORACLE[name] = BASE + sql
        return f

    return put


def _checked(spark, sf):
    return c.validate_works(_rows(spark, sf), tasks=catalog_tasks(spark, sf))


def _valid(spark, sf):
    return _checked(spark, sf).where("code IS NULL")


def _search(spark, sf):
    return c.search_catalog_of(_rows(spark, sf), tasks=catalog_tasks(spark, sf))


@query("catalog_outcomes", "SELECT outcome, count(*) AS works FROM (SELECT outcome FROM sel UNION ALL SELECT split_part(broken, '/', 1) FROM checked WHERE broken IS NOT NULL) GROUP BY outcome")
def catalog_outcomes(spark, sf):
    checked = _checked(spark, sf)
    return c.select_bodies(checked).select(F.coalesce("code", "outcome").alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("works"))


@query("group_works", f"SELECT work_id, first_row, n_rows, {', '.join(_own)} FROM works")
def group_works(spark, sf):
    return c.group_works(_rows(spark, sf))


@query("inconsistent_columns", "SELECT * FROM inc")
def inconsistent_columns(spark, sf):
    return c.inconsistent_columns(_rows(spark, sf))


@query("dedupe_people", "SELECT * FROM people")
def dedupe_people(spark, sf):
    return c.dedupe_people(_rows(spark, sf))


@query("person_conflicts", "SELECT DISTINCT work_id, person_id, role FROM firsts WHERE name <> name1 OR reading <> reading1")
def person_conflicts(spark, sf):
    return c.person_conflicts(_rows(spark, sf))


@query("validate_works", "SELECT work_id, n_rows, nullif(split_part(broken, '/', 1), '') AS code, nullif(split_part(broken, '/', 2), '') AS detail FROM checked")
def validate_works(spark, sf):
    return _checked(spark, sf).select("work_id", "n_rows", "code", "detail")


@query("is_calendar_date", f"SELECT d, {_date('d')} AS ok FROM (SELECT DISTINCT CAST(1990 + (l_orderkey % 9) AS STRING) || '-' || lpad(CAST(l_orderkey % 14 AS STRING), CASE WHEN l_orderkey % 50 = 0 THEN 1 ELSE 2 END, '0') || '-' || lpad(CAST(l_partkey % 33 AS STRING), 2, '0') AS d FROM lineitem)")
def calendar_date(spark, sf):
    d = view(spark, "SELECT DISTINCT CAST(1990 + (l_orderkey % 9) AS STRING) || '-' || lpad(CAST(l_orderkey % 14 AS STRING), CASE WHEN l_orderkey % 50 = 0 THEN 1 ELSE 2 END, '0') || '-' || lpad(CAST(l_partkey % 33 AS STRING), 2, '0') AS d FROM {lineitem}", lineitem=read(spark, sf, "lineitem"))
    return d.select("d", is_calendar_date("d").alias("ok"))


@query("map_role", f"SELECT role AS label, {_role} AS role, count(*) AS n FROM t GROUP BY 1, 2")
def map_role(spark, sf):
    return _rows(spark, sf).select(F.col("role").alias("label"), c.map_role(F.col("role")).alias("role")).groupBy("label", "role").agg(F.count(F.lit(1)).alias("n"))


@query("owned_url", f"SELECT work_id, card_url, {_owned_card} AS owned FROM works")
def owned_url(spark, sf):
    return c.group_works(_rows(spark, sf)).select("work_id", "card_url", c.owned_card(F.col("card_url"), F.col("work_id")).alias("owned"))


@query("body_refs", "SELECT * FROM refs")
def body_refs(spark, sf):
    return c.body_refs(_valid(spark, sf))


@query("card_person_member", f"SELECT work_id, bool_or(person_id = {_card}) AS member FROM t GROUP BY work_id")
def card_person_member(spark, sf):
    return c.card_person_member(_rows(spark, sf))


@query("check_works", f"""SELECT DISTINCT work_id, problem FROM (
  SELECT w.work_id, unnest(list_filter([CASE WHEN NOT regexp_full_match(w.work_id, '[0-9]{{6}}') THEN 'id' END, CASE WHEN NOT {_owned_card.replace('work_id', 'w.work_id')} THEN 'card' END, CASE WHEN NOT list_contains(ids, {_card}) THEN 'card-person' END], lambda x: x IS NOT NULL)) AS problem FROM works w JOIN pf USING (work_id)
  UNION ALL SELECT work_id, 'ref' FROM refs WHERE note IS NOT NULL UNION ALL SELECT work_id, 'repeated' FROM works WHERE work_id LIKE '%77')""")
def check_works(spark, sf):
    rows = kept(_rows(spark, sf))
    works = c.group_works(rows)
    return c.check_works(works.unionAll(works.where("work_id LIKE '%77'")), rows.select("work_id", "person_id").distinct(), c.body_refs(c.validate_works(rows, tasks=catalog_tasks(spark, sf)).where("code IS NULL")))


@query("select_bodies", "SELECT * FROM sel")
def select_bodies(spark, sf):
    return c.select_bodies(_valid(spark, sf)).select("work_id", "outcome", "sources")


@query("build_search_catalog", "SELECT * FROM search")
def build_search_catalog(spark, sf):
    return _search(spark, sf)


@query("join_search_catalog", "SELECT * FROM search")
def join_search_catalog(spark, sf):
    """The same catalog from selected works and people that are tables of their own."""
    rows = kept(_rows(spark, sf))
    return c.build_search_catalog(c.select_bodies(c.validate_works(rows, tasks=catalog_tasks(spark, sf)).where("code IS NULL")), c.dedupe_people(rows.repartition("work_id")))


@query("search_catalog", """SELECT rank, work_id, title, people FROM (SELECT *, CASE WHEN title = 'Work 12' THEN 1 WHEN starts_with(title, 'Work 12') THEN 2 WHEN contains(title, 'Work 12') THEN 3 WHEN contains(subtitle, 'Work 12') THEN 4 WHEN contains(people, 'Work 12') THEN 5 WHEN contains(title_reading, 'Work 12') OR contains(readings, 'Work 12') THEN 6 END AS rank FROM search)
  WHERE rank IS NOT NULL AND orthography = '新字新仮名' ORDER BY rank, sort_reading, work_id LIMIT 50""")
def search_catalog(spark, sf):
    return c.search_catalog(_search(spark, sf), "Work 12", orthography="新字新仮名", k=50)


SEARCHES = {"Work 12": 12, "ork 49": 1000, "Part 3": 1000, "author:Sur7": 1000, "given8": 1000, "work 4321": 1000, "k": 100, "5": 1000, " 作 ": 50, "": 50, "1111": 1000}
_search_sql = " UNION ALL ".join(
    f"""(SELECT '{q}' AS query, rank, work_id, title, people FROM (SELECT *, CASE WHEN title = '{q.strip()}' THEN 1 WHEN starts_with(title, '{q.strip()}') THEN 2 WHEN contains(title, '{q.strip()}') THEN 3 WHEN contains(subtitle, '{q.strip()}') THEN 4 WHEN contains(people, '{q.strip()}') THEN 5 WHEN contains(title_reading, '{q.strip()}') OR contains(readings, '{q.strip()}') THEN 6 END AS rank FROM search)
  WHERE rank IS NOT NULL AND '{q.strip()}' <> '' ORDER BY rank, sort_reading, work_id LIMIT {k})""" for q, k in SEARCHES.items()
)


@query("search_index", _search_sql)
def search_index(spark, sf):
    """Searches of every rank in a stored index of the whole catalog."""
    path = fresh_folder(spark)
    write_search_index(_search(spark, sf), path)
    found = [index_of(spark, path, q, k=k).select(F.lit(q).alias("query"), "rank", "work_id", "title", "people") for q, k in SEARCHES.items()]
    return functools.reduce(lambda a, b: a.unionAll(b), found)


@query("catalog_shards", "SELECT work_id, title, ('0x' || substr(sha256(work_id), 1, 8))::BIGINT % 16 AS shard FROM search")
def catalog_shards(spark, sf):
    return c.catalog_shards(_search(spark, sf), 16).select("work_id", "title", "shard")


@query("beginner_candidates", """SELECT work_id, title, orthography, n_chars FROM search JOIN (SELECT lpad(CAST(doc_id AS STRING), 6, '0') AS work_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents) USING (work_id)
  WHERE n_chars <= 10000 AND work_id IN (SELECT work_id FROM t GROUP BY work_id HAVING bool_and(person_copyright = 'なし' AND coalesce(CASE WHEN TRY_CAST(person_id AS BIGINT) % 13 <> 0 THEN (DATE '1930-06-01' + CAST(TRY_CAST(person_id AS BIGINT) % 60 AS INT) * INTERVAL 1 YEAR + INTERVAL 840 MONTH) END < DATE '2026-01-01', false)))""")
def beginner_candidates(spark, sf):
    rows = _rows(spark, sf)
    number = F.expr("try_cast(person_id AS BIGINT)")
    people = rows.select("work_id", "person_copyright", F.when(number % 13 != 0, F.add_months(F.lit("1930-06-01").cast("date"), (number % 60 * 12).cast("int"))).alias("died"))
    bodies = read(spark, sf, "documents").select(F.lpad(F.col("doc_id").cast("string"), 6, "0").alias("work_id"), F.char_length("text").cast("long").alias("n_chars"))
    return c.beginner_candidates(_search(spark, sf), bodies, people, "2026-01-01")
