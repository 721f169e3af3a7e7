"""From catalog rows, one per work, person and role, to validated works, selected bodies and the search catalog.

Every job takes rows with the columns of COLUMNS and row_no, which gives the rows' order inside a work. Jobs that
group partition by work_id only, so that Spark can share the exchange.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions.text import is_calendar_date, trimmed
from vellum.sources.scratch import kept

WORK_COLUMNS = [
    "work_id", "title", "title_reading", "sort_reading", "subtitle", "subtitle_reading", "original_title", "first_publication", "classification", "orthography", "work_copyright",
    "published", "updated", "card_url", "text_url", "text_updated", "text_encoding", "xhtml_url", "xhtml_updated", "xhtml_encoding",
]
PERSON_COLUMNS = ["person_id", "surname", "given", "surname_reading", "given_reading", "role", "person_copyright"]
COLUMNS = WORK_COLUMNS + PERSON_COLUMNS
#: Role labels and copyright flags of the catalog.
ROLES = {"著者": "author", "翻訳者": "translator", "編者": "editor", "校訂者": "reviser", "その他": "other"}
FREE, PROTECTED = "なし", "あり"
HOST = "https://library.example"
PATHS = {"xhtml": "html", "text": "zip"}


def trim_rows(rows: DataFrame) -> DataFrame:
    """All text columns trimmed, nulls as empty strings."""
    return rows.select("row_no", *(trimmed(c).alias(c) for c in COLUMNS))


def map_role(label: Column) -> Column:
    """The role of a label; null for an unknown label."""
    return F.coalesce(*(F.when(label == k, v) for k, v in ROLES.items()))


def number_of(work_id: Column) -> Column:
    return F.regexp_replace(work_id, "^0+", "")


def card_person(card_url: Column, host: str = HOST) -> Column:
    """The person directory of a card URL; empty if it isn't one."""
    return F.regexp_extract(card_url, f"^{re.escape(host)}/cards/([0-9]{{6}})/card([0-9]+)\\.html$", 1)


def owned_card(card_url: Column, work_id: Column, host: str = HOST) -> Column:
    """The host's card whose number is the work's."""
    return (card_person(card_url, host) != "") & (F.regexp_extract(card_url, "/card([0-9]+)\\.html$", 1) == number_of(work_id))


def owned_body(url: Column, card_url: Column, work_id: Column, extension: str, host: str = HOST) -> Column:
    """A body in the card's person directory with the work's number, a suffix of file name signs, and the path's extension."""
    pattern = f"^{re.escape(host)}/cards/([0-9]{{6}})/files/([0-9]+)(?:_[A-Za-z0-9_.-]+)?\\.{extension}$"
    return (F.regexp_extract(url, pattern, 1) == card_person(card_url, host)) & (card_person(card_url, host) != "") & (F.regexp_extract(url, pattern, 2) == number_of(work_id))


def group_works(rows: DataFrame) -> DataFrame:
    """One row per work_id with the columns of its first row, first_row and the number of rows."""
    own = [c for c in WORK_COLUMNS if c != "work_id"]
    return rows.groupBy("work_id").agg(F.min("row_no").alias("first_row"), F.count(F.lit(1)).alias("n_rows"), *(F.min_by(c, "row_no").alias(c) for c in own))


def _differ(c: str) -> Column:
    """Whether a column differs between a group's rows, by digests: numbers are aggregated in place, texts would be sorted."""
    return F.min(F.xxhash64(c)) != F.max(F.xxhash64(c))


def inconsistent_columns(rows: DataFrame) -> DataFrame:
    """(work_id, column): works whose own columns differ between rows, with the first such column in column order."""
    own = [c for c in WORK_COLUMNS if c != "work_id"]
    first = F.coalesce(*(F.when(_differ(c), F.lit(c)) for c in own))
    return rows.groupBy("work_id").agg(first.alias("column")).where("column IS NOT NULL")


def _named(rows: DataFrame) -> DataFrame:
    return rows.select("work_id", "row_no", "person_id", "role", F.concat("surname", "given").alias("name"), F.concat("surname_reading", "given_reading").alias("reading"))


def dedupe_people(rows: DataFrame) -> DataFrame:
    """(work_id, position, person_id, role, name, reading): each person and role once, in order of first appearance."""
    one = Window.partitionBy("work_id", "person_id", "role").orderBy("row_no")
    first = _named(rows).withColumn("n", F.row_number().over(one)).where("n = 1")
    order = Window.partitionBy("work_id").orderBy("row_no")
    return first.select("work_id", F.row_number().over(order).alias("position"), "person_id", map_role(F.col("role")).alias("role"), "name", "reading")


def person_conflicts(rows: DataFrame) -> DataFrame:
    """(work_id, person_id, role): pairs with another name or reading than on their first row."""
    one = Window.partitionBy("work_id", "person_id", "role").orderBy("row_no")
    named = _named(rows).withColumn("name_first", F.first("name").over(one)).withColumn("reading_first", F.first("reading").over(one))
    return named.where("name <> name_first OR reading <> reading_first").select("work_id", "person_id", "role").distinct()


def _with_person_fault(rows: DataFrame) -> DataFrame:
    """rows with the fault of their person, if any."""
    one = Window.partitionBy("work_id", "person_id", "role").orderBy("row_no")
    named = rows.withColumn("name", F.concat("surname", "given")).withColumn("reading", F.concat("surname_reading", "given_reading"))
    named = named.withColumn("other", (F.col("name") != F.first("name").over(one)) | (F.col("reading") != F.first("reading").over(one)))
    fault = F.coalesce(
        F.when(map_role(F.col("role")).isNull(), F.lit("unknown-role")),
        F.when(~F.col("person_id").rlike("^[0-9]{6}$") | (F.col("name") == ""), F.lit("invalid-field")),
        F.when(F.col("other"), F.lit("inconsistent-rows")),
    )
    return named.withColumn("fault", fault).withColumn("nth", F.row_number().over(one))


def validate_works(rows: DataFrame, host: str = HOST, tasks: int | None = None) -> DataFrame:
    """One row per work with the code and detail of the first rule it breaks; both null for a valid work.

    The order of the rules: ID, agreement of rows, copyright flag, title, orthography, card, dates, people in row
    order, and the card's person among them. tasks: how many tasks works are dealt to; without it Spark says.
    """
    return _checked(rows.repartition(*([tasks] if tasks else []), "work_id"), host).drop("p")  # the window and the aggregation share this exchange, and its sort


def _checked(rows: DataFrame, host: str) -> DataFrame:
    """validate_works' rows, and p, each person and role of the work once; rows are dealt by work_id."""
    own = [c for c in WORK_COLUMNS if c != "work_id"]
    rows = _with_person_fault(rows)
    person = F.struct("row_no", map_role(F.col("role")).alias("role"), "name", "reading")
    works = rows.groupBy("work_id").agg(
        F.min("row_no").alias("first_row"),
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(*(F.when(_differ(c), F.lit(c)) for c in own)).alias("column"),
        F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("row_no"))).alias("person_fault"),
        F.bool_or(F.col("person_id") == card_person(F.col("card_url"), host)).alias("member"),
        F.min_by(F.struct(*own), "row_no").alias("w"),
        F.array_sort(F.collect_list(F.when(F.col("nth") == 1, person))).alias("p"),
    ).select("*", "w.*")
    rule = lambda broken, code, detail: F.when(broken, F.struct(F.lit(code).alias("code"), detail.alias("detail")))
    first = F.coalesce(
        rule(~F.col("work_id").rlike("^[0-9]{6}$"), "invalid-field", F.lit("work_id")),
        rule(F.col("column").isNotNull(), "inconsistent-rows", F.col("column")),
        rule(~F.col("work_copyright").isin(FREE, PROTECTED), "unknown-copyright-flag", F.lit("work_copyright")),
        rule(F.col("title") == "", "invalid-field", F.lit("title")),
        rule(F.col("orthography") == "", "invalid-field", F.lit("orthography")),
        rule(~owned_card(F.col("card_url"), F.col("work_id"), host), "invalid-field", F.lit("card_url")),
        rule(~is_calendar_date("published"), "invalid-field", F.lit("published")),
        rule(~is_calendar_date("updated"), "invalid-field", F.lit("updated")),
        F.when(F.col("person_fault").isNotNull(), F.struct(F.col("person_fault").alias("code"), F.lit("people").alias("detail"))),
        rule(~F.col("member"), "invalid-field", F.lit("card_person")),
    )
    return works.select(*WORK_COLUMNS, "first_row", "n_rows", first["code"].alias("code"), first["detail"].alias("detail"), "p")


def card_person_member(rows: DataFrame, host: str = HOST) -> DataFrame:
    """(work_id, member): whether the card's person directory is one of the work's people."""
    return rows.groupBy("work_id").agg(F.bool_or(F.col("person_id") == card_person(F.col("card_url"), host)).alias("member"))


def body_refs(works: DataFrame, host: str = HOST) -> DataFrame:
    """(work_id, path, url, updated, encoding, note): one row per body URL of a work; note says why it can't be used."""
    each = F.array(*(F.struct(F.lit(p).alias("path"), F.col(f"{p}_url").alias("url"), F.col(f"{p}_updated").alias("updated"), F.col(f"{p}_encoding").alias("encoding"), _note(p, e, host).alias("note")) for p, e in PATHS.items()))
    return works.select("work_id", F.inline(each)).where("url <> ''")


def _note(path: str, extension: str, host: str) -> Column:
    """Why a path's body can't be used; null if it can."""
    owned = owned_body(F.col(f"{path}_url"), F.col("card_url"), F.col("work_id"), extension, host)
    return F.coalesce(F.when(~owned, F.lit("external-body-url")), F.when(~is_calendar_date(f"{path}_updated"), F.lit("invalid-body-date")), F.when(~F.col(f"{path}_encoding").isin("ShiftJIS", "UTF-8"), F.lit("unsupported-encoding")))


def select_bodies(valid: DataFrame, host: str = HOST) -> DataFrame:
    """valid with outcome and sources: free works with a usable body are fetched, the page first; others say why not."""
    usable = F.array_compact(F.array(*(F.when((F.col(f"{p}_url") != "") & _note(p, e, host).isNull(), F.lit(p)) for p, e in PATHS.items())))
    outcome = F.when(F.col("work_copyright") != FREE, "copyright-active").when(F.size(usable) == 0, "no-body").otherwise("fetch")
    return valid.withColumn("outcome", outcome).withColumn("sources", F.when(F.col("outcome") == "fetch", F.array_join(usable, ",")).otherwise(""))


def check_works(works: DataFrame, people: DataFrame, refs: DataFrame, host: str = HOST) -> DataFrame:
    """(work_id, problem): what is wrong in a table of works made by hand, repeated IDs included."""
    members = people.groupBy("work_id").agg(F.collect_set("person_id").alias("ids"))
    each = works.join(members, "work_id", "left")
    faults = each.select("work_id", F.explode(F.array_compact(F.array(
        F.when(~F.col("work_id").rlike("^[0-9]{6}$"), "id"),
        F.when(~owned_card(F.col("card_url"), F.col("work_id"), host), "card"),
        F.when(~F.coalesce(F.array_contains("ids", card_person(F.col("card_url"), host)), F.lit(False)), "card-person"),
    ))).alias("problem"))
    repeated = works.groupBy("work_id").count().where("count > 1").select("work_id", F.lit("repeated").alias("problem"))
    return faults.unionByName(repeated).unionByName(refs.where("note IS NOT NULL").select("work_id", F.lit("ref").alias("problem")).distinct()).distinct()


def _light(shipped: DataFrame) -> DataFrame:
    """The search catalog's columns from works with p, their people in order."""
    names = F.array_join(F.transform("p", lambda p: F.concat(p["role"], F.lit(":"), p["name"])), "|").alias("people")
    light = ["title", "title_reading", "sort_reading", "subtitle", "orthography", "classification"]
    return shipped.select("work_id", *(F.nullif(F.col(c), F.lit("")).alias(c) for c in light), names, F.array_join(F.transform("p", lambda p: p["reading"]), "|").alias("readings"))


def build_search_catalog(selected: DataFrame, people: DataFrame) -> DataFrame:
    """Shippable works in ID order: light columns, people as role:name, no person IDs; optional columns null if empty."""
    listed = people.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("position", "role", "name", "reading"))).alias("p"))
    return _light(selected.where("outcome = 'fetch'").join(listed, "work_id")).orderBy("work_id")


def search_catalog_of(rows: DataFrame, host: str = HOST, tasks: int | None = None) -> DataFrame:
    """build_search_catalog from the catalog's rows at once: one exchange by work_id serves validation and people, and only
    the light works, which are kept, are sorted. tasks: how many tasks works are dealt to; without it Spark says."""
    valid = _checked(rows.repartition(*([tasks] if tasks else []), "work_id"), host).where("code IS NULL")
    return kept(_light(select_bodies(valid, host).where("outcome = 'fetch'"))).orderBy("work_id")


def search_catalog(catalog: DataFrame, query: str, *, author: str | None = None, orthography: str | None = None, classification: str | None = None, sort: str = "relevance", k: int = 50) -> DataFrame:
    """The k best works for a query: exact title, title prefix, inside title, inside subtitle, author, then readings.

    Ties go by sort reading, then ID. An empty query finds nothing.
    """
    q = F.lit(query.strip())
    inside = lambda c: F.coalesce(F.contains(F.col(c), q), F.lit(False))
    rank = F.when(F.col("title") == q, 1).when(F.startswith("title", q), 2).when(inside("title"), 3).when(inside("subtitle"), 4).when(inside("people"), 5).when(inside("title_reading") | inside("readings"), 6)
    found = catalog.withColumn("rank", rank).where(F.col("rank").isNotNull() & F.lit(bool(query.strip())))
    if author is not None:
        found = found.where(F.exists(F.split("people", r"\|"), lambda p: p == f"author:{author}"))
    for c, v in (("orthography", orthography), ("classification", classification)):
        if v is not None:
            found = found.where(F.col(c) == v)
    first = {"relevance": ["rank"], "title": ["sort_reading"], "author": ["people"]}[sort]
    return found.orderBy(*first, "sort_reading", "work_id").limit(k).select("rank", "work_id", "title", "people")


def catalog_shards(catalog: DataFrame, shards: int) -> DataFrame:
    """The catalog with its shard: the first 32 bits of SHA-256 of the ID, modulo the shards; sorted inside a shard."""
    shard = F.conv(F.substring(F.sha2("work_id", 256), 1, 8), 16, 10).cast("long") % shards
    return catalog.withColumn("shard", shard).repartition(F.col("shard")).sortWithinPartitions("shard", "work_id")


def beginner_candidates(catalog: DataFrame, bodies: DataFrame, people: DataFrame, today: str, most: int = 10_000) -> DataFrame:
    """Works for first readers: every person free and dead for over 70 years, modern orthography first, and a short body.

    bodies: (work_id, n_chars); people: (work_id, died, person_copyright). The catalog's works have a free flag of their
    own; a work with an unknown date of death or a person who isn't free is none."""
    free = F.coalesce((F.add_months("died", 70 * 12) < F.lit(today).cast("date")) & (F.col("person_copyright") == FREE), F.lit(False))
    out = people.groupBy("work_id").agg(F.bool_and(free).alias("free"))
    short = catalog.join(bodies.where(F.col("n_chars") <= most), "work_id").join(out.where("free"), "work_id")
    return short.select("work_id", "title", "orthography", "n_chars").orderBy(F.when(F.col("orthography") == "新字新仮名", 0).otherwise(1), "n_chars", "work_id")
