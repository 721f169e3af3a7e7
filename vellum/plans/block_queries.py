"""Queries of the block and position jobs, each with SQL for the same rows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions.text import utf16_length
from vellum.operators import anchors as a
from vellum.operators import blocks as b
from vellum.operators import documents
from vellum.sources.adapters import BLOCKS, REVISED, oracle, read, view
from vellum.sources.scratch import kept

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
UNSEEN = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\x{00}-\x{1F}\x{7F}-\x{9F}\x{AD}\x{34F}\x{600}-\x{605}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{FFF0}-\x{FFFB}\x{E0000}-\x{E0FFF}"
LINES = r"lines AS (SELECT doc_id, CAST(i - 1 AS INT) AS no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '^\x{FEFF}', ''), '\r\n|\r|\n') AS ls FROM documents)))"


def _ids(name: str, source: str) -> str:
    """CTEs that give IDs and offsets to the blocks of a CTE."""
    return f"""{name}_v AS (SELECT work_id, block_no, kind, url, CASE WHEN kind = 'figure' THEN chr(65532) ELSE '' END || coalesce(text, '') AS text FROM {source} WHERE kind NOT IN ('pageBreak', 'pageCenter')),
{name}_o AS (SELECT *, CASE WHEN text <> '' THEN substr(sha256(CASE WHEN kind = 'figure' THEN 'figure' || chr(0) || url || chr(0) || text ELSE kind || chr(0) || text END), 1, 12) END AS own FROM {name}_v),
{name}_r AS (SELECT *, count(own) OVER (PARTITION BY work_id ORDER BY block_no) AS run FROM {name}_o),
{name}_k AS (SELECT *, list(CASE WHEN own IS NULL THEN kind END) OVER w AS kinds, coalesce(first_value(own IGNORE NULLS) OVER w, '') AS before FROM {name}_r WINDOW w AS (PARTITION BY work_id, run ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{name}_h AS (SELECT work_id, block_no, kind, text, coalesce(own, list_reduce(list_prepend(before, list_filter(kinds, lambda x: x IS NOT NULL)), lambda x, k: substr(sha256(k || chr(0) || chr(0) || x), 1, 12))) AS h FROM {name}_k),
{name}_i AS (SELECT work_id, block_no, kind, text, 'p-' || h || CASE WHEN n > 1 THEN '-' || CAST(n AS STRING) ELSE '' END AS block_id FROM (SELECT *, row_number() OVER (PARTITION BY work_id, h ORDER BY block_no) AS n FROM {name}_h)),
{name} AS (SELECT *, CAST(length(text) AS BIGINT) AS size, CAST(coalesce(sum(length(text)) OVER (PARTITION BY work_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at, CAST(sum(length(text)) OVER (PARTITION BY work_id) AS BIGINT) AS total FROM {name}_i)"""


BASE = f"WITH {LINES}, blk AS ({oracle(BLOCKS, lines='lines')}), {_ids('cur', 'blk')}"
SAVED = f"""{BASE}, rblk AS ({oracle(REVISED, blocks='blk')}), {_ids('rev', 'rblk')},
nth AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY block_no) - 1 AS i, count(*) OVER (PARTITION BY work_id) AS n FROM cur),
want AS (SELECT work_id AS position_id, work_id, block_id, work_id * 17 % (size + 1) AS "offset" FROM nth WHERE i = work_id * 31 % n),
pos AS (SELECT position_id, w.work_id, block_id, "offset", substr(text, CAST(greatest("offset" - 24, 0) + 1 AS INT), CAST("offset" - greatest("offset" - 24, 0) AS INT)) AS before, substr(text, CAST("offset" + 1 AS INT), 24) AS after, CASE WHEN total = 0 THEN 0.0 ELSE (at + "offset") / total END AS percent FROM want w JOIN cur USING (work_id, block_id)),
sav AS (SELECT position_id, work_id, CASE WHEN position_id % 10 = 3 THEN NULL ELSE block_id END AS block_id, "offset", CASE WHEN position_id % 10 = 4 THEN 'zz' || before ELSE before END AS before, after, percent FROM pos),
sound AS (SELECT * FROM sav WHERE block_id IS NOT NULL AND "offset" >= length(before) AND length(before) <= 24 AND length(after) <= 24),
same AS (SELECT s.*, text, total, regexp_extract(block_id, '^(p-[0-9a-f]+)', 1) AS family FROM sound s JOIN rev USING (work_id, block_id) WHERE "offset" <= size AND substr(text, CAST("offset" - length(before) + 1 AS INT), length(before)) = before AND substr(text, CAST("offset" + 1 AS INT), length(after)) = after),
exact AS (SELECT position_id, CASE WHEN count(*) = 1 THEN 'exact' ELSE 'context' END AS how, arg_min(r.block_id, {{'far': abs((r.at + "offset") / s.total - percent), 'no': r.block_no}}) AS block_id, "offset" FROM same s JOIN rev r ON s.work_id = r.work_id AND s.text = r.text AND s.family = regexp_extract(r.block_id, '^(p-[0-9a-f]+)', 1) GROUP BY position_id, "offset"),
hits AS (SELECT position_id, r.block_id, instr(text, before || after) AS p, before, after, text FROM sound s JOIN rev r USING (work_id) WHERE length(before || after) >= 6 AND contains(text, before || after)),
ctx AS (SELECT position_id, 'context' AS how, min(block_id) AS block_id, min(p - 1 + length(before)) AS "offset" FROM hits GROUP BY position_id HAVING sum(CASE WHEN contains(substr(text, CAST(p + 1 AS INT)), before || after) THEN 2 ELSE 1 END) = 1),
tgt AS (SELECT position_id, work_id, total, last, least(total, greatest(0, CAST(floor(percent * total + 0.5) AS BIGINT))) AS target FROM sav JOIN (SELECT work_id, max(block_no) AS last, max(total) AS total FROM rev GROUP BY work_id) USING (work_id) WHERE total > 0),
pct AS (SELECT position_id, 'percent' AS how, block_id, target - at AS "offset" FROM tgt t JOIN rev r ON t.work_id = r.work_id AND ((target >= at AND target < at + size) OR (target = t.total AND block_no = last)))
"""


def query(name: str, sql: str, base: str = BASE):
    def put(f):
        QUERIES[name] = f
        ORACLE[name] = re.sub(r"\bat\b", '"at"', base + " " + sql)  # a reserved word there
        return f

    return put


def lines_of(spark, sf):
    return b.split_lines(read(spark, sf, "documents"))


def blocks_of(spark, sf):
    return view(spark, BLOCKS, lines=lines_of(spark, sf))


class _Works:
    """The blocks before and after the revision, whose places are read more than once and lie in tables without texts."""

    def __init__(self, spark, sf):
        self.spark, self.blocks = spark, kept(blocks_of(spark, sf))

    @property
    def positions(self):
        cur = kept(b.block_places(self.blocks))
        w = Window.partitionBy("work_id")
        nth = cur.withColumn("i", F.row_number().over(w.orderBy("block_no")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
        want = nth.where("i = work_id * 31 % n").select(F.col("work_id").alias("position_id"), "work_id", "block_id", F.expr("work_id * 17 % (size + 1)").alias("offset"))
        return a.make_positions(b.with_texts(cur, self.blocks), want)

    @property
    def saved(self):
        p = self.positions
        return p.withColumn("block_id", F.expr("CASE WHEN position_id % 10 = 3 THEN NULL ELSE block_id END")).withColumn("before", F.expr("CASE WHEN position_id % 10 = 4 THEN 'zz' || before ELSE before END"))

    @property
    def revision(self):
        return view(self.spark, REVISED, blocks=self.blocks)

    @property
    def revised(self):
        return b.with_texts(kept(b.block_places(self.revision)), self.revision)


@query("split_lines", "SELECT doc_id, no, line FROM lines")
def split_lines(spark, sf):
    return lines_of(spark, sf)


@query("is_blank", f"SELECT doc_id, no, regexp_replace(line, '[{UNSEEN}]', '', 'g') <> '' AS visible FROM lines")
def is_blank(spark, sf):
    return b.visible_lines(lines_of(spark, sf)).select("doc_id", "no", "visible")


@query("excerpt_lines", f"SELECT doc_id, n, count(CASE WHEN NOT regexp_full_match(line, '-{{3,}}|\\*{{3,}}') THEN 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS paragraph, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS n FROM lines WHERE regexp_replace(line, '[{UNSEEN}]', '', 'g') <> '') WHERE n >= 2 AND n < 7")
def excerpt_lines(spark, sf):
    return b.excerpt_lines(lines_of(spark, sf), 2, 5)


@query("block_ids", "SELECT work_id, block_no, kind, block_id FROM cur")
def block_ids(spark, sf):
    return b.block_ids(blocks_of(spark, sf)).select("work_id", "block_no", "kind", "block_id")


@query("block_offsets", "SELECT work_id, block_no, block_id, at, size, total FROM cur")
def block_offsets(spark, sf):
    return b.block_places(blocks_of(spark, sf)).select("work_id", "block_no", "block_id", "at", "size", "total")


@query("utf16_length", "SELECT doc_id, CAST(length(coalesce(text, '')) + length(regexp_replace(coalesce(text, ''), '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS BIGINT) AS units FROM documents", "")
def utf16(spark, sf):
    return read(spark, sf, "documents").select("doc_id", utf16_length(F.coalesce("text", F.lit(""))).alias("units"))


@query("make_positions", "SELECT * FROM pos", SAVED)
def make_positions(spark, sf):
    return _Works(spark, sf).positions


@query("restore_exact", "SELECT * FROM exact", SAVED)
def restore_exact(spark, sf):
    works = _Works(spark, sf)
    return a.restore_exact(kept(works.saved), works.revised)


@query("restore_context", "SELECT * FROM ctx", SAVED)
def restore_context(spark, sf):
    works = _Works(spark, sf)
    return a.restore_context(kept(works.saved), works.revised)


@query("restore_percent", "SELECT * FROM pct", SAVED)
def restore_percent(spark, sf):
    works = _Works(spark, sf)
    return a.restore_percent(works.saved, kept(b.block_places(works.revision)))


@query("restore_positions", 'SELECT * FROM exact UNION ALL SELECT * FROM ctx WHERE position_id NOT IN (SELECT position_id FROM exact) UNION ALL SELECT * FROM pct WHERE position_id NOT IN (SELECT position_id FROM exact) AND position_id NOT IN (SELECT position_id FROM ctx)', SAVED)
def restore_positions(spark, sf):
    works = _Works(spark, sf)
    return a.restore_positions(kept(works.saved), works.revised)


_work = "SELECT lpad(CAST(doc_id AS STRING), 6, '0') AS work_id, CASE WHEN doc_id % 41 = 3 THEN '' ELSE 'T' END AS title, CASE WHEN doc_id % 43 = 4 THEN '' ELSE 'N' END AS orthography, CASE WHEN doc_id % 3 = 0 THEN 's' ELSE '' END AS subtitle, CASE WHEN doc_id % 37 = 5 THEN 'r' ELSE '' END AS subtitle_reading, CASE WHEN doc_id % 2 = 0 THEN 'xhtml' ELSE 'text' END AS converter_path, CASE WHEN doc_id % 2 = 0 OR doc_id % 47 = 6 THEN 'a.html' ELSE 'a.zip' END AS file_url, CAST(doc_id % 53 AS INT) AS n_people FROM {documents}"
_block = "SELECT lpad(CAST(work_id AS STRING), 6, '0') AS work_id, block_no, CASE WHEN block_no = 9 AND work_id % 7 = 2 THEN 'p-0' ELSE 'p-' || CAST(block_no % 60 AS STRING) END AS block_id, CASE WHEN work_id % 29 = 1 AND block_no = 4 THEN 'table' ELSE kind END AS kind, CAST(CASE WHEN work_id % 31 = 2 AND block_no = 5 THEN 201 ELSE 2 END AS INT) AS chars, CAST(CASE WHEN work_id % 5 = 0 AND work_id % 15 = 0 THEN 4 ELSE 1 END AS INT) AS level, CAST(10 AS INT) AS width, CAST(CASE WHEN work_id % 17 = 4 THEN 20000 ELSE 20 END AS INT) AS height FROM {blocks}"


@query("validate_work_table", f""", w AS ({_work.format(documents="documents")}), bb AS ({_block.format(blocks="blk")}), v AS (
  SELECT work_id, -1 AS block_no, 1 AS n, 'title' AS path, 'empty' AS message FROM w WHERE title = '' UNION ALL SELECT work_id, -1, 2, 'orthography', 'empty' FROM w WHERE orthography = ''
  UNION ALL SELECT work_id, -1, 3, 'subtitleReading', 'without subtitle' FROM w WHERE subtitle_reading <> '' AND subtitle = '' UNION ALL SELECT work_id, -1, 4, 'people', 'empty' FROM w WHERE n_people < 1
  UNION ALL SELECT work_id, -1, 5, 'converterPath', 'another file' FROM w WHERE NOT (converter_path = 'xhtml' AND ends_with(file_url, '.html') OR converter_path = 'text' AND ends_with(file_url, '.zip'))
  UNION ALL SELECT work_id, block_no, 0, 'kind', 'unknown' FROM bb WHERE kind = 'table' UNION ALL SELECT work_id, block_no, 1, 'id', 'repeated' FROM (SELECT *, count(*) OVER (PARTITION BY work_id, block_id) AS c FROM bb) WHERE c > 1
  UNION ALL SELECT work_id, block_no, 2, 'layout', 'out of range' FROM bb WHERE chars > 200 UNION ALL SELECT work_id, block_no, 3, 'level', 'out of range' FROM bb WHERE kind = 'heading' AND level > 3
  UNION ALL SELECT work_id, block_no, 4, 'image', 'out of range' FROM bb WHERE kind = 'figure' AND height > 10000)
  SELECT work_id, block_no, path, message FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY block_no, n) AS r FROM v) WHERE r = 1""")
def validate_work_table(spark, sf):
    return b.validate_work_table(view(spark, _work, documents=read(spark, sf, "documents")), view(spark, _block, blocks=blocks_of(spark, sf)))


@query("work_json", "SELECT work_id, CAST(NULL AS STRING) AS problem, block_no, kind, text FROM cur")
def work_json(spark, sf):
    return b.read_work_json(b.work_json(b.block_ids(blocks_of(spark, sf))))


#: Each block as a text of the closed format, some with a fault.
_told = """SELECT work_id, block_no, CASE
  WHEN kind = 'pageBreak' THEN to_json(named_struct('kind', kind, 'style', CASE WHEN work_id % 13 = 2 THEN 'scroll' ELSE 'leaf' END))
  WHEN kind = 'figure' THEN to_json(named_struct('kind', kind, 'id', id, 'image', named_struct('url', 'https://library.example/cards/' || CASE WHEN work_id % 37 = 9 THEN '000013' ELSE '000012' END || '/files/' || block_no || '.png'), 'alt', '', 'size', named_struct('width', CASE WHEN work_id % 17 = 3 THEN 10001 ELSE 10 END, 'height', 20), 'caption', nodes))
  ELSE to_json(named_struct('kind', kind, 'id', id, 'level', CASE WHEN kind = 'heading' THEN 'small' END, 'layout', named_struct('kind', 'none'), 'inline', nodes, 'extra', CASE WHEN kind = 'paragraph' AND work_id % 11 = 1 THEN 1 END)) END AS block
  FROM (SELECT *, 'b' || CASE WHEN work_id % 7 = 4 THEN block_no % 9 ELSE block_no END AS id, filter(array(named_struct('kind', CASE WHEN kind <> 'figure' AND work_id % 5 = 4 AND block_no % 10 = 3 THEN 'txt' ELSE 'text' END, 'text', text)), n -> n.text <> '') AS nodes FROM {blocks})"""
_document = """SELECT work_id, CASE WHEN work_id % 29 = 7 THEN left(json, length(json) - 1) ELSE json END AS json FROM (SELECT work_id, '{{"schemaVersion":' || CASE WHEN work_id % 23 = 6 THEN '2' ELSE '1' END || ',"id":"' || lpad(work_id, 6, '0') || '","title":"' || CASE WHEN work_id % 19 = 5 THEN '' ELSE 'T' END
  || '","orthography":"x","people":[{{"role":"author","name":"A"}}],"provenance":{{"copyright":{{"work":"なし"}},"converter":{{"version":"1.0.0","path":"xhtml"}},"bibliography":["b"],"source":{{"upstreamUpdated":"2024-02-29","cardUrl":"https://library.example/cards/000012/card' || work_id || '.html","fileUrl":"https://library.example/cards/000012/files/' || work_id || '_1.html"}}}},"blocks":['
  || array_join(transform(array_sort(collect_list(struct(block_no, block))), b -> b.block), ',') || ']}}' AS json FROM {told} GROUP BY work_id)"""


@query("document_faults", """, q AS (SELECT *, work_id AS w, 'b' || CAST(CASE WHEN work_id % 7 = 4 THEN block_no % 9 ELSE block_no END AS STRING) AS id, '$.blocks[' || CAST(row_number() OVER (PARTITION BY work_id ORDER BY block_no) - 1 AS STRING) || ']' AS p FROM blk),
  f AS (SELECT w, 3 AS o, block_no AS i, 0 AS n, p || '.extra' AS path, 'unknown field' AS message FROM q WHERE kind = 'paragraph' AND w % 11 = 1 UNION ALL SELECT w, 3, block_no, 0, p || '.style', 'not an allowed value' FROM q WHERE kind = 'pageBreak' AND w % 13 = 2
  UNION ALL SELECT w, 3, block_no, 0, p || '.size.width', 'not a whole number from 1 to 10000' FROM q WHERE kind = 'figure' AND w % 17 = 3 UNION ALL SELECT w, 3, block_no, 8, p || '.inline[0].kind', 'unknown kind' FROM q WHERE kind IN ('paragraph', 'heading') AND w % 5 = 4 AND block_no % 10 = 3 AND text <> ''
  UNION ALL SELECT w, 4, block_no, 0, p || '.id', 'repeated' FROM (SELECT *, row_number() OVER (PARTITION BY w, id ORDER BY block_no) AS r FROM q WHERE kind <> 'pageBreak') WHERE r > 1 UNION ALL SELECT DISTINCT w, 5, 0, 0, '$.title', 'not a filled text' FROM q WHERE w % 19 = 5
  UNION ALL SELECT w, 9, block_no, 0, p || '.image.url', 'not a file of this work' FROM q WHERE kind = 'figure' AND w % 37 = 9)
  SELECT DISTINCT w AS work_id, CASE WHEN w % 29 = 7 THEN 'unreadable' ELSE 'unsupported-version' END AS code, CAST(NULL AS STRING) AS path, CAST(NULL AS STRING) AS message FROM q WHERE w % 29 = 7 OR w % 23 = 6
  UNION ALL SELECT w, 'invalid', path, message FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY o, i, n) AS r FROM f WHERE w % 29 <> 7 AND w % 23 <> 6) WHERE r = 1""")
def document_faults(spark, sf):
    """Documents of the closed format, written from every block, and read back as strangers' texts."""
    told = view(spark, _told, blocks=blocks_of(spark, sf))
    return documents.document_faults(kept(view(spark, _document, told=told)))
