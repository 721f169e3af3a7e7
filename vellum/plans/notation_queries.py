"""Queries of the notation jobs, each with SQL for the same rows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from vellum.operators import notation as n
from vellum.operators import runs
from vellum.plans.block_queries import LINES, UNSEEN, lines_of
from vellum.sources.adapters import MARKED, WHOLE, oracle, read, view
from vellum.sources.scratch import kept

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
P = n.NOTES
_units = lambda x: f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"
_case = lambda label, names: f"CASE {label} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"
_visible = lambda x: f"regexp_replace(regexp_replace(regexp_replace({x}, '※［＃[^］]*］', '￼', 'g'), '［＃[^］]*入る］', '￼', 'g'), '［＃[^］]*］|《[^》]*》|｜', '', 'g')"
_kind = lambda x: "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{k}'" for k, p in P.items()) + " ELSE 'unknown' END"
_num = lambda x: f"coalesce(CAST(nullif(translate({x}, '０１２３４５６７８９', '0123456789'), '') AS INT), 0)"
WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
BASE = f"""WITH {LINES}, mk AS ({oracle(MARKED, lines="lines")}),
ts AS (SELECT work_id, no, line, regexp_extract_all(line, '{n.TOKEN}') AS t FROM mk),
tk0 AS (SELECT work_id, no, line, unnest(t) AS tok, generate_subscripts(t, 1) - 1 AS token_no FROM ts),
tk1 AS (SELECT *, coalesce(sum({_units("tok")}) OVER u, 0)::BIGINT AS col, coalesce(sum(length(tok)) OVER u, 0)::BIGINT AS cp, coalesce(lead(tok) OVER (PARTITION BY work_id, no ORDER BY token_no), '') AS nx FROM tk0 WINDOW u AS (PARTITION BY work_id, no ORDER BY token_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tk2 AS (SELECT *, CASE WHEN starts_with(tok, '※［＃') THEN 'gaiji' WHEN starts_with(tok, '［＃') THEN 'note' WHEN tok = '｜' THEN 'bar' WHEN tok IN ('《', '》') THEN 'unclosed' WHEN starts_with(tok, '《') THEN 'ruby' WHEN tok = '［' AND starts_with(nx, '＃') THEN 'unclosed' ELSE 'text' END AS kind FROM tk1),
tk AS (SELECT work_id, no, CAST(token_no AS INT) AS token_no, kind, CASE WHEN kind IN ('gaiji', 'note', 'ruby') THEN regexp_replace(tok, '^※?［＃|］$|^《|》$', '', 'g') ELSE tok END AS text, col, cp, line FROM tk2),
nt AS (SELECT work_id, no, token_no, col, cp, line, text AS inner, {_kind("text")} AS note, {_visible("substr(line, 1, CAST(cp AS INT))")} AS before FROM tk WHERE kind = 'note'),
rb0 AS (SELECT *, substr(line, 1, CAST(cp AS INT)) AS b FROM tk WHERE kind = 'ruby'),
rb AS (SELECT work_id, no, CAST(row_number() OVER (PARTITION BY work_id, no ORDER BY token_no) - 1 AS INT) AS n, col, coalesce(nullif(regexp_extract(b, '｜([^《｜]+)$', 1), ''), nullif(regexp_extract(b, '([㐀-䶿一-鿿豈-﫿々〆〇ヶ\\x{{20000}}-\\x{{3FFFF}}]+)$', 1), ''), nullif(regexp_extract(b, '([\\p{{Latin}}\\p{{Greek}}\\p{{Cyrillic}}]+)$', 1), ''), '') AS base, text AS reading FROM rb0),
ruby AS (SELECT *, CASE WHEN base = '' OR regexp_replace(reading, '[{UNSEEN}]', '', 'g') = '' OR regexp_matches(reading, '［＃|｜|※|《') THEN 'ruby-base' END AS code FROM rb),
gj0 AS (SELECT work_id, no, token_no, text, string_split(text, '、') AS parts FROM tk WHERE kind = 'gaiji'),
gj1 AS (SELECT *, '^(?:第([34])水準)?([0-9])-([0-9]{{1,2}})-([0-9]{{1,2}})$' AS j, list_filter(parts, lambda p: regexp_matches(p, '^U\\+[0-9A-F]{{4,6}}$')) AS us FROM gj0),
gj2 AS (SELECT *, regexp_matches(parts[-1], j) AS jis, len(us) + len(list_filter(parts, lambda p: regexp_matches(p, '^(?:第([34])水準)?([0-9])-([0-9]{{1,2}})-([0-9]{{1,2}})$'))) > 1 AS many, coalesce(TRY_CAST(regexp_extract(parts[-1], j, 1) AS INT), 0) AS lv, coalesce(TRY_CAST(regexp_extract(parts[-1], j, 2) AS INT), 0) AS pl, coalesce(TRY_CAST(regexp_extract(parts[-1], j, 3) AS INT), 0) AS ro, coalesce(TRY_CAST(regexp_extract(parts[-1], j, 4) AS INT), 0) AS ce FROM gj1),
gj3 AS (SELECT *, NOT many AND jis AND pl IN (1, 2) AND (lv = 0 OR lv = pl + 2) AND ro BETWEEN 1 AND 94 AND ce BETWEEN 1 AND 94 AS pic, CASE WHEN NOT many AND NOT jis AND len(us) = 1 THEN chr(('0x' || substr(us[1], 3))::INT) END AS ch FROM gj2),
gj AS (SELECT work_id, no, token_no, text AS description, CASE WHEN pic THEN 'https://library.example/gaiji/' || pl || '-' || lpad(CAST(ro AS STRING), 2, '0') || '/' || pl || '-' || lpad(CAST(ro AS STRING), 2, '0') || '-' || lpad(CAST(ce AS STRING), 2, '0') || '.png' END AS url, ch AS character,
  CASE WHEN NOT pic AND ch IS NULL AND NOT (len(parts) = 2 AND parts[1] <> '' AND regexp_matches(parts[-1], '^[0-9]+-[0-9]+$')) THEN 'unknown-notation' END AS code FROM gj3),
pr0 AS (SELECT *, regexp_replace(note, '-(open|close)$', '') AS fam, regexp_extract(regexp_replace(inner, '終わり$', ''), '^(?:左に)?(.*)$', 1) AS name, starts_with(inner, '左に') AS lf FROM nt WHERE regexp_matches(note, '-(open|close)$')),
pr AS (SELECT *, lead(note) OVER w AS nn, lead(cp) OVER w AS nc FROM pr0 WINDOW w AS (PARTITION BY work_id, no, fam, name, lf ORDER BY token_no)),
acc AS (SELECT work_id, CAST(no AS INT) AS line, {_units("regexp_extract(line, '(?s)^(.*?)〔[^〔〕]*[A-Za-z][^〔〕]*〕', 1)")}::BIGINT AS "column", 'unknown-notation' AS code FROM mk WHERE regexp_matches(line, '〔[^〔〕]*[A-Za-z][^〔〕]*〕')),
unk AS (SELECT work_id, no AS line, col AS "column", 'unknown-notation' AS code FROM nt WHERE note = 'unknown' UNION ALL SELECT * FROM acc),
sp0 AS (SELECT work_id, no, count(*) AS c, list(ends_with(note, '-open') ORDER BY token_no) AS os, list(regexp_replace(inner, '終わり$', '') ORDER BY token_no) AS names, list(token_no ORDER BY token_no) AS ix, list(col ORDER BY token_no) AS cs FROM nt WHERE regexp_matches(note, '-(open|close)$') AND note NOT LIKE 'close-%' GROUP BY work_id, no),
sp1 AS (SELECT work_id, no, CASE WHEN c = 2 AND os = [true, false] AND names[1] = names[2] THEN CASE WHEN ix[2] = ix[1] + 1 THEN {{'col': cs[2], 'code': 'unsupported-construct'}} END
  WHEN c = 4 AND os = [true, true, false, false] AND names[1] = names[4] AND names[2] = names[3] THEN CASE WHEN ix[3] = ix[2] + 1 THEN {{'col': cs[3], 'code': 'unsupported-construct'}} END
  WHEN os[1] AND c < 3 THEN {{'col': cs[c], 'code': 'unclosed-notation'}} ELSE {{'col': cs[1], 'code': 'unclosed-notation'}} END AS f FROM sp0),
sp AS (SELECT work_id, no, f.col AS col, f.code AS code FROM sp1 WHERE f IS NOT NULL),
cr0 AS (SELECT work_id, no, line, regexp_extract(line, '^［＃([^］]*)］$', 1) AS i FROM mk),
cr1 AS (SELECT *, {_kind("i")} AS k FROM cr0),
cr2 AS (SELECT *, CASE WHEN k LIKE 'range-%' THEN substr(k, 7) WHEN k LIKE 'close-%' THEN k END AS mark, CASE WHEN k = 'range-indent' THEN {_num(f"regexp_extract(i, '{P['range-indent']}', 1)")} WHEN k = 'range-hanging' THEN {_num(f"regexp_extract(i, '{P['range-hanging']}', 2)")} WHEN k LIKE 'range-%' OR k LIKE 'close-%' THEN {_num(f"regexp_extract(i, '{P['range-end']}', 2)")} END AS size FROM cr1),
cr3 AS (SELECT *, last_value(mark IGNORE NULLS) OVER w AS bf, last_value(size IGNORE NULLS) OVER w AS cs, max(no) FILTER (mark IS NOT NULL) OVER (PARTITION BY work_id) = no AS fin FROM cr2 WINDOW w AS (PARTITION BY work_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cr4 AS (SELECT *, coalesce(bf IN ('indent', 'hanging', 'end'), false) AS op FROM cr3),
cr AS (SELECT work_id, no, CASE WHEN mark IS NULL AND op THEN bf END AS layout, CASE WHEN mark IS NULL AND op THEN cs END AS chars, CASE WHEN mark IN ('indent', 'hanging', 'end') AND op AND NOT (mark <> 'end' AND bf IN ('indent', 'hanging')) THEN 'unsupported-construct'
  WHEN (mark = 'close-indent' AND NOT coalesce(bf IN ('indent', 'hanging'), false)) OR (mark = 'close-end' AND NOT coalesce(bf = 'end', false)) OR (mark IN ('indent', 'hanging', 'end') AND fin) THEN 'unclosed-notation' END AS code FROM cr4),
ll0 AS (SELECT work_id, no, op, regexp_extract(line, '^［＃([^］]*)］(?:［＃([^］]*)］)?', 1) AS l1, regexp_extract(line, '^［＃([^］]*)］(?:［＃([^］]*)］)?', 2) AS l2 FROM cr4),
ll AS (SELECT work_id, no, CASE WHEN l1 LIKE '%字下げ' THEN 'indent' ELSE 'end' END AS layout, {_num("regexp_extract(l1, '([０-９0-9]+)字(下|上)げ$', 1)")} AS chars, CASE WHEN op OR regexp_matches(l2, '^((天から)?[０-９0-9]+字下げ|地付き|地から[０-９0-9]+字上げ)$') THEN 'unsupported-construct' END AS code FROM ll0 WHERE regexp_matches(l1, '^((天から)?[０-９0-9]+字下げ|地付き|地から[０-９0-9]+字上げ)$')),
wh AS ({oracle(WHOLE, marked="mk", documents="documents")}),
pl0 AS (SELECT work_id, coalesce(list(no ORDER BY no) FILTER (regexp_matches(line, '^-{{20,}}$')), []) AS d, coalesce(list(no) FILTER (line = '{n.LEGEND}'), []) AS lg, coalesce(list(no ORDER BY no) FILTER (line = '{n.END_MARK}'), []) AS en, coalesce(list(no ORDER BY no) FILTER (starts_with(line, '{n.BASE_MARK}')), []) AS bs FROM wh GROUP BY work_id),
pl AS (SELECT work_id, d[2] AS second, CASE WHEN d[2] IS NULL OR NOT list_contains(lg, d[1] + 1) THEN 'missing-section' WHEN len(en) > 1 OR (len(en) = 0 AND len(bs) > 1) THEN 'unsupported-construct' WHEN len(en) = 0 AND len(bs) = 0 THEN 'missing-section' END AS code, coalesce(en[1], bs[1]) AS stop, CASE WHEN len(en) > 0 THEN en[1] + 1 ELSE bs[1] END AS rest FROM pl0),
sec AS (SELECT work_id, no, line, CASE WHEN no <= second THEN 'header' WHEN no < stop THEN 'body' WHEN no < rest THEN 'mark' ELSE 'bibliography' END AS section FROM wh JOIN pl USING (work_id) WHERE code IS NULL)
"""


def query(name: str, sql: str):
    def put(f):
        QUERIES[name] = f
        ORACLE[name] = re.sub(r"\binner\b", '"inner"', BASE + sql)  # a reserved word there
        return f

    return put


def _marked(spark, sf):
    return view(spark, MARKED, lines=lines_of(spark, sf))


def _tokens(spark, sf):
    return n.tokenize_lines(_marked(spark, sf))


def _notes(spark, sf):
    return n.notes_of(_tokens(spark, sf))


def _whole(spark, sf):
    return view(spark, WHOLE, marked=_marked(spark, sf), documents=read(spark, sf, "documents"))


@query("tokenize_line", "SELECT work_id, no, token_no, kind, text, col FROM tk")
def tokenize_line(spark, sf):
    return _tokens(spark, sf).drop("line", "at")


@query("ruby_pairs", "SELECT * FROM ruby")
def ruby_pairs(spark, sf):
    return n.ruby_pairs(_tokens(spark, sf))


@query("gaiji_refs", "SELECT * FROM gj")
def gaiji_refs(spark, sf):
    return n.gaiji_refs(_tokens(spark, sf))


def _span_sql(kind, names, side):
    s = f", CASE WHEN regexp_extract(inner, '{P[kind]}', 2) = 'の左' THEN 'left' ELSE 'right' END AS side" if side else ""
    t = ", CASE WHEN lf THEN 'left' ELSE 'right' END" if side else ""
    between = _visible("substr(line, CAST(cp AS INT) + length(inner) + 4, CAST(nc AS INT) - CAST(cp AS INT) - length(inner) - 3)")
    return f"""SELECT work_id, no, token_no, 'trailing' AS form, {_case(f"regexp_extract(inner, '{P[kind]}', 3)", names)} AS mark{s}, regexp_extract(inner, '{P[kind]}', 1) AS text, CASE WHEN NOT ends_with(before, regexp_extract(inner, '{P[kind]}', 1)) THEN 'unknown-notation' END AS code FROM nt WHERE note = '{kind}'
  UNION ALL SELECT work_id, no, token_no, 'pair', {_case("name", names)}{t}, CASE WHEN coalesce(nn = '{kind}-close', false) THEN {between} ELSE '' END, CASE WHEN NOT coalesce(nn = '{kind}-close', false) THEN 'unclosed-notation' END FROM pr WHERE note = '{kind}-open'"""


@query("emphasis_spans", _span_sql("emphasis", n.DOTS, True))
def emphasis_spans(spark, sf):
    return n.emphasis_spans(_notes(spark, sf))


@query("container_spans", _span_sql("container", n.CONTAINERS, False))
def container_spans(spark, sf):
    return n.container_spans(_notes(spark, sf))


_rest = lambda note, cp: f"regexp_replace(substr(line, CAST({cp} AS INT) + length({note}) + 4), '[{UNSEEN}]', '', 'g') <> ''"
_size = lambda x: f"CASE {x} WHEN '大' THEN 'large' WHEN '中' THEN 'medium' ELSE 'small' END"


HEADINGS_SQL = f"""SELECT work_id, no, col, 'trailing' AS form, {_size("regexp_extract(inner, '(.)見出し$', 1)")} AS level, t AS text, CASE WHEN before <> t OR {_rest('inner', 'cp')} THEN 'unsupported-construct' END AS code FROM (SELECT *, regexp_extract(inner, '^「(.+)」は[大中小]見出し$', 1) AS t FROM nt) WHERE t <> ''
  UNION ALL SELECT work_id, no, col, 'pair', {_size('substr(inner, 1, 1)')}, CASE WHEN closed THEN {_visible("substr(line, CAST(cp AS INT) + length(inner) + 4, CAST(np AS INT) - CAST(cp AS INT) - length(inner) - 3)")} ELSE '' END,
    CASE WHEN before <> '' OR nth > 1 THEN 'unsupported-construct' WHEN NOT closed THEN 'unclosed-notation' WHEN {_rest('ni', 'np')} THEN 'unsupported-construct' END
  FROM (SELECT *, coalesce(ni = inner || '終わり', false) AS closed FROM (SELECT *, lead(inner) OVER w AS ni, lead(cp) OVER w AS np, row_number() OVER w AS nth FROM nt WHERE regexp_matches(inner, '^[大中小]見出し(終わり)?$') WINDOW w AS (PARTITION BY work_id, no ORDER BY token_no))) WHERE inner NOT LIKE '%終わり'"""


@query("headings", f"SELECT * EXCLUDE (col) FROM ({HEADINGS_SQL})")
def headings(spark, sf):
    return n.headings(_notes(spark, sf))


@query("page_breaks", f"SELECT work_id, no, CASE WHEN i = 'ページの左右中央' THEN 'pageCenter' ELSE 'pageBreak' END AS kind, {_case('i', n.BREAKS)} AS style FROM cr0 WHERE i = 'ページの左右中央' OR {_case('i', n.BREAKS)} IS NOT NULL")
def page_breaks(spark, sf):
    return n.page_breaks(_marked(spark, sf))


@query("line_layout", "SELECT * FROM ll")
def line_layout(spark, sf):
    return n.line_layout(_marked(spark, sf))


@query("image_notes", f"SELECT work_id, no, CASE WHEN line = '［＃' || inner || '］' THEN 'figure' ELSE 'inline' END AS kind, regexp_extract(inner, '{P['image']}', 1) AS alt, 'https://library.example/cards/' || work_id || '/files/' || regexp_extract(inner, '{P['image']}', 2) AS url, TRY_CAST(regexp_extract(inner, '{P['image']}', 5) AS INT) AS width, TRY_CAST(regexp_extract(inner, '{P['image']}', 6) AS INT) AS height FROM nt WHERE note = 'image'")
def image_notes(spark, sf):
    files = read(spark, sf, "documents").select(F.col("doc_id").alias("work_id"), F.concat(F.lit("https://library.example/cards/"), "doc_id", F.lit("/files/1_1.html")).alias("file_url"))
    return n.image_notes(_notes(spark, sf), files)


@query("editorial_notes", "SELECT work_id, no, token_no, inner FROM nt WHERE note = 'editorial'")
def editorial_notes(spark, sf):
    return n.editorial_notes(_notes(spark, sf))


@query("unknown_notation", "SELECT * FROM unk")
def unknown_notation(spark, sf):
    return n.unknown_notation(_notes(spark, sf), _marked(spark, sf))


@query("visible_text", f"SELECT work_id, no, {_visible('line')} AS text FROM mk")
def visible_text(spark, sf):
    return _marked(spark, sf).select("work_id", "no", n.visible_text(F.col("line")).alias("text"))


@query("has_visible", f"SELECT work_id, no, regexp_replace({_visible('line')}, '[{UNSEEN}]', '', 'g') <> '' AS visible FROM mk")
def has_visible(spark, sf):
    return n.has_visible(_marked(spark, sf))


@query("span_pairs", "SELECT * FROM sp")
def span_pairs(spark, sf):
    return n.span_pairs(_notes(spark, sf))


@query("carry_ranges", "SELECT * FROM cr")
def carry_ranges(spark, sf):
    return n.carry_ranges(_marked(spark, sf))


@query("split_sections", "SELECT work_id, no, section FROM sec UNION ALL SELECT work_id, -1, code FROM pl WHERE code IS NOT NULL")
def split_sections(spark, sf):
    lines = _whole(spark, sf)
    return n.split_sections(lines).unionByName(n.section_faults(lines).select("work_id", F.lit(-1).alias("no"), F.col("code").alias("section")))


@query("bibliography", f"SELECT work_id, row_number() OVER (PARTITION BY work_id ORDER BY no) AS n, line FROM (SELECT work_id, no, regexp_replace(line, '[{WS}]+$', '') AS line FROM sec WHERE section = 'bibliography') WHERE line <> ''")
def bibliography(spark, sf):
    return n.bibliography(_whole(spark, sf))


CAPTIONS_SQL = f"""SELECT work_id, CASE WHEN code IS NULL THEN fno END AS figure_no, no, caption, code FROM (
  SELECT *, CASE WHEN pair AND starts_with(line, '［＃キャプション］') AND NOT closed THEN 'unclosed-notation' WHEN laid OR NOT fig OR (pair AND (NOT closed OR regexp_replace(regexp_extract(line, '^［＃キャプション］(.*)［＃キャプション終わり］(.*)$', 2), '[{UNSEEN}]', '', 'g') <> '')) THEN 'unsupported-construct' END AS code,
    CASE WHEN pair THEN {_visible("regexp_extract(line, '^［＃キャプション］(.*)［＃キャプション終わり］(.*)$', 1)")} ELSE regexp_extract(line, '［＃「([^］]+)」はキャプション］$', 1) END AS caption
  FROM (SELECT c.*, r.layout IS NOT NULL OR l.layout IS NOT NULL AS laid FROM (SELECT work_id, no, line, contains(line, '［＃キャプション］') AS pair, regexp_matches(line, '^［＃キャプション］.*［＃キャプション終わり］') AS closed, coalesce(lag(regexp_matches(line, '^［＃[^］]*（[^（）]*）入る］$')) OVER (PARTITION BY work_id ORDER BY no), false) AS fig, lag(no) OVER (PARTITION BY work_id ORDER BY no) AS fno FROM mk) c
    JOIN cr r ON c.work_id = r.work_id AND c.no = r.no LEFT JOIN ll l ON c.work_id = l.work_id AND c.no = l.no WHERE pair OR regexp_matches(line, '［＃「[^］]+」はキャプション］$')))"""


@query("attach_captions", CAPTIONS_SQL)
def attach_captions(spark, sf):
    return n.attach_captions(_marked(spark, sf))


_level = "CASE " + " ".join(f"WHEN regexp_matches(line, '［＃「.+」は{k}見出し］[{WS}]*$|^(［＃[^］]*］)?［＃{k}見出し］.*［＃{k}見出し終わり］[{WS}]*$') THEN '{v}'" for k, v in (("大", "large"), ("中", "medium"), ("小", "small"))) + " END"


@query("to_blocks", f"""SELECT c.work_id, c.no, kind, level, coalesce(l.layout, r.layout) AS layout, CASE WHEN l.layout IS NOT NULL THEN l.chars ELSE r.chars END AS chars, CASE WHEN kind IN ('pageBreak', 'pageCenter') THEN '' ELSE {_visible('line')} END AS text
  FROM (SELECT *, CASE WHEN note = 'break' THEN 'pageBreak' WHEN note = 'center' THEN 'pageCenter' WHEN note = 'image' THEN 'figure' WHEN level IS NOT NULL THEN 'heading' ELSE 'paragraph' END AS kind FROM (SELECT work_id, no, line, CASE WHEN i <> '' THEN k ELSE '' END AS note, {_level} AS level FROM cr1)) c
  JOIN cr r ON c.work_id = r.work_id AND c.no = r.no LEFT JOIN ll l ON c.work_id = l.work_id AND c.no = l.no WHERE note NOT LIKE 'range-%' AND note NOT LIKE 'close-%'""")
def to_blocks(spark, sf):
    return n.to_blocks(_marked(spark, sf))


_caption_col = f"CASE WHEN contains(line, '［＃キャプション］') THEN {_units("split_part(line, '［＃キャプション］', 1)")} ELSE {_units("regexp_extract(line, '^(.*)［＃[^］]*］$', 1)")} END"
_spans_with_col = lambda sql: f"SELECT s.work_id, s.no, nt.col, s.code FROM ({sql}) s JOIN nt ON s.work_id = nt.work_id AND s.no = nt.no AND s.token_no = nt.token_no WHERE s.form = 'trailing'"
FAULTS = f"""SELECT * FROM unk UNION ALL SELECT * FROM (SELECT work_id, no, col, 'unclosed-notation' AS code FROM tk WHERE kind = 'unclosed'
  UNION ALL SELECT g.work_id, g.no, t.col, g.code FROM gj g JOIN tk t ON g.work_id = t.work_id AND g.no = t.no AND g.token_no = t.token_no UNION ALL SELECT work_id, no, col, code FROM ruby UNION ALL SELECT * FROM sp
  UNION ALL SELECT work_id, no, 0, code FROM ll UNION ALL SELECT work_id, no, 0, code FROM cr UNION ALL {_spans_with_col(_span_sql("emphasis", n.DOTS, True))} UNION ALL {_spans_with_col(_span_sql("container", n.CONTAINERS, False))}
  UNION ALL SELECT work_id, no, col, code FROM ({HEADINGS_SQL}) WHERE NOT (form = 'pair' AND code = 'unclosed-notation') UNION ALL SELECT c.work_id, c.no, {_caption_col}, c.code FROM ({CAPTIONS_SQL}) c JOIN mk ON c.work_id = mk.work_id AND c.no = mk.no) WHERE code IS NOT NULL"""
_first = lambda faults: f"""SELECT work_id, f.line, f."column", f.code, {_case('f.code', {k: v.replace("'", "''") for k, v in n.MESSAGES.items()})} AS message FROM (SELECT work_id, min({{'line': line, 'column': "column", 'code': code}}) AS f FROM ({faults}) GROUP BY work_id)"""


@query("first_failure", _first(FAULTS))
def first_failure(spark, sf):
    lines = kept(_marked(spark, sf))
    return runs.first_failure(n.line_faults(lines), n.MESSAGES)


@query("line_faults", f"SELECT work_id, line, \"column\", code, count(*) AS times FROM ({FAULTS}) GROUP BY ALL")
def line_faults(spark, sf):
    lines = kept(_marked(spark, sf))
    return n.line_faults(lines).groupBy("work_id", "line", "column", "code").agg(F.count(F.lit(1)).alias("times"))


@query("work_failures", _first(FAULTS + " UNION ALL SELECT work_id, -1, 0, code FROM pl WHERE code IS NOT NULL"))
def work_failures(spark, sf):
    """The first failure of whole texts, with their sections."""
    return runs.first_failure(n.work_faults(kept(_whole(spark, sf))), n.MESSAGES)


def _of_bodies(sql: str) -> str:
    """The SQL with the bodies of whole texts in place of the marked lines."""
    lines, marked, rest = sql.partition("mk AS (")
    made, notation, tail = rest.partition("ts AS (")
    between, whole, after = tail.partition("wh AS (")
    sections, end, last = after.partition("FROM wh JOIN pl USING (work_id) WHERE code IS NULL)")
    return f"{lines}mk0 AS ({made}wh AS ({sections.replace('mk', 'mk0')}{end}, mk AS (SELECT work_id, no, line FROM sec WHERE section = 'body'), ts AS ({between.rstrip().rstrip(',')}{last}"


ORACLE["work_failures"] = _of_bodies(ORACLE["work_failures"])
