"""Queries of the markup and image jobs, each with SQL for the same rows."""

from __future__ import annotations

import io
import re
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from vellum.functions.skew import frequent_keys, hot_keys
from vellum.operators import images as im
from vellum.operators import markup as m
from vellum.plans.block_queries import UNSEEN
from vellum.sources import readers
from vellum.sources.adapters import IMAGE_REFS, INVENTORY, MARKUP, oracle, read, view

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_in = lambda names: "(" + ", ".join(f"'{x}'" for x in names) + ")"
_case = lambda label, names: f"CASE {label} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"
_blank = lambda x: f"regexp_replace({x}, '[{UNSEEN}]', '', 'g') = ''"
_path = lambda x: f"string_split(substr({x}, 25), '/')"  # noqa: E731  what follows the host
_allowed = lambda x: f"(starts_with({x}, 'https://library.example/') AND len(list_filter({_path(x)}, lambda s: NOT regexp_full_match(s, '[A-Za-z0-9_.-]+') OR s IN ('.', '..'))) = 0 AND (({_path(x)}[1] = 'gaiji' AND len({_path(x)}) > 1) OR (len({_path(x)}) = 4 AND {_path(x)}[1] = 'cards' AND regexp_full_match({_path(x)}[2], '[0-9]{{6}}') AND {_path(x)}[3] = 'files')) AND regexp_matches({_path(x)}[-1], '.\\.(png|jpg|jpeg|gif)$'))"
#: A tag's attributes in SQL of their own: quoted values first, then what has none.
_ATTR = r"""[\s/]([^\s"''<>/=]+)(?:\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''=<>`]+)))?"""
BASE = f"""WITH pg AS ({oracle(MARKUP, pages="pages")}),
mh AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), '(?is)(<(script|style)\\b[^>]*>).*?</(script|style)\\s*>', '\\1</\\2>', 'g') AS h FROM pg),
n0 AS (SELECT page_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS node_no FROM (SELECT page_id, regexp_extract_all(h, '<(?:[^<>"'']+|"[^"]*"|''[^'']*'')*>|<[^>]*>|[^<]+') AS t FROM mh)),
n1 AS (SELECT *, lower(regexp_extract(token, '{m.TAG}', 1)) AS tag FROM n0),
n2 AS (SELECT *, CASE WHEN NOT starts_with(token, '<') THEN 'text' WHEN tag = '' THEN 'other' WHEN starts_with(token, '</') THEN 'close' WHEN tag IN {_in(m.VOID)} OR ends_with(token, '/>') THEN 'void' ELSE 'open' END AS kind FROM n1),
nd AS (SELECT page_id, CAST(node_no AS INT) AS node_no, kind, tag, CAST(coalesce(sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY node_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS depth, token FROM n2),
at0 AS (SELECT page_id, node_no, tag, {", ".join(f"regexp_extract_all(token, '{_ATTR}', {g}) AS a{g}" for g in (1, 2, 3, 4))} FROM nd WHERE kind IN ('open', 'void')),
att AS (SELECT page_id, node_no, tag, lower(a1[i]) AS name, coalesce(a2[i], '') || coalesce(a3[i], '') || coalesce(a4[i], '') AS value FROM (SELECT *, unnest(generate_series(1, len(a1))) AS i FROM at0)),
im0 AS (SELECT page_id, node_no, max(value) FILTER (name = 'class') AS class, max(value) FILTER (name = 'src') AS src, max(value) FILTER (name = 'alt') AS alt, max(value) FILTER (name = 'width') AS width, max(value) FILTER (name = 'height') AS height FROM att WHERE tag = 'img' GROUP BY 1, 2),
mt AS (SELECT *, lead(kind) OVER w AS lk, lead(node_no) OVER w AS ln FROM (SELECT *, sum(CASE kind WHEN 'open' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id, tag ORDER BY node_no) + CASE kind WHEN 'close' THEN 1 ELSE 0 END AS lv FROM nd WHERE kind IN ('open', 'close') AND tag IN {_in([*m.SECTIONS, 'div'])}) WINDOW w AS (PARTITION BY page_id, tag, lv ORDER BY node_no)),
iv0 AS (SELECT page_id, node_no AS o, CASE WHEN lk = 'close' THEN ln END AS c, CASE WHEN tag = 'div' THEN 'ignored' ELSE {_case('tag', m.SECTIONS)} END AS name FROM mt WHERE kind = 'open' AND (tag <> 'div' OR contains(token, 'class="ad"'))),
iv AS (SELECT page_id, o, coalesce(c, (SELECT min(e) FROM (SELECT page_id AS q, o AS e FROM iv0 UNION ALL SELECT page_id, c FROM iv0) WHERE q = page_id AND e > o), 1000000000) AS c, name FROM iv0),
sc AS (SELECT n.page_id, n.node_no, n.kind, n.tag, n.token, arg_max(name, o) AS section FROM nd n LEFT JOIN iv ON n.page_id = iv.page_id AND n.node_no >= o AND n.node_no < c GROUP BY ALL),
sf AS (SELECT page_id, count(*) FILTER (kind = 'open' AND tag = 'article') AS main, count(*) FILTER (kind = 'open' AND tag = 'footer') AS bib, count(*) FILTER (kind IN ('open', 'void') AND section IS NULL AND tag NOT IN {_in(["html", "body", *m.ACTIVE])}) AS unknown, count(*) FILTER (kind = 'text' AND section IS NULL AND NOT {_blank('token')}) AS outside FROM sc GROUP BY page_id),
ai AS (SELECT *, coalesce(sum(CASE WHEN tag IN {_in([t for t in m.ACTIVE if t not in m.CODE and t not in m.VOID])} THEN CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END ELSE 0 END) OVER (PARTITION BY page_id ORDER BY node_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM nd),
rb AS (SELECT page_id, CAST(i - 1 AS INT) AS n, rs[i] AS r FROM (SELECT page_id, rs, unnest(generate_series(1, len(rs))) AS i FROM (SELECT page_id, regexp_extract_all(h, '(?is)<ruby(?:\\s[^>]*)?>(.*?)</ruby\\s*>', 1) AS rs FROM mh))),
rf AS ({oracle(IMAGE_REFS, pages="pages")}), inv AS ({oracle(INVENTORY, refs="rf")}),
sup AS (SELECT work_id, url FROM rf WHERE length(url) % 13 <> 4 UNION ALL SELECT work_id, url || '.old' FROM rf WHERE work_id % 9 = 1),
kp AS (SELECT url, md5(url) AS sha256, CASE WHEN length(url) % 5 = 0 THEN 'x' ELSE md5(url) END AS stored_sha256 FROM (SELECT DISTINCT url FROM rf) d WHERE length(url) % 3 <> 0),
ar AS (SELECT lpad(CAST(work_id AS STRING), 6, '0') AS work_id, url, CASE WHEN work_id % 17 = 2 THEN 'image/bmp' ELSE 'image/png' END AS mime, CAST(CASE WHEN work_id % 19 = 3 THEN 0 ELSE 10 END AS INT) AS width, CAST(20 AS INT) AS height, CASE work_id % 23 WHEN 4 THEN 'abc' WHEN 9 THEN 'QU=D' WHEN 14 THEN '' WHEN 15 THEN 'QQ==' ELSE 'QUJD' END AS data,
  CASE work_id % 29 WHEN 5 THEN 'works/999999.images-1.json.gz' WHEN 7 THEN 'works/' || lpad(CAST(work_id AS STRING), 6, '0') || '.images-x.json.gz' WHEN 11 THEN 'works/' || lpad(CAST(work_id AS STRING), 6, '0') || '.images-1.json' ELSE 'works/' || lpad(CAST(work_id AS STRING), 6, '0') || '.images-1.json.gz' END AS p1, 'works/' || lpad(CAST(work_id AS STRING), 6, '0') || CASE WHEN work_id % 31 = 6 THEN '.images-1.json.gz' ELSE '.images-2.json.gz' END AS p2 FROM rf)
"""


def query(name: str, sql: str):
    def put(f):
        QUERIES[name] = f
        ORACLE[name] = BASE + sql
        return f

    return put


def _pages(spark, sf):
    return view(spark, MARKUP, pages=read(spark, sf, "pages"))


def _nodes(spark, sf):
    return m.html_nodes(_pages(spark, sf))


def _refs(spark, sf):
    return view(spark, IMAGE_REFS, pages=read(spark, sf, "pages"))


def _inventory(spark, sf):
    return view(spark, INVENTORY, refs=_refs(spark, sf))


def _supplied(spark, sf):
    return view(spark, "SELECT work_id, url FROM {rf} WHERE length(url) % 13 <> 4 UNION ALL SELECT work_id, url || '.old' FROM {rf} WHERE work_id % 9 = 1", rf=_refs(spark, sf))


@query("html_nodes", "SELECT page_id, node_no, kind, tag, depth, CASE WHEN depth > 64 THEN 'unsupported-construct' END AS code FROM nd")
def html_nodes(spark, sf):
    return _nodes(spark, sf).drop("token")


@query("active_content", f"SELECT page_id, tag, count(*) AS n FROM nd WHERE kind IN ('open', 'void') AND tag IN {_in(m.ACTIVE)} GROUP BY 1, 2")
def active_content(spark, sf):
    return m.active_content(_nodes(spark, sf))


@query("active_attributes", f"SELECT page_id, node_no, name FROM att WHERE starts_with(name, 'on') OR (name IN {_in(m.URL_ATTRIBUTES)} AND regexp_matches(regexp_replace(value, '[\\x00-\\x20]', '', 'g'), '(?i)^(javascript|data|vbscript):'))")
def active_attributes(spark, sf):
    return m.active_attributes(_nodes(spark, sf))


@query("active_with_text", f"SELECT page_id, 'active-content' AS code FROM (SELECT page_id FROM ai WHERE kind = 'text' AND inside > 0 AND NOT {_blank('token')} UNION SELECT page_id FROM att WHERE tag IN {_in(m.ACTIVE)} AND name IN {_in(m.TEXT_ATTRIBUTES)} AND NOT {_blank('value')})")
def active_with_text(spark, sf):
    return m.active_with_text(_nodes(spark, sf))


@query("html_sections", "SELECT page_id, code FROM (SELECT page_id, CASE WHEN main = 0 OR bib = 0 THEN 'missing-section' WHEN main > 1 OR bib > 1 THEN 'unsupported-construct' WHEN unknown > 0 THEN 'unknown-section' WHEN outside > 0 THEN 'text-outside' END AS code FROM sf) WHERE code IS NOT NULL UNION ALL SELECT page_id, coalesce(section, '-') || ':' || count(*) FROM sc GROUP BY page_id, section")
def html_sections(spark, sf):
    nodes = _nodes(spark, sf)
    sizes = m.html_sections(nodes).groupBy("page_id", "section").count().select("page_id", F.concat_ws(":", F.coalesce("section", F.lit("-")), "count").alias("code"))
    return m.section_faults(nodes).unionByName(sizes)


def _lines_sql(section, ends):
    return f"""SELECT page_id, line_no, regexp_replace(line, '^[{WS}]+|[{WS}]+$', '', 'g') AS line FROM (SELECT page_id, line_no, string_agg(token, '' ORDER BY node_no) AS line FROM (SELECT *, count(CASE WHEN tag IN ('br', 'hr') OR (kind = 'close' AND tag IN {_in(ends)}) THEN 1 END) OVER (PARTITION BY page_id ORDER BY node_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS line_no FROM sc WHERE section = '{section}') WHERE kind = 'text' GROUP BY page_id, line_no) WHERE NOT {_blank('line')}"""


@query("html_lines", _lines_sql("main", m.BLOCK_ENDS))
def html_lines(spark, sf):
    return m.html_lines(_nodes(spark, sf))


@query("html_bibliography", _lines_sql("bibliography", ["-"]))
def html_bibliography(spark, sf):
    return m.html_bibliography(_nodes(spark, sf))


@query("html_ruby", f"SELECT page_id, n, base, reading, CASE WHEN nb <> 1 OR nr <> 1 OR {_blank('base')} OR {_blank('reading')} THEN 'ruby-base' END AS code FROM (SELECT page_id, n, len(b) AS nb, len(r2) AS nr, regexp_replace(coalesce(b[1], ''), '<[^>]*>', '', 'g') AS base, regexp_replace(coalesce(r2[1], ''), '<[^>]*>', '', 'g') AS reading FROM (SELECT page_id, n, regexp_extract_all(r, '(?is)<rb(?:\\s[^>]*)?>(.*?)</rb\\s*>', 1) AS b, regexp_extract_all(r, '(?is)<rt(?:\\s[^>]*)?>(.*?)</rt\\s*>', 1) AS r2 FROM rb))")
def html_ruby(spark, sf):
    return m.html_ruby(_pages(spark, sf))


@query("html_class_map", f"""SELECT page_id, node_no, tag, class, family, CASE family WHEN 'emphasis' THEN coalesce(dot, nullif(ln, '')) || '/' || CASE WHEN ends_with(class, '_after') OR starts_with(class, 'overline') THEN 'left' ELSE 'right' END WHEN 'container' THEN sp WHEN 'size' THEN sz WHEN 'heading' THEN hd WHEN 'layout' THEN la END AS name, CASE WHEN family IS NULL AND tag <> 'div' THEN 'unknown-class' END AS code FROM (
  SELECT *, CASE WHEN tag = 'em' AND (dot IS NOT NULL OR ln <> '') THEN 'emphasis' WHEN tag = 'span' AND sp IS NOT NULL THEN 'container' WHEN tag = 'span' AND sz <> '' THEN 'size' WHEN tag IN ('h3', 'h4', 'h5') AND hd IS NOT NULL THEN 'heading' WHEN tag = 'div' AND la <> '' THEN 'layout' END AS family FROM (
  SELECT page_id, node_no, tag, value AS class, {_case("regexp_replace(value, '_after$', '')", m.EMPHASIS)} AS dot, regexp_extract(value, '^(?:underline|overline)_(solid|double|dotted|dashed|wave)$', 1) AS ln, {_case('value', m.SPANS)} AS sp, {_case('value', m.HEADINGS)} AS hd, regexp_extract(value, '^((?:dai|sho)[1-5])$', 1) AS sz, regexp_extract(value, '^((?:jisage|chitsuki)_[0-9]{{1,3}}|burasage)$', 1) AS la FROM att WHERE name = 'class' AND tag IN ('em', 'span', 'h3', 'h4', 'h5', 'div')))""")
def html_class_map(spark, sf):
    return m.html_class_map(_nodes(spark, sf))


_size = lambda a: f"CASE WHEN regexp_full_match({a}, '[1-9][0-9]{{0,4}}') AND CAST({a} AS INT) <= 10000 THEN CAST({a} AS INT) END"


@query("html_images", f"SELECT page_id, node_no, kind, src, alt, width, height, CASE WHEN NOT {_allowed('src')} THEN 'external-image' WHEN kind = 'gaiji' AND (alt = '' OR NOT starts_with(src, 'https://library.example/gaiji/')) THEN 'unknown-notation' WHEN kind = 'illustration' AND (width IS NULL OR height IS NULL) THEN 'invalid-image' END AS code FROM (SELECT page_id, node_no, CASE WHEN class = 'gaiji' THEN 'gaiji' ELSE 'illustration' END AS kind, coalesce(src, '') AS src, coalesce(alt, '') AS alt, {_size('width')} AS width, {_size('height')} AS height FROM im0)")
def html_images(spark, sf):
    return m.html_images(_nodes(spark, sf))


@query("allowed_image_url", f"SELECT url, {_allowed('url')} AS allowed FROM (SELECT DISTINCT url FROM rf)")
def allowed_image_url(spark, sf):
    return _refs(spark, sf).select("url").distinct().select("url", im.allowed_url(F.col("url")).alias("allowed"))


@query("image_owner", "SELECT work_id, url, CASE WHEN starts_with(url, 'https://library.example/gaiji/') THEN true ELSE regexp_extract(url, '^https://library.example/cards/([0-9]{6})/files/', 1) = lpad(CAST(work_id % 90 AS STRING), 6, '0') END AS owned FROM rf")
def image_owner(spark, sf):
    refs = _refs(spark, sf)
    return im.image_owner(refs, refs.select("work_id").distinct().withColumn("person_id", F.lpad((F.col("work_id") % 90).cast("string"), 6, "0")))


@query("image_urls_per_work", "SELECT work_id, CAST(count(*) AS INT) AS n, string_agg(url, ' ' ORDER BY url) AS urls FROM rf GROUP BY work_id")
def image_urls_per_work(spark, sf):
    return im.image_urls_per_work(_refs(spark, sf))


@query("distinct_images", "SELECT url, count(DISTINCT work_id) AS works FROM rf GROUP BY url")
def distinct_images(spark, sf):
    return im.distinct_images(_refs(spark, sf))


@query("image_budget", "SELECT work_id, bytes, CASE WHEN f IS NOT NULL THEN f.code WHEN bytes > 30000000 THEN 'images-too-large' END AS code, f.url AS url FROM (SELECT work_id, CAST(coalesce(sum(byte_length) FILTER (code IS NULL), 0) AS BIGINT) AS bytes, min({'url': rf.url, 'code': code}) FILTER (code IS NOT NULL) AS f FROM rf JOIN inv USING (url) GROUP BY work_id)")
def image_budget(spark, sf):
    return im.image_budget(_refs(spark, sf), _inventory(spark, sf), 30_000_000)


@query("missing_images", "SELECT work_id, url FROM rf EXCEPT SELECT work_id, url FROM sup")
def missing_images(spark, sf):
    return im.missing_images(_refs(spark, sf), _supplied(spark, sf))


@query("unreferenced_images", "SELECT work_id, url FROM sup EXCEPT SELECT work_id, url FROM rf")
def unreferenced_images(spark, sf):
    return im.unreferenced_images(_refs(spark, sf), _supplied(spark, sf))


@query("inline_images", "SELECT work_id, url, mime, width, height, sha256 FROM rf JOIN inv USING (url) WHERE code IS NULL")
def inline_images(spark, sf):
    images = im.inline_images(_refs(spark, sf), _inventory(spark, sf))
    return images.select("work_id", F.explode("images").alias("url", "i")).select("work_id", "url", "i.mime", "i.width", "i.height", "i.sha256")


@query("frequent_images", "SELECT url AS key, count(*) AS n FROM rf GROUP BY url HAVING count(*) > 0.02 * (SELECT count(*) FROM rf)")
def frequent_images(spark, sf):
    """URLs of more than a fiftieth of all references."""
    return frequent_keys(_refs(spark, sf), "url", 0.02)


@query("shared_inline_images", "SELECT work_id, url, mime, width, height, sha256 FROM rf JOIN inv USING (url) WHERE code IS NULL")
def shared_inline_images(spark, sf):
    """Pictures of works, with the references of shared glyphs spread over tasks."""
    refs = _refs(spark, sf)
    images = im.inline_images(refs, _inventory(spark, sf), hot_keys(refs, "url", 0.02))
    return images.select("work_id", F.explode("images").alias("url", "i")).select("work_id", "url", "i.mime", "i.width", "i.height", "i.sha256")


@query("reuse_images", f"SELECT url, CASE WHEN NOT {_allowed('url')} THEN 'invalid-url' WHEN coalesce(sha256 = stored_sha256, false) THEN 'reuse' ELSE 'fetch' END AS decision FROM (SELECT DISTINCT url FROM rf) LEFT JOIN kp USING (url)")
def reuse_images(spark, sf):
    refs = _refs(spark, sf)
    kept = view(spark, "SELECT url, md5(url) AS sha256, CASE WHEN length(url) % 5 = 0 THEN 'x' ELSE md5(url) END AS stored_sha256 FROM (SELECT DISTINCT url FROM {rf}) d WHERE length(url) % 3 <> 0", rf=refs)
    return im.reuse_images(refs, kept)


PARTS = """e AS (SELECT work_id, url, CAST(length(to_json(url)) - 2 + length(mime) + length(width::VARCHAR) + length(height::VARCHAR) + 4 * ceil(byte_length / 3) + 46 AS BIGINT) AS size, row_number() OVER (PARTITION BY work_id ORDER BY url) AS k FROM rf JOIN inv USING (url) WHERE code IS NULL),
  f AS (SELECT work_id, list_reduce(list_prepend({'k': 0, 'url': '', 'size': 0::BIGINT, 'part': 1, 'held': 0::BIGINT, 'all': []::INT[]}, list({'k': k, 'url': url, 'size': size, 'part': 0, 'held': 0::BIGINT, 'all': []::INT[]} ORDER BY k)),
    lambda a, x: {'k': x.k, 'url': x.url, 'size': x.size, 'part': CASE WHEN a.held + x.size > 36000000 AND a.held > 0 THEN a.part + 1 ELSE a.part END, 'held': CASE WHEN a.held + x.size > 36000000 AND a.held > 0 THEN x.size ELSE a.held + x.size END, 'all': list_append(a."all", CAST(CASE WHEN a.held + x.size > 36000000 AND a.held > 0 THEN a.part + 1 ELSE a.part END AS INT))}) AS r FROM e GROUP BY work_id),
  parts AS (SELECT e.work_id, url, size, CASE WHEN s <= 36000000 THEN 1 ELSE r."all"[k] END AS part, CASE WHEN size > 36000000 THEN 'image-too-large' END AS code FROM e JOIN f USING (work_id) JOIN (SELECT work_id, sum(size) AS s FROM e GROUP BY work_id) USING (work_id))"""


@query("split_parts", f", {PARTS} SELECT * FROM parts")
def split_parts(spark, sf):
    return im.split_parts(_refs(spark, sf), _inventory(spark, sf), 40_000_000)


def own_size(spark, sf):
    """(work_id, own): the characters of each page, of some as if it were a very long one."""
    return read(spark, sf, "pages").select(F.col("page_id").alias("work_id"), (F.char_length("html").cast("long") * F.when(F.col("page_id") % 6 == 1, 50_000).otherwise(1)).alias("own"))


@query("asset_files", f""", {PARTS}, own AS (SELECT page_id AS work_id, CAST(length(html) * CASE WHEN page_id % 6 = 1 THEN 50000 ELSE 1 END AS BIGINT) AS own FROM pages),
  w AS (SELECT o.work_id, any_value(own) AS own, coalesce(sum(size), 0) AS size, min(p.code) AS code, coalesce(max(part), 0) AS n FROM own o LEFT JOIN parts p ON o.work_id = p.work_id GROUP BY o.work_id),
  s AS (SELECT *, own + size > 40000000 AS split FROM w),
  g AS (SELECT work_id, part, list(url ORDER BY url) AS urls FROM parts GROUP BY 1, 2),
  a AS (SELECT work_id, split, own, code, unnest(generate_series(0, CASE WHEN split THEN n ELSE 0 END)) AS n FROM s)
  SELECT a.work_id, CAST(a.n AS INT) AS n, 'works/' || lpad(CAST(a.work_id AS STRING), 6, '0') || CASE WHEN a.n > 0 THEN '.images-' || a.n ELSE '' END || '.json.gz' AS path,
    array_to_string(CASE WHEN NOT split THEN coalesce((SELECT list(url ORDER BY part, url) FROM parts p WHERE p.work_id = a.work_id), []) WHEN a.n = 0 THEN [] ELSE g.urls END, ' ') AS urls, CASE WHEN split THEN coalesce(code, CASE WHEN own > 40000000 THEN 'work-too-large' END) END AS code
  FROM a LEFT JOIN g ON a.work_id = g.work_id AND a.n = g.part""")
def asset_files(spark, sf):
    rows = own_size(spark, sf).join(im.split_parts(_refs(spark, sf), _inventory(spark, sf), 40_000_000), "work_id", "left")
    return im.asset_files(rows, 40_000_000).withColumn("urls", F.array_join("urls", " "))


@query("check_asset_rows", "SELECT work_id, url, problem FROM (SELECT work_id, url, CASE WHEN mime = 'image/bmp' THEN 'mime' WHEN width < 1 THEN 'size' WHEN NOT regexp_full_match(data, '([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?') OR data = '' THEN 'data' WHEN NOT regexp_full_match(p1, 'works/[0-9]{6}\\.images-[0-9]{1,4}\\.json\\.gz') OR substr(p1, 7, 6) <> work_id THEN 'part-name' WHEN p1 = p2 THEN 'part-repeated' END AS problem FROM ar) WHERE problem IS NOT NULL")
def check_asset_rows(spark, sf):
    ar = re.search(r"ar AS \((.*)\)\s*$", BASE, re.S)[1].replace("FROM rf", "FROM {rf}")
    rows = view(spark, ar, rf=_refs(spark, sf)).withColumn("parts", F.array("p1", "p2"))
    return im.check_asset_rows(rows)


PICTURES = """
SELECT page_id, 'https://library.example/i/' || CAST(page_id AS STRING) AS url,
  CASE page_id % 4 WHEN 0 THEN '89504E470D0A1A0A0000000D49484452' || lpad(hex(10 + page_id % 300), 8, '0') || lpad(hex(20 + page_id % 200), 8, '0') || '0806000000' || CASE WHEN page_id % 20 = 0 THEN '' ELSE '0000000049454E44AE426082' END
    WHEN 1 THEN '474946383961' || lpad(hex(1 + page_id % 200), 2, '0') || '00' || lpad(hex(1 + page_id % 100), 2, '0') || '000000003B'
    WHEN 2 THEN 'FFD8FFE00004AABB' || CASE WHEN page_id % 12 = 2 THEN 'FFC2' ELSE 'FFC0' END || '000B08' || lpad(hex(5 + page_id % 250), 4, '0') || lpad(hex(6 + page_id % 250), 4, '0') || '01011100FFD9' ELSE '00' END AS h
FROM {pages}
"""


@query("image_inventory", f""", pic AS ({PICTURES.format(pages="pages")}) SELECT url, sha256(unhex(h)) AS sha256, CAST(length(h) // 2 AS BIGINT) AS byte_length, CASE WHEN ok THEN mime END AS mime, CASE WHEN ok THEN w END AS width, CASE WHEN ok THEN hh END AS height, CASE WHEN NOT ok THEN 'invalid-image' END AS code FROM (
  SELECT url, h, CASE page_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/gif' ELSE 'image/jpeg' END AS mime, CAST(CASE page_id % 4 WHEN 0 THEN 10 + page_id % 300 WHEN 1 THEN 1 + page_id % 200 ELSE 6 + page_id % 250 END AS INT) AS w, CAST(CASE page_id % 4 WHEN 0 THEN 20 + page_id % 200 WHEN 1 THEN 1 + page_id % 100 ELSE 5 + page_id % 250 END AS INT) AS hh, page_id % 4 <> 3 AND page_id % 20 <> 0 AND page_id % 12 <> 2 AS ok FROM pic)""")
def image_inventory(spark, sf):
    pictures = view(spark, PICTURES, pages=read(spark, sf, "pages"))
    return readers.image_inventory(pictures.select("url", F.unhex("h").alias("content")))


def _files(batches):
    """Documents as files: pages in UTF-8, some with a stray byte, pages in Shift_JIS, and texts in zips, some with two."""
    for b in batches:
        ids, out = b.column("work_id").to_pylist(), []
        for i, text in zip(ids, b.column("text").to_pylist(), strict=True):
            raw = text.encode("cp932" if i % 7 in (3, 4) else "utf-8")
            if i % 7 in (4, 5, 6):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    for name in ("a.txt", "b.txt" if i % 7 == 6 else "b.bin"):
                        z.writestr(name, raw)
                raw = held.getvalue()
            out.append(raw + b"\xff" if i % 7 == 2 else raw)
        yield pa.RecordBatch.from_arrays([b.column("work_id"), pa.array(["text" if i % 7 > 3 else "xhtml" for i in ids]), pa.array(["ShiftJIS" if i % 7 in (3, 4) else "UTF-8" for i in ids]), pa.array(out, pa.binary())], names=["work_id", "path", "encoding", "content"])


@query("decode_bodies", "SELECT doc_id AS work_id, CASE WHEN doc_id % 7 > 3 THEN 'text' ELSE 'xhtml' END AS path, CASE WHEN doc_id % 7 NOT IN (2, 6) THEN sha256('底本' || regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '', 'g')) END AS sha256, CASE WHEN doc_id % 7 IN (2, 6) THEN 'decode-error' END AS error FROM documents")
def decode_bodies(spark, sf):
    text = F.concat(F.lit("底本"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x00-\\x7F]", ""))  # what both encodings can write
    files = read(spark, sf, "documents").select(F.col("doc_id").alias("work_id"), text.alias("text")).mapInArrow(_files, "work_id bigint, path string, encoding string, content binary")
    return readers.decode_bodies(files).select("work_id", "path", F.sha2("text", 256).alias("sha256"), "error")
