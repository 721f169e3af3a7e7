"""The jobs' inputs, derived from the driver's tables by SQL that Spark and DuckDB both run.

Each entry is a SELECT over names in braces: Spark fills them with DataFrames, an oracle with table names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CATALOG = """
SELECT row_no,
  CASE WHEN k % 211 = 5 THEN 'W' || lpad(CAST(k AS STRING), 5, '0') ELSE lpad(CAST(k AS STRING), 6, '0') END AS work_id,
  CASE WHEN k % 131 = 7 THEN ' ' WHEN k % 127 = 9 AND row_no = 2 THEN 'Other' ELSE ' Work ' || CAST(k % 5000 AS STRING) || '　' END AS title,
  'work ' || CAST(k % 5000 AS STRING) AS title_reading,
  'work ' || lpad(CAST(k % 5000 AS STRING), 4, '0') AS sort_reading,
  CASE WHEN k % 6 = 0 THEN 'Part ' || CAST(k % 9 AS STRING) ELSE '' END AS subtitle,
  CASE WHEN k % 12 = 0 THEN 'part ' || CAST(k % 9 AS STRING) ELSE '' END AS subtitle_reading,
  '' AS original_title,
  CASE WHEN k % 5 = 0 THEN 'Monthly' ELSE '' END AS first_publication,
  CASE WHEN k % 4 = 0 THEN '' ELSE 'NDC ' || CAST(900 + k % 20 AS STRING) END AS classification,
  CASE WHEN k % 137 = 11 THEN '' WHEN k % 3 = 0 THEN '旧字旧仮名' ELSE '新字新仮名' END AS orthography,
  CASE WHEN pr LIKE '1%' THEN 'あり' WHEN k % 149 = 2 THEN '不明' ELSE 'なし' END AS work_copyright,
  CASE WHEN k % 139 = 1 THEN '2025-02-31' ELSE d END AS published,
  CASE WHEN k % 151 = 4 THEN '20250101' ELSE d END AS updated,
  CASE WHEN k % 163 = 8 THEN 'https://elsewhere.example' ELSE 'https://library.example' END || '/cards/' || CASE WHEN k % 157 = 6 THEN '000000' ELSE person END || '/card' || CAST(k AS STRING) || '.html' AS card_url,
  CASE WHEN k % 10 = 1 THEN '' WHEN k % 10 = 2 THEN 'https://elsewhere.example/x.zip' ELSE 'https://library.example/cards/' || person || '/files/' || CAST(k AS STRING) || '_ruby_1.zip' END AS text_url,
  CASE WHEN k % 14 = 3 THEN 'soon' ELSE d END AS text_updated,
  CASE WHEN k % 9 = 4 THEN 'EUC' ELSE 'ShiftJIS' END AS text_encoding,
  CASE WHEN k % 4 = 1 THEN '' ELSE 'https://library.example/cards/' || person || '/files/' || CAST(CASE WHEN k % 23 = 5 THEN k + 1 ELSE k END AS STRING) || '_1.html' END AS xhtml_url,
  d AS xhtml_updated, 'ShiftJIS' AS xhtml_encoding,
  CASE WHEN k % 167 = 10 THEN 'p1' ELSE lpad(CAST(p AS STRING), 6, '0') END AS person_id,
  'Sur' || CAST(p % 50 AS STRING) AS surname,
  CASE WHEN k % 5 = 3 AND row_no % 2 = 0 THEN 'Alt' ELSE 'Given' END || CAST(p AS STRING) AS given,
  'sur' || CAST(p % 50 AS STRING) AS surname_reading,
  'given' || CAST(p AS STRING) AS given_reading,
  CASE WHEN k % 179 = 13 AND row_no = 1 THEN '朗読者' ELSE CASE (p + k + CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END) % 5 WHEN 0 THEN '著者' WHEN 1 THEN '翻訳者' WHEN 2 THEN '編者' WHEN 3 THEN '校訂者' ELSE 'その他' END END AS role,
  CASE WHEN p % 17 = 3 THEN 'あり' ELSE 'なし' END AS person_copyright
FROM (
  SELECT *, lpad(CAST(min(p) OVER (PARTITION BY k) AS STRING), 6, '0') AS person FROM (
    SELECT row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_no,
      l_orderkey AS k, l_suppkey AS p, l_linenumber AS n, o_orderpriority AS pr, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d
    FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey) a) b
"""

#: The state of a run over documents: one record per work.
PREVIOUS = """
SELECT lpad(CAST(doc_id AS STRING), 6, '0') AS work_id, CASE WHEN doc_id % 3 = 0 THEN 'text' ELSE 'xhtml' END AS path,
  'https://library.example/b/' || CAST(doc_id AS STRING) AS url, '2025-01-01' AS updated,
  md5('in' || CAST(doc_id AS STRING)) AS input_sha256, md5(coalesce(text, '')) AS raw_sha256, 'v1' AS converter,
  CASE WHEN doc_id % 17 = 3 THEN 'failed' ELSE 'converted' END AS status,
  CASE WHEN doc_id % 17 = 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'fetch-status' ELSE 'unknown-notation' END END AS code,
  CASE WHEN doc_id % 17 = 3 THEN NULL ELSE md5('work' || coalesce(text, '')) END AS work_sha256, CAST(length(coalesce(text, '')) AS BIGINT) AS work_bytes,
  'なし' AS flag, 'Title ' || CAST(doc_id AS STRING) AS title, source AS author
FROM {documents}
"""

#: The next run: works gone, edited, protected, newly failed and new.
CANDIDATE = """
SELECT lpad(CAST(doc_id AS STRING), 6, '0') AS work_id, CASE WHEN doc_id % 3 = 0 THEN 'text' ELSE 'xhtml' END AS path,
  'https://library.example/b/' || CAST(doc_id AS STRING) AS url, CASE WHEN doc_id % 5 = 0 THEN '2025-02-01' ELSE '2025-01-01' END AS updated,
  md5('in' || CASE WHEN doc_id % 19 = 2 THEN 'new' ELSE '' END || CAST(doc_id AS STRING)) AS input_sha256,
  md5(coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS raw_sha256, CASE WHEN doc_id % 29 = 1 THEN 'v2' ELSE 'v1' END AS converter,
  CASE WHEN doc_id % 23 = 4 THEN 'failed' ELSE 'converted' END AS status,
  CASE WHEN doc_id % 23 = 4 THEN CASE WHEN doc_id % 3 = 0 THEN 'fetch-status' ELSE 'decode-error' END END AS code,
  CASE WHEN doc_id % 23 = 4 THEN NULL ELSE md5('work' || coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) END AS work_sha256,
  CAST(length(coalesce(text, '')) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS work_bytes,
  CASE WHEN doc_id % 13 = 0 THEN 'あり' ELSE 'なし' END AS flag, 'Title ' || CAST(doc_id AS STRING) AS title, source AS author
FROM {documents} WHERE doc_id % 11 <> 0
UNION ALL
SELECT 'N' || lpad(CAST(doc_id AS STRING), 5, '0'), 'xhtml', 'https://library.example/n/' || CAST(doc_id AS STRING), '2025-02-01', md5('n'), md5('n' || coalesce(text, '')), 'v1',
  'converted', NULL, md5('n'), CAST(7 AS BIGINT), 'なし', 'New ' || CAST(doc_id AS STRING), source
FROM {documents} WHERE doc_id % 31 = 6
"""

#: What fetching each path of a candidate gave.
FETCHED = """
SELECT lpad(CAST(doc_id AS STRING), 6, '0') AS work_id, path,
  CASE WHEN doc_id % 6 = 1 THEN 304 WHEN doc_id % 37 = 9 AND path = 'xhtml' THEN 404 ELSE 200 END AS http,
  CASE WHEN doc_id % 6 = 1 THEN NULL ELSE md5(coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) END AS body_sha256,
  CASE WHEN doc_id % 41 = 5 AND path = 'xhtml' THEN 'unknown-notation' WHEN doc_id % 43 = 7 THEN 'decode-error' END AS convert_code
FROM {documents} CROSS JOIN (SELECT 'xhtml' AS path UNION ALL SELECT 'text' AS path) p
WHERE doc_id % 11 <> 0
"""

#: Blocks of a work: its lines; every fifth work has some as headings, figures or breaks.
BLOCKS = """
SELECT doc_id AS work_id, CAST(no AS INT) AS block_no, CASE WHEN doc_id % 5 = 0 AND no % 7 = 3 THEN 'heading' WHEN no % 11 = 5 THEN 'figure' WHEN no % 13 = 6 THEN 'pageBreak' ELSE 'paragraph' END AS kind,
  CASE WHEN no % 11 <> 5 THEN NULL ELSE 'https://library.example/i/' || CAST(no AS STRING) || '.png' END AS url,
  CASE WHEN no % 13 = 6 AND no % 11 <> 5 AND NOT (doc_id % 5 = 0 AND no % 7 = 3) THEN '' WHEN no % 4 = 1 THEN '' ELSE line END AS text
FROM {lines}
"""

#: The same blocks after a revision: every work's second block is new, every ninth is edited.
REVISED = """
SELECT work_id, CAST(CASE WHEN block_no >= 1 THEN block_no + 1 ELSE block_no END AS INT) AS block_no, kind, url, CASE WHEN block_no % 9 = 2 THEN substr(text, 1, 40) || 'edit' || substr(text, 41) ELSE text END AS text FROM {blocks}
UNION ALL SELECT DISTINCT work_id, CAST(1 AS INT), 'paragraph', CAST(NULL AS STRING), 'A line that the revision has put in.' FROM {blocks}
"""

#: Image references of works, from the links of pages; every page refers to up to three shared pictures and some wrong URLs too.
IMAGE_REFS = """
SELECT DISTINCT page_id AS work_id, url FROM (
  SELECT page_id, 'https://library.example/cards/' || lpad(CAST(page_id % 97 AS STRING), 6, '0') || '/files' || href || '.png' AS url FROM (SELECT page_id, explode(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM {pages}) h
  UNION ALL SELECT page_id, 'https://library.example/cards/' || lpad(CAST(page_id % 97 AS STRING), 6, '0') || '/files/fig' || CAST(n AS STRING) || '.png' FROM {pages} CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3) a
  UNION ALL SELECT page_id, 'https://library.example/gaiji/1-0' || CAST(n AS STRING) || '/1-0' || CAST(n AS STRING) || '-0' || CAST(page_id % 5 + 1 AS STRING) || '.png' FROM {pages} CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2) b
  UNION ALL SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'https://elsewhere.example/a.png' WHEN 1 THEN 'https://library.example/a/../b.png' WHEN 2 THEN 'https://library.example/gaiji/a.png?x=1' WHEN 3 THEN 'https://libraryXexample/gaiji/a.png' WHEN 4 THEN 'https://library.example/gaiji/./a.png' WHEN 5 THEN 'https://library.example/gaiji/.png' WHEN 6 THEN 'https://library.example/cards/000001/files/b/a.gif' ELSE url END FROM {pages}) u
"""

#: What is known of each picture: a size from its URL's hash, and some faults.
INVENTORY = """
SELECT url, md5(url) AS sha256, CAST(100000 + length(url) * 7919 % 997 * 30000 AS BIGINT) AS byte_length, 'image/png' AS mime, CAST(10 + length(url) % 90 AS INT) AS width, CAST(20 + length(url) % 70 AS INT) AS height,
  CASE WHEN url LIKE '%fig3%' AND url LIKE '%7/files%' THEN 'invalid-image' WHEN url LIKE '%/../%' THEN 'invalid-url' END AS code
FROM (SELECT DISTINCT url FROM {refs}) d
"""


#: Catalog rows of a task: each is about 800 bytes, made of some 20.
ROWS_A_TASK = 250_000


def view(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    return spark.sql(sql, **frames)


def oracle(sql: str, **names: str) -> str:
    return sql.format(**names).replace("explode(", "unnest(")  # the one word that differs


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog_tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks the catalog's rows are dealt to, by their number and not by the bytes that they are made of."""
    return max(spark.sparkContext.defaultParallelism, -(-read(spark, sf_dir, "lineitem").count() // ROWS_A_TASK))


def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CATALOG's rows. Join and window share one exchange, of as many tasks as the wide rows ask for."""
    n = catalog_tasks(spark, sf_dir)
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").repartition(n, "l_orderkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate").repartition(n, "o_orderkey")
    return view(spark, CATALOG, lineitem=lines, orders=orders)


#: Lines with notes of every kind, right and wrong ones, before, after or in place of what is there.
MARKED = """
SELECT doc_id AS work_id, no, CASE (doc_id + no) % 41
  WHEN 0 THEN '漢字《かんじ》' || line WHEN 1 THEN line || '｜base《よみ》 tail' WHEN 2 THEN line || ' word《reading》 x' WHEN 3 THEN '※［＃「木＋吶」、第3水準1-85-54］' || line
  WHEN 4 THEN line || 'a※［＃「x」、U+5433、12-3］' WHEN 5 THEN '※［＃「y」、12-3］' WHEN 6 THEN line || 'abc［＃「abc」に傍点］' WHEN 7 THEN '［＃左に傍線］' || line || 'mid［＃左に傍線終わり］' WHEN 8 THEN line || '。［＃「xyz」の左に丸傍点］' WHEN 9 THEN '［＃太字］bold［＃太字終わり］' || line
  WHEN 10 THEN line || '12［＃「12」は縦中横］' WHEN 11 THEN '［＃３字下げ］見出し［＃「見出し」は大見出し］' WHEN 12 THEN '［＃改ページ］' WHEN 13 THEN '［＃ここから２字下げ］' WHEN 14 THEN CASE WHEN doc_id % 3 = 0 THEN '［＃３字下げ］' || line ELSE '［＃ここで字下げ終わり］' END WHEN 15 THEN '［＃地から１字上げ］' || line
  WHEN 16 THEN '［＃挿絵（fig1.png、横100×縦200）入る］' WHEN 17 THEN CASE WHEN doc_id % 2 = 0 THEN '［＃キャプション］' || line || '［＃キャプション終わり］' ELSE line || '図の説明［＃「図の説明」はキャプション］' END WHEN 18 THEN line || '語［＃「語」は底本では「ゴ」］' WHEN 19 THEN line || '［＃謎の注記］' WHEN 20 THEN '《よみ》 lone' || line WHEN 21 THEN line || 'not closed［＃ open'
  WHEN 22 THEN '［＃ここから地付き］' WHEN 23 THEN '［＃ここで地付き終わり］' WHEN 24 THEN '［＃太字］［＃傍点］' || line || 'in［＃傍点終わり］［＃太字終わり］' WHEN 25 THEN '［＃太字］bad' || line || '［＃傍点終わり］' WHEN 26 THEN '' WHEN 27 THEN '※［＃「z」、第4水準1-2-3］' || line || '〔cafe´〕' WHEN 28 THEN '𠮷' || line || '𠮷abc［＃「abc」に傍点］𠮷《よし》'
  WHEN 29 THEN '［＃中見出し］' || line || 'x［＃中見出し終わり］　' WHEN 30 THEN '［＃小見出し］𠮷' || line WHEN 31 THEN '𠮷［＃謎の注記］ tail 《よみ》' WHEN 32 THEN '［＃大見出し］head［＃大見出し終わり］ rest' WHEN 33 THEN '𠮷［＃太字］in［＃傍点終わり］' || line WHEN 34 THEN '［＃２字下げ］［＃地付き］' || line
  WHEN 35 THEN line || 'ends［＃「ends」は小見出し］' WHEN 36 THEN '［＃太字］［＃太字終わり］' || line WHEN 37 THEN '［＃キャプション］' || line WHEN 38 THEN '［＃５字下げ］' ELSE line END AS line
FROM {lines}
"""

#: The same lines as whole texts: a header between dash lines, and a bibliography after the last line; some works lack a part.
WHOLE = """
SELECT work_id, CAST(no + 6 AS INT) AS no, line FROM {marked}
UNION ALL SELECT doc_id, CAST(i AS INT), CASE i WHEN 0 THEN 'Title' WHEN 1 THEN 'Author' WHEN 2 THEN '' WHEN 3 THEN '-----------------------' WHEN 4 THEN CASE WHEN doc_id % 19 = 3 THEN 'x' ELSE '【テキスト中に現れる記号について】' END ELSE CASE WHEN doc_id % 23 = 4 THEN '' ELSE '-------------------------' END END
FROM {documents} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) h
UNION ALL SELECT doc_id, CAST(last + 7 + i AS INT), CASE i WHEN 0 THEN CASE WHEN doc_id % 17 = 5 THEN '［＃本文終わり］' ELSE '' END WHEN 1 THEN CASE WHEN doc_id % 29 = 7 THEN '' ELSE '底本：「Collected」  ' END WHEN 2 THEN CASE WHEN doc_id % 31 = 8 THEN '底本：again' ELSE '入力：someone' END ELSE ' ' END
FROM {documents} JOIN (SELECT work_id, max(no) AS last FROM {marked} GROUP BY work_id) l ON doc_id = work_id CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) f
"""


#: Pages with ruby, pictures, marks and active content put in at fixed places.
MARKUP = """
SELECT page_id, replace(replace(html, '<article>', '<article>' || CASE page_id % 8
  WHEN 0 THEN '<div class="jisage_3"><ruby><rb>base</rb><rp>(</rp><rt>reading</rt><rp>)</rp></ruby></div>' WHEN 1 THEN '<em class="sesame_dot_after">mark</em><em class="underline_solid">line</em><span class="futoji">bold</span><ruby><rb>two</rb><rb>bases</rb><rt>x</rt></ruby>'
  WHEN 2 THEN '<img class="gaiji" src="https://library.example/gaiji/1-85/1-85-54.png" alt="glyph"><img class="illustration" src="https://library.example/cards/000001/files/fig1.png" alt="a" width="100" height="2x">'
  WHEN 3 THEN '<h3 class="o-midashi">head</h3><span class="dai2">big</span><span class="odd">odd</span><img src="https://elsewhere.example/a.png" alt="b" width="10" height="20">' WHEN 4 THEN '<form><input value="text"><button onclick="go()">press</button></form><a href="JavaScript:run()">x</a>'
  WHEN 5 THEN '<RUBY class="r"><rb lang="ja">Base</rb><RT>read</RT></RUBY><ruby ><rb> </rb><rt>x</rt></ruby><a title="a > b" href=''javascript:go()'' onclick=go()>y</a>' WHEN 6 THEN '<img src=https://library.example/cards/000001/files/fig2.gif alt=''c'' width=20000 height=10><img src=''https://library.example/cards/000001/files/fig3.jpg'' width=10000 height=10 hidden><a href=" java' || chr(9) || 'script:x" data-on="1">z</a>'
  ELSE '<svg/onload=go()><input disabled value=''text''>' END),
  '</article>', CASE WHEN page_id % 7 = 3 THEN '</article>loose' WHEN page_id % 11 = 4 THEN '</article><article>again</article>' WHEN page_id % 13 = 5 THEN '</article><aside>more</aside>'
    WHEN page_id % 5 = 2 THEN '<nav>side<div>deep</div><p>list</p></nav><p>after the list</p><div class="ad">buy<div>now</div>more</div><div><p>last</p></div></article>' WHEN page_id % 17 = 9 THEN '<nav>open<p>still</p></article>' ELSE '</article>' END) AS html
FROM {pages}
"""
