"""Queries of the sources and sinks: tables are written, read back and compared with SQL over what was written."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from vellum.operators import blocks as b
from vellum.operators import images, publish, runs
from vellum.plans.block_queries import BASE as BLOCK_BASE
from vellum.plans.block_queries import blocks_of
from vellum.plans.page_queries import BASE as PAGE_BASE
from vellum.plans.page_queries import PARTS, _inventory, _refs, own_size
from vellum.plans.run_queries import BASE as RUN_BASE
from vellum.plans.run_queries import Tables
from vellum.sources import readers
from vellum.sources.adapters import CATALOG, catalog_rows, catalog_tasks, oracle, read
from vellum.sources.scratch import fresh_folder, kept

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_columns = list(readers.LABELS.values())
RAW = f"WITH raw AS ({oracle(CATALOG, lineitem='lineitem', orders='orders')})"
BLOCKS_TOO = re.sub(r"\bat\b", '"at"', BLOCK_BASE.removeprefix("WITH "))
_record = [f.split()[0] for f in runs.RECORD.split(", ")]


def query(name: str, sql: str):
    def put(f):
        QUERIES[name] = f
        ORACLE[name] = sql
        return f

    return put


def _csv(spark, sf) -> str:
    """The derived catalog as official CSV files."""
    rows = catalog_rows(spark, sf)
    path = fresh_folder(spark)
    rows.select(*(F.col(name).alias(label) for label, name in readers.LABELS.items())).write.options(header=True, quote='"', escape='"', quoteAll=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, compression="lz4").csv(path)
    return path


@query("read_catalog_csv", f"{RAW} SELECT {', '.join(_columns)}, count(*) AS n FROM raw GROUP BY ALL")
def read_catalog_csv(spark, sf):
    """Equal rows are counted where their work's rows lie: side by side they shuffle as half of what they do when strewn."""
    rows = readers.read_catalog_csv(spark, _csv(spark, sf)).select(*_columns).repartition(catalog_tasks(spark, sf), "work_id")
    return rows.groupBy(*_columns).agg(F.count(F.lit(1)).alias("n"))


@query("check_header", f"{RAW} SELECT p.problem, p.\"column\", any_value(n) > 0 AS found FROM (SELECT count(*) AS n FROM raw), (VALUES ('missing', '副題'), ('missing', '原題'), ('repeated', '作品名'), ('new-column', '備考, \"特\"')) p(problem, \"column\") GROUP BY ALL")
def check_header(spark, sf):
    """Catalog files that lack two columns, repeat one and have a new one."""
    rows = catalog_rows(spark, sf)
    labels = {"副題": "作品名", "原題": '備考, "特"'}
    columns = [F.col(name).alias(labels.get(label, label)) for label, name in readers.LABELS.items()]
    path = fresh_folder(spark)
    quoted = F.concat_ws(",", *(F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns))
    head = ",".join('"' + labels.get(label, label).replace('"', '""') + '"' for label in readers.LABELS)
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # of its partition, which is a file
    rows.select(F.when(first, F.concat(F.lit(head + "\r\n"), quoted)).otherwise(quoted).alias("value")).write.text(path, compression="lz4")
    return readers.check_files(spark, path).groupBy("problem", "column").agg((F.count(F.lit(1)) > 0).alias("found"))


@query("write_run", f"{RUN_BASE} SELECT {', '.join(_record)} FROM cand")
def write_run(spark, sf):
    path = fresh_folder(spark)
    runs.write_run(Tables(spark, sf).cand, path)
    return spark.read.schema(runs.RECORD).parquet(path)


@query("write_assets", f"""{PAGE_BASE}, {BLOCKS_TOO} SELECT CAST(w.work_id AS STRING) AS work_id, n_blocks, coalesce(n, 0) AS n_images, urls FROM (SELECT work_id, count(*) AS n_blocks FROM cur GROUP BY work_id) w
  LEFT JOIN (SELECT work_id, count(*) AS n, string_agg(url, ' ' ORDER BY url) AS urls FROM rf JOIN inv USING (url) WHERE code IS NULL GROUP BY work_id) i USING (work_id)""")
def write_assets(spark, sf):
    path = fresh_folder(spark)
    works = b.work_json(b.block_ids(blocks_of(spark, sf))).select(F.col("work_id").cast("string").alias("work_id"), "json")
    good = _inventory(spark, sf).where("code IS NULL")
    pictures = _refs(spark, sf).join(good, "url").select(F.col("work_id").cast("string").alias("work_id"), "url", "mime", "width", "height", F.lit("QQ==").alias("data"))
    readers.write_assets(works, pictures, path)
    got = readers.read_assets(spark, path)
    n = F.size(F.from_json("work", b.WORK)["blocks"]).cast("long")
    return got.select("work_id", n.alias("n_blocks"), F.size("images").cast("long").alias("n_images"), F.nullif(F.array_join(F.transform("images", lambda i: i["url"]), " "), F.lit("")).alias("urls"))


@query("pack_assets", f"""{PAGE_BASE}, {PARTS}, own AS (SELECT page_id AS work_id, CAST(length(html) * CASE WHEN page_id % 6 = 1 THEN 50000 ELSE 1 END AS BIGINT) AS own FROM pages),
  w AS (SELECT o.work_id, any_value(own) AS own, coalesce(sum(size), 0) AS size, min(p.code) AS code, coalesce(max(part), 0) AS n FROM own o LEFT JOIN parts p ON o.work_id = p.work_id GROUP BY o.work_id),
  s AS (SELECT *, own + size > 40000000 AS split FROM w WHERE own + size <= 40000000 OR (code IS NULL AND own <= 40000000)),
  a AS (SELECT work_id, split, n AS parts, unnest(generate_series(0, CASE WHEN split THEN n ELSE 0 END)) AS n FROM s)
  SELECT work_id, CAST(n AS INT) AS n, CAST((SELECT count(*) FROM parts p WHERE p.work_id = a.work_id AND (NOT split OR p.part = a.n)) AS INT) AS images, CAST(CASE WHEN split AND n = 0 THEN parts ELSE 0 END AS INT) AS parts,
    CASE WHEN n = 0 THEN sha256(html) END AS work FROM a JOIN pages ON page_id = work_id""")
def pack_assets(spark, sf):
    """Files written as text, one line each, and read back; the documents are pages here."""
    pages = read(spark, sf, "pages").select(F.col("page_id").alias("work_id"), F.col("html").alias("json"))
    files = images.asset_files(own_size(spark, sf).join(images.split_parts(_refs(spark, sf), _inventory(spark, sf), 40_000_000), "work_id", "left"), 40_000_000)
    pictures = _refs(spark, sf).join(_inventory(spark, sf).where("code IS NULL"), "url").select("work_id", "url", "mime", "width", "height", F.lit("QQ==").alias("data"))
    path = fresh_folder(spark)
    readers.pack_assets(pages, files, pictures).select("work_id", "n", "value").write.parquet(path)
    got = spark.read.parquet(path).withColumn("r", F.from_json("value", f"format int, work string, images array<{readers.ENTRY}>, imageParts array<string>"))
    return got.select("work_id", "n", F.size("r.images").alias("images"), F.coalesce(F.size("r.imageParts"), F.lit(0)).alias("parts"), F.sha2("r.work", 256).alias("work"))


_told = "CASE code " + " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in publish.MESSAGES.items()) + " END"


@query("asset_results", f"""{PAGE_BASE}, {PARTS}, own AS (SELECT page_id AS work_id, CAST(length(html) * CASE WHEN page_id % 6 = 1 THEN 50000 ELSE 1 END AS BIGINT) AS own FROM pages),
  w AS (SELECT o.work_id, any_value(own) AS own, coalesce(sum(size), 0) AS size, min(p.code) AS code, coalesce(max(part), 0) AS n FROM own o LEFT JOIN parts p ON o.work_id = p.work_id GROUP BY o.work_id),
  s AS (SELECT *, own + size > 40000000 AS split FROM w),
  b AS (SELECT work_id, CASE WHEN f IS NOT NULL THEN f.code WHEN bytes > 70000000 THEN 'images-too-large' END AS code, f.url AS url FROM (SELECT work_id, sum(byte_length) FILTER (code IS NULL) AS bytes, min({{'url': rf.url, 'code': code}}) FILTER (code IS NOT NULL) AS f FROM rf JOIN inv USING (url) GROUP BY work_id)),
  bad AS (SELECT * FROM (SELECT s.work_id, coalesce(b.code, CASE WHEN split THEN coalesce(s.code, CASE WHEN own > 40000000 THEN 'work-too-large' END) END) AS code, CASE WHEN b.code IS NOT NULL THEN b.url END AS url FROM s LEFT JOIN b USING (work_id)) WHERE code IS NOT NULL),
  a AS (SELECT work_id, split, unnest(generate_series(0, CASE WHEN split THEN n ELSE 0 END)) AS n FROM s WHERE work_id NOT IN (SELECT work_id FROM bad))
  SELECT work_id, 'works/' || lpad(CAST(work_id AS STRING), 6, '0') || CASE WHEN n > 0 THEN '.images-' || n ELSE '' END || '.json.gz' AS path, CAST((SELECT count(*) FROM parts p WHERE p.work_id = a.work_id AND (NOT split OR p.part = a.n)) AS INT) AS images, true AS stored, NULL AS code, NULL AS message, NULL AS url FROM a
  UNION ALL SELECT work_id, NULL, NULL, NULL, code, {_told}, url FROM bad""")
def asset_results(spark, sf):
    """Pages with their pictures, written as a release's compressed files, and what is told of each file and failed work."""
    pages, refs, known, root = read(spark, sf, "pages").select(F.col("page_id").alias("work_id"), F.col("html").alias("json")), _refs(spark, sf), _inventory(spark, sf), fresh_folder(spark)
    files = kept(images.asset_files(own_size(spark, sf).join(images.split_parts(refs, known, 40_000_000), "work_id", "left"), 40_000_000))
    failed = kept(publish.failed_works(images.image_budget(refs, known, 70_000_000), files))
    pictures = refs.join(known.where("code IS NULL"), "url").select("work_id", "url", "mime", "width", "height", F.lit("QQ==").alias("data"))
    attempt = publish.stage_assets(readers.pack_assets(pages, files.join(failed.select("work_id"), "work_id", "left_anti"), pictures), root)
    got = publish.asset_results(publish.staged_files(spark, root, attempt), files, failed)
    stored = (F.col("bytes") > 0) & (F.char_length("sha256") == 64)
    return got.select("work_id", "path", "images", stored.alias("stored"), "code", "message", "url")
