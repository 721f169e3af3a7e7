"""What a run can reuse, what a fetch leads to, what may be committed, and how two runs differ.

Records are flat rows: work_id, path, url, updated, input_sha256, raw_sha256, converter, status, code, work_sha256,
work_bytes, and for releases flag, title, author. All joins are on work_id, so tables bucketed by it (state.py) join
without an exchange.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RECORD = "work_id string, path string, url string, updated string, input_sha256 string, raw_sha256 string, converter string, status string, code string, work_sha256 string, work_bytes bigint"
PATHS = {"xhtml": 0, "text": 1}
#: What a record keeps besides: sources that failed before, and what a conversion left out.
DETAILS = "attempts array<struct<path:string,url:string,code:string,message:string,location:string>>, diagnostics array<struct<code:string,message:string,location:string>>"
#: The kinds of diagnostics.
DIAGNOSTICS = ("active-content-removed", "attribute-dropped", "link-removed", "section-ignored")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def input_hash(*fields: Column) -> Column:
    """The digest of all conversion inputs in a fixed order; nulls are left out as absent keys are."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def read_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed records from JSON texts, with attempts and diagnostics.

    A record that lacks a field it needs, or has one of another type, is absent, and so is one with an attempt or, if it
    is converted, a diagnostic that can't be read whole. A failed record has no diagnostics."""
    r = F.from_json(column, f"{RECORD}, {DETAILS}", {"mode": "PERMISSIVE"})
    needed = [F.col(c).isNotNull() for c in ("work_id", "path", "url", "updated", "input_sha256", "converter", "status")]
    sound = lambda c, one: F.coalesce(F.forall(c, one), F.lit(False))
    attempts = sound("attempts", lambda x: x["path"].isin(*PATHS) & x["url"].isNotNull() & x["code"].isNotNull() & x["message"].isNotNull())
    diagnostics = sound("diagnostics", lambda x: x["code"].isin(*DIAGNOSTICS) & x["message"].isNotNull() & x["location"].isNotNull())
    converted = (F.col("status") == "converted") & F.col("work_sha256").isNotNull() & F.col("work_bytes").isNotNull() & diagnostics
    failed = (F.col("status") == "failed") & F.col("code").isNotNull()
    rows = lines.select(r.alias("r")).select("r.*").where((converted | failed) & attempts)
    for condition in needed:
        rows = rows.where(condition)
    return rows.withColumn("diagnostics", F.when(F.col("status") == "converted", F.col("diagnostics")))


def read_manifest(records: DataFrame, counts: DataFrame, version: int = 1) -> DataFrame:
    """One row: whether a manifest holds; its version, counts and the uniqueness of IDs are computed again.

    counts: one row (schema_version, total, converted, failed)."""
    real = records.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "converted").alias("c"), F.count_if(F.col("status") == "failed").alias("f"), F.count_distinct("work_id").alias("ids"))
    checks = F.coalesce(F.when(F.col("schema_version") != version, "version"), F.when((F.col("n") != F.col("total")) | (F.col("c") != F.col("converted")) | (F.col("f") != F.col("failed")), "counts"), F.when(F.col("ids") != F.col("n"), "repeated-id"), F.lit("valid"))
    return counts.crossJoin(real).select(checks.alias("outcome"), "total", "converted", "failed")  # a row each


def _sources(previous: DataFrame) -> DataFrame:
    """(work_id, old): the converted records of each work, gathered by work_id alone, so that tables bucketed by it need no
    exchange."""
    fields = F.struct("path", "url", "input_sha256", "converter", "raw_sha256")
    return previous.where("status = 'converted'").groupBy("work_id").agg(F.array_sort(F.collect_list(fields)).alias("old"))


def reuse_previous(targets: DataFrame, previous: DataFrame, intact: DataFrame, revalidate: bool = False) -> DataFrame:
    """(work_id, path, decision): ``reuse`` where inputs and converter are as in the last run and the artifact is whole."""
    joined = targets.join(_sources(previous), "work_id", "left").join(intact.select("work_id", F.lit(True).alias("intact")), "work_id", "left")
    joined = joined.withColumn("o", F.get(F.filter("old", lambda o: (o["path"] == F.col("path")) & (o["url"] == F.col("url"))), F.lit(0)))
    same = (F.col("input_sha256") == F.col("o.input_sha256")) & (F.col("converter") == F.col("o.converter")) & F.coalesce("intact", F.lit(False)) & F.lit(not revalidate)
    return joined.select("work_id", "path", F.when(F.coalesce(same, F.lit(False)), "reuse").when(F.col("o.raw_sha256").isNotNull(), "revalidate").otherwise("fetch").alias("decision"))


def fetch_outcome(fetched: DataFrame, targets: DataFrame, previous: DataFrame) -> DataFrame:
    """(work_id, path, outcome) of each fetched path: fetch-status, not-modified, unchanged, a conversion fault, or converted."""
    now = targets.select("work_id", "input_sha256", "converter")
    j = fetched.join(now, "work_id").join(_sources(previous), "work_id", "left").withColumn("o", F.get(F.filter("old", lambda o: o["path"] == F.col("path")), F.lit(0)))
    same = F.coalesce((F.col("input_sha256") == F.col("o.input_sha256")) & (F.col("converter") == F.col("o.converter")), F.lit(False))
    kept = F.col("o.raw_sha256").isNotNull()
    outcome = (
        F.when((F.col("http") == 304) & ~kept, "fetch-status").when((F.col("http") == 304) & same, "not-modified").when(~F.col("http").isin(200, 304), "fetch-status")
        .when((F.col("http") == 200) & kept & same & (F.col("body_sha256") == F.col("o.raw_sha256")), "unchanged").when(F.col("convert_code").isNotNull(), F.col("convert_code")).otherwise("converted")
    )
    return j.select("work_id", "path", outcome.alias("outcome"))


def pending_targets(targets: DataFrame, records: DataFrame, intact: DataFrame) -> DataFrame:
    """Targets without a record that stands: a converted one with a whole artifact, or a failure that isn't of fetching."""
    stands = records.join(intact.select("work_id", F.lit(True).alias("intact")), "work_id", "left").where("(status = 'converted' AND coalesce(intact, false)) OR (status = 'failed' AND NOT startswith(code, 'fetch-'))")
    return targets.join(stands.select("work_id"), "work_id", "left_anti")


GOOD = ("not-modified", "unchanged", "converted")


def pick_source(outcomes: DataFrame) -> DataFrame:
    """(work_id, path, outcome, attempts): the first usable path, pages before texts, with the earlier ones' faults."""
    rank = F.coalesce(*(F.when(F.col("path") == p, n) for p, n in PATHS.items()), F.lit(9))
    ranked = outcomes.withColumn("rank", rank).withColumn("good", F.col("outcome").isin(*GOOD))
    best = ranked.groupBy("work_id").agg(F.min(F.when(F.col("good"), F.struct("rank", "path", "outcome"))).alias("b"), F.array_sort(F.collect_list(F.when(~F.col("good"), F.struct("rank", "path", "outcome")))).alias("bad"))
    earlier = F.filter("bad", lambda x: F.col("b").isNull() | (x["rank"] < F.col("b")["rank"]))
    return best.select("work_id", F.col("b")["path"].alias("path"), F.coalesce(F.col("b")["outcome"], F.lit("failed")).alias("outcome"), F.array_join(F.transform(earlier, lambda x: F.concat_ws(":", x["path"], x["outcome"])), ",").alias("attempts"))


def verify_artifacts(records: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(work_id, problem): converted records whose artifact is missing or of another size or digest.

    artifacts: (work_id, text)."""
    held = artifacts.select("work_id", F.octet_length("text").cast("long").alias("bytes"), content_hash(F.col("text")).alias("sha256"))
    j = records.where("status = 'converted'").join(held, "work_id", "left")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("bytes") != F.col("work_bytes"), "size").when(F.col("sha256") != F.col("work_sha256"), "digest")
    return j.select("work_id", problem.alias("problem")).where("problem IS NOT NULL")


def manifest_counts(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "converted").alias("converted"), F.count_if(F.col("status") == "failed").alias("failed"))


def run_stats(decisions: DataFrame, outcomes: DataFrame, targets: DataFrame, pending: DataFrame) -> DataFrame:
    """One row of counts over what was reused, what fetching gave, and what stood from a run that was cut off.

    targets, pending: (work_id); see pending_targets."""
    d = decisions.agg(F.count_if(F.col("decision") == "reuse").alias("catalog_unchanged"), F.count_if(F.col("decision") != "reuse").alias("requests"))
    o = outcomes.agg(F.count_if(F.col("outcome") == "not-modified").alias("not_modified"), F.count_if(F.col("outcome") == "unchanged").alias("content_unchanged"), F.count_if(F.col("outcome") == "converted").alias("fetched"))
    left = targets.agg(F.count(F.lit(1)).alias("all")).crossJoin(pending.agg(F.count(F.lit(1)).alias("left"))).select((F.col("all") - F.col("left")).alias("resumed"))
    return d.crossJoin(o).crossJoin(left)  # a row each


def run_key(records: DataFrame, converter: str, revalidate: bool = False) -> DataFrame:
    """One row: the digest of converter, flag and all inputs by ID.

    Digests are taken in three levels, of buckets by the first four, two and no digits of the ID's hash, so that no task
    holds more than 65,536th of all IDs, and the last one 256 digests."""
    digest = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256).alias("h")
    part = records.groupBy(F.substring(F.sha2("work_id", 256), 1, 4).alias("b")).agg(digest(F.concat_ws("=", "work_id", "path", "input_sha256")))
    more = part.groupBy(F.substring("b", 1, 2).alias("b")).agg(digest(F.concat_ws("=", "b", "h")))
    whole = more.agg(digest(F.concat_ws("=", "b", "h")))
    return whole.select(F.sha2(F.concat_ws("\n", F.lit(converter), F.lit(str(revalidate).lower()), "h"), 256).alias("run_key"))


def commit_gate(records: DataFrame, problems: DataFrame, pending: DataFrame, most_failed: float = 0.02) -> DataFrame:
    """One row: ok, or why a run can't be committed."""
    one = manifest_counts(records).crossJoin(problems.agg(F.count(F.lit(1)).alias("problems"))).crossJoin(pending.agg(F.count(F.lit(1)).alias("pending")))
    outcome = F.when(F.col("pending") > 0, "unfinished").when(F.col("problems") > 0, "integrity").when(F.col("total") == 0, "empty").when(F.col("failed") / F.col("total") > most_failed, "too-many-failed").otherwise("ok")
    return one.select("total", "failed", "problems", "pending", outcome.alias("outcome"))


def first_failure(faults: DataFrame, messages: Mapping[str, str] | None = None) -> DataFrame:
    """(work_id, line, column, code, message): a work's first fault by place. faults: (work_id, line, column, code); a
    code without message gives its own name."""
    first = faults.groupBy("work_id").agg(F.min(F.struct("line", "column", "code")).alias("f"))
    message = F.coalesce(*(F.when(F.col("f.code") == k, v) for k, v in (messages or {}).items()), F.col("f.code"))
    return first.select("work_id", "f.line", "f.column", "f.code", message.alias("message"))


def attempt_report(picked: DataFrame) -> DataFrame:
    """(path, code, works): failed attempts over all works."""
    each = picked.where("attempts <> ''").select(F.explode(F.split("attempts", ",")).alias("a"))
    return each.groupBy(F.substring_index("a", ":", 1).alias("path"), F.substring_index("a", ":", -1).alias("code")).agg(F.count(F.lit(1)).alias("works"))


def provenance_lock(records: DataFrame, converter: str, schema_version: int = 1) -> DataFrame:
    """One row per source of a candidate, with the run's versions, counts and key."""
    whole = manifest_counts(records).crossJoin(run_key(records, converter))
    return records.where("status = 'converted'").select("work_id", "url", "raw_sha256", "updated").crossJoin(F.broadcast(whole)).withColumn("converter", F.lit(converter)).withColumn("schema_version", F.lit(schema_version))


def frozen_input_check(lock: DataFrame, fetched: DataFrame) -> DataFrame:
    """(work_id, problem): where inputs fetched again aren't those of the lock. Both: (work_id, raw_sha256)."""
    j = lock.select("work_id", F.col("raw_sha256").alias("a"), F.lit(True).alias("locked")).join(fetched.select("work_id", F.col("raw_sha256").alias("b"), F.lit(True).alias("there")), "work_id", "full")
    problem = F.when(F.col("there").isNull(), "missing").when(F.col("locked").isNull(), "extra").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return j.select("work_id", problem.alias("problem")).where("problem IS NOT NULL")


def write_run(records: DataFrame, path: str) -> None:
    """Records as Parquet in ID order, columns fixed and no clock values: the same records give the same rows in order."""
    records.select(*(f.split()[0] for f in RECORD.split(", "))).repartitionByRange(F.col("work_id")).sortWithinPartitions("work_id").write.mode("overwrite").parquet(path)


def latest(records: DataFrame) -> DataFrame:
    """The last record of each work where runs are kept in one table with run_no."""
    w = Window.partitionBy("work_id").orderBy(F.desc("run_no"))
    return records.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
