"""Frequent keys and spread joins; runs stored in buckets."""

import os
import random

import pytest
from pyspark.sql import functions as F

from vellum.functions.skew import frequent_keys, hot_keys, spread_join
from vellum.operators import images, runs, state


@pytest.fixture
def plain(spark):
    """No adaptive plans and no broadcasts, so that a task holds what its key says."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def keys(spark, rows):
    return spark.createDataFrame([(k,) for k in rows], "key string")


@pytest.mark.parametrize("seed", range(4))
def test_frequent_keys_are_those_of_an_exact_count(spark, seed):
    rng = random.Random(seed)
    rows = [f"k{int(rng.paretovariate(0.7)) % 5000}" for _ in range(20_000)] + [None] * rng.choice([0, 3000])
    rng.shuffle(rows)
    df, share = keys(spark, rows).repartition(5 + seed), rng.choice([0.2, 0.02, 0.003])
    want = {k: rows.count(k) for k in set(rows) - {None} if rows.count(k) > share * len(rows)}
    assert {r["key"]: r["n"] for r in frequent_keys(df, "key", share).collect()} == want
    hot = hot_keys(df, "key", share)
    assert set(want) <= set(hot) and len(hot) <= 2 / share
    assert all(rows.count(k) > share / 2 * len(rows) for k in hot)


def test_a_key_that_stands_in_one_sorted_partition_only_is_found(spark):
    rows = ["a"] * 300 + [f"x{i}" for i in range(9_700)]
    assert [tuple(r) for r in frequent_keys(keys(spark, rows).repartition(7, "key"), "key", 0.02).collect()] == [("a", 300)]


def test_no_rows_no_keys(spark):
    for rows in ([], [None] * 10):
        assert frequent_keys(keys(spark, rows), "key").collect() == [] and hot_keys(keys(spark, rows), "key") == []
    assert hot_keys(keys(spark, ["a"] * 5), "key", 1.0) == ["a"] and frequent_keys(keys(spark, ["a"] * 5), "key", 1.0).collect() == []
    with pytest.raises(ValueError):
        hot_keys(keys(spark, ["a"]), "key", 0)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_spread_join_has_the_rows_of_a_plain_one(spark, how):
    rng = random.Random(7)
    left = [(i, rng.choice(["hot", "hot", "other", f"k{i % 40}", None]), i % 3) for i in range(1500)] + [(1, "hot", 0)] * 4
    right = [("hot", 1), ("hot", 2), ("other", 3), (None, 4)] + [(f"k{i}", i) for i in range(30)]
    a, b = spark.createDataFrame(left, "id int, url string, way int"), spark.createDataFrame(right, "url string, way_ int")
    rows = lambda df: sorted(map(repr, (tuple(r) for r in df.select("id", "url", "way", "way_").collect())))
    for hot in ([], ["hot"], ["hot", "k3", "absent"]):
        assert rows(spread_join(a, b, "url", hot, ["id"], how, 16)) == rows(a.join(b, "url", how))
    with pytest.raises(ValueError):
        spread_join(a, b, "url", [], ["id"], "full")


def test_a_glyph_of_nearly_all_works_is_no_single_tasks(plain):
    works = plain.range(4000).select(F.col("id").alias("work_id"))
    glyph = works.where("work_id % 10 <> 0").withColumn("url", F.lit("glyph"))
    refs = glyph.unionByName(works.select("work_id", F.concat(F.lit("own"), "work_id").alias("url")))
    inventory = refs.select("url").distinct().select("url", F.lit("d").alias("sha256"), F.lit(5).cast("long").alias("byte_length"), F.lit("image/png").alias("mime"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.lit(None).cast("string").alias("code"))
    hot = hot_keys(refs, "url", 0.05)
    assert hot == ["glyph"]
    tasks = lambda df: [r["count"] for r in df.where("url = 'glyph'").groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks(spread_join(refs, inventory, "url", [], ["work_id"]))) == 1
    spread = tasks(spread_join(refs, inventory, "url", hot, ["work_id"]))
    assert sum(spread) == 3600 and len(spread) == 8 and max(spread) < 1400
    for job in (lambda h: images.image_budget(refs, inventory, 9, hot=h), lambda h: images.split_parts(refs, inventory, 300, hot=h), lambda h: images.inline_images(refs, inventory, hot=h).select("work_id", F.to_json("images"))):
        assert sorted(map(tuple, job(hot).collect()), key=repr) == sorted(map(tuple, job(()).collect()), key=repr)


TARGET = "work_id string, path string, url string, input_sha256 string, converter string"


def stored(spark, root, mark, buckets=5):
    """Targets, last records, whole artifacts and fetches of 60 works, some failed, gone, changed or fetched twice."""
    n = range(60)
    w = lambda i: f"{i:06}"
    targets = [(w(i), "xhtml" if i % 2 else "text", f"u{i % 50}" if i % 7 else "new", "in" if i % 3 else "in2", "v1") for i in n]
    records = [(w(i), "xhtml" if i % 2 else "text", f"u{i % 50}", "2025-01-01", "in", "raw", "v1", "failed" if i % 11 == 0 else "converted", "fetch-status" if i % 22 == 0 else "decode-error", "s", 1) for i in n if i % 13]
    fetched = [(w(i), p, 304 if i % 5 == 0 else 404 if i % 9 == 0 and p == "xhtml" else 200, "raw" if i % 4 else "raw2", None) for i in n for p in ("xhtml", "text")]
    tables = {"targets": (targets, TARGET), "previous": (records, runs.RECORD), "intact": ([(w(i),) for i in n if i % 4], "work_id string"), "fetched": (fetched, "work_id string, path string, http int, body_sha256 string, convert_code string")}
    frames = {k: spark.createDataFrame(r, s) for k, (r, s) in tables.items()}
    return frames, {k: state.write_state(df, f"{k}_{mark}", root, buckets) for k, df in frames.items()}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_a_second_run_exchanges_nothing(plain, tmp_path, adaptive):
    plain.conf.set("spark.sql.adaptive.enabled", adaptive)
    frames, tables = stored(plain, str(tmp_path), f"a{adaptive}")
    got, flat = state.next_run(*tables.values()), state.next_run(*frames.values())
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in flat._jdf.queryExecution().executedPlan().toString()
    assert rows_of(got) == rows_of(flat) and got.count() == 60
    assert {r["decision"] for r in got.collect()} == {"reuse", "revalidate", "fetch"} and {r["pending"] for r in got.collect()} == {True, False}


def test_a_later_session_finds_the_buckets(plain, tmp_path):
    frames, tables = stored(plain, str(tmp_path), "b", buckets=3)
    want = rows_of(state.next_run(*tables.values()))
    for k in frames:
        plain.sql(f"DROP TABLE {k}_b")
    again = state.next_run(*(state.attach_state(plain, f"{k}_b", str(tmp_path)) for k in frames))
    assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString() and rows_of(again) == want
    files = [f for f in os.listdir(tmp_path / "targets_b" / "rows") if f.endswith(".parquet")]
    assert len(files) == 3


def test_state_goes_into_new_folders_whole_and_by_plain_names(plain, tmp_path):
    df = plain.createDataFrame([("1", 2)], "work_id string, way int")
    state.write_state(df, "once_c", str(tmp_path), 2)
    with pytest.raises(Exception, match="(?i)already exists|not empty|non-empty"):
        state.write_state(df, "once_c", str(tmp_path), 2)
    os.rename(tmp_path / "once_c" / "buckets", tmp_path / "gone")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        state.attach_state(plain, "once_c", str(tmp_path))
    for name in ("a b", "x;y", "", "1a"):
        with pytest.raises(ValueError):
            state.write_state(df, name, str(tmp_path))
    empty = state.write_state(df.where("false"), "none_c", str(tmp_path), 2)
    assert empty.collect() == []


def test_repeated_records_of_a_work_give_one_decision(spark):
    one = ("1", "text", "u", "d", "in", "raw", "v1", "converted", None, "s", 1)
    previous = spark.createDataFrame([one, one, (*one[:1], "xhtml", *one[2:])], runs.RECORD)
    targets = spark.createDataFrame([("1", "text", "u", "in", "v1"), ("2", "text", "u", "in", "v1"), (None, "text", "u", "in", "v1")], TARGET)
    intact = spark.createDataFrame([("1",)], "work_id string")
    assert rows_of(runs.reuse_previous(targets, previous, intact)) == [("1", "text", "reuse"), ("2", "text", "fetch"), (None, "text", "fetch")]
