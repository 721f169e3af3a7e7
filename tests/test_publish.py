"""Size-bounded shards and releases that are there whole or not at all."""

import glob
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from vellum.operators import publish


def frame(spark, rows, schema="o string, v string"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("limit", [40, 100, 1000])
def test_shards_keep_order_and_limit(spark, tmp_path, limit):
    rng = random.Random(limit)
    rows = [(f"{rng.randint(0, 300):04}", "é" * rng.randint(0, 15)) for _ in range(1500)] + [("0100", "same")] * 50 + [(None, None), ("0005", None)]
    got = publish.bounded_shards(frame(spark, rows), "o", F.col("v"), limit)
    out = got.collect()
    assert sorted((r["o"] or "", r["value"]) for r in out) == sorted((o or "", v or "") for o, v in rows)
    placed = sorted(out, key=lambda r: (r["o"] is not None, r["o"] or "", r["value"]))
    assert all(r["code"] is None for r in out) and [r["shard"] for r in placed] == sorted(r["shard"] for r in placed)
    sizes = {}
    for r in out:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["bytes"]
    assert max(sizes.values()) <= limit
    total, longest = sum(sizes.values()), max(r["bytes"] for r in out)
    assert len(sizes) <= total // (limit - longest + 1) + 1
    path = str(tmp_path / "s")
    publish.write_shards(got, "o", path)
    files = glob.glob(f"{path}/shard=*/*.txt")
    assert len(files) == len(sizes) and all(os.path.getsize(f) <= limit for f in files)
    read = [line for n in sorted(sizes) for f in glob.glob(f"{path}/shard={n}/*.txt") for line in open(f, encoding="utf8").read().split("\n")[:-1]]
    assert read == [r["value"] for r in placed]


def test_texts_beyond_the_limit_are_told_and_the_rest_is_placed(spark):
    rows = [("a", "x" * 10), ("b", "x" * 500), ("c", "x" * 19), ("d", "")]
    got = {r["o"]: (r["shard"], r["code"]) for r in publish.bounded_shards(frame(spark, rows), "o", F.col("v"), 20).collect()}
    assert got["b"] == (None, "too-large") and got["a"][1] is None and len({got["a"], got["c"]}) == 2
    assert publish.bounded_shards(frame(spark, []), "o", F.col("v"), 20).collect() == []


def parts(spark, *values):
    return {"works": spark.createDataFrame([(f"p{i % 2}", v) for i, v in enumerate(values)], "folder string, value string")}


def values(spark, root):
    return sorted(r["value"] for r in publish.read_release(spark, root, "works").collect())


def test_a_release_that_dies_between_stages_leaves_the_old_one(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "root")
    assert publish.current(spark, root) is None
    with pytest.raises(LookupError):
        publish.read_release(spark, root, "works")
    first = publish.stage(parts(spark, "a", "b"), root)
    assert publish.current(spark, root) is None  # staged, not out
    assert publish.commit(spark, root, first) == 1 and values(spark, root) == ["a", "b"]
    # dies while texts are written: one part is there, the next fails
    bad = parts(spark, "x") | {"other": parts(spark, "y")["works"].withColumn("value", F.raise_error(F.lit("killed")).cast("string"))}
    with pytest.raises(Exception, match="killed"):
        publish.stage(bad, root)
    assert values(spark, root) == ["a", "b"]
    # dies after the texts and the list of files, before the commit
    second = publish.stage(parts(spark, "c"), root)
    with monkeypatch.context() as m:
        m.setattr(publish, "current", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            publish.commit(spark, root, second)
    assert values(spark, root) == ["a", "b"]
    left = {r["attempt"] for r in publish.orphans(spark, root).collect()}
    assert second in left and first not in left and len(left) == 2
    third = publish.stage(parts(spark, "d", "e", "f"), root)
    assert publish.commit(spark, root, third) == 2 and values(spark, root) == ["d", "e", "f"]
    row = publish.current(spark, root)
    assert (row["release"], row["attempt"], row["files"]) == (2, third, 2)
    assert row["bytes"] == sum(os.path.getsize(f) for f in glob.glob(f"{root}/attempts/{third}/works/*/*.gz"))
    assert {r["attempt"] for r in publish.orphans(spark, root, keep=1).collect()} == left | {first}


def test_what_may_not_go_out_is_refused(spark, tmp_path):
    root = str(tmp_path / "root")
    publish.commit(spark, root, publish.stage(parts(spark, "a"), root))
    big = publish.stage(parts(spark, os.urandom(3000).hex()), root)
    with pytest.raises(publish.Refused, match="file-too-large"):
        publish.commit(spark, root, big, most_bytes=2000)
    many = publish.stage(parts(spark, "a", "b", "c"), root)
    with pytest.raises(publish.Refused, match="too-many-files"):
        publish.commit(spark, root, many, most_files=2)
    lost = publish.stage(parts(spark, "a"), root)
    refs = spark.createDataFrame([("works/x", "works/nowhere")], "path string, target string")
    with pytest.raises(publish.Refused, match="missing works/nowhere"):
        publish.commit(spark, root, lost, refs)
    assert values(spark, root) == ["a"] and publish.current(spark, root)["release"] == 1
    with pytest.raises(ValueError, match="plain"):
        publish.stage({"../x": parts(spark, "a")["works"]}, root)


def test_the_list_holds_sizes_and_digests_of_the_compressed_files(spark, tmp_path):
    import hashlib

    root = str(tmp_path / "root")
    attempt = publish.stage(parts(spark, "a", "b", "a", "b"), root)
    publish.commit(spark, root, attempt)
    files = glob.glob(f"{root}/attempts/{attempt}/works/*/*.gz")
    want = {(os.path.relpath(f, f"{root}/attempts/{attempt}"), os.path.getsize(f), hashlib.sha256(open(f, "rb").read()).hexdigest()) for f in files}
    listed = spark.read.schema(publish.FILES).json(f"{root}/manifests/{attempt}")
    assert {tuple(r) for r in listed.collect()} == want and len(want) == 2
    assert publish.check_current(spark, root).collect() == []
    shutil.copy(files[0], files[0].replace("part-", "part-9"))
    with open(files[1], "ab") as f:
        f.write(b"x")
    for crc in glob.glob(f"{root}/attempts/{attempt}/works/*/.*.crc"):
        os.remove(crc)
    assert sorted(r["problem"] for r in publish.check_current(spark, root).collect()) == ["changed", "extra"]
    os.remove(files[0])
    assert sorted(r["problem"] for r in publish.check_current(spark, root).collect()) == ["changed", "extra", "missing"]


def packed_works(spark, root):
    """Four works: one file, a document with two parts, pictures that fail, a document that stays large when compressed."""
    from vellum.operators import images
    from vellum.sources import readers

    rng = random.Random(3)
    noise = "".join(chr(rng.randint(97, 122)) for _ in range(4000))
    works = spark.createDataFrame([(1, "a" * 3000), (2, "b" * 300), (3, "c"), (4, noise)], "work_id bigint, json string")
    known = spark.createDataFrame([(f"u{i}", "d", 300, "image/png", 1, 1, "invalid-image" if i == 9 else None) for i in range(10)], "url string, sha256 string, byte_length bigint, mime string, width int, height int, code string")
    refs = spark.createDataFrame([(1, "u1"), *((2, f"u{i}") for i in range(8)), (3, "u9"), (3, "u8")], "work_id bigint, url string")
    own = works.select("work_id", F.char_length("json").cast("long").alias("own"))
    parts = images.split_parts(refs, known, 4100)
    assert parts.where("work_id = 2").agg(F.max("part")).first()[0] == 2 or parts.where("work_id = 2").agg(F.sum("size")).first()[0] <= 4100
    files = images.asset_files(own.join(parts, "work_id", "left"), 4100)
    failed = publish.failed_works(images.image_budget(refs, known, 1 << 20), files)
    pictures = refs.join(known.where("code IS NULL"), "url").select("work_id", "url", "mime", "width", "height", F.lit("QQ==" * 100).alias("data"))
    sound = files.join(failed.select("work_id"), "work_id", "left_anti")
    return files, failed, publish.stage_assets(readers.pack_assets(works, sound, pictures), root)


def test_results_are_of_files_as_compressed_and_failures_are_told(spark, tmp_path):
    import gzip
    import hashlib
    import json

    root = str(tmp_path / "r")
    files, failed, attempt = packed_works(spark, root)
    staged = publish.staged_files(spark, root, attempt)
    got = publish.asset_results(staged, files, failed, 2000).collect()
    wrong = {r["work_id"]: (r["code"], r["url"]) for r in got if r["path"] is None}
    assert wrong == {3: ("invalid-image", "u9"), 4: ("file-too-large", None)}
    assert all(r["message"] == publish.MESSAGES[r["code"]] for r in got if r["path"] is None)
    listed = {r["path"]: r for r in got if r["path"]}
    assert {r["work_id"] for r in listed.values()} == {1, 2} and all(r["code"] is None for r in listed.values())
    for path, r in listed.items():
        name = path.removeprefix("works/").removesuffix(".json.gz")
        (file,) = glob.glob(f"{root}/attempts/{attempt}/works/folder={name}/*.gz")
        raw = open(file, "rb").read()
        assert (r["bytes"], r["sha256"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert len(json.loads(gzip.decompress(raw))["images"]) == r["images"]
    assert sum(r["images"] for r in listed.values() if r["work_id"] == 2) == 8
    assert {r["work_id"] for r in publish.asset_results(staged, files, failed).collect() if r["path"]} == {1, 2, 4}
    lost = publish.asset_results(staged.where("path NOT LIKE '%000001%'"), files, failed, 2000).collect()
    assert ("missing-file",) in {(r["code"],) for r in lost if r["work_id"] == 1} and not [r for r in lost if r["work_id"] == 1 and r["path"]]
    assert publish.asset_results(staged, files.where("false"), failed.where("false")).collect() == []
