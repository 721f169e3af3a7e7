"""Pictures: which URLs may be taken, what works refer to, sizes, budgets, parts and assets.

Digests and sizes travel through the plans; bytes are joined only where an asset is written.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.skew import spread_join

HOST = "https://library.example"
MIMES = ("image/png", "image/jpeg", "image/gif")


def allowed_url(url: Column, host: str = HOST) -> Column:
    """A glyph or a file of a person's directory on the host, in canonical form.

    The path is read segment by segment: each of letters, digits, and the signs of file names, none a dot segment, so
    that no query, fragment or escape can stand in it."""
    path = F.split(F.substring(url, F.lit(len(host) + 2), F.char_length(url)), "/")
    clean = F.forall(path, lambda s: s.rlike("^[A-Za-z0-9_.-]+$") & ~s.isin(".", ".."))
    folder, depth = F.get(path, F.lit(0)), F.size(path)
    glyph = (folder == "gaiji") & (depth >= 2)
    file = (folder == "cards") & (depth == 4) & F.get(path, F.lit(1)).rlike("^[0-9]{6}$") & (F.get(path, F.lit(2)) == "files")
    name = F.element_at(path, -1)
    picture = F.substring_index(name, ".", -1).isin("png", "jpg", "jpeg", "gif") & (F.instr(name, ".") > 1)
    return F.coalesce(F.startswith(url, F.lit(f"{host}/")) & clean & (glyph | file) & picture, F.lit(False))


def image_owner(refs: DataFrame, works: DataFrame, host: str = HOST) -> DataFrame:
    """(work_id, url, owned): whether a file lies in the work's own person directory; glyphs belong to all. works: (work_id, person_id)."""
    directory = F.regexp_extract("url", f"^{re.escape(host)}/cards/([0-9]{{6}})/files/", 1)
    return refs.join(works, "work_id").select("work_id", "url", F.when(F.startswith("url", F.lit(f"{host}/gaiji/")), True).otherwise(directory == F.col("person_id")).alias("owned"))


def image_urls_per_work(refs: DataFrame) -> DataFrame:
    """(work_id, n, urls): distinct URLs in order, joined by spaces."""
    return refs.groupBy("work_id").agg(F.array_sort(F.collect_set("url")).alias("u")).select("work_id", F.size("u").alias("n"), F.array_join("u", " ").alias("urls"))


def distinct_images(refs: DataFrame) -> DataFrame:
    """(url, works): every picture once."""
    return refs.groupBy("url").agg(F.count_distinct("work_id").alias("works"))


def image_budget(refs: DataFrame, inventory: DataFrame, most: int = 32 << 20, hot: Sequence[str] = ()) -> DataFrame:
    """(work_id, bytes, code, url): the first failed picture by URL, else images-too-large beyond ``most`` raw bytes.

    hot: URLs that very many works share (see hot_keys), whose references are spread; without it the join is left to AQE."""
    j = spread_join(refs, inventory, "url", hot, ["work_id"], "left").withColumn("code", F.coalesce("code", F.when(F.col("sha256").isNull(), "missing-image")))
    per = j.groupBy("work_id").agg(F.coalesce(F.sum(F.when(F.col("code").isNull(), F.col("byte_length"))), F.lit(0)).alias("bytes"), F.min(F.when(F.col("code").isNotNull(), F.struct("url", "code"))).alias("f"))
    return per.select("work_id", "bytes", F.coalesce(F.col("f.code"), F.when(F.col("bytes") > most, "images-too-large")).alias("code"), F.col("f.url").alias("url"))


def missing_images(refs: DataFrame, supplied: DataFrame) -> DataFrame:
    """(work_id, url): referenced, but in neither the asset nor its parts. supplied: (work_id, url), repeats allowed."""
    return refs.select("work_id", "url").distinct().join(supplied.select("work_id", "url").distinct(), ["work_id", "url"], "left_anti")


def unreferenced_images(refs: DataFrame, supplied: DataFrame) -> DataFrame:
    return missing_images(supplied, refs)


def inline_images(refs: DataFrame, inventory: DataFrame, hot: Sequence[str] = ()) -> DataFrame:
    """(work_id, images): a map from URL to picture, at the edge only. hot: shared URLs, as for image_budget."""
    j = spread_join(refs, inventory.where("code IS NULL"), "url", hot, ["work_id"])
    entry = F.struct("url", F.struct("mime", "width", "height", "sha256").alias("image"))
    return j.groupBy("work_id").agg(F.map_from_entries(F.array_sort(F.collect_set(entry))).alias("images"))


def reuse_images(refs: DataFrame, kept: DataFrame, revalidate: bool = False, host: str = HOST) -> DataFrame:
    """(url, decision): invalid-url, reuse of a kept copy whose digest holds, or fetch. kept: (url, sha256, stored_sha256)."""
    j = refs.select("url").distinct().join(kept, "url", "left")
    whole = F.coalesce(F.col("sha256") == F.col("stored_sha256"), F.lit(False)) & F.lit(not revalidate)
    return j.select("url", F.when(~allowed_url(F.col("url"), host), "invalid-url").when(whole, "reuse").otherwise("fetch").alias("decision"))


def entry_size() -> Column:
    """The characters of a picture's entry in a part's JSON, ["url",{"mime":…,"width":…,"height":…,"data":…}], with a comma."""
    frame = len('["",{"mime":"","width":,"height":,"data":""}],')
    digits = lambda c: F.char_length(F.col(c).cast("string"))
    url = F.char_length(F.to_json(F.struct("url"))) - len('{"url":""}')  # as JSON writes it
    return (url + F.char_length("mime") + digits("width") + digits("height") + F.ceil(F.col("byte_length") / 3) * 4 + frame).cast("long")


def asset_files(rows: DataFrame, limit: int, most_parts: int = 1000) -> DataFrame:
    """(work_id, path, urls, code): the files a work is written to, in order, from split_parts' rows with ``own`` (the
    characters of the work's document): one file where all fits into ``limit``, else the document and a file a part.

    A document beyond the limit is ``work-too-large``; faults of parts are the work's."""
    per = rows.groupBy("work_id").agg(F.max("own").alias("own"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.min("code").alias("code"), F.array_sort(F.collect_list(F.when(F.col("url").isNotNull(), F.struct("part", "url")))).alias("e"))
    path = lambda *tail: F.concat(F.lit("works/"), F.lpad(F.col("work_id").cast("string"), 6, "0"), *tail)
    urls = lambda n: F.transform(F.filter("e", lambda x: x["part"] == n), lambda x: x["url"])
    split = F.col("own") + F.col("size") > limit
    whole = F.array(F.struct(path(F.lit(".json.gz")).alias("path"), F.transform("e", lambda x: x["url"]).alias("urls")))
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.array_max(F.transform("e", lambda x: x["part"])), F.lit(1))), lambda n: F.struct(path(F.lit(".images-"), n.cast("string"), F.lit(".json.gz")).alias("path"), urls(n).alias("urls")))
    main = F.array(F.struct(path(F.lit(".json.gz")).alias("path"), F.array().cast("array<string>").alias("urls")))
    files = F.when(~split, whole).otherwise(F.concat(main, F.when(F.size("e") > 0, parts).otherwise(F.array().cast("array<struct<path:string,urls:array<string>>>"))))
    code = F.when(split, F.coalesce("code", F.when(F.col("own") > limit, "work-too-large")))
    return per.select("work_id", F.posexplode(files).alias("n", "f"), code.alias("code")).select("work_id", "n", "f.path", "f.urls", "code")


def split_parts(refs: DataFrame, inventory: DataFrame, limit: int, most_parts: int = 1000, hot: Sequence[str] = ()) -> DataFrame:
    """(work_id, url, size, part, code): pictures in URL order packed greedily into parts of at most nine tenths of ``limit``.

    A picture is as large as its entry in a part's JSON: URL, type, sizes, and its bytes in base64, with a comma. Only works beyond one part are folded. A picture beyond a part is ``image-too-large``; too many parts is a fault of the work.
    hot: shared URLs, as for image_budget."""
    budget = limit * 9 // 10
    sized = spread_join(refs, inventory.where("code IS NULL").select("url", entry_size().alias("size")), "url", hot, ["work_id"])
    work = sized.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("url", "size"))).alias("e"), F.sum("size").alias("total"))
    start = F.struct(F.lit(1).alias("part"), F.lit(0).cast("long").alias("held"), F.array().cast("array<int>").alias("parts"))

    def step(s, x):
        full = (s["held"] + x["size"] > budget) & (s["held"] > 0)
        part = F.when(full, s["part"] + 1).otherwise(s["part"])
        return F.struct(part.alias("part"), F.when(full, x["size"]).otherwise(s["held"] + x["size"]).alias("held"), F.concat(s["parts"], F.array(part)).alias("parts"))

    parts = F.when(F.col("total") <= budget, F.transform("e", lambda _: F.lit(1))).otherwise(F.aggregate("e", start, step)["parts"])
    rows = work.select("work_id", F.explode(F.arrays_zip("e", parts.alias("part"))).alias("x"), F.array_max(parts).alias("n"))
    code = F.when(F.col("x.e.size") > budget, "image-too-large").when(F.col("n") > most_parts, "too-many-parts")
    return rows.select("work_id", F.col("x.e.url").alias("url"), F.col("x.e.size").alias("size"), F.col("x.part").alias("part"), code.alias("code"))


def check_asset_rows(rows: DataFrame) -> DataFrame:
    """(work_id, url, problem): rows (work_id, url, mime, width, height, data, parts) that an asset may not hold."""
    base = (F.col("data") != "") & (F.char_length("data") % 4 == 0) & ~F.col("data").rlike("\\s") & F.try_to_binary("data", F.lit("base64")).isNotNull()
    own = F.concat(F.lit("works/"), F.col("work_id").cast("string"))
    tail = lambda p: F.regexp_extract(p, r"\.images-([0-9]{1,4})\.json\.gz$", 1)
    own = F.col("work_id").cast("string").rlike("^[0-9]{6}$") & F.forall("parts", lambda p: (tail(p) != "") & (p == F.concat(own, F.lit(".images-"), tail(p), F.lit(".json.gz"))))
    problem = F.when(~F.col("mime").isin(*MIMES), "mime").when(~F.col("width").between(1, 10_000) | ~F.col("height").between(1, 10_000), "size").when(~F.coalesce(base, F.lit(False)), "data").when(~own, "part-name").when(F.size(F.array_distinct("parts")) != F.size("parts"), "part-repeated").when(F.size("parts") > 1000, "too-many-parts")
    return rows.select("work_id", "url", problem.alias("problem")).where("problem IS NOT NULL")
