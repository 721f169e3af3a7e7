"""Strict readers: the catalog's CSV, bodies as files, pictures' headers; and the writers of assets."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vellum.sources.csv_ranges import csv_records

#: The official catalog's column labels and our names for them.
LABELS = {
    "作品ID": "work_id", "作品名": "title", "作品名読み": "title_reading", "ソート用読み": "sort_reading", "副題": "subtitle", "副題読み": "subtitle_reading", "原題": "original_title", "初出": "first_publication",
    "分類番号": "classification", "文字遣い種別": "orthography", "作品著作権フラグ": "work_copyright", "公開日": "published", "最終更新日": "updated", "図書カードURL": "card_url", "人物ID": "person_id",
    "姓": "surname", "名": "given", "姓読み": "surname_reading", "名読み": "given_reading", "役割フラグ": "role", "人物著作権フラグ": "person_copyright",
    "テキストファイルURL": "text_url", "テキストファイル最終更新日": "text_updated", "テキストファイル符号化方式": "text_encoding",
    "XHTML/HTMLファイルURL": "xhtml_url", "XHTML/HTMLファイル最終更新日": "xhtml_updated", "XHTML/HTMLファイル符号化方式": "xhtml_encoding",
}
STRICT = {"multiLine": True, "quote": '"', "escape": '"', "mode": "FAILFAST", "unescapedQuoteHandling": "RAISE_ERROR", "encoding": "UTF-8", "nullValue": "\0", "emptyValue": "", "maxCharsPerColumn": -1}


def read_header(spark: SparkSession, path: str) -> list[str]:
    """The first row's values, a byte order mark taken off. Only this row reaches the driver."""
    row = spark.read.options(**{**STRICT, "mode": "PERMISSIVE"}).csv(path).first()
    names = [] if row is None else ["" if x is None else x for x in row]
    return [names[0].lstrip("﻿"), *names[1:]] if names else []


def check_header(spark: SparkSession, names: list[str], required: list[str] | None = None) -> DataFrame:
    """(problem, column): missing and repeated columns, which refuse a load, and new-column, which is a note."""
    got = spark.range(1).select(F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")).alias("column"))
    want = spark.range(1).select(F.explode(F.array(*map(F.lit, required or LABELS))).alias("column"))
    repeated = got.groupBy("column").count().where("count > 1").select(F.lit("repeated").alias("problem"), "column")
    missing = want.join(got, "column", "left_anti").select(F.lit("missing").alias("problem"), "column")
    return missing.unionByName(repeated).unionByName(got.distinct().join(want, "column", "left_anti").select(F.lit("new-column").alias("problem"), "column"))


def check_files(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """(file, problem, column): check_header of every CSV file under a path, from each file's first line, in Spark."""
    want = F.array(*map(F.lit, required or LABELS))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), "value")
    heads = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "n").alias("head"))
    names = F.transform(F.split(F.regexp_replace("head", r"^\x{FEFF}", ""), ",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"), lambda c: F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"')))
    got = heads.select("file", names.alias("names"))
    each = lambda problem, columns: F.transform(columns, lambda c: F.struct(F.lit(problem).alias("problem"), c.alias("column")))
    repeated = F.filter(F.array_distinct("names"), lambda c: F.size(F.filter("names", lambda x: x == c)) > 1)
    all_of = F.concat(each("missing", F.array_except(want, F.col("names"))), each("repeated", repeated), each("new-column", F.array_except("names", want)))
    return got.select("file", F.inline(all_of))


def read_catalog_csv(spark: SparkSession, path: str, labels: dict[str, str] = LABELS) -> DataFrame:
    """Rows of a catalog with row_no in file order and columns renamed; unknown columns are left out.

    Quoted commas, line ends and doubled quotes are read; any line end serves, and is a line feed inside quotes; blank lines
    go. A missing or repeated column, a stray or an unclosed quote raises; a row of another width does when rows are read.
    A file is read by ranges, as many tasks as its size asks for (see csv_ranges).
    """
    names = read_header(spark, path)
    wrong = check_header(spark, names, list(labels)).where("problem <> 'new-column'").collect()
    if wrong:
        raise ValueError(f"the catalog's header is refused: {[(r['problem'], r['column']) for r in wrong]}")
    options = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in STRICT.items() if k not in ("multiLine", "encoding")}
    rows = csv_records(spark, path).where("NOT head").select("row_no", F.from_csv("record", ", ".join(f"`{n.replace(chr(96), 2 * chr(96))}` string" for n in names), options).alias("r"))
    return rows.select("row_no", *(F.coalesce(F.col("r").getField(label), F.lit("")).alias(name) for label, name in labels.items()))


CODECS = {"ShiftJIS": "cp932", "UTF-8": "utf-8"}


def _text_of(content: bytes | None, path: str, encoding: str, most_entries: int, most_bytes: int) -> tuple[str | None, str | None]:
    try:
        if content is None or encoding not in CODECS:
            return None, "decode-error"
        if path == "text":
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                texts = [i for i in z.infolist() if i.filename.lower().endswith(".txt")]
                if len(z.infolist()) > most_entries or len(texts) != 1 or texts[0].file_size > most_bytes:
                    return None, "decode-error"
                content = z.read(texts[0])
        return content.decode(CODECS[encoding], "strict"), None
    except (UnicodeDecodeError, zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, zlib.error):
        return None, "decode-error"


def decode_bodies(files: DataFrame, most_entries: int = 8, most_bytes: int = 64 << 20) -> DataFrame:
    """(work_id, path, text, error) from (work_id, path, encoding, content): pages as they are, texts from a zip with
    exactly one of them, both strictly decoded; what can't be read is ``decode-error`` and the job goes on."""
    cols = ["work_id", "path", "encoding", "content"]
    some = files.select(*cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                path, encoding, content = (row.column(c)[0].as_py() for c in cols[1:])
                text, error = _text_of(content, path, encoding, most_entries, most_bytes)
                yield pa.RecordBatch.from_arrays([row.column("work_id"), row.column("path"), pa.array([text], pa.string()), pa.array([error], pa.string())], names=["work_id", "path", "text", "error"])

    schema = StructType([some.schema["work_id"], some.schema["path"], StructField("text", StringType()), StructField("error", StringType())])
    return some.mapInArrow(run, schema)


def _jpeg_size(data: bytes) -> tuple[int, int] | None:
    """The frame size of a sequential JPEG, found by walking its markers."""
    at = 2
    while at + 9 < len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if kind in (0xC0, 0xC1):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        if 0xC2 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC) or kind == 0xDA or size < 2:
            return None
        at += 2 + size
    return None


def _jpeg(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the frame size of the pictures that were sent for it, which go no further."""
    for b in batches:
        sizes = [_jpeg_size(x) if x is not None else None for x in b.column("jpeg").to_pylist()]
        w, h = (pa.array([s[i] if s else own for s, own in zip(sizes, b.column(c).to_pylist(), strict=True)], pa.int32()) for i, c in enumerate(("w", "h")))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("url", "sha256", "byte_length", "mime")), w, h], names=["url", "sha256", "byte_length", "mime", "w", "h"])


def _int(c: Column, at: int, size: int, little: bool = False) -> Column:
    h = F.hex(F.substring(c, at + 1, size))
    return F.conv(F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2)) if little else h, 16, 10).cast("int")


def image_inventory(files: DataFrame, most_bytes: int = 8 << 20, most_side: int = 10_000, most_pixels: int = 16_000_000) -> DataFrame:
    """(url, sha256, byte_length, mime, width, height, code) from (url, content), read from headers and end markers.

    Only sequential JPEG frames count; what can't be read, lacks its end or is beyond a limit is ``invalid-image``."""
    c = F.col("content")
    n = F.octet_length(c)
    head, tail = F.hex(F.substring(c, 1, 8)), lambda k: F.hex(F.expr(f"substring(content, greatest(octet_length(content) - {k - 1}, 1), {k})"))
    png = (head == "89504E470D0A1A0A") & (F.hex(F.substring(c, 13, 4)) == "49484452") & (tail(12) == "0000000049454E44AE426082")
    gif = F.substring(head, 1, 12).isin("474946383761", "474946383961") & (tail(1) == "3B")
    jpeg = F.startswith(head, F.lit("FFD8FF")) & (tail(2) == "FFD9")
    mime = F.when(png, "image/png").when(gif, "image/gif").when(jpeg, "image/jpeg")
    width = F.when(png, _int(c, 16, 4)).when(gif, _int(c, 6, 2, True))
    height = F.when(png, _int(c, 20, 4)).when(gif, _int(c, 8, 2, True))
    # digest, size and header are of the row itself; bytes go to a JPEG's marker walk at most, and through no exchange
    rows = files.select("url", F.sha2(c, 256).alias("sha256"), n.cast("long").alias("byte_length"), mime.alias("mime"), width.alias("w"), height.alias("h"), F.when(jpeg, c).alias("jpeg"))
    j = rows.mapInArrow(_jpeg, "url string, sha256 string, byte_length bigint, mime string, w int, h int")
    width, height = F.col("w"), F.col("h")
    sound = width.between(1, most_side) & height.between(1, most_side) & (width.cast("long") * height <= most_pixels) & (F.col("byte_length") <= most_bytes)
    good = F.coalesce(sound, F.lit(False))
    return j.select("url", "sha256", "byte_length", F.when(good, F.col("mime")).alias("mime"), F.when(good, width).alias("width"), F.when(good, height).alias("height"), F.when(~good, "invalid-image").alias("code"))


def write_assets(works: DataFrame, images: DataFrame, path: str, buckets: int = 64) -> None:
    """One compressed JSON line per work, with its document and its pictures, in folders by bucket of the ID.

    works: (work_id, json); images: (work_id, url, mime, width, height, data). Bytes are joined here and nowhere before."""
    entry = F.struct("url", "mime", "width", "height", "data")
    per = images.groupBy("work_id").agg(F.array_sort(F.collect_list(entry)).alias("images"))
    bucket = F.pmod(F.xxhash64("work_id"), F.lit(buckets)).cast("int")
    text = F.to_json(F.struct(F.lit(1).alias("format"), "work_id", F.col("json").alias("work"), F.coalesce("images", F.array().cast("array<struct<url:string,mime:string,width:int,height:int,data:string>>")).alias("images")))
    rows = works.join(per, "work_id", "left").select(bucket.alias("bucket"), "work_id", text.alias("value"))
    rows.repartition("bucket").sortWithinPartitions("bucket", "work_id").select("bucket", "value").write.mode("overwrite").partitionBy("bucket").option("compression", "gzip").text(path)


ENTRY = "struct<url:string,mime:string,width:int,height:int,data:string>"


def pack_assets(works: DataFrame, files: DataFrame, images: DataFrame) -> DataFrame:
    """(work_id, path, n, images, parts, bytes, sha256, value): the JSON text of each file of asset_files, with what is
    written of it in a list of results. The document's file lists its parts; a part holds pictures only.

    works: (work_id, json); files: (work_id, n, path, urls, code); works with a code are left out. Bytes of pictures are
    joined here, by work and URL, and nowhere before."""
    sound = files.where("code IS NULL")
    held = sound.select("work_id", "n", F.explode("urls").alias("url")).join(images, ["work_id", "url"]).groupBy("work_id", "n").agg(F.array_sort(F.collect_list(F.struct("url", "mime", "width", "height", "data"))).alias("e"))
    parts = sound.where("n > 0").groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("n", "path"))).alias("p"))
    rows = sound.join(works, "work_id").join(held, ["work_id", "n"], "left").join(parts, "work_id", "left")
    e = F.coalesce("e", F.array().cast(f"array<{ENTRY}>")).alias("images")
    listed = F.when(F.col("n") == 0, F.coalesce(F.transform("p", lambda x: x["path"]), F.array().cast("array<string>"))).alias("imageParts")
    text = F.to_json(F.struct(F.lit(1).alias("format"), F.when(F.col("n") == 0, F.col("json")).alias("work"), e, listed))
    made = rows.select("work_id", "path", "n", F.size(e).alias("images"), F.when(F.col("n") == 0, F.size(listed)).otherwise(0).alias("parts"), text.alias("value"))
    return made.select("work_id", "path", "n", "images", "parts", F.octet_length("value").cast("long").alias("bytes"), F.sha2("value", 256).alias("sha256"), "value")


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    schema = "format int, work_id string, work string, images array<struct<url:string,mime:string,width:int,height:int,data:string>>"
    return spark.read.schema(schema).json(path)
