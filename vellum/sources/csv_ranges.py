"""Records of CSV files whose quoted fields hold line ends, read by ranges: one file is many tasks.

Spark's text reader cuts files into ranges at line ends. Whether a line begins inside quotes depends on all quotes before it
in its file, so each range is summed up first: its quotes, and how many records would begin in it outside and inside of
quotes. A scan over these sums, one row a range, tells every range its state and the number of its first record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUMS = "file string, at bigint, quotes bigint, outside bigint, inside bigint"
FRAGMENT = "row_no bigint, at bigint, whole boolean, head boolean, record string"
FIELD = r'(?:"(?:[^"]++|"")*+"|[^",\n]*+)'
#: Fields with quotes about all of them or none at all.
RECORD = re.compile(f"{FIELD}(?:,{FIELD})*+")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all ranges; the tasks keep a range's lines together and in order."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")


def _ranges(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """A batch by range: a task may read several, one after the other."""
    file, at = batch.column("file"), batch.column("at").to_pylist()
    start = 0
    while start < len(at):
        end = start
        name = file[start]
        while end < len(at) and at[end] == at[start] and file[end] == name:
            end += 1
        yield (name.as_py(), at[start]), batch.column("value").slice(start, end - start)
        start = end


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        for key, lines in _ranges(batch):
            own = seen.setdefault(key, [0, 0, 0])
            for filled, quotes in zip(pc.not_equal(lines, "").to_pylist(), pc.count_substring(lines, '"').to_pylist(), strict=True):
                if filled:
                    own[1 + own[0] % 2] += 1
                own[0] += quotes
    columns = [*zip(*seen), *zip(*seen.values())] if seen else [()] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), *[pa.int64()] * 4], strict=True)], names=[x.split()[0] for x in SUMS.split(", ")])


def _scan(sums: list[tuple]) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """Whether each range begins inside quotes, how many records of all files begin before it, and before its file."""
    out, file, inside, before, first = {}, None, False, 0, 0
    for name, at, quotes, outside, within in sorted(sums):
        if name != file:
            if inside:
                raise ValueError(f"a quote is not closed: {file}")
            file, inside, first = name, False, before
        out[name, at] = inside, before, first
        before += within if inside else outside
        inside ^= quotes % 2 == 1
    if inside:
        raise ValueError(f"a quote is not closed: {file}")
    return out


def _broken(states: dict[tuple[str, int], tuple[bool, int, int]]) -> list[tuple[str, int]]:
    """The ranges that begin inside a record, and those before them, where it is that begins or goes on."""
    found, last = set(), None
    for key in sorted(states):
        if states[key][0]:
            found |= {key, last}
        last = key
    return sorted(found)


def _checked(record: str) -> str:
    if '"' in record and not RECORD.fullmatch(record):
        raise ValueError(f"a quote stands inside of a field: {record[:200]}")
    return record


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in FRAGMENT.split(", ")])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, head, record): the text of each record of the CSV files under a path, numbered from 0 in order of files' names
    and of places in them; head marks each file's first. Empty lines outside of quotes are none. Line ends inside quotes,
    of any kind, become line feeds. A quote that a file doesn't close, or one inside of a field, raises.

    A record that goes over the end of its range is put together from its parts; only those parts are shuffled, and only the
    ranges that have one are read again for them. The driver holds a row for each range
    (spark.sql.files.maxPartitionBytes), as Spark's own list of them does.
    """
    lines = _lines(spark, path)
    scanned = _scan([tuple(r) for r in lines.mapInArrow(_sums, SUMS).collect()])
    states = spark.sparkContext.broadcast(scanned)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, row, first, inside, whole = None, [], 0, 0, False, True
        for batch in batches:
            rows = []
            for own, values in _ranges(batch):
                if own != key:
                    if held:  # the record goes on in the next range
                        rows.append((row, key[1], False, row == first, "\n".join(held)))
                    key, held = own, []
                    inside, before, first = states.value[own]
                    row, whole = before - 1, not inside
                for line, quotes in zip(values.to_pylist(), pc.count_substring(values, '"').to_pylist(), strict=True):
                    if not inside:
                        if not line:
                            continue
                        row += 1
                    held.append(line)
                    inside ^= quotes % 2 == 1
                    if not inside:
                        text = held[0] if len(held) == 1 else "\n".join(held)
                        rows.append((row, key[1], whole, row == first, _checked(text) if whole else text))
                        held, whole = [], True
            if rows:
                yield _batch(rows)
        if held:
            yield _batch([(row, key[1], False, row == first, "\n".join(held))])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record in batch.column("record").to_pylist():
                _checked(record)
            yield batch

    whole = lines.mapInArrow(parts, FRAGMENT).where("whole").select("row_no", "head", "record")
    broken = _broken(scanned)
    if not broken:
        return whole
    some = F.broadcast(spark.createDataFrame(broken, "file string, at bigint"))
    cut = lines.join(some, ["file", "at"]).select("file", "at", "value").mapInArrow(parts, FRAGMENT).where("NOT whole").groupBy("row_no", "head").agg(F.array_sort(F.collect_list(F.struct("at", "record"))).alias("p"))
    cut = cut.select("row_no", "head", F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record")).mapInArrow(check, "row_no bigint, head boolean, record string")
    return whole.unionAll(cut)
