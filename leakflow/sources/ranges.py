"""Large text files by byte ranges: many tasks read one file, and every chunk knows its first line."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakflow.sources.files import AHEAD, CHUNK, FRAGMENTS

#: Chunks of a range: what a task reads, and holds, at a time.
RANGE_CHUNKS = 64
_BLANK = re.compile(rb"\n[ \t\r\x0b\x0c]*\n")


def _cut(data: bytes, at: int, whole: int, first: int, ahead: int) -> int:
    """Where the chunk before offset ``at`` of a file of ``whole`` bytes ends: where two line ends follow each other, else ``ahead`` bytes later and not inside a character. ``data`` begins at offset ``first``."""
    if at <= 0 or at >= whole:
        return max(0, min(at, whole))
    m = _BLANK.search(data, at - 1 - first, min(at + ahead, whole) - first)
    if m:
        return first + m.end()
    end = min(at + ahead, whole)
    while end < whole and data[end - first] & 0xC0 == 0x80 and end < at + ahead + 3:
        end += 1
    return end


def _chunks(path: str, whole: int, number: int, size: int, ahead: int, chunks: int) -> Iterator[bytes]:
    """The chunks of range ``number`` of a file. Each ends at a border that only depends on its place, so ranges need nothing of each other."""
    store, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    nth, last = number * chunks, min((number + 1) * chunks, -(-whole // size))
    first = max(0, nth * size - 1)
    with store.open_input_file(at) as f:
        f.seek(first)
        data = f.read(min(whole, last * size + ahead + 4) - first)
    start = _cut(data, nth * size, whole, first, ahead)
    for k in range(nth + 1, last + 1):
        end = _cut(data, k * size, whole, first, ahead)
        if end > start:
            yield data[start - first : end - first]
        start = max(start, end)


def file_ranges(spark: SparkSession, path: str, size: int = CHUNK, chunks: int = RANGE_CHUNKS) -> DataFrame:
    """(path, length, number): the ranges of the files at ``path``, dealt evenly; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").filter("length > 0")
    ranges = files.withColumn("number", F.explode(F.sequence(F.lit(0), F.expr(f"cast((length - 1) div {size * chunks} as int)"))))
    return _dealt(ranges, ranges.count())


def _dealt(ranges: DataFrame, n: int) -> DataFrame:
    """Ranges are small rows and much work: they are dealt by number, so that they aren't put together again."""
    return ranges.repartition(max(1, min(n, 100_000)), "path", "number")


def range_fragments(spark: SparkSession, path: str, size: int = CHUNK, ahead: int = AHEAD, chunks: int = RANGE_CHUNKS) -> DataFrame:
    """(path, raw, start_line) of text files of any length, chunks of about ``size`` bytes.

    A file is read by as many tasks as it has ranges of ``chunks`` chunks, and
    twice: a first pass counts the lines of each range, whose running total
    (one row a range) is where the next one's begin. The chunks of a file are
    the same however long the ranges are. ``ahead`` has to be less than
    ``size``. Files have to be where ``pyarrow.fs`` can open them. Bytes that
    aren't UTF-8 become replacement signs; empty files have no chunk.
    """
    if ahead + 4 > size:
        raise ValueError("a chunk has to be longer than what is looked ahead")
    ranges = file_ranges(spark, path, size, chunks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [sum(c.count(b"\n") for c in _chunks(r["path"], r["length"], r["number"], size, ahead, chunks)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("number"), pa.array(lines, pa.int64())], names=["path", "number", "lines"])

    before = F.sum("lines").over(Window.partitionBy("path").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    begins = ranges.mapInArrow(count, "path string, number int, lines long").withColumn("first", F.coalesce(before, F.lit(0)) + 1).drop("lines")
    placed = _dealt(ranges.join(begins, ["path", "number"]), ranges.count())
    names = [f.split(" ")[0] for f in FRAGMENTS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                line = r["first"]
                for chunk in _chunks(r["path"], r["length"], r["number"], size, ahead, chunks):
                    yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), pa.array([chunk.decode("utf-8", "replace")]), pa.array([line], pa.int64())], names=names)
                    line += chunk.count(b"\n")

    return placed.select("path", "number", "length", "first").mapInArrow(read, FRAGMENTS)
