"""Export streams of version control as records, and records as streams.

A stream's records follow each other and data lengths are only known from the
record before, so one task reads one stream, piece by piece; many streams are
read in parallel.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGES = "array<struct<kind:string,mode:string,ref:string,path:string,new_path:string>>"
RECORDS = f"stream string, seq long, kind string, mark long, original_oid string, name string, author string, committer string, tagger string, encoding string, message string, parent string, merges array<string>, changes {CHANGES}, data binary"
_CHANGES = pa.list_(pa.struct([(c, pa.string()) for c in ("kind", "mode", "ref", "path", "new_path")]))
_SCHEMA = pa.schema([("stream", pa.string()), ("seq", pa.int64()), ("kind", pa.string()), ("mark", pa.int64()), *((c, pa.string()) for c in ("original_oid", "name", "author", "committer", "tagger", "encoding", "message", "parent")), ("merges", pa.list_(pa.string())), ("changes", _CHANGES), ("data", pa.binary())])
_CHANGE = re.compile(r"^(?:(M) (\d+) (\S+) (.*)|(D) (.*)|([RC]) (\"(?:[^\"\\]|\\.)*\"|\S+) (.*)|(deleteall))$", re.S)
_ESCAPES = {"n": 10, "t": 9, "r": 13, "a": 7, "b": 8, "f": 12, "v": 11, '"': 34, "\\": 92}


def unquote(path: str) -> str:
    """A path of the stream: quoted ones have escapes."""
    if not path.startswith('"'):
        return path
    body = path[1:-1] if path.endswith('"') and len(path) > 1 else path[1:]
    raw = re.sub(r"\\([0-7]{3})|\\(.)|([^\\]+)", lambda m: chr(int(m[1], 8)) if m[1] else chr(_ESCAPES.get(m[2], ord(m[2]))) if m[2] else m[3].encode().decode("latin-1"), body)
    return raw.encode("latin-1", "replace").decode("utf-8", "replace")


class _Lines:
    """Lines and counted bytes of a stream."""

    def __init__(self, read: Callable[[int], bytes]):
        self.read, self.held, self.at = read, b"", 0

    def _fill(self) -> bool:
        more = self.read(1 << 20)
        self.held, self.at = self.held[self.at :] + more, 0
        return bool(more)

    def line(self) -> str | None:
        while (end := self.held.find(b"\n", self.at)) < 0:
            if not self._fill():
                rest, self.held, self.at = self.held[self.at :], b"", 0
                return rest.decode("utf-8", "replace") if rest else None
        found, self.at = self.held[self.at : end], end + 1
        return found.decode("utf-8", "replace")

    def data(self, header: str) -> bytes:
        if header.startswith("data <<"):
            mark, lines = header[7:], []
            while (x := self.line()) is not None and x != mark:
                lines.append(x + "\n")
            return "".join(lines).encode()
        n = int(header[5:])
        while len(self.held) - self.at < n:
            if not self._fill():
                raise ValueError("the stream ends inside data")
        found, self.at = self.held[self.at : self.at + n], self.at + n
        if self.held[self.at : self.at + 1] == b"\n" or (self.at == len(self.held) and self._fill() and self.held[self.at : self.at + 1] == b"\n"):
            self.at += 1
        return found


def parse_stream(read: Callable[[int], bytes]) -> Iterator[dict]:
    """Records of a stream, of which ``read(n)`` gives the next bytes."""
    lines, line = _Lines(read), None
    line = lines.line()
    while line is not None:
        kind, _, rest = line.partition(" ")
        if kind in ("blob", "commit", "tag", "reset"):
            record: dict = {"kind": kind, "name": rest or None, "merges": [], "changes": []}
            line = lines.line()
            while line is not None:
                key, _, value = line.partition(" ")
                if key == "mark":
                    record["mark"] = int(value[1:])
                elif key == "original-oid":
                    record["original_oid"] = value
                elif key in ("author", "committer", "tagger", "encoding"):
                    record[key] = value
                elif key == "data":
                    raw = lines.data(line)
                    if kind == "blob":
                        record["data"] = raw
                        line = lines.line()
                        break
                    record["message"] = raw.decode("utf-8", "replace")
                elif key == "from":
                    record["parent"] = value
                elif key == "merge":
                    record["merges"].append(value)
                elif kind == "commit" and (m := _CHANGE.match(line)):
                    if m[1]:
                        change = ("M", m[2], m[3], unquote(m[4]), None)
                        if m[3] == "inline":
                            raise ValueError("inline data isn't read")
                    elif m[5]:
                        change = ("D", None, None, unquote(m[6]), None)
                    elif m[7]:
                        change = (m[7], None, None, unquote(m[8]), unquote(m[9]))
                    else:
                        change = ("deleteall", None, None, None, None)
                    record["changes"].append(dict(zip(("kind", "mode", "ref", "path", "new_path"), change)))
                elif line == "":
                    line = lines.line()
                    if kind != "commit" or line is None or not (_CHANGE.match(line) or line.startswith(("from ", "merge "))):
                        break
                    continue
                else:
                    break
                line = lines.line()
            yield record
        else:
            if line:
                yield {"kind": kind if kind in ("progress", "checkpoint", "feature", "option", "done") else "literal", "message": line, "merges": [], "changes": []}
            line = lines.line()


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """Records of the export files at ``path``, in order of ``seq`` within each stream."""
    files = spark.read.format("binaryFile").load(path).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
                with store.open_input_stream(at, compression=None) as stream:
                    rows: list[dict] = []
                    for seq, record in enumerate(parse_stream(stream.read)):
                        rows.append({"stream": name, "seq": seq} | record)
                        if len(rows) >= 500:
                            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return files.mapInArrow(run, RECORDS)


def serialized(records: DataFrame) -> DataFrame:
    """(stream, seq, raw): each record as the bytes that an import reads. Only columns: the data stay in the engine."""
    from leakflow.functions.commands import quote_path

    def line(prefix: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(prefix), value, F.lit("\n"))).otherwise(F.lit(""))

    mark = line("mark :", F.col("mark").cast("string"))
    oid = line("original-oid ", F.col("original_oid"))
    message = F.concat(F.lit("data "), F.octet_length(F.coalesce("message", F.lit(""))).cast("string"), F.lit("\n"), F.coalesce("message", F.lit("")), F.lit("\n"))
    change = lambda c: F.when(c["kind"] == "M", F.concat_ws(" ", c["kind"], c["mode"], c["ref"], quote_path(c["path"]))).when(c["kind"] == "D", F.concat(F.lit("D "), quote_path(c["path"]))).when(c["kind"].isin("R", "C"), F.concat_ws(" ", c["kind"], quote_path(c["path"]), quote_path(c["new_path"]))).otherwise(c["kind"])
    changes = F.array_join(F.transform("changes", lambda c: F.concat(change(c), F.lit("\n"))), "")
    merges = F.array_join(F.transform("merges", lambda m: F.concat(F.lit("merge "), m, F.lit("\n"))), "")
    name = F.coalesce("name", F.lit(""))
    root = F.when(F.col("parent").isNull() & (F.size("merges") == 0), F.concat(F.lit("reset "), name, F.lit("\n"))).otherwise(F.lit(""))
    commit = F.concat(root, F.lit("commit "), name, F.lit("\n"), mark, oid, line("author ", F.col("author")), line("committer ", F.col("committer")), line("encoding ", F.col("encoding")), message, line("from ", F.col("parent")), merges, changes, F.lit("\n"))
    tag = F.concat(F.lit("tag "), name, F.lit("\n"), mark, line("from ", F.col("parent")), oid, line("tagger ", F.col("tagger")), message)
    reset = F.concat(F.lit("reset "), name, F.lit("\n"), line("from ", F.col("parent")), F.lit("\n"))
    text = F.when(F.col("kind") == "commit", commit).when(F.col("kind") == "tag", tag).when(F.col("kind") == "reset", reset).otherwise(F.concat("message", F.lit("\n")))
    blob = F.concat(F.encode(F.concat(F.lit("blob\n"), mark, oid, F.lit("data "), F.octet_length(F.coalesce("data", F.encode(F.lit(""), "utf-8"))).cast("string"), F.lit("\n")), "utf-8"), F.coalesce("data", F.encode(F.lit(""), "utf-8")), F.encode(F.lit("\n"), "utf-8"))
    return records.select("stream", "seq", F.when(F.col("kind") == "blob", blob).otherwise(F.encode(text, "utf-8")).alias("raw"))


def replace_blobs(records: DataFrame, text_of: Callable[[Column], Column]) -> DataFrame:
    """Records whose text blobs went through ``text_of``; blobs with a NUL stay as they are."""
    binary = F.contains(F.decode("data", "iso-8859-1"), F.lit("\0")) | ~F.is_valid_utf8(F.col("data").cast("string"))
    return records.withColumn("data", F.when(F.col("data").isNotNull() & ~binary, F.encode(text_of(F.col("data").cast("string")), "utf-8")).otherwise(F.col("data")))


def rename_changes(records: DataFrame, path_of: Callable[[Column], Column]) -> DataFrame:
    """Records whose file changes went through ``path_of``; changes whose path becomes null go."""
    moved = F.transform("changes", lambda c: F.struct(c["kind"].alias("kind"), c["mode"].alias("mode"), c["ref"].alias("ref"), path_of(c["path"]).alias("path"), path_of(c["new_path"]).alias("new_path")))
    return records.withColumn("changes", F.filter(moved, lambda c: c["path"].isNotNull() | (c["kind"] == "deleteall")))
