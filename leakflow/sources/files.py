"""Files, archives and diffs as fragments."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakflow.operators.rules import SKIPPED_PATHS

#: Bytes of a chunk, bytes looked ahead for its end, and bytes looked at for a NUL.
CHUNK, AHEAD, SNIFF = 100_000, 25_000, 8_192
#: Bytes of chunks that a task holds before it hands them on.
HELD = 4 << 20
SKIPPED_DIRS = [".git", ".svn", ".hg", "node_modules", "vendor", "third_party"]

#: First bytes of archive formats.
MAGIC = {"zip": b"PK\x03\x04", "gzip": b"\x1f\x8b", "bzip2": b"BZh", "xz": b"\xfd7zXZ\x00", "zstd": b"\x28\xb5\x2f\xfd", "7z": b"7z\xbc\xaf\x27\x1c", "rar": b"Rar!\x1a\x07", "lz4": b"\x04\x22\x4d\x18"}
SUFFIXES = {".zip": "zip", ".jar": "zip", ".tar": "tar", ".gz": "gzip", ".tgz": "gzip", ".bz2": "bzip2", ".xz": "xz", ".zst": "zstd", ".7z": "7z", ".rar": "rar", ".br": "brotli", ".lz4": "lz4"}


def read_files(spark: SparkSession, path: str, max_bytes: int = 10 << 20, skipped_paths: list[str] | None = None, skipped_dirs: list[str] | None = None) -> DataFrame:
    """(path, length, content) below a folder: neither empty nor larger than ``max_bytes`` nor skipped. Size limits reach the source; contents are read only for what is left."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter((F.col("length") > 0) & (F.col("length") <= max_bytes))
    dirs = "|".join(re.escape(d) for d in (SKIPPED_DIRS if skipped_dirs is None else skipped_dirs))
    patterns = SKIPPED_PATHS if skipped_paths is None else skipped_paths
    skip = F.col("path").rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)
    return files.filter(~skip & ~F.col("path").rlike(rf"/(?:{dirs})/") if dirs else ~skip).select("path", "length", "content")


def is_binary(content: Column, sniff: int = SNIFF) -> Column:
    """A NUL among the first bytes."""
    return F.contains(F.decode(F.substring(content, 1, sniff), "iso-8859-1"), F.lit("\0"))


def chunk_bytes(data: bytes, size: int = CHUNK, ahead: int = AHEAD) -> Iterator[tuple[int, bytes]]:
    """(first line, chunk): chunks of about ``size`` bytes that end where two line ends follow each other, at most ``ahead`` bytes later, so that a secret isn't cut."""
    at, line = 0, 1
    blank = re.compile(rb"\n[ \t\r\x0b\x0c]*\n")
    while at < len(data):
        end = min(at + size, len(data))
        if end < len(data):
            m = blank.search(data, max(at, end - 1), min(end + ahead, len(data)))
            end = m.end() if m else min(end + ahead, len(data))
            while end < len(data) and data[end] & 0xC0 == 0x80 and end - at < size + ahead + 3:  # not inside a character
                end += 1
        yield line, data[at:end]
        line += data.count(b"\n", at, end)
        at = end


FRAGMENTS = "path string, raw string, start_line long"


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def file_fragments(files: DataFrame, size: int = CHUNK, skip_binary: bool = False, max_archive_depth: int = 0, numbered: bool = False) -> DataFrame:
    """(path, raw, start_line) from (path, content): chunks of texts, and of archives' entries up to a depth. Bytes that aren't UTF-8 become replacement signs. ``numbered`` adds ``number``, a chunk's place in its text from 0: chunks of one long line have the same ``start_line``."""
    schema = pa.schema([("path", pa.string()), ("raw", pa.string()), ("start_line", pa.int64()), *([("number", pa.int64())] if numbered else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for name, data in unpack(path, content or b"", max_archive_depth):
                    if skip_binary and b"\0" in data[:SNIFF]:
                        continue
                    for number, (line, chunk) in enumerate(chunk_bytes(data, size)):
                        rows.append((name, chunk.decode("utf-8", "replace"), line, number))
                        held += len(chunk)
                        if held >= HELD:
                            yield _rows(rows, schema)
                            rows, held = [], 0
        yield _rows(rows, schema)

    return files.select("path", "content").mapInArrow(run, FRAGMENTS + ", number long" * numbered)


def identify(path: str, head: bytes) -> str | None:
    """The archive format: by first bytes, else by the name's end."""
    for name, magic in MAGIC.items():
        if head.startswith(magic):
            return name
    if head[257:262] == b"ustar":
        return "tar"
    return next((f for s, f in SUFFIXES.items() if path.lower().endswith(s)), None)


def unpack(path: str, data: bytes, depth: int) -> Iterator[tuple[str, bytes]]:
    """(path, bytes) of a file, or of the entries of an archive; an entry's path follows its archive's and an exclamation mark. Broken archives yield nothing, formats without a codec here are taken as files."""
    kind = identify(path, data[:512]) if depth > 0 else None
    try:
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                entries = [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir() and not re.search(r"^/|(^|/)\.\.(/|$)", i.filename)]
        elif kind == "tar":
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                entries = [(m.name, t.extractfile(m).read()) for m in t if m.isfile()]
        elif kind in ("gzip", "bzip2", "xz"):
            inner = {"gzip": gzip, "bzip2": bz2, "xz": lzma}[kind].decompress(data)
            name = re.sub(r"(?i)\.(?:gz|bz2|xz)$", "", re.sub(r"(?i)\.(?:tgz|tbz2?|txz)$", ".tar", re.split("[/!]", path)[-1]))
            entries = [(name, inner)]
        else:
            yield path, data
            return
    except (OSError, EOFError, ValueError, zipfile.BadZipFile, tarfile.TarError, lzma.LZMAError, zipfile.LargeZipFile, NotImplementedError, RuntimeError):
        return
    for name, content in entries:
        yield from unpack(f"{path}!{name}", content, depth - 1)


HUNKS = "commit string, author_name string, author_email string, date string, message string, old_path string, new_path string, is_new boolean, is_delete boolean, is_rename boolean, is_binary boolean, old_start long, old_lines long, new_start long, new_lines long, added string, removed string, context string"
_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_HUNK_SCHEMA = pa.schema([(c.split(" ")[0], {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64()}[c.split(" ")[1]]) for c in HUNKS.split(", ")])


def parse_diff(text: str) -> list[tuple]:
    """A row for each hunk, and one for each file without hunks, of ``log -p`` or ``diff`` output."""
    rows: list[tuple] = []
    head = {"commit": "", "name": "", "email": "", "date": "", "message": ""}
    file: dict | None = None
    hunk: dict | None = None

    def close_hunk() -> None:
        nonlocal hunk
        if hunk and file is not None:
            rows.append((head["commit"], head["name"], head["email"], head["date"], head["message"].strip("\n"), file["old"], file["new"], file["is_new"], file["is_delete"], file["is_rename"], file["is_binary"], *hunk["at"], *("".join(hunk[s]) for s in "+- ")))
            file["hunks"] += 1
        hunk = None

    def close_file() -> None:
        nonlocal file
        close_hunk()
        if file is not None and not file["hunks"]:
            rows.append((head["commit"], head["name"], head["email"], head["date"], head["message"].strip("\n"), file["old"], file["new"], file["is_new"], file["is_delete"], file["is_rename"], file["is_binary"], None, None, None, None, "", "", ""))
        file = None

    left = [0, 0]
    for line in text.split("\n"):
        if hunk is not None and (left[0] > 0 or left[1] > 0) and line[:1] in ("+", "-", " ", ""):
            sign = line[:1] or " "
            hunk[sign].append(line[1:] + "\n")
            left[0] -= sign in "- "
            left[1] -= sign in "+ "
        elif line.startswith("\\ No newline") and hunk is not None:
            pass
        elif line.startswith("commit ") and re.fullmatch(r"commit [0-9a-f]{7,64}.*", line):
            close_file()
            head = {"commit": line.split(" ")[1], "name": "", "email": "", "date": "", "message": ""}
        elif line.startswith("Author: ") and file is None:
            m = re.match(r"Author:\s+(.*?)\s*<([^>]*)>", line)
            head["name"], head["email"] = m.groups() if m else (line[8:].strip(), "")
        elif line.startswith("Date: ") and file is None:
            head["date"] = line[5:].strip()
        elif line.startswith("diff --git "):
            close_file()
            m = re.match(r"diff --git a/(.*) b/(.*)$", line)
            file = {"old": m[1] if m else "", "new": m[2] if m else "", "is_new": False, "is_delete": False, "is_rename": False, "is_binary": False, "hunks": 0}
        elif file is None:
            head["message"] += line[4:] + "\n" if line.startswith("    ") else ""
        elif m := _HUNK.match(line):
            close_hunk()
            at = [int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)]
            left = [at[1], at[3]]
            hunk = {"at": at, "+": [], "-": [], " ": []}
        elif line.startswith("new file"):
            file["is_new"] = True
        elif line.startswith("deleted file"):
            file["is_delete"] = True
        elif line.startswith("rename "):
            file["is_rename"] = True
        elif line.startswith("Binary files") or line.startswith("GIT binary patch"):
            file["is_binary"] = True
    close_file()
    return rows


def diff_hunks(texts: DataFrame, column: str = "text") -> DataFrame:
    """The hunks of diff texts, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield _rows(parse_diff(text or ""), _HUNK_SCHEMA)

    return texts.select(column).mapInArrow(run, HUNKS)


def hunk_fragments(hunks: DataFrame) -> DataFrame:
    """Added text of hunks as fragments with their commit; deleted and binary files are left out."""
    return hunks.filter(~F.col("is_delete") & ~F.col("is_binary") & (F.length("added") > 0)).select(F.xxhash64("commit", "new_path", "new_start").alias("fragment_id"), F.col("added").alias("raw"), F.col("new_start").alias("start_line"), F.col("new_path").alias("path"), "commit", "author_name", "author_email", "date", "message")
