"""Version-control object files as tables: loose objects, packs, trees, commits, the staging index and references."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Type numbers of packed objects, and modes of entries that are read.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
OFFSET_DELTA, REF_DELTA = 6, 7
MODES = {b"40000": "tree", b"040000": "tree", b"100644": "blob", b"100755": "blob"}

OBJECTS = "oid string, kind string, content binary"
_OBJECTS = pa.schema([("oid", pa.string()), ("kind", pa.string()), ("content", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def inflate(data: bytes, limit: int, at: int = 0) -> tuple[bytes, int] | None:
    """(inflated, bytes used) from ``at`` on; None if it is larger than ``limit`` or broken. Fed in pieces, so what follows isn't copied."""
    d, out, view, end = zlib.decompressobj(), bytearray(), memoryview(data), at
    try:
        while not d.eof and end < len(view) and len(out) <= limit:
            piece = view[end : end + (1 << 16)]
            out += d.decompress(piece, limit + 1 - len(out))
            end += len(piece) - len(d.unused_data) - len(d.unconsumed_tail)
    except zlib.error:
        return None
    return (bytes(out), end - at) if d.eof and len(out) <= limit else None


def loose_objects(spark: SparkSession, git_dir: str, limit: int = 64 << 20) -> DataFrame:
    """(oid, kind, content) of the object files below ``git_dir``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{git_dir}/objects").filter(F.col("path").rlike("/[0-9a-f]{2}/[0-9a-f]{38}$"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if found := inflate(raw, limit):
                    head, _, body = found[0].partition(b"\0")
                    rows.append(("".join(path.rsplit("/", 2)[-2:]), head.split(b" ")[0].decode(), body))
            yield _batch(rows, _OBJECTS)

    return files.select("path", "content").mapInArrow(run, OBJECTS)


def index_offsets(idx: bytes) -> dict[int, str]:
    """offset -> oid of a version 2 pack index."""
    if idx[:8] != b"\xfftOc\0\0\0\2":
        raise ValueError("not a version 2 pack index")
    n = struct.unpack(">I", idx[8 + 255 * 4 : 8 + 256 * 4])[0]
    names, small = 8 + 1024, 8 + 1024 + 24 * n
    large = small + 4 * n
    found = {}
    for i in range(n):
        off = struct.unpack_from(">I", idx, small + 4 * i)[0]
        if off >> 31:
            off = struct.unpack_from(">Q", idx, large + 8 * (off & 0x7FFFFFFF))[0]
        found[off] = idx[names + 20 * i : names + 20 * i + 20].hex()
    return found


def _size(data: bytes, at: int) -> tuple[int, int]:
    size = shift = 0
    while True:
        b = data[at]
        at += 1
        size |= (b & 0x7F) << shift
        shift += 7
        if not b & 0x80:
            return size, at


def apply_delta(base: bytes, delta: bytes) -> bytes | None:
    """A delta's copies and insertions; None if it doesn't fit its base."""
    want, at = _size(delta, 0)
    size, at = _size(delta, at)
    if want != len(base):
        return None
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 0x80:
            off = n = 0
            for i in range(7):
                if op >> i & 1:
                    if i < 4:
                        off |= delta[at] << 8 * i
                    else:
                        n |= delta[at] << 8 * (i - 4)
                    at += 1
            n = n or 0x10000
            if off + n > len(base):
                return None
            out += base[off : off + n]
        elif op:
            out += delta[at : at + op]
            at += op
        else:
            return None
    return bytes(out) if len(out) == size else None


def pack_objects(pack: bytes, idx: bytes, limit: int = 64 << 20, max_depth: int = 64) -> Iterator[tuple[str, str, bytes]]:
    """(oid, kind, content) of a pack; deltas are resolved within it."""
    offsets = index_offsets(idx)
    by_oid = {v: k for k, v in offsets.items()}
    known: dict[int, tuple[int, bytes]] = {}

    def read(off: int, depth: int) -> tuple[int, bytes] | None:
        if off in known:
            return known[off]
        if depth > max_depth:
            return None
        b = pack[off]
        kind, at = b >> 4 & 7, off + 1
        while b & 0x80:
            b = pack[at]
            at += 1
        base = None
        if kind == OFFSET_DELTA:
            b = pack[at]
            at += 1
            back = b & 0x7F
            while b & 0x80:
                b = pack[at]
                at += 1
                back = (back + 1) << 7 | b & 0x7F
            base = off - back
        elif kind == REF_DELTA:
            base = by_oid.get(pack[at : at + 20].hex())
            at += 20
            if base is None:
                return None
        body = inflate(pack, limit, at)
        if body is None:
            return None
        if base is None:
            found = (kind, body[0])
        else:
            under = read(base, depth + 1)
            made = under and apply_delta(under[1], body[0])
            if made is None or under is None:
                return None
            found = (under[0], made)
        known[off] = found
        return found

    for off, oid in offsets.items():
        if (found := read(off, 0)) and found[0] in KINDS:
            yield oid, KINDS[found[0]], found[1]


def packed_objects(spark: SparkSession, git_dir: str, limit: int = 64 << 20) -> DataFrame:
    """(oid, kind, content) of all packs; a pack and its index are joined by name and read by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "pack-*").load(f"{git_dir}/objects/pack")
    stem = F.regexp_replace("path", r"\.(?:pack|idx)$", "")
    packs = files.filter(F.col("path").endswith(".pack")).select(stem.alias("stem"), F.col("content").alias("pack"))
    indexes = files.filter(F.col("path").endswith(".idx")).select(stem.alias("stem"), F.col("content").alias("idx"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, idx in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                for row in pack_objects(pack, idx, limit):
                    rows.append(row)
                    if len(rows) == 500:
                        yield _batch(rows, _OBJECTS)
                        rows = []
                yield _batch(rows, _OBJECTS)

    return packs.join(indexes, "stem").select("pack", "idx").mapInArrow(run, OBJECTS)


def objects(loose: DataFrame, packed: DataFrame) -> DataFrame:
    """Loose and packed objects together, each id once."""
    return loose.unionByName(packed.join(loose.select("oid"), "oid", "left_anti")).dropDuplicates(["oid"])


def parse_tree(content: bytes) -> list[tuple[str, str, str]]:
    """(name, oid, kind) of a tree's files and folders; links and submodules are left out."""
    at, found = 0, []
    while at < len(content):
        space, nul = content.index(b" ", at), content.index(b"\0", at)
        if kind := MODES.get(content[at:space]):
            found.append((content[space + 1 : nul].decode("utf-8", "replace"), content[nul + 1 : nul + 21].hex(), kind))
        at = nul + 21
    return found


def tree_entries(objects_: DataFrame) -> DataFrame:
    """(tree_oid, name, oid, kind) of all trees."""
    schema = pa.schema([("tree_oid", pa.string()), ("name", pa.string()), ("oid", pa.string()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(tree, *e) for tree, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for e in parse_tree(c)], schema)

    return objects_.filter("kind = 'tree'").select("oid", "content").mapInArrow(run, "tree_oid string, name string, oid string, kind string")


def commits(objects_: DataFrame) -> DataFrame:
    """(oid, tree, parents, date, is_signed, message) of all commits."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    head, message = F.substring_index(text, "\n\n", 1), F.substr(text, F.locate("\n\n", text) + 2, F.length(text))
    return objects_.filter("kind = 'commit'").select(
        "oid", F.regexp_extract(head, "(?m)^tree ([0-9a-f]{40})", 1).alias("tree"), F.regexp_extract_all(head, F.lit("(?m)^parent ([0-9a-f]{40})"), F.lit(1)).alias("parents"),
        F.regexp_extract(head, r"(?m)^committer .* (-?\d+) [+-]\d{4}$", 1).try_cast("long").alias("date"), head.rlike("(?m)^gpgsig(?:-sha256)? ").alias("is_signed"), message.alias("message"),
    )


#: What begins the signature of a tag.
SIGNATURES = ["-----BEGIN PGP SIGNATURE-----", "-----BEGIN SSH SIGNATURE-----"]


def is_signed_tag(text: Column) -> Column:
    """The text of a tag object holds a signature, valid or not."""
    return F.contains(text, F.lit(SIGNATURES[0])) | F.contains(text, F.lit(SIGNATURES[1]))


def tags(objects_: DataFrame) -> DataFrame:
    """(oid, object, kind, tag, is_signed, message) of all annotated tags; ``kind`` is that of the object."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    head, message = F.substring_index(text, "\n\n", 1), F.substr(text, F.locate("\n\n", text) + 2, F.length(text))
    told = lambda field, value: F.regexp_extract(head, f"(?m)^{field} ({value})$", 1)
    return objects_.filter("kind = 'tag'").select("oid", told("object", "[0-9a-f]{40}").alias("object"), told("type", "[a-z]+").alias("kind"), told("tag", ".*").alias("tag"), is_signed_tag(text).alias("is_signed"), message.alias("message"))


INDEX = "path string, oid string"


def parse_index(data: bytes) -> list[tuple[str, str]]:
    """(path, oid) of staged regular files, of index versions 2 to 4."""
    if data[:4] != b"DIRC":
        raise ValueError("not an index")
    version, n = struct.unpack_from(">II", data, 4)
    at, previous, found = 12, b"", []
    for _ in range(n):
        mode = struct.unpack_from(">I", data, at + 24)[0]
        oid, flags = data[at + 40 : at + 60].hex(), struct.unpack_from(">H", data, at + 60)[0]
        p = at + 62 + (2 if version >= 3 and flags & 0x4000 else 0)
        if version == 4:
            b = data[p]
            p += 1
            strip = b & 0x7F
            while b & 0x80:
                b = data[p]
                p += 1
                strip = (strip + 1) << 7 | b & 0x7F
            end = data.index(b"\0", p)
            name = previous[: len(previous) - strip] + data[p:end]
            at = end + 1
        else:
            end = data.index(b"\0", p)
            name = data[p:end]
            at += (end - at + 8) // 8 * 8
        previous = name
        if not flags >> 12 & 3 and mode >> 12 == 0o10:
            found.append((name.decode("utf-8", "replace"), oid))
    return found


def staged_files(spark: SparkSession, git_dir: str) -> DataFrame:
    """(path, oid) of the staging index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                yield _batch(parse_index(raw), pa.schema([("path", pa.string()), ("oid", pa.string())]))

    return spark.read.format("binaryFile").load(f"{git_dir}/index").select("content").mapInArrow(run, INDEX)


def references(spark: SparkSession, git_dir: str) -> DataFrame:
    """(ref, oid) of loose and packed references; a loose one hides a packed one, and one that names another takes its id."""
    base = git_dir.rstrip("/")
    loose = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{base}/refs").select(F.regexp_extract("path", "/(refs/.*)$", 1).alias("ref"), F.trim(F.regexp_replace(F.decode("content", "utf-8"), r"\s+$", "")).alias("value"))
    head = spark.read.format("binaryFile").load(f"{base}/HEAD").select(F.lit("HEAD").alias("ref"), F.regexp_replace(F.decode("content", "utf-8"), r"\s+$", "").alias("value"))
    lines = spark.read.format("binaryFile").option("pathGlobFilter", "packed-refs").load(base).select(F.explode(F.split(F.decode("content", "utf-8"), "\n")).alias("line")).filter(F.col("line").rlike("^[0-9a-f]{40} "))
    packed = lines.select(F.substr("line", F.lit(42), F.length("line")).alias("ref"), F.left("line", F.lit(40)).alias("value"))
    both = loose.unionByName(packed.join(loose, "ref", "left_anti")).unionByName(head)
    plain = both.filter(F.col("value").rlike("^[0-9a-f]{40}$")).select("ref", F.col("value").alias("oid"))
    named = both.filter(F.col("value").startswith("ref: ")).select("ref", F.substr("value", F.lit(6), F.length("value")).alias("target"))
    return plain.unionByName(named.join(plain.withColumnRenamed("ref", "target"), "target").select("ref", "oid"))
