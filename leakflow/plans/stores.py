"""Queries that write archives, object stores, staging indexes, references and export streams to the shared folder and read them again.

Texts of ``documents`` are what is stored. Tasks write the files, one set for
each Arrow batch, under names that a repeated task writes again; SQL says from
the table alone what reading them must give.
"""

from __future__ import annotations

import bz2
import gzip
import hashlib
import io
import lzma
import os.path
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakflow.functions import places
from leakflow.operators import graph
from leakflow.plans.registry import query, read
from leakflow.session import new_path, staged
from leakflow.sources import fastexport, files, objects, ranges


def _written(rows: DataFrame, label: str, build: Callable[[list[tuple], str], Iterator[tuple[str, bytes]]], folder: str = "") -> str:
    """The new folder to which tasks wrote the (name, bytes) that ``build(rows, number)`` gives for each batch. ``folder`` in it is there even if there are no rows."""
    path = new_path(rows.sparkSession, label)
    target = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
    target.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).mkdirs(target)
    uri = re.sub(r"^file:/+", "file:///", path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(uri)
        part = TaskContext.get().partitionId()
        for n, batch in enumerate(batches):
            for name, data in build(list(zip(*(c.to_pylist() for c in batch.columns))), f"{part}-{n}"):
                store.create_dir(f"{at}/{name}".rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{at}/{name}", compression=None) as out:
                    out.write(data)
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    rows.mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
    return path


def _texts(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


_DOCS_SQL = "docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"

# --- archives


def _zipped(entries: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def _tarred(name: str, data: bytes) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def _archive(rows: list[tuple], number: str) -> Iterator[tuple[str, bytes]]:
    """A zip of plain files and of archives, once more in a folder of vendored code, and an empty file."""
    entries = []
    for doc_id, text in rows:
        raw, name = text.encode(), f"d{doc_id}.txt"
        entries.append(
            [(name, raw), (f"{name}.gz", gzip.compress(raw, mtime=0)), (f"{name}.bz2", bz2.compress(raw)), (f"{name}.xz", lzma.compress(raw, preset=0)), (f"d{doc_id}.tar", _tarred(f"in/{name}", raw)), (f"d{doc_id}.zip", _zipped([(name, raw), ("../out.txt", raw)]))][doc_id % 6]
        )
    whole = _zipped(entries)
    yield f"src/a-{number}.zip", whole
    yield f"vendor/a-{number}.zip", whole
    yield f"src/empty-{number}.txt", b""


_ENTRY = "CASE doc_id % 6 WHEN 0 THEN name WHEN 1 THEN name || '.gz!' || name WHEN 2 THEN name || '.bz2!' || name WHEN 3 THEN name || '.xz!' || name WHEN 4 THEN 'd' || doc_id || '.tar!in/' || name ELSE 'd' || doc_id || '.zip!' || name END"


@query("archive_entries", f"WITH {_DOCS_SQL}, named AS (SELECT *, 'd' || doc_id || '.txt' AS name FROM docs WHERE text <> '') SELECT {_ENTRY} AS path, strlen(text)::BIGINT AS n_bytes, sha256(text) AS sha256 FROM named")
def archive_entries(spark, sf_dir):
    """Texts out of archives in archives; paths that leave the archive, vendored folders and empty files yield nothing."""
    path = _written(_texts(spark, sf_dir), "archives", _archive)
    found = files.file_fragments(files.read_files(spark, path, max_bytes=1 << 30, skipped_paths=[]), size=1 << 30, max_archive_depth=2)
    return found.select(F.regexp_extract("path", r"a-[0-9]+-[0-9]+\.zip!(.*)$", 1).alias("path"), F.octet_length("raw").cast("long").alias("n_bytes"), F.sha2("raw", 256).alias("sha256"))


@query("binary_sniff", f"WITH {_DOCS_SQL} SELECT doc_id, doc_id % 2 = 1 AND strlen(text) < 8192 AS in_scan, doc_id % 2 = 1 AND strlen(text) < 8000 AS in_gate FROM docs")
def binary_sniff(spark, sf_dir):
    """Every other text has a NUL at its end, which counts where it is near enough to the start."""
    content = F.encode(F.concat("text", F.when(F.col("doc_id") % 2 == 1, F.lit("\0")).otherwise(F.lit(""))), "utf-8")
    return _texts(spark, sf_dir).select("doc_id", files.is_binary(content).alias("in_scan"), files.is_binary(content, 8000).alias("in_gate"))


_SUFFIXES = ["", ".gz", ".TGZ", ".tbz2", ".xz", ".zip", ".zst"]


@query("unpacked_names", "SELECT page_id, url || '!' || page_id || CASE page_id % 7 WHEN 2 THEN '.tar' WHEN 3 THEN '.tar' WHEN 5 THEN '.zip' ELSE '' END AS path FROM pages")
def unpacked_names(spark, sf_dir):
    suffix = F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("page_id") % len(_SUFFIXES) + 1).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", places.full_path(F.col("url"), places.strip_compression(F.concat(F.col("page_id").cast("string"), suffix))).alias("path"))


# --- objects


def _utf8(*parts: Column | str) -> Column:
    return F.encode(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)), "utf-8")


def _oid(kind: str, body: Column) -> Column:
    return F.sha1(F.concat(_utf8(f"{kind} ", F.octet_length(body).cast("string")), F.unhex(F.lit("00")), body))


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _delta(base: bytes, body: bytes) -> bytes:
    """The common beginning copied, the rest inserted."""
    n = min(len(os.path.commonprefix([base, body])), 0xFFFF)
    out = bytearray(_number(len(base)) + _number(len(body)))
    if n:
        out += bytes([0x80 | 0x10 | 0x20]) + struct.pack("<H", n)
    for at in range(n, len(body), 127):
        piece = body[at : at + 127]
        out += bytes([len(piece)]) + piece
    return bytes(out)


def _packed(rows: list[tuple[str, str, bytes]]) -> tuple[bytes, bytes]:
    """A pack and its index: of three objects one is whole, one an offset delta and one a delta by id."""
    codes = {v: k for k, v in objects.KINDS.items()}
    pack, offsets = bytearray(b"PACK" + struct.pack(">II", 2, len(rows))), []
    for i, (oid, kind, body) in enumerate(rows):
        offsets.append(len(pack))
        code, base, data = codes[kind], b"", body
        if i % 3:
            data = _delta(rows[i - 1][2], body)
            code = objects.OFFSET_DELTA if i % 3 == 1 else objects.REF_DELTA
            base = bytes.fromhex(rows[i - 1][0])
            if i % 3 == 1:
                back = offsets[i] - offsets[i - 1]
                tail = [back & 0x7F]
                while back := back >> 7:
                    back -= 1
                    tail.append(0x80 | back & 0x7F)
                base = bytes(reversed(tail))
        size = len(data)
        first, size = code << 4 | size & 15, size >> 4
        pack += (bytes([first | 0x80]) + _number(size) if size else bytes([first])) + base + zlib.compress(data)
    pack += hashlib.sha1(pack).digest()
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    heads = [int(rows[i][0][:2], 16) for i in order]
    counts = [sum(h <= x for h in heads) for x in range(256)]
    idx = b"\xfftOc\0\0\0\2" + struct.pack(">256I", *counts) + b"".join(bytes.fromhex(rows[i][0]) for i in order) + bytes(4 * len(rows)) + struct.pack(f">{len(rows)}I", *(offsets[i] for i in order))
    return bytes(pack), idx + pack[-20:] + hashlib.sha1(idx + pack[-20:]).digest()


def _store(rows: list[tuple], number: str) -> Iterator[tuple[str, bytes]]:
    """All objects in a pack; those whose id begins with a zero also as loose files."""
    pack, idx = _packed(rows)
    yield f"objects/pack/pack-{number}.pack", pack
    yield f"objects/pack/pack-{number}.idx", idx
    for oid, kind, body in rows:
        if oid.startswith("0"):
            yield f"objects/{oid[:2]}/{oid[2:]}", zlib.compress(f"{kind} {len(body)}\0".encode() + body)


def _read_back(bodies: DataFrame, kind: str) -> DataFrame:
    """Objects with these bodies, written as packs and loose files and read again."""
    made = bodies.select(_oid(kind, F.col("body")).alias("oid"), F.lit(kind).alias("kind"), "body").dropDuplicates(["oid"])
    path = _written(made, f"{kind}s", _store, "objects/pack")
    return objects.objects(objects.loose_objects(bodies.sparkSession, path), objects.packed_objects(bodies.sparkSession, path))


def _oid_sql(kind: str, body: str) -> str:
    return f"sha1(encode('{kind} ' || octet_length({body})) || unhex('00') || {body})"


_BLOB_SQL = f"blobs AS (SELECT doc_id, text, {_oid_sql('blob', 'encode(text)')} AS blob FROM docs)"
_TREE_BODY = "encode('100644 a é') || unhex('00') || unhex(blob) || encode('120000 link') || unhex('00') || unhex(blob) || encode('40000 sub') || unhex('00') || unhex(sha1(blob))"
_TREE_SQL = f"trees AS (SELECT doc_id, blob, {_oid_sql('tree', f'({_TREE_BODY})')} AS tree FROM blobs)"


def _blobs(spark, sf_dir) -> DataFrame:
    docs = _texts(spark, sf_dir).withColumn("body", F.encode("text", "utf-8"))
    return docs.select("doc_id", "body", _oid("blob", F.col("body")).alias("blob"))


def _trees(spark, sf_dir) -> DataFrame:
    nul = F.unhex(F.lit("00"))
    blob = F.unhex("blob")
    body = F.concat(_utf8("100644 a é"), nul, blob, _utf8("120000 link"), nul, blob, _utf8("40000 sub"), nul, F.unhex(F.sha1("blob")))
    return _blobs(spark, sf_dir).select("doc_id", "blob", body.alias("body"), _oid("tree", body).alias("tree"))


@query("object_blobs", f"WITH {_DOCS_SQL}, {_BLOB_SQL} SELECT DISTINCT blob AS oid, 'blob' AS kind, strlen(text)::BIGINT AS n_bytes, sha256(text) AS sha256 FROM blobs")
def object_blobs(spark, sf_dir):
    found = _read_back(_blobs(spark, sf_dir), "blob")
    return found.select("oid", "kind", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


@query("object_trees", f"WITH {_DOCS_SQL}, {_BLOB_SQL}, {_TREE_SQL} SELECT DISTINCT tree AS tree_oid, 'a é' AS name, blob AS oid, 'blob' AS kind FROM trees UNION ALL SELECT DISTINCT tree, 'sub', sha1(blob), 'tree' FROM trees")
def object_trees(spark, sf_dir):
    """Links are left out of a tree's entries."""
    return objects.tree_entries(_read_back(_trees(spark, sf_dir), "tree"))


_COMMIT_BODY = """encode('tree ' || tree || chr(10) || CASE WHEN doc_id % 3 > 0 THEN 'parent ' || blob || chr(10) ELSE '' END || CASE WHEN doc_id % 3 > 1 THEN 'parent ' || tree || chr(10) ELSE '' END
 || 'author Ä B <a@b.c> 1 +0000' || chr(10) || 'committer C <c@d> ' || (1700000000 + doc_id) || ' -0530' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN 'gpgsig -----BEGIN' || chr(10) || ' x' || chr(10) ELSE '' END || chr(10) || 'change ' || doc_id || chr(10) || chr(10) || 'tree of é' || chr(10))"""


@query(
    "object_commits",
    f"""WITH {_DOCS_SQL}, {_BLOB_SQL}, {_TREE_SQL}, bodies AS (SELECT doc_id, blob, tree, {_COMMIT_BODY} AS body FROM trees)
    SELECT {_oid_sql('commit', 'body')} AS oid, tree, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN blob ELSE blob || ' ' || tree END AS parents, 1700000000 + doc_id AS date, doc_id % 5 = 0 AS is_signed, 'change ' || doc_id || chr(10) || chr(10) || 'tree of é' || chr(10) AS message FROM bodies""",
)
def object_commits(spark, sf_dir):
    made = _trees(spark, sf_dir)
    n = F.col("doc_id")
    some = lambda when, *parts: F.when(when, F.concat(*parts)).otherwise(F.lit(""))
    head = [F.lit("tree "), F.col("tree"), F.lit("\n"), some(n % 3 > 0, F.lit("parent "), F.col("blob"), F.lit("\n")), some(n % 3 > 1, F.lit("parent "), F.col("tree"), F.lit("\n"))]
    people = [F.lit("author Ä B <a@b.c> 1 +0000\ncommitter C <c@d> "), (n + 1700000000).cast("string"), F.lit(" -0530\n"), some(n % 5 == 0, F.lit("gpgsig -----BEGIN\n x\n"))]
    body = _utf8(*head, *people, F.lit("\nchange "), n.cast("string"), F.lit("\n\ntree of é\n"))
    return objects.commits(_read_back(made.select(body.alias("body")), "commit")).withColumn("parents", F.array_join("parents", " "))


_PGP, _SSH = objects.SIGNATURES


@query(
    "signed_history",
    f"""WITH RECURSIVE d AS (SELECT doc_id AS k, coalesce(text, '') AS t FROM documents), e AS (SELECT k AS oid, k // 2 AS parent FROM d WHERE k > 0 UNION SELECT k, k // 3 FROM d WHERE k > 0),
    r AS (SELECT k AS oid FROM d WHERE k % 100 = 99 UNION SELECT e.parent FROM e JOIN r USING (oid))
    SELECT 'commit' AS kind, count(*)::BIGINT AS n, count(*) FILTER (k % 5 = 0)::BIGINT AS n_signed FROM d JOIN r ON k = oid
    UNION ALL SELECT 'tag', count(*)::BIGINT, count(*) FILTER (k % 3 < 2 OR contains(t, '{_PGP}') OR contains(t, '{_SSH}'))::BIGINT FROM d WHERE k % 4 = 1""",
)
def signed_history(spark, sf_dir):
    """Texts as messages of commits and tags, some of them signed, some with bytes that aren't UTF-8; what a rewrite of all that the references reach would invalidate."""
    k = F.col("doc_id")
    oid = lambda c, letter="": F.sha1(_utf8(letter, c.cast("string")))
    parent = lambda n: F.concat(F.lit("parent "), oid(F.expr(f"doc_id div {n}")), F.lit("\n"))
    some = lambda when, x: F.when(when, x).otherwise(F.lit(""))
    head = _utf8("tree ", oid(k, "t"), "\n", some(k > 0, F.concat(parent(2), parent(3))), "author ")
    rest = _utf8(" <a@b> 1 +0000\ncommitter C <c@d> 2 +0000\n", some(k % 5 == 0, F.lit("gpgsig -----BEGIN\n x\n")), some(k % 5 == 1, F.lit("\ngpgsig in a message\n")), "\n", F.col("text"))
    name = F.when(k % 7 == 0, F.unhex(F.lit("E9FF"))).otherwise(_utf8("é"))
    docs = _texts(spark, sf_dir)
    commit = docs.select(oid(k).alias("oid"), F.lit("commit").alias("kind"), F.concat(head, name, rest).alias("content"))
    block = F.when(k % 3 == 0, F.lit(f"\n{_PGP}\nx")).when(k % 3 == 1, F.lit(f"\n{_SSH}\nx")).otherwise(F.lit(""))
    tag = docs.select(oid(k, "v").alias("oid"), F.lit("tag").alias("kind"), _utf8("object ", oid(k), "\ntype commit\ntag v", k.cast("string"), "\ntagger T <t@t> 1 +0000\n\n", F.col("text"), block).alias("content"))
    # every other tag has a second reference; heads that point at tags name none
    named = lambda when, prefix: docs.filter(when).select(F.concat(F.lit(prefix), k.cast("string")).alias("ref"), oid(k, "v").alias("oid"))
    refs = named(k % 4 == 1, "refs/tags/v").unionByName(named(k % 8 == 1, "refs/tags/again/v")).unionByName(named(k % 4 == 2, "refs/heads/v"))
    stored = commit.unionByName(tag)
    commits = staged(objects.commits(stored).select("oid", "parents", "is_signed"), "commits")
    return graph.signed_counts(commits, objects.tags(stored), refs, docs.filter(k % 100 == 99).select(oid(k).alias("oid")))


# --- large files


@query(
    "file_ranges",
    """SELECT coalesce(source, 'none') AS file, doc_id, (1 + coalesce(sum(length(t) - length(replace(t, chr(10), '')) + 3) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS line
    FROM (SELECT source, doc_id, coalesce(text, '') AS t FROM documents)""",
)
def file_ranges(spark, sf_dir):
    """The documents of each source as one file, read by ranges: on which line of its file each begins."""
    docs = read(spark, sf_dir, "documents")
    home = new_path(spark, "large")
    rows = docs.select(F.coalesce("source", F.lit("none")).alias("s"), "doc_id", F.concat(F.lit("#doc:"), F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("value"))
    rows.repartition("s").sortWithinPartitions("s", "doc_id").select("s", "value").write.partitionBy("s").text(home)
    chunks = ranges.range_fragments(spark, home, size=40_000, ahead=10_000)
    lines = chunks.select("path", "start_line", F.posexplode(F.split("raw", "\n", -1)).alias("at", "x")).filter(F.col("x").rlike("^#doc:[0-9]+$"))
    return lines.select(F.regexp_extract("path", "/s=([^/]*)/", 1).alias("file"), F.substr("x", F.lit(6)).cast("long").alias("doc_id"), (F.col("start_line") + F.col("at")).alias("line"))


# --- staging index and references


def _index(rows: list[tuple], number: str) -> Iterator[tuple[str, bytes]]:
    """Indexes of versions 2, 3 and 4. Some entries are conflicts, some links."""
    for version in (2, 3, 4):
        mine = sorted((f"d/{doc_id:09}".encode(), doc_id, blob) for doc_id, blob in rows if doc_id % 3 == version - 2)
        out, before = bytearray(b"DIRC" + struct.pack(">II", version, len(mine))), b""
        for name, doc_id, blob in mine:
            more = version == 3 and doc_id % 2 == 0
            mode = 0o120000 if doc_id % 11 == 0 else 0o100644
            flags = (0x4000 if more else 0) | (2 << 12 if doc_id % 7 == 0 else 0) | len(name)
            entry = struct.pack(">10I", 0, 0, 0, 0, 0, 0, mode, 0, 0, 0) + bytes.fromhex(blob) + struct.pack(">H", flags) + (b"\0\0" if more else b"")
            if version == 4:
                same = len(os.path.commonprefix([before, name]))
                out += entry + bytes([len(before) - same]) + name[same:] + b"\0"
            else:
                out += entry + name + bytes(8 - (len(entry) + len(name)) % 8)
            before = name
        yield f"r{number}-{version}/index", bytes(out) + hashlib.sha1(out).digest()


@query("staged_index", f"WITH {_DOCS_SQL}, {_BLOB_SQL} SELECT 'd/' || lpad(doc_id::VARCHAR, 9, '0') AS path, blob AS oid, strlen(text)::BIGINT AS n_bytes FROM blobs WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0")
def staged_index(spark, sf_dir):
    """Staged regular files without conflicts, with the sizes of their objects."""
    blobs = _blobs(spark, sf_dir)
    path = _written(blobs.select("doc_id", "blob"), "indexes", _index, "r/index")
    sizes = blobs.select(F.col("blob").alias("oid"), F.octet_length("body").cast("long").alias("n_bytes")).distinct()
    return objects.staged_files(spark, f"{path}/*").join(sizes, "oid").select("path", "oid", "n_bytes")


def _refs(rows: list[tuple], number: str) -> Iterator[tuple[str, bytes]]:
    """One repository: packed references, loose ones that hide some of them, a symbolic one and HEAD."""
    lines = [f"{packed} refs/heads/b{n}\n" + (f"^{loose}\n" if n % 4 == 0 else "") for n, packed, loose in sorted(rows)]
    yield "packed-refs", ("# pack-refs with: peeled\n" + "".join(lines)).encode()
    yield "HEAD", b"ref: refs/heads/b0\n"
    yield "refs/remotes/origin/HEAD", b"ref: refs/heads/b1\n"
    for n, _, loose in rows:
        if n % 5 == 0:
            yield f"refs/heads/b{n}", f"{loose}\n".encode()


@query("reference_tips", "WITH r AS (SELECT n_nationkey AS n, sha1(CASE WHEN n_nationkey % 5 = 0 THEN 'l' ELSE 'p' END || n_nationkey) AS oid FROM nation) SELECT 'refs/heads/b' || n AS ref, oid FROM r UNION ALL SELECT 'HEAD', oid FROM r WHERE n = 0 UNION ALL SELECT 'refs/remotes/origin/HEAD', oid FROM r WHERE n = 1")
def reference_tips(spark, sf_dir):
    """Nations as branches: one repository has one packed file, so one task writes it."""
    number = F.col("n_nationkey").cast("string")
    rows = read(spark, sf_dir, "nation").select("n_nationkey", F.sha1(_utf8("p", number)).alias("packed"), F.sha1(_utf8("l", number)).alias("loose")).coalesce(1)
    return objects.references(spark, _written(rows, "references", _refs))


# --- export streams

_WORD, _MARK = "the", "***"
_EXPORT_SQL = f"""WITH {_DOCS_SQL}, named AS (SELECT doc_id, replace(text, '{_WORD}', '{_MARK}') AS changed, 'new/' || doc_id || ' é"' || chr(10) || 'x' AS path FROM docs)
SELECT doc_id, 'blob' AS kind, 2 * doc_id + 1 AS mark, NULL AS name, NULL AS author, sha256(changed) AS content, NULL AS changes FROM named
UNION ALL SELECT doc_id, 'commit', 2 * doc_id + 2, 'refs/heads/d' || doc_id, 'Ä B <a@b.c> ' || doc_id || ' +0000', 'change ' || doc_id || chr(10) || chr(10) || 'data 3' || chr(10), 'deleteall' || chr(9) || 'M 100644 :' || (2 * doc_id + 1) || ' ' || path || chr(9) || 'R ' || path || ' new/b' FROM named
UNION ALL SELECT doc_id, 'tag', -1, 't' || doc_id, NULL, 'a tag', '' FROM named
UNION ALL SELECT doc_id, 'reset', -1, 'refs/heads/r' || doc_id, NULL, ':' || (2 * doc_id + 2), '' FROM named"""


def _records(docs: DataFrame) -> DataFrame:
    """A blob, a commit, a tag and a reset for each text, in this order within its partition."""
    number, nothing = F.col("doc_id").cast("string"), F.lit(None).cast("string")
    mark = lambda k: (F.col("doc_id") * 2 + k).cast("long")
    path = F.concat(F.lit("old/"), number, F.lit(' é"\nx'))
    change = lambda kind, mode=nothing, ref=nothing, at=nothing, to=nothing: F.struct(F.lit(kind).alias("kind"), mode.alias("mode"), ref.alias("ref"), at.alias("path"), to.alias("new_path"))
    changes = F.array(change("deleteall"), change("M", F.lit("100644"), F.concat(F.lit(":"), mark(1).cast("string")), path), change("D", at=F.lit("gone/a")), change("R", at=path, to=F.lit("old/b")))
    to = F.concat(F.lit(":"), mark(2).cast("string"))
    values = {
        "blob": {"mark": mark(1), "data": F.encode("text", "utf-8")},
        "commit": {"mark": mark(2), "name": F.concat(F.lit("refs/heads/d"), number), "author": F.concat(F.lit("Ä B <a@b.c> "), number, F.lit(" +0000")), "committer": F.lit("C <c@d> 1 +0000"), "message": F.concat(F.lit("change "), number, F.lit("\n\ndata 3\n")), "parent": F.concat(F.lit(":"), mark(0).cast("string")), "changes": changes},
        "tag": {"name": F.concat(F.lit("t"), number), "parent": to, "tagger": F.lit("T <t@t> 1 +0000"), "message": F.lit("a tag")},
        "reset": {"name": F.concat(F.lit("refs/heads/r"), number), "parent": to},
    }
    types = dict(c.split(" ", 1) for c in re.split(r", (?=[a-z_]+ )", fastexport.RECORDS))
    empty = {"merges": F.array().cast(types["merges"]), "changes": F.array().cast(types["changes"]), "stream": F.lit(""), "seq": F.lit(0).cast("long")}
    one = lambda kind, own: F.struct(*((own | {"kind": F.lit(kind)}).get(c, empty.get(c, F.lit(None).cast(types[c]))).cast(types[c]).alias(c) for c in types))
    return docs.select(F.explode(F.array(*(one(k, v) for k, v in values.items()))).alias("r")).select("r.*")


@query("export_streams", _EXPORT_SQL)
def export_streams(spark, sf_dir):
    """Texts as export streams, one a partition and batch, read again and changed: words replaced, paths moved and removed."""
    raw = fastexport.serialized(_records(_texts(spark, sf_dir))).select("raw")
    path = _written(raw, "exports", lambda rows, number: iter([(f"stream-{number}", b"".join(r[0] for r in rows))]))
    records = staged(fastexport.read_exports(spark, path), "records").filter("kind <> 'reset' or parent is not null")
    moved = fastexport.rename_changes(fastexport.replace_blobs(records, lambda t: F.replace(t, F.lit(_WORD), F.lit(_MARK))), lambda p: F.when(p.isNull() | p.startswith("old/"), F.regexp_replace(p, "^old/", "new/")))
    shown = F.array_join(F.transform("changes", lambda c: F.concat_ws(" ", c["kind"], c["mode"], c["ref"], c["path"], c["new_path"])), "\t")
    content = F.when(F.col("kind") == "blob", F.sha2("data", 256)).when(F.col("kind") == "reset", F.col("parent")).otherwise(F.col("message"))
    doc_id = F.coalesce((F.col("mark") - 1 - (F.col("kind") == "commit").cast("long")) / 2, F.regexp_extract("name", "([0-9]+)$", 1).try_cast("double")).cast("long")
    return moved.select(doc_id.alias("doc_id"), "kind", F.coalesce("mark", F.lit(-1)).alias("mark"), "name", "author", content.alias("content"), F.when(F.col("kind") != "blob", shown).alias("changes"))
