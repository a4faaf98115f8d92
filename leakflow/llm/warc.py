"""WARC archives: one gzip member for each record, written and read sequentially."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakflow.llm.staging import arrow_rows, new_path, stage

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
_READ = 1 << 18
#: Pages carry no time of their own.
DATE = "1970-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("5b0c8c7e-6c1e-5f5e-9d0a-3f1f6f0c2a10")
#: Salts of a payload that several pages share.
SALTS = 32


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder, and the path in it. Hadoop writes file:/ and s3a:// where this library has file:/// and s3://."""
    uri = re.sub("^file:/+", "file:///", path) if ":" in path else f"file://{path}"
    return fs.FileSystem.from_uri(re.sub("^s3a://", "s3://", uri))


def _line_safe(value: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in value)


def _id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, name)}>"


def response_id(page_id: int | None, url: str | None, payload_digest: str) -> str:
    """The record id of a response that revisits refer to: the same wherever it is asked for."""
    return _id(f"{page_id} {url} {payload_digest}")


def _member_of(fields: dict[str, str | None], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields.items() if v is not None)]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines) + _END + block + _END) + packer.flush()


def info(name: str, date: str = DATE) -> bytes:
    """The record that opens an archive."""
    block = b"software: leakflow\r\nformat: WARC File Format 1.1\r\n"
    return _member_of({"WARC-Type": "warcinfo", "WARC-Record-ID": _id(f"{name} info"), "WARC-Date": date, "WARC-Filename": name, "WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Type": "application/warc-fields", "Content-Length": str(len(block))}, block)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, refers_url: str | None = None, record_id: str | None = None, refers_id: str | None = None, date: str = DATE) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP header only, whose Content-Length is the payload's; it names the response's target, date and, where given, record."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block, payload_digest = head if revisit else head + payload, digest(payload)
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id or response_id(page_id, url, payload_digest),
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else _line_safe(url),
        "WARC-Payload-Digest": f"sha1:{payload_digest}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": refers_id if revisit else None,
        "WARC-Refers-To-Target-URI": _line_safe(refers_url) if revisit and refers_url is not None else None,
        "WARC-Refers-To-Date": date if revisit else None,
        "Page-ID": None if page_id is None else str(page_id),
        "Refers-To-Page-ID": None if refers_to is None else str(refers_to),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    return _member_of(fields, block)


@dataclass
class Record:
    """A record as read: its header fields, and length, digest and (if asked for) bytes of what the HTTP block carries."""

    fields: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload_bytes: int = 0
    payload_digest: str = ""
    payload: bytes | None = None


def _headers(raw: bytes) -> tuple[bytes, dict[str, str]]:
    first, *rest = raw.split(b"\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (line.decode("utf-8", "replace").partition(":") for line in rest)}


#: The longest header that is read. Names of records can be as long as a text, so this only stops what isn't an archive.
HEADER_BYTES = 1 << 28


class _Member:
    """Inflated bytes of one gzip member, on demand."""

    def __init__(self, source: Callable[[int], bytes], waiting: bytes):
        self.source, self.waiting, self.held = source, waiting, b""
        self.inflater = zlib.decompressobj(31)

    def more(self) -> bool:
        """Inflates some more; False at the end of the member."""
        if self.inflater.eof:
            return False
        data = self.inflater.unconsumed_tail or self.waiting or self.source(_READ)
        if not self.inflater.unconsumed_tail:
            self.waiting = b""
        if not data:
            raise ValueError("the archive ends inside a gzip member")
        self.held += self.inflater.decompress(data, 4 * _READ)
        if self.inflater.eof:
            self.waiting = self.inflater.unused_data
        return True

    def until(self, mark: bytes, limit: int = HEADER_BYTES) -> bytes:
        looked = 0
        while (at := self.held.find(mark, looked)) < 0:
            looked = max(0, len(self.held) - len(mark) + 1)
            if len(self.held) > limit or not self.more():
                raise ValueError("a header has no end")
        found, self.held = self.held[:at], self.held[at + len(mark) :]
        return found

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            while not self.held:
                if not self.more():
                    raise ValueError("a record is shorter than its Content-Length")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            yield part


def read_records(source: Callable[[int], bytes], with_payload: bool = False) -> Iterator[Record]:
    """Records of an archive, of which ``source(n)`` gives the next n bytes at most. Lengths and digests are verified; a fault raises ValueError."""
    waiting = source(_READ)
    while waiting:
        member = _Member(source, waiting)
        version, fields = _headers(member.until(_END))
        if not version.startswith(b"WARC/"):
            raise ValueError("a record doesn't start with a WARC version")
        left = int(fields["content-length"])
        whole, body, size, kept = hashlib.sha1(), hashlib.sha1(), 0, []
        http = fields.get("content-type", "").startswith("application/http")
        head: bytes | None = b"" if http else None
        found = Record(fields)
        for part in member.exactly(left):
            whole.update(part)
            if head is not None:
                head += part
                if _END not in head:
                    continue
                raw, _, part = head.partition(_END)
                found.http, head = _headers(raw)[1], None
            body.update(part)
            size += len(part)
            if with_payload:
                kept.append(part)
        if "".join(p.decode("latin-1") for p in member.exactly(4)) != "\r\n\r\n":
            raise ValueError("a record isn't followed by two line ends")
        while member.more():
            pass
        if member.held:
            raise ValueError("a gzip member holds more than a record")
        text = lambda h: base64.b32encode(h.digest()).decode()
        if fields.get("warc-block-digest", "").removeprefix("sha1:") not in ("", text(whole)):
            raise ValueError(f"block digest of {fields.get('warc-record-id')} differs")
        stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        if fields["warc-type"] == "revisit":
            found.payload_bytes, found.payload_digest = int(found.http.get("content-length", 0)), stated
        else:
            found.payload_bytes, found.payload_digest = size, text(body)
            if stated not in ("", found.payload_digest):
                raise ValueError(f"payload digest of {fields.get('warc-record-id')} differs")
        found.payload = b"".join(kept) if with_payload else None
        yield found
        waiting = member.waiting or source(_READ)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to, revisit, refers_url, named) of pages (page_id, url, html): payloads of at least ``min_bytes`` that equal that of a page with a larger id are revisits of the largest.

    ``named``: there is one such response only, so its record id can be told from the page.
    """
    keyed = pages.withColumn("bytes_", F.octet_length("html")).withColumn("sum_", F.sha1(F.encode("html", "utf-8")))
    # one row for each page first, so that a payload that is everywhere meets only distinct pages
    each = keyed.filter(F.col("bytes_") >= min_bytes).groupBy("sum_", "bytes_", "page_id", "url").agg(F.count("*").alias("n_"))
    order = F.struct(F.col("page_id").isNotNull().alias("given"), "page_id", "url", "n_")
    shared = each.groupBy("sum_", "bytes_").agg(F.max(order).alias("top_"), F.sum("n_").alias("all_")).filter("all_ > 1")
    shared = shared.select("sum_", "bytes_", F.col("top_.page_id").alias("refers_to"), F.col("top_.url").alias("refers_url"), (F.col("top_.n_") == 1).alias("named"))
    salted = shared.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = keyed.withColumn("salt_", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = left.join(salted, ["sum_", "bytes_", "salt_"], "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    one = F.coalesce(F.col("named") & (revisit | F.col("url").eqNullSafe(F.col("refers_url"))), F.lit(False))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("refers_to")).alias("refers_to"), revisit.alias("revisit"), "refers_url", one.alias("named"))


def write_archives(pages: DataFrame, path: str, max_bytes: int = 32 << 20) -> DataFrame:
    """Writes the pages of ``with_revisits`` to archives of about ``max_bytes`` under ``path``; returns their (file, n_records, n_bytes).

    Each attempt of a task writes files of its own names, so that a repeated
    task leaves the others' files alone; only files in the returned table
    count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = open_store(path)
        store.create_dir(at, recursive=True)
        out, name, n, size, done = None, "", 0, 0, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{at}/{name}", compression=None)
                    out.write(info(name))
                page, url, html, refers_to, revisit, refers_url, named = row
                payload = html.encode()
                # the file's name is new for each attempt, so ids made of it are unique
                own = None if named and not revisit else _id(f"{name} {n}")
                target = response_id(refers_to, refers_url, digest(payload)) if named and revisit else None
                member = record(page, url, payload, refers_to, revisit, refers_url, own, target)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= max_bytes:
                    out.close()
                    done.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "n_records", "n_bytes"])

    with arrow_rows(pages.sparkSession, 500):
        return stage(pages.select("page_id", "url", "html", "refers_to", "revisit", "refers_url", "named").mapInArrow(run, "file string, n_records long, n_bytes long"), "archives")


def read_archives(archives: DataFrame, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url for each record of the ``archives`` (column file) under ``path``. An archive is read by one task, piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = open_store(path)
        number = lambda x: None if x is None else int(x)
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with store.open_input_stream(f"{at}/{name}", compression=None) as stream:
                    for r in read_records(stream.read):
                        if r.fields["warc-type"] not in ("response", "revisit"):
                            continue
                        rows.append((number(r.fields.get("page-id")), r.payload_bytes, r.payload_digest, r.fields["warc-type"], number(r.fields.get("refers-to-page-id")), r.fields.get("warc-target-uri")))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    files = archives.select("file").repartition(max(1, archives.count()))
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def round_trip(pages: DataFrame, min_bytes: int = 0, path: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archives ``pages`` under ``path`` (by default a new folder in the shared one) and reads them back: a row for each page.

    A null html is an empty payload, and a null url leaves out the target.
    Of equal payloads the largest page_id is the response; rows that repeat
    that id are responses too, and a page without an id revisits it. An empty
    table writes no archive and returns no row. Payloads are read in pieces,
    urls of any length up to HEADER_BYTES as a whole.
    """
    spark: SparkSession = pages.sparkSession
    path = path or new_path(spark, "warc")
    plain = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    return read_archives(write_archives(with_revisits(plain, min_bytes), path), path)
