"""Encoded parts of texts: finding and decoding them, with built-in functions for one pass and a small helper for repeated ones."""

from __future__ import annotations

import base64
import binascii
import bisect
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least length of runs that are taken for encodings.
HEX_RUN, BASE64_RUN = 32, 16
_PRINTABLE = r"^[\x09\x0a\x0d\x20-\x7e]+$"


def decode_hex(run: Column) -> Column:
    """The text of a hex run; empty if it has an odd length, no digit, or isn't printable."""
    text = F.decode(F.unhex(F.when((F.length(run) % 2 == 0) & run.rlike("^[0-9A-Fa-f]*[0-9][0-9A-Fa-f]*$"), run)), "utf-8")
    return F.coalesce(F.when(text.rlike(_PRINTABLE), text), F.lit(""))


def decode_base64(run: Column) -> Column:
    """The text of a base64 run, padded or URL-safe; empty if it has only letters or isn't printable."""
    plain = F.regexp_replace(F.translate(run, "-_", "+/"), "=+$", "")
    whole = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4))))
    good = run.rlike(r"[0-9+\-_/]") & (F.pmod(F.length(plain), F.lit(4)) != 1)
    text = F.decode(F.try_to_binary(F.when(good, whole), F.lit("base64")), "utf-8")
    return F.coalesce(F.when(text.rlike(_PRINTABLE), text), F.lit(""))


def decode_percent(run: Column) -> Column:
    """The text of a percent-encoded run, in which a plus stays a plus."""
    text = F.try_url_decode(F.replace(run, F.lit("+"), F.lit("%2B")))
    return F.coalesce(F.when(text.rlike(_PRINTABLE), text), F.lit(""))


#: Runs of hex digits and of code points are none if they are a part of a longer base64 run.
_APART, _ENDED = "(?<![A-Za-z0-9+/_-])", "(?![A-Za-z0-9+/_-])"


@functools.cache
def _kinds(hex_run: int) -> tuple[tuple[str, re.Pattern], ...]:
    return (
        ("percent", re.compile(r"%[0-9A-Fa-f]{2}(?:[^\n]*%[0-9A-Fa-f]{2})?")),
        ("unicode", re.compile(rf"{_APART}(?:U\+[0-9A-Fa-f]{{4}}\s?)+|(?:\\u[0-9A-Fa-f]{{4}})+")),
        ("hex", re.compile(rf"{_APART}[0-9A-Fa-f]{{{hex_run},}}+{_ENDED}")),
        ("base64", re.compile(rf"[A-Za-z0-9+/_-]{{{BASE64_RUN},}}={{0,2}}")),
    )


_SHOWN = re.compile(_PRINTABLE)


def _decoded(kind: str, run: str) -> str:
    try:
        if kind == "percent":
            raw = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), run.encode()).decode()
        elif kind == "unicode":
            raw = "".join(chr(int(h, 16)) for h in re.findall(r"(?:U\+|\\u)([0-9A-Fa-f]{4})", run))
        elif kind == "hex":
            raw = bytes.fromhex(run).decode() if re.search(r"\d", run) else ""
        else:
            plain = run.rstrip("=").translate(str.maketrans("-_", "+/"))
            raw = base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True).decode() if re.search(r"[0-9+\-_/]", run) else ""
    except (ValueError, binascii.Error, UnicodeDecodeError):
        return ""
    return raw if _SHOWN.match(raw) else ""


def decode_pass(text: str, segments: list[dict], depth: int, hex_run: int = HEX_RUN) -> tuple[str, list[dict]]:
    """One pass: each decodable run replaced. Segments say where in the decoded text they are, and from where in the original; of overlapping runs that of the earlier kind is taken."""
    starts, taken = [], []  # in order, and apart from each other
    for kind, rx in _kinds(hex_run):
        for m in rx.finditer(text):
            at = bisect.bisect_left(starts, m.end())
            if not at or taken[at - 1][1] <= m.start():
                starts.insert(at, m.start())
                taken.insert(at, (m.start(), m.end(), kind))
    out, size, at, found = [], 0, 0, []
    ends = [s["dec_start"] for s in segments]
    for a, b, kind in taken:
        value = _decoded(kind, text[a:b])
        if not value:
            continue
        out += [text[at:a], value]
        size += a - at
        found.append({"orig_start": _original(segments, ends, a, True), "orig_end": _original(segments, ends, b, False), "dec_start": size, "dec_end": size + len(value), "encoding": kind, "depth": depth})
        size += len(value)
        at = b
    return "".join([*out, text[at:]]), found


def _original(segments: list[dict], starts: list[int], at: int, start: bool) -> int:
    """An offset of the decoded text in the original one; within a segment its near edge. ``starts``: where the segments begin in the decoded text."""
    i = (bisect.bisect_right if start else bisect.bisect_left)(starts, at) - 1
    if i < 0:
        return at
    s = segments[i]
    if at < s["dec_end"] or (at == s["dec_end"] and not start):
        return s["orig_start"] if start else s["orig_end"]
    return at + s["orig_end"] - s["dec_end"]


SEGMENTS = "array<struct<orig_start:int,orig_end:int,dec_start:int,dec_end:int,encoding:string,depth:int>>"


def decode_fragments(frags: DataFrame, max_depth: int = 3, keep: tuple[str, ...] = (), hex_run: int = HEX_RUN) -> DataFrame:
    """(fragment_id, ``keep``, depth, raw, segments): each fragment after 1, 2, .. passes, while a pass still changes it. ``hex_run``: the least length of hex runs.

    The lineage of nested encodings is recursive, so this part runs in
    Arrow-batched workers, a text at a time. Offsets are in code points.
    """
    source = frags.select(F.col("raw"), F.col("fragment_id"), *keep)
    kind = pa.list_(pa.struct([("orig_start", pa.int32()), ("orig_end", pa.int32()), ("dec_start", pa.int32()), ("dec_end", pa.int32()), ("encoding", pa.string()), ("depth", pa.int32())]))
    names = [*source.columns[1:], "depth", "raw", "segments"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, rows = [], []
            for i, text in enumerate(batch.column(0)):
                text = text.as_py() or ""
                segments: list[dict] = []
                for depth in range(1, max_depth + 1):
                    text, segments = decode_pass(text, segments, depth, hex_run)
                    if not segments:
                        break
                    where.append(i)
                    rows.append((depth, text, segments))
            kept = batch.select(batch.schema.names[1:]).take(pa.array(where, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), kind)))], names=names)

    types = ", ".join(f"{n} {t}" for n, t in source.dtypes[1:])
    return source.mapInArrow(run, f"{types}, depth int, raw string, segments {SEGMENTS}")


def decode_tags(segments: Column) -> Column:
    """``decoded:kind`` for each kind, and ``decode-depth:n``."""
    kinds = F.array_sort(F.array_distinct(F.transform(segments, lambda s: F.concat(F.lit("decoded:"), s["encoding"]))))
    return F.concat(kinds, F.array(F.concat(F.lit("decode-depth:"), F.array_max(F.transform(segments, lambda s: s["depth"])).cast("string"))))


def overlapping(segments: Column, start: Column, end: Column) -> Column:
    """Segments whose decoded range overlaps a match."""
    return F.filter(segments, lambda s: (s["dec_start"] < end) & (start < s["dec_end"]))
