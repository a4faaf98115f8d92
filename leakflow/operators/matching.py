"""Where a pattern matches: offsets, lines and windows, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,match:string,secret:string>"
LOCATED = "struct<start:int,end:int,match:string,start_line:int,end_line:int,start_column:int,end_column:int,allowed:boolean,line:string,context:string>"
#: Elements of a block, and levels of blocks of blocks, in a running combination.
BLOCK, LEVELS = 64, 3


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, zero: Column, combine: Callable[[Column, Column], Column], levels: int = LEVELS) -> Column:
    """Each element combined, by an associative function with a neutral ``zero``, with all before it.

    A fold copies its state for every element, so one that gathers values
    costs the square of their number. Here blocks are combined first, then
    what stands before each block, and within a block each element with those
    before it: some thirty steps an element and level.
    """
    if not levels:
        return named(values, lambda v: F.transform(v, lambda x, i: F.aggregate(F.slice(v, 1, i + 1), zero, combine)))
    block = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(v, b * BLOCK + 1, BLOCK), zero, combine))
    place = lambda i: F.floor(i / BLOCK).cast("int")

    def spread(v: Column) -> Column:
        before = F.when(F.size(v) > BLOCK, running(block(v), zero, combine, levels - 1)).otherwise(F.slice(v, 1, 0))
        return named(before, lambda p: F.transform(v, lambda x, i: F.aggregate(F.slice(v, place(i) * BLOCK + 1, i % BLOCK + 1), F.when(i >= BLOCK, F.get(p, place(i) - 1)).otherwise(zero), combine)))

    return named(values, spread)


#: More patterns than this make more code than a generated method can hold, so they are interpreted.
CODED_PATTERNS = 16


class Patterns:
    """A list of patterns of which ``number`` says the one for a row. Each stays a literal, so it is compiled once; which one it is takes as many comparisons as the list has binary digits."""

    def __init__(self, number: Column, patterns: list[str]):
        self.number, self.patterns = number, patterns

    def _choose(self, use: Callable[[str], Column], number: Column, first: int, last: int) -> Column:
        if last - first == 1:
            return use(self.patterns[first])
        middle = (first + last) // 2
        return F.when(number < middle, self._choose(use, number, first, middle)).otherwise(self._choose(use, number, middle, last))

    def of(self, use: Callable[[str], Column]) -> Column:
        """``use`` of the row's pattern."""
        n = len(self.patterns)
        if n > CODED_PATTERNS:  # functions of array elements are interpreted
            return named(self.number, lambda number: self._choose(use, number, 0, n))
        return self._choose(use, self.number, 0, n)


def spans(text: Column, pattern: Column | str, group: Column | int = 0) -> Column:
    """array<struct<start, end, match, secret>> in code points, left to right.

    A match ends after the pieces between matches and the matches up to it.
    The secret is the group, or for group 0 the whole match. A text without
    matches is read once.
    """
    rx = F.lit(pattern) if isinstance(pattern, str) else pattern

    def made(whole: Column) -> Column:
        part = whole if isinstance(group, int) and not group else F.regexp_extract_all(text, rx, F.lit(group) if isinstance(group, int) else group)
        sizes = F.zip_with(F.slice(F.split(text, rx, -1), 1, F.size(whole)), whole, lambda p, m: F.length(p) + F.length(m))
        rows = F.arrays_zip(running(sizes, F.lit(0), lambda a, b: a + b).alias("end"), whole.alias("match"), part.alias("secret"))
        found = F.transform(rows, lambda r: F.struct((r["end"] - F.length(r["match"])).alias("start"), r["end"].alias("end"), r["match"].alias("match"), r["secret"].alias("secret")))
        return F.when(F.size(whole) > 0, found.cast(f"array<{SPAN}>")).otherwise(F.array().cast(f"array<{SPAN}>"))

    return F.coalesce(named(F.regexp_extract_all(text, rx, F.lit(0)), made), F.array().cast(f"array<{SPAN}>"))


def _extent(part: Column) -> Column:
    """Of a part of a text: characters, line feeds, and bytes after the last of these."""
    return F.struct(F.length(part).alias("chars"), newlines(part).alias("feeds"), F.octet_length(F.substring_index(part, "\n", -1)).alias("bytes"))


def _joined(a: Column, b: Column) -> Column:
    """The extent of two parts, one behind the other."""
    return F.struct((a["chars"] + b["chars"]).alias("chars"), (a["feeds"] + b["feeds"]).alias("feeds"), F.when(b["feeds"] > 0, b["bytes"]).otherwise(a["bytes"] + b["bytes"]).alias("bytes"))


def located(text: Column, pattern: Column | str | None, markers: list[str], with_line: bool = False, context: int = 0, whole: Column | None = None, pieces: Column | None = None) -> Column:
    """array of LOCATED: matches without the line feeds at their ends, with 0-based lines and the columns of ``start_column`` and ``end_column``.

    ``allowed``: a line of the match holds a marker. ``line`` and ``context``
    are the lines touched, and those with ``context`` more on both sides; they
    are null unless asked for. Lines and columns run along with the matches,
    so a text of very many matches is read a fixed number of times. ``whole``
    and ``pieces`` are the matches and what is split by them, where these are
    known already.
    """
    if whole is None:
        rx = F.lit(pattern) if isinstance(pattern, str) else pattern
        whole, pieces = F.regexp_extract_all(text, rx, F.lit(0)), F.split(text, rx, -1)
    parts = F.zip_with(F.slice(pieces, 1, F.size(whole)), whole, lambda p, m: F.struct(_extent(p).alias("before"), m.alias("whole")))
    nothing = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("feeds"), F.lit(0).alias("bytes"))
    ends = lambda parts: running(F.transform(parts, lambda r: _joined(r["before"], _extent(r["whole"]))), nothing, _joined)
    # where a match begins: behind the match before it and the piece between them
    begun = lambda parts, e: F.transform(parts, lambda r, i: F.struct(_joined(F.when(i > 0, F.get(e, i - 1)).otherwise(nothing), r["before"]).alias("at"), r["whole"].alias("whole"), F.regexp_replace(r["whole"], r"\n+$", "").alias("match")))
    lines = F.split(text, "\n", -1)
    extra = F.struct((F.transform(lines, lambda x: is_allowed(x, markers)) if markers else F.array().cast("array<boolean>")).alias("flags"), (lines if with_line or context else F.array().cast("array<string>")).alias("lines"))
    one = F.lit(1)  # after the first line the line feed counts as a column

    def made(r: Column, more: Column) -> Column:
        at = r["at"]
        to = _joined(at, _extent(r["match"]))
        touched = lambda name, n: F.slice(more[name], F.greatest(at["feeds"] - n, F.lit(0)) + 1, to["feeds"] - at["feeds"] + 1 + n + F.least(at["feeds"], F.lit(n)))
        return F.struct(
            at["chars"].alias("start"), to["chars"].alias("end"), r["match"].alias("match"),
            (at["feeds"] + F.when(F.startswith(r["whole"], F.lit("\n")), 1).otherwise(0)).alias("start_line"), to["feeds"].alias("end_line"),
            (at["bytes"] + F.when(at["feeds"] > 0, one).otherwise(0) + 1).alias("start_column"), (to["bytes"] + F.when(to["feeds"] > 0, one).otherwise(0)).alias("end_column"),
            (F.exists(touched("flags", 0), lambda x: x) if markers else F.lit(False)).alias("allowed"),
            (F.array_join(touched("lines", 0), "\n") if with_line else F.lit(None).cast("string")).alias("line"),
            (F.array_join(touched("lines", context), "\n") if context else F.lit(None).cast("string")).alias("context"),
        )

    rows = named(parts, lambda p: named(ends(p), lambda e: begun(p, e)))
    found = named(extra, lambda more: F.transform(rows, lambda r: made(r, more)))
    return F.when(F.size(whole) > 0, found.cast(f"array<{LOCATED}>")).otherwise(F.array().cast(f"array<{LOCATED}>"))


def newlines(text: Column) -> Column:
    """How many line feeds a text has."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def start_line(raw: Column, start: Column) -> Column:
    """0-based line of an offset; one at a line feed belongs to the next line."""
    return newlines(F.left(raw, start + 1))


def end_line(raw: Column, end: Column) -> Column:
    return newlines(F.left(raw, end))


def _line_offset(raw: Column, upto: Column) -> Column:
    """Bytes from the line feed before, which counts, to ``upto``; on the first line from the beginning."""
    head = F.left(raw, upto)
    tail = F.octet_length(F.substring_index(head, "\n", -1))
    return F.when(F.contains(head, F.lit("\n")), tail + 1).otherwise(tail)


def start_column(raw: Column, start: Column) -> Column:
    """1-based bytes. After the first line the line feed counts as a column, so columns are one larger there."""
    return _line_offset(raw, start) + 1


def end_column(raw: Column, end: Column) -> Column:
    return _line_offset(raw, end)


def line_around(raw: Column, start: Column, end: Column) -> Column:
    """The lines that a span touches, without the line feeds around them."""
    before = F.substring_index(F.left(raw, start), "\n", -1)
    after = F.substring_index(F.substr(raw, end + 1, F.length(raw)), "\n", 1)
    return F.concat(before, F.substr(raw, start + 1, end - start), after)


def column_window(raw: Column, start: Column, end: Column, before: int, after: int) -> Column:
    """The span with up to ``before`` and ``after`` characters around it."""
    first = F.greatest(start - before, F.lit(0))
    return F.substr(raw, first + 1, end + after - first)


def line_window(raw: Column, start: Column, end: Column, before: int, after: int) -> Column:
    """The span's lines and up to ``before`` and ``after`` lines around them."""
    lines = F.split(raw, "\n", -1)
    first = F.greatest(start_line(raw, start) - before, F.lit(0))
    last = F.least(end_line(raw, end) + after, F.size(lines) - 1)
    return F.array_join(F.slice(lines, first + 1, last - first + 1), "\n")


ALLOW_MARKER = "leakflow:allow"


def is_allowed(line: Column, markers: list[str]) -> Column:
    """The line says that its secret may stay."""
    found = F.lit(False)
    for marker in markers:
        found = found | F.contains(line, F.lit(marker))
    return found
