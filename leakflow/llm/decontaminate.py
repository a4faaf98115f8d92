"""Benchmark decontamination by winnowing.

Words are hashed; gram hashes of five words are taken at every word, and each
window of six consecutive grams keeps its smallest, with its place. Ten equal
words hold the same six grams, so a shared span of ten or more words always
shares a kept fingerprint. Kept fingerprints of documents and of benchmark
items are joined; each hit is extended word by word to the windows around it.
Documents' fingerprints that no item has are told apart beforehand with a
bitmap that grows with the benchmark up to a bound; beyond it more of them
reach the join, which decides alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakflow.llm.staging import arrow_rows, carried, marked, restored, stage, with_row_id

GRAM = 5
#: The bitmap's index has as many bits as give 1/16 of its places to fingerprints, between these; 2 ** 28 bits are 32 MB.
MIN_BITS, MAX_BITS = 20, 28
#: Documents' contexts of one fingerprint are dealt to so many tasks.
SALTS = 16
_PIECE = 1 << 20
_U = np.uint64


def _byte_table() -> np.ndarray:
    """Lower-case value of each byte of a word; 0 for bytes between words. Bytes from 0x80 on are parts of letters."""
    table = np.zeros(256, dtype=np.uint8)
    for first, last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[first : last + 1] = np.arange(first, last + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


_TABLE = _byte_table()
_SALT = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_STEP = _U(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Words:
    """The words of consecutive texts: byte ranges in ``bytes_`` (lower-cased, 0 between words), hashes, and the text each is in."""

    bytes_: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    text: np.ndarray

    def joined(self, first: int, n: int) -> str:
        """``n`` words from number ``first``, with single spaces."""
        return b" ".join(self.bytes_[a:b].tobytes() for a, b in zip(self.starts[first : first + n].tolist(), self.ends[first : first + n].tolist())).decode("utf-8", "replace")


def words_of(texts: pa.Array) -> Words:
    """All words of an Arrow string array; a null text has none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    low = _TABLE[data]
    inside = low != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    begins = np.unique(offsets[:-1][offsets[:-1] < len(low)])
    first[begins] |= inside[begins]
    before = begins[begins > 0] - 1
    last[before] |= inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):  # piece by piece, so that the helper arrays stay small
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _PIECE, side="right")))
        a, b = starts[at], ends[to - 1]
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(_SALT[low[a:b]] * inside[a:b] * _powers(_BASE, b - a), out=sums[1:])
        back = _powers(_BACK, b - a)
        hashes[at:to] = (sums[ends[at:to] - a] - sums[starts[at:to] - a]) * back[starts[at:to] - a]
        at = to
    return Words(low, starts, ends, _mix(hashes), np.searchsorted(offsets, starts, side="right") - 1)


def _grams(words: Words, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive words, those across texts too."""
    count = max(0, len(words.hashes) - n + 1)
    grams = np.zeros(count, dtype=np.uint64)
    for j in range(n):
        grams = grams * _STEP + words.hashes[j : j + count]
    return _mix(grams + _U(n))


def _kept(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing for windows of ``n`` words: (first word of each window inside a text, its fingerprint's word, its fingerprint).

    The fingerprint is the window's smallest gram hash, of equal ones the last;
    windows of fewer words than a gram are one gram.
    """
    gram = min(GRAM, n)
    grams = _grams(words, gram)
    count = max(0, len(words.hashes) - n + 1)
    least, at = grams[:count].copy(), np.zeros(count, dtype=np.int8)
    for j in range(1, n - gram + 1):
        later = grams[j : j + count] <= least
        least[later], at[later] = grams[j : j + count][later], j
    first = np.flatnonzero(words.text[:count] == words.text[n - 1 : n - 1 + count])
    return first, first + at[first], _mix(least[first] + _U(n))


WINDOW_SCHEMA = "item_id_ string, n_words int, words string, print long, lead int"


def benchmark_windows(benchmark: DataFrame, window: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The windows of each item: ``window`` consecutive words, or all words of a shorter item. ``lead``: words before the fingerprint's gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words_of(batch.column(1))
            counts = np.bincount(w.text, minlength=batch.num_rows)
            rows: list[tuple] = []
            for n in sorted({min(window, int(c)) for c in counts if c}):
                for i, g, h in zip(*(x.tolist() for x in _kept(w, n))):
                    item = int(w.text[i])
                    if min(window, int(counts[item])) == n:
                        rows.append((batch.column(0)[item].as_py(), n, w.joined(i, n), h - (1 << 64) if h >> 63 else h, g - i))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32()))],
                names=["item_id_", "n_words", "words", "print", "lead"],
            )

    return benchmark.select(F.col(item_id).cast("string"), F.col(text)).mapInArrow(run, WINDOW_SCHEMA)


def _bitmap(prints: DataFrame) -> tuple[np.ndarray, int]:
    """(a bitmap of the fingerprints, bits of its index). At most 2 ** MAX_BITS / 64 rows reach the driver."""
    n = prints.count()
    bits = min(MAX_BITS, max(MIN_BITS, (16 * n).bit_length()))
    slot = F.shiftrightunsigned("print", 64 - bits)
    cells = prints.groupBy(F.shiftrightunsigned(slot, 6).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(print, {64 - bits}) & 63 as int))")).alias("bits")).toArrow()
    packed = np.zeros(1 << (bits - 6), dtype=np.int64)
    packed[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return packed.view(np.uint8), bits


def _has(bitmap: np.ndarray, bits: int, prints: np.ndarray) -> np.ndarray:
    slots = (prints >> _U(64 - bits)).astype(np.int64)
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


def find_hits(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hits, owners). rows: ``keep`` columns (all by default) as c0, c1, .. and row_id_, n_words_ for each document; hits: row_id_, at, n_words, words for each occurrence of a window; owners: words, item_id_ for each window and item.

    A null document text has no words, and an item without words no window.
    Kept fingerprints go along with the words around them. Equal ones are one
    row of the join, so what many documents share is compared once, and items
    that share a window are looked up afterwards.
    """
    spark = docs.sparkSession
    windows = stage(benchmark_windows(benchmark, window, item_id, item_text), "windows")
    lengths = sorted(r[0] for r in windows.select("n_words").distinct().collect())  # at most ``window``
    bitmap = spark.sparkContext.broadcast(_bitmap(windows.select("print").distinct()))
    kept_columns = carried(docs, [text, *(docs.columns if keep is None else keep)])[0]
    names = [f"c{i}" for i in range(len(kept_columns.columns) - 1)]
    source = kept_columns.select(F.col("c0").alias("text_"), *(F.col(c).alias(n) for c, n in zip(kept_columns.columns[1:], names)))
    prints = pa.list_(pa.struct([("at", pa.int32()), ("n_words", pa.int32()), ("print", pa.int64()), ("before", pa.int32()), ("around", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words_of(batch.column(0))
            counts = np.bincount(w.text, minlength=batch.num_rows)
            begin = np.concatenate(([0], np.cumsum(counts)))
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for n in lengths:
                _, at, hashes = _kept(w, n)
                likely = _has(*bitmap.value, hashes)
                at, once = np.unique(at[likely], return_index=True)
                for g, h in zip(at.tolist(), hashes[likely][once].view(np.int64).tolist()):
                    row, reach = int(w.text[g]), n - min(GRAM, n)
                    a, b = max(g - reach, int(begin[row])), min(g + n, int(begin[row + 1]))
                    found[row].append({"at": g - int(begin[row]), "n_words": n, "print": h, "before": g - a, "around": w.joined(a, b - a)})
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts, pa.int64()), pa.array(found, prints)], names=[*names, "n_words_", "found_"])

    schema = ", ".join([*(f"{n} {t}" for n, t in source.dtypes[1:]), "n_words_ long", "found_ array<struct<at:int,n_words:int,print:long,before:int,around:string>>"])
    with arrow_rows(spark, 2000):
        staged = stage(with_row_id(source.mapInArrow(run, schema), "row_id_"), "scanned")
    kept = staged.filter(F.size("found_") > 0).select("row_id_", F.explode("found_").alias("s")).select("row_id_", "s.*")
    # the words around a fingerprint, once for all documents that have them
    contexts = kept.select("print", "n_words", "before", "around").distinct().withColumn("salt", F.pmod(F.xxhash64("around"), F.lit(SALTS)).cast("int"))
    tests = windows.select("print", "n_words", "lead", "words").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = contexts.join(tests, ["print", "n_words", "salt"])
    # extension: the item's words before and behind the fingerprint are the document's
    there = F.array_join(F.slice(F.split("around", " "), F.greatest(F.col("before") - F.col("lead"), F.lit(0)) + 1, F.col("n_words")), " ")
    extended = joined.filter((F.col("lead") <= F.col("before")) & (there == F.col("words")))
    matched = extended.groupBy("print", "n_words", "before", "around").agg(F.collect_list(F.struct("lead", "words")).alias("m"))
    salted = matched.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = kept.withColumn("salt", F.pmod(F.xxhash64("row_id_"), F.lit(SALTS)).cast("int"))
    hits = dealt.join(salted, ["print", "n_words", "before", "around", "salt"]).select("row_id_", "at", "n_words", F.explode("m").alias("m"))
    hits = stage(hits.select("row_id_", (F.col("at") - F.col("m.lead")).alias("at"), "n_words", F.col("m.words").alias("words")), "hits")
    return staged.select(*names, "row_id_", "n_words_"), hits, windows.select("words", "item_id_").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``.

    n_hit counts the words inside any occurrence of a window of an item.
    Null and wordless texts have no words and no hits; items without words
    never hit. Repeated rows each return a row; items that share an id are
    one item, and an item whose id is null hits words but is not listed.
    Without documents the result is empty, without items nothing hits. Texts
    of any length are read as a whole, one Arrow batch at a time.
    """
    rows, hits, owners = find_hits(docs, benchmark, [doc_id], window)
    spans = hits.groupBy("row_id_").agg(F.sort_array(F.collect_set(F.struct("at", "n_words"))).alias("spans"))
    # each window once a document, so that no occurrence meets all items
    salt = lambda x: F.pmod(F.xxhash64(x), F.lit(SALTS)).cast("int")
    held = hits.select("row_id_", "words").distinct().withColumn("salt", salt("row_id_"))
    named = held.join(owners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["words", "salt"])
    by_row = spans.join(named.groupBy("row_id_").agg(F.sort_array(F.collect_set("item_id_")).alias("items")), "row_id_")
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["to"], s["at"] + s["n_words"]).alias("to"), (acc["n"] + F.greatest(F.lit(0), s["at"] + s["n_words"] - F.greatest(acc["to"], s["at"]))).alias("n")),
        lambda acc: acc["n"],
    )
    by_row = by_row.select("row_id_", covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(by_row, "row_id_", "left").select(
        F.col("c0").alias(doc_id), F.col("n_words_").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the rows whose text holds a window of an item."""
    rows, hits, _ = find_hits(docs, benchmark, None, window)
    return restored(marked(rows, hits.select("row_id_"), key="row_id_", apart=True), docs.columns)
