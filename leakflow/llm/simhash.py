"""SimHash fingerprints and near-duplicate links found with pivot distance tables.

A fingerprint is one or more 64-bit words. Each distinct fingerprint carries
its Hamming distances to a fixed set of reference fingerprints (pivots). By
the triangle inequality two fingerprints within ``radius`` differ by at most
``radius`` in every coordinate of that table, so pairs with a larger
difference in any coordinate are discarded before the exact comparison.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakflow.llm.components import connected_components
from leakflow.llm.staging import arrow_rows, carried, join_by_count, marked, restored, stage, with_row_id

SEED = 42
#: A-Z to a-z; other bytes stay.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_PIECE = 1 << 20
#: For each byte, its eight bits as the eight bytes of one integer.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
#: Odd multipliers that derive further words from a shingle's hash (fractional parts of square roots of primes).
_MULTIPLIERS = [int((p**0.5 % 1) * 2**52) << 12 | 1 for p in (2, 3, 5, 7, 11, 13, 17, 19)]
#: Words of a fingerprint that pivot cells are made from, and how many sets of pivots there are.
CELL_WORDS, TURNS = 8, 72
_BITS, _CELL = 64 * CELL_WORDS, 128


def _word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in pieces of about 1 MB cut between words."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + _PIECE) if len(text) - at > _PIECE else None
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


def _hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, by pieces; a text of fewer words is one shingle."""
    held: list[bytes] = []
    whole = False
    for words in _word_pieces(text.translate(LOWER)):
        words = held + words
        if len(words) >= shingle:
            whole = True
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate(([0], ends[: len(words) - shingle] + 1))
            digest = xxhash.xxh64_intdigest
            yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())], dtype=np.uint64)
            held = words[len(words) - shingle + 1 :] if shingle > 1 else []
        else:
            held = words
    if held and not whole:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], dtype=np.uint64)


def _mixed(hashes: np.ndarray, words: int) -> np.ndarray:
    """The shingles' hashes for each word of a fingerprint: (words, hashes)."""
    if words == 1:
        return hashes[None]
    more = hashes * np.array(_MULTIPLIERS[1:words], dtype=np.uint64)[:, None]
    more ^= more >> np.uint64(32)
    more *= np.array(_MULTIPLIERS[: words - 1], dtype=np.uint64)[:, None]
    more ^= more >> np.uint64(29)
    return np.concatenate((hashes[None], more))


def majorities(pieces: Iterable[np.ndarray], words: int) -> np.ndarray:
    """For each bit of ``words`` words, by how many more of the shingles' hashes (in ``pieces``) it is set than not."""
    n, ones = 0, np.zeros((words, 64), dtype=np.int64)
    for hashes in pieces:
        n += len(hashes)
        for at in range(0, len(hashes), 255):  # a lane holds up to 255
            lanes = _LANES[_mixed(hashes[at : at + 255], words).view(np.uint8).reshape(words, -1, 8)]
            ones += lanes.sum(axis=1, dtype=np.uint64).view(np.uint8)
    return ones * 2 - n


def fingerprint(counts: np.ndarray) -> np.ndarray:
    """The words, unsigned, of ``majorities``: a bit is 1 if it is set in over half of the hashes."""
    return np.packbits(counts > 0, axis=-1, bitorder="little").view(np.uint64).reshape(counts.shape[:-1])


def text_fingerprint(text: str | None, shingle: int, words: int = 1) -> list[int]:
    """The fingerprint's words, unsigned. A bit is 1 if it is set in over half of the shingles' hashes; without words all are 0."""
    return fingerprint(majorities(_hashes((text or "").encode("utf-8", "surrogatepass"), shingle), words)).tolist()


_SIGNS = np.array([xxhash.xxh64_intdigest(f"turn {i}".encode(), SEED) for i in range(TURNS * CELL_WORDS)], dtype=np.uint64)
_SIGNS = np.unpackbits(_SIGNS.view(np.uint8)).reshape(TURNS, _BITS, 1).astype(np.float32) * 2 - 1


def pivot_cells(counts: np.ndarray) -> np.ndarray:
    """For rows of ``majorities`` of CELL_WORDS words, the nearest pivot of each of the TURNS * 4 tables: uint8 (rows, tables).

    The pivots of a turn are 512 fingerprints that differ in 256 bits from
    each other (a Hadamard matrix, columns negated at random), and their
    complements; a table has 128 of them and the complements of those. A
    distance counts a differing bit by its majority, so that bits which a few
    shingles decide weigh little: it is (sum of all - product) / 2, and the
    nearest pivot is that with the largest product.
    """
    tables = _BITS // _CELL
    cells = np.zeros((len(counts), TURNS * tables), dtype=np.uint8)
    for start in range(0, len(counts), 128):  # so many fit a core's cache
        base = np.ascontiguousarray(counts[start : start + 128].reshape(-1, _BITS).T, dtype=np.float32)
        n = base.shape[1]
        for i, signs in enumerate(_SIGNS):
            far, other = base * signs, np.empty_like(base)
            half = 1
            while half < _BITS:  # the product with a Hadamard matrix, by sums and differences
                x, y = far.reshape(-1, 2, half * n), other.reshape(-1, 2, half * n)
                np.add(x[:, 0], x[:, 1], out=y[:, 0])
                np.subtract(x[:, 0], x[:, 1], out=y[:, 1])
                far, other, half = other, far, half * 2
            far = np.ascontiguousarray(far.T).reshape(-1, _CELL)
            at = np.abs(far).argmax(axis=1)
            cells[start : start + n, i * tables : (i + 1) * tables] = (at | ((far[np.arange(len(far)), at] < 0) << 7)).reshape(n, tables)
    return cells


def _choices(rounds: int) -> np.ndarray:
    """Threes of tables: each table is in ``rounds`` of them."""
    n = TURNS * _BITS // _CELL
    order = [sorted(range(n), key=lambda j: xxhash.xxh64_intdigest(f"choice {r} {j}".encode(), SEED)) for r in range(rounds)]
    return np.array(order).reshape(-1, 3)


CHOICES = _choices(2)


def cell_keys(cells: np.ndarray) -> np.ndarray:
    """Keys of ``pivot_cells``, one for each of CHOICES: its number and the three cells, as int64 (rows, choices)."""
    three = cells.astype(np.int64)[:, CHOICES]
    return np.arange(len(CHOICES)) << 24 | three[:, :, 0] << 16 | three[:, :, 1] << 8 | three[:, :, 2]


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, words: int = 1, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs`` (all by default) as c0, c1, .., a unique ``row_id``, and fingerprint words ``fp0``..: a staged table.

    A null text counts as one without words.
    """
    fps = [f"fp{i}" for i in range(words)]
    kept = carried(docs, [text, *(docs.columns if keep is None else keep)])[0]
    source = kept.select(F.col("c0").alias("text_"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(kept.columns[1:])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_fingerprint(t.as_py(), shingle, words) for t in batch.column(0)]
            found = np.array(found, dtype=np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(found[:, i]) for i in range(words))], names=[*batch.schema.names[1:], *fps])

    schema = ", ".join([*(f"{n} {t}" for n, t in source.dtypes[1:]), *(f"{c} long" for c in fps)])
    with arrow_rows(docs.sparkSession, 2000):
        return stage(with_row_id(source.mapInArrow(run, schema)), "fingerprints")


def _references(words: int, pivots: int) -> list[list[int]]:
    """Fixed reference fingerprints, as signed words."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [[signed(xxhash.xxh64_intdigest(f"pivot {j} {i}".encode(), SEED)) for i in range(words)] for j in range(pivots)]


def with_pivots(fps: DataFrame, words: int, pivots: int) -> DataFrame:
    """The pivot distance table: ``piv`` array<short>, one Hamming distance for each reference."""
    far = lambda ref: sum((F.bit_count(F.col(f"fp{i}").bitwiseXOR(F.lit(r))) for i, r in enumerate(ref)), F.lit(0))
    return fps.withColumn("piv", F.array(*(far(r).cast("short") for r in _references(words, pivots))))


def within(a: str, b: str, words: int, pivots: int, radius: int) -> Column:
    """Pairs that the pivot tables can't rule out, then those whose Hamming distance is at most ``radius``."""
    near = F.lit(True)
    for j in range(pivots):
        near = near & (F.abs(F.col(f"{a}.piv")[j] - F.col(f"{b}.piv")[j]) <= radius)
    apart = sum((F.bit_count(F.col(f"{a}.fp{i}").bitwiseXOR(F.col(f"{b}.fp{i}"))) for i in range(words)), F.lit(0))
    return near & (apart <= radius)


def _blocks(parts: int) -> list[tuple[int, int]]:
    """(first bit, bits) of ``parts`` blocks of a word."""
    edges = [64 * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def block_keys(words: int, parts: int, same: int) -> Column:
    """array<struct<k, bits>>: for each word and each choice of ``same`` of its ``parts`` blocks, those blocks' bits."""
    keys = []
    for w in range(words):
        for chosen in combinations(_blocks(parts), same):
            mask = sum(((1 << n) - 1) << at for at, n in chosen)
            mask -= (1 << 64) if mask >> 63 else 0
            keys.append(F.struct(F.lit(len(keys)).cast("short").alias("k"), F.col(f"fp{w}").bitwiseAND(F.lit(mask)).alias("bits")))
    return F.array(*keys)


def links(nodes: DataFrame, words: int, radius: int, pivots: int = 16, parts: int | None = None, same: int = 3, key_words: int = 1, bucket: int = 16, part: int = 512) -> DataFrame:
    """(u, v): pairs of ``nodes`` (row_id, fp0..) within ``radius`` bits, such that linked nodes are connected by them.

    Candidates share ``same`` of ``parts`` blocks of a word (``radius + same``
    blocks by default: any pair within ``radius`` then shares some choice).
    Buckets of up to ``bucket`` nodes are joined with themselves; the pivot
    tables discard pairs, and the exact distance verifies the rest.

    A larger bucket makes no rows of pairs. With one word and a radius of 2,
    its nodes are grouped by the fingerprints one bit or less from them: two
    nodes within 2 bits always share one, at most 65 nodes share each, and a
    group is linked to its smallest node. Otherwise its nodes are dealt to
    parts of about ``part`` nodes, and each two parts go to one task, which
    returns a spanning forest of the nodes within ``radius`` there. Either
    way no connection between candidates is lost.
    """
    parts = parts or radius + same
    wide = stage(with_pivots(nodes, words, pivots), "pivots")
    keys = wide.select("row_id", F.explode(block_keys(key_words, parts, same)).alias("key")).select("row_id", "key.*")
    sizes = keys.groupBy("k", "bits").agg(F.count("*").alias("n"), F.min("row_id").alias("first")).filter("n > 1")
    members = stage(keys.join(sizes, ["k", "bits"]), "buckets")
    exact = words == 1 and radius == 2
    small = members.filter(F.col("n") <= bucket)
    large = members.filter(F.col("n") > bucket)
    if exact:  # the words themselves are narrow enough to go along
        a, b = (small.join(wide, "row_id").alias(x) for x in "ab")
        pairs = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.row_id") < F.col("b.row_id")) & within("a", "b", words, pivots, radius))
        pairs = pairs.select(F.col("a.row_id").alias("u"), F.col("b.row_id").alias("v"))
        hot = large.select("row_id").distinct().join(wide, "row_id").select("row_id", "fp0")
        flips = [0, *(1 << i for i in range(63)), -(1 << 63)]
        middles = hot.select("row_id", F.explode(F.array(*(F.col("fp0").bitwiseXOR(F.lit(x)) for x in flips))).alias("middle"))
        groups = middles.groupBy("middle").agg(F.sort_array(F.collect_list("row_id")).alias("ids")).filter(F.size("ids") > 1)
        stars = groups.select(F.col("ids")[0].alias("v"), F.explode(F.slice("ids", 2, 64)).alias("u")).distinct()
        # the tables and the exact distance decide these candidates too
        told = stars.join(wide.alias("a"), F.col("a.row_id") == F.col("u")).join(wide.alias("b"), F.col("b.row_id") == F.col("v"))
        return pairs.unionByName(told.filter(within("a", "b", words, pivots, radius)).select("u", "v"))
    a, b = (small.select("k", "bits", "row_id").alias(x) for x in "ab")
    pairs = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.row_id") < F.col("b.row_id")))
    pairs = pairs.select(F.col("a.row_id").alias("u"), F.col("b.row_id").alias("v")).distinct()
    near = pairs.join(wide.alias("a"), F.col("a.row_id") == F.col("u")).join(wide.alias("b"), F.col("b.row_id") == F.col("v"))
    return near.filter(within("a", "b", words, pivots, radius)).select("u", "v").unionByName(_forests(large, wide, words, radius, part))


def _forest(ids: np.ndarray, fps: np.ndarray, piv: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(u, v) that connect the nodes within ``radius`` of each other: nodes that are reached aren't compared again."""
    us, vs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    left, reached = np.arange(len(ids)), []
    while len(left):
        if not reached:
            reached, left = [left[0]], left[1:]
        x = reached.pop()
        close = left[(np.abs(piv[left] - piv[x]) <= radius).all(axis=1)]
        close = close[np.bitwise_count(fps[close] ^ fps[x]).sum(axis=1, dtype=np.int64) <= radius]
        if len(close):
            us.append(ids[close])
            vs.append(np.full(len(close), ids[x]))
            reached.extend(close.tolist())
            left = left[~np.isin(left, close)]
    return us, vs


def _forests(large: DataFrame, wide: DataFrame, words: int, radius: int, part: int) -> DataFrame:
    """(u, v) for buckets (k, bits, n, row_id) of ``large``: what connects the nodes of each two parts of a bucket."""
    parts = F.ceil(F.col("n") / part).cast("int")
    own = F.pmod(F.xxhash64("row_id", "k", "bits"), parts).cast("int")
    dealt = large.select("k", "bits", "row_id", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    dealt = dealt.select("k", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "row_id")
    fps = [f"fp{i}" for i in range(words)]

    def run(table: pa.Table) -> pa.Table:
        columns = [table.column(f).to_numpy() for f in fps]
        piv = table.column("piv").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        us, vs = _forest(table.column("row_id").to_numpy(), np.stack(columns, axis=1).view(np.uint64), piv, radius)
        return pa.table({"u": np.concatenate(us), "v": np.concatenate(vs)})

    return dealt.join(wide, "row_id").groupBy("k", "bits", "i", "j").applyInArrow(run, "u long, v long")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the component) for each row of ``docs``.

    Null or wordless texts have fingerprint zero and are linked like any
    other. A null doc_id stays null and never is a component_id unless the
    component has no other; repeated rows each return a row. An empty table
    gives an empty result. Very long texts are hashed in pieces of about a
    megabyte. Other columns of ``docs`` are not read.
    """
    rows = fingerprints(docs, text, shingle, 1, [doc_id])
    fps = stage(rows.groupBy("fp0").agg(F.min("row_id").alias("row_id"), F.min("c0").alias("least"), F.count("*").alias("n")), "nodes")
    roots = connected_components(links(fps.select("row_id", "fp0"), 1, radius))
    rooted = stage(fps.join(roots, fps.row_id == roots.node, "left").select("fp0", "least", "n", F.coalesce("root", "row_id").alias("root")), "rooted")
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = join_by_count(rooted, best, ["root"], "members", rooted.count()).select("fp0", "n", "component_id")
    return join_by_count(rows, named, ["fp0"], "n", rows.count()).select(F.col("c0").alias(doc_id), F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


def radius_for(similarity: float, words: int) -> int:
    """The Hamming distance expected at a Jaccard ``similarity`` J of equally long shingle sets: their cosine is 2J / (1 + J)."""
    return int(64 * words * np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest doc_id, a null one last.

    Similarity is the Jaccard similarity of shingle sets. At 0.8 some 15 % of
    a fingerprint's bits differ, so candidates don't share blocks of bits but
    the nearest pivots of three pivot tables (see ``pivot_cells``) and differ
    in few enough of 512 bits; all of them are then compared set by set (see
    ``jaccard``). Repeated rows count as copies.
    Texts without words form one group. An empty table stays empty.
    """
    from leakflow.llm import jaccard

    rows = jaccard.signatures(docs, text, shingle)
    own = F.col(f"c{docs.columns.index(doc_id)}")
    told = rows.withColumn("best", F.struct(own.isNull().alias("none"), own.alias("doc_id_"), "row_id"))
    kept = jaccard.roots(told, f"c{docs.columns.index(text)}", shingle, similarity).groupBy("root").agg(F.min("best").alias("best"))
    return restored(marked(rows, kept.select(F.col("best.row_id").alias("row_id"))), docs.columns)
