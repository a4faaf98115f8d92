"""Product codes of vectors: Lloyd rounds over parts, nearest entries found with a vantage-point tree for each part position."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakflow.llm.staging import arrow_rows, stage, with_row_id

#: Distances are rounded outward by this share, far more than a float's error.
SLACK = 1e-12
#: Sums by label of up to so many labels are broadcast.
BROADCAST_LABELS = 100_000


@dataclass
class _Node:
    """An entry, and the entries below it by their distance to it: those within the median, and the others, each with bounds of these distances."""

    entry: int
    radius: float = 0.0
    inner: _Node | None = None
    outer: _Node | None = None
    inner_bounds: tuple[float, float] = (0.0, 0.0)
    outer_bounds: tuple[float, float] = (0.0, 0.0)


class VantageTree:
    """Nearest entry by squared Euclidean distance in integers, ties to the lower index."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.ascontiguousarray(entries, dtype=np.int64)
        self.root = self._build(np.arange(len(entries)))

    def _build(self, index: np.ndarray) -> _Node | None:
        if not len(index):
            return None
        far = self._squares(self.entries[index], self.entries[index[0]])
        node, rest, far = _Node(int(index[0])), index[1:], np.sqrt(far[1:].astype(np.float64))
        if len(rest):
            order = np.argsort(far, kind="stable")
            half = (len(rest) + 1) // 2
            sides = [(rest[o], (far[o].min() * (1 - SLACK), far[o].max() * (1 + SLACK)) if len(o) else (0.0, 0.0)) for o in (order[:half], order[half:])]
            node.radius = float(far[order[half - 1]])
            (a, node.inner_bounds), (b, node.outer_bounds) = sides
            node.inner, node.outer = self._build(a), self._build(b)
        return node

    @staticmethod
    def _squares(rows: np.ndarray, entry: np.ndarray) -> np.ndarray:
        apart = rows - entry
        return np.einsum("ij,ij->i", apart, apart)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) for each of ``rows``: branch and bound for all of them at a time."""
        best = np.full(len(rows), np.iinfo(np.int64).max)
        code = np.full(len(rows), len(self.entries))
        self._visit(self.root, rows, np.arange(len(rows)), best, code)
        return code, best

    def _visit(self, node: _Node | None, rows: np.ndarray, at: np.ndarray, best: np.ndarray, code: np.ndarray) -> None:
        if node is None or not len(at):
            return
        squares = self._squares(rows[at], self.entries[node.entry])
        better = (squares < best[at]) | ((squares == best[at]) & (node.entry < code[at]))
        best[at[better]], code[at[better]] = squares[better], node.entry
        if node.inner is None:
            return
        far = np.sqrt(squares.astype(np.float64))
        near = far <= node.radius
        self._visit(node.inner, rows, at[near], best, code)
        self._visit(node.outer, rows, at[~near], best, code)
        for side, bounds, mask in ((node.outer, node.outer_bounds, near), (node.inner, node.inner_bounds, ~near)):
            # the least distance that an entry of the other side can have, rounded down; an equal one may win a tie
            least = np.maximum(far[mask] * (1 - SLACK) - bounds[1], bounds[0] - far[mask] * (1 + SLACK))
            least -= SLACK * (far[mask] + bounds[1])
            reach = np.sqrt(best[at[mask]].astype(np.float64)) * (1 + SLACK)
            self._visit(side, rows, at[mask][least <= reach], best, code)


@dataclass
class Codebooks:
    """Entries of each part position; part i has the components edges[i] to edges[i + 1]."""

    edges: list[int]
    entries: list[np.ndarray]

    def trees(self) -> list[VantageTree]:
        return [VantageTree(e) for e in self.entries]

    def digest(self) -> str:
        """SHA-256 of the components in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for x in part.ravel().tolist()).encode()).hexdigest()

    def restore(self, code: bytes) -> list[int]:
        """The vector that a code stands for."""
        return [x for part, i in zip(self.entries, code) for x in part[i].tolist()]


def quantized(vectors: DataFrame, scale: int, embedding: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns as c0, c1, .., and v array<long>: floor(scale * component) of the vectors that take part, a staged table with a row_id."""
    x = F.col("x")
    wide = vectors.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.col(f"`{embedding}`").cast("array<double>").alias("x"))
    good = wide.filter(x.isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return stage(with_row_id(good.withColumn("v", F.transform("x", lambda c: F.floor(c * scale))).drop("x")), "vectors")


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sums(rows: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> (rows, component sums) of the parts nearest to an entry. As many numbers as the codebooks have reach the driver."""
    dim, edges = books.edges[-1], books.edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.trees()
        sums = [np.zeros(e.shape, dtype=np.int64) for e in books.entries]
        counts = [np.zeros(len(e), dtype=np.int64) for e in books.entries]
        for batch in batches:
            v = _matrix(batch.column(0), dim)
            for p, tree in enumerate(trees):
                own = np.ascontiguousarray(v[:, edges[p] : edges[p + 1]])
                code = tree.nearest(own)[0]
                np.add.at(sums[p], code, own)
                counts[p] += np.bincount(code, minlength=len(counts[p]))
        found = [(p, k, j, int(n), int(sums[p][k, j])) for p in range(len(trees)) for k, n in enumerate(counts[p]) if n for j in range(sums[p].shape[1])]
        columns = list(zip(*found)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["part", "entry", "place", "n", "total"])

    with arrow_rows(rows.sparkSession, 8192):
        partial = rows.select("v").mapInArrow(run, "part int, entry int, place int, n long, total long")
        made = partial.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    found: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in sorted(made, key=lambda r: (r["part"], r["entry"], r["place"])):
        found.setdefault((r["part"], r["entry"]), (r["n"], []))[1].append(r["total"])
    return found


def train(rows: DataFrame, order: str, parts: int, entries: int, rounds: int) -> Codebooks | None:
    """Codebooks of ``rows`` (``order``, v): they start as the parts of the first rows in ``order`` (nulls last, equal ones by their components), and each round moves an entry to the floored mean of its parts. None for an empty table."""
    first = rows.orderBy(F.col(order).asc_nulls_last(), "v").select("v").limit(entries).collect()
    if not first:
        return None
    start = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), -1)
    edges = [i * start.shape[1] // parts for i in range(parts + 1)]
    books = Codebooks(edges, [start[:, a:b].copy() for a, b in zip(edges, edges[1:])])
    for _ in range(rounds):
        for (p, k), (n, total) in _sums(rows, books).items():
            books.entries[p][k] = np.array(total, dtype=np.int64) // n
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` (.., v) without v, and code binary (an index a part), error long (squared distance of vector and code)."""
    dim, edges = books.edges[-1], books.edges
    names = [n for n in rows.columns if n != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.trees()
        for batch in batches:
            v = _matrix(batch.column(batch.schema.get_field_index("v")), dim)
            codes, error = np.zeros((len(v), len(trees)), dtype=np.uint8), np.zeros(len(v), dtype=np.int64)
            for p, tree in enumerate(trees):
                codes[:, p], far = tree.nearest(np.ascontiguousarray(v[:, edges[p] : edges[p + 1]]))
                error += far
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=[*names, "code", "error"])

    schema = ", ".join([*(f"{n} {t}" for n, t in rows.dtypes if n != "v"), "code binary, error long"])
    with arrow_rows(rows.sparkSession, 8192):
        return stage(rows.mapInArrow(run, schema), "codes")


def compress(vectors: DataFrame, scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6, vec_id: str = "vec_id", embedding: str = "embedding", keep: list[str] | None = None) -> tuple[DataFrame, Codebooks | None]:
    """(the ``keep`` columns as c0, c1, .. with code and error, codebooks): a product code of ``parts`` bytes for each vector.

    Null vectors and ones with null or non-finite components take no part;
    nor do those of another length than the one with the least vec_id (nulls
    last). A length that ``parts`` doesn't divide makes parts that differ by
    one. Repeated rows count each. With fewer rows than ``entries`` there are
    as many entries as rows; an empty table has no codes and no codebooks.
    ``entries`` is 256 at most; scaled components up to 2^28 are safe from
    overflow.
    """
    if not 0 < entries <= 256:
        raise ValueError("1 to 256 entries")
    keep = [vec_id] if keep is None else keep
    rows = quantized(vectors, scale, embedding, [vec_id, *keep])
    first = rows.orderBy(F.col("c0").asc_nulls_last(), "v").select(F.size("v")).first()
    rows = rows.filter(F.size("v") == (first[0] if first else 0))
    books = train(rows, "c0", parts, entries, rounds)
    named = rows.select(*(F.col(f"c{i + 1}").alias(f"c{i}") for i in range(len(keep))), "v")
    if books is None:
        return named.drop("v").withColumn("code", F.lit(b"")).withColumn("error", F.lit(0).cast("long")).filter("false"), None
    return encode(named, books), books


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", **how: int) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (errors summed over equal labels, null ones together), codebooks_sha256. See ``compress``."""
    codes, books = compress(vectors, vec_id=vec_id, embedding=embedding, keep=[vec_id, label], **how)
    by_label = codes.groupBy(F.col("c1").alias("label_")).agg(F.sum("error").alias("label_error"))
    by_label = stage(by_label, "labels")
    small = by_label.count() <= BROADCAST_LABELS
    told = codes.join(F.broadcast(by_label) if small else by_label, F.col("c1").eqNullSafe(F.col("label_")))
    return told.select(F.col("c0").alias(vec_id), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))
