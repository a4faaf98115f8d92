"""Exact top-k inner products with a KD-tree for each shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakflow.llm.staging import arrow_rows, stage, with_row_id

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8192, 512, 128
#: Query blocks that pass through one task with a shard's tree.
TASK_BLOCKS = 64


@dataclass
class Tree:
    """A KD-tree over the rows of a matrix: node i has the rows order[start[i]:end[i]], a tight box, and children 2i + 1, 2i + 2 unless it is a leaf."""

    rows: np.ndarray
    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def build(rows: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
        """Splits at the median of the widest side until a node has ``leaf_rows`` rows or equal ones only."""
        depth = max(0, int(np.ceil(np.log2(max(1, len(rows)) / leaf_rows)))) if len(rows) > leaf_rows else 0
        size = (1 << (depth + 1)) - 1
        order = np.arange(len(rows))
        start, end = np.zeros(size, np.int64), np.zeros(size, np.int64)
        low, high = np.zeros((size, rows.shape[1])), np.zeros((size, rows.shape[1]))
        end[0] = len(rows)
        for i in range(size):
            a, b = start[i], end[i]
            if a == b:
                continue
            part = rows[order[a:b]]
            low[i], high[i] = part.min(axis=0), part.max(axis=0)
            if 2 * i + 2 < size:
                middle = (a + b) // 2
                if rows.shape[1]:
                    side = int(np.argmax(high[i] - low[i]))
                    order[a:b] = order[a:b][np.argpartition(part[:, side], middle - a)]
                start[2 * i + 1], end[2 * i + 1], start[2 * i + 2], end[2 * i + 2] = a, middle, middle, b
        return Tree(rows, order, start, end, low, high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, the largest inner product that a point of the box can have."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bounds: np.ndarray, k: int, floor: float, ids: np.ndarray, uids: np.ndarray, own: int) -> list[tuple[int, int, int]]:
        """Up to ``k`` best (score, -id, -uid), none of them below ``floor``: nodes are visited best bound first, and those below the kth score are left out."""
        best: list[tuple[int, int, int]] = []
        heap = [(-bounds[0], 0)]
        size = len(self.start)
        while heap and -heap[0][0] >= floor:
            node = heapq.heappop(heap)[1]
            if 2 * node + 2 < size:
                for child in (2 * node + 1, 2 * node + 2):
                    if self.end[child] > self.start[child] and bounds[child] >= floor:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            at = self.order[self.start[node] : self.end[node]]
            scores = self.rows[at] @ query
            good = (scores >= floor) & (uids[at] != own)
            for s, i, u in zip(scores[good].tolist(), ids[at][good].tolist(), uids[at][good].tolist()):
                item = (int(s), -i, -u)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return best


def _matrix(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.int64).reshape(-1, dim) if dim else np.zeros((len(raw) // 8, 0), np.int64)


def quantized(vectors: DataFrame, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """(row_id, vec_id, dim, v array<long>): floor(scale * component) of the vectors that take part, as a staged table."""
    wide = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = wide.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite)
    return stage(with_row_id(good.select("vec_id", F.size("x").alias("dim"), F.transform("x", lambda c: F.floor(c * scale)).alias("v"))), "vectors")


def _trees(rows: DataFrame) -> DataFrame:
    """(dim, shard, ids, uids, m, nodes, boxes): each shard's tree, built once. ``m`` is the matrix in the tree's order, ``nodes`` their first and last rows, ``boxes`` their lower and upper corners."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.array(pdf["v"].tolist(), dtype=np.int64).reshape(len(pdf), -1)
        tree = Tree.build(v)
        column = lambda c: pdf[c].to_numpy(np.int64)[tree.order].tobytes()
        parts = {"ids": column("vec_id"), "uids": column("row_id"), "m": v[tree.order].tobytes(), "nodes": np.stack([tree.start, tree.end]).tobytes(), "boxes": np.stack([tree.low, tree.high]).tobytes()}
        return pd.DataFrame([{"dim": pdf["dim"].iloc[0], "shard": pdf["shard"].iloc[0]} | parts])

    return rows.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, ids binary, uids binary, m binary, nodes binary, boxes binary")


def _loaded(x: dict) -> Tree:
    nodes, boxes = np.frombuffer(x["nodes"], dtype=np.int64).reshape(2, -1), np.frombuffer(x["boxes"], dtype=np.float64)
    boxes = boxes.reshape(2, nodes.shape[1], -1) if x["dim"] else np.zeros((2, nodes.shape[1], 0))
    rows = _matrix(x["m"], x["dim"]) if x["dim"] else np.zeros((len(x["ids"]) // 8, 0), np.int64)
    return Tree(rows, np.arange(len(rows)), nodes[0], nodes[1], boxes[0], boxes[1])


def _blocks(queries: DataFrame) -> DataFrame:
    """(dim, block, ids, uids, m, floors): blocks of queries (dim, block, vec_id, row_id, v, floor) as one row each; a null floor is the least long."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        column = lambda c: pdf[c].to_numpy(np.int64).tobytes()
        v = np.array(pdf["v"].tolist(), dtype=np.int64)
        return pd.DataFrame([{"dim": pdf["dim"].iloc[0], "block": pdf["block"].iloc[0], "ids": column("vec_id"), "uids": column("row_id"), "m": v.tobytes(), "floors": column("floor")}])

    filled = queries.withColumn("floor", F.coalesce("floor", F.lit(_LEAST)))
    return filled.groupBy("dim", "block").applyInPandas(pack, "dim int, block int, ids binary, uids binary, m binary, floors binary")


FOUND = "query_uid long, query_id long, vec_id long, uid long, score long"
_LEAST = -(1 << 63)


def _search(trees: DataFrame, blocks: DataFrame, k: int, shards: int, first: int, last: int) -> DataFrame:
    """The best of each query in the shards ``first`` to ``last`` places after its block's own.

    A shard's tree goes to a task once, before up to TASK_BLOCKS blocks that
    pass through it.
    """
    places = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("place")
    visits = blocks.select("*", places).withColumn("shard", F.pmod(F.col("block") + F.col("place"), F.lit(shards)).cast("int"))
    visits = visits.withColumn("task", F.floor(F.col("block") / (TASK_BLOCKS * shards)).cast("int")).withColumn("kind", F.lit(1))
    none = F.lit(None).cast("binary")
    tasks = visits.select("dim", "shard", "task").distinct()
    names = ["dim", "shard", "task", "kind", "ids", "uids", "m", "nodes", "boxes", "floors"]
    held = trees.join(tasks, ["dim", "shard"]).withColumn("kind", F.lit(0)).withColumn("floors", none).select(names)
    stream = held.unionByName(visits.withColumn("nodes", none).withColumn("boxes", none).select(names))
    stream = stream.repartition("dim", "shard", "task").sortWithinPartitions("dim", "shard", "task", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, ids, uids, exact, loaded = None, None, None, {}, None
        for batch in batches:
            for row in range(batch.num_rows):
                x = {n: batch.column(i)[row].as_py() for i, n in enumerate(batch.schema.names)}
                place = (x["dim"], x["shard"], x["task"])
                if not x["kind"]:
                    tree, exact, loaded = _loaded(x), {}, place
                    ids, uids = (np.frombuffer(x[c], dtype=np.int64) for c in ("ids", "uids"))
                    continue
                if loaded != place:  # no vector of this length is in the shard
                    continue
                qids, quids, floors = (np.frombuffer(x[c], dtype=np.int64) for c in ("ids", "uids", "floors"))
                queries = _matrix(x["m"], x["dim"]) if x["dim"] else np.zeros((len(qids), 0), np.int64)
                most = float(np.abs(tree.rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, x["dim"])
                kind = np.float64 if most < 2**53 else np.int64  # products of floats are exact below, and faster
                if kind not in exact:
                    exact[kind] = replace(tree, rows=tree.rows.astype(kind))
                bounds = tree.bounds(queries.astype(np.float64))
                bounds += np.abs(bounds) * 1e-12 if most >= 2**53 else 0
                out: list[tuple] = []
                for i, (query, own, floor) in enumerate(zip(queries.astype(kind), quids.tolist(), floors.tolist())):
                    found = exact[kind].search(query, bounds[i], k, -np.inf if floor == _LEAST else floor, ids, uids, own)
                    out += [(own, int(qids[i]), -v, -u, s) for s, v, u in found]
                columns = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_uid", "query_id", "vec_id", "uid", "score"])

    with arrow_rows(trees.sparkSession, 4):
        return stage(stream.mapInArrow(run, FOUND), "found")


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best inner products of each query (vec_id divisible by ``every``) with all other rows.

    Components become floor(scale * x). Ties go to the smaller vec_id. Rows
    whose id or vector is null, or whose vector holds a null or non-finite
    component, take no part; vectors of different lengths never meet.
    Repeated rows are rows: each is a candidate of the others, and a query of
    its own. With fewer than ``k`` candidates all are returned; an empty
    table returns none. Scores must fit a long.

    Rows are dealt at random to shards of about ``shard_rows``, whose trees
    are built once. Queries, in blocks, search one shard first, then 1, 2, 4,
    .. further ones at a time; after each round a query's kth score so far is
    the bound below which whole boxes are left out.
    """
    rows = quantized(vectors, scale, vec_id, embedding)
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row_id"), F.lit(shards)).cast("int"))
    trees = stage(_trees(dealt), "trees")
    queries = rows.filter(F.col("vec_id") % every == 0)
    blocks_n = max(1, -(-queries.count() // BLOCK_ROWS))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("row_id", F.lit(1)), F.lit(blocks_n)).cast("int")).withColumn("floor", F.lit(None).cast("long"))
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    best, place = None, 0
    while place < shards:
        last = min(shards - 1, 2 * place)
        found = _search(trees, _blocks(queries), k, shards, place, last)
        found = found if best is None else best.unionByName(found)
        best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        place = last + 1
        if place < shards:
            best = stage(best.drop("rank"), "best")
            kth = best.groupBy("query_uid").agg(F.min("score").alias("floor"), F.count("*").alias("n")).filter(F.col("n") >= k)
            queries = queries.drop("floor").join(kth.select(F.col("query_uid").alias("row_id"), "floor"), "row_id", "left")
    return best.select("query_id", "rank", "vec_id", "score")
