"""Hard negatives by product quantisation: table scores plus or minus a bound from stored residual norms select, exact integer scores decide."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakflow.llm.staging import arrow_rows, stage, with_row_id

SHARD_ROWS, BLOCK_ROWS = 8192, 256
#: Anchor blocks that pass through one task with a shard.
TASK_BLOCKS = 64
#: Components of a part, entries of its codebook, rows that codebooks are fitted on, and rounds of the fit.
PART_WIDTH, ENTRIES, SAMPLE_ROWS, FIT_ROUNDS = 2, 256, 4096, 6
#: Bounds are widened by this share, far more than the error of their floats.
SLACK = 1e-9


@dataclass
class Quantizer:
    """Codebooks for vectors of one length, with whole-number entries, so that scores from tables are whole numbers too."""

    edges: list[int]
    entries: list[np.ndarray]

    @staticmethod
    def fit(sample: np.ndarray) -> Quantizer:
        """k-means for each part of the sample; without a sample each codebook is the zero vector."""
        dim = sample.shape[1]
        edges = [*range(0, dim, PART_WIDTH), dim]
        return Quantizer(edges, [_means(sample[:, a:b]) for a, b in zip(edges, edges[1:])])

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, residual norms rounded up)."""
        codes = np.zeros((len(v), len(self.entries)), dtype=np.uint8)
        squares = np.zeros(len(v))
        for p, entries in enumerate(self.entries):
            own = v[:, self.edges[p] : self.edges[p + 1]].astype(np.float64)
            codes[:, p] = _closest(own, entries.astype(np.float64))
            squares += ((own - entries[codes[:, p]]) ** 2).sum(axis=1)
        return codes, np.sqrt(squares) * (1 + SLACK)

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """For each part, the inner products of queries and entries."""
        return [queries[:, a:b] @ e.T.astype(queries.dtype) for a, b, e in zip(self.edges, self.edges[1:], self.entries)]


def _closest(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((entries**2).sum(axis=1) - 2 * (rows @ entries.T)).argmin(axis=1)


def _means(rows: np.ndarray) -> np.ndarray:
    """Up to ENTRIES whole-number means of ``rows``; they start as evenly spaced ones of the distinct rows."""
    distinct = np.unique(rows, axis=0)
    if not len(distinct):
        return np.zeros((1, rows.shape[1]), dtype=np.int64)
    found = distinct[np.linspace(0, len(distinct) - 1, min(ENTRIES, len(distinct))).astype(int)].astype(np.float64)
    for _ in range(FIT_ROUNDS if len(distinct) > ENTRIES else 0):
        code = _closest(rows.astype(np.float64), found)
        n = np.bincount(code, minlength=len(found))
        for j in range(rows.shape[1]):
            sums = np.bincount(code, weights=rows[:, j], minlength=len(found))
            found[n > 0, j] = sums[n > 0] / n[n > 0]
    return np.rint(found).astype(np.int64)


def labelled(vectors: DataFrame, scale: int, relabel: int, labels: int, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(row_id, vec_id, label, dim, v array<long>) of the vectors that take part, a staged table; labels of ids divisible by ``relabel`` go to the next of ``labels``."""
    x = F.col("x")
    wide = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{embedding}`").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = wide.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite)
    moved = F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return stage(with_row_id(good.select("vec_id", moved.alias("label"), F.size("x").alias("dim"), F.transform("x", lambda c: F.floor(c * scale)).alias("v"))), "vectors")


def fit(rows: DataFrame) -> dict[int, Quantizer]:
    """A quantizer for each length in a sample of at most SAMPLE_ROWS rows, those of the smallest id hashes."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "row_id").select("dim", "v").limit(SAMPLE_ROWS).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r["dim"], []).append(r["v"])
    return {dim: Quantizer.fit(np.array(v, dtype=np.int64).reshape(len(v), dim)) for dim, v in by_dim.items()}


def _quantizer(found: dict[int, Quantizer], dim: int) -> Quantizer:
    return found.get(dim) or found.setdefault(dim, Quantizer.fit(np.zeros((0, dim), dtype=np.int64)))


def _index(rows: DataFrame, quantizers: dict[int, Quantizer], shards: int) -> DataFrame:
    """(dim, shard, rows array<struct>): every row's label, ids, code, residual norm and components, dealt to shards by a hash of the row: a staged table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            lists, codes, norms, raw = batch.column("v"), [b""] * len(dims), np.zeros(len(dims)), [b""] * len(dims)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                v = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                own, norms[at] = _quantizer(quantizers, dim).encode(v)
                for i, c, m in zip(at.tolist(), own, v):
                    codes[i], raw[i] = c.tobytes(), m.tobytes()
            keep = [batch.column(n) for n in ("row_id", "vec_id", "label", "dim")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(codes, pa.binary()), pa.array(norms), pa.array(raw, pa.binary())], names=["row_id", "vec_id", "label", "dim", "code", "norm", "m"])

    with arrow_rows(rows.sparkSession, 4096):
        coded = rows.mapInArrow(run, "row_id long, vec_id long, label long, dim int, code binary, norm double, m binary")
        dealt = coded.withColumn("shard", F.pmod(F.xxhash64("row_id"), F.lit(shards)).cast("int"))
        return stage(dealt.groupBy("dim", "shard").agg(F.sort_array(F.collect_list(F.struct("label", "vec_id", "row_id", "norm", "code", "m"))).alias("rows")), "index")


class Shard:
    """A shard's rows in the order of their labels."""

    def __init__(self, dim: int, rows: list[dict]):
        column = lambda c, t: np.array([r[c] for r in rows], dtype=t)
        self.dim, self.labels, self.ids, self.uids, self.norms = dim, column("label", np.int64), column("vec_id", np.int64), column("row_id", np.int64), column("norm", np.float64)
        self.codes = np.frombuffer(b"".join(r["code"] for r in rows), dtype=np.uint8).reshape(len(rows), -1)
        self.m = np.frombuffer(b"".join(r["m"] for r in rows), dtype=np.int64).reshape(len(rows), dim)
        self.most = float(np.abs(self.m).max(initial=0))
        self.exact: dict[type, np.ndarray] = {}

    def rows(self, kind: type) -> np.ndarray:
        if kind not in self.exact:
            self.exact[kind] = self.m.astype(kind)
        return self.exact[kind]

    def of(self, label: int) -> slice:
        """The rows of a label."""
        return slice(*np.searchsorted(self.labels, [label, label + 1]).tolist())

    def bounds(self, quantizer: Quantizer, queries: np.ndarray, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """For each query and row, numbers that the exact score lies between: the score of the code, less and plus the length of the query times that of the residual."""
        codes = self.codes[at]
        score = np.zeros((len(queries), len(codes)), dtype=queries.dtype)
        for p, table in enumerate(quantizer.tables(queries)):
            score += table[:, codes[:, p]]
        score = score.astype(np.float64)
        lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        far = np.outer(lengths, self.norms[at]) * (1 + SLACK) + np.abs(score) * 1e-12 + 0.5
        return score - far, score + far


def _best(scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> list[int]:
    """Places of the ``k`` best: higher scores, then smaller ids."""
    return np.lexsort((uids, ids, -scores))[:k].tolist()


def _kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, -k)[-k]) if len(values) >= k else -np.inf


def _positives(shard: Shard, quantizer: Quantizer, anchors: list[dict], queries: np.ndarray, k: int) -> list[tuple]:
    """(anchor's row, anchor, label, row, id, score): each anchor's best rows of its label."""
    found = []
    labels = np.array([a["label"] for a in anchors])
    for label in np.unique(labels).tolist():
        at = shard.of(label)
        if at.start == at.stop:
            continue
        asked = np.flatnonzero(labels == label)
        low, high = shard.bounds(quantizer, queries[asked], at)
        rows, ids, uids = shard.rows(queries.dtype.type)[at], shard.ids[at], shard.uids[at]
        for i, a in enumerate(asked.tolist()):
            others = uids != anchors[a]["row_id"]
            floor = anchors[a]["floor"]
            least = max(-np.inf if floor is None else floor, _kth(low[i][others], k))
            near = np.flatnonzero(others & (high[i] >= least))
            scores = rows[near] @ queries[a]
            for j in _best(scores, ids[near], uids[near], k):
                found.append((anchors[a]["row_id"], anchors[a]["vec_id"], label, int(uids[near[j]]), int(ids[near[j]]), int(scores[j])))
    return found


def _negatives(shard: Shard, quantizer: Quantizer, anchors: list[dict], queries: np.ndarray, k: int) -> list[tuple]:
    """(anchor's row, anchor, positive's row, positive, its score, row, id, score): the best rows of other labels in each window of an anchor."""
    found = []
    low, high = shard.bounds(quantizer, queries, slice(0, len(shard.ids)))
    rows = shard.rows(queries.dtype.type)
    for a, anchor in enumerate(anchors):
        other = np.ones(len(shard.ids), dtype=bool)
        other[shard.of(anchor["label"])] = False
        lows, highs = low[a], high[a]
        asked, union = [], np.zeros(len(other), dtype=bool)
        for w in anchor["windows"]:
            sure = lows[other & (lows >= w["low"]) & (highs <= w["high"])]  # in the window for certain
            least = max(w["low"], _kth(sure, k), -np.inf if w["floor"] is None else w["floor"])
            near = other & (highs >= least) & (lows <= w["high"])
            union |= near
            asked.append((w, near))
        at = np.flatnonzero(union)
        scores = rows[at] @ queries[a]
        for w, near in asked:
            inside = near[at] & (scores >= w["low"]) & (scores <= w["high"])
            own = at[inside]
            for j in _best(scores[inside], shard.ids[own], shard.uids[own], k):
                found.append((anchor["row_id"], anchor["vec_id"], w["positive_uid"], w["positive_id"], w["positive_score"], int(shard.uids[own[j]]), int(shard.ids[own[j]]), int(scores[inside][j])))
    return found


POSITIVE = "anchor_uid long, anchor_id long, label long, positive_uid long, positive_id long, positive_score long"
NEGATIVE = "anchor_uid long, anchor_id long, positive_uid long, positive_id long, positive_score long, uid long, negative_id long, negative_score long"


def _search(index: DataFrame, blocks: DataFrame, quantizers: dict[int, Quantizer], kernel, k: int, shards: int, first: int, last: int, schema: str) -> DataFrame:
    """What ``kernel`` finds for each block of anchors (dim, block, anchors) in the shards ``first`` to ``last`` places after its own. A shard goes to a task once, before up to TASK_BLOCKS blocks."""
    visits = blocks.select("*", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("place"))
    visits = visits.withColumn("shard", F.pmod(F.col("block") + F.col("place"), F.lit(shards)).cast("int")).withColumn("task", F.floor(F.col("block") / (TASK_BLOCKS * shards)).cast("int"))
    held = index.join(visits.select("dim", "shard", "task").distinct(), ["dim", "shard"])
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    names = ["dim", "shard", "task", "kind", "rows", "anchors"]
    held = held.withColumn("kind", F.lit(0)).withColumn("anchors", none(blocks, "anchors")).select(names)
    stream = held.unionByName(visits.withColumn("kind", F.lit(1)).withColumn("rows", none(index, "rows")).select(names))
    stream = stream.repartition("dim", "shard", "task").sortWithinPartitions("dim", "shard", "task", "kind")
    fields = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, loaded = None, None
        for batch in batches:
            for x in batch.to_pylist():
                place = (x["dim"], x["shard"], x["task"])
                if not x["kind"]:
                    shard, loaded = Shard(x["dim"], x["rows"]), place
                elif loaded == place:  # else no vector of this length is in the shard
                    queries = np.frombuffer(b"".join(a["m"] for a in x["anchors"]), dtype=np.int64).reshape(len(x["anchors"]), x["dim"])
                    quantizer = _quantizer(quantizers, x["dim"])
                    most = max([shard.most, *(float(np.abs(e).max(initial=0)) for e in quantizer.entries)]) * float(np.abs(queries).max(initial=0)) * max(1, x["dim"])
                    found = kernel(shard, quantizer, x["anchors"], queries.astype(np.float64 if most < 2**53 else np.int64), k)  # products of floats are exact below, and faster
                    columns = list(zip(*found)) or [()] * len(fields)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=fields)

    with arrow_rows(index.sparkSession, 2):
        return stage(stream.mapInArrow(run, schema), "found")


def _rounds(index: DataFrame, asked: DataFrame, quantizers: dict[int, Quantizer], kernel, k: int, shards: int, schema: str, keys: list[str], score: str, order: list, block) -> DataFrame:
    """The ``k`` best for each of ``keys``: anchors search 1, then 2, 4, .. shards at a time, and each round's kth score is the floor of the next. ``block`` makes (dim, block, anchors) of ``asked`` and the floors (``keys``, floor) so far."""
    best, place, floors = None, 0, None
    window = Window.partitionBy(*keys).orderBy(*order)
    while True:
        last = min(shards - 1, 2 * place)
        found = _search(index, block(asked, floors), quantizers, kernel, k, shards, place, last, schema)
        found = found if best is None else best.drop("rank").unionByName(found)
        best = found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
        place = last + 1
        if place >= shards:
            return best
        best = stage(best, "best")
        floors = best.groupBy(*keys).agg(F.min(score).alias("floor"), F.count("*").alias("n")).filter(F.col("n") >= k).drop("n")


def mine(
    vectors: DataFrame, positives: int = 5, negatives: int = 10, every: int = 100, scale: int = 256, low: int = 30, high: int = 90, relabel: int = 7, labels: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (vec_id divisible by ``every``) and each of its first ``positives`` other rows of the same label, the first ``negatives`` rows of other labels that score ``low`` to ``high`` percent of the positive.

    A score is the inner product with the anchor, of components floor(scale *
    x); higher ones come first, ties by smaller vec_id. Labels of ids divisible
    by ``relabel`` are first moved on by one, modulo ``labels``.

    Rows with a null id, label or vector, or with a null or non-finite
    component, take no part; vectors of different lengths never meet.
    Repeated rows are rows: each is a candidate of the others and an anchor of
    its own. With fewer candidates all are returned; a positive that scores
    below zero has no window; an empty table returns none. Scores must fit a
    long. Other columns are not read.

    Codebooks are fitted on at most SAMPLE_ROWS rows; every row is indexed. A
    row is left out only if its bounds rule it out, so results are exact.
    """
    rows = labelled(vectors, scale, relabel, labels, vec_id, embedding, label)
    quantizers = fit(rows)
    shards = max(1, -(-rows.count() // shard_rows))
    index = _index(rows, quantizers, shards)
    anchors = rows.filter(F.col("vec_id") % every == 0)
    blocks_n = max(1, -(-anchors.count() // BLOCK_ROWS))
    in_index = index.select("dim", F.explode("rows").alias("r")).select("dim", "r.*").filter(F.col("vec_id") % every == 0)
    anchors = stage(in_index.select("dim", "row_id", "vec_id", "label", "m", F.pmod(F.xxhash64("row_id", F.lit(1)), F.lit(blocks_n)).cast("int").alias("block")), "anchors")

    def same_label(asked: DataFrame, floors: DataFrame | None) -> DataFrame:
        told = asked.withColumn("floor", F.lit(None).cast("long")) if floors is None else asked.join(floors.withColumnRenamed("anchor_uid", "row_id"), "row_id", "left")
        return told.groupBy("dim", "block").agg(F.collect_list(F.struct("row_id", "vec_id", "label", "m", "floor")).alias("anchors"))

    by_anchor = [F.desc("positive_score"), F.asc("positive_id"), F.asc("positive_uid")]
    near = stage(_rounds(index, anchors, quantizers, _positives, positives, shards, POSITIVE, ["anchor_uid"], "positive_score", by_anchor, same_label), "positives")
    # whole numbers: the least and the greatest score of each window
    windows = near.withColumn("low", F.expr(f"-((-{low} * positive_score - pmod(-{low} * positive_score, 100)) div 100)")).withColumn("high", F.expr(f"({high} * positive_score - pmod({high} * positive_score, 100)) div 100"))
    windows = stage(windows.filter("low <= high").select("anchor_uid", "positive_uid", "positive_id", "positive_score", "low", "high"), "windows")

    def in_windows(asked: DataFrame, floors: DataFrame | None) -> DataFrame:
        told = asked.withColumn("floor", F.lit(None).cast("long")) if floors is None else asked.join(floors, ["anchor_uid", "positive_uid"], "left")
        lists = told.groupBy("anchor_uid").agg(F.collect_list(F.struct("positive_uid", "positive_id", "positive_score", "low", "high", "floor")).alias("windows"))
        held = anchors.join(lists, anchors.row_id == lists.anchor_uid)
        return held.groupBy("dim", "block").agg(F.collect_list(F.struct("row_id", "vec_id", "label", "m", "windows")).alias("anchors"))

    by_window = [F.desc("negative_score"), F.asc("negative_id"), F.asc("uid")]
    found = _rounds(index, windows, quantizers, _negatives, negatives, shards, NEGATIVE, ["anchor_uid", "positive_uid"], "negative_score", by_window, in_windows)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
