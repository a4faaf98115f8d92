"""Exact copies by a content sort: texts are dealt to key ranges with sampled borders, sorted, and compared in full with their neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakflow.llm.staging import arrow_rows, carried, restored, stage

#: What counts as space between words: each run of these is one blank.
SPACES = r"[\x20\x09-\x0D]+"
#: Characters of a text that stand in the range key before its digest.
PREFIX = 64
#: Border rows up to which they are broadcast; there are two for each range at most.
BROADCAST_BORDERS = 200_000


def normalized(text: Column) -> Column:
    """The text with each run of spaces as one blank; a null one is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


class _Runs:
    """Runs of equal neighbours in a sorted range. Only the rows of the run that is still open are held, without their texts."""

    def __init__(self, part: int, schema: pa.Schema):
        self.part, self.schema = part, schema
        self.open: list[pa.RecordBatch] = []
        self.text: str | None = None
        self.seen = 0

    def _emit(self, rows: pa.Table, sizes: np.ndarray, border: int | None, text: str | None) -> pa.RecordBatch:
        """``rows`` of whole runs of the given sizes; ``border`` and ``text`` are those of a single run at an end of the range."""
        n = rows.num_rows
        starts = np.cumsum(sizes) - sizes
        which = np.repeat(np.arange(len(sizes)), sizes)
        first = np.zeros(n, dtype=bool)
        first[starts] = True
        ids = rows.column("id_").combine_chunks()
        found = {
            "keep_": ids.take(pa.array(starts)).take(pa.array(which)), "n_": pa.array(np.repeat(sizes, sizes), pa.int64()), "first_": pa.array(first), "part_": pa.array(np.full(n, self.part), pa.int32()),
            "border_": pa.array([border] * n, pa.int32()), "edge_": pa.array([text if border is not None and i == 0 else None for i in range(n)], pa.string()),
        }
        columns = [found[f.name] if f.name in found else rows.column(f.name).combine_chunks() for f in self.schema]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, self.schema)], schema=self.schema)

    def _close(self, last: bool) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(self.open)
        border = 0 if not self.seen else 1 if last else None
        self.seen += 1
        yield self._emit(rows, np.array([rows.num_rows]), border, self.text)

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        texts = batch.column("t_")
        rows = batch.select([n for n in batch.schema.names if n != "t_"])
        new = np.ones(batch.num_rows, dtype=bool)
        new[1:] = pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
        new[0] = not self.open or texts[0].as_py() != self.text
        starts = np.flatnonzero(new)
        if not len(starts):  # all of it belongs to the open run
            self.open.append(rows)
            return
        if starts[0]:
            self.open.append(rows.slice(0, starts[0]))
        if self.open:
            yield from self._close(False)
        whole, last = starts[:-1], starts[-1]
        if len(whole) and not self.seen:  # the first run of the range is told apart
            self.open, self.text = [rows.slice(whole[0], starts[1] - whole[0])], texts[int(whole[0])].as_py()
            yield from self._close(False)
            whole = whole[1:]
        if len(whole):
            self.seen += len(whole)
            yield self._emit(pa.Table.from_batches([rows.slice(whole[0], last - whole[0])]), np.diff([*whole, last]), None, None)
        self.open, self.text = [rows.slice(last)], texts[int(last)].as_py()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.open:
            yield from self._close(True)


def _sorted_runs(source: DataFrame) -> DataFrame:
    """``source`` (c0.., id_, t_, d_) without its texts, and for each row its run within a range: keep_ (least id), n_, first_, part_, border_ (0 for the first run of a range, 1 for the last), edge_ (the text of such a run, once). A staged table."""
    prefix = F.substring("t_", 1, PREFIX)
    # equal texts have equal prefixes and digests; the row number lets a large group of copies span ranges
    ranged = source.withColumn("u_", F.monotonically_increasing_id()).repartitionByRange(prefix, "d_", "u_").drop("u_")
    dealt = ranged.sortWithinPartitions(prefix, "d_", "t_", F.col("id_").asc_nulls_last())
    types = [(n, t) for n, t in source.dtypes if n != "t_"]
    id_type = dict(types)["id_"]
    schema = ", ".join([*(f"{n} {t}" for n, t in types), f"keep_ {id_type}, n_ long, first_ boolean, part_ int, border_ int, edge_ string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = None
        for batch in batches:
            if runs is None:
                narrow = [f for f in batch.schema if f.name != "t_"]
                id_field = batch.schema.field("id_").type
                more = [("keep_", id_field), ("n_", pa.int64()), ("first_", pa.bool_()), ("part_", pa.int32()), ("border_", pa.int32()), ("edge_", pa.string())]
                runs = _Runs(TaskContext.get().partitionId(), pa.schema([*narrow, *(pa.field(n, t) for n, t in more)]))
            yield from runs.add(batch)
        if runs is not None:
            yield from runs.end()

    with arrow_rows(source.sparkSession, 500):
        return stage(dealt.mapInArrow(run, schema), "runs")


def _across_borders(runs: DataFrame) -> DataFrame:
    """(part_, border_, whole_n, whole_keep, leads): for runs that go on in the next range, what holds for all of them together. Two rows a range at most."""
    ends = stage(runs.filter(F.col("edge_").isNotNull()).select("part_", "border_", "keep_", "n_", "edge_"), "borders")
    order = Window.orderBy("part_", "border_")  # rows of three numbers, two for each range
    numbered = ends.select("part_", "border_", "keep_", "n_").withColumn("at", F.row_number().over(order))
    texts = numbered.select("part_", "border_", "at").join(ends.select("part_", "border_", "edge_"), ["part_", "border_"]).select("at", "edge_")
    before = texts.select((F.col("at") + 1).alias("at"), F.col("edge_").alias("before_"))
    same = texts.join(before, "at").filter("edge_ = before_").select("at", F.lit(0).alias("new"))
    chains = numbered.join(same, "at", "left").withColumn("chain", F.sum(F.coalesce("new", F.lit(1))).over(order))
    least = F.min(F.struct(F.col("keep_").isNull().alias("none"), F.col("keep_").alias("id"), "at")).alias("least")
    whole = chains.groupBy("chain").agg(F.sum("n_").alias("whole_n"), least, F.count("*").alias("members")).filter("members > 1")
    joined = chains.join(whole, "chain").select("part_", "border_", "whole_n", F.col("least.id").alias("whole_keep"), (F.col("at") == F.col("least.at")).alias("leads"))
    return stage(joined, "chains")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of each row (``doc_id`` by default), keep_id, group_size, kept, text_sha256: groups of rows whose texts are equal but for runs of spaces.

    The row with the least doc_id of a group stays, a null id only where the
    group has no other; of repeated rows one stays. Null and empty texts are
    one group. An empty table gives an empty result. Texts of any length are
    compared in full. Columns named like the ones that are added are replaced.

    Ranges are cut between (first characters, digest, row), from a sample that
    Spark takes of such keys (whole texts don't reach the driver), so copies
    of one text, however many, fill as many ranges as they need. What lies at
    both ends of a range is compared with its neighbour's end afterwards.
    """
    kept_columns, names = carried(docs, [doc_id] if keep is None else keep)
    extra = [F.col(f"`{doc_id}`").alias("id_"), normalized(F.col(f"`{text}`")).alias("t_")]
    source = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), *extra)
    source = source.withColumn("d_", F.unhex(F.sha2(F.col("t_"), 256)))
    runs = _sorted_runs(source)
    chains = _across_borders(runs)
    few = chains.count() <= BROADCAST_BORDERS
    told = runs.drop("edge_").join(F.broadcast(chains) if few else chains, ["part_", "border_"], "left")
    lone = F.col("whole_n").isNull()
    whole = told.select(
        *kept_columns.columns, F.when(lone, F.col("keep_")).otherwise(F.col("whole_keep")).alias("keep_id"), F.coalesce("whole_n", "n_").alias("group_size"),
        (F.col("first_") & F.coalesce("leads", F.lit(True))).alias("kept"), F.lower(F.hex("d_")).alias("text_sha256"),
    )
    return restored(whole, names, "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of ``exact_groups``; its own columns stay as they are."""
    place = "kept_row_"
    while place in docs.columns:
        place += "_"
    wide = docs.select("*", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(place))
    return exact_groups(wide, doc_id, text, [place]).filter("kept").select(f"{place}.*")
