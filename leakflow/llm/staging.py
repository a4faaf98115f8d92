"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakflow.session import new_path, shuffled


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here, and lost executors cost no work done before."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def carried(df: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The ``keep`` columns (all by default) under the neutral names c0, c1, .. and their own names, so that what an operator adds never clashes with them."""
    keep = df.columns if keep is None else keep
    return df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep))), keep


def restored(df: DataFrame, names: list[str], *more: str) -> DataFrame:
    """The columns of ``carried`` under their own names again, and ``more`` columns, which replace equally named ones."""
    return df.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c not in more), *more)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A unique long for each row. It is fixed only once the frame is staged."""
    return df.withColumn(name, F.monotonically_increasing_id())


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the actions run inside, so that long texts don't fill a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: A key is hot if more rows than this share of all have it; so there are no more hot keys than this number.
HOT_SHARE, HOT_ROWS = 100_000, 256
#: So many narrow rows fit a task even if one key has them all.
TASK_ROWS = 1 << 20


def join_by_count(rows: DataFrame, table: DataFrame, on: list[str], n: str, total: int, merge: bool = False) -> DataFrame:
    """``rows`` with the row of ``table`` that has their key. ``table`` has a row a key, and in ``n`` how many of the ``total`` rows have it at most.

    Rows of hot keys stay where they are: what ``table`` has of these keys is
    broadcast, HOT_SHARE rows at most. Only the others are shuffled. Where all
    rows together would fit a task, no key needs this. With ``merge`` Spark
    isn't left to broadcast the other keys where they are few enough for it.
    """
    side = shuffled if merge else lambda t: t
    if total <= TASK_ROWS:
        return rows.join(side(table), on)
    often = max(HOT_ROWS, total // HOT_SHARE)
    hot = F.broadcast(table.filter(F.col(n) > often))
    cold = table.filter(F.col(n) <= often)
    apart = rows.join(F.broadcast(table.filter(F.col(n) > often).select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(apart.join(side(cold), on))


#: So many longs, of 64 rows each, are broadcast at most.
MARKS = 100_000


def marked(rows: DataFrame, ids: DataFrame, *flags: str, key: str = "row_id", apart: bool = False) -> DataFrame:
    """``rows`` whose ``key``, a long, is in ``ids`` (key, ``flags``), with the ``flags``; a null one is false. With ``apart``, those not in ``ids`` (no flags).

    Wide rows stay where they are, as a bit for each is broadcast. Where these
    are more than MARKS longs, both sides are shuffled. With flags ``ids`` has
    each key once.
    """
    word, at = F.shiftright(key, 6), F.expr(f"CAST({key} & 63 AS INT)")
    bit = F.expr(f"shiftleft(1L, CAST({key} & 63 AS INT))")
    told = (F.coalesce(F.bit_or(F.when(F.col(f), bit)), F.lit(0).cast("long")).alias(f) for f in flags)
    bits = stage(ids.groupBy(word.alias("word_")).agg(F.bit_or(bit).alias("bits_"), *told), "bits")
    if bits.count() > MARKS:
        few = ids.select(key, *(F.coalesce(f, F.lit(False)).alias(f) for f in flags))
        return rows.join(shuffled(few), key, "left_anti" if apart else "inner" if flags else "left_semi")
    has = lambda c: F.getbit(F.coalesce(c, F.lit(0).cast("long")), at) == 1
    told = rows.join(F.broadcast(bits), word == F.col("word_"), "left" if apart else "inner")
    here = told.filter(~has("bits_") if apart else has("bits_"))
    return here.select(*rows.columns, *(has(f).alias(f) for f in flags))
