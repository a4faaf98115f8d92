"""The audit log: hash chains, their verification, searches and roll-ups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from leakflow.functions.hashing import FIELD_SEPARATOR, chain_hash
from leakflow.session import new_path, staged


#: A task folds so many rows of one chain at most.
BLOCK = 1 << 20


def build_chain(rows: DataFrame, key: str, order: str, fields: list[str], block: int = BLOCK) -> DataFrame:
    """``rows`` with ``prev_hash`` and ``row_hash``, chained in ``order`` within each ``key``.

    A chain is a fold. Where none is longer than ``block``, the table is dealt
    by key and sorted, and each task's rows stream through in batches with
    only the last hash kept. Otherwise see ``_by_ranges``.
    """
    text = rows.select("*", F.concat(*(F.concat(F.lit(FIELD_SEPARATOR), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields)).alias("text_"))
    longest = rows.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    if longest > block:
        return _by_ranges(text, key, order, block).select(*rows.columns, "prev_hash", "row_hash")
    sorted_rows = text.withColumn("part_", F.lit(0)).repartition(key).sortWithinPartitions(key, order)
    return sorted_rows.mapInArrow(_folder(key, {}, ()), _chained(sorted_rows)).select(*rows.columns, "prev_hash", "row_hash")


def _chained(rows: DataFrame) -> str:
    return ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes if n != "text_"), "prev_hash string", "row_hash string", "at_ long"])


def _folder(key: str, starts: dict[int, str], skipped: tuple[int, ...] | set[int]):
    """Folds sorted rows (``key``, part_, text_, ..). Of parts in ``starts`` only the first key's rows, from the hash there; of parts in ``skipped`` all but the first key's. ``at_`` is a row's place in the part."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, part, now, first, last, at = False, None, None, True, "", 0
        for batch in batches:
            kept, previous, made, places = [], [], [], []
            for i, (p, k, t) in enumerate(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part_", key, "text_")))):
                if not begun or p != part:
                    begun, part, now, first, last, at = True, p, k, True, starts.get(p, ""), 0
                elif k != now:
                    now, first, last = k, False, ""
                at += 1
                if first and p in skipped or not first and p in starts:
                    continue
                kept.append(i)
                previous.append(last)
                last = hashlib.sha256((last + t).encode()).hexdigest()
                made.append(last)
                places.append(at)
            others = batch.select([n for n in batch.schema.names if n != "text_"])
            others = others if len(kept) == batch.num_rows else others.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*others.columns, pa.array(previous, pa.string()), pa.array(made, pa.string()), pa.array(places, pa.int64())], names=[*others.schema.names, "prev_hash", "row_hash", "at_"])

    return fold


def _by_ranges(text: DataFrame, key: str, order: str, block: int) -> DataFrame:
    """Chains of any length: rows are dealt to ranges of (key, order) of about ``block`` rows, and a task folds one range.

    Only the first key of a range can go on from the range before. All other
    keys are folded at once; then rounds follow, each with the next range of
    every chain that has one, from the hash at the end of the one before. The
    rounds are as many as ranges of the longest chain, which is a fold and has
    no other way; what a task holds doesn't grow. The driver holds two keys
    and a hash a range.
    """
    spark, home = text.sparkSession, new_path(text.sparkSession, "chains")
    dealt = text.repartitionByRange(-(-text.count() // block), key, order).withColumn("part_", F.spark_partition_id())
    dealt = staged(dealt, "ranges")
    ends = dealt.groupBy("part_").agg(F.min(F.struct(key)).alias("least"), F.max(F.struct(key)).alias("most")).orderBy("part_").collect()
    rounds: list[dict[int, int]] = [{}]  # of each range that goes on, the one before
    whole, before, later = 0, None, []  # in which round the last key of the range before comes; ranges with nothing for the first round
    for r in ends:
        goes_on = before is not None and before["most"] == r["least"]
        if goes_on:
            own = whole + 1
            rounds.extend({} for _ in range(own + 1 - len(rounds)))
            rounds[own][r["part_"]] = before["part_"]
        whole = own if goes_on and r["least"] == r["most"] else 0
        later += [r["part_"]] if whole else []
        before = r
    skipped = {p for found in rounds for p in found}
    for i, found in enumerate(rounds):
        rows, starts = dealt.filter(~F.col("part_").isin(later)) if later else dealt, {}
        if i:
            rows = dealt.filter(F.col("part_").isin(*found))
            known = spark.read.parquet(f"{home}/round={i - 1}").filter(F.col("part_").isin(*found.values()))
            hashes = dict(known.groupBy("part_").agg(F.max_by("row_hash", "at_")).collect())
            starts = {p: hashes[was] for p, was in found.items()}
        dealt_again = rows.repartitionByRange(len(found) if i else max(1, len(ends) - len(later)), "part_").sortWithinPartitions("part_", key, order)
        dealt_again.mapInArrow(_folder(key, starts, set() if i else skipped), _chained(dealt_again)).write.option("compression", "zstd").parquet(f"{home}/round={i}")
    return spark.read.schema(_chained(text)).parquet(home)


def _appender(place: str):
    """Goes on with a chain from its last hash and number, which are all that is kept of it and come along with its rows."""

    def go_on(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        number, last = state.get if state.exists else (0, "")
        batch = pd.concat(list(batches)).sort_values(place, kind="stable")
        previous, made = [], []
        for text in batch["text_"]:
            previous.append(last)
            last = hashlib.sha256((last + text).encode()).hexdigest()
            made.append(last)
        state.update((number + len(made), last))
        yield batch.drop(columns="text_").assign(number=range(number + 1, number + len(made) + 1), prev_hash=previous, row_hash=made)

    return go_on


#: State of many keys needs this store; batches write what changed, not the whole of it.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def append_chain(stream: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """A stream's rows with ``number``, ``prev_hash`` and ``row_hash``: each batch goes on with the chains where the ones before ended, also after a restart from the checkpoint.

    Rows of a batch are chained in ``order`` (equal ones as they come), batches
    as they come. A task holds a chain's rows of one batch, which triggers
    bound. The session needs STATE_STORE.
    """
    text = F.concat(*(F.concat(F.lit(FIELD_SEPARATOR), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in stream.dtypes), "number long, prev_hash string, row_hash string"])
    return stream.withColumn("text_", text).groupBy(key).applyInPandasWithState(_appender(order), schema, "number long, row_hash string", "append", GroupStateTimeout.NoTimeout)


def verify_chain(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """(key, checked, legacy, first_broken): rows without a hash are legacy and skipped; a row is broken if its previous hash isn't that of the row before, or its own doesn't fit its fields.

    Rows are dealt to ranges of (key, order), so a single chain fills as many
    tasks as it needs. What each range tells of a chain is a row: its counts,
    its first broken row, and the hashes at its two ends, which are compared
    with those of the ranges beside it. A null key is a key; rows of equal
    order stand in no particular one.
    """
    empty = F.lit("")
    told = rows.select(
        F.col(f"`{key}`").alias("k"), F.col(f"`{order}`").alias("o"), F.coalesce("prev_hash", empty).alias("before"), F.coalesce("row_hash", empty).alias("own"),
        F.coalesce(F.col("row_hash") == chain_hash(F.col("prev_hash"), [F.col(f"`{f}`") for f in fields]), F.lit(False)).alias("fits"),
    )
    kinds = dict(told.dtypes)
    dealt = told.repartitionByRange("k", "o").sortWithinPartitions("k", "o")
    schema = f"k {kinds['k']}, part int, checked long, legacy long, first_o {kinds['o']}, first_before string, last_own string, broken {kinds['o']}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now = TaskContext.get().partitionId(), None
        for batch in batches:
            names, (k, o, before, own, fits) = [f.strip().split(" ")[0] for f in schema.split(", ")], batch.columns
            types = [k.type, pa.int32(), pa.int64(), pa.int64(), o.type, pa.string(), pa.string(), o.type]
            done = []
            for first, last in _runs(k):
                if now is None or now[0] != k[first].as_py():
                    if now is not None:
                        done.append(now)
                    now = [k[first].as_py(), part, 0, 0, None, None, None, None]
                hashes = own.slice(first, last - first).to_pylist()
                chained = [i for i, h in enumerate(hashes) if h]
                now[3] += len(hashes) - len(chained)
                if not chained:
                    continue
                previous = before.slice(first, last - first).to_pylist()
                good = fits.slice(first, last - first).to_pylist()
                ends = [now[6], *(hashes[i] for i in chained)]
                if not now[2]:
                    now[4], now[5] = o[first + chained[0]].as_py(), previous[chained[0]]
                    ends[0] = now[5]  # whether it is the one before is told between ranges
                now[2] += len(chained)
                now[6] = ends[-1]
                if now[7] is None:
                    now[7] = next((o[first + i].as_py() for i, e in zip(chained, ends) if not good[i] or previous[i] != e), None)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[i]], t) for i, t in enumerate(types)], names=names)

    ranges = dealt.mapInArrow(run, schema)
    # a row for each key and range that it lies in: few for one key, as many as ranges at most
    behind = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    linked = ranges.withColumn("last_before", F.coalesce(F.last("last_own", ignorenulls=True).over(behind), empty))
    broken = F.least("broken", F.when((F.col("checked") > 0) & (F.col("first_before") != F.col("last_before")), F.col("first_o")))
    found = linked.groupBy("k").agg(F.sum("checked").alias("checked"), F.sum("legacy").alias("legacy"), F.min(broken).alias("first_broken"))
    return found.select(F.col("k").alias(key), "checked", "legacy", "first_broken")


def _runs(keys: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of each run of equal keys, nulls being equal."""
    n = len(keys)
    if not n:
        return
    same = pc.fill_null(pc.equal(keys[1:], keys[:-1]), False)
    both = pc.and_(pc.is_null(keys[1:]), pc.is_null(keys[:-1]))
    starts = [0, *(np.flatnonzero(~pc.or_(same, both).to_numpy(zero_copy_only=False)) + 1).tolist(), n]
    yield from zip(starts, starts[1:])


def tail(rows: DataFrame, order: str, n: int = 20) -> DataFrame:
    """The newest ``n`` rows, the oldest first."""
    return rows.orderBy(F.desc(order)).limit(n).orderBy(order)


def search(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows that hold the text in any of the columns, in whatever case."""
    return rows.filter(F.contains(F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))), F.lit(text.lower())))


def viewport(rows: DataFrame, order: str, offset: int, n: int) -> DataFrame:
    return rows.orderBy(order).offset(offset).limit(n)


def timing_stats(rows: DataFrame, rule: str, nanos: Column) -> DataFrame:
    """(rule, total, hits, average) with whole-number averages; most expensive first."""
    return rows.groupBy(F.col(rule).alias("rule_id")).agg(F.sum(nanos).alias("total"), F.count("*").alias("hits")).withColumn("average", F.floor(F.col("total") / F.col("hits"))).orderBy(F.desc("total"), F.desc("hits"), "rule_id")


def worst(rows: DataFrame, key: str, status: str, ranks: list[str]) -> DataFrame:
    """The worst status of each key; ``ranks`` go from good to bad. A status that isn't among them doesn't count; a key of none but such has null."""
    rank = F.create_map(*(F.lit(x) for i, s in enumerate(ranks) for x in (s, i)))
    return rows.groupBy(key).agg(F.max(F.try_element_at(rank, F.col(status))).alias("r")).select(key, F.array(*map(F.lit, ranks))[F.col("r")].alias("worst"))


def verdict(events: DataFrame, command: Column, argv: Column, remote_ok: Column, has_secret: Column, block: bool = True) -> DataFrame:
    """``events`` with ``verdict``: alias tricks and unknown remotes are blocked; commits and pushes with secrets are blocked, or warned of."""
    alias = argv.rlike(r"(?i)(^|\s)-c\s*alias\.[^=\s]+=")
    rewrite = argv.rlike(r"(?i)(^|\s)-c\s*(url\..*\.(push)?insteadof|remote\..*\.(push)?url)=")
    gated = command.isin("commit", "push")
    return events.withColumn(
        "verdict",
        F.when(alias, "blocked:alias").when(rewrite, "blocked:rewrite").when(command.isin("push", "fetch", "pull", "clone") & ~remote_ok, "blocked:remote")
        .when(gated & has_secret, F.lit("blocked:secret" if block else "warned:secret")).otherwise("allowed"),
    )
