"""Near-duplicate links of SimHash fingerprints: pivot cells select the candidates, exact Jaccard similarity of shingle sets decides."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakflow.llm.components import connected_components
from leakflow.llm.simhash import CELL_WORDS, SEED, _hashes, cell_keys, fingerprint, majorities, pivot_cells
from leakflow.llm.staging import arrow_rows, carried, marked, stage, with_row_id
from leakflow.session import shuffled

#: Bits of 512 in which sets of similarity 0.8 differ at most: 63 to 78 on average (96 for sets of five), deviation 8; unrelated ones differ in 256, deviation 11.
RADIUS = 136
#: Buckets of up to so many nodes are compared pair by pair.
BUCKET = 8
#: Larger ones are cut so many times at most.
CUTS = 3
_WORDS = [f"fp{i}" for i in range(CELL_WORDS)]


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct XXH64 of a text's shingles, in order; a text of fewer words is one shingle."""
    pieces = list(_hashes((text or "").encode("utf-8", "surrogatepass"), shingle))
    return np.unique(np.concatenate(pieces)) if pieces else np.zeros(0, dtype=np.uint64)


def band_keys(hashes: np.ndarray) -> list[int]:
    """The keys of a set's pivot cells; none for an empty set."""
    return cell_keys(pivot_cells(majorities([hashes], CELL_WORDS)[None]))[0].tolist() if len(hashes) else []


def signatures(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """The columns of ``docs`` as c0, c1, .., a unique ``row_id``, the shingle set's ``digest`` (128 bits), its ``size``, fingerprint words ``fp0``.. and pivot ``cells`` (null for an empty set): a staged table."""
    kept = carried(docs, [text, *docs.columns])[0]
    source = kept.select(F.col("c0").alias("text_"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(kept.columns[1:])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes = [], []
            counts = np.zeros((batch.num_rows, CELL_WORDS, 64), dtype=np.int64)
            for i, t in enumerate(batch.column(0)):
                hashes = shingle_set(t.as_py(), shingle)
                digests.append(xxhash.xxh128_digest(hashes.tobytes(), SEED))
                sizes.append(len(hashes))
                counts[i] = majorities([hashes], CELL_WORDS)
            cells = [row.tobytes() if n else None for row, n in zip(pivot_cells(counts), sizes)]
            words = fingerprint(counts).view(np.int64)
            found = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), *(pa.array(words[:, i]) for i in range(CELL_WORDS)), pa.array(cells, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *found], names=[*batch.schema.names[1:], "digest", "size", *_WORDS, "cells"])

    schema = ", ".join([*(f"{n} {t}" for n, t in source.dtypes[1:]), "digest binary, size long", *(f"{w} long" for w in _WORDS), "cells binary"])
    with arrow_rows(docs.sparkSession, 2000):
        return stage(with_row_id(source.mapInArrow(run, schema)), "signatures")


def _banded(nodes: DataFrame) -> DataFrame:
    """(row_id, size, bands) for nodes (row_id, size, cells): the keys of their pivot cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keys = cell_keys(np.array([np.frombuffer(c.as_py(), dtype=np.uint8) for c in part.column(2)]))
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), keys.ravel())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], lists], names=["row_id", "size", "bands"])

    return nodes.select("row_id", "size", "cells").filter("cells is not null").mapInArrow(run, "row_id long, size long, bands array<long>")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(row_id, large, hashes array<long>) for (row_id, large, text_): a staged table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shingle_set(t.as_py(), shingle).view(np.int64) for t in batch.column(2)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], found], names=["row_id", "large", "hashes"])

    with arrow_rows(texts.sparkSession, 500):
        return stage(texts.select("row_id", "large", "text_").mapInArrow(run, "row_id long, large boolean, hashes array<long>"), "sets")


#: Salts of a group's hub, and how many hubs a large group gets before its parts are compared.
SALTS, HUBS = 32, 6
#: So many sets of a large group, about, tell which hashes are common in it.
SAMPLE = 128


def _apart(a: Column, b: Column) -> Column:
    """The Hamming distance of the fingerprints ``a`` and ``b``, structs of words."""
    return sum((F.bit_count(a[w].bitwiseXOR(b[w])) for w in _WORDS), F.lit(0))


def _counted(members: DataFrame, *bucket: str) -> DataFrame:
    """``members`` of buckets of more than one node, with their number ``n`` and the ``first``."""
    own = Window.partitionBy(*bucket)
    return members.withColumn("n", F.count("*").over(own)).withColumn("first", F.min("row_id").over(own)).filter("n > 1")


def _thinned(near: DataFrame) -> DataFrame:
    """Fewer (u, v) that connect the same nodes, where many u have the same few v: each u and all its v are linked to the least of these."""
    told = near.select("u", "v", F.min("v").over(Window.partitionBy("u")).alias("least"))
    told = told.select("u", F.col("least").alias("v")).unionByName(told.select(F.col("v").alias("u"), F.col("least").alias("v")))
    return told.filter("u <> v").distinct()


def _cut(large: DataFrame, prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links (u, v), members (band, row_id, size) that are cut off) of buckets (band, row_id, size, n).

    The pivot of a bucket is the node that shares most with others, so that
    buckets of the same nodes have few pivots between them. A distance is the
    same in all buckets that both nodes share and is worked out once for
    these. Where the distances to a pivot, in order, leave a gap wider than
    RADIUS, no pair within RADIUS can be across it: the nodes below it are
    linked to the pivot, those beyond are cut off.
    """
    own, shared = F.struct(*_WORDS), F.sum("n").over(Window.partitionBy("row_id"))
    pivot = F.max_by("row_id", F.struct("shared", -F.col("row_id"))).over(Window.partitionBy("band"))
    large = stage(large.select("band", "row_id", "size", shared.alias("shared")).withColumn("pivot", pivot).drop("shared"), "pivots")
    told = large.select("row_id", "pivot").filter("row_id <> pivot").distinct().join(shuffled(prints.select("row_id", own.alias("own"))), "row_id")
    told = told.join(shuffled(prints.select(F.col("row_id").alias("pivot"), own.alias("other"))), "pivot")
    far = stage(told.select("row_id", "pivot", _apart(F.col("own"), F.col("other")).alias("far")), "distances")
    before = F.lag("far", 1, 0).over(Window.partitionBy("pivot").orderBy("far"))  # 512 distances at most
    ends = far.select("pivot", "far").distinct().withColumn("before", before).filter(F.col("far") - F.col("before") > RADIUS)
    told = far.join(shuffled(ends.groupBy("pivot").agg(F.min("far").alias("end"))), "pivot", "left")
    beyond = F.col("end").isNotNull() & (F.col("far") >= F.col("end"))
    off = large.join(shuffled(told.filter(beyond).select("row_id", "pivot")), ["row_id", "pivot"]).select("band", "row_id", "size")
    return _thinned(told.filter(~beyond).select(F.col("row_id").alias("u"), F.col("pivot").alias("v"))), off


def _candidates(members: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """(u, v) that connect all pairs of a bucket of ``members`` (band, row_id, size, n, first) whose ``prints`` (row_id, fp0..) are within RADIUS.

    Small buckets are compared pair by pair. A large one is cut by the
    distances to a pivot, CUTS times at most as long as what is cut off is
    large; the rest is taken as one group.
    """
    few, large, found = [members.filter(F.col("n") <= BUCKET)], members.filter(F.col("n") > BUCKET), []
    for _ in range(CUTS):
        near, off = _cut(large, prints)
        off = stage(_counted(off, "band"), "pieces")
        few.append(off.filter(F.col("n") <= BUCKET))
        large = off.filter(F.col("n") > BUCKET)
        found.append(near)
        if large.isEmpty():
            break
    found.append(large.select(F.col("row_id").alias("u"), F.col("first").alias("v")))
    small = reduce(DataFrame.unionByName, few).select("band", "n", "first", "row_id", "size")
    a, b = (small.alias(x) for x in "ab")
    same = reduce(Column.__and__, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("band", "n", "first"))) & (F.col("a.row_id") < F.col("b.row_id"))
    alike = F.least("a.size", "b.size") >= F.greatest("a.size", "b.size") * (similarity - 1e-9)
    pairs = a.join(shuffled(b), same & alike).select(F.col("a.row_id").alias("u"), F.col("b.row_id").alias("v")).distinct()
    own = prints.select("row_id", F.struct(*_WORDS).alias("own"))
    told = pairs.join(shuffled(own.alias("a")), F.col("a.row_id") == F.col("u")).join(shuffled(own.alias("b")), F.col("b.row_id") == F.col("v"))
    return reduce(DataFrame.unionByName, found, _thinned(told.filter(_apart(F.col("a.own"), F.col("b.own")) <= RADIUS)))


def links(nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float, part: int = 512, part_hashes: int = 1 << 20, prints: DataFrame | None = None) -> DataFrame:
    """(u, v): pairs of ``nodes`` (row_id, size, bands) at least ``similarity`` alike, such that alike candidates are connected.

    Nodes that share bands, directly or through others, are a group; where
    there are ``prints`` (row_id, fp0..), only those whose fingerprints may be
    within RADIUS. Sets are made again from ``texts`` (row_id, text_) for
    groups only. A group of up to ``part`` nodes and ``part_hashes`` hashes
    goes to one task, each set once. A larger one is compared with a hub at a time (see ``_hub_round``),
    which takes a pass over it. What hubs don't settle is split (see ``_split``),
    and the rest is dealt to parts (see ``_forests``).
    """
    keys = nodes.select("row_id", "size", F.explode("bands").alias("band"))
    members = stage(_counted(keys, "band"), "buckets")
    near = members.select(F.col("row_id").alias("u"), F.col("first").alias("v")) if prints is None else _candidates(members, prints, similarity)
    roots_ = stage(connected_components(near), "roots")
    roots_ = roots_.unionByName(roots_.select(F.col("root").alias("node"), "root")).distinct()
    # of a group, the node that shares most bands with most others is the likeliest middle
    known = members.groupBy("row_id").agg(F.sum("n").alias("shared"), F.first("size").alias("size"))
    grouped = stage(known.join(shuffled(roots_), known.row_id == F.col("node")).select(F.col("root").alias("group"), "row_id", "shared", "size"), "groups")
    done, large = _by_size(grouped, part, part_hashes)
    large = stage(large, "large")
    told = grouped.select("row_id").join(shuffled(large.select("row_id", F.lit(True).alias("large"))), "row_id", "left")
    sets = _sets(marked(texts, told, "large"), shingle)
    large_sets, found, before = stage(sets.filter("large").drop("large"), "large_sets"), [], None
    for left in range(HUBS, -1, -1):
        n = large.count()
        if not n:
            break
        if not left or (before and n > 0.9 * before):  # hubs settle little here
            small, large = _by_size(stage(_split(large, large_sets, similarity), "split"), part, part_hashes)
            done = done.unionByName(small)
            found += _forests(stage(large, "large"), large_sets, similarity, part, part_hashes)
            break
        before = n
        near, large = _hub_round(large, large_sets, similarity)
        found.append(near)
        small, large = _by_size(large, part, part_hashes)
        done, large = done.unionByName(small), stage(large, "large")
    # no two of these groups have the same name, which is a row_id of theirs
    return reduce(DataFrame.unionByName, found, _within(done, sets.drop("large"), similarity))


def _by_size(grouped: DataFrame, part: int, part_hashes: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of groups that one task can hold, and those of larger ones. Only the names of larger groups, a row for ``part`` nodes at most, are broadcast."""
    totals = grouped.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("hashes_"))
    fits = (F.col("n") <= part) & (F.col("hashes_") <= part_hashes)
    known = grouped.drop("n", "hashes_").join(F.broadcast(totals.filter(~fits & (F.col("n") > 1))), "group", "left")
    return known.filter("n is null"), known.filter("n is not null")


def _hub_round(large: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(links to each group's hub, nodes that may have links which those don't tell).

    Distances to the hub are exact. The distance of two nodes is at least the
    difference of theirs to the hub, so a node linked to the hub meets no
    unlinked one that is more than the radius farther out; linked ones are
    connected anyway. What stays: the unlinked nodes, and linked ones near
    enough to the nearest of them.
    """
    hubs = large.groupBy("group").agg(F.max_by("row_id", F.struct("shared", -F.col("row_id"))).alias("hub"))
    hub_sets = hubs.join(sets.select(F.col("row_id").alias("hub"), F.col("hashes").alias("y")), "hub").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = large.join(shuffled(sets), "row_id").withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int")).join(shuffled(hub_sets), ["group", "salt"]).filter("row_id <> hub")
    shared = F.size(F.array_intersect("hashes", "y"))
    far = stage(own.select("group", "row_id", "shared", "size", "hub", (1 - shared / (F.size("hashes") + F.size("y") - shared)).alias("far")), "hub")
    radius = 1 - similarity + 1e-12
    near = far.filter(F.col("far") <= radius).select(F.col("row_id").alias("u"), F.col("hub").alias("v"))
    open_ = far.filter(F.col("far") > radius).groupBy("group").agg(F.min("far").alias("nearest"))
    rest = far.join(open_, "group").filter((F.col("far") > radius) | (F.col("far") >= F.col("nearest") - radius))
    return near, rest.select("group", "row_id", "shared", "size")


def _alike(table: pa.Table, similarity: float) -> pa.Table:
    lists = table.column("hashes").combine_chunks()
    us, vs = _forest(table.column("row_id").to_numpy(), lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64), similarity)
    return pa.table({"u": np.concatenate(us), "v": np.concatenate(vs)})


def _within(small: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v) for nodes of groups that fit a task."""
    return small.select("group", "row_id").join(shuffled(sets), "row_id").groupBy("group").applyInArrow(lambda table: _alike(table, similarity), "u long, v long")


def _forest(ids: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, similarity: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(u, v) that connect the nodes at least ``similarity`` alike: nodes that are reached aren't compared again."""
    us, vs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    distinct, codes = np.unique(hashes, return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(ids)), sizes)
    marked = np.zeros(len(distinct), dtype=bool)
    left, reached = np.ones(len(ids), dtype=bool), []
    waiting = 0  # all nodes before it are reached
    codes_left, own_left = codes, own
    while True:
        if not reached:
            while waiting < len(ids) and not left[waiting]:
                waiting += 1
            if waiting == len(ids):
                return us, vs
            reached, left[waiting] = [waiting], False
        x = reached.pop()
        mine = codes[starts[x] : starts[x] + sizes[x]]
        marked[mine] = True
        shared = np.bincount(own_left[marked[codes_left]], minlength=len(ids))
        marked[mine] = False
        close = np.flatnonzero(left & (shared / (sizes + sizes[x] - shared) >= similarity))
        if len(close):
            us.append(ids[close])
            vs.append(np.full(len(close), ids[x]))
            reached.extend(close.tolist())
            left[close] = False
            stay = left[own_left]
            codes_left, own_left = codes_left[stay], own_left[stay]


def _split(large: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Nodes (group, row_id, shared, size) of ``large`` in smaller groups that no link crosses.

    Sets in any fixed order of hashes which are ``similarity`` alike share one
    of their first few: all but that share of them, and one more. Hashes that
    several of some SAMPLE sets of the group have come last, so what most of
    a group has in common connects nobody. The sample only sets this order.
    """
    picked = large.filter(F.pmod(F.xxhash64("row_id"), F.ceil(F.col("n") / SAMPLE)) == 0).join(shuffled(sets), "row_id")
    often = picked.select("group", F.explode("hashes").alias("h")).groupBy("group", "h").agg(F.count("*").alias("n")).filter("n > 1")
    often = often.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("n", "h")))["h"].alias("often"))
    often = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = large.join(shuffled(sets), "row_id").withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int")).join(shuffled(often), ["group", "salt"], "left")
    often_ = F.coalesce("often", F.array().cast("array<long>"))
    in_order = F.concat(F.array_except("hashes", often_), F.array_intersect(often_, "hashes"))
    most = (F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1).cast("int")
    keys = own.select("group", "row_id", F.explode(F.slice(in_order, F.lit(1), most)).alias("h"))
    near = _counted(keys, "group", "h").filter("row_id <> first").select(F.col("row_id").alias("u"), F.col("first").alias("v"))
    split = stage(connected_components(_thinned(near)), "parts")
    split = split.unionByName(split.select(F.col("root").alias("node"), "root")).distinct()  # others are alone
    return large.join(shuffled(split), large.row_id == split.node).select(F.col("root").alias("group"), "row_id", "shared", "size")


def _forests(large: DataFrame, sets: DataFrame, similarity: float, part: int, part_hashes: int) -> list[DataFrame]:
    """(u, v) that connect the alike nodes of groups (group, n, hashes_, row_id, shared, size), in two tables.

    First each node is compared with those of its own part and the group's
    hub. Then nodes that this leaves outside of their group's largest
    component are compared with all nodes, two parts in a task; the others
    need no comparison with each other.
    """
    in_parts = lambda n, size: F.greatest(F.ceil(n / part), F.ceil(size / part_hashes)).cast("int")
    parts = in_parts(F.col("n"), F.col("hashes_"))
    dealt = large.select("group", "row_id", "size", parts.alias("parts"), F.pmod(F.xxhash64("row_id", "group"), parts).cast("int").alias("j"))
    hubs = large.groupBy("group").agg(F.max_by("row_id", F.struct("shared", -F.col("row_id"))).alias("row_id"), F.first(parts).alias("parts"))
    hubs = hubs.select("group", "row_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"))
    each = dealt.select("group", "row_id", "j").unionByName(hubs).distinct().join(shuffled(sets), "row_id")
    near = stage(each.groupBy("group", "j").applyInArrow(lambda table: _alike(table, similarity), "u long, v long"), "near")

    told = connected_components(near)
    known = stage(dealt.join(shuffled(told), dealt.row_id == told.node, "left").select("group", "row_id", "size", "parts", "j", F.coalesce("root", "row_id").alias("root")), "known")
    most = known.groupBy("group", "root").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("most"))
    outside = known.join(F.broadcast(most), "group").filter("root <> most")
    left = outside.groupBy("group").agg(in_parts(F.count("*"), F.sum("size")).alias("lefts"))
    i = F.pmod(F.xxhash64("row_id", "group", F.lit(1)), F.col("lefts")).cast("int")
    mine = outside.join(F.broadcast(left), "group").select("group", "row_id", "root", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), F.lit(True).alias("mine"))
    other = known.join(F.broadcast(left), "group").select("group", "row_id", "root", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"), "j", F.lit(False).alias("mine"))
    both = mine.unionByName(other.select(mine.columns)).join(shuffled(sets), "row_id")
    return [near, both.groupBy("group", "i", "j").applyInArrow(lambda table: _across(table, similarity), "u long, v long")]


def _across(table: pa.Table, similarity: float) -> pa.Table:
    """(u, v) that connect each node of ``mine`` with every root one of whose other nodes is alike."""
    lists = table.column("hashes").combine_chunks()
    ids, roots_ = (table.column(c).to_numpy() for c in ("row_id", "root"))
    mine = np.asarray(table.column("mine").to_numpy(zero_copy_only=False), dtype=bool)
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    distinct, codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(ids)), sizes)
    codes_other, own_other = codes[~mine[own]], own[~mine[own]]
    marked = np.zeros(len(distinct), dtype=bool)
    us, vs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for x in np.flatnonzero(mine):
        codes_x = codes[starts[x] : starts[x] + sizes[x]]
        marked[codes_x] = True
        shared = np.bincount(own_other[marked[codes_other]], minlength=len(ids))
        marked[codes_x] = False
        close = np.flatnonzero(~mine & (roots_ != roots_[x]) & (shared / (sizes + sizes[x] - shared) >= similarity))
        close = close[np.unique(roots_[close], return_index=True)[1]]
        us.append(np.full(len(close), ids[x]))
        vs.append(ids[close])
    return pa.table({"u": np.concatenate(us), "v": np.concatenate(vs)})


def roots(rows: DataFrame, text: str, shingle: int, similarity: float) -> DataFrame:
    """``rows`` (row_id, digest, size, fp0.., cells, best, ``text``) as (root, best): equal sets are collapsed first, so copies cost one node.

    ``best`` is the row that each set, and then each group, keeps.
    """
    made = rows.groupBy("digest").agg(F.min("best").alias("best"), F.min("row_id").alias("row_id"), *(F.first(c).alias(c) for c in ("size", *_WORDS, "cells")))
    nodes = stage(made, "nodes")
    near = links(_banded(nodes), rows.select("row_id", F.col(text).alias("text_")), shingle, similarity, prints=nodes.select("row_id", *_WORDS))
    found = connected_components(near)
    return nodes.select("row_id", "best").join(shuffled(found), nodes.row_id == found.node, "left").select(F.coalesce("root", "row_id").alias("root"), "best")
