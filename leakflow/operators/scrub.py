"""A scrub as one plan: replaced texts, filtered paths, pruned commits, re-pointed parents and dense marks of export records."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakflow.operators import graph
from leakflow.session import shuffled, staged
from leakflow.sources import fastexport

_AT = "\x1f"


def dense_numbers(rows: DataFrame, group: str, order: str, into: str) -> DataFrame:
    """``rows`` numbered from 1 in ``order`` within each ``group``.

    Rows are dealt to ranges and sorted there; each range counts its rows, and
    starts where the ranges before it end. No task sees a whole group.
    """
    dealt = rows.repartitionByRange(group, order).sortWithinPartitions(group, order).withColumn("m_", F.monotonically_increasing_id()).withColumn("part_", F.spark_partition_id())
    dealt = staged(dealt, "ranges")
    counts = dealt.groupBy(group, "part_").agg(F.count("*").alias("n_"), F.min("m_").alias("first_"))
    before = F.sum("n_").over(Window.partitionBy(group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("before_", F.coalesce(before, F.lit(0))).drop("n_")
    return dealt.join(shuffled(starts), [group, "part_"]).withColumn(into, F.col("before_") + F.col("m_") - F.col("first_") + 1).drop("part_", "m_", "first_", "before_")


def _named(ref: Column) -> Column:
    """A reference within its stream; it has the same name as the commit that it means, ``:`` and a mark."""
    return F.concat("stream", F.lit(_AT), ref)


def _plain(name: Column) -> Column:
    return F.substring_index(name, _AT, -1)


def _resolved(parents: DataFrame, survivors: DataFrame) -> DataFrame:
    """``parents`` (oid, pos, ref, ..) with the nearest ancestor that isn't pruned as ref. Ones of which nothing survives go, and so do those that became equal to an earlier one; parents that always were equal stay."""
    told = parents.join(shuffled(survivors.select(F.col("oid").alias("ref"), F.col("parent").alias("onward"), F.lit(True).alias("moved"))), "ref", "left")
    told = told.withColumn("ref", F.when(F.col("moved"), F.col("onward")).otherwise(F.col("ref"))).filter("ref is not null")
    nth = F.row_number().over(Window.partitionBy("oid", "ref").orderBy("pos"))
    return told.withColumn("nth_", nth).filter("moved is null or nth_ = 1").drop("nth_", "moved", "onward")


def pruned_commits(commits: DataFrame, parents: DataFrame, mode: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(oid of pruned commits, (oid, parent): the nearest ancestor of each that stays, null if there is none), staged tables.

    ``commits`` are (oid, had_changes, is_empty), ``parents`` (oid, pos, ref).
    ``auto`` prunes commits that became empty, and ones that were empty if
    their parent goes; ``always`` prunes all empty ones; ``never`` none. A
    merge goes if it is empty and its parents have become one or none.

    Lines of commits are settled at once by pointer jumping; a round is needed
    only where a merge goes because of a merge that went before.
    """
    n_parents = parents.groupBy("oid").agg(F.count("*").alias("n_parents"), F.min_by("ref", "pos").alias("first_parent"))
    known = staged(commits.join(shuffled(n_parents), "oid", "left").select("oid", "had_changes", "is_empty", F.coalesce("n_parents", F.lit(0)).alias("n_parents"), F.col("first_parent").alias("parent")), "commits")
    empty = known.filter("is_empty") if mode != "never" else known.filter("false")
    lines, merges = empty.filter("n_parents < 2"), empty.filter("n_parents > 1")
    gone = lines.filter("had_changes" if mode == "auto" else "true").select("oid", "parent")
    followers = lines.filter("not had_changes and n_parents = 1").select("oid", "parent") if mode == "auto" else lines.filter("false").select("oid", "parent")
    anchors = staged(graph.survivors(followers, followers.select("oid")).select("oid", F.col("parent").alias("anchor")), "anchors")
    theirs = lambda went: followers.join(shuffled(anchors.join(shuffled(went.select(F.col("oid").alias("anchor"))), "anchor", "left_semi").select("oid")), "oid", "left_semi")
    pruned = staged(gone.unionByName(theirs(gone)), "pruned")
    merge_parents = staged(parents.join(shuffled(merges.select("oid")), "oid", "left_semi").select("oid", "pos", "ref"), "merges")
    while True:
        survivors = staged(graph.survivors(pruned, pruned.select("oid")), "survivors")
        if merge_parents.isEmpty():
            return pruned.select("oid"), survivors
        left = _resolved(merge_parents, survivors).groupBy("oid").agg(F.count("*").alias("n"), F.first("ref").alias("parent"))
        waiting = merge_parents.select("oid").distinct().join(pruned.select("oid"), "oid", "left_anti")
        went = staged(waiting.join(left, "oid", "left").filter("n is null or n < 2").select("oid", "parent"), "pruned")
        if went.isEmpty():
            return pruned.select("oid"), survivors
        pruned = staged(reduce(DataFrame.unionByName, [pruned, went, theirs(went)]), "pruned")


def scrub(records: DataFrame, text_of: Callable[[Column], Column] | None = None, path_of: Callable[[Column], Column] | None = None, mode: str = "auto") -> DataFrame:
    """Export records (see ``fastexport.RECORDS``) after a scrub, ready for ``fastexport.serialized``.

    Texts of blobs go through ``text_of`` and paths of changes through
    ``path_of``, which makes null of those that go. Commits that are empty
    then are pruned (see ``pruned_commits``) and become resets of their branch
    to what is left of it; parents, resets and tags mean the nearest ancestor
    that stays, and resets and tags of which nothing stays go. Blobs that no
    change names any more go too. Marks are numbered anew, without gaps, in
    the order of each stream. Parents have to be named, as exporters do; a
    reference that isn't a mark of the stream stays as it is. Records are read
    twice, once without what their blobs hold, which is shuffled once.
    """
    # what blobs hold stays out of all that follows, until it is known which of them stay
    had = records.drop("data").withColumn("had_", F.coalesce(F.size("changes"), F.lit(0)) > 0)
    changed = staged(had if path_of is None else fastexport.rename_changes(had, path_of), "records")
    own = _named(F.concat(F.lit(":"), F.col("mark").cast("string")))
    refs = F.array_compact(F.concat(F.array("parent"), F.coalesce("merges", F.array().cast("array<string>"))))
    heads = staged(changed.select("stream", "seq", "kind", "mark", own.alias("oid"), "had_", (F.coalesce(F.size("changes"), F.lit(0)) == 0).alias("is_empty"), refs.alias("refs")), "heads")
    pointed = heads.select("stream", "seq", "kind", F.coalesce("oid", F.concat("stream", F.lit(f"{_AT}seq "), F.col("seq").cast("string"))).alias("oid"), F.posexplode("refs").alias("pos", "r")).withColumn("ref", _named(F.col("r"))).drop("r")
    commits = heads.filter("kind = 'commit' and oid is not null").select("oid", F.col("had_").alias("had_changes"), "is_empty")
    pruned, survivors = pruned_commits(commits, pointed.filter("kind = 'commit'").select("oid", "pos", "ref"), mode)
    # a pruned commit becomes a reset: its one reference is what it stands for now
    gone = heads.filter("kind = 'commit'").join(shuffled(survivors), "oid").select("stream", "seq", "oid", F.lit(0).alias("pos"), F.col("parent").alias("ref")).filter("ref is not null")
    stay = _resolved(pointed.join(shuffled(pruned), "oid", "left_anti").select("stream", "seq", "oid", "pos", "ref"), survivors)
    told = staged(stay.unionByName(gone.select(stay.columns)), "parents")
    lost = heads.filter("kind in ('reset', 'tag') and size(refs) > 0").select("stream", "seq").unionByName(heads.join(shuffled(pruned), "oid").select("stream", "seq")).join(shuffled(told.select("stream", "seq")), ["stream", "seq"], "left_anti")
    is_pruned = heads.join(shuffled(pruned), "oid").select("stream", "seq", F.lit(True).alias("pruned_"))
    kept = changed.join(shuffled(lost), ["stream", "seq"], "left_anti").join(shuffled(is_pruned), ["stream", "seq"], "left")
    marked = lambda c: F.when(F.col("pruned_"), F.lit(None)).otherwise(F.col(c)).alias(c)
    changes = kept.filter("kind = 'commit' and pruned_ is null").select("stream", "seq", F.posexplode("changes").alias("pos", "c"))
    used = changes.filter("c.kind = 'M'").select("stream", F.col("c.ref").alias("ref")).distinct()
    blobs = kept.filter("kind = 'blob'").withColumn("ref", F.concat(F.lit(":"), F.col("mark").cast("string"))).join(shuffled(used), ["stream", "ref"], "left_semi").select(kept.columns)
    kept = staged(kept.filter("kind <> 'blob'").unionByName(blobs).withColumn("kind", F.when(F.col("pruned_"), "reset").otherwise(F.col("kind"))), "kept")
    old = kept.filter("mark is not null and pruned_ is null").select("stream", "seq", F.concat(F.lit(":"), F.col("mark").cast("string")).alias("ref"))
    marks = staged(dense_numbers(old, "stream", "seq", "new_mark"), "marks")
    new = F.coalesce(F.concat(F.lit(":"), F.col("new_mark").cast("string")), F.col("ref"))
    by_ref = marks.select("stream", "ref", "new_mark")
    parents = told.withColumn("ref", _plain(F.col("ref"))).join(shuffled(by_ref), ["stream", "ref"], "left").groupBy("stream", "seq").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", new.alias("ref")))), lambda x: x["ref"]).alias("parents_"))
    c = F.col("c")
    renamed = changes.withColumn("ref", c["ref"]).join(shuffled(by_ref), ["stream", "ref"], "left")
    item = F.struct(c["kind"].alias("kind"), c["mode"].alias("mode"), new.alias("ref"), c["path"].alias("path"), c["new_path"].alias("new_path"))
    lists = renamed.groupBy("stream", "seq").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", item.alias("c")))), lambda x: x["c"]).alias("changes_"))
    out = kept.drop("changes", "parent", "merges").join(shuffled(marks.select("stream", "seq", "new_mark")), ["stream", "seq"], "left").join(shuffled(parents), ["stream", "seq"], "left").join(shuffled(lists), ["stream", "seq"], "left")
    made = {
        "mark": F.col("new_mark"), "parent": F.get("parents_", F.lit(0)), "merges": F.coalesce(F.slice("parents_", 2, F.greatest(F.size("parents_"), F.lit(1))), F.array().cast("array<string>")),
        "changes": F.coalesce("changes_", F.array().cast(fastexport.CHANGES)), "data": F.lit(None).cast("binary"), "message": marked("message"), "original_oid": marked("original_oid"),
    }
    told = staged(out.select(*(made.get(n, F.col(n)).alias(n) for n in records.columns)), "told")
    # a blob keeps its place and gets its mark from a table of three columns; texts are shuffled once for it
    texts = records.filter("kind = 'blob'").drop("mark")
    texts = texts if text_of is None else fastexport.replace_blobs(texts, text_of)
    bare = {"parent": F.lit(None).cast("string"), "merges": F.array().cast("array<string>"), "changes": F.array().cast(fastexport.CHANGES)}
    marked_blobs = staged(told.filter("kind = 'blob'").select("stream", "seq", "mark"), "blobs")
    blobs = texts.join(shuffled(marked_blobs), ["stream", "seq"]).select(*(bare.get(n, F.col(n)).alias(n) for n in records.columns))
    return told.filter("kind <> 'blob'").unionByName(blobs)
