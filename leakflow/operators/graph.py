"""Reachability, introductions and tree expansion over object tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakflow.session import shuffled, staged


def _cut(df: DataFrame) -> DataFrame:
    """Ends the lineage of a loop's table: it is written to the shared folder and read again."""
    return staged(df, "graph")


def _shortcuts(parents: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(edges beside the one each commit follows, jumps): jump k leads along followed edges to the ancestor 2^k away, where there is one.

    Each commit follows its greatest parent: where ids grow with time that is
    the latest, so lines of followed edges are long. The jumps together pass
    over any such line; a circle ends them when they pass all commits.
    """
    known = parents.select("oid", "parent").filter("oid is not null and parent is not null").distinct()
    edges = _cut(known.withColumn("followed", F.max("parent").over(Window.partitionBy("oid"))))
    jump = edges.filter("parent = followed").select("oid", "parent")
    jumps, n = [], jump.count()
    ahead = n
    while ahead and 2 ** len(jumps) <= n:
        jumps.append(jump)
        jump = _cut(jump.alias("a").join(shuffled(jump).alias("b"), F.col("a.parent") == F.col("b.oid")).select("a.oid", "b.parent"))
        ahead = jump.count()
    return edges.filter("parent <> followed").select("oid", "parent"), jumps


def _reached(shortcuts: tuple[DataFrame, list[DataFrame]], tips: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` of all that ``tips`` reach. A round takes all jumps in one job, so rounds are as many as edges beside the followed ones on a path, and a line of any length is one."""
    side, jumps = shortcuts
    frontier, seen, rounds = tips.select(*keys).filter("oid is not null").distinct(), None, 0
    while True:
        for jump in jumps:
            both = frontier.join(shuffled(jump), "oid", "left").withColumn("oid", F.explode(F.array_compact(F.array("oid", "parent"))))
            frontier = both.select(*keys).distinct()
        found = _cut(frontier if seen is None else frontier.join(shuffled(seen), keys, "left_anti"))
        if found.isEmpty():
            return found if seen is None else seen
        rounds += 1
        seen = found if seen is None else seen.unionByName(found)
        if rounds % 10 == 0:
            seen = _cut(seen)
        onward = found.join(shuffled(side), "oid").withColumn("oid", F.col("parent")).select(*keys).distinct()
        frontier = onward.join(shuffled(seen), keys, "left_anti")


def reachable(parents: DataFrame, tips: DataFrame) -> DataFrame:
    """(oid): commits reached from ``tips`` (oid) over ``parents`` (oid, parent), tips included, each once. Nulls are no commits; circles end."""
    return _reached(_shortcuts(parents), tips, ["oid"])


def range_difference(parents: DataFrame, tips: DataFrame, excluded: DataFrame) -> DataFrame:
    """Commits reached from ``tips`` and not from ``excluded``."""
    shortcuts = _shortcuts(parents)
    return _reached(shortcuts, tips, ["oid"]).join(shuffled(_reached(shortcuts, excluded, ["oid"])), "oid", "left_anti")


def merged_range(parents: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``A...B``: commits reached from either side."""
    return reachable(parents, left.select("oid").unionByName(right.select("oid")))


def first_introductions(touches: DataFrame, key: str = "oid", date: str = "date", commit: str = "commit", more: tuple[str, ...] = ()) -> DataFrame:
    """The oldest commit of each blob, equal dates by commit id. An aggregate, so a blob that all commits hold costs one row a task."""
    carried = [date, commit, *more]
    return touches.groupBy(key).agg(F.min(F.struct(*carried)).alias("x")).select(key, *(f"x.{c}" for c in carried))


def _settled(start: DataFrame, edges: DataFrame, offer, value: str) -> DataFrame:
    """(tree_oid, ``value``): the least value that reaches each tree along ``edges`` (tree_oid, oid, ..), from ``start`` (tree_oid, ``value``); ``offer`` is what an edge makes of a value.

    A round takes the trees whose value got smaller, each once, whatever
    number of trees hold them; without such trees it ends, so circles do too.
    """
    best = changed = _cut(start.groupBy("tree_oid").agg(F.min(value).alias(value)))
    while True:
        offered = changed.join(shuffled(edges), "tree_oid").groupBy("oid").agg(F.min(offer).alias("offered_")).withColumnRenamed("oid", "tree_oid")
        changed = _cut(offered.join(shuffled(best), "tree_oid", "left").filter(F.col(value).isNull() | (F.col("offered_") < F.col(value))).select("tree_oid", F.col("offered_").alias(value)))
        if changed.isEmpty():
            return best
        best = _cut(best.unionByName(changed).groupBy("tree_oid").agg(F.min(value).alias(value)))


def tree_introductions(commits: DataFrame, entries: DataFrame) -> DataFrame:
    """(oid, path, commit, date): each blob with the oldest commit (equal dates by id) whose tree holds it, and its least path there.

    ``commits`` are (oid, tree, date), ``entries`` (tree_oid, name, oid, kind)
    with kind tree or blob. Dates and commits go down the trees, where a tree
    that many commits or trees share is one row; nothing lists all paths of
    all commits. Paths are attached afterwards: what a commit introduces, it
    holds below trees that it introduces, so only edges between trees of the
    same commit are followed. Rounds are as many as trees nest. Nulls are no
    commits, trees or blobs; trees without entries hold nothing.
    """
    roots = commits.filter("oid is not null and tree is not null").select(F.col("tree").alias("tree_oid"), F.struct("date", F.col("oid").alias("commit")).alias("first"))
    known = entries.filter("tree_oid is not null and name is not null and oid is not null")
    down = known.filter("kind = 'tree'").select("tree_oid", "name", "oid")
    first = _settled(roots, down.select("tree_oid", "oid").distinct(), F.col("first"), "first")
    child = first.select(F.col("tree_oid").alias("oid"), F.col("first").alias("own_"))
    within = _cut(down.join(shuffled(first), "tree_oid").join(shuffled(child), "oid").filter("first = own_").select("tree_oid", "oid", "name"))
    top = roots.join(shuffled(first.withColumnRenamed("first", "own_")), "tree_oid").filter("first = own_").select("tree_oid", F.lit("").alias("prefix"))
    prefixes = _settled(top, within, F.concat("prefix", "name", F.lit("/")), "prefix")
    blobs = known.filter("kind = 'blob'").select("tree_oid", "name", "oid").join(shuffled(first), "tree_oid").join(shuffled(prefixes), "tree_oid")
    found = blobs.groupBy("oid").agg(F.min(F.struct("first", F.concat("prefix", "name").alias("path"))).alias("x"))
    return found.select("oid", "x.path", "x.first.commit", "x.first.date")


def paths_of(listing: DataFrame, ids: DataFrame, longest: int = 64) -> DataFrame:
    """(id, path): paths in ``listing`` (oid, path) of objects named in full or by their beginning in ``ids`` (id), each once.

    An id of any length up to ``longest`` is joined by equality with as many
    characters of an oid, so nothing is compared with everything. Blank paths,
    and null, empty or longer ids, give no rows.
    """
    wanted = ids.select("id").filter(f"length(id) between 1 and {longest}").distinct()
    lengths = [r["n"] for r in wanted.select(F.length("id").alias("n")).distinct().collect()]  # at most ``longest`` rows
    if not lengths:
        return wanted.withColumn("path", F.lit("")).filter("false")
    named = listing.filter("trim(path) <> ''").select("oid", "path").distinct().withColumn("n", F.explode(F.array(*map(F.lit, sorted(lengths)))))
    return named.withColumn("id", F.expr("substring(oid, 1, n)")).filter("length(id) = n").join(shuffled(wanted), "id").select("id", "path").distinct()


def expand_tree(entries: DataFrame, roots: DataFrame, max_depth: int = 100) -> DataFrame:
    """(root, path, oid) of blobs below ``roots`` (root), over ``entries`` (tree_oid, name, oid, kind); one join a level. Trees that nest deeper than ``max_depth`` raise, since their blobs would be missing."""
    level = roots.select("root", F.col("root").alias("tree_oid"), F.lit("").alias("prefix"))
    blobs = None
    for _ in range(max_depth):
        below = _cut(level.join(entries, "tree_oid").select("root", F.concat("prefix", "name").alias("path"), "oid", "kind"))
        if below.isEmpty():
            return blobs if blobs is not None else below.select("root", "path", "oid")
        here = below.filter("kind = 'blob'").select("root", "path", "oid")
        blobs = here if blobs is None else blobs.unionByName(here)
        level = below.filter("kind = 'tree'").select("root", F.col("oid").alias("tree_oid"), F.concat("path", F.lit("/")).alias("prefix"))
    if not level.isEmpty():
        raise ValueError(f"trees nest deeper than {max_depth}")
    return blobs if blobs is not None else entries.select(F.lit("").alias("root"), F.col("name").alias("path"), "oid").filter("false")


def blobs_at(wanted: DataFrame, commits: DataFrame, entries: DataFrame) -> DataFrame:
    """(commit, path, oid): the blob that each of ``wanted`` (commit, path) names, null if the commit isn't known or holds no blob there.

    ``commits`` are (oid, tree), ``entries`` (tree_oid, name, oid, kind) with
    kind tree or blob. A path goes down one folder a round, by an equality
    join on tree and name, so only entries on wanted paths are touched; a path
    that several commits ask of one tree is followed once. Rounds are as many
    as the longest path has parts. Rows of ``wanted`` that repeat are one.
    """
    asked = _cut(wanted.select("commit", "path").distinct().join(commits.filter("oid is not null").select(F.col("oid").alias("commit"), F.col("tree").alias("root")).dropDuplicates(["commit"]), "commit", "left"))
    level = asked.filter("root is not null and path is not null").select("root", "path").distinct().select("root", "path", F.col("root").alias("tree_oid"), F.split("path", "/").alias("rest_"))
    known = entries.select("tree_oid", "name", "oid", "kind").filter("kind in ('tree', 'blob')")
    found = None
    while True:
        level = level.withColumn("name", F.get("rest_", F.lit(0))).withColumn("rest_", F.slice("rest_", F.lit(2), F.greatest(F.size("rest_") - 1, F.lit(0))))
        below = _cut(level.join(known, ["tree_oid", "name"]).filter("(kind = 'blob') = (size(rest_) = 0)").select("root", "path", "oid", "kind", "rest_"))
        here = below.filter("kind = 'blob'").select("root", "path", "oid")
        found = here if found is None else found.unionByName(here)
        level = below.filter("kind = 'tree'").select("root", "path", F.col("oid").alias("tree_oid"), "rest_")
        if level.isEmpty():
            return asked.join(found.groupBy("root", "path").agg(F.min("oid").alias("oid")), ["root", "path"], "left").select("commit", "path", "oid")


def signed_counts(commits: DataFrame, tags: DataFrame, refs: DataFrame, tips: DataFrame) -> DataFrame:
    """(kind, n, n_signed): commits that ``tips`` (oid) reach, and annotated tags that references below refs/tags name; what a rewrite would invalidate.

    ``commits`` are (oid, parents, is_signed), ``tags`` (oid, is_signed),
    ``refs`` (ref, oid). Each object counts once, whatever names it; tips that
    are no commits reach nothing. Both kinds are there even if there are none.
    """
    parents = commits.select("oid", F.explode("parents").alias("parent"))
    reached = commits.join(reachable(parents, tips), "oid", "left_semi")
    named = tags.join(refs.filter(F.col("ref").startswith("refs/tags/")).select("oid"), "oid", "left_semi")
    counted = lambda rows, kind: rows.dropDuplicates(["oid"]).agg(F.count("*").alias("n"), F.count_if("is_signed").alias("n_signed")).select(F.lit(kind).alias("kind"), "n", "n_signed")
    return counted(reached, "commit").unionByName(counted(named, "tag"))


#: References that share a word of a bitmap.
WORD = 64


def refs_that_hold(refs: DataFrame, parents: DataFrame, holders: DataFrame) -> DataFrame:
    """(ref, n): refs (ref, oid) from which a commit of ``holders`` (oid) is reached, with how many.

    References are numbered, and what reaches a commit is a bitmap, 64 of them
    a word: rows are commits times words, not commits times references. A
    round goes on with the words that got new bits, along all jumps.
    """
    side, jumps = _shortcuts(parents)
    numbered = _cut(refs.select("ref").distinct().withColumn("at_", F.monotonically_increasing_id()))
    # ids of a partition follow each other, so blocks are dense but for the last of each partition
    numbered = numbered.withColumn("block", F.floor(F.col("at_") / WORD).cast("long")).withColumn("bit", F.pmod("at_", F.lit(WORD)).cast("int"))
    own = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    start = refs.select("ref", "oid").filter("oid is not null").join(shuffled(numbered), "ref").select("oid", "block", own.alias("bits"))
    merged = lambda rows: rows.groupBy("oid", "block").agg(F.bit_or("bits").alias("bits"))
    frontier, seen = merged(start), None
    while True:
        for jump in jumps:
            # one reading of the frontier a jump: as a union of two, the plan doubled with each of them
            both = frontier.join(shuffled(jump), "oid", "left")
            frontier = merged(both.select(F.explode(F.array_compact(F.array("oid", "parent"))).alias("oid"), "block", "bits"))
        if seen is None:
            found = seen = _cut(frontier)
        else:
            before = seen.withColumnRenamed("bits", "had")
            found = _cut(frontier.join(shuffled(before), ["oid", "block"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long"))))).filter("bits <> 0").select("oid", "block", "bits"))
            if found.isEmpty():
                break
            seen = _cut(merged(seen.unionByName(found)))
        frontier = merged(found.join(shuffled(side), "oid").select(F.col("parent").alias("oid"), "block", "bits"))
        if frontier.isEmpty():
            break
    held = seen.join(shuffled(holders.select("oid").distinct()), "oid").withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))))
    told = held.filter(F.call_function("getbit", F.col("bits"), F.col("bit")) == 1).groupBy("block", "bit").agg(F.count("*").alias("n"))
    return told.join(shuffled(numbered), ["block", "bit"]).select("ref", "n")


def survivors(parents: DataFrame, pruned: DataFrame) -> DataFrame:
    """(oid, parent) from first parents (oid, parent) as text: each pruned commit's nearest ancestor along first parents that isn't pruned, by pointer jumping: the rounds grow with the logarithm of the longest run."""
    none = F.lit("")  # of a pruned commit without a parent nothing survives
    jump = pruned.select("oid").distinct().join(shuffled(parents), "oid", "left").select("oid", F.coalesce("parent", none).alias("parent"))
    while True:
        jump = _cut(jump)
        on = jump.alias("a").join(shuffled(jump).alias("b"), F.col("a.parent") == F.col("b.oid")).select(F.col("a.oid").alias("oid"), F.col("b.parent").alias("onward"))
        if on.isEmpty():
            return jump.withColumn("parent", F.nullif("parent", none))
        jump = jump.join(shuffled(on), "oid", "left").select("oid", F.coalesce("onward", "parent").alias("parent"))


def newest(rows: DataFrame, section: str, order: list, n: int) -> DataFrame:
    """The newest ``n`` rows of each section."""
    w = Window.partitionBy(section).orderBy(*order)
    return rows.withColumn("rn_", F.row_number().over(w)).filter(F.col("rn_") <= n).drop("rn_")


def within_budget(rows: DataFrame, order: str, size: str, cap: int, buckets: int = 64) -> DataFrame:
    """Rows in ``order`` while the running total of ``size`` stays at or below ``cap``.

    Totals by range of the order come first; then each range runs its own
    total from where the ones before it end, so no task sees all rows.
    """
    cuts = rows.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.001)
    bucket = F.lit(0)
    for c in sorted(set(cuts)):
        bucket = bucket + F.when(F.col(order) > c, 1).otherwise(0)
    dealt = rows.withColumn("bucket_", bucket)
    totals = dealt.groupBy("bucket_").agg(F.sum(size).alias("sum_"))  # at most ``buckets`` rows
    offsets = totals.withColumn("before_", F.coalesce(F.sum("sum_").over(Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("bucket_", "before_")
    running = F.sum(size).over(Window.partitionBy("bucket_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(offsets), "bucket_").withColumn("running", F.col("before_") + running).filter(F.col("running") <= cap).drop("bucket_", "before_")
