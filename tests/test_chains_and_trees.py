"""Audit chains that are appended to and verified by ranges, first introductions down trees, and bitmaps of references."""

import hashlib
import random

import pytest

from leakflow.operators import audit, graph
from leakflow.session import new_path
from leakflow.streaming import scans

LOG = "chain string, id long, value string, part int"


def log_rows(n=60, parts=3):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None]), i, rnd.choice(["x", None, "é", ""]), i * parts // n) for i in range(n)]
    rnd.shuffle(rows)
    return rows


def chained(rows):
    last, out = {}, []
    for chain, i, value, *_ in sorted(rows, key=lambda r: r[1]):
        before, n = last.get(chain, ("", 0))
        own = hashlib.sha256((before + f"\x1f{i}\x1f{value or ''}").encode()).hexdigest()
        out.append((chain, i, n + 1, before, own))
        last[chain] = (own, n + 1)
    return sorted(out, key=repr)


def test_appended_batches_are_one_chain_also_after_restarts(spark):
    rows = log_rows()
    made = scans.run_in_parts(spark.createDataFrame(rows, LOG), "part", new_path(spark, "append"), lambda s: audit.append_chain(s, "chain", "id", ["id", "value"]), audit.STATE_STORE)
    assert sorted(map(tuple, made.select("chain", "id", "number", "prev_hash", "row_hash").collect()), key=repr) == chained(rows)
    built = audit.build_chain(spark.createDataFrame(rows, LOG), "chain", "id", ["id", "value"]).filter("chain is not null")
    assert sorted(map(tuple, built.select("chain", "id", "prev_hash", "row_hash").collect())) == sorted((c, i, p, h) for c, i, _, p, h in chained(rows) if c)


def verified(rows):
    """(chain, checked, legacy, first broken) by walking each chain."""
    out = {}
    for chain, i, value, before, own in sorted(rows, key=lambda r: r[1]):
        s = out.setdefault(chain, [0, 0, None, ""])
        if not own:
            s[1] += 1
            continue
        fits = own == hashlib.sha256(((before or "") + f"\x1f{i}\x1f{value or ''}").encode()).hexdigest()
        if s[2] is None and not (fits and (before or "") == s[3]):
            s[2] = i
        s[0] += 1
        s[3] = own
    return sorted(((c, *s[:3]) for c, s in out.items()), key=repr)


@pytest.mark.parametrize("ranges", [1, 4, 17])
def test_chains_are_verified_across_ranges(spark, ranges):
    rnd = random.Random(ranges)
    rows = []
    for chain, i, _, before, own in chained([(c, i, v) for c, i, v, _ in log_rows(300)]):
        value = next(v for c, j, v, _ in log_rows(300) if j == i)
        rows.append((chain, i, value, before, own))
    for trial in range(3):
        touched = [list(r) for r in rows]
        for r in rnd.sample(touched, 4 * trial):
            if rnd.random() < 0.5:
                r[3 if rnd.random() < 0.5 else 2] = "changed"
            else:
                r[3], r[4] = None, rnd.choice([None, ""])  # legacy
        table = spark.createDataFrame([tuple(r) for r in touched], "chain string, id long, value string, prev_hash string, row_hash string")
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = audit.verify_chain(table, "chain", "id", ["id", "value"]).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert sorted(map(tuple, got), key=repr) == verified(touched)
    empty = spark.createDataFrame([], "chain string, id long, value string, prev_hash string, row_hash string")
    assert audit.verify_chain(empty, "chain", "id", ["id", "value"]).count() == 0


def walk(commits, entries):
    """First introductions as a walk finds them, oldest commit first."""
    below = {}
    for tree, name, oid, kind in entries:
        if None not in (tree, name, oid):
            below.setdefault(tree, []).append((name, oid, kind))
    found, seen = {}, set()

    def visit(tree, prefix, fresh):
        if tree in seen_here:
            return
        for name, oid, kind in below.get(tree, []):
            if kind == "blob":
                fresh.setdefault(oid, []).append(prefix + name)
            elif kind == "tree":
                visit(oid, f"{prefix}{name}/", fresh)

    for oid, tree, date in sorted((c for c in commits if None not in c[:2]), key=lambda c: (c[2], c[0])):
        seen_here, fresh = set(seen), {}
        visit(tree, "", fresh)
        for blob, paths in fresh.items():
            found.setdefault(blob, (blob, min(p.encode() for p in paths).decode(), oid, date))
    return sorted(found.values())


def test_introductions_are_those_of_a_walk(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        entries = [(f"t{i}", f"{rnd.choice('abcé')}{k}", f"t{rnd.randint(i + 1, 24)}", "tree") for i in range(24) for k in range(rnd.randint(0, 3))]
        entries += [(f"t{rnd.randint(0, 24)}", f"f{rnd.randint(0, 5)}.{k}", f"b{rnd.randint(0, 40)}", "blob") for k in range(60)]
        entries += [("t1", "module", "c9", "commit"), (None, "x", "b1", "blob"), ("t1", None, "b99", "blob")]
        commits = [(f"c{i}", f"t{rnd.randint(0, 24)}", rnd.randint(0, 6)) for i in range(12)] + [("c98", None, 0), (None, "t0", 0), ("c97", "gone", 0)]
        made = graph.tree_introductions(spark.createDataFrame(commits, "oid string, tree string, date long"), spark.createDataFrame(entries, "tree_oid string, name string, oid string, kind string"))
        assert sorted(map(tuple, made.select("oid", "path", "commit", "date").collect())) == walk(commits, entries)
    none = graph.tree_introductions(spark.createDataFrame([], "oid string, tree string, date long"), spark.createDataFrame([], "tree_oid string, name string, oid string, kind string"))
    assert none.count() == 0


def test_trees_deeper_than_allowed_are_told(spark):
    entries = spark.createDataFrame([(f"t{i}", "d", f"t{i + 1}", "tree") for i in range(5)] + [("t5", "f", "b", "blob")], "tree_oid string, name string, oid string, kind string")
    roots = spark.createDataFrame([("t0",)], "root string")
    assert graph.expand_tree(entries, roots, 6).collect() == [("t0", "d/d/d/d/d/f", "b")]
    with pytest.raises(ValueError):
        graph.expand_tree(entries, roots, 5)


def test_bitmaps_of_many_references(spark):
    rnd = random.Random(6)
    edges = [(i, p) for i in range(1, 120) for p in {i - 1, rnd.randint(0, i - 1)} if rnd.random() < 0.9]
    refs = [(f"r{i}", rnd.randint(0, 119)) for i in range(150)] + [("r0", 3), ("none", None), ("out", 500)]
    holders = [(i,) for i in rnd.sample(range(120), 30)] + [(500,), (500,)]
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += up.get(y, ())
        return seen

    want = {}
    for ref, oid in refs:
        if oid is not None:
            want.setdefault(ref, set()).update(reach(oid) & {h for (h,) in holders})
    got = graph.refs_that_hold(spark.createDataFrame(refs, "ref string, oid long").repartition(3), spark.createDataFrame(edges, "oid long, parent long"), spark.createDataFrame(holders, "oid long"))
    assert sorted(map(tuple, got.collect())) == sorted((r, len(s)) for r, s in want.items() if s)
    assert graph.refs_that_hold(spark.createDataFrame([], "ref string, oid long"), spark.createDataFrame(edges, "oid long, parent long"), spark.createDataFrame(holders, "oid long")).count() == 0

