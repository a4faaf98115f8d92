"""A whole scrub against a walk in stream order, and imported with git."""

import random
import subprocess

import pytest
from pyspark.sql import functions as F

from leakflow.functions.masking import replace_text
from leakflow.operators import rewrite, scrub
from leakflow.sources import fastexport


def walk(records, path_of, mode):
    """(kept records, marks) of one stream, as they come: parents are resolved through what was pruned before."""
    to, out = {}, []
    used = {c["ref"] for r in records if r["kind"] == "commit" for c in r["changes"] if c["kind"] == "M" and path_of(c["path"])}

    def resolve(refs):
        kept, seen = [], set()
        for ref in refs:
            moved = ref in to
            ref = to[ref] if moved else ref
            if ref is None or (moved and ref in seen):
                continue
            seen.add(ref)
            kept.append(ref)
        return kept

    for r in records:
        r = dict(r)
        refs = [x for x in [r["parent"], *r["merges"]] if x]
        left = resolve(refs)
        if r["kind"] == "blob" and f":{r['mark']}" not in used:
            continue
        if r["kind"] == "commit":
            had = bool(r["changes"])
            r["changes"] = [c | {"path": path_of(c["path"])} for c in r["changes"] if path_of(c["path"])]
            empty = not r["changes"]
            goes = mode != "never" and empty and len(left) < 2 and (mode == "always" or had or len(left) < len(refs) or (len(refs) == 1 and refs[0] in to))
            if goes:
                to[f":{r['mark']}"] = left[0] if left else None
                if left:
                    out.append((r["seq"], "reset", None, left, []))
                continue
        elif refs and not left:
            continue
        out.append((r["seq"], r["kind"], r["mark"], left, [(c["path"], c["ref"]) for c in r["changes"]]))
    marks = {f":{m}": f":{i + 1}" for i, m in enumerate(m for _, _, m, _, _ in out if m is not None)}
    new = lambda x: marks.get(x, x)
    return [(seq, kind, m and int(new(f":{m}")[1:]), list(map(new, left)), [(p, new(ref)) for p, ref in changes]) for seq, kind, m, left, changes in out]


def history(seed, n=60):
    rnd = random.Random(seed)
    rows, commits = [], []
    for i in range(n):
        mark, kind = 3 * i + 2, rnd.random()
        base = {"stream": f"s{seed}", "seq": i * 2, "kind": "blob", "mark": None, "parent": None, "merges": [], "changes": [], "data": None, "name": None}
        if kind < 0.3 or not commits:
            rows.append(base | {"mark": mark, "data": b"x%d" % i})
            commits = commits or [None]
        elif kind < 0.9:
            blobs = [r["mark"] for r in rows if r["kind"] == "blob"]
            real = [c for c in commits if c]
            parents = rnd.sample(real, min(len(real), rnd.choice([1, 1, 1, 1, 2, 2, 3]))) if real and rnd.random() < 0.95 else []
            if parents and rnd.random() < 0.05:
                parents = [parents[0], parents[0]]
            changes = [{"kind": "M", "mode": "100644", "ref": f":{rnd.choice(blobs)}", "path": rnd.choice(["keep/a", "drop/a", "drop/b"]), "new_path": None} for _ in range(rnd.choice([0, 0, 1, 1, 1, 2]))]
            rows.append(base | {"kind": "commit", "mark": mark, "parent": f":{parents[0]}" if parents else None, "merges": [f":{p}" for p in parents[1:]], "changes": changes, "name": "refs/heads/m"})
            commits.append(mark)
        elif any(commits):
            rows.append(base | {"kind": rnd.choice(["reset", "tag"]), "parent": rnd.choice([f":{rnd.choice([c for c in commits if c])}", None, "0123abcd"]), "name": "v"})
    return rows


@pytest.mark.parametrize("mode", ["auto", "always", "never"])
def test_scrubs_are_those_of_a_walk(spark, mode):
    streams = {seed: history(seed) for seed in range(4)}
    path_of = lambda p: None if p.startswith("drop/") else "new/" + p
    rows = [r for s in streams.values() for r in s]
    kinds = fastexport.RECORDS.split(", ")
    names = [k.split(" ")[0] for k in kinds]
    table = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], fastexport.RECORDS).repartition(3)
    made = scrub.scrub(table, path_of=lambda p: F.when(~p.startswith("drop/"), F.concat(F.lit("new/"), p)), mode=mode).collect()
    for seed, records in streams.items():
        got = [(r["seq"], r["kind"], r["mark"], [x for x in [r["parent"], *r["merges"]] if x], [(c["path"], c["ref"]) for c in r["changes"]]) for r in sorted(made, key=lambda r: r["seq"]) if r["stream"] == f"s{seed}"]
        assert got == walk(records, path_of, mode)
    assert {r["kind"] for r in made} >= {"commit", "blob"}


def test_scrubs_of_nothing(spark):
    assert scrub.scrub(spark.createDataFrame([], fastexport.RECORDS)).collect() == []


def test_dense_numbers_over_many_ranges(spark):
    rows = [(rnd % 3, i) for i, rnd in enumerate(random.Random(1).choices(range(100), k=500))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = scrub.dense_numbers(spark.createDataFrame(rows, "g long, i long"), "g", "i", "n").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in range(3):
        assert [r["n"] for r in sorted(got, key=lambda r: r["i"]) if r["g"] == g] == list(range(1, sum(r[0] == g for r in rows) + 1))


def git(repo, *args, data=None):
    who = ["-c", "user.name=A B", "-c", "user.email=a@b.c", "-c", "init.defaultBranch=main", "-c", "commit.gpgsign=false", "-c", "core.quotepath=off"]
    return subprocess.run(["git", *who, "-C", str(repo), *args], check=True, capture_output=True, input=data).stdout.decode()


def test_git_imports_a_scrubbed_history(spark, tmp_path):
    source, target, stream = tmp_path / "source", tmp_path / "target", tmp_path / "stream"
    for r in (source, target):
        r.mkdir()
        git(r, "init", "-q")
    for i in range(4):
        (source / "secret.txt").write_text(f"hidden {i}")
        if i % 2:
            (source / f"é {i}.txt").write_text(f"the word is plugh {i}\n")
        git(source, "add", "-A")
        git(source, "commit", "-q", "-m", f"change {i}")
    git(source, "checkout", "-q", "-b", "side", "HEAD~1")
    (source / "secret.txt").write_text("only hidden")
    git(source, "commit", "-q", "-a", "-m", "side")
    git(source, "tag", "-a", "v1", "-m", "a tag")
    git(source, "checkout", "-q", "main")
    git(source, "merge", "-q", "-s", "ours", "-m", "merged", "side")
    stream.write_bytes(subprocess.run(["git", "-C", str(source), "fast-export", "--all", "--show-original-ids"], check=True, capture_output=True).stdout)
    rules = rewrite.parse_path_rules(["é 1.txt", "é 3.txt"])
    made = scrub.scrub(fastexport.read_exports(spark, f"file://{stream}"), lambda t: replace_text(t, [("plugh", "***")]), lambda p: rewrite.new_path(p, rules))
    git(target, "fast-import", "--quiet", data=b"".join(bytes(r["raw"]) for r in fastexport.serialized(made).orderBy("seq").collect()))
    assert git(target, "log", "--format=%s", "main").split("\n")[:3] == ["merged", "change 3", "change 1"]
    assert git(target, "log", "--format=%s", "side").split("\n")[:1] == ["change 1"] and git(target, "rev-parse", "v1^{commit}") == git(target, "rev-parse", "side")
    assert git(target, "ls-tree", "-r", "--name-only", "main").split("\n")[:2] == ["é 1.txt", "é 3.txt"] and git(target, "show", "main:é 3.txt") == "the word is *** 3\n"
    assert "hidden" not in git(target, "log", "-p", "--all") and git(target, "fsck", "--unreachable") == ""
