"""Blobs by commit and path, signatures, policies, ledgers, pins and vocabularies, on awkward rows and against plain Python."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from leakflow.functions import commands, hashing, places, secrets
from leakflow.operators import graph
from leakflow.sources import objects, settings

ENTRIES = "tree_oid string, name string, oid string, kind string"


def one(spark, value, schema="string"):
    return spark.createDataFrame([(value,)], f"x {schema}")


def test_blobs_at_against_a_walk(spark):
    rnd = random.Random(3)
    trees = {f"t{i}": {} for i in range(40)}
    for i in range(40):
        for name in "abc":
            if i < 30 and rnd.random() < 0.6:
                trees[f"t{i}"][name] = (f"t{rnd.randrange(i + 1, 40)}", "tree")
            elif rnd.random() < 0.8:
                trees[f"t{i}"][name] = (f"b{rnd.randrange(9)}", "blob")
    commits = [(f"c{i}", f"t{rnd.randrange(20)}") for i in range(25)] + [(None, "t1"), ("bare", None), ("lost", "gone")]

    def walk(commit, path):
        at = (dict(c for c in commits if c[0]).get(commit), "tree")
        for part in (path or "").split("/"):
            at = trees.get(at[0], {}).get(part, (None, None)) if at[1] == "tree" else (None, None)
        return at[0] if at[1] == "blob" and path is not None else None

    wanted = [(c, "/".join(rnd.choices("abcd", k=rnd.randrange(1, 7)))) for c, _ in commits for _ in range(80)] + [("c1", ""), ("c1", None), ("c1", "a//b"), ("c1", "/a"), ("c1", "a/"), ("nobody", "a"), (None, "a"), ("c1", "a"), ("c1", "a")]
    entries = spark.createDataFrame([(t, n, *e) for t, es in trees.items() for n, e in es.items()] + [(None, "a", "b1", "blob"), ("t1", None, "b1", "blob")], ENTRIES).withColumn("path", F.lit("clash")).withColumn("commit", F.lit("clash"))
    got = graph.blobs_at(spark.createDataFrame(wanted, "commit string, path string").withColumn("oid", F.lit("clash")), spark.createDataFrame(commits, "oid string, tree string").withColumn("path", F.lit("clash")), entries).collect()
    assert len(got) == len(set(wanted)) and {(r["commit"], r["path"]) for r in got} == set(wanted)
    assert {(r["commit"], r["path"]): r["oid"] for r in got} == {w: walk(*w) for w in wanted}
    assert sum(r["oid"] is not None for r in got) > 50


def test_blobs_at_of_nothing(spark):
    commits, entries = spark.createDataFrame([], "oid string, tree string"), spark.createDataFrame([], ENTRIES)
    wanted = spark.createDataFrame([("c", "a/b")], "commit string, path string")
    assert [tuple(r) for r in graph.blobs_at(wanted, commits, entries).collect()] == [("c", "a/b", None)]
    assert graph.blobs_at(wanted.filter("false"), commits, entries).collect() == []


def test_signatures_stand_in_the_header_of_commits_and_anywhere_in_tags(spark):
    line = "tree {0}\nparent {0}\nauthor A <a> 1 +0000\ncommitter C <c> 2 +0000\n".format("a" * 40).encode()
    rows = [
        ("c1", "commit", line + b"gpgsig -----BEGIN\n x\n\nm"), ("c2", "commit", line + b"\ngpgsig no\n"), ("c3", "commit", line.replace(b"A", b"\xe9\xff") + b"gpgsig-sha256 x\n\n\xff" + b"y" * 2_000_000), ("c4", "commit", b""), ("c5", "commit", None),
        ("t1", "tag", b"object " + b"b" * 40 + b"\ntype commit\ntag v\xff1\ntagger T <t> 1 +0000\n\nm\n-----BEGIN PGP SIGNATURE-----\n"), ("t2", "tag", b"object " + b"b" * 40 + b"\ntype tree\ntag v2\n\nm\n-----BEGIN SSH SIGNATURE-----"),
        ("t3", "tag", b"object x\n\n-----BEGIN PGP MESSAGE-----"), ("t4", "tag", b""), ("b1", "blob", b"-----BEGIN PGP SIGNATURE-----"),
    ]
    stored = spark.createDataFrame(rows, objects.OBJECTS)
    made = {r["oid"]: r for r in objects.commits(stored).collect()}
    assert {k: r["is_signed"] for k, r in made.items()} == {"c1": True, "c2": False, "c3": True, "c4": False, "c5": None}
    assert made["c3"]["parents"] == ["a" * 40] and made["c3"]["date"] == 2 and len(made["c3"]["message"]) == 2_000_001
    tags = {r["oid"]: r for r in objects.tags(stored).collect()}
    assert {k: r["is_signed"] for k, r in tags.items()} == {"t1": True, "t2": True, "t3": False, "t4": False}
    assert (tags["t1"]["object"], tags["t1"]["kind"], tags["t1"]["tag"], tags["t2"]["kind"], tags["t3"]["object"]) == ("b" * 40, "commit", "v�1", "tree", "")


def test_signed_counts_count_each_object_once(spark):
    commits = spark.createDataFrame([("a", ["b", "c"], True), ("b", ["d"], False), ("c", ["d"], True), ("d", ["gone"], None), ("e", [], True), ("d", ["gone"], None)], "oid string, parents array<string>, is_signed boolean")
    tags = spark.createDataFrame([("t1", True), ("t2", False), ("t3", True), (None, True)], "oid string, is_signed boolean")
    refs = spark.createDataFrame([("refs/tags/x", "t1"), ("refs/tags/y/z", "t1"), ("refs/tags/p", "t2"), ("refs/heads/q", "t3"), ("refs/tags/c", "a"), ("refs/tags/n", None), (None, "t3")], "ref string, oid string")
    tips = spark.createDataFrame([("a",), ("b",), ("a",), ("t1",), (None,)], "oid string")
    assert {tuple(r) for r in graph.signed_counts(commits, tags, refs, tips).collect()} == {("commit", 4, 2), ("tag", 2, 1)}
    assert {tuple(r) for r in graph.signed_counts(commits, tags.filter("false"), refs, tips.filter("false")).collect()} == {("commit", 0, 0), ("tag", 0, 0)}


def test_policies_have_defaults(spark):
    def read(text):
        return one(spark, text).select(settings.policy(F.col("x")).alias("p")).select("p.*", *(settings.gate_applies(F.col("p"), F.lit(c).cast("string")).alias(str(c)) for c in ("push", "fetch", None)), settings.gate_blocks(F.col("p")).alias("blocks")).first().asDict(True)

    bare = {"version": 0, "secretGate": {"enabled": False, "commands": [], "mode": ""}, "remoteAllowlist": {"enabled": False, "hosts": []}, "stages": {"pre": [], "post": []}, "push": False, "fetch": False, "None": False, "blocks": True}
    assert read(None) == read("{}") == read(' {"other": 1}\n') == read('{"secretGate": null, "stages": {}}') == bare
    full = read(json.dumps({"version": 2, "secretGate": {"enabled": True, "mode": "warn"}, "remoteAllowlist": {"hosts": ["a.b/c"]}, "stages": {"pre": [{"run": ["x"]}, {"name": "n", "timeoutMs": 7}], "post": []}}))
    assert full["push"] and not full["fetch"] and not full["None"] and not full["blocks"] and full["remoteAllowlist"] == {"enabled": False, "hosts": ["a.b/c"]}
    assert full["stages"]["pre"] == [{"name": "", "run": ["x"], "timeoutMs": 5000}, {"name": "n", "run": [], "timeoutMs": 7}]
    named = read('{"secretGate": {"enabled": true, "commands": ["fetch"]}}')
    assert named["fetch"] and not named["push"]


@pytest.mark.parametrize("text", ["", "  ", "[]", "3", "{", '{"version": "x"}', '{"version": 1', '{"secretGate": []}', "{} {"])
def test_what_is_no_policy_or_ledger_fails(spark, text):
    for parse in (settings.policy, settings.ledger):
        if parse is settings.ledger and "secretGate" in text:
            continue
        with pytest.raises(Exception, match="JSON|MALFORMED|PARSE|Malformed"):
            one(spark, text).select(parse(F.col("x")).alias("p")).collect()


def test_files_of_settings(spark, tmp_path):
    assert settings.load(spark, f"file://{tmp_path}/none.json").first()["secretGate"]["enabled"] is False
    assert settings.load(spark, f"file://{tmp_path}/none.json", "ledger").first().asDict(True) == {"version": 1, "updated_at": "", "gates": [], "leaks": [], "vulns": []}
    (tmp_path / "state.json").write_text(json.dumps({"version": 1, "leaks": [{"rule_id": "r", "line": 3}]}, indent=2))
    assert settings.load(spark, f"file://{tmp_path}/state.json", "ledger").first().asDict(True)["leaks"] == [{"rule_id": "r", "path": "", "line": 3, "fingerprint": "", "at": ""}]
    (tmp_path / "empty.json").write_text("")
    with pytest.raises(Exception, match="JSON"):
        settings.load(spark, f"file://{tmp_path}/empty.json").collect()


def test_pins_and_padding(spark):
    good = hashlib.sha256("é".encode()).hexdigest()
    rows = [("é", good), ("é", good.upper()), ("", None), (None, good), (None, None), ("x", good)]
    got = [r[0] for r in spark.createDataFrame(rows, "u string, p string").coalesce(1).select(hashing.pin_problem(F.col("u"), F.col("p"))).collect()]
    assert got[0] is None and all(got[1:]) and got[5] == f"x (got {hashlib.sha256(b'x').hexdigest()}, want {good})"
    wide = one(spark, "é日").select(commands.padded(F.col("x"), 4), commands.padded(F.col("x"), 1), commands.shortened(F.col("x"), 0), commands.padded(F.lit(None).cast("string"), 3)).first()
    assert tuple(wide) == ("é日  ", "é日", "…", None)


def test_connection_strings_keep_the_last_value(spark):
    rnd = random.Random(5)
    for text in [None, "", ";;", "a=1;a=2", "=x;a==b=;c", *(";".join(rnd.choice(["a=", " b =x=y", "c", "d=" + str(i), "a=" + str(i)]) for i in range(rnd.randrange(300))) for _ in range(8))]:
        want = None if text is None else {p.split("=", 1)[0].strip(" "): p.split("=", 1)[1] for p in text.split(";") if "=" in p}
        assert one(spark, text).select(places.connection_string(F.col("x"))).first()[0] == want


def test_ratios_of_a_vocabulary_are_those_of_another_library(spark):
    public_tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    import base64

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(2)
    texts = ["", "password", "hunter two", "aGVsbG8gd29ybGQ", "é日本😀", "x" * 50_000, *("".join(rnd.choices("abcdefXYZ0189+/ _-\n", k=rnd.randrange(1, 60))) for _ in range(300))]
    plain = [t.replace("\n", "").replace("\r", "") if len(t.encode()) < 20 else t for t in texts]
    want = [(len(t.encode()) / n if (n := len(encoding.encode_ordinary(t))) else 0.0) for t in plain]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "i long, x string")
    count = secrets.vocabulary_counter(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["i"]: r["ratio"] for r in rows.select("i", secrets.token_ratio(F.col("x"), count).alias("ratio")).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want) and got[-1] == 0.0
