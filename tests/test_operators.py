"""Detection, graphs, audit, rewriting, decoding, sources and streams on small inputs."""

import base64
import hashlib
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from leakflow.operators import audit, decode, detect, graph, matching, rewrite, rules
from leakflow.operators.rules import Component, Rule
from leakflow.sources import files, objects, reports


def frags(spark, *texts, path="a/b.txt"):
    return spark.createDataFrame([(i, t, 0, path) for i, t in enumerate(texts)], "fragment_id long, raw string, start_line long, path string")


def aws(rnd):
    return "AK" + "IA" + "".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)), "".join(rnd.choices("ABCDEFGHabcdefgh0123456789+/XYZxyz", k=40))


def found(spark, *texts, rules_=rules.BUILTIN, **how):
    return sorted((r["fragment_id"], r["rule_id"], r["secret"]) for r in detect.detect(frags(spark, *texts), rules_, **how).collect())


def test_composite_rule_needs_its_component(spark):
    key, secret = aws(random.Random(1))
    near, far = f'id = "{key}"\naws_secret = "{secret}"\n', f'id = "{key}"\n' + "\n" * 20 + f'aws_secret = "{secret}"\n'
    got = found(spark, near, far, f"id = {key}\n")
    assert (0, "aws-access-token", key) in got and not any(i in (1, 2) and r == "aws-access-token" for i, r, _ in got)
    assert not any(r == "aws-secret-access-key" for _, r, _ in got)


def test_tokens_fire_and_prose_does_not(spark):
    rnd = random.Random(2)
    body = lambda n: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOP0123456789", k=n))
    pat, lab = "gh" + "p_" + body(36), "gl" + "pat-" + body(20)
    got = found(spark, f"x {pat} y", f"{lab}", "nothing to see here, only words.", "ghp_" + "a" * 36)
    assert (0, "github-pat", pat) in got and (1, "gitlab-pat", lab) in got and {i for i, *_ in got} == {0, 1}


def test_allow_markers_and_confidence(spark):
    token = "k3J8f7Qz91LmXv02RtYw"
    text = f'my_token = "{token}"'
    assert found(spark, text) == [(0, "generic-api-key", token)]
    assert found(spark, text + " # leakflow:allow") == []
    assert found(spark, text, least_confidence="medium") == []


def test_large_catalogues_are_joined_with_the_same_result(spark, monkeypatch):
    key, secret = aws(random.Random(3))
    made = [Rule("a", "x=([0-9]+)(y?)", ("X=",)), Rule("b", "(u?)v([0-9])"), Rule("c", "w([0-9])([0-9])", secret_group=2, path="b[.]txt$"), Rule("d", "w", path="none$"), *rules.BUILTIN]
    table = frags(spark, "x=12y x=3\nv4 uv5 w67\n\n", f'id = "{key}"\naws_secret = "{secret}"\n', 'my_token = "k3J8f7Qz91LmXv02RtYw"\n', "nothing")
    cols = ["fragment_id", "rule_id", "start", "end", "start_line", "start_column", "end_column", "match", "secret", "specificity"]
    inline = sorted(map(tuple, detect.scan(table, made).select(cols).collect()))
    monkeypatch.setattr(detect, "INLINE_RULES", 2)
    assert sorted(map(tuple, detect.scan(table, made).select(cols).collect())) == inline and {r[1] for r in inline} >= {"a", "b", "c", "generic-api-key"}
    assert {(r[1], r[8]) for r in inline if r[0] == 0 and r[1] in "abc"} == {("a", "12"), ("a", "3"), ("b", "4"), ("b", "u"), ("c", "7")}


def test_partitions_do_not_matter(spark):
    texts = [f'a\nmy_token = "k3J8f7Qz91LmXv0{i}RtYw"\n' for i in range(30)]
    one, many = frags(spark, *texts).coalesce(1), frags(spark, *texts).repartition(7)
    assert sorted(map(tuple, detect.detect(one).collect())) == sorted(map(tuple, detect.detect(many).collect()))


def test_locations(spark):
    table = frags(spark, "ab X12\ncd X34 é X56", "X78")
    got = {r["secret"]: (r["start_line"], r["start_column"], r["end_column"]) for r in detect.scan(table, [Rule("x", r"X\d\d")]).collect()}
    assert got == {"X12": (0, 4, 6), "X34": (1, 5, 7), "X56": (1, 12, 14), "X78": (0, 1, 3)}


def test_windows(spark):
    row = spark.range(1).select(F.lit("aa\nbb X1 cc\ndd\nee").alias("raw"))
    got = row.select(matching.line_window(F.col("raw"), F.lit(6), F.lit(8), 1, 1), matching.column_window(F.col("raw"), F.lit(6), F.lit(8), 3, 3), matching.line_around(F.col("raw"), F.lit(6), F.lit(8))).first()
    assert tuple(got) == ("aa\nbb X1 cc\ndd", "bb X1 cc", "bb X1 cc")


@pytest.mark.parametrize("within,want", [("", ("", 0, 0, 0, 0)), ("5L", ("box", 0, 0, 4, 4)), ("20C", ("cols", 20, 20, 0, 0)), ("-3L,+10C", ("box", 0, 10, 2, 0))])
def test_window_grammar(within, want):
    assert rules.parse_window(within) == want
    with pytest.raises(ValueError):
        rules.parse_window("5X")


def test_component_sets_are_bounded_products(spark):
    made = [Rule("p", "P"), Rule("a", "[0-9]", skip_report=True), Rule("b", "[xyz]", skip_report=True)]
    composite = [Rule("p", "P", components=(Component("a"), Component("b")))]
    scanned = detect.scan(frags(spark, "P 123 xyz", "P 1", "P " + "1" * 20 + "x" * 20), made)
    sizes = {r["fragment_id"]: len(r["component_sets"]) for r in detect.with_components(scanned, composite).filter("rule_id = 'p'").collect()}
    assert sizes == {0: 9, 2: 100}


def test_suppression_looks_at_all_findings(spark):
    schema = "fragment_id long, start_line long, rule_id string, secret string, specificity int"
    table = spark.createDataFrame([(1, 1, "low", "abc", 1), (1, 1, "mid", "abcd", 2), (1, 1, "high", "abcde", 3), (1, 2, "low", "abc", 1), (2, 1, "low", "abc", 1)], schema)
    assert sorted((r["fragment_id"], r["start_line"], r["rule_id"]) for r in detect.suppress(table).collect()) == [(1, 1, "high"), (1, 2, "low"), (2, 1, "low")]


def test_ignore_and_baseline(spark):
    table = spark.createDataFrame([("p", "r", 1, "c1"), ("p", "r", 2, "c1"), ("q", "r", 1, None)], "path string, rule_id string, start_line long, commit string")
    lines = spark.createDataFrame([("# x",), ("p:r:1",), ("c1:p:r:2",), ("bad",), ("",)], "value string")
    ignore = detect.parse_ignore(lines)
    assert [r["good"] for r in ignore.orderBy("entry").collect()] == [False, True, True]
    assert [r["path"] for r in detect.drop_ignored(table, ignore).collect()] == ["q"]
    assert detect.drop_known(table, table.filter("path = 'q'"), ["path", "commit"]).count() == 2


def test_rule_checks_and_catalog(tmp_path):
    assert all(not r.problems() for r in rules.BUILTIN)
    assert Rule("", "", confidence="odd").problems() == ["no id", "neither regex nor path", "confidence odd"]
    assert Rule("x", "(a)", secret_group=2).problems()
    file = tmp_path / "c.toml"
    file.write_text('[[rules]]\nid = "x"\nregex = "a(b)"\nkeywords = ["AB"]\nentropy = 2.5\n')
    (rule,) = rules.load_catalog(str(file))
    assert rule.keywords == ("ab",) and rule.filter == "(byte_entropy(secret) <= 2.5)"
    file.write_text('[[rules]]\nid = "x"\nodd = 1\n')
    with pytest.raises(ValueError):
        rules.load_catalog(str(file))
    assert [r.rule_id for r in rules.extend([Rule("a", "a"), Rule("b", "b")], [Rule("b", "c"), Rule("d", "d")], {"a"})] == ["b", "d"]


def test_dialects():
    assert rules.java_pattern(r"(?P<a_b>x){2,}{{[^}]+}\p{L}") == r"(?<ab>x){2,}\{\{[^}]+}\p{L}"
    assert rules.python_pattern(r"x(?i)y\z") == r"x(?i:y\Z)"


def test_reachability_of_a_merged_graph(spark):
    parents = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("e", "d")], "oid string, parent string")
    tip = lambda *o: spark.createDataFrame([(x,) for x in o], "oid string")
    assert {r["oid"] for r in graph.reachable(parents, tip("d")).collect()} == set("abcd")
    assert {r["oid"] for r in graph.range_difference(parents, tip("e"), tip("b")).collect()} == set("ecd")
    refs = spark.createDataFrame([("x", "d"), ("y", "a")], "ref string, oid string")
    assert {(r["ref"], r["n"]) for r in graph.refs_that_hold(refs, parents, tip("b", "c")).collect()} == {("x", 2)}
    first = parents.filter("oid <> 'd' or parent = 'b'")
    assert {(r["oid"], r["parent"]) for r in graph.survivors(first, tip("d", "b", "a")).collect()} == {("d", None), ("b", None), ("a", None)}
    assert {(r["oid"], r["parent"]) for r in graph.survivors(first, tip("d", "b")).collect()} == {("d", "a"), ("b", "a")}


def test_lookups_by_the_beginning_of_an_id(spark):
    listing = spark.createDataFrame([("abcd", "x"), ("abce", "y"), ("abce", "y"), ("b", "z"), ("abcd", " "), (None, "n"), ("abcf", None)], "oid string, path string")
    ids = lambda *o: spark.createDataFrame([(x,) for x in o], "id string")
    got = sorted(tuple(r) for r in graph.paths_of(listing, ids("abc", "abcd", "bb", "", None, "abc", "q" * 65)).collect())
    assert got == [("abc", "x"), ("abc", "y"), ("abcd", "x")] and graph.paths_of(listing, ids("", None)).collect() == []
    findings = spark.createDataFrame([("v1:a.txt:r:1",), ("a.txt:r:1",), ("b.txt:r:1",), (None,)], "fingerprint string")
    count = lambda wanted: detect.traced(findings, wanted).count()
    assert [count(w) for w in ("a.txt:r:1", " a.t ", "v1:a", "v1:b", "", "b.txt:r:12", "b%")] == [2, 2, 1, 0, 0, 0, 0]


def test_reachability_of_long_lines_circles_and_random_graphs(spark):
    rnd = random.Random(8)
    tips_of = lambda *o: spark.createDataFrame([(x,) for x in o], "oid long")
    table = lambda pairs: spark.createDataFrame(pairs, "oid long, parent long")

    def walk(pairs, *start):
        after, seen, left = {}, set(start), list(start)
        for a, b in pairs:
            after.setdefault(a, []).append(b)
        while left:
            fresh = [b for b in after.get(left.pop(), []) if b is not None and b not in seen]
            seen.update(fresh)
            left.extend(fresh)
        return seen

    def reached(pairs, *start):
        rows = [r["oid"] for r in graph.reachable(table(pairs), tips_of(*start)).collect()]
        assert len(rows) == len(set(rows))
        return set(rows)

    # 5,000 commits in a line, every tenth of which merges a branch of three commits that left the line before
    line = [(i, i - 1) for i in range(1, 5000)]
    merged = [p for i in range(20, 5000, 10) for p in ((i, 10_000 + 3 * i), (10_000 + 3 * i, 10_001 + 3 * i), (10_001 + 3 * i, i - 15))]
    assert reached(line + merged, 4999) == walk(line + merged, 4999)
    circle = [(1, 2), (2, 3), (3, 1), (4, 1), (3, 5), (None, 4), (5, None), (4, 1)]
    assert reached(circle, 4) == {1, 2, 3, 4, 5} and reached(circle, 5, 5, 77) == {5, 77} and reached([], 3) == {3}
    assert reached(circle) == set() and reached(circle, None) == set()
    wild = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(330)]
    assert reached(wild, 7, 8) == walk(wild, 7, 8)
    refs = spark.createDataFrame([(f"r{i}", i) for i in range(12)] + [("r1", 2), ("empty", None)], "ref string, oid long")
    want = {f"r{i}": len({x for x in walk(wild, i, *([2] if i == 1 else [])) if x % 3 == 0}) for i in range(12)}
    got = {r["ref"]: r["n"] for r in graph.refs_that_hold(refs, table(wild), tips_of(*range(0, 300, 3))).collect()}
    assert got == {ref: n for ref, n in want.items() if n}


def test_budget_cuts_like_one_running_total(spark):
    rows = spark.createDataFrame([(i, (i * 37) % 11) for i in range(500)], "k long, n long")
    total, want = 0, []
    for i in range(500):
        total += (i * 37) % 11
        want += [(i, total)] if total <= 700 else []
    assert sorted((r["k"], r["running"]) for r in graph.within_budget(rows, "k", "n", 700).collect()) == want


def test_chain_breaks_where_a_row_changed(spark):
    rows = spark.createDataFrame([(u, i, f"t{i}") for u in (1, 2) for i in range(20)], "u long, id long, t string")
    chained = audit.build_chain(rows, "u", "id", ["t"])
    whole = {tuple(r) for r in audit.verify_chain(chained, "u", "id", ["t"]).collect()}
    assert whole == {(1, 20, 0, None), (2, 20, 0, None)}
    touched = chained.withColumn("t", F.when((F.col("u") == 1) & (F.col("id") == 7), "x").otherwise(F.col("t")))
    gone = chained.filter("not (u = 2 and id = 5)")
    assert {tuple(r) for r in audit.verify_chain(touched, "u", "id", ["t"]).collect()} == {(1, 20, 0, 7), (2, 20, 0, None)}
    assert {tuple(r) for r in audit.verify_chain(gone, "u", "id", ["t"]).collect()} == {(1, 20, 0, None), (2, 19, 0, 6)}
    legacy = chained.withColumn("row_hash", F.when((F.col("u") == 1) & (F.col("id") == 0), "").otherwise(F.col("row_hash")))
    assert (1, 19, 1, 1) in {tuple(r) for r in audit.verify_chain(legacy, "u", "id", ["t"]).collect()}


def test_path_rules(spark):
    table = spark.createDataFrame([(p,) for p in ("a/x", "ab", "b/a/y.txt", "c/z.py")], "p string")
    run = lambda lines, **k: {r["p"]: r["n"] for r in table.select("p", rewrite.new_path(F.col("p"), rewrite.parse_path_rules(lines), **k).alias("n")).collect()}
    assert run(["a"]) == {"a/x": "a/x", "ab": None, "b/a/y.txt": None, "c/z.py": None}
    assert run(["a"], inverted=True) == {"a/x": None, "ab": "ab", "b/a/y.txt": "b/a/y.txt", "c/z.py": "c/z.py"}
    assert run(["glob:*.py", "b/==>q/", "regex:^q/"]) == {"a/x": None, "ab": None, "b/a/y.txt": "q/a/y.txt", "c/z.py": "c/z.py"}
    assert run([r"regex:^(\w)/==>\1_"])["a/x"] == "a_x"
    assert rewrite.parse_replacements(["a==>b==>c", "regex:x+", "plain"]) == ([("a==>b", "c"), ("plain", "***REMOVED***")], [("x+", "***REMOVED***")])


def test_decoding(spark):
    text = "user token 12345"
    runs = {"hex": text.encode().hex(), "b64": base64.b64encode(text.encode()).decode(), "pct": "".join(f"%{b:02X}" for b in text.encode())}
    row = spark.createDataFrame([runs]).select(decode.decode_hex(F.col("hex")), decode.decode_base64(F.col("b64")), decode.decode_percent(F.col("pct")), decode.decode_hex(F.lit("abc")), decode.decode_base64(F.lit("abcdefgh"))).first()
    assert tuple(row) == (text, text, text, "", "")
    for kind, run in runs.items():
        got = decode.decode_fragments(frags(spark, f"x {run} y")).collect()
        assert got[0]["raw"] == f"x {text} y" and got[0]["segments"][0]["orig_start"] == 2 and got[0]["segments"][0]["orig_end"] == 2 + len(run), kind
    nested = base64.b64encode(runs["hex"].encode()).decode()
    got = decode.decode_fragments(frags(spark, f"ab {nested} cd")).orderBy("depth").collect()
    assert [r["depth"] for r in got] == [1, 2] and got[1]["raw"] == f"ab {text} cd" and got[1]["segments"][0]["orig_end"] == 3 + len(nested)


def test_chunks_end_between_paragraphs():
    text = b"".join(b"line %d\n" % i + (b"\n" if i % 7 == 0 else b"") for i in range(400))
    parts = list(files.chunk_bytes(text, 500, 200))
    assert b"".join(c for _, c in parts) == text and len(parts) > 3
    assert all(line == 1 + text[: text.index(c)].count(b"\n") for line, c in parts)
    assert all(c.endswith(b"\n\n") for _, c in parts[:-1])


def test_archives_within_archives(tmp_path):
    import gzip
    import io
    import zipfile

    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep/a.txt", "secret")
        z.writestr("../bad.txt", "no")
    data = gzip.compress(inner.getvalue())
    assert list(files.unpack("x/f.zip.gz", data, 3)) == [("x/f.zip.gz!f.zip!deep/a.txt", b"secret")]
    assert list(files.unpack("x/f.zip.gz", data, 0)) == [("x/f.zip.gz", data)]
    assert list(files.unpack("b.zip", b"PK\x03\x04broken", 2)) == []


def git(repo, *args):
    who = ["-c", "user.name=A B", "-c", "user.email=a@b.c", "-c", "init.defaultBranch=main", "-c", "commit.gpgsign=false"]
    return subprocess.run(["git", *who, "-C", str(repo), *args], check=True, capture_output=True, text=True).stdout


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    r = tmp_path_factory.mktemp("repo")
    git(r, "init", "-q")
    for i in range(6):
        (r / "dir").mkdir(exist_ok=True)
        (r / "dir" / "f.txt").write_text("".join(f"line {j} of {i if j == 3 else 0}\n" for j in range(200)))
        (r / f"g{i}.txt").write_text(f"file {i}\n")
        git(r, "add", "-A")
        git(r, "commit", "-q", "-m", f"change {i}")
    git(r, "tag", "v1", "HEAD~2")
    git(r, "gc", "-q")
    (r / "late.txt").write_text("late\n")
    git(r, "add", "-A")
    git(r, "commit", "-q", "-m", "late")
    git(r, "checkout", "-q", "-b", "side", "HEAD~1")
    return r


def test_objects_are_those_of_git(spark, repo):
    d = str(repo / ".git")
    all_objects = objects.objects(objects.loose_objects(spark, d), objects.packed_objects(spark, d))
    got = {(r["oid"], r["kind"]): bytes(r["content"]) for r in all_objects.collect()}
    lines = git(repo, "cat-file", "--batch-all-objects", "--batch-check=%(objectname) %(objecttype)").split("\n")[:-1]
    assert set(got) == {tuple(x.split(" ")) for x in lines}
    assert all(got[k].decode() == git(repo, "cat-file", "blob", k[0]) for k in got if k[1] == "blob")
    refs = {(r["ref"], r["oid"]) for r in objects.references(spark, d).collect()}
    want = {tuple(x.split(" ")[::-1]) for x in git(repo, "show-ref").split("\n")[:-1]} | {("HEAD", git(repo, "rev-parse", "HEAD").strip())}
    assert refs == want
    assert {(r["path"], r["oid"]) for r in objects.staged_files(spark, d).collect()} == {(x.split("\t")[1], x.split(" ")[1]) for x in git(repo, "ls-files", "-s").split("\n")[:-1]}
    commits, entries = objects.commits(all_objects), objects.tree_entries(all_objects)
    parents = commits.select("oid", F.explode("parents").alias("parent"))
    tip = spark.createDataFrame([(git(repo, "rev-parse", "main").strip(),)], "oid string")
    assert {r["oid"] for r in graph.reachable(parents, tip).collect()} == set(git(repo, "rev-list", "main").split())
    root = git(repo, "rev-parse", "main^{tree}").strip()
    blobs = graph.expand_tree(entries, spark.createDataFrame([(root,)], "root string"))
    assert {(r["path"], r["oid"]) for r in blobs.collect()} == {(x.split("\t")[1], x.split(" ")[2].split("\t")[0]) for x in git(repo, "ls-tree", "-r", "main").split("\n")[:-1]}


def test_diffs_of_git(spark, repo):
    text = git(repo, "log", "-p", "-U0", "main")
    hunks = files.diff_hunks(spark.createDataFrame([(text,)], "text string"))
    rows = hunks.filter("new_path = 'dir/f.txt' and not is_new").collect()
    assert len(rows) == 5 and all(r["new_start"] == 4 and r["added"].startswith("line 3 of") and r["author_email"] == "a@b.c" for r in rows)
    assert files.hunk_fragments(hunks).filter("path = 'late.txt'").first()["raw"] == "late\n"
    assert {r["message"] for r in hunks.collect()} == {"late", *(f"change {i}" for i in range(6))}


def test_file_source(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a" / "x.txt").write_text("hello\n")
    (tmp_path / "a" / "p.png").write_bytes(b"png")
    (tmp_path / "node_modules" / "y.txt").write_text("no")
    (tmp_path / "a" / "empty").write_text("")
    (tmp_path / "a" / "bin").write_bytes(b"ab\0cd\xff")
    read = files.read_files(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r["raw"] for r in files.file_fragments(read).collect()}
    assert got == {"x.txt": "hello\n", "bin": "ab\0cd\ufffd"}
    assert files.file_fragments(read, skip_binary=True).count() == 1
    assert {r["path"].rsplit("/", 1)[1] for r in read.filter(files.is_binary(F.col("content"))).collect()} == {"bin"}


def test_reports(spark, tmp_path):
    token = "k3J8f7Qz91LmXv02RtYw"
    got = detect.detect(frags(spark, f'my_token = "{token}"'))
    reports.write_csv(got, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).collect()
    assert back[0]["Secret"] == token and list(back[0].asDict()) == reports.CSV_COLUMNS
    reports.write_json(got, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first()["StartLine"] == 0
    assert token not in reports.human_lines(got).first()["value"] and token not in reports.sarif_results(got).first()["value"]
    assert "testcase" in reports.junit_cases(got).first()["value"]
    assert spark.range(1).select(reports.strip_controls(F.lit("a\x1b[31mb\x1b]0;t\x07c\x00"))).first()[0] == "abc"


def test_streamed_scan_skips_known_contents(spark, tmp_path):
    from leakflow.streaming import scans

    schema = "fragment_id long, raw string, start_line long, path string"
    text = 'my_token = "k3J8f7Qz91LmXv02RtYw"'
    out: list = []
    for n, rows in enumerate(([(1, text, 0, "p")], [(2, text, 0, "p"), (3, text + " ", 0, "p")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = scans.stream_table(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        scans.scan_new(stream, str(tmp_path / "cache"), lambda df, i: out.extend(r["fragment_id"] for r in df.collect()), str(tmp_path / "check")).awaitTermination()
    # a known content isn't scanned again, but its findings are there for the new fragment too
    assert sorted(out) == [1, 2, 3]
    cached = scans.read_cache(spark, str(tmp_path / "cache"), scans.rules_version(rules.BUILTIN, skip=""))
    assert sorted((r["batch"], r["content"]) for r in cached.collect()) == [(0, hashlib.sha256(text.encode()).hexdigest()), (1, hashlib.sha256((text + " ").encode()).hexdigest())]
