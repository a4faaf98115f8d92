"""Export streams: read, transform, write, and import again with git. Commands and decoys on fixed vectors."""

import io
import subprocess

import pytest
from pyspark.sql import functions as F

from leakflow.functions import commands, secrets
from leakflow.functions.masking import replace_text
from leakflow.operators import rewrite
from leakflow.sources import fastexport


def git(repo, *args, data=None):
    who = ["-c", "user.name=A B", "-c", "user.email=a@b.c", "-c", "init.defaultBranch=main", "-c", "commit.gpgsign=false"]
    return subprocess.run(["git", *who, "-C", str(repo), *args], check=True, capture_output=True, input=data).stdout


@pytest.fixture(scope="module")
def export(tmp_path_factory):
    r = tmp_path_factory.mktemp("src")
    git(r, "init", "-q")
    for i in range(4):
        (r / "keep").mkdir(exist_ok=True)
        (r / "keep" / f"é {i}.txt").write_text(f"the word is plugh {i}\n")
        (r / "drop.txt").write_text(f"gone {i}")
        (r / "bin").write_bytes(b"\0plugh\n\n" + bytes([i]))
        git(r, "add", "-A")
        git(r, "commit", "-q", "-m", f"change {i}\n\nbody")
    git(r, "checkout", "-q", "-b", "side", "HEAD~1")
    (r / "s.txt").write_text("side\n")
    git(r, "add", "-A")
    git(r, "commit", "-q", "-m", "side")
    git(r, "checkout", "-q", "main")
    git(r, "merge", "-q", "-m", "merged", "side")
    git(r, "tag", "-a", "v1", "-m", "a tag")
    out = tmp_path_factory.mktemp("out") / "stream"
    out.write_bytes(git(r, "fast-export", "--all", "--show-original-ids"))
    return r, out


def imported(tmp_path, records):
    raw = b"".join(bytes(r["raw"]) for r in fastexport.serialized(records).orderBy("seq").collect())
    git(tmp_path, "init", "-q")
    git(tmp_path, "fast-import", "--quiet", data=raw)
    return tmp_path


def test_an_unchanged_stream_imports_to_the_same_commits(spark, export, tmp_path):
    source, out = export
    records = fastexport.read_exports(spark, f"file://{out}")
    assert git(imported(tmp_path, records), "show-ref") == git(source, "show-ref")


def test_rewritten_streams(spark, export, tmp_path):
    _, out = export
    records = fastexport.read_exports(spark, f"file://{out}")
    rules = rewrite.parse_path_rules(["drop.txt==>never/drop.txt", "keep/==>kept/", "literal:kept", "bin", "s.txt"])
    changed = fastexport.rename_changes(fastexport.replace_blobs(records, lambda t: replace_text(t, [("plugh", "***")])), lambda p: rewrite.new_path(p, rules))
    repo = imported(tmp_path, changed)
    names = git(repo, "-c", "core.quotepath=off", "ls-tree", "-r", "--name-only", "main").decode().split("\n")[:-1]
    assert names == ["bin", *(f"kept/é {i}.txt" for i in range(4)), "s.txt"]
    assert git(repo, "show", "main:kept/é 1.txt") == b"the word is *** 1\n" and git(repo, "show", "main:bin").startswith(b"\0plugh")


def test_stream_parser_details():
    text = b'blob\nmark :1\ndata <<END\na\nEND\nreset refs/heads/x\nfrom :1\n\ncommit refs/heads/m\nmark :2\ncommitter A <a@b> 1 +0000\ndata 2\nhi\nM 100644 :1 "q\\"\\303\\251"\nD old\nR "a b" c\ndeleteall\n\nprogress p\ndone\n'
    got = list(fastexport.parse_stream(io.BytesIO(text).read))
    assert [r["kind"] for r in got] == ["blob", "reset", "commit", "progress", "done"]
    assert got[0]["data"] == b"a\n" and got[1]["parent"] == ":1"
    assert [(c["kind"], c["path"], c["new_path"]) for c in got[2]["changes"]] == [("M", 'q"é', None), ("D", "old", None), ("R", "a b", "c"), ("deleteall", None, None)]
    with pytest.raises(ValueError):
        list(fastexport.parse_stream(io.BytesIO(b"blob\ndata 9\nab").read))


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def words(*w):
    return F.array(*map(F.lit, w))


def test_commands(spark):
    assert value(spark, commands.verb(words("-C", "push", "--no-pager", "log"))) == "log"
    assert value(spark, commands.verb(words("--exec-path", "push"))) == "push"
    assert value(spark, commands.config_overrides(words("-c", "A.b=1", "-c", "c.d", "status", "-c", "no=1"))) == ["a.b", "c.d"]
    assert value(spark, commands.remote_refs(words("push", "-o", "opt", "git@h:o/r"))) == ["opt", "git@h:o/r"]
    assert value(spark, commands.remote_refs(words("remote", "add", "n", "https://h/o"))) == ["https://h/o"]
    assert value(spark, commands.remote_refs(words("log", "x"))) == []
    assert [value(spark, commands.auditable(words(*w))) for w in (("status",), ("--version",), ("help",), ("log", "--help"))] == [True, False, False, False]
    assert value(spark, commands.rewrites_remote(F.lit("url.x.pushInsteadOf"))) is True
    env = F.create_map(*map(F.lit, ("PATH", "/b", "GIT_X", "https://u:p@h", "OTHER", "1")))
    assert value(spark, commands.kept_environment(env)) == {"PATH": "/b", "GIT_X": "https://u:***@h"}


@pytest.mark.parametrize(
    "nanos,text", [(0, "0s"), (7, "7ns"), (1500, "1.5µs"), (2_000_000, "2ms"), (1_500_000_000, "1.5s"), (90_000_000_000, "1m30s"), (1_209_600_000_000_000, "336h0m0s"), (-1_000_000_001, "-1.000000001s")]
)
def test_durations(spark, nanos, text):
    assert value(spark, commands.duration_text(F.lit(nanos).cast("long"))) == text
    assert value(spark, commands.parse_duration(F.lit(text))) == nanos


def test_bad_durations_and_paths(spark):
    assert [value(spark, commands.parse_duration(F.lit(x))) for x in ("", "1", "1x", "s", "+1.5h")] == [None, None, None, None, 5_400_000_000_000]
    for raw, want in (("", "."), ("a/..", "."), ("/..", "/"), ("../../a", "../../a"), ("a/../../b", "../b"), ("//x//y/", "/x/y")):
        assert value(spark, commands.clean_path(F.lit(raw))) == want
    assert value(spark, commands.quote_path(F.lit('"a\nb'))) == '"\\"a\\nb"' and value(spark, commands.quote_path(F.lit("a b"))) == "a b"


def test_decoys_and_ratios(spark):
    secret = "pre_" + "aB3xY9" * 6
    decoy = value(spark, secrets.obfuscate(F.lit(secret)))
    kind = lambda t: ["l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else c for c in t]
    assert decoy != secret and decoy.startswith("pre_") and kind(decoy) == kind(secret) and decoy == value(spark, secrets.obfuscate(F.lit(secret)))
    assert value(spark, secrets.token_ratio(F.lit("abcdef"))) == 0.0
    assert value(spark, secrets.token_ratio(F.lit("ab\ncd"), lambda texts: [max(1, len(t) // 2) for t in texts])) == 2.0
    fails = lambda s, r, w5, w4: value(spark, secrets.fails_efficiency(F.lit(s), F.lit(r), F.lit(w5), F.lit(w4)))
    assert [fails("abcdefgh", 2.2, False, True), fails("abcdefgh", 2.2, False, False), fails("a" * 30, 2.6, False, False), fails("a" * 30, 0.0, True, True), fails("a" * 30, 1.0, True, False)] == [True, False, True, False, True]
