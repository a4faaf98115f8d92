"""Catalogue files, running sums and findings in decoded runs."""

import base64
import random
import re

import pytest
from pyspark.sql import functions as F

from leakflow.operators import detect, matching, rules
from leakflow.operators.rules import Rule


def test_catalogues_extend_and_allow(tmp_path):
    (tmp_path / "base.toml").write_text('[[rules]]\nid = "a"\nregex = "a"\n[[rules]]\nid = "b"\nregex = "b"\n[allowlist]\npaths = ["skip/"]\n')
    (tmp_path / "own.toml").write_text(
        '[extend]\npath = "base.toml"\ndisabledRules = ["b"]\n[[allowlists]]\ntargetRules = ["c"]\nregexes = ["^it\'s"]\n[[rules]]\nid = "c"\nregex = "c"\n'
        '[[rules.allowlists]]\ncondition = "AND"\npaths = ["x"]\nstopwords = ["no"]\n[[rules.setConfidence]]\nwhen = "length(secret) < 9"\nvalue = "low"\n'
    )
    made = rules.load_config(str(tmp_path / "own.toml"))
    assert [r.rule_id for r in made.rules] == ["a", "c"] and made.skipped_paths == ("skip/",)
    assert " and " in made.rules[1].filter and made.rules[1].set_confidence == (("length(secret) < 9", "low"),) and "it\\'s" in made.skip
    (tmp_path / "odd.toml").write_text("[allowlist]\nodd = 1\n")
    with pytest.raises(ValueError):
        rules.load_config(str(tmp_path / "odd.toml"))


def test_predicates_of_a_catalogue_and_captures(spark):
    rule = Rule("c", "k=(?P<name>[a-z]+)", filter=rules.allowlist_predicate("c", {"stopwords": ["no"], "paths": ["x$"], "condition": "AND"}), set_confidence=(("length(secret) < 4", "low"),))
    frags = spark.createDataFrame([(1, "k=nono", 0, "x"), (2, "k=nono", 0, "y"), (3, "k=abc\nk=it", 0, "x")], "fragment_id long, raw string, start_line long, path string")
    got = sorted((r["fragment_id"], r["secret"], r["confidence"], r["captures"]["name"]) for r in detect.detect(frags, [rule], skip="secret = 'it'").collect())
    assert got == [(2, "nono", "high", "nono"), (3, "abc", "low", "abc")]


def test_places_of_very_many_matches(spark):
    rnd = random.Random(5)
    text = "".join(rnd.choice(["ab12", "é", "\n", "x345 ", "😀", "7"]) for _ in range(30_000))
    one = spark.createDataFrame([(text,)], "t string")
    got = one.select(matching.located(F.col("t"), "[0-9]+", ["345"]).alias("s")).first()["s"]
    lines = text.split("\n")
    for r, m in zip(got, re.finditer("[0-9]+", text), strict=True):
        head = text[: m.start()]
        line = head.count("\n")
        column = len(head.rsplit("\n", 1)[-1].encode()) + 1 + (line > 0)
        assert (r["start"], r["end"], r["start_line"], r["start_column"], r["allowed"]) == (m.start(), m.end(), line, column, "345" in lines[line])


def test_decoded_secrets_are_placed_at_their_runs(spark):
    secret = "k3J8f7Qz91LmXv02RtYw"
    run = base64.b64encode(f'my_token = "{secret}"'.encode()).decode()
    frags = spark.createDataFrame([(1, f"one\ntwo {run} x", 0, "p"), (2, "plain", 0, "p")], "fragment_id long, raw string, start_line long, path string")
    assert detect.detect(frags).count() == 0
    (r,) = detect.detect(frags, max_depth=2).collect()
    assert (r["fragment_id"], r["secret"], r["start"], r["end"], r["start_line"]) == (1, secret, 8, 8 + len(run), 1) and r["tags"] == ["decoded:base64", "decode-depth:1"]
    ignore = detect.parse_ignore(spark.createDataFrame([("p:generic-api-key:1",)], "value string"))
    assert detect.detect(frags, max_depth=2, ignore=ignore).count() == 0
