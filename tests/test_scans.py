"""Keyword automata, scans of large catalogues, cached findings, components beyond the sets that are shown, and what decoded findings keep."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from leakflow.functions import filters, secrets
from leakflow.functions.entropy import byte_entropy, report_entropy, text_byte_entropy, text_report_entropy
from leakflow.operators import detect, keywords, rules
from leakflow.operators.rules import Component, Rule
from leakflow.streaming import scans

FRAGS = "fragment_id long, raw string, start_line long, path string"


def test_automaton_is_a_plain_search():
    rnd = random.Random(1)
    for _ in range(40):
        words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(0, 30))]
        texts = ["".join(rnd.choice("abcd") for _ in range(rnd.choice([0, 1, 5, 70, 1023, 1024, 1025, 3000]))).encode() for _ in range(rnd.randint(0, 9))]
        automaton = keywords.Automaton(w.encode() for w in words)
        want = sorted((i, j + len(w), k) for i, t in enumerate(texts) for k, w in enumerate(automaton.words) for j in range(len(t)) if t.startswith(w, j))
        assert sorted(zip(*(x.tolist() for x in automaton.occurrences(texts)))) == want
        assert sorted(zip(*(x.tolist() for x in automaton.found(texts)))) == sorted({(i, k) for i, _, k in want})


def test_word_lists_beyond_one_automaton(monkeypatch):
    monkeypatch.setattr(keywords, "MOST_BYTES", 500)
    words = [f"word{i}" for i in range(50)]
    built = keywords.automata(words)
    assert len(built) > 5 and sorted(w.decode() for a in built for w in a.words) == sorted(words)


def test_keywords_of_rules_fold_and_nulls_have_none(spark):
    made = [Rule("a", "a", ("Key", "x")), Rule("b", "b", ("secret", "key")), Rule("c", "c")]
    texts = [(1, "my KEY", 0, "p"), (2, "ſecret", 0, "p"), (3, "the Key", 0, "p"), (4, None, 0, "p"), (5, "é" * 3000 + "x", 0, None), (5, "", 0, None)]
    got = sorted(map(tuple, detect.candidate_rules(spark.createDataFrame(texts, FRAGS), made).collect()))
    assert got == [(1, "a"), (1, "b"), (1, "c"), (2, "b"), (2, "c"), (3, "a"), (3, "b"), (3, "c"), (4, "c"), (5, "a"), (5, "c"), (5, "c")]
    assert detect.candidate_rules(spark.createDataFrame([], FRAGS), made).count() == 0
    many = [f"term{i}" for i in range(100)]
    one = spark.createDataFrame([("a TERM77.",), ("none",), (None,)], "t string")
    assert [r[0] for r in one.select(filters.contains_any(F.col("t"), many)).collect()] == [True, False, None]


@pytest.mark.parametrize("n", [5, 40])
def test_large_catalogues_find_what_small_ones_find(spark, monkeypatch, n):
    made = [Rule(f"r{i}", f"(?P<name>w{i})-([a-z]+)", (f"w{i}",) if i % 3 else (), path="/x$" if i % 5 == 1 else "", secret_group=2 if i % 2 else 0) for i in range(n)]
    rnd = random.Random(n)
    texts = [(i, "\n".join(f"w{rnd.randint(0, n + 1)}-ab w{rnd.randint(0, n)}-c" for _ in range(20)), 3, rnd.choice(["a/x", "y"])) for i in range(30)]
    frags = spark.createDataFrame(texts, FRAGS)
    columns = ["fragment_id", "rule_id", "start", "end", "start_line", "start_column", "secret", F.col("captures")["name"].alias("name")]
    found = []
    for limit in (1, 1000):
        monkeypatch.setattr(detect, "INLINE_RULES", limit)
        found.append(sorted(map(tuple, detect.scan(frags, made).select(*columns).collect())))
    assert found[0] == found[1] and len(found[0]) > 100


def test_decoded_findings_of_null_paths_and_repeated_fragments(spark):
    secret = "k3J8f7Qz91LmXv02RtYw"
    text = "x " + base64.b64encode(f'my_token = "{secret}"'.encode()).decode()
    frags = spark.createDataFrame([(1, text, 0, None), (2, text, 0, "p"), (3, text, 5, "q"), (3, text, 5, "q")], FRAGS)
    got = sorted((r["fragment_id"], r["path"], r["secret"], r["start"], r["start_line"]) for r in detect.detect(frags, max_depth=1).collect())
    assert got == [(1, None, secret, 2, 0), (2, "p", secret, 2, 0), (3, "q", secret, 2, 5)]


def test_duplicates_go_at_any_depth(spark):
    frags = spark.createDataFrame([(1, 'my_token = "k3J8f7Qz91LmXv02RtYw"', 0, "p")] * 2, FRAGS)
    assert detect.detect(frags).count() == detect.detect(frags, max_depth=1).count() == 1


def test_components_beyond_the_sets_that_are_shown(spark):
    numbers = Rule("number", "[0-9]+", skip_report=True)
    mail = Rule("mail", "[a-z]+@[a-z]+", components=(Component("number"),))
    text = "a@b " + " ".join(str(i) for i in range(100, 130))
    found = detect.scan(spark.createDataFrame([(1, text, 0, "p"), (2, "c@d", 0, "p")], FRAGS), [numbers, mail])
    held = detect.with_components(found, [mail], max_sets=4)
    (r,) = held.filter("rule_id = 'mail'").collect()
    assert [s[0]["secret"] for s in r["component_sets"]] == ["100", "101", "102", "103"] and r["sets_left_out"] == 26
    assert detect.suppress(held, detect.covered_parts(found, [mail])).select("rule_id").distinct().collect() == [("mail",)]
    near = Rule("mail", "", components=(Component("number", within="8C"), Component("none", optional=True)))
    (r,) = detect.with_components(found, [near], max_sets=4).filter("rule_id = 'mail'").collect()
    assert [s[0]["secret"] for s in r["component_sets"]] == ["100", "101"] and not r["sets_left_out"]


SCANNED = [Rule("t", 'tok = "([a-z0-9]+)"', ("tok",)), Rule("only-x", "xx[0-9]+", path="x$")]


def batches(spark):
    texts = ['one\ntok = "ab12"', 'tok = "cd34" xx77', "nothing", None]
    first = [(1, texts[0], 0, "a"), (2, texts[0], 10, "b"), (3, texts[2], 0, "c"), (4, texts[1], 0, "a/x"), (4, texts[1], 0, "a/x"), (9, texts[3], 0, None)]
    second = [(5, texts[0], 0, "e"), (6, texts[1], 0, "plain"), (7, texts[1], 0, None), (8, 'tok = "new9"', 2, "f/x")]
    want = [(1, "a", "t", "ab12", 1), (2, "b", "t", "ab12", 11), (4, "a/x", "t", "cd34", 0), (4, "a/x", "only-x", "xx77", 0), (4, "a/x", "t", "cd34", 0), (4, "a/x", "only-x", "xx77", 0)]
    more = [(5, "e", "t", "ab12", 1), (6, "plain", "t", "cd34", 0), (7, None, "t", "cd34", 0), (8, "f/x", "t", "new9", 2)]
    return first, second, want, more


def shown(df):
    return sorted(((r["fragment_id"], r["path"], r["rule_id"], r["secret"], r["start_line"]) for r in df.collect()), key=repr)


def test_cached_findings_are_those_of_all_paths_and_batches_run_twice(spark, tmp_path):
    first, second, want, more = batches(spark)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        assert shown(scans.scan_batch(spark.createDataFrame(first, FRAGS), 0, cache, SCANNED)) == sorted(want, key=repr)
    for _ in range(2):
        assert shown(scans.scan_batch(spark.createDataFrame(second, FRAGS), 1, cache, SCANNED)) == sorted(more, key=repr)
    version = scans.rules_version(SCANNED, skip="")
    held = scans.read_cache(spark, cache, version)
    assert held.count() == held.select("content", "path_key").distinct().count() == 6
    assert held.filter("batch = 1").count() == 2  # a text under a path that another rule reads, and a new one
    assert "ab12" not in str(held.collect())
    other = scans.scan_batch(spark.createDataFrame(second, FRAGS), 1, cache, SCANNED[:1], skip="path = 'e'")
    assert [r[0] for r in shown(other)] == [6, 7, 8]
    assert scans.scan_batch(spark.createDataFrame([], FRAGS), 2, cache, SCANNED).count() == 0


def test_streamed_scans_go_on_where_they_stopped(spark):
    first, second, want, more = batches(spark)
    rows = [(*r, 0) for r in first] + [(*r, 1) for r in second]
    frags = spark.createDataFrame(rows, FRAGS + ", part int")
    assert shown(scans.scan_in_batches(frags, "part", SCANNED)) == sorted(want + more, key=repr)


def test_catalogues_over_the_built_in_rules(spark, tmp_path):
    (tmp_path / "own.toml").write_text(
        'prefilter = "path like \'skip/%\'"\nfilter = "secret = \'zzz\'"\n[extend]\nuseDefault = true\ndisabledRules = ["jwt"]\n[[rules]]\nid = "own"\nregex = "own=([a-z ]+)"\ntokenEfficiency = true\n'
    )
    made = rules.load_config(str(tmp_path / "own.toml"))
    ids = {r.rule_id for r in made.rules}
    assert "own" in ids and "github-pat" in ids and "jwt" not in ids and made.skip == "(secret = 'zzz')" and made.skipped_paths == tuple(rules.SKIPPED_PATHS)
    frags = spark.createDataFrame([(1, "own=abc", 0, "p"), (2, "own=zzz", 0, "p"), (3, "own=abc", 0, "skip/p"), (4, "own=abc", 0, None), (5, "own=house garden", 0, "p")], FRAGS)
    kept = detect.prefilter(frags, made.skipped_paths, made.prefilter)
    assert sorted(r[0] for r in kept.select("fragment_id").collect()) == [1, 2, 4, 5]
    assert sorted(r[0] for r in detect.detect(kept, made.rules, skip=made.skip).select("fragment_id").collect()) == [1, 4, 5]
    secrets.register_token_efficiency(spark, lambda texts: [len(t) for t in texts], ["house"])
    try:
        assert sorted(r[0] for r in detect.detect(kept, made.rules, skip=made.skip).select("fragment_id").collect()) == [1, 4]
    finally:
        spark.sql("DROP TEMPORARY FUNCTION fails_token_efficiency")
    (tmp_path / "both.toml").write_text('[extend]\nuseDefault = true\npath = "own.toml"\n')
    with pytest.raises(ValueError):
        rules.load_config(str(tmp_path / "both.toml"))


def test_token_efficiency_limits(spark):
    secrets.register_token_efficiency(spark, lambda texts: [max(1, len(t) // 2) if t else 0 for t in texts], ["horse", "tree"])
    try:
        texts = ["", "x9horse1", "abcd", "abtreecd", "a\nb", "a" * 31, None]
        got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "s string").selectExpr("fails_token_efficiency(s)").collect()]
    finally:
        spark.sql("DROP TEMPORARY FUNCTION fails_token_efficiency")
    # two bytes a token: below both limits, unless a word of five letters is in it
    assert got == [False, True, False, False, False, False, False]


def test_dictionary_parts_by_automaton_and_by_join(spark, monkeypatch):
    words = spark.createDataFrame([(w,) for w in ["ability", "able", "élan", "lan", "abl", "", None]], "word string")
    tokens = spark.createDataFrame([(t,) for t in ["stability", "UnABLE", "ÉLANable", "x", "", None, "ableable"]], "token string")
    want = [("UnABLE", 2, "able"), ("ableable", 0, "able"), ("ableable", 4, "able"), ("stability", 2, "ability"), ("ÉLANable", 0, "élan"), ("ÉLANable", 4, "able")]
    assert sorted(map(tuple, secrets.dictionary_parts(words, tokens, 4).collect())) == want
    monkeypatch.setattr(secrets, "MANY_WORDS", 1)
    assert sorted(map(tuple, secrets.dictionary_parts(words, tokens, 4).collect())) == want


def test_entropies_of_long_and_short_texts_agree(spark):
    texts = ["", "a", "aaab", "déjà vu 日本", "x\n" * 5000, "".join(map(chr, range(32, 500)))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(byte_entropy(F.col("t")).alias("a"), text_byte_entropy(F.col("t")).alias("b"), report_entropy(F.col("t")).alias("c"), text_report_entropy(F.col("t")).alias("d")).collect():
        assert abs(r["a"] - r["b"]) < 1e-9 and abs(r["c"] - r["d"]) < 1e-9
