"""Scalar functions on fixed vectors."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from leakflow.functions import entropy, filters, hashing, masking, places


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("", 0.0), ("aaaa", 0.0), ("ab", 1.0), ("abcd", 2.0), ("aabb", 1.0), ("é", 1.0)])
def test_byte_entropy(spark, text, want):
    assert abs(value(spark, entropy.byte_entropy(F.lit(text))) - want) < 1e-12


def test_report_entropy_counts_characters_over_bytes(spark):
    assert value(spark, entropy.report_entropy(F.lit("abcd"))) == 2.0
    assert abs(value(spark, entropy.report_entropy(F.lit("é"))) - 0.5) < 1e-12


@pytest.mark.parametrize("percent,want", [(0, "abcdefghij..."), (25, "abcdefgh..."), (75, "ab..."), (100, "..."), (300, "...")])
def test_mask_percent_rounds_half_to_even(spark, percent, want):
    assert value(spark, masking.mask_percent(F.lit("abcdefghij"), percent)) == want


def test_masks(spark):
    assert value(spark, masking.mask_first4(F.lit("abcdef"))) == "abcd**"
    assert value(spark, masking.mask_first4(F.lit("ab"))) == "ab"
    assert [value(spark, masking.mask_gate(F.lit(x))) for x in ("", "abc", "abcdefghijkl")] == ["<redacted>", "***", "abcd******"]
    assert value(spark, masking.mask_counted(F.lit("abcdef"))) == "abcd… (6 chars)"
    assert value(spark, masking.redact_finding(F.lit("key=abcd"), F.lit("abcd"), 100)) == "key=REDACTED"


@pytest.mark.parametrize(
    "text,want",
    [("https://u:p@h/x", "https://u:***@h/x"), ("https://tok@h/x", "https://***@h/x"), ("Authorization: Bearer abc", "Authorization: Bearer ***"), ("https://h/x", "https://h/x"), ("a https://u:p:q@h b ssh://t@k", "a https://u:***@h b ssh://***@k")],
)
def test_redact_credentials(spark, text, want):
    assert value(spark, masking.redact_credentials(F.lit(text))) == want


def test_redaction_is_stable(spark):
    once = masking.redact_credentials(F.lit("x https://u:p@h/y Authorization: Basic q"))
    assert value(spark, once) == value(spark, masking.redact_credentials(once))


def test_replacements_are_literal(spark):
    got = masking.replace_text(F.lit("a1b22"), [("a", "$1")], [("[0-9]+", "$0\\")])
    assert value(spark, got) == "$$0\\b$0\\"


def test_digests(spark):
    key, data = b"k" * 70, b"payload"
    for mine, name in ((hashing.hmac_sha256, "sha256"), (hashing.hmac_sha1, "sha1")):
        for k in (key, b"short"):
            assert bytes(value(spark, mine(F.lit(bytearray(k)), F.lit(bytearray(data))))) == hmac.new(k, data, name).digest()
    parts = ["rule", "p/é", "12", "s"]
    want = hashlib.sha256(b"".join(len(p.encode()).to_bytes(8, "little") + p.encode() for p in parts)).hexdigest()[:32]
    assert value(spark, hashing.leak_fingerprint(*map(F.lit, ("rule", "p/é", 12, "s")))) == want
    assert value(spark, hashing.chain_hash(F.lit("ab"), [F.lit("x"), F.lit(None).cast("string"), F.lit(3)])) == hashlib.sha256(b"ab\x1fx\x1f\x1f3").hexdigest()


def test_escapes(spark):
    assert value(spark, hashing.query_escape(F.lit("a b~*/é"))) == "a+b~%2A%2F%C3%A9"
    assert value(spark, hashing.uri_encode(F.lit("a b/c"), keep_slash=True)) == "a%20b/c"
    assert value(spark, hashing.canonical_query(F.lit("b=2&a=1&&c"))) == "a=1&b=2&c"
    assert value(spark, hashing.json_string(F.lit('a"<b>&'))) == '"a\\"\\u003cb\\u003e\\u0026"'


@pytest.mark.parametrize(
    "raw,want",
    [("git@h.x:o/r.git", "https://h.x/o/r"), ("git@h.x:22/o/r", "https://h.x/o/r"), ("https://u:p@h/o/r.git", "https://h/o/r"), ("  ", None), ("git@h_x:o", None), ("https://h/o", "https://h/o")],
)
def test_normalize_remote(spark, raw, want):
    assert value(spark, places.normalize_remote(F.lit(raw))) == want


def test_remotes(spark):
    assert value(spark, places.host_owner(F.lit("https://u@h/o/r/x"))) == "h/o"
    assert value(spark, places.host_owner(F.lit("git@h:o/r"))) == "h/o"
    assert value(spark, places.remote_allowed(F.lit("https://h/ox/r"), ["h/o"])) is False
    assert value(spark, places.remote_allowed(F.lit("https://h/o/r"), ["h/o"])) is True
    assert [value(spark, places.is_remote(F.lit(x))) for x in ("git@h:o", "a:b@c", "x://y", "plain")] == [True, False, True, False]
    assert value(spark, places.platform_of(F.lit("Codeberg.org"))) == "gitea"


def test_dates(spark):
    assert value(spark, places.parse_commit_date(F.lit("Mon Jan 2 15:04:05 2006 -0700"))) == "2006-01-02T22:04:05Z"
    assert value(spark, places.parse_commit_date(F.lit("yesterday"))) is None
    assert value(spark, places.ident_epoch(F.lit("A B <a@b> 1136239445 -0700"))) == 1136239445
    assert value(spark, places.rfc1123(F.lit(1136239445))) == "Mon, 02 Jan 2006 22:04:05 GMT"


def test_small_parsers(spark):
    assert value(spark, places.strip_compression(F.lit("a/b.tgz"))) == "a/b.tar"
    assert value(spark, places.semver(F.lit("v1.20.3-rc1"))) == (1, 20, 3)
    assert value(spark, places.semver(F.lit("x"))) is None
    assert value(spark, places.ahead_behind(F.lit("+3 -12"))) == (3, 12)
    assert value(spark, places.connection_string(F.lit("A=1;B=x=y;;C"))) == {"A": "1", "B": "x=y"}
    assert value(spark, places.command_text(F.lit('["git","push"]'))) == "git push"


def test_filters(spark):
    s = F.lit("Hello World hello")
    assert value(spark, filters.contains_any(s, ["WORLD"])) is True and value(spark, filters.contains_any(s, [])) is False
    assert value(spark, filters.matches_any(s, ["^x", "W.r"])) is True and value(spark, filters.matches_any(s, [])) is False
    assert value(spark, filters.last_index_of(F.lit("é.a.b"), ".")) == 4 and value(spark, filters.last_index_of(s, "zz")) == -1
    assert value(spark, filters.byte_slice(F.lit("abcdef"), F.lit(-3), F.lit(2))) == "ab" and value(spark, filters.byte_slice(F.lit("abc"), F.lit(2), F.lit(99))) == "c"
    assert value(spark, filters.equal_or_missing(F.lit(None).cast("string"), F.lit(""))) is True
    filters.register_sql(spark)
    assert spark.sql("select byte_entropy('abcd'), contains_any('xAb', array('B')), matches_any('ab', array('^b', 'b$')), find_match('ab12', '[0-9]+')").first()[:] == (2.0, True, True, "12")
