"""Digests, keyed digests and fingerprints, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between the fields of a chained row.
FIELD_SEPARATOR = "\x1f"


def fingerprint(path: Column, rule_id: Column, line: Column, commit: Column | None = None) -> Column:
    """``path:rule:line``, after the commit and a colon where there is one."""
    plain = F.concat_ws(":", path, rule_id, line.cast("string"))
    return plain if commit is None else F.when(F.length(commit) > 0, F.concat_ws(":", commit, plain)).otherwise(plain)


def _length_prefix(part: Column) -> Column:
    """A length as 8 bytes, the lowest first."""
    big = F.lpad(F.hex(F.octet_length(part).cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(big, 15 - 2 * i, 2) for i in range(8))))


def leak_fingerprint(rule_id: Column, path: Column, line: Column, secret: Column) -> Column:
    """The first 16 bytes, in hex, of SHA-256 over parts that each follow their length."""
    parts = [rule_id, path, line.cast("string"), secret]
    joined = F.concat(*(x for p in parts for x in (_length_prefix(p), F.encode(p, "utf-8"))))
    return F.substring(F.sha2(joined, 256), 1, 32)


def chain_hash(previous: Column, fields: list[Column]) -> Column:
    """SHA-256 in hex of the previous hash and the fields, each after a separator."""
    return F.sha2(F.concat(F.coalesce(previous, F.lit("")), *(F.concat(F.lit(FIELD_SEPARATOR), F.coalesce(f.cast("string"), F.lit(""))) for f in fields)), 256)


def _hmac(key: Column, data: Column, digest, block: int = 64) -> Column:
    """HMAC of binaries: H((k ^ opad) H((k ^ ipad) data))."""
    key_hex = F.hex(F.when(F.octet_length(key) > block, F.unhex(digest(key))).otherwise(key))
    padded = F.rpad(key_hex, 2 * block, "0")

    def mixed(pad: int) -> Column:
        bytes_ = F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda i: F.lpad(F.hex(F.conv(F.substring(padded, i * 2 + 1, F.lit(2)), 16, 10).cast("long").bitwiseXOR(F.lit(pad))), 2, "0"))
        return F.unhex(F.array_join(bytes_, ""))

    return F.unhex(digest(F.concat(mixed(0x5C), F.unhex(digest(F.concat(mixed(0x36), data))))))


def hmac_sha256(key: Column, data: Column) -> Column:
    """Raw HMAC-SHA-256 of two binary columns."""
    return _hmac(key, data, lambda x: F.sha2(x, 256))


def hmac_sha1(key: Column, data: Column) -> Column:
    """Raw HMAC-SHA-1 of two binary columns."""
    return _hmac(key, data, F.sha1)


def base64_text(data: Column) -> Column:
    """Base64 of a binary in one line: Spark's own breaks it every 76 characters."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def query_escape(text: Column) -> Column:
    """URL query escaping: letters, digits and ``-_.~`` stay, a space becomes a plus."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def uri_encode(text: Column, keep_slash: bool = False) -> Column:
    """RFC 3986 escaping."""
    plain = F.replace(query_escape(text), F.lit("+"), F.lit("%20"))
    return F.replace(plain, F.lit("%2F"), F.lit("/")) if keep_slash else plain


def canonical_query(query: Column) -> Column:
    """Parameters of a query string, sorted."""
    return F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")


def json_string(text: Column) -> Column:
    """A quoted JSON string in which <, > and & are escaped too."""
    quoted = F.to_json(F.array(text))
    inner = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
    for sign, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        inner = F.replace(inner, F.lit(sign), F.lit(code))
    return inner


def pin_problem(text: Column, pin: Column) -> Column:
    """What is wrong with a text whose SHA-256 (lower-case hex) is pinned; null if it is the pinned one. A missing text or pin is wrong."""
    got = F.sha2(text, 256)
    shown = F.concat(F.coalesce(text, F.lit("")), F.lit(" (got "), F.coalesce(got, F.lit("")), F.lit(", want "), F.coalesce(pin, F.lit("")), F.lit(")"))
    return F.when(F.coalesce(got == pin, F.lit(False)), F.lit(None)).otherwise(shown)
