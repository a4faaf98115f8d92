"""Queries over page URLs as paths and remotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from leakflow.functions import commands, filters, hashing, masking, places
from leakflow.operators import detect, rewrite
from leakflow.operators.rules import SKIPPED_PATHS, Rule, java_pattern
from leakflow.plans.registry import query, quoted, read
from leakflow.sources import settings

_SKIPPED = [*SKIPPED_PATHS, r"/de/", r"\.html$"]
_ANY = quoted("|".join(f"(?:{p})" for p in _SKIPPED))


@query("path_prefilter", f"SELECT page_id AS fragment_id, url AS path FROM pages WHERE NOT regexp_matches(url, {_ANY})")
def path_prefilter(spark, sf_dir):
    frags = read(spark, sf_dir, "pages").select(F.col("page_id").alias("fragment_id"), F.col("url").alias("path"))
    return detect.prefilter(frags, _SKIPPED)


_PATH_RULES = [Rule("html-file", path=r"(?i)(?:^|\/)[^\/]+\.html?$"), Rule("feed", path=r"utm_source=feed")]


@query("path_only_rule", " UNION ALL ".join(f"SELECT page_id AS fragment_id, url AS path, {quoted(r.rule_id)} AS rule_id, 'file detected: ' || url AS match FROM pages WHERE regexp_matches(url, {quoted(r.path)})" for r in _PATH_RULES))
def path_only_rule(spark, sf_dir):
    frags = read(spark, sf_dir, "pages").select(F.col("page_id").alias("fragment_id"), F.col("url").alias("path"))
    return detect.path_findings(frags, _PATH_RULES)


@query("redact_urls", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN replace(url, '://', '://user:***@') WHEN 1 THEN replace(url, '://', '://***@') ELSE 'Authorization: Bearer ***' END AS safe FROM pages")
def redact_urls(spark, sf_dir):
    url = lambda who: F.replace("url", F.lit("://"), F.lit(f"://{who}@"))
    text = F.when(F.col("page_id") % 3 == 0, url("user:passwd")).when(F.col("page_id") % 3 == 1, url("tok123")).otherwise(F.concat(F.lit("Authorization: Bearer "), F.col("page_id").cast("string")))
    return read(spark, sf_dir, "pages").select("page_id", masking.redact_credentials(text).alias("safe"))


@query(
    "path_filter_rename",
    """SELECT page_id, CASE WHEN starts_with(p, 'en/') OR p = 'en' OR regexp_matches(p, '^es/[0-9]+') THEN p END AS new_path
    FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '^fr/', 'en/') AS p FROM pages)""",
)
def path_filter_rename(spark, sf_dir):
    rules = rewrite.parse_path_rules(["# kept languages", "fr/==>en/", "literal:en", "regex:^es/[0-9]+"])
    path = F.regexp_replace("url", "^https?://[^/]+/", "")
    return read(spark, sf_dir, "pages").select("page_id", rewrite.new_path(path, rules).alias("new_path"))


@query("host_allowlist", "SELECT page_id, h AS host_owner, h || '/' LIKE 'tionsh.example.net/%' OR h || '/' LIKE 'www.thering.example.org/de/%' AS allowed FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]+/[^/]*)', 1) AS h FROM pages)")
def host_allowlist(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", places.host_owner(url).alias("host_owner"), places.remote_allowed(url, ["tionsh.example.net", "www.thering.example.org/de"]).alias("allowed"))


@query(
    "normalize_remote",
    """SELECT page_id, CASE page_id % 2 WHEN 0 THEN 'https://' || h || '/a/b' ELSE 'https://' || h || '/x' END AS remote, page_id % 2 = 0 AS is_remote
    FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS h FROM pages)""",
)
def normalize_remote(spark, sf_dir):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    raw = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" git@"), host, F.lit(":22/a/b.git "))).otherwise(F.concat(F.lit("https://u:p@"), host, F.lit("/x.git")))
    plain = F.when(F.col("page_id") % 2 == 0, raw).otherwise(F.lit("local/path"))
    return read(spark, sf_dir, "pages").select("page_id", places.normalize_remote(raw).alias("remote"), places.is_remote(plain).alias("is_remote"))


@query("page_platforms", "SELECT host, CASE WHEN host = 'github.com' THEN 'github' ELSE 'unknown' END AS platform, count(*)::BIGINT AS n FROM (SELECT CASE WHEN page_id % 9 = 0 THEN 'github.com' ELSE lower(regexp_extract(url, '^https?://([^/:]+)', 1)) END AS host FROM pages) GROUP BY host")
def page_platforms(spark, sf_dir):
    host = F.when(F.col("page_id") % 9 == 0, F.lit("github.com")).otherwise(places.remote_host(F.col("url")))
    return read(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("n")).select("host", places.platform_of(F.col("host")).alias("platform"), "n")


@query("skip_paths", f"SELECT page_id, regexp_matches(url, {_ANY}) AS skipped FROM pages")
def skip_paths(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", filters.matches_any(F.col("url"), [java_pattern(p) for p in _SKIPPED]).alias("skipped"))


@query("canonical_queries", "SELECT page_id, 'a=1&b=' || page_id || '&c=' || url_encode(url) AS query FROM pages")
def canonical_queries(spark, sf_dir):
    raw = F.concat(F.lit("c="), hashing.uri_encode(F.col("url")), F.lit("&&b="), F.col("page_id").cast("string"), F.lit("&a=1"))
    return read(spark, sf_dir, "pages").select("page_id", hashing.canonical_query(raw).alias("query"))


@query("valid_paths", "SELECT page_id, regexp_replace(url, '^https?:/', '') AS path, false AS rooted, NOT list_has_any(string_split(regexp_replace(url, '^https?://', ''), '/'), ['.', '..']) AS below FROM pages")
def valid_paths(spark, sf_dir):
    """A path from the root is never valid; one below is, unless a part of it is . or .."""
    rooted, below = F.regexp_replace("url", "^https?:/", ""), F.regexp_replace("url", "^https?://", "")
    return read(spark, sf_dir, "pages").select("page_id", rooted.alias("path"), rewrite.valid_path(rooted).alias("rooted"), rewrite.valid_path(below).alias("below"))


@query("connection_strings", "SELECT page_id, split_part(url, ';', 1) AS endpoint, CASE WHEN url IS NOT NULL THEN 'k' || page_id || '==' END AS key FROM pages")
def connection_strings(spark, sf_dir):
    """Urls as values of connection strings, which end at a semicolon; a key that comes twice has its last value."""
    text = F.concat(F.lit("AccountKey=old;Endpoint="), "url", F.lit(";AccountKey=k"), F.col("page_id").cast("string"), F.lit("==;Version=2"))
    parts = read(spark, sf_dir, "pages").select("page_id", places.connection_string(text).alias("m"))
    return parts.select("page_id", F.try_element_at("m", F.lit("Endpoint")).alias("endpoint"), F.try_element_at("m", F.lit("AccountKey")).alias("key"))


@query(
    "policy_files",
    """SELECT page_id, CASE WHEN missing THEN 0 ELSE page_id % 3 END::BIGINT AS version, NOT missing AND page_id % 2 = 0 AND page_id % 5 <> 0 AS applies, missing OR page_id % 4 <> 0 AS blocks,
    CASE WHEN NOT missing THEN coalesce(url, '') END AS host, CASE WHEN NOT missing THEN CASE page_id % 3 WHEN 0 THEN 5000 ELSE page_id % 3 * 100 END END::BIGINT AS millis FROM (SELECT *, page_id % 7 = 0 AS missing FROM pages)""",
)
def policy_files(spark, sf_dir):
    """A policy of each page's own, some with fields left out, some missing: whether a push is gated and refused, the allowed host, and the time of a stage."""
    k, some = F.col("page_id"), lambda when, x: F.when(when, F.lit(x)).otherwise(F.lit(""))
    text = F.concat(
        F.lit('{"version": '), (k % 3).cast("string"), F.lit(', "secretGate": {"enabled": '), (k % 2 == 0).cast("string"), some(k % 5 == 0, ', "commands": ["fetch"]'), some(k % 4 == 0, ', "mode": "warn"'),
        F.lit('}, "remoteAllowlist": {"hosts": '), F.to_json(F.array(F.coalesce("url", F.lit("")))), F.lit('}, "stages": {"pre": [{"name": "s", "timeoutMs": '), (k % 3 * 100).cast("string"), F.lit("}]}}"),
    )
    p = F.col("p")
    rows = read(spark, sf_dir, "pages").select("page_id", settings.policy(F.when(k % 7 > 0, text)).alias("p"))
    return rows.select("page_id", "p.version", settings.gate_applies(p, F.lit("push")).alias("applies"), settings.gate_blocks(p).alias("blocks"), F.get(p["remoteAllowlist"]["hosts"], F.lit(0)).alias("host"), F.get(p["stages"]["pre"], F.lit(0))["timeoutMs"].alias("millis"))


@query(
    "pinned_origins",
    """SELECT page_id, coalesce(url, '') || ' (got ' || coalesce(sha256(url), '') || ', want ' || coalesce(pin, '') || ')' AS problem
    FROM (SELECT page_id, url, CASE WHEN page_id % 17 > 0 THEN sha256(CASE WHEN page_id % 13 = 0 THEN url || '/' ELSE url END) END AS pin FROM pages) WHERE pin IS DISTINCT FROM sha256(url) OR url IS NULL""",
)
def pinned_origins(spark, sf_dir):
    """Urls with pinned digests, of which some are another url's and some are missing: those that don't hold."""
    k = F.col("page_id")
    pin = F.when(k % 17 > 0, F.sha2(F.when(k % 13 == 0, F.concat("url", F.lit("/"))).otherwise(F.col("url")), 256))
    return read(spark, sf_dir, "pages").select("page_id", hashing.pin_problem(F.col("url"), pin).alias("problem")).filter("problem is not null")


@query("padded_urls", "SELECT page_id, CASE WHEN length(url) < 60 THEN rpad(url, 60, ' ') ELSE url END AS padded, CASE WHEN length(url) > 20 THEN left(url, 19) || '…' ELSE url END AS short FROM pages")
def padded_urls(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", commands.padded(F.col("url"), 60).alias("padded"), commands.shortened(F.col("url"), 20).alias("short"))


@query("versions", "SELECT page_id, (page_id % 7)::INTEGER AS major, (page_id % 11)::INTEGER AS minor, (page_id % 13)::INTEGER AS patch FROM pages")
def versions(spark, sf_dir):
    part = lambda n: (F.col("page_id") % n).cast("string")
    v = read(spark, sf_dir, "pages").select("page_id", places.semver(F.concat(F.lit("v"), part(7), F.lit("."), part(11), F.lit("."), part(13))).alias("v"))
    return v.select("page_id", *(F.col(f"v.{c}").cast("int").alias(c) for c in ("major", "minor", "patch")))
