"""Remotes, paths, dates and durations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts of known platforms.
PLATFORMS = {
    "github.com": "github", "gitlab.com": "gitlab", "dev.azure.com": "azure", "visualstudio.com": "azure",
    "gitea.com": "gitea", "code.forgejo.org": "gitea", "codeberg.org": "gitea", "bitbucket.org": "bitbucket",
}


def normalize_remote(raw: Column) -> Column:
    """An https form of a remote: scp-style ones are rewritten (an all-digit first part, a port, is left out), user info and .git go. Null where there is none."""
    cut = F.trim(raw)
    scp = F.regexp_extract(cut, r"^git@([A-Za-z0-9.-]+):(?:\d{1,5}/)?(.+)$", 1)
    path = F.regexp_extract(cut, r"^git@([A-Za-z0-9.-]+):(?:\d{1,5}/)?(.+)$", 2)
    url = F.when(cut.startswith("git@"), F.when(scp != "", F.concat(F.lit("https://"), scp, F.lit("/"), path))).when(cut != "", cut)
    return F.regexp_replace(F.regexp_replace(url, r"\.git$", ""), r"^([^:/]*://)[^/]*@", "$1")


def remote_host(remote: Column) -> Column:
    return F.lower(F.regexp_extract(remote, r"^[^:/]*://([^/:]+)", 1))


def platform_of(host: Column) -> Column:
    """The platform of a host; hosts that aren't known are not guessed."""
    column = F.lit("unknown")
    for name, platform in PLATFORMS.items():
        column = F.when(F.lower(host) == name, F.lit(platform)).otherwise(column)
    return column


def host_owner(remote: Column) -> Column:
    """``host/owner`` of a remote."""
    url = F.regexp_replace(F.regexp_replace(remote, r"^.*?://", ""), r"^[^@]*@", "")
    scp = F.regexp_replace(F.regexp_replace(remote, r"^[^@]*@", ""), "^([^:]*):", "$1/")
    plain = F.when(F.contains(remote, F.lit("://")), url).when(F.contains(remote, F.lit("@")), scp).otherwise(remote)
    return F.regexp_extract(plain, r"^([^/]*(?:/[^/]*)?)", 1)


def is_remote(text: Column) -> Column:
    """Has ``://``, or an @ before the first colon."""
    at, colon = F.locate("@", text), F.locate(":", text)
    return F.contains(text, F.lit("://")) | ((at > 0) & (colon > at))


def remote_allowed(remote: Column, hosts: list[str]) -> Column:
    """Its host and owner are one of ``hosts`` or below one, at a slash."""
    place = F.concat(host_owner(remote), F.lit("/"))
    allowed = F.lit(False)
    for host in hosts:
        allowed = allowed | place.startswith(host + "/")
    return allowed


def rfc3339(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def rfc1123(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def parse_commit_date(raw: Column) -> Column:
    """``Mon Jan 2 15:04:05 2006 -0700`` as RFC 3339 in UTC; null if it isn't one."""
    plain = F.regexp_replace(raw, r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) ", "")
    return F.date_format(F.try_to_timestamp(plain, F.lit("MMM d HH:mm:ss yyyy Z")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def ident_epoch(ident: Column) -> Column:
    """Seconds of a commit's author or committer line."""
    return F.regexp_extract(ident, r"\s(-?\d+) [+-]\d{4}\s*$", 1).try_cast("long")


def full_path(outer: Column, inner: Column) -> Column:
    """The path of an archive's entry."""
    return F.concat_ws("!", outer, inner)


def strip_compression(path: Column) -> Column:
    """What a compressed file is called when unpacked."""
    tars = F.regexp_replace(path, r"(?i)\.(?:tgz|tbz2?|txz)$", ".tar")
    return F.regexp_replace(tars, r"(?i)\.(?:gz|bz2|xz|zst|br|lz4)$", "")


def path_below(path: Column, prefix: str) -> Column:
    """The path is the prefix or lies below it; an empty prefix holds all."""
    p = prefix.rstrip("/")
    return F.lit(True) if not p else (path == p) | path.startswith(p + "/")


def semver(text: Column) -> Column:
    """struct<major, minor, patch>; null if the text isn't a version."""
    part = lambda i: F.regexp_extract(text, r"^v?(\d+)\.(\d+)\.(\d+)", i).try_cast("int")
    return F.when(text.rlike(r"^v?\d+\.\d+\.\d+"), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def ahead_behind(text: Column) -> Column:
    """struct<ahead, behind> of ``+a -b``."""
    number = lambda sign: F.coalesce(F.regexp_extract(text, rf"\{sign}(\d+)", 1).try_cast("long"), F.lit(0))
    return F.struct(number("+").alias("ahead"), number("-").alias("behind"))


def connection_string(text: Column) -> Column:
    """``k=v;k=v`` as a map; values may hold further equal signs, parts without one are left out, and of a repeated key the last value counts."""
    pairs = F.filter(F.split(text, ";"), lambda p: F.contains(p, F.lit("=")))
    placed = F.transform(pairs, lambda p, i: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), (-i).alias("i"), F.substr(p, F.locate("=", p) + 1, F.length(p)).alias("v")))
    ordered = F.array_sort(placed)  # the last of each key comes first
    last = F.filter(F.transform(ordered, lambda x, i: F.when((i == 0) | (F.get(ordered, i - 1)["k"] != x["k"]), F.struct(x["k"], x["v"]))), lambda x: x.isNotNull())
    return F.map_from_entries(last)


def command_text(argv_json: Column) -> Column:
    """A JSON array of arguments, joined by spaces."""
    return F.array_join(F.from_json(argv_json, "array<string>"), " ")
