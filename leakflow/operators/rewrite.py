"""History rewriting as table transforms: paths, identities, replacements and pruning."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakflow.functions.masking import DEFAULT_REPLACEMENT
from leakflow.functions.places import path_below


@dataclass(frozen=True)
class PathRule:
    """kind: prefix, glob or regex. With ``rename_to`` the match is renamed, without it the path is selected."""

    kind: str
    pattern: str
    rename_to: str | None = None


def glob_pattern(glob: str) -> str:
    """A shell pattern as a regular expression for whole paths."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            inner = glob[i + 1 : close]
            out += "[" + ("^" + inner[1:] if inner[:1] in ("!", "^") else inner).replace("\\", "\\\\") + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return rf"(?s)\A{out}\z"


def parse_path_rules(lines: list[str]) -> list[PathRule]:
    """``path``, ``glob:``, ``regex:`` and ``old==>new`` lines; # starts a comment."""
    rules = []
    for line in (x.strip() for x in lines):
        if not line or line.startswith("#"):
            continue
        body, found, new = line.rpartition("==>")
        kind, _, rest = (body if found else line).partition(":")
        kind, pattern = (kind, rest) if kind in ("literal", "glob", "regex") else ("literal", body if found else line)
        rules.append(PathRule("prefix" if kind == "literal" else kind, pattern, new if found else None))
    return rules


def parse_replacements(lines: list[str]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(literals, patterns) with their replacements, from ``literal:``, ``regex:``, ``glob:`` or bare lines; the last ``==>`` starts the replacement."""
    literals, patterns = [], []
    for line in filter(None, (x.rstrip("\r\n") for x in lines)):
        body, found, new = line.rpartition("==>")
        text, new = (body, new) if found else (line, DEFAULT_REPLACEMENT)
        kind, _, rest = text.partition(":")
        if kind == "regex":
            patterns.append((rest, new))
        elif kind == "glob":
            patterns.append((glob_pattern(rest)[6:-2], new))
        else:
            literals.append((rest if kind == "literal" else text, new))
    return literals, patterns


def _matches(path: Column, rule: PathRule) -> Column:
    if rule.kind == "prefix":
        return path_below(path, rule.pattern)
    if rule.kind == "glob":
        own = path.rlike(glob_pattern(rule.pattern))
        return own if rule.pattern.endswith("*") else own | path.rlike(glob_pattern(rule.pattern + "/*"))
    return path.rlike(rule.pattern)


def new_path(path: Column, rules: list[PathRule], inverted: bool = False) -> Column:
    """The path after all rules; null if it isn't kept. Renames apply in order and later rules see the new name; without a selecting rule all paths are kept."""
    selected = F.lit(False)
    selects = any(r.rename_to is None for r in rules)
    for r in rules:
        if r.rename_to is None:
            selected = selected | _matches(path, r)
            continue
        if r.kind == "regex":
            path = F.regexp_replace(path, r.pattern, re.sub(r"\\(\d)", r"$\1", r.rename_to))
        else:
            path = F.when(_matches(path, r), F.concat(F.lit(r.rename_to), F.substr(path, F.lit(len(r.pattern) + 1), F.length(path)))).otherwise(path)
    return F.when(F.lit(not selects) | (selected != F.lit(inverted)), path)


def valid_path(path: Column) -> Column:
    """Doesn't start at the root and has no part that is . or .."""
    return ~path.rlike(r"^/|(^|/)\.{1,2}(/|$)")


def collisions(changes: DataFrame, commit: str = "commit", path: str = "path") -> DataFrame:
    """(commit, path, n) of paths that several changes of a commit end at."""
    return changes.groupBy(commit, path).agg(F.count("*").alias("n")).filter("n > 1")


def rewrite_identity(name: Column, email: Column, match_name: str | None, match_email: str | None, new_name: str, new_email: str) -> tuple[Column, Column]:
    """(name, email), replaced where both given conditions hold."""
    hit = (name == match_name if match_name is not None else F.lit(True)) & (email == match_email if match_email is not None else F.lit(True))
    return F.when(hit, F.lit(new_name)).otherwise(name), F.when(hit, F.lit(new_email)).otherwise(email)


def prunable(commits: DataFrame, mode: str = "auto") -> DataFrame:
    """Commits (oid, n_parents, had_changes, n_changes) that a rewrite drops: never merges; ``auto`` those that became empty, ``always`` all empty ones."""
    if mode == "never":
        return commits.limit(0)
    empty = (F.col("n_changes") == 0) & (F.col("n_parents") < 2)
    return commits.filter(empty & F.col("had_changes") if mode == "auto" else empty)


def secret_rules(secrets: DataFrame, redaction: str = DEFAULT_REPLACEMENT) -> DataFrame:
    """One literal replacement for each distinct secret."""
    return secrets.filter(F.length("secret") > 0).select("secret").distinct().withColumn("replacement", F.lit(redaction))


def plan_stats(blobs: DataFrame, secrets: DataFrame) -> DataFrame:
    """(n_blobs, n_commits): blobs (oid, commit, secrets array) that hold a target value, and commits that brought them."""
    held = blobs.select("oid", "commit", F.explode("secrets").alias("secret")).join(secrets.select("secret").distinct(), "secret", "left_semi")
    return held.agg(F.count_distinct("oid").alias("n_blobs"), F.count_distinct("commit").alias("n_commits"))
