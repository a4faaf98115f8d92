"""Detection rules: a small built-in catalogue, loading of larger ones, and the pattern dialect."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from leakflow import schemas

CONFIDENCE = {"low": 0, "medium": 1, "high": 2}
DEFAULT_SPECIFICITY = 100


@dataclass(frozen=True)
class Component:
    """Another rule that must match near a rule's match. ``within``: ``5L`` lines, ``20C`` columns, or empty for anywhere in the fragment."""

    rule_id: str
    optional: bool = False
    within: str = ""


@dataclass(frozen=True)
class Rule:
    rule_id: str
    regex: str = ""
    keywords: tuple[str, ...] = ()
    description: str = ""
    path: str = ""
    secret_group: int = 0
    confidence: str = "high"
    specificity: int = DEFAULT_SPECIFICITY
    skip_report: bool = False
    filter: str = ""
    components: tuple[Component, ...] = field(default_factory=tuple)
    #: (SQL predicate, confidence): findings for which a predicate holds get that confidence.
    set_confidence: tuple[tuple[str, str], ...] = ()

    def problems(self) -> list[str]:
        """What is wrong with the rule."""
        found = []
        if not self.rule_id:
            found.append("no id")
        if not (self.regex or self.path):
            found.append("neither regex nor path")
        if self.confidence not in CONFIDENCE:
            found.append(f"confidence {self.confidence}")
        if self.regex and self.secret_group > re.compile(python_pattern(self.regex)).groups:
            found.append("secret group beyond the pattern's groups")
        if len({c.rule_id for c in self.components}) < len(self.components):
            found.append("a component twice")
        for c in self.components:
            try:
                parse_window(c.within)
            except ValueError as e:
                found.append(str(e))
        return found


#: Patterns of well-known credentials and the words that must be near them.
BUILTIN = (
    Rule("aws-access-token", r"\b((?:A3T[A-Z0-9]|AKIA|ASIA|ABIA|ACCA)[A-Z2-7]{16})\b", ("a3t", "akia", "asia", "abia", "acca"), components=(Component("aws-secret-access-key", within="5L"),), filter="byte_entropy(secret) <= 3"),
    Rule("aws-secret-access-key", r"""(?i:(?:secret|access|key|token)(?:[ \t\w.-]{0,20})[\s'"]{0,3})(?:=|>|:{1,3}=|\|\||:|=>|\?=|,)[\x60'"\s=]{0,5}([A-Za-z0-9/+=]{40})(?:\\?['"\x60]|[\s;]|\\[nr]|$)""", ("secret", "access", "key", "token"), confidence="medium", skip_report=True, filter="byte_entropy(secret) <= 4.0"),
    Rule("gcp-api-key", r"""\b(AIza[\w-]{35})(?:\\?['"\x60]|[\s;]|\\[nr]|$)""", ("aiza",), filter="byte_entropy(secret) <= 4"),
    Rule("generic-api-key", r"""(?i)(?:access|auth|(?-i:[Aa]pi|API)|credential|creds|key|passw(?:or)?d|secret|token)(?:[ \t\w.-]{0,20})[\s'"]{0,3}(?:=|>|:{1,3}=|\|\||:|=>|\?=|,)[\x60'"\s=]{0,5}([\w.=-]{10,150}|[a-z0-9][a-z0-9+/]{11,}={0,3})(?:\\?['"\x60]|[\s;]|\\[nr]|$)""", ("access", "api", "auth", "key", "credential", "creds", "passwd", "password", "secret", "token"), confidence="low", specificity=0, filter="byte_entropy(secret) <= 3.5 or secret rlike '^[a-zA-Z_.-]+$'"),
    Rule("github-pat", r"ghp_[0-9a-zA-Z]{36}", ("ghp_",), filter="byte_entropy(secret) <= 3"),
    Rule("gitlab-pat", r"glpat-[\w-]{20}", ("glpat-",), filter="byte_entropy(secret) <= 3"),
    Rule("jwt", r"""\b(ey[a-zA-Z0-9]{17,}\.ey[a-zA-Z0-9\/\\_-]{17,}\.(?:[a-zA-Z0-9\/\\_-]{10,}={0,2})?)(?:\\?['"\x60]|[\s;]|\\[nr]|$)""", ("eyj",), filter="byte_entropy(secret) <= 3.0"),
    Rule("pkcs12-file", path=r"(?i)(?:^|\/)[^\/]+\.p(?:12|fx)$"),
    Rule("private-key", r"(?i)-----BEGIN[ A-Z0-9_-]{0,100}PRIVATE KEY(?: BLOCK)?-----[\s\S-]{64,}?KEY(?: BLOCK)?-----", ("-----begin",)),
    Rule("slack-webhook-url", r"(?:https?://)?hooks.slack.com/(?:services|workflows|triggers)/[A-Za-z0-9+/]{43,56}", ("hooks.slack.com",)),
    Rule("stripe-access-token", r"""\b((?:sk|rk)_(?:test|live|prod)_[a-zA-Z0-9]{10,99})(?:\\?['"\x60]|[\s;]|\\[nr]|$)""", ("sk_test", "sk_live", "sk_prod", "rk_test", "rk_live", "rk_prod"), filter="byte_entropy(secret) <= 2"),
)

#: Secrets that are placeholders, whatever rule finds them.
PLACEHOLDERS = [
    r"(?i)^true|false|null$",
    r"^(?i:a+|b+|c+|d+|e+|f+|g+|h+|i+|j+|k+|l+|m+|n+|o+|p+|q+|r+|s+|t+|u+|v+|w+|x+|y+|z+|\*+|\.+)$",
    r"^\$(?:[A-Z_]+|[a-z_]+)$",
    r"^%(?:[A-Z_]+|[a-z_]+)%$",
    r"^@(?:[A-Z_]+|[a-z_]+)@$",
    r"^/(?:bin|etc|home|opt|tmp|usr|var)/[\w ./-]+$",
]

#: Paths that aren't read.
SKIPPED_PATHS = [
    r"(?i)\.(?:bmp|gif|jpe?g|png|svg|tiff?)$",
    r"(?i)\.(?:eot|[ot]tf|woff2?)$",
    r"(?i)\.(?:docx?|xlsx?|pdf|bin|socket|vsidx|v2|suo|wsuo|dll|pdb|exe|gltf)$",
    r"(?:^|/)node_modules(?:/.*)?$",
    r"(?:^|/)(?:deno\.lock|npm-shrinkwrap\.json|package-lock\.json|pnpm-lock\.yaml|yarn\.lock)$",
    r"(?:^|/)\.git$",
]


def java_pattern(pattern: str) -> str:
    """The pattern for Java: named groups without P and underscores, and braces that start no count escaped."""
    named = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)
    return re.sub(r"(?<!\\)\{(?!\d+(?:,\d*)?\})", r"\\{", re.sub(r"(?<=\\[pP])\{(\w+)\}", "\ue000\\1\ue001", named)).replace("\ue000", "{").replace("\ue001", "}")


def python_pattern(pattern: str) -> str:
    """The pattern for Python's re: end-of-text marks, and flags set in the middle scoped to what follows."""
    text = pattern.replace(r"\z", r"\Z")
    if (at := text.find("(?i)", 1)) > 0:
        text = f"{text[:at]}(?i:{text[at + 4 :]})" if text.count("(", at + 4) - text.count(r"\(", at + 4) == text.count(")", at + 4) - text.count(r"\)", at + 4) else "(?i)" + text.replace("(?i)", "")
    return text


def parse_window(within: str) -> tuple[str, int, int, int, int]:
    """(mode, columns before, after, lines before, after) of ``10L``, ``20C``, ``-5L,+3C`` and so on; mode is "", "cols" or "box". The match's own line counts as one."""
    columns, lines = [0, 0], [0, 0]
    seen = ""
    for part in filter(None, (p.strip() for p in within.split(","))):
        m = re.fullmatch(r"([+-]?)(\d+)([LlCc])", part)
        if not m:
            raise ValueError(f"window {within}")
        amount, sides = int(m[2]), (0, 1) if not m[1] else (0,) if m[1] == "-" else (1,)
        which = lines if m[3] in "Ll" else columns
        seen += m[3].upper()
        for side in sides:
            which[side] = max(0, amount - 1) if which is lines else amount
    return ("" if not seen else "box" if "L" in seen else "cols", *columns, *lines)


@dataclass(frozen=True)
class Catalog:
    """Rules, a SQL predicate for findings of all rules that are to be skipped, patterns of paths that aren't read, and a SQL predicate over fragments that aren't."""

    rules: tuple[Rule, ...] = ()
    skip: str = ""
    skipped_paths: tuple[str, ...] = ()
    prefilter: str = ""


#: The fields of a catalogue file.
_TOP = {"title", "description", "minVersion", "extend", "rules", "allowlist", "allowlists", "prefilter", "filter"}
_RULE = {"id", "description", "regex", "path", "secretGroup", "entropy", "tokenEfficiency", "keywords", "confidence", "specificity", "skipReport", "components", "filter", "tags", "validate", "allowlist", "allowlists", "setConfidence"}
_ALLOW = {"id", "description", "condition", "commits", "paths", "regexTarget", "regexes", "stopwords", "targetRules"}
_EXTEND = {"path", "useDefault", "disabledRules"}
#: How many files may stand below a catalogue file.
EXTEND_DEPTH = 2


def _known(what: str, table: dict, fields: set[str]) -> dict:
    if unknown := set(table) - fields:
        raise ValueError(f"{what}: unknown fields {sorted(unknown)}")
    return table


def _sql(texts: list[str]) -> str:
    """A SQL array of texts."""
    return "array(" + ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in texts) + ")"


def _tables(owner: dict) -> list[dict]:
    return [*owner.get("allowlists", []), *([owner["allowlist"]] if "allowlist" in owner else [])]


def allowlist_predicate(what: str, table: dict) -> str:
    """An allowlist as a SQL predicate over a finding: any of its parts holds, or all of them with the condition AND."""
    _known(f"allowlist of {what}", table, _ALLOW)
    target = table.get("regexTarget", "secret") or "secret"
    if target not in ("secret", "match"):
        raise ValueError(f"allowlist of {what}: target {target}")
    parts = []
    if commits := table.get("commits"):
        parts.append(f"array_contains({_sql([c.lower() for c in commits])}, lower(commit))")
    if paths := table.get("paths"):
        parts.append(f"matches_any(path, {_sql([java_pattern(p) for p in paths])})")
    if regexes := table.get("regexes"):
        parts.append(f"matches_any({target}, {_sql([java_pattern(p) for p in regexes])})")
    if words := table.get("stopwords"):
        parts.append(f"contains_any(secret, {_sql(words)})")
    if not parts:
        raise ValueError(f"allowlist of {what} is empty")
    both = table.get("condition", "OR").upper() in ("AND", "&&")
    made = (" and " if both else " or ").join(parts)
    return f"array_contains({_sql(table['targetRules'])}, rule_id) and ({made})" if table.get("targetRules") else made


def _rule(r: dict) -> Rule:
    name = r.get("id", "")
    _known(f"rule {name}", r, _RULE)
    filters = [f for f in (r.get("filter", ""), f"byte_entropy(secret) <= {r['entropy']}" if "entropy" in r else "", "fails_token_efficiency(secret)" if r.get("tokenEfficiency") else "", *(allowlist_predicate(name, t) for t in _tables(r))) if f]
    return Rule(
        name, r.get("regex", ""), tuple(k.lower() for k in r.get("keywords", [])), r.get("description", ""), r.get("path", ""), r.get("secretGroup", 0), r.get("confidence", "high"),
        r.get("specificity", DEFAULT_SPECIFICITY), r.get("skipReport", False), " or ".join(f"({f})" for f in filters), tuple(Component(c["id"], c.get("optional", False), c.get("within", "")) for c in r.get("components", [])),
        tuple((c["when"], c["value"]) for c in r.get("setConfidence", [])),
    )


def _either(*predicates: str) -> str:
    return " or ".join(f"({p})" for p in predicates if p)


def load_config(path: str, depth: int = 0) -> Catalog:
    """A TOML catalogue file with its allowlists as SQL predicates, over the file that it extends.

    Filters are Spark SQL predicates over the columns of a finding.
    ``extend.path`` is relative to the file; what stands below is overlaid:
    rules of equal id are replaced, ``disabledRules`` go, predicates and paths
    are added. ``extend.useDefault`` puts the built-in rules below. The
    top-level ``filter`` skips findings of all rules, ``prefilter`` fragments,
    of which it sees the columns. A global allowlist of nothing but paths also
    keeps the paths from being read. ``tokenEfficiency`` needs a tokenizer
    (see ``secrets.register_token_efficiency``). Unknown fields, and more than EXTEND_DEPTH files below,
    raise ValueError.
    """
    with open(path, "rb") as f:
        raw = _known(path, tomllib.load(f), _TOP)
    base = Catalog()
    below = _known("extend", raw.get("extend", {}), _EXTEND)
    if below.get("useDefault"):
        base = Catalog(BUILTIN, "", tuple(SKIPPED_PATHS))
    if "path" in below:
        if base.rules:
            raise ValueError(f"{path}: both useDefault and a path")
        if depth >= EXTEND_DEPTH:
            raise ValueError(f"{path}: more than {EXTEND_DEPTH} files below")
        base = load_config(os.path.join(os.path.dirname(path), below["path"]), depth + 1)
    tables = _tables(raw)
    only_paths = [t for t in tables if set(t) - {"id", "description", "condition"} == {"paths"}]
    skips = [base.skip, raw.get("filter", ""), *(allowlist_predicate("all", t) for t in tables)]
    rules = extend(list(base.rules), [_rule(r) for r in raw.get("rules", [])], set(below.get("disabledRules", [])))
    return Catalog(tuple(rules), _either(*skips), (*base.skipped_paths, *(p for t in only_paths for p in t["paths"])), _either(base.prefilter, raw.get("prefilter", "")))


def load_catalog(path: str) -> list[Rule]:
    """The rules of ``load_config``."""
    return list(load_config(path).rules)


def extend(base: list[Rule], local: list[Rule], disabled: set[str] = frozenset()) -> list[Rule]:
    """A catalogue over another: its rules replace those of equal id, disabled ones go."""
    by_id = {r.rule_id: r for r in base} | {r.rule_id: r for r in local}
    return [r for r in by_id.values() if r.rule_id not in disabled]


def rules_frame(spark: SparkSession, rules: list[Rule] | tuple[Rule, ...] = BUILTIN) -> DataFrame:
    """The catalogue as a table, most specific rules first."""
    rows = [
        (r.rule_id, r.description, java_pattern(r.regex), java_pattern(r.path), r.secret_group, list(r.keywords), r.confidence, r.specificity, r.skip_report, r.filter, [(c.rule_id, c.optional, c.within) for c in r.components])
        for r in sorted(rules, key=lambda r: -r.specificity)
    ]
    return spark.createDataFrame(rows, schemas.RULE)
