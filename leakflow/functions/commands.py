"""Command lines, status output, durations and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Global options that take the next word as their value, and commands that talk to a remote.
VALUE_OPTIONS = ["-C", "-c", "--git-dir", "--work-tree", "--namespace", "--config-env", "--super-prefix", "--attr-source"]
REMOTE_COMMANDS = ["push", "fetch", "pull", "clone", "remote", "send-pack", "http-push"]


def verb_index(argv: Column) -> Column:
    """0-based place of the first word that is neither a global option nor its value; -1 if there is none. ``--`` ends the options."""
    options = F.array(*map(F.lit, VALUE_OPTIONS))
    # a fold over the words: what the next word is, and where the verb was found
    start = F.struct(F.lit(0).alias("i"), F.lit(False).alias("value"), F.lit(False).alias("ended"), F.lit(-1).alias("at"))

    def step(acc: Column, word: Column) -> Column:
        plain = acc["ended"] | ~word.startswith("-")
        is_verb = (acc["at"] < 0) & ~acc["value"] & plain
        return F.struct(
            (acc["i"] + 1).alias("i"), (~acc["value"] & ~acc["ended"] & F.array_contains(options, word)).alias("value"),
            (acc["ended"] | (~acc["value"] & (word == "--"))).alias("ended"), F.when(is_verb, acc["i"]).otherwise(acc["at"]).alias("at"),
        )

    return F.aggregate(argv, start, step, lambda acc: acc["at"])


def verb(argv: Column) -> Column:
    """The subcommand, or null."""
    at = verb_index(argv)
    return F.when(at >= 0, F.get(argv, at))


def positionals(argv: Column) -> Column:
    """Words after the subcommand that aren't options."""
    return F.filter(F.slice(argv, verb_index(argv) + 2, F.size(argv)), lambda w: ~w.startswith("-"))


def config_overrides(argv: Column) -> Column:
    """Names, in lower case, that ``-c name=value`` words set before the subcommand."""
    ahead = F.slice(argv, F.lit(1), F.greatest(verb_index(argv), F.lit(0)))
    named = F.filter(F.transform(ahead, lambda w, i: F.when(F.get(ahead, i - 1) == "-c", F.lower(F.substring_index(w, "=", 1)))), lambda n: n.isNotNull())
    return named


def alias_injection(argv: Column) -> Column:
    """A ``-c alias.x=`` override: the first such name, or null."""
    return F.get(F.filter(config_overrides(argv), lambda n: n.startswith("alias.")), F.lit(0))


def rewrites_remote(name: Column) -> Column:
    """A setting that sends a remote elsewhere."""
    return name.rlike(r"(?i)^(url\..*\.(push)?insteadof|remote\..*\.(push)?url)$")


def remote_refs(argv: Column) -> Column:
    """Remotes that a command talks to: the first positional, and others that look like remotes."""
    from leakflow.functions.places import is_remote

    words = positionals(argv)
    first = F.slice(words, 1, 1)
    others = F.filter(F.slice(words, F.lit(2), F.size(words)), is_remote)
    return F.when(verb(argv) == "clone", first).when(verb(argv) == "remote", F.filter(words, is_remote)).when(F.coalesce(verb(argv).isin(REMOTE_COMMANDS), F.lit(False)), F.concat(first, others)).otherwise(F.array().cast("array<string>"))


def auditable(argv: Column) -> Column:
    """Worth a log row: not a bare call, nor help or version."""
    return (verb_index(argv) >= 0) & ~F.coalesce(verb(argv).isin("help", "version"), F.lit(False)) & ~F.exists(argv, lambda w: w.isin("--help", "-h", "--version"))


def kept_environment(env: Column) -> Column:
    """Variables that are logged, with credentials in them hidden."""
    from leakflow.functions.masking import redact_credentials

    return F.transform_values(F.map_filter(env, lambda k, v: k.isin("PATH", "SSH_AUTH_SOCK") | k.startswith("GIT_")), lambda k, v: redact_credentials(v))


def status_counts(text: Column) -> Column:
    """struct<branch, oid, ahead, behind, staged, unstaged, conflicts, untracked> of porcelain version 2 output."""
    from leakflow.functions.places import ahead_behind

    lines = F.split(text, "\n")
    count = lambda rx: F.size(F.filter(lines, lambda x: x.rlike(rx))).cast("long")
    ab = ahead_behind(F.regexp_extract(text, r"(?m)^# branch\.ab (.*)$", 1))
    return F.struct(
        F.regexp_extract(text, r"(?m)^# branch\.head (.*)$", 1).alias("branch"), F.regexp_extract(text, r"(?m)^# branch\.oid (.*)$", 1).alias("oid"), ab["ahead"].alias("ahead"), ab["behind"].alias("behind"),
        count(r"^[12] [^.\s]\S(?:\s|$)").alias("staged"), count(r"^[12] \S[^.\s](?:\s|$)").alias("unstaged"), count("^u ").alias("conflicts"), count(r"^\? ").alias("untracked"),
    )


def _number(value: Column, digits: int) -> Column:
    """A whole part and a fraction of ``digits`` digits without trailing zeros, from a count of the smallest unit."""
    unit = 10**digits
    tail = F.regexp_replace(F.lpad((F.pmod(value, F.lit(unit))).cast("string"), digits, "0"), "0+$", "")
    return F.concat(F.floor(value / unit).cast("string"), F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(F.lit("")))


def duration_text(nanos: Column) -> Column:
    """A duration as ``1h2m3.5s``, below a second as ``1.5ms``, ``2µs`` or ``7ns``."""
    n = F.abs(nanos)
    second = 1_000_000_000
    minutes, hours = F.floor(n / (60 * second)), F.floor(n / (3600 * second))
    rest = n - minutes * 60 * second
    long = F.concat(
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"))).otherwise(F.lit("")), F.when(minutes > 0, F.concat(F.pmod(minutes, F.lit(60)).cast("string"), F.lit("m"))).otherwise(F.lit("")), _number(rest, 9), F.lit("s"),
    )
    short = F.when(n == 0, F.lit("0s")).when(n < 1000, F.concat(n.cast("string"), F.lit("ns"))).when(n < 1_000_000, F.concat(_number(n, 3), F.lit("µs"))).otherwise(F.concat(_number(n, 6), F.lit("ms")))
    return F.concat(F.when(nanos < 0, F.lit("-")).otherwise(F.lit("")), F.when(n < second, short).otherwise(long))


def parse_duration(text: Column) -> Column:
    """Nanoseconds of ``1h2m3.5s`` and the like; null if the text isn't a duration."""
    units = {"h": 3600 * 10**9, "m": 60 * 10**9, "s": 10**9, "ms": 10**6, "us": 10**3, "µs": 10**3, "μs": 10**3, "ns": 1}
    unit = "(h|ms|m|s|us|µs|μs|ns)"
    numbers = F.regexp_extract_all(text, F.lit(r"([0-9]*\.?[0-9]+|[0-9]+\.)" + unit), F.lit(1))
    names = F.regexp_extract_all(text, F.lit(r"([0-9]*\.?[0-9]+|[0-9]+\.)" + unit), F.lit(2))
    sizes = F.create_map(*(F.lit(x) for kv in units.items() for x in kv))
    parts = F.zip_with(numbers, names, lambda a, b: (a.cast("decimal(28,9)") * F.element_at(sizes, b)).cast("decimal(38,9)"))
    total = F.aggregate(parts, F.lit(0).cast("decimal(38,9)"), lambda acc, x: (acc + x).cast("decimal(38,9)"))
    good = text.rlike(rf"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+){unit})+$")
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    return F.when(text.isin("0", "+0", "-0"), F.lit(0).cast("long")).when(good, (F.floor(total) * sign).cast("long"))


def clean_path(path: Column) -> Column:
    """A path without empty parts, ``.`` and the parts that ``..`` takes back; an empty one is ``.``."""
    rooted = path.startswith("/")

    def step(acc: Column, part: Column) -> Column:
        up = (F.size(acc) > 0) & (F.element_at(F.concat(acc, F.array(F.lit(""))), F.greatest(F.size(acc), F.lit(1))) != "..")
        return F.when(part.isin("", "."), acc).when((part == "..") & up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when((part == "..") & rooted, acc).otherwise(F.concat(acc, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    joined = F.array_join(parts, "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).otherwise(F.when(joined == "", F.lit(".")).otherwise(joined))


def quote_path(path: Column) -> Column:
    """A path that starts with a quote or holds a line feed, in quotes with escapes; others stay."""
    escaped = F.replace(F.replace(F.replace(F.replace(path, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    return F.when(path.startswith('"') | F.contains(path, F.lit("\n")), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(path)


def object_counts(text: Column) -> Column:
    """struct<loose, packed, packs> of ``name: number`` lines; what isn't told is 0."""
    told = lambda name: F.coalesce(F.regexp_extract(text, rf"(?m)^{name}: (\d+)$", 1).try_cast("long"), F.lit(0).cast("long"))
    return F.struct(told("count").alias("loose"), told("in-pack").alias("packed"), told("packs").alias("packs"))


def unreachable_count(text: Column) -> Column:
    """How many lines tell of an unreachable object."""
    return F.regexp_count(text, F.lit("(?m)^unreachable ")).cast("long")


def padded(text: Column, width: int) -> Column:
    """``text`` with spaces up to ``width`` characters, each of which counts as one column; a longer one stays."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def shortened(text: Column, width: int) -> Column:
    """At most ``width`` characters, and one at least; what is cut off becomes an ellipsis."""
    width = max(width, 1)
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width - 1)), F.lit("…"))).otherwise(text)


def short_argv(argv_json: Column, width: int) -> Column:
    """A JSON array of arguments, joined by spaces and shortened."""
    return shortened(F.array_join(F.from_json(argv_json, "array<string>"), " "), width)
