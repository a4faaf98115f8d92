"""Detection and what follows it: candidate rules by keyword, matches, filters, components, suppression and ignore lists.

Everything is DataFrame operations. A fragment meets only rules of which it
holds a keyword; the rules are a small literal array, so no join is needed.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakflow.functions import filters, hashing
from leakflow.functions.entropy import report_entropy
from leakflow.operators import decode, keywords, matching
from leakflow.operators.rules import BUILTIN, CONFIDENCE, PLACEHOLDERS, Component, Rule, java_pattern, parse_window, python_pattern
from leakflow.session import staged

KEYS = ["fragment_id", "rule_id", "start", "end"]


def fragments(table: DataFrame, fragment_id: str, raw: str, path: Column | None = None, start_line: int = 0) -> DataFrame:
    """A table's texts as fragments (fragment_id, raw, start_line, path)."""
    return table.select(F.col(fragment_id).cast("long").alias("fragment_id"), F.coalesce(F.col(raw), F.lit("")).alias("raw"), F.lit(start_line).cast("long").alias("start_line"), (path if path is not None else F.lit("")).alias("path"))


def prefilter(frags: DataFrame, skipped_paths: list[str] | tuple[str, ...], skip: str = "") -> DataFrame:
    """Fragments whose path isn't skipped, and for which the SQL predicate ``skip`` isn't true; a null path or predicate keeps."""
    unwanted = filters.matches_any(F.col("path"), [java_pattern(p) for p in skipped_paths])
    if skip:
        filters.register_sql(frags.sparkSession)
        unwanted = unwanted | F.expr(f"({skip})")
    return frags.filter(filters.skip_if(unwanted))


def _by_word(rules: list[Rule]) -> dict[str, list[int]]:
    """Of each keyword, the numbers of the rules that have it."""
    by: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        for k in r.keywords:
            by.setdefault(k, []).append(i)
    return by


def candidate_rules(frags: DataFrame, rules: list[Rule]) -> DataFrame:
    """(fragment_id, rule_id): rules that have a keyword in the fragment, in whatever ASCII case, or no keyword at all.

    One pass over a text, however many keywords there are (see ``keywords``).
    """
    by = _by_word(rules)
    told = keywords.with_words(frags.select("fragment_id", "raw"), "raw", by, by, [i for i, r in enumerate(rules) if not r.keywords])
    ids = F.array(*(F.lit(r.rule_id) for r in rules)) if rules else F.array().cast("array<string>")
    return told.select("fragment_id", F.explode("numbers_").alias("n_")).select("fragment_id", F.get(ids, F.col("n_")).alias("rule_id"))


#: For catalogues of up to so many rules each keyword is a test of its own in the plan; for larger ones an automaton finds all keywords in one pass.
INLINE_RULES = 32


def _group_count(pattern: str) -> int:
    return re.compile(python_pattern(pattern)).groups


def _named(match: Column, pattern: str) -> Column:
    """The named groups of a match that aren't empty, as a map."""
    groups = re.compile(python_pattern(pattern)).groupindex
    pairs = F.array(*(F.struct(F.lit(name).alias("key"), F.regexp_extract(match, java_pattern(pattern), g).alias("value")) for name, g in groups.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"] != ""))


def _wanted(low: Column, rule: Rule) -> Column:
    """The text holds a keyword of the rule, or the rule has none."""
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(k.lower())) for k in rule.keywords), F.lit(not rule.keywords))


def _numbered(frags: DataFrame, rules: list[Rule]) -> DataFrame:
    """``frags`` with ``number_``, a row for each rule of which the text holds a keyword."""
    if len(rules) > INLINE_RULES:
        by = _by_word(rules)
        return keywords.with_words(frags, "raw", by, by, [i for i, r in enumerate(rules) if not r.keywords]).withColumn("number_", F.explode("numbers_")).drop("numbers_")
    low = frags.withColumn("low_", F.replace(F.lower("raw"), F.lit("\u017f"), F.lit("s")))
    hits = [F.when(_wanted(F.col("low_"), r), F.lit(i)) for i, r in enumerate(rules)]
    return low.withColumn("number_", F.explode(F.array_compact(F.array(*hits)))).drop("low_")


def _matches(frags: DataFrame, rules: list[Rule], how: dict) -> DataFrame:
    """A row for each match: fragments meet the rules that they have a keyword of. Patterns are literals of the plan, so none is compiled again from row to row; what is known of a rule is looked up by its number."""
    known = [F.struct(*(F.lit(v).alias(n) for n, v in (("rule_id", r.rule_id), ("secret_group", r.secret_group), ("groups", _group_count(r.regex)), ("specificity", r.specificity), ("confidence", r.confidence), ("skip_report", r.skip_report)))) for r in rules]
    number, raw = F.col("number_"), F.col("raw")
    here = _numbered(frags, rules)
    if any(r.path for r in rules):
        here = here.filter(matching.Patterns(number, [java_pattern(r.path) for r in rules]).of(lambda p: F.rlike("path", F.lit(p)) if p else F.lit(True)))
    patterns = matching.Patterns(number, [java_pattern(r.regex) for r in rules])
    found = here.withColumn("whole_", patterns.of(lambda p: F.regexp_extract_all(raw, F.lit(p), F.lit(0)))).filter(F.size("whole_") > 0)
    found = found.withColumn("pieces_", patterns.of(lambda p: F.split(raw, p, -1)))
    found = found.withColumn("s", F.explode(matching.located(raw, None, whole=F.col("whole_"), pieces=F.col("pieces_"), **how))).drop("raw", "whole_", "pieces_").select("*", "s.*").drop("s")
    found = found.withColumn("rule_", F.get(F.array(*known), number)).select("*", "rule_.*").drop("rule_")
    group = lambda g: patterns.of(lambda p: F.call_function("regexp_extract", F.col("match"), F.lit(p), g))
    tried = F.when(F.col("secret_group") > 0, F.array("secret_group")).otherwise(F.filter(F.sequence(F.lit(0), F.col("groups")), lambda g: g > 0))
    secret = F.coalesce(F.get(F.filter(F.transform(tried, group), lambda x: (x != "") | (F.col("secret_group") > 0)), F.lit(0)), F.col("match"))
    captures = F.create_map().cast("map<string,string>")
    for i, r in enumerate(rules):
        if re.compile(python_pattern(r.regex)).groupindex:
            captures = F.when(number == i, _named(F.col("match"), r.regex)).otherwise(captures)
    return found.withColumn("secret", secret).withColumn("captures", captures)


def scan(frags: DataFrame, rules: list[Rule] | tuple[Rule, ...] = BUILTIN, markers: list[str] | None = None, with_context: int = 0, keep: tuple[str, ...] = (), with_line: bool = False) -> DataFrame:
    """Findings before filters: one row for each match of each candidate rule, with the ``keep`` columns of its fragment.

    Only rules of which the text holds a keyword are tried, and only matches
    leave the row. A match's secret is found by matching the rule again
    within the match; ``captures`` are its named groups. Lines that carry an
    allow marker yield nothing. ``line`` is there if asked for, since it may
    be much longer than the match.
    """
    rules = [r for r in rules if r.regex]
    if not rules:  # nothing can match, but the columns are the same
        return scan(frags.filter("false"), [Rule("none", "a")], markers, with_context, keep, with_line)
    how = {"markers": [matching.ALLOW_MARKER] if markers is None else markers, "with_line": with_line, "context": with_context}
    renamed = frags.withColumnRenamed("start_line", "first_line")
    found = _matches(renamed, rules, how).filter(~F.col("allowed"))
    placed = lambda c: (F.col("first_line") + F.col(c)).alias(c)
    long = lambda c: F.col(c).cast("long").alias(c)
    return found.select(
        "fragment_id", "path", "rule_id", placed("start_line"), placed("end_line"), *map(long, ("start_column", "end_column", "start", "end")), "match", "secret", "captures",
        report_entropy(F.col("secret")).alias("entropy"), "specificity", "confidence", "skip_report", *(["line"] if with_line else []), *(["context"] if with_context else []), *keep,
    )


def path_findings(frags: DataFrame, rules: list[Rule] | tuple[Rule, ...] = BUILTIN) -> DataFrame:
    """Findings of rules that have a path and no pattern: one for each fragment whose path matches."""
    hits = [F.when(F.col("path").rlike(java_pattern(r.path)), F.lit(r.rule_id)) for r in rules if r.path and not r.regex]
    return frags.select("fragment_id", "path", F.explode(F.array_compact(F.array(*hits))).alias("rule_id")).withColumn("match", F.concat(F.lit("file detected: "), F.col("path")))


def apply_filters(findings: DataFrame, rules: list[Rule] | tuple[Rule, ...] = BUILTIN, placeholders: list[str] = PLACEHOLDERS, skip: str = "") -> DataFrame:
    """Findings that no filter drops: placeholders go for all rules, ``skip`` is a SQL predicate for all, and each rule's own says what to skip. A predicate that is null keeps.

    A rule's ``set_confidence`` pairs then change the confidence of what stays: the last predicate that holds counts.
    """
    filters.register_sql(findings.sparkSession)
    unwanted, value = skip, F.col("confidence")
    skip = filters.matches_any(F.col("secret"), [java_pattern(p) for p in placeholders])
    for r in rules:
        if r.filter:
            skip = skip | ((F.col("rule_id") == r.rule_id) & F.coalesce(F.expr(f"({r.filter})"), F.lit(False)))
    if unwanted:
        skip = skip | F.coalesce(F.expr(f"({unwanted})"), F.lit(False))
    for r in rules:
        for when, confidence in r.set_confidence:
            value = F.when((F.col("rule_id") == r.rule_id) & F.expr(f"({when})"), F.lit(confidence)).otherwise(value)
    return findings.filter(filters.skip_if(skip)).withColumn("confidence", value)


def confident(findings: DataFrame, least: str) -> DataFrame:
    """Findings of at least a confidence; ones of unknown confidence pass."""
    rank = F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv))
    return findings.filter(F.coalesce(F.try_element_at(rank, F.lower("confidence")) >= CONFIDENCE[least], F.lit(True)))


def near(p: str, c: str, within: str) -> Column:
    """Component ``c`` lies in the window of primary ``p``, both with lines and columns of one fragment."""
    mode, before, after, above, below = parse_window(within)
    if not mode:
        return F.lit(True)
    col = lambda x, y: F.col(f"{x}.{y}")
    if mode == "cols":
        return (col(c, "start") >= F.greatest(col(p, "start") - before, F.lit(0))) & (col(c, "start") < col(p, "end") + after)
    held = (col(c, "start_line") >= col(p, "start_line") - above) & (col(c, "start_line") <= col(p, "end_line") + below)
    if before or after:
        inside = (col(c, "start_column") - 1 >= F.greatest(col(p, "start_column") - 1 - before, F.lit(0))) & (col(c, "start_column") - 1 < col(p, "end_column") + after)
        held = held & (inside | (col(p, "start_line") != col(p, "end_line")))
    return held


COMPONENT = "struct<rule_id:string,start_line:bigint,start:bigint,secret:string>"


def _component(name: str) -> Column:
    return F.struct(*(F.col(f"{name}.{c}").alias(c) for c in ("rule_id", "start_line", "start", "secret"))).cast(COMPONENT)


def component_pairs(findings: DataFrame, rule_id: str, component: Component) -> DataFrame:
    """Findings of a rule with those of one component in its window: a join on the fragment with a range condition."""
    p, c = findings.filter(F.col("rule_id") == rule_id).alias("p"), findings.filter(F.col("rule_id") == component.rule_id).alias("c")
    joined = p.join(c, (F.col("p.fragment_id") == F.col("c.fragment_id")) & near("p", "c", component.within))
    return joined.select(*(F.col(f"p.{k}").alias(k) for k in KEYS), _component("c").alias("component"))


def _first_parts(findings: DataFrame, rule: Rule, component: Component, most: int) -> tuple[DataFrame, list[str]]:
    """(keys, part, n): the first ``most`` matches of a component, by place, and how many there are; for each primary, or for each fragment where the component has no window, so that nothing is paired with everything."""
    if parse_window(component.within)[0]:
        pairs, keys = component_pairs(findings, rule.rule_id, component), KEYS
    else:
        own = findings.filter(F.col("rule_id") == component.rule_id).alias("c")
        pairs, keys = own.select("fragment_id", _component("c").alias("component")), ["fragment_id"]
    order = Window.partitionBy(*keys).orderBy("component.start", "component.secret")
    ranked = pairs.withColumn("at_", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(*keys))).filter(F.col("at_") <= most)
    lists = ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at_", "component"))), lambda x: x["component"]).alias("part"), F.first("n").alias("n"))
    return lists, keys


def _primaries(findings: DataFrame, rule: Rule) -> DataFrame:
    """Findings of a composite rule that have all components they need."""
    own = findings.filter(F.col("rule_id") == rule.rule_id)
    for c in rule.components:
        if c.optional:
            continue
        if parse_window(c.within)[0]:
            own = own.join(component_pairs(findings, rule.rule_id, c).select(*KEYS).distinct(), KEYS, "left_semi")
        else:
            own = own.join(findings.filter(F.col("rule_id") == c.rule_id).select("fragment_id"), "fragment_id", "left_semi")
    return own


def with_components(findings: DataFrame, rules: list[Rule] | tuple[Rule, ...] = BUILTIN, max_sets: int = 100) -> DataFrame:
    """Findings with ``component_sets``: for composite rules the choices of one match per component, the first ``max_sets`` of them by place; ``sets_left_out`` says how many more there are. Primaries that lack a required component go.

    Component-only findings stay until ``report`` drops them.
    """
    composite = [r for r in rules if r.components]
    plain = findings.filter(~F.col("rule_id").isin([r.rule_id for r in composite])) if composite else findings
    out = plain.withColumn("component_sets", F.array().cast(f"array<array<{COMPONENT}>>")).withColumn("sets_left_out", F.lit(0).cast("long"))
    for r in composite:
        own = findings.filter(F.col("rule_id") == r.rule_id)
        for i, c in enumerate(r.components):
            lists, keys = _first_parts(findings, r, c, max_sets)
            own = own.join(lists.withColumnsRenamed({"part": f"part{i}", "n": f"n{i}"}), keys, "left" if c.optional else "inner")
        sets = F.array(F.array().cast(f"array<{COMPONENT}>"))
        total = F.lit(1).cast("long")
        for i in range(len(r.components)):
            part = F.col(f"part{i}")
            grown = F.flatten(F.transform(sets, _each_with(part)))
            sets = F.when(F.coalesce(F.size(part), F.lit(0)) > 0, F.slice(grown, 1, max_sets)).otherwise(sets)
            total = F.try_multiply(total, F.coalesce(f"n{i}", F.lit(1)))
        sets = F.filter(sets, lambda s: F.size(s) > 0)
        made = own.withColumn("component_sets", sets).withColumn("sets_left_out", F.when(F.size(sets) > 0, total - F.size(sets)).otherwise(0))
        out = out.unionByName(made.drop(*(f"{x}{i}" for i in range(len(r.components)) for x in ("part", "n"))))
    return out


def _each_with(part: Column):
    return lambda chosen: F.transform(part, lambda x: F.concat(chosen, F.array(x)))


def covered_parts(findings: DataFrame, rules: list[Rule] | tuple[Rule, ...] = BUILTIN) -> DataFrame | None:
    """(fragment_id, start_line, secret) of all matches that are components of a composite finding, however many sets they make; None without composite rules."""
    found = []
    for r in (r for r in rules if r.components):
        primaries = _primaries(findings, r)
        for c in r.components:
            parts = findings.filter(F.col("rule_id") == c.rule_id)
            if parse_window(c.within)[0]:
                pairs = component_pairs(primaries.unionByName(parts), r.rule_id, c)
                found.append(pairs.select("fragment_id", F.col("component.start_line").alias("start_line"), F.col("component.secret").alias("secret")))
            else:
                found.append(parts.join(primaries.select("fragment_id"), "fragment_id", "left_semi").select("fragment_id", "start_line", "secret"))
    return reduce(DataFrame.unionByName, found).distinct() if found else None


def suppress(findings: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """Findings whose secret isn't part of a more specific finding's on the same line, nor one of the ``covered`` parts of composite findings.

    Both tests look at all findings, also at ones that go themselves.
    """
    f, o = findings.alias("f"), findings.select("fragment_id", "start_line", "rule_id", "secret", "specificity").alias("o")
    same = (F.col("f.fragment_id") == F.col("o.fragment_id")) & (F.col("f.start_line") == F.col("o.start_line"))
    above = (F.col("f.rule_id") != F.col("o.rule_id")) & (F.col("o.specificity") > F.col("f.specificity")) & F.contains(F.col("o.secret"), F.col("f.secret"))
    kept = f.join(o, same & above, "left_anti")
    return kept if covered is None else kept.join(covered, ["fragment_id", "start_line", "secret"], "left_anti")


def report(findings: DataFrame) -> DataFrame:
    """Findings of rules that report, with their fingerprint."""
    return findings.filter(~F.col("skip_report")).withColumn("fingerprint", hashing.fingerprint(F.col("path"), F.col("rule_id"), F.col("start_line")))


def _decoded(frags: DataFrame, rules: list[Rule] | tuple[Rule, ...], markers: list[str] | None, max_depth: int) -> DataFrame:
    """Findings inside decoded runs, placed where the runs are in the fragment, with their tags. Matches outside of runs belong to earlier passes.

    The fragment's own text goes along until the matches are placed, so no
    join has to find it again: null paths and repeated ids are as good as any.
    """
    carried = frags.withColumn("first_line_", F.col("start_line")).withColumn("text_", F.col("raw"))
    passes = decode.decode_fragments(carried, max_depth, keep=("path", "first_line_", "text_")).withColumn("start_line", F.col("first_line_"))
    hits = scan(passes, rules, markers, keep=("segments", "first_line_", "text_"))
    hits = hits.withColumn("on_", decode.overlapping(F.col("segments"), F.col("start"), F.col("end"))).filter(F.size("on_") > 0)
    hits = hits.withColumn("start", F.array_min(F.transform("on_", lambda x: x["orig_start"])).cast("long")).withColumn("end", F.array_max(F.transform("on_", lambda x: x["orig_end"])).cast("long"))
    placed = hits.withColumn("tags", decode.decode_tags(F.col("on_"))).drop("on_", "segments")
    start, end, raw = F.col("start").cast("int"), F.col("end").cast("int"), F.col("text_")
    return (
        placed.withColumn("start_line", F.col("first_line_") + matching.start_line(raw, start)).withColumn("end_line", F.col("first_line_") + matching.end_line(raw, end))
        .withColumn("start_column", matching.start_column(raw, start).cast("long")).withColumn("end_column", matching.end_column(raw, end).cast("long")).drop("text_", "first_line_")
    )


#: What makes findings of one fragment the same.
SAME = ["fragment_id", "path", "rule_id", "secret", "start_line"]


def detect(
    frags: DataFrame, rules: list[Rule] | tuple[Rule, ...] = BUILTIN, least_confidence: str = "low", max_depth: int = 0, ignore: DataFrame | None = None, baseline: DataFrame | None = None,
    baseline_fields: tuple[str, ...] = ("rule_id", "path", "start_line", "secret"), markers: list[str] | None = None, skip: str = "",
) -> DataFrame:
    """The whole chain: scan, decode and scan again up to ``max_depth`` times, filter, confidence, components, suppression, report; then duplicates, ignored and known findings go.

    ``skip`` is a further SQL predicate for all rules. ``tags`` say how a
    finding was decoded. What passes the filters is written to the shared
    folder once, so the texts are scanned once however often the findings are
    joined with each other.
    """
    found = scan(frags, rules, markers).withColumn("tags", F.array().cast("array<string>"))
    if max_depth:
        found = found.unionByName(_decoded(frags, rules, markers, max_depth))
    found = staged(confident(apply_filters(found, rules, skip=skip), least_confidence), "findings")
    shown = report(suppress(with_components(found, rules), covered_parts(found, rules)))
    shown = dedupe(shown, SAME, ["start", "end", "tags"])  # a run that decodes in several passes is found in each
    if ignore is not None:
        shown = drop_ignored(shown, ignore)
    return shown if baseline is None else drop_known(shown, baseline, list(baseline_fields))


def dedupe(findings: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first finding of each key in the given order."""
    others = [c for c in findings.columns if c not in keys]
    first = F.min_by(F.struct(*others), F.struct(*order)).alias("x")
    return findings.groupBy(*keys).agg(first).select(*keys, *(f"x.{c}" for c in others))


def parse_ignore(lines: DataFrame) -> DataFrame:
    """(entry, commit, good) of an ignore file's lines: ``path:rule:line`` or ``commit:path:rule:line``; others are told as not good."""
    cut = F.replace(F.trim("value"), F.lit("\\"), F.lit("/"))
    parts = F.size(F.split(cut, ":"))
    return lines.filter((F.trim("value") != "") & ~F.trim("value").startswith("#")).select(cut.alias("entry"), F.when(parts == 4, F.substring_index(cut, ":", 1)).alias("commit"), parts.isin(3, 4).alias("good"))


def drop_ignored(findings: DataFrame, ignore: DataFrame) -> DataFrame:
    """Findings that no entry names, with or without their commit. Ignore files are small; the engine decides how to join."""
    entries = ignore.select("entry").distinct()
    plain = findings.join(entries, F.concat_ws(":", "path", "rule_id", F.col("start_line").cast("string")) == F.col("entry"), "left_anti")
    if "commit" not in findings.columns:
        return plain
    full = F.when(F.length("commit") > 0, F.concat_ws(":", "commit", "path", "rule_id", F.col("start_line").cast("string")))
    return plain.join(entries, full == F.col("entry"), "left_anti")


def drop_known(findings: DataFrame, baseline: DataFrame, fields: list[str]) -> DataFrame:
    """Findings of which no baseline row agrees in all fields, nulls included."""
    f, b = findings.alias("f"), baseline.select(*fields).distinct().alias("b")
    return f.join(b, reduce(lambda x, y: x & y, (F.col(f"f.{c}").eqNullSafe(F.col(f"b.{c}")) for c in fields)), "left_anti")


def traced(findings: DataFrame, wanted: str, fingerprint: str = "fingerprint") -> DataFrame:
    """Findings whose fingerprint, with or without its ``v1:``, begins with ``wanted`` (blanks around it don't count). A blank ``wanted`` finds none, as does a null fingerprint. Both tests reach a Parquet scan."""
    head = wanted.strip()
    if not head:
        return findings.filter("false")
    return findings.filter(F.col(fingerprint).startswith(head) | F.col(fingerprint).startswith(f"v1:{head}"))
