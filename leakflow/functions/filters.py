"""Predicates of rule filters as column expressions, and as SQL functions for filters written as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from leakflow.functions.entropy import byte_entropy


#: Terms up to which each is a test of its own.
MANY_TERMS = 64


def matches_any(text: Column, patterns: list[str]) -> Column:
    """Any of the patterns matches somewhere. No patterns: false."""
    return text.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def contains_any(text: Column, terms: list[str]) -> Column:
    """Any of the terms occurs, in whatever case. More than MANY_TERMS are looked for in one pass over the text."""
    if len(terms) > MANY_TERMS:
        from leakflow.operators.keywords import holds_any

        return holds_any(text, terms)
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(t.lower())) for t in terms), F.lit(False))


def find_match(text: Column, pattern: str) -> Column:
    """The first match, or an empty string."""
    return F.regexp_extract(text, pattern, 0)


def last_index_of(text: Column, part: str) -> Column:
    """Byte offset of the last occurrence, or -1."""
    place = F.length(text) - F.length(F.lit(part)) - F.locate(part[::-1], F.reverse(text)) + 1
    return F.when(F.contains(text, F.lit(part)), F.octet_length(F.left(text, place))).otherwise(F.lit(-1))


def byte_slice(text: Column, low: Column, high: Column) -> Column:
    """Bytes low to high, with both held inside the text."""
    raw = F.encode(text, "utf-8")
    size = F.octet_length(text)
    start = F.least(F.greatest(low, F.lit(0)), size)
    stop = F.least(F.greatest(high, F.lit(0)), size)
    return F.when(stop > start, F.decode(F.substring(raw, start + 1, stop - start), "utf-8")).otherwise(F.lit(""))


def any_of(items: Column, test) -> Column:
    return F.exists(items, test)


def all_of(items: Column, test) -> Column:
    return F.forall(items, test)


def one_of(items: Column, test) -> Column:
    return F.size(F.filter(items, test)) == 1


def none_of(items: Column, test) -> Column:
    return ~F.exists(items, test)


def equal_or_missing(value: Column, other: Column) -> Column:
    """Equality in which a missing value equals an empty string."""
    return F.coalesce(value, F.lit("")) == F.coalesce(other, F.lit(""))


def skip_if(filter_column: Column) -> Column:
    """Turns a filter into "keep": rows are dropped only where it is true, so one that fails keeps them."""
    return ~F.coalesce(filter_column, F.lit(False))


#: SQL functions for filters written as text; Catalyst inlines their bodies.
SQL_FUNCTIONS = {
    "matches_any": "(s STRING, patterns ARRAY<STRING>) RETURNS BOOLEAN RETURN exists(patterns, p -> s rlike p)",
    "contains_any": "(s STRING, terms ARRAY<STRING>) RETURNS BOOLEAN RETURN exists(terms, t -> contains(lower(s), lower(t)))",
    "find_match": "(s STRING, p STRING) RETURNS STRING RETURN regexp_extract(s, p, 0)",
    "byte_entropy": """(s STRING) RETURNS DOUBLE RETURN aggregate(
        transform(array_distinct(regexp_extract_all(hex(encode(s, 'utf-8')), '(..)', 1)),
                  u -> size(filter(regexp_extract_all(hex(encode(s, 'utf-8')), '(..)', 1), x -> x = u)) / cast(octet_length(s) AS DOUBLE)),
        cast(0 AS DOUBLE), (acc, p) -> acc - p * log2(p))""",
}


#: What stands in for functions that need something of the caller's until it is there.
_UNTIL_GIVEN = {"fails_token_efficiency": "(s STRING) RETURNS BOOLEAN RETURN false"}


def register_sql(spark: SparkSession) -> None:
    """Temporary SQL functions for ``F.expr`` and ``spark.sql``. Functions of the caller's that are there stay."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    for name, body in _UNTIL_GIVEN.items():
        if not spark.catalog.functionExists(name):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")


__all__ = ["all_of", "any_of", "byte_entropy", "byte_slice", "contains_any", "equal_or_missing", "find_match", "last_index_of", "matches_any", "none_of", "one_of", "register_sql", "skip_if"]
