"""Decoys for secrets, and how word-like a secret is."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BooleanType

from leakflow.operators import keywords

#: The share of characters that change, and prefixes that don't.
RATE, PREFIX_LEAST, PREFIX_LENGTH = 0.7, 20, 6
CLASSES = {"[a-z]": "abcdefghijklmnopqrstuvwxyz", "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "[0-9]": "0123456789"}


def obfuscate(secret: Column, seed: int = 0) -> Column:
    """A decoy of the same shape: most characters become others of their class. The draw is a hash of seed, secret and place, so it is the same in each run."""
    prefix = F.when(F.length(secret) > PREFIX_LEAST, F.coalesce(F.nullif(F.regexp_extract(secret, "^[^_.-]{1,8}[_.-]", 0), F.lit("")), F.left(secret, F.lit(PREFIX_LENGTH)))).otherwise(F.lit(""))
    body = F.regexp_extract_all(F.substr(secret, F.length(prefix) + 1, F.length(secret)), F.lit("(?s)(.)"), F.lit(1))

    def swap(c: Column, i: Column) -> Column:
        draw = F.pmod(F.xxhash64(F.lit(seed), secret, i), F.lit(1000))
        out = c
        for kind, letters in CLASSES.items():
            pick = F.pmod(F.xxhash64(F.lit(seed + 1), secret, i), F.lit(len(letters))).cast("int") + 1
            out = F.when(c.rlike(f"^{kind}$"), F.substr(F.lit(letters), pick, F.lit(1))).otherwise(out)
        return F.when(draw < int(1000 * RATE), out).otherwise(c)

    return F.concat(prefix, F.array_join(F.transform(body, swap), ""))


#: Word lists of up to so many words become an automaton; larger ones are joined.
MANY_WORDS = 2_000_000


def dictionary_parts(words: DataFrame, tokens: DataFrame, least: int) -> DataFrame:
    """(token, start, word): all parts of the distinct ``tokens`` (token) that are ``words`` (word) of at least ``least`` letters, in whatever case; overlapping ones too. Null and blank words and tokens have no part.

    A list of up to MANY_WORDS goes to the driver and becomes an automaton, so
    a token costs one pass whatever its length. Of a longer one, all parts of
    all tokens are joined with the words.
    """
    low = words.select(F.lower("word").alias("word")).filter(F.length("word") >= least).distinct()
    distinct = tokens.select("token").filter("token is not null").distinct()
    if low.count() <= MANY_WORDS:
        found = keywords.occurrences(distinct.withColumn("low_", F.lower("token")), "low_", [r["word"] for r in low.collect()], keep=("token", "low_"))
        letters = F.length(F.substring(F.encode("low_", "utf-8"), F.lit(1), F.col("start").cast("int")).cast("string"))
        return found.select("token", letters.alias("start"), "word")
    longest = low.agg(F.max(F.length("word"))).first()[0]
    size = F.length("token")
    starts = distinct.filter(size >= least).withColumn("start", F.explode(F.sequence(F.lit(0), size - least)))
    cut = starts.withColumn("n", F.explode(F.sequence(F.lit(least), F.greatest(F.lit(least), F.least(size - F.col("start"), F.lit(longest))))))
    return cut.select("token", "start", F.substr(F.lower("token"), F.col("start") + 1, F.col("n")).alias("word")).join(low, "word").select("token", "start", "word")


def register_token_efficiency(spark: SparkSession, count_tokens: Callable[[list[str]], list[int]], words: list[str]) -> None:
    """The SQL function ``fails_token_efficiency(secret)`` for filters, with a tokenizer and a word list of the caller's: see ``fails_efficiency``. Null doesn't fail."""
    built = keywords.automata([w.lower() for w in words if len(w.encode()) >= 4], fold=False)

    @arrow_udf(BooleanType())
    def fails(secrets: pa.Array) -> pa.Array:
        texts = [t or "" for t in secrets.to_pylist()]
        short = [len(t.encode()) < 20 for t in texts]
        texts = [t.replace("\n", "").replace("\r", "") if s else t for t, s in zip(texts, short)]
        longest = [0] * len(texts)
        low = [t.lower().encode() for t in texts]
        for automaton in built:
            for t, w in zip(*(x.tolist() for x in automaton.found(low))):
                longest[t] = max(longest[t], len(automaton.words[w]))
        sizes = [len(t.encode()) for t in texts]
        return pa.array([n > 0 and (w >= 5 or s / n >= (2.1 if s < 12 and w >= 4 else 2.5)) for s, n, w in zip(sizes, count_tokens(texts), longest)], pa.bool_())

    spark.udf.register("fails_token_efficiency", fails)


@functools.lru_cache(maxsize=2)
def _vocabulary(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary_counter(path: str) -> Callable[[list[str]], list[int]]:
    """A tokenizer for ``token_ratio`` and ``register_token_efficiency`` from a vocabulary file that every worker can open at ``path``; a worker reads it once. No special tokens are added, nothing is cut."""

    def count(texts: list[str]) -> list[int]:
        return [len(e.ids) for e in _vocabulary(path).encode_batch(texts, add_special_tokens=False)]

    return count


def token_ratio(secret: Column, count_tokens: Callable[[list[str]], list[int]] | None = None) -> Column:
    """Bytes for each token; texts of under 20 bytes lose line ends first. Without a tokenizer it is 0. ``count_tokens`` counts the tokens of a batch."""
    if count_tokens is None:
        return F.lit(0.0)
    plain = F.when(F.octet_length(secret) < 20, F.regexp_replace(secret, r"[\r\n]", "")).otherwise(secret)

    @arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        return pa.array(count_tokens([t or "" for t in texts.to_pylist()]), pa.int64())

    n = tokens(plain)
    return F.when(n > 0, F.octet_length(plain) / n).otherwise(F.lit(0.0))


def fails_efficiency(secret: Column, ratio: Column, has_word5: Column, has_word4: Column) -> Column:
    """Reads like words: a word of five letters in it, or many bytes for each token. Secrets of under 12 bytes that hold a four-letter word have a lower limit. A ratio of 0 (no tokenizer) never fails."""
    limit = F.when((F.octet_length(secret) < 12) & has_word4, 2.1).otherwise(2.5)
    return (ratio > 0) & (has_word5 | (ratio >= limit))
