"""Removal of lines that many sites share.

A HyperLogLog sketch of sites is kept for each line's hash; sketches merge by
aggregation. Lines whose estimate is near the threshold get an exact distinct
count. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakflow.llm.staging import join_by_count, stage, with_row_id

#: log2 of a sketch's buckets; the standard error is 1.04 / sqrt(2 ** 12) = 1.6 %.
LG_K = 12
#: Estimates within this share of the threshold (about five standard errors), and within 1 of it, are counted exactly.
NEAR = 0.08


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """A line's two 64-bit hashes, without the spaces around it."""
    cut = F.trim(line)
    return F.struct(F.xxhash64(cut).alias("h1"), F.xxhash64(F.lit("line"), cut).alias("h2"))


def shared_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h1, h2, n) of lines that at least ``min_sites`` distinct sites have, with how many rows they have, from rows (h1, h2, site)."""
    sketches = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.count("*").alias("n"))
    # a line has no more sites than occurrences
    estimated = sketches.filter(F.col("n") >= min_sites).select("h1", "h2", "n", F.hll_sketch_estimate("sketch").alias("sites"))
    margin = max(1.0, NEAR * min_sites)
    estimated = stage(estimated.filter(F.col("sites") >= min_sites - margin), "estimated")
    sure = estimated.filter(F.col("sites") > min_sites + margin).select("h1", "h2", "n")
    near = estimated.filter(F.col("sites") <= min_sites + margin).select("h1", "h2", "n")
    counted = join_by_count(lines, near, ["h1", "h2"], "n", lines.count()).filter(F.col("site").isNotNull()).groupBy("h1", "h2", "site").agg(F.first("n").alias("n"))
    exact = counted.groupBy("h1", "h2").agg(F.count("*").alias("sites"), F.first("n").alias("n")).filter(F.col("sites") >= min_sites).select("h1", "h2", "n")
    return sure.unionByName(exact)


def _bucket(key: Column, n: Column) -> Column:
    return F.pmod(key["h1"], n.cast("long")).cast("int")


def _buckets(keys: Column) -> Column:
    """A set of keys as an array of about as many buckets as a bucket has keys: a long document's lines are looked up among few."""
    n = F.ceil(F.sqrt(F.size(keys))).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.filter(keys, lambda k: _bucket(k, n) == b))


def _in_buckets(buckets: Column, key: Column) -> Column:
    return F.array_contains(F.get(buckets, _bucket(key, F.size(buckets))), key)


def drop_shared_lines(docs: DataFrame, min_sites: int = 5, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """doc_id, n_lines, n_removed, clean_text for each row of ``docs``: its text without lines that ``min_sites`` or more sites share.

    Lines end at line feeds and are compared without the spaces around them;
    blank ones are never removed. A null site counts as none. A null text has
    no lines and stays null; an empty one has one blank line; long ones may
    have any number of lines. Repeated rows
    each return a row, an empty table returns none; other columns are not
    read.
    """
    plain = docs.select(F.col(f"`{doc_id}`").alias("id_"), F.col(f"`{text}`").alias("text_"), F.col(f"`{site}`").cast("string").alias("site_"))
    staged = stage(with_row_id(plain, "row_id_"), "documents")
    keys = F.transform(F.filter(_lines(F.col("text_")), lambda x: F.trim(x) != ""), line_key)
    lines = stage(staged.select("row_id_", F.col("site_").alias("site"), F.explode(F.array_distinct(keys)).alias("key")).select("row_id_", "site", "key.*"), "lines")
    shared = shared_lines(lines.select("h1", "h2", "site"), min_sites)
    flagged = join_by_count(lines.select("row_id_", "h1", "h2"), stage(shared, "shared"), ["h1", "h2"], "n", lines.count()).groupBy("row_id_").agg(F.collect_set(F.struct("h1", "h2")).alias("flags_")).select("row_id_", _buckets(F.col("flags_")).alias("flags_"))
    kept = F.filter(_lines(F.col("text_")), lambda x: ~_in_buckets(F.col("flags_"), line_key(x)) | (F.trim(x) == ""))
    all_lines = F.coalesce(F.size(_lines(F.col("text_"))), F.lit(0))
    n_lines = F.when(F.col("text_").isNull(), 0).otherwise(all_lines).cast("long")
    joined = staged.join(flagged, "row_id_", "left").withColumn("kept_", F.when(F.col("flags_").isNotNull(), kept))
    return joined.select(
        F.col("id_").alias(doc_id), n_lines.alias("n_lines"),
        F.when(F.col("kept_").isNotNull(), n_lines - F.size("kept_")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("kept_").isNotNull(), F.array_join("kept_", "\n")).otherwise(F.col("text_")).alias("clean_text"),
    )
