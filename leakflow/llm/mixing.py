"""Mixing sources to target weights by Poisson replication.

A document's number of copies inverts a Poisson distribution at a hash of its
id. A rate above PART_RATE is split: the sum of independent Poisson draws is
a Poisson draw, so such a document is drawn in equal parts, each with a hash
of its own. Tables of the distribution thus stay small whatever the rate, and
no task makes all copies of a document that is repeated very often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakflow.llm.staging import carried, restored, stage

#: Up to so many sources the table of rates (about a kilobyte each) is broadcast.
BROADCAST_SOURCES = 10_000
#: Salts of a source in the shuffled join that is used beyond.
SALTS = 64
#: The largest rate that is drawn at once, and the numbers that a part's copies may have.
PART_RATE, PART_COPIES = 64, 1024
#: Parts that a row stands for before they are drawn; documents of more are dealt to several tasks first.
PARTS_A_ROW = 16


def unit_hash(*parts: Column | str) -> Column:
    """A number in (0, 1) from the first 52 bits of the md5 of the parts, joined by colons; nulls are empty."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string") if isinstance(p, Column) else F.lit(p), F.lit("")) for p in parts))
    return (hash_key(text) + 0.5) / float(1 << 52)


def hash_key(text: Column) -> Column:
    """The first 13 hex digits of a text's md5 as a long."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def rates(sizes: DataFrame, weights: dict[str, float], default_weight: float, epochs: float) -> DataFrame:
    """(source, rate) from (source, size): the mean number of copies that gives each source its share of ``epochs`` times all sizes."""
    named = F.create_map(*(F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1])))) if weights else None
    weight = F.coalesce(F.try_element_at(named, F.col("source")), F.lit(float(default_weight))) if weights else F.lit(float(default_weight))
    weighed = sizes.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(F.lit(0.0)))
    total = weighed.agg(F.sum("size").alias("all_"), F.sum("weight").alias("weights_"))
    rate = F.when((F.col("size") > 0) & (F.col("weights_") > 0), epochs * F.col("all_") * F.col("weight") / F.col("weights_") / F.col("size")).otherwise(F.lit(0.0))
    return weighed.join(F.broadcast(total)).select("source", rate.alias("rate"))  # one row


def part_count(rate: Column) -> Column:
    """Into how many equal parts a rate is split."""
    return F.greatest(F.ceil(rate / PART_RATE), F.lit(1)).cast("long")


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k from 0 until what is left is below what a 52-bit number can tell; empty for a rate of 0. For rates up to PART_RATE: at most some 200 numbers."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    term = lambda acc, k: acc["lp"] + F.log(rate) - F.log(k.cast("double"))
    start = F.struct((-rate).alias("lp"), F.array(F.exp(-rate)).alias("cdf"))
    grown = F.aggregate(
        F.sequence(F.lit(1), top), start,
        lambda acc, k: F.struct(term(acc, k).alias("lp"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + F.exp(term(acc, k)))).alias("cdf")),
        lambda acc: acc["cdf"],
    )
    return F.when(rate > 0, grown).otherwise(F.array().cast("array<double>"))


def mix(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, epochs: float = 1.0, seed: int = 17, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` replicated to target weights, with ``copy_no`` (long) and ``mix_key``, in a global random order.

    A source's weight over the sum of all weights is its share of the mix, in
    characters of text; unlisted sources have ``default_weight``, and a null
    source is a source. A document's number of copies inverts the Poisson
    distribution with its source's rate at a hash of seed and doc_id, so it
    is the same in each run; rows that share an id (or have none) share the
    draw. Rates above PART_RATE are drawn in parts (part p > 0 at a hash of
    seed, id and "part p"); copies of part p are numbered from
    p * PART_COPIES + 1. So a tiny source beside a huge one, whose documents
    are repeated millions of times, costs no more than the rows it yields.
    Sources of weight 0, or with no text at all, yield no row; an empty table
    stays empty. Texts may be of any length. Rows are dealt to partitions by
    ``mix_key``, a hash of seed, id and copy, and sorted by it there. Columns
    of ``docs`` that have these two names are replaced.
    """
    docs, names = carried(docs)
    doc_id, source, text = (f"c{names.index(c)}" for c in (doc_id, source, text))
    size = F.sum(F.coalesce(F.length(F.col(text)), F.lit(0)).cast("long"))
    sizes = stage(docs.groupBy(F.col(source).alias("source")).agg(size.alias("size")), "sizes")
    table = rates(sizes, weights, default_weight, epochs).withColumn("parts__", part_count(F.col("rate")))
    table = stage(table.select(F.col("source").alias("src__"), "parts__", poisson_cdf(F.col("rate") / F.col("parts__")).alias("cdf__")), "rates")
    id_text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    same = F.col(source).eqNullSafe(F.col("src__"))
    if table.count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(table), same)
    else:
        salted = table.withColumn("salt__", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = docs.withColumn("salt_of__", F.pmod(F.xxhash64(id_text), F.lit(SALTS)).cast("int"))
        joined = left.join(salted, same & (F.col("salt_of__") == F.col("salt__")))
    joined = joined.filter(F.size("cdf__") > 0)
    first = F.lit(0).cast("long")
    few = joined.filter(F.col("parts__") <= PARTS_A_ROW).withColumn("from__", first)
    if table.filter(F.col("parts__") > PARTS_A_ROW).isEmpty():
        spread = few
    else:  # groups of parts of a much repeated document go to many tasks before any copy is made
        many = joined.filter(F.col("parts__") > PARTS_A_ROW).withColumn("from__", F.explode(F.sequence(first, F.col("parts__") - 1, F.lit(PARTS_A_ROW).cast("long"))))
        spread = few.unionByName(many.repartition(F.xxhash64(id_text, "from__")))
    to = F.least(F.col("from__") + PARTS_A_ROW, F.col("parts__")) - 1
    parts = spread.withColumn("part__", F.explode(F.sequence(F.col("from__"), to)))
    draw = F.when(F.col("part__") == 0, unit_hash(F.lit(str(seed)), id_text)).otherwise(unit_hash(F.lit(str(seed)), id_text, F.concat(F.lit("part "), F.col("part__").cast("string"))))
    # the inverse: how many values of the distribution function lie below the draw
    drawn = parts.withColumn("draw__", draw).withColumn("copies__", F.size(F.filter("cdf__", lambda c: c < F.col("draw__")))).filter("copies__ > 0")
    before = F.col("part__") * PART_COPIES
    copies = drawn.withColumn("copy_no", F.explode(F.sequence(before + 1, before + F.col("copies__"))))
    keyed = copies.withColumn("mix_key", hash_key(F.concat_ws(":", F.lit(str(seed)), id_text, F.col("copy_no").cast("string"))))
    return restored(keyed, names, "copy_no", "mix_key").repartition("mix_key").sortWithinPartitions("mix_key", "copy_no")
