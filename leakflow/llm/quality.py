"""A quality classifier: a sparse ensemble of rules over text statistics.

Trees are grown on statistics of labelled texts; each path from a root is a
conjunctive rule; a lasso-penalized logistic regression weights the rules, and
those with a weight are compiled into one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from leakflow.llm.staging import carried, restored, stage

#: Bytes by class: capitals, small letters and bytes of other letters, digits, blanks, line ends, common punctuation; the rest are symbols.
_UPPER, _LOWER, _DIGIT, _BLANK, _LINE, _POINT, _SYMBOL = range(7)


def _classes() -> np.ndarray:
    table = np.full(256, _SYMBOL, dtype=np.uint8)
    for first, last, kind in ((0x41, 0x5A, _UPPER), (0x61, 0x7A, _LOWER), (0x80, 0xFF, _LOWER), (0x30, 0x39, _DIGIT)):
        table[first : last + 1] = kind
    for signs, kind in ((b" \t", _BLANK), (b"\n\r\x0b\x0c", _LINE), (b".,;:'\"?()-", _POINT)):
        table[list(signs)] = kind
    return table


_CLASS = _classes()
_SALT = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)

STATISTICS = ["log_bytes", "upper", "digits", "blanks", "lines", "points", "symbols", "log_words", "word_length", "distinct", "repeated", "runs", "odd_ends", "no_letters", "word_line"]
STATISTICS_TYPE = T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS])
#: Bytes of texts whose statistics are made at a time: some fifty bytes of arrays for each.
_CHUNK = 1 << 19


def text_statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; null and empty texts have zeros."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    out = np.zeros((len(texts), len(STATISTICS)))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK, side="right")) - 1)
        to = min(to, len(texts))
        out[at:to] = _statistics(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to
    return out


def _statistics(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    n = len(edges) - 1
    size = np.diff(edges)
    kinds = _CLASS[data]
    text = np.repeat(np.arange(n), size)
    by_kind = np.bincount(text * 7 + kinds, minlength=7 * n).reshape(n, 7).astype(float)
    inside = (kinds != _BLANK) & (kinds != _LINE)
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1] | (text[1:] != text[:-1])
        last[:-1] &= ~inside[1:] | (text[1:] != text[:-1])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    owner = text[starts]
    sizes = ends - starts
    words = np.bincount(owner, minlength=n).astype(float)
    mixed = _SALT[data]
    mixed[1:] += _SALT[data[:-1]] >> np.uint64(7)  # each byte together with the one before
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
    letters = np.concatenate(([0], np.cumsum((kinds == _LOWER) | (kinds == _UPPER))))
    # the first byte counts without its forerunner
    hashes = (sums[ends] - sums[starts] - mixed[starts] + _SALT[data[starts]] * np.uint64(3)) if len(starts) else np.zeros(0, np.uint64)
    order = np.lexsort((hashes, owner))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][fresh], minlength=n)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    twice = same.copy()
    twice[1:] &= same[:-1]
    odd = kinds[ends - 1] == _SYMBOL
    bare = letters[ends] == letters[starts]
    count = lambda x: np.bincount(owner[x], minlength=n)
    per_byte, per_word = np.maximum(size, 1), np.maximum(words, 1)
    return np.column_stack([
        np.log1p(size), *(by_kind[:, k] / per_byte for k in (_UPPER, _DIGIT, _BLANK, _LINE, _POINT, _SYMBOL)),
        np.log1p(words), np.bincount(owner, weights=sizes, minlength=n) / per_word, distinct / per_word,
        count(same) / per_word, count(twice) / per_word, count(odd) / per_word, count(bare) / per_word, words / (by_kind[:, _LINE] + 1),
    ])


@arrow_udf(STATISTICS_TYPE)
def statistics(texts: pa.Array) -> pa.Array:
    found = text_statistics(texts)
    return pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(len(STATISTICS))], names=STATISTICS)


@dataclass
class Rule:
    """A conjunction: for a statistic's number, the bounds (above, up to)."""

    bounds: dict[int, tuple[float, float]] = field(default_factory=dict)

    def with_bound(self, statistic: int, threshold: float, upper: bool) -> Rule:
        low, high = self.bounds.get(statistic, (-np.inf, np.inf))
        pair = (low, min(high, threshold)) if upper else (max(low, threshold), high)
        return Rule(self.bounds | {statistic: pair})

    def key(self) -> tuple:
        return tuple(sorted(self.bounds.items()))

    def column(self, stats: str) -> Column:
        """The rule as a predicate over the struct column ``stats``."""
        holds = F.lit(True)
        for i, (low, high) in sorted(self.bounds.items()):
            value = F.col(f"{stats}.{STATISTICS[i]}")
            holds = holds & (value > low if np.isfinite(low) else F.lit(True)) & (value <= high if np.isfinite(high) else F.lit(True))
        return holds


@dataclass
class RuleEnsemble:
    """A bias and weighted rules; ``score`` is the logistic of their sum."""

    bias: float
    rules: list[tuple[Rule, float]]

    def score(self, stats: str) -> Column:
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            total = total + F.when(rule.column(stats), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _paths(node, rule: Rule) -> list[Rule]:
    """Rules of all nodes below ``node`` of a fitted tree."""
    if node.numDescendants() == 0:
        return []
    split, found = node.split(), []
    for child, upper in ((node.leftChild(), True), (node.rightChild(), False)):
        path = rule.with_bound(split.featureIndex(), split.threshold(), upper)
        found += [path, *_paths(child, path)]
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(stats, label) of at most ``max_rows`` labelled texts, never those whose crc32(id as text) is divisible by 5.

    Which: the distinct (id, text, label) with the smallest hashes of their
    ids, so repeated ids, texts and labels don't exceed the bound. Labels that
    are null or aren't 0 or 1, and those without a document, are left out.
    """
    key = F.col(f"`{doc_id}`")
    usable = labels.filter(F.col(label).isin(0, 1) & (F.crc32(key.cast("string")) % 5 != 0)).select(key.alias("key_"), F.col(label).cast("double").alias("label")).distinct()
    texts = docs.select(key.alias("key_"), F.col(f"`{text}`").alias("text_")).withColumn("which_", F.xxhash64("text_"))
    # narrow rows first: keys and hashes of texts
    pairs = texts.select("key_", "which_").distinct().join(usable, "key_")
    chosen = pairs.orderBy(F.xxhash64("key_"), "key_", "which_", "label").limit(max_rows)
    # bounded by max_rows, so fit to be broadcast
    taught = texts.join(F.broadcast(chosen), ["key_", "which_"]).dropDuplicates(["key_", "which_", "label"])
    return stage(taught.select(statistics("text_").alias("stats"), "label"), "labelled")


def fit(sample: DataFrame, trees: int = 24, depth: int = 3, penalty: float = 0.0005, seed: int = 7) -> RuleEnsemble:
    """The ensemble fitted to a ``labelled_sample``. With labels of one kind only, or none, it has a bias and no rules."""
    seen = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(seen) < 2:
        return RuleEnsemble({0.0: -20.0, 1.0: 20.0}.get(next(iter(seen), None), 0.0), [])
    vector = array_to_vector(F.array(*(F.col(f"stats.{s}") for s in STATISTICS)))
    table = sample.select("label", "stats", vector.alias("features")).coalesce(2).cache()
    grown = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, featureSubsetStrategy="sqrt", subsamplingRate=0.7, seed=seed).fit(table)
    rules = list({r.key(): r for t in grown.trees for r in _paths(t._call_java("rootNode"), Rule())}.values())
    if not rules:
        table.unpersist()
        return RuleEnsemble(float(np.log(seen[1.0] / seen[0.0])), [])
    holds = array_to_vector(F.array(*(r.column("stats").cast("double") for r in rules)))
    active = table.select("label", holds.alias("features")).cache()
    fitted = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=True, maxIter=60).fit(active)
    active.unpersist()
    table.unpersist()
    weights = fitted.coefficients.toArray()
    return RuleEnsemble(float(fitted.intercept), [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-9])


def with_score(docs: DataFrame, model: RuleEnsemble, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1, from the whole text, as column ``name``."""
    plain, names = carried(docs)
    scored = plain.withColumn("stats", statistics(F.col(f"c{names.index(text)}"))).withColumn("s", model.score("stats"))
    return restored(scored.withColumn(name, F.col("s")), names, name)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 20_000, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    held_out: crc32(doc_id as text) is divisible by 5 (a null id: not); such
    rows never teach. Null and empty texts are scored by their statistics,
    which are zeros; very long ones are scored as a whole. Repeated rows each
    return a row. Without usable labels
    every score is 0.5; with labels of one kind it is near that kind.
    """
    model = fit(labelled_sample(docs, labels, max_rows, doc_id))
    key = F.col(f"`{doc_id}`")
    scored = with_score(docs.select(key.alias(doc_id), "text"), model)
    return scored.select(doc_id, F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 20_000) -> DataFrame:
    """``docs`` whose score is at least ``threshold``."""
    model = fit(labelled_sample(docs, labels, max_rows))
    plain, names = carried(docs)
    scored = plain.withColumn("stats", statistics(F.col(f"c{names.index('text')}")))
    return restored(scored.filter(model.score("stats") >= threshold), names)


def accuracy(scores: pd.DataFrame, labels: pd.DataFrame) -> float:
    """The share of held-out rows with a label whose prediction is the label."""
    held = scores[scores.held_out].merge(labels.dropna(subset=["quality"]), on="doc_id")
    return float((held.predicted == held.quality).mean())
