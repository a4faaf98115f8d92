"""Scans of growing inputs with Structured Streaming."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakflow.functions import hashing
from leakflow.operators import detect
from leakflow.operators.rules import BUILTIN, Rule, java_pattern
from leakflow.session import new_path, staged


def stream_table(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(stream: DataFrame, keys: list[str], event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first row of each key; with an event time, keys older than the delay are forgotten."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys) if event_time else stream.dropDuplicates(keys)


def windowed_counts(stream: DataFrame, event_time: str, key: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """(window_start, key, n): rows for each window and key.

    The watermark is the latest event time of the batches before, less
    ``delay``. A window that ends at or before it is given out, once, and
    forgotten; rows that come for such a window are late and don't count.
    """
    counted = stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), key, "n")


def session_counts(stream: DataFrame, event_time: str, key: str, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """(session_start, session_end, key, n): rows of each key that follow each other within ``gap``; a session ends a gap after its last row. Late rows are those of ``windowed_counts``."""
    counted = stream.withWatermark(event_time, delay).groupBy(F.session_window(event_time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


#: What the cache holds of a finding: places and numbers, no byte of a secret.
CACHED = "rule_id string, start_line long, end_line long, start_column long, end_column long, start long, end long, secret_at int, secret_length int, entropy double, specificity int, confidence string"
_LIST = "array<struct<" + CACHED.replace(", ", ",").replace(" ", ":") + ">>"
CACHE = f"content string, path_key string, findings {_LIST}, batch long"


def rules_version(rules: list[Rule] | tuple[Rule, ...], **how) -> str:
    """A name for rules and how they are applied; other ones have another."""
    return hashlib.sha256(repr((sorted(rules, key=lambda r: r.rule_id), sorted(how.items()))).encode()).hexdigest()[:16]


def _path_key(rules: list[Rule] | tuple[Rule, ...], skip: str) -> Column:
    """What of a path the findings depend on: nothing, which rules' path patterns match it, or all of it where a predicate mentions it."""
    predicates = [skip, *(r.filter for r in rules), *(when for r in rules for when, _ in r.set_confidence)]
    if any(re.search(r"\bpath\b", p) for p in predicates):
        return F.col("path")
    tests = [F.when(F.rlike("path", F.lit(java_pattern(r.path))), "1").otherwise("0") for r in rules if r.path and r.regex]
    return F.concat(*tests) if tests else F.lit("")


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """(content, path_key, findings, batch) of one version of rules; nothing is there before the first batch. The folder of a version holds a partition for each batch."""
    folder = f"{cache_path.rstrip('/')}/version={version}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(conf).exists(path):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).option("basePath", folder).parquet(folder)


def scan_batch(batch: DataFrame, number: int, cache_path: str, rules: list[Rule] | tuple[Rule, ...] = BUILTIN, skip: str = "") -> DataFrame:
    """All findings of a batch of fragments (fragment_id, raw, start_line, path), of which contents that the cache knows aren't scanned again.

    New contents are scanned once each, whatever number of fragments has them,
    and what is found, also nothing, becomes the batch's partition of the
    cache. A batch that runs again overwrites its own partition and sees none
    of what it wrote before. Matches and secrets are cut out of the fragment
    again, so the cache has no secrets. A null text is an empty one; a null
    path and repeated fragments are as good as others.
    """
    spark, version = batch.sparkSession, rules_version(rules, skip=skip)
    told = batch.withColumn("raw", F.coalesce("raw", F.lit(""))).withColumn("content", F.sha2("raw", 256)).withColumn("path_key", F.coalesce(_path_key(rules, skip), F.lit("")))
    keys = ["content", "path_key"]
    known = read_cache(spark, cache_path, version).filter(F.col("batch") != number)
    fresh = told.join(known.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.min_by(F.struct("raw", "path"), F.struct("path", "raw")).alias("x"))
    fresh = staged(fresh.select(*keys, "x.raw", "x.path").withColumn("fragment_id", F.monotonically_increasing_id()).withColumn("start_line", F.lit(0).cast("long")), "fresh")
    found = detect.detect(fresh.drop(*keys), rules, skip=skip)
    places = {"secret_at": F.greatest(F.instr("match", F.col("secret")) - 1, F.lit(0)), "secret_length": F.length("secret")}
    columns = [c.split(" ") for c in CACHED.split(", ")]
    item = F.struct(*(places.get(n, F.col(n)).cast(t).alias(n) for n, t in columns))
    lists = found.groupBy("fragment_id").agg(F.collect_list(item).alias("findings"))
    made = fresh.select("fragment_id", *keys).join(lists, "fragment_id", "left").select(*keys, F.coalesce("findings", F.array().cast(_LIST)).alias("findings"))
    made.write.mode("overwrite").parquet(f"{cache_path.rstrip('/')}/version={version}/batch={number}")
    cached = read_cache(spark, cache_path, version)
    hits = told.join(cached.select(*keys, "findings").filter(F.size("findings") > 0), keys).withColumn("f", F.explode("findings"))
    match = F.substr("raw", F.col("f.start").cast("int") + 1, (F.col("f.end") - F.col("f.start")).cast("int"))
    placed = lambda c: (F.col("start_line") + F.col(f"f.{c}")).alias(c)
    return hits.select(
        "fragment_id", "path", "f.rule_id", placed("start_line"), placed("end_line"), "f.start_column", "f.end_column", "f.start", "f.end", match.alias("match"),
        F.substr(match, F.col("f.secret_at") + 1, F.col("f.secret_length")).alias("secret"), "f.entropy", "f.specificity", "f.confidence",
    ).withColumn("fingerprint", hashing.fingerprint(F.col("path"), F.col("rule_id"), F.col("start_line")))


def scan_new(stream: DataFrame, cache_path: str, sink: Callable[[DataFrame, int], None], checkpoint: str, rules: list[Rule] | tuple[Rule, ...] = BUILTIN, skip: str = ""):
    """Scans fragments (fragment_id, raw, start_line, path) as they come, with ``scan_batch``; ``sink`` gets each batch's findings and its number, and may get them again after a failure."""

    def step(batch: DataFrame, number: int) -> None:
        sink(scan_batch(batch, number, cache_path, rules, skip), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parts(rows: DataFrame, part: str, home: str) -> Iterator[DataFrame]:
    """A stream for each ``part`` (a number) of ``rows``, which sees that part and the ones before: with one checkpoint, each goes on where the one before stopped."""
    # dealt by ``part``, each part would go to one task; all files of a part are one batch, however many they are
    rows.write.partitionBy(part).parquet(f"{home}/in")
    numbers = sorted(r[0] for r in rows.select(part).distinct().collect())
    for i in range(len(numbers)):
        yield stream_table(rows.sparkSession, f"{home}/in/{part}={{{','.join(map(str, numbers[: i + 1]))}}}", rows.drop(part).schema, (1 << 31) - 1)


def run_in_parts(rows: DataFrame, part: str, home: str, transform: Callable[[DataFrame], DataFrame], settings: dict[str, str] | None = None) -> DataFrame:
    """What ``transform`` makes of a stream of ``rows`` that comes a ``part`` at a time, each in a run of its own. ``settings`` hold while it runs."""
    spark = rows.sparkSession
    before = {k: spark.conf.get(k, None) for k in settings or {}}
    for k, v in (settings or {}).items():
        spark.conf.set(k, v)
    try:
        for stream in _parts(rows, part, home):
            made = transform(stream)
            made.writeStream.format("parquet").option("checkpointLocation", f"{home}-checkpoint").trigger(availableNow=True).start(f"{home}/out").awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(made.schema).parquet(f"{home}/out")


def scan_in_batches(frags: DataFrame, part: str, rules: list[Rule] | tuple[Rule, ...] = BUILTIN) -> DataFrame:
    """Findings of fragments that a stream takes a ``part`` (a number) at a time. Fragments, cache, findings and checkpoint lie in the shared folder."""
    spark = frags.sparkSession
    home = new_path(spark, "batches")
    for source in _parts(frags, part, home):
        scan_new(source, f"{home}/cache", lambda found, k: found.write.mode("overwrite").parquet(f"{home}/out/batch={k}"), f"{home}-checkpoint", rules).awaitTermination()
    return spark.read.option("basePath", f"{home}/out").parquet(f"{home}/out").drop("batch")
