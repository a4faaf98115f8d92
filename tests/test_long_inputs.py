"""What only shows on larger or odder inputs: long lines, repeated rows, joins that would be broadcast, plans that would double."""

import base64
import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leakflow.operators import audit, decode, graph, keywords, scrub
from leakflow.plans import commands, documents
from leakflow.plans.registry import ORACLE_SQL
from leakflow.session import new_path
from leakflow.sources import fastexport
from leakflow.streaming import scans


@pytest.fixture
def cuts(monkeypatch):
    """(join nodes of the physical plan, leaves of the plan) of each table that a graph's loop ends."""
    seen, cut = [], graph._cut

    def told(df):
        plan = df._jdf.queryExecution()
        seen.append((plan.executedPlan().toString(), plan.analyzed().collectLeaves().size()))
        return cut(df)

    monkeypatch.setattr(graph, "_cut", told)
    return seen


def _line(spark, n):
    """A line of commits with a side edge from each tenth to the one seven before."""
    main = spark.range(1, n).select(F.col("id").alias("oid"), (F.col("id") - 1).alias("parent"))
    return main.unionByName(main.filter("oid % 10 = 0").select("oid", (F.col("oid") - 7).alias("parent")))


def test_references_take_jumps_in_a_plan_that_does_not_double(spark, cuts):
    refs = spark.createDataFrame([("a", 299), ("b", 120), ("c", 5)], "ref string, oid long")
    found = graph.refs_that_hold(refs, _line(spark, 300), spark.range(100, 130).withColumnRenamed("id", "oid"))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {("a", 30), ("b", 21)}
    assert max(leaves for _, leaves in cuts) < 40  # nine jumps: a union of two a jump had 512
    assert not any("BroadcastHashJoin" in plan for plan, _ in cuts)


def test_range_differences_broadcast_nothing(spark, cuts):
    tips = lambda *ids: spark.createDataFrame([(i,) for i in ids], "oid long")
    found = graph.range_difference(_line(spark, 200), tips(199, 50), tips(150))
    assert {r["oid"] for r in found.collect()} == set(range(151, 200))
    assert not any("BroadcastHashJoin" in plan for plan in (found._jdf.queryExecution().executedPlan().toString(), *(p for p, _ in cuts)))


def test_merged_ranges_broadcast_nothing(spark, cuts):
    tips = lambda *ids: spark.createDataFrame([(i,) for i in ids], "oid long")
    found = graph.merged_range(_line(spark, 200), tips(120), tips(150))
    assert {r["oid"] for r in found.collect()} == set(range(151))
    assert not any("BroadcastHashJoin" in plan for plan in (found._jdf.queryExecution().executedPlan().toString(), *(p for p, _ in cuts)))


def test_hex_within_a_base64_run_is_no_run():
    text = "value 1: By By By x" + " th" * 40 + " end"  # " th" repeated is hex digits in base64
    run = base64.b64encode(text.encode()).decode()
    decoded, segments = decode.decode_pass(f"x {run} y", [], 1)
    assert decoded == f"x {text} y" and [s["encoding"] for s in segments] == ["base64"]
    assert decode.decode_pass(f"x {text.encode().hex()} y", [], 1)[0] == f"x {text} y"


def test_decoded_passes_of_null_and_short_texts_are_those_of_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = [None, "", "a", "ab", "abc", "abcdef", "caf\u00e9", "tab\tand\nline\n", "nul\0byte", None, "th th " * 400]
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, documents.decode_loop(spark, str(tmp_path)).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(ORACLE_SQL["decode_loop"]).fetchall(), key=repr)


def test_chunks_of_long_lines_and_repeated_rows_come_together_in_order(spark, tmp_path):
    long = "".join(f"{i * 7919 % 10007:05d} " for i in range(20_000))
    rows = [(1, long), (2, "twice"), (2, "twice"), (2, "other\nline"), (None, "none"), (3, ""), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in commands.file_chunks(spark, str(tmp_path)).collect()}
    assert got == {("1", len(long), 1, long), ("2", 10, 1, "twice"), ("2", 10, 1, "other\nline"), (None, 4, 1, "none")}


def test_long_chains_are_folded_a_range_at_a_time(spark):
    rows = [("long", i, f"r{i}") for i in range(900)] + [(None, i, f"n{i}") for i in range(250)] + [(f"k{i % 40}", i, f"s{i}") for i in range(400)]
    table = spark.createDataFrame(rows, "c string, i long, t string").repartition(3)
    got = {tuple(r) for r in audit.build_chain(table, "c", "i", ["t"], block=100).select("c", "i", "prev_hash", "row_hash").collect()}
    want, last = set(), {}
    for c, i, t in rows:
        before = last.get(c, "")
        last[c] = hashlib.sha256(f"{before}\x1f{t}".encode()).hexdigest()
        want.add((c, i, before, last[c]))
    assert got == want == {tuple(r) for r in audit.build_chain(table, "c", "i", ["t"]).select("c", "i", "prev_hash", "row_hash").collect()}


def test_a_part_of_a_stream_is_not_one_file(spark):
    home = new_path(spark, "parts")
    rows = spark.range(0, 4000, 1, 4).select((F.col("id") % 2).alias("part"), "id")
    streams = scans._parts(rows, "part", home)
    next(streams)
    files = spark.read.parquet(f"{home}/in").select("part", F.input_file_name().alias("file")).distinct().groupBy("part").count().collect()
    assert {tuple(r) for r in files} == {(0, 4), (1, 4)}


def test_a_batch_of_long_texts_is_looked_at_in_slices(spark, monkeypatch):
    texts = ["x" * 3_000_000 + "Key", None, "", "no", "token key", "y" * 5_000_000, *["key"] * 2_500]
    batch = pa.record_batch({"text": texts, "i": list(range(len(texts)))})
    parts = list(keywords._sliced(iter([batch])))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows == 1 or (p.num_rows <= 1_000 and sum(len(t or "") for t in p.column(0).to_pylist()) <= 4 << 20) for p in parts)
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:5])], "i long, t string").coalesce(1)
    got = {r["i"]: r["numbers_"] for r in keywords.with_words(table, "t", ["key", "token"], {"key": [1], "token": [0]}).collect()}
    assert got == {0: [1], 1: [], 2: [], 3: [], 4: [0, 1]}


def test_states_of_chains_come_along_with_their_rows(spark):
    stream = spark.readStream.format("rate").load().selectExpr("value % 3 as c", "value as i")
    plan = audit.append_chain(stream, "c", "i", ["i"])._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "TransformWithState" not in plan  # no calls for each key


def test_a_scrub_broadcasts_nothing(spark, monkeypatch):
    plans, was = [], scrub.staged

    def told(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return was(df, label)

    monkeypatch.setattr(scrub, "staged", told)
    rows = [("s", 0, "blob", 1, None, b"a"), ("s", 1, "commit", 2, None, None), ("s", 2, "commit", 3, ":2", None)]
    columns = [c.split(" ") for c in fastexport.RECORDS.split(", ")]
    few = spark.createDataFrame(rows, "stream string, seq long, kind string, mark long, parent string, data binary")
    change = F.expr("case when mark = 2 then array(named_struct('kind', 'M', 'mode', '100644', 'ref', ':1', 'path', 'p', 'new_path', null)) end")
    records = few.withColumn("changes", change).select(*((F.col(n) if n in (*few.columns, "changes") else F.lit(None)).cast(t).alias(n) for n, t in columns))
    made = scrub.scrub(records)
    assert {(r["kind"], r["mark"], r["parent"]) for r in made.collect()} == {("blob", 1, None), ("commit", 2, None), ("commit", 3, ":2")}
    plans.append(made._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not any("BroadcastHashJoin" in p for p in plans)
