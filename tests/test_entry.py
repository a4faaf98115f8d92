"""Registered queries against their SQL, and the package without the optional folder."""

import importlib
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def test_every_sql_belongs_to_a_query():
    from leakflow.plans import catalog

    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 60


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["scan_summary", "byte_entropy", "policy_verdict", "tree_expand", "path_filter_rename", "redact_text", "first_introduction"])
def test_queries_are_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from leakflow.plans import catalog

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = con.execute(catalog.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    plain = lambda df: sorted(tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False))
    assert plain(got) == plain(want)


def test_imports_without_the_optional_parts(tmp_path):
    for name in os.listdir(ROOT):
        if name not in ("corpus_pipeline.py", ".git", "leakflow"):
            os.symlink(f"{ROOT}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "leakflow")
    for name in os.listdir(f"{ROOT}/leakflow"):
        if name != "llm":
            os.symlink(f"{ROOT}/leakflow/{name}", tmp_path / "leakflow" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_entry_lists_the_numbered_queries():
    sys.path.insert(0, ROOT)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name, table", [("durations_all", "events")])
def test_whole_tables_are_their_sql(spark, name, table):
    test_queries_are_their_sql(spark, name)
    from leakflow.plans import catalog

    assert catalog.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_streamed_rows_and_checkpoint_are_in_the_shared_folder(spark):
    from leakflow.plans import catalog
    from leakflow.session import shared_dir

    made = catalog.QUERIES["streaming_dedupe"](spark, SF)
    want = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_type").distinct()
    assert sorted(made.collect()) == sorted(want.collect())
    paths = made.inputFiles()
    assert paths
    home = shared_dir(spark).removeprefix("file:").rstrip("/")
    home = "/" + home.lstrip("/")
    assert all(("/" + p.removeprefix("file:").lstrip("/")).startswith(home) for p in paths)
    assert os.path.isdir("/" + os.path.dirname(paths[0]).removeprefix("file:").lstrip("/") + "-checkpoint/state")
