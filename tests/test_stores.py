"""Stores that are written and read again, against their SQL on awkward rows; readers on their limits."""

import zlib

import pytest

from leakflow.plans import catalog
from leakflow.sources import files, objects

duckdb = pytest.importorskip("duckdb")
STORES = ["archive_entries", "binary_sniff", "object_blobs", "object_trees", "object_commits", "staged_index", "export_streams"]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Nulls, empty and repeated texts, a very long one, marks of the formats in the text, and a clashing column."""
    texts = [None, "", "same", "same", "é😀 the\n" * 40_000, 'data 3\nabc\n\ncommit "x"\n', "\r\n\ttab", *(f"text {i} the end\n" * (i % 9) for i in range(60)), "x" * 8191, "x" * 8192, "x" * 7999]
    path = tmp_path_factory.mktemp("awkward")
    rows = [(i, t, "en", "src", len(t or ""), "b") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, body string").repartition(2).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", STORES)
def test_what_is_read_is_what_was_stored(spark, awkward, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{awkward}/documents.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    text = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert text(catalog.QUERIES[name](spark, awkward).select(columns).collect()) == text(want.fetchall())


@pytest.mark.parametrize("name", STORES)
def test_an_empty_table_gives_no_rows(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_inflating_stops_at_the_end_and_at_the_limit():
    data = bytes(range(256)) * 2000
    packed = b"head" + zlib.compress(data, 0) + b"rest" * 50_000
    assert objects.inflate(packed, len(data), 4) == (data, len(zlib.compress(data, 0)))
    assert objects.inflate(packed, len(data) - 1, 4) is None
    assert objects.inflate(packed[: len(data) // 2], 1 << 30, 4) is None and objects.inflate(packed, 1 << 30, 1) is None
    assert objects.inflate(zlib.compress(b""), 0) == (b"", 8)


def test_names_of_entries_follow_their_archive():
    import bz2

    assert list(files.unpack("a/b.zip!c.txt.bz2", bz2.compress(b"x"), 1)) == [("a/b.zip!c.txt.bz2!c.txt", b"x")]
