"""Exact copies, vector codes and hard negatives against brute force on awkward tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re

import numpy as np
import pytest

from leakflow.llm import contentsort, decontaminate, hardneg, linespread, quality, simhash, staging, vectorcode, warc
from leakflow.llm.components import connected_components

DOCS = "doc_id long, text string, lang string"
CLASH = ["row_id", "id_", "t_", "d_", "u_", "keep_", "n_", "first_", "part_", "border_", "edge_", "keep_id", "group_size", "kept", "text_sha256", "c0", "c1", "v", "x", "code", "error", "label_error", "shard", "rank"]


def with_clashes(df):
    for name in CLASH:
        df = df.selectExpr("*", f"'x' AS {name}") if name not in df.columns else df
    return df


def equal_texts(rows):
    """(doc_id, keep_id, group_size, sha) of each row, and how many rows each text keeps."""
    texts = [(i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for i, t, *_ in rows]
    by = {}
    for i, t in texts:
        by.setdefault(t, []).append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in by.items()}
    return sorted(((i, least[t], len(by[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts), key=repr), len(by)


def copies(n=400):
    rnd = random.Random(4)
    head = "the same first words " * 10
    rows = [(1, None, "en"), (2, "", "en"), (3, " ", None), (4, "\t\n ", None), (None, "a  b", "en"), (None, "a b", "en"), (5, "a b", "en"), (6, "x" * 300_000, "en"), (7, "x" * 300_000, "en"), (8, "é\r\nñ", "en"), (9, "é ñ", "fr"), (9, "é ñ", "fr"), (None, "alone", "en")]
    rows += [(100 + i, "copy of\none text", "en") for i in rnd.sample(range(n), n)]
    rows += [(1000 + i, head + str(rnd.randint(0, 20)), "en") for i in range(n // 4)]
    rows += [(2000 + i, rnd.choice("ab") * rnd.randint(0, 4) + rnd.choice(["", " ", "\n\n"]) + rnd.choice("cd"), "en") for i in range(n // 4)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("partitions", [1, 4, 23])
def test_exact_copies_over_few_and_many_ranges(spark, partitions):
    rows = copies()
    docs = with_clashes(spark.createDataFrame(rows, DOCS).repartition(5))
    keys = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        made = contentsort.exact_groups(docs).collect()
        stay = contentsort.drop_exact_copies(docs).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want, groups = equal_texts(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in made), key=repr) == want
    kept = [r for r in made if r["kept"]]
    assert len(kept) == groups and all(r["doc_id"] == r["keep_id"] for r in kept) and len({r["text_sha256"] for r in kept}) == groups
    assert sorted((r["doc_id"] or 0) for r in stay) == sorted((r["doc_id"] or 0) for r in kept) and stay[0].__fields__ == docs.columns


def test_exact_copies_of_nothing_and_of_one_batch_after_another(spark):
    assert contentsort.exact_groups(spark.createDataFrame([], DOCS)).collect() == []
    # a run that ends with an Arrow batch, goes on over several, and one that fills a range
    rows = [(i, t, "en") for i, t in enumerate(["a"] * 500 + ["b"] * 1700 + ["c"])]
    got = contentsort.exact_groups(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == [(i, {"a": 0, "b": 500, "c": 2200}[t], {"a": 500, "b": 1700, "c": 1}[t]) for i, t, _ in rows]


def brute_nearest(entries, rows):
    far = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
    return far.argmin(axis=1), far.min(axis=1)


def test_vantage_tree_is_a_plain_search_with_ties():
    rnd = np.random.default_rng(3)
    for n, width, spread in ((1, 3, 5), (2, 1, 2), (16, 8, 4096), (16, 2, 2), (40, 1, 3), (256, 2, 50), (7, 0, 1)):
        entries = rnd.integers(-spread, spread + 1, (n, width))
        rows = np.concatenate([rnd.integers(-2 * spread, 2 * spread + 1, (300, width)), entries])
        code, far = vectorcode.VantageTree(entries).nearest(rows)
        want_code, want_far = brute_nearest(entries, rows)
        assert (code == want_code).all() and (far == want_far).all()


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, np.floor(scale * np.array(v, dtype=np.float64)).astype(np.int64), label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    x = np.array([v for _, v, _ in kept])
    edges = [j * x.shape[1] // parts for j in range(parts + 1)]
    books = [x[:entries, a:b].copy() for a, b in zip(edges, edges[1:])]
    for _ in range(rounds):
        for p, (a, b) in enumerate(zip(edges, edges[1:])):
            code, _ = brute_nearest(books[p], x[:, a:b])
            books[p] = np.array([x[code == k, a:b].sum(axis=0) // (code == k).sum() if (code == k).any() else books[p][k] for k in range(len(books[p]))])
    codes, errors = zip(*(brute_nearest(books[p], x[:, a:b]) for p, (a, b) in enumerate(zip(edges, edges[1:]))))
    error = sum(errors)
    by = {}
    for (_, _, label), e in zip(kept, error.tolist()):
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()
    return [(i, "".join(f"{c[n]:02x}" for c in codes), e, by[label], digest) for n, ((i, _, label), e) in enumerate(zip(kept, error.tolist()))]


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n, dim, seed=1):
    rnd = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.float32(rnd.normal(0, 0.3, dim))], int(rnd.integers(0, 4))) for i in range(n)]
    bad = [(n + 1, None, 1), (n + 2, [float("nan")] * dim, 1), (n + 3, [float("inf")] + [0.0] * (dim - 1), 1), (n + 4, [None] + [0.0] * (dim - 1), 1)]
    ties = [(n + 10 + i, [0.25] * dim, None if i % 2 else 2) for i in range(6)] + [(700, [0.5] * dim, 3)] * 3
    return rows + bad + ties


@pytest.mark.parametrize("n, dim", [(200, 16), (3, 16), (60, 11)])
def test_vector_codes_against_brute_force(spark, n, dim):
    rows = [*vectors(n, dim), (None, [0.1] * dim, None)]
    got = vectorcode.vector_codes(with_clashes(spark.createDataFrame(rows, VECTORS).repartition(3)))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_codes(rows), key=repr)


def test_vector_codes_of_nothing_and_what_codes_stand_for(spark):
    assert vectorcode.vector_codes(spark.createDataFrame([(1, None, 1)], VECTORS)).collect() == []
    assert vectorcode.vector_codes(spark.createDataFrame([], VECTORS)).collect() == []
    codes, books = vectorcode.compress(spark.createDataFrame(vectors(100, 8), VECTORS), keep=["vec_id", "embedding"])
    for r in codes.collect():
        v = np.floor(4096 * np.array(r["c1"])).astype(int)
        assert ((v - books.restore(r["code"])) ** 2).sum() == r["error"]


def brute_negatives(rows):
    kept = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, lab, v) in enumerate(kept):
        if i % 100:
            continue
        scored = sorted((-int(v @ w), j, other) for b, (j, other, w) in enumerate(kept) if b != a and len(w) == len(v))
        for ps, p, _ in [s for s in scored if s[2] == lab][:5]:
            window = [(-s, j) for s, j, other in scored if other != lab and 30 * -ps <= 100 * -s <= 90 * -ps]
            out += [(i, p, r + 1, j, -ps, s) for r, (s, j) in enumerate(window[:10])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [8192, 60])
def test_hard_negatives_against_brute_force(spark, shard_rows):
    rows = [*vectors(900, 6), (None, [0.1] * 6, 1), (1000, [0.3] * 6, None), (1100, [0.0] * 6, 1), (1200, [-0.3] * 6, 2), (1300, [0.3] * 4, 2), (1301, [0.2] * 4, 3), (1302, [0.1] * 4, 2), (1400, [0.3] * 6, 77)]
    got = hardneg.mine(with_clashes(spark.createDataFrame(rows, VECTORS).repartition(3)), shard_rows=shard_rows)
    want = brute_negatives(rows)
    assert want and sorted(map(tuple, got.collect())) == want


def test_hard_negatives_of_nothing_and_of_large_numbers(spark):
    assert hardneg.mine(spark.createDataFrame([], VECTORS)).collect() == []
    rows = [(i * 50, [float(np.float32(2.0**18 * x)) for x in np.random.default_rng(i).normal(0, 1, 3)], i % 3) for i in range(40)]  # scores beyond 2^53
    assert sorted(map(tuple, hardneg.mine(spark.createDataFrame(rows, VECTORS)).collect())) == brute_negatives(rows)


def test_bounds_hold_and_leave_most_rows_out():
    rnd = np.random.default_rng(8)
    v = np.floor(256 * rnd.normal(0, 0.125, (3000, 64))).astype(np.int64)
    quantizer = hardneg.Quantizer.fit(v[:2000])
    codes, norms = quantizer.encode(v)
    shard = hardneg.Shard(64, [{"label": 0, "vec_id": i, "row_id": i, "norm": n, "code": c.tobytes(), "m": m.tobytes()} for i, (c, n, m) in enumerate(zip(codes, norms, v))])
    queries = v[:20].astype(np.float64)
    low, high = shard.bounds(quantizer, queries, slice(0, len(v)))
    exact = queries @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    kth = np.sort(low, axis=1)[:, -10:-9]
    assert (high >= kth).mean() < 0.15  # random directions are the hardest case


# --- hot keys, and texts beyond one piece


def test_joins_of_hot_keys_are_joins(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(rnd.choice([1, 1, 1, 2, 3, i]), i) for i in range(3000)]
    table = spark.createDataFrame(rows, "k long, i long")
    counts = table.groupBy("k").count().withColumnRenamed("count", "n")
    want = sorted(map(tuple, table.join(counts, "k").collect()))
    monkeypatch.setattr(staging, "TASK_ROWS", 0)
    for least in (1, 300, 10**9):
        monkeypatch.setattr(staging, "HOT_ROWS", least)
        assert sorted(map(tuple, staging.join_by_count(table, counts, ["k"], "n", 3000).collect())) == want


@pytest.mark.parametrize("task_rows", [0, 1 << 20])
def test_a_star_of_many_nodes(spark, monkeypatch, task_rows):
    monkeypatch.setattr(staging, "TASK_ROWS", task_rows)
    edges = [(0, i) for i in range(1, 4000)] + [(5000 + i, 9000) for i in range(3000)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 4000)} | {i: 5000 for i in [*range(5001, 8000), 9000]}


def test_equal_fingerprints_and_a_line_that_all_texts_have(spark):
    n = 50_000
    docs = spark.range(n).selectExpr("id AS doc_id", "if(id % 3 = 0, ' ', concat('the same line\nown ', id)) AS text", "concat('s', id % 7) AS source")
    got = simhash.components(docs.filter("doc_id % 3 = 0 or doc_id < 30")).groupBy("component_id").count().collect()
    assert max(got, key=lambda r: r["count"])["component_id"] == 0 and max(r["count"] for r in got) >= n // 3
    lines = linespread.drop_shared_lines(docs, 5).agg({"n_removed": "sum"}).first()[0]
    assert lines == n - len(range(0, n, 3))


def test_very_long_texts(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    filler = " ".join(f"w{i}" for i in range(300_000))  # over two pieces of 1 MB
    docs = spark.createDataFrame([(1, filler + " " + item, "en"), (2, filler + " " + item + " end", "en"), (3, "A" * 3_000_000, "en"), (4, filler[:500], "en")], DOCS)
    items = spark.createDataFrame([("i1", item)], "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: (300_012, 12), 2: (300_013, 12), 3: (1, 0), 4: (len(filler[:500].split()), 0)}
    whole = simhash.text_fingerprint(docs.first()["text"], 3)
    words = (filler + " " + item).split()
    import xxhash

    hashes = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)], dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes))
    assert whole == [want]
    parts = {r["doc_id"]: r["component_id"] for r in simhash.components(docs).collect()}
    assert parts[1] == parts[2] == 1 and parts[3] == 3
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 5)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in quality.quality_scores(docs, labels).collect())


def test_very_long_urls_are_read_back(spark):
    pages = spark.createDataFrame([(1, "https://h/" + "x" * 3_000_000, "<p>"), (2, "https://h/y", "<p>")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"], len(r["url"])) for r in warc.round_trip(pages, min_bytes=0).collect()}
    assert got[1] == ("revisit", 2, 3_000_010) and got[2][0] == "response"
