"""The pipeline's stages, each on its own input, against brute-force versions."""

import hashlib
import math
import os
import re

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from leakflow.llm import packing, quality, queries, simhash, staging  # noqa: E402
from leakflow.llm.staging import stage  # noqa: E402
from test_llm_operators import brute_hits  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        made = stage(step(spark, docs, SF), name)
        out.append((name, docs, made))
        docs = made
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_all_but_the_last_return_documents(stages):
    assert [n for n, *_ in stages] == ["quality", "near_duplicates", "decontamination", "mixing", "packing"]
    assert all(made.columns == docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] for _, docs, made in stages[:-1])


def test_quality_stage_keeps_what_scores(spark, stages):
    _, docs, made = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(quality.labelled_sample(docs, labels))
    stats = {}
    for r in docs.select("doc_id", quality.statistics("text").alias("s")).collect():
        total = model.bias + sum(w for rule, w in model.rules if all(lo < r["s"][i] <= hi for i, (lo, hi) in rule.bounds.items()))
        stats[r["doc_id"]] = 1 / (1 + math.exp(-total))
    assert {r["doc_id"] for r in made.collect()} == {k for k, s in stats.items() if s >= 0.3}
    marked = {r["doc_id"]: r["quality"] for r in labels.collect()}
    kept = {r["doc_id"] for r in made.collect()}
    wrong = [k for k in stats if k in marked and (k in kept) != bool(marked[k])]
    assert len(wrong) <= 0.03 * len(marked)


def test_near_duplicate_stage_keeps_one_of_each_group(stages):
    _, docs, made = stages[1]
    data = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    prints = {k: int.from_bytes(b"".join(w.to_bytes(8, "little") for w in simhash.text_fingerprint(t, 5, 8)), "little") for k, t in data}
    keys = sorted(prints)

    def firsts(radius):
        """The smallest id of each group that pairs within ``radius`` make."""
        parent = {k: k for k in prints}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, a in enumerate(keys):
            for b in keys[:i]:
                if (prints[a] ^ prints[b]).bit_count() <= radius:
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
        return {k for k in keys if find(k) == k}

    kept = {r["doc_id"] for r in made.collect()}
    # nothing goes without a partner within the radius, and all close copies go
    assert firsts(simhash.radius_for(0.8, 8)) <= kept <= firsts(simhash.radius_for(0.9, 8))


def test_decontamination_stage_drops_hits(spark, stages):
    _, docs, made = stages[2]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {x[0] for x in brute_hits([(r["doc_id"], r["text"]) for r in docs.collect()], items) if not x[5]}
    assert rows(made) == rows(docs.filter(docs.doc_id.isin(list(clean))))


def test_mixing_stage_inverts_the_poisson_distribution(stages):
    _, docs, made = stages[3]
    data = docs.collect()
    size = {}
    for r in data:
        size[r["source"]] = size.get(r["source"], 0) + len(r["text"])
    weight = {s: queries.SOURCE_WEIGHTS.get(s, 1.0) for s in size}
    want = []
    for r in data:
        rate = sum(size.values()) * weight[r["source"]] / sum(weight.values()) / size[r["source"]]
        u = (int(hashlib.md5(f"17:{r['doc_id']}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n, p = 0, math.exp(-rate)
        left = p
        while left < u:
            n += 1
            p *= rate / n
            left += p
        want += [tuple(r)] * n
    assert rows(made) == sorted(want, key=repr)


def test_packing_stage_is_lossless(stages):
    from tokenizers import Tokenizer

    _, docs, made = stages[4]
    tok = Tokenizer.from_file(queries.vocabulary_path())
    tok.encode_special_tokens = True
    want = {}
    for r in docs.collect():
        want.setdefault(r["doc_id"], []).append(tok.encode(r["text"], add_special_tokens=False).ids)
    pieces = {}
    for r in packing.unpack(made).collect():
        pieces.setdefault((r["doc_id"], r["piece_start"]), []).append(r["ids"])
    for key, copies in want.items():
        for start in range(0, len(copies[0]), queries.PACK_LENGTH):
            assert pieces.pop((key, start)) == [copies[0][start : start + queries.PACK_LENGTH]] * len(copies)
    assert not pieces


def test_near_duplicates_are_exactly_the_pairs_at_the_similarity(spark):
    import random

    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(10**9)}"
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    data, alike, other = [], set(), set()
    for i in range(400):  # pairs of which one has a longer tail, so that the similarity is that of their lengths
        same = rnd.randint(100, 400)
        a = [word() for _ in range(same + 4)]
        b = a + [word() for _ in range(round(same / (0.8 + 0.001 * (i % 40) if i < 200 else 0.72 + 0.001 * (i % 78)) - same))]
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        (alike if len(x & y) / len(x | y) >= 0.8 else other).add(2 * i + 1)
        data += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    assert len(alike) > 150 and len(other) > 150
    start = [word() for _ in range(104)]  # a group that fills its buckets: 60 copies within the similarity of the first, 60 beyond that of all
    data.append((1000, " ".join(start)))
    for i in range(60):
        data.append((1001 + i, " ".join(start + [word() for _ in range(5)])))
        data.append((1101 + i, " ".join(start + [word() for _ in range(40)])))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    assert not kept & alike and other <= kept and set(range(0, 800, 2)) <= kept
    assert 1000 in kept and not kept & set(range(1001, 1061)) and set(range(1101, 1161)) <= kept


def test_large_groups_lose_no_link(spark):
    import random

    from leakflow.llm import jaccard
    from leakflow.llm.components import connected_components

    rnd = random.Random(31)
    sets = [set(rnd.sample(range(10**9), 100))]
    for i in range(240):  # copies of copies, so that groups are chains, rings around a middle, and near misses
        old = list(rnd.choice(sets[: 1 + i // 3]))
        gone = rnd.randint(1, 14)
        rnd.shuffle(old)
        sets.append(set(old[gone:]) | set(rnd.sample(range(10**9), gone)))
    texts = [" ".join(f"w{x}" for x in sorted(s)) for s in sets]
    hashed = [set(jaccard.shingle_set(t, 1).tolist()) for t in texts]
    rows_ = [(i, len(hashed[i]), jaccard.band_keys(jaccard.shingle_set(t, 1)), t) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows_, "row_id long, size long, bands array<long>, text_ string").cache()
    bands = [set(r[2]) for r in rows_]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if len(hashed[i] & hashed[j]) >= 0.8 * len(hashed[i] | hashed[j]) and bands[i] & bands[j]:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    want = {i: find(i) for i in range(len(sets)) if find(i) != i}
    for hubs, part in ((6, 512), (6, 10), (1, 10)):
        was, jaccard.HUBS = jaccard.HUBS, hubs
        near = jaccard.links(table.select("row_id", "size", "bands"), table.select("row_id", "text_"), 1, 0.8, part=part).collect()
        jaccard.HUBS = was
        assert all(len(hashed[r["u"]] & hashed[r["v"]]) >= 0.8 * len(hashed[r["u"]] | hashed[r["v"]]) for r in near)
        got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(near, "u long, v long")).collect()}
        assert all(got.get(i, i) == got.get(r, r) for i, r in want.items())


def test_stages_take_nulls_empty_tables_and_clashing_names(spark):
    from test_llm_operators import awkward, with_clashes

    base = awkward(spark)
    odd, n = with_clashes(base), base.count()
    for name, step in corpus_pipeline.STAGES:
        made = step(spark, odd, SF)
        assert step(spark, base.limit(0), SF).count() == 0, name
        if name == "packing":
            assert made.count() > 0
            continue
        assert sorted(made.columns) == sorted(odd.columns), name
        got = made.collect()
        assert (0 < len(got) <= n) or name == "mixing", name
        assert all(r["fp0"] == "x" for r in got), name
        if name == "decontamination":  # no text of the awkward table is a passage of the benchmark
            assert len(got) == n


def test_the_whole_run_on_awkward_rows(spark, tmp_path):
    import shutil

    from test_llm_operators import awkward

    for table in ("benchmark", "labels"):
        shutil.copy(f"{SF}/{table}.parquet", tmp_path)
    awkward(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    awkward(spark).limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_fingerprints_and_pivot_cells_lose_no_pair_at_the_similarity():
    import numpy as np

    from leakflow.llm import jaccard

    rng = np.random.default_rng(11)
    for same, more, other in ((4, 1, 0), (8, 1, 1), (40, 5, 5), (300, 75, 0), (300, 30, 45)):
        for _ in range(40):
            h = rng.integers(0, 2**64, same + more + other, dtype=np.uint64)
            counts = np.stack([simhash.majorities([x], 8) for x in (h[: same + more], np.delete(h, range(same, same + more)))])
            a, b = simhash.fingerprint(counts)
            assert np.bitwise_count(a ^ b).sum() <= jaccard.RADIUS
            x, y = simhash.cell_keys(simhash.pivot_cells(counts))
            assert (x == y).any() and x.tolist() == jaccard.band_keys(h[: same + more])
    counts = np.stack([simhash.majorities([rng.integers(0, 2**64, 200, dtype=np.uint64)], 8) for _ in range(200)])
    keys = simhash.cell_keys(simhash.pivot_cells(counts))
    assert len(np.unique(keys)) > 0.999 * keys.size  # what is unrelated meets by chance alone, 2^-24 a key


def test_buckets_are_cut_by_the_distance_to_their_pivot(spark):
    import numpy as np

    from leakflow.llm import jaccard
    from leakflow.llm.components import connected_components

    rng = np.random.default_rng(12)
    flip = lambda bits, n: np.bitwise_xor(bits, np.isin(np.arange(512), rng.choice(512, n, replace=False)))
    middle = [rng.random(512) < 0.5 for _ in range(6)]
    bits = [flip(middle[0], int(rng.integers(0, 60))) for _ in range(20)]  # a bucket with a large piece, a small one, and others
    bits += [flip(middle[1], int(rng.integers(0, 60))) for _ in range(4)] + middle[2:5]
    bits += [flip(middle[5], int(rng.integers(0, 60))) for _ in range(3)] + [rng.random(512) < 0.5]  # a small bucket
    words = np.packbits(np.array(bits), axis=1, bitorder="little").view(np.int64)
    prints = spark.createDataFrame([(i, *map(int, w)) for i, w in enumerate(words)], "row_id long, " + ", ".join(f"fp{i} long" for i in range(8)))
    band = lambda i: 1 if i < 27 else 2
    members = spark.createDataFrame([(band(i), i, 100, 27 if i < 27 else 4, 0 if i < 27 else 27) for i in range(31)], "band long, row_id long, size long, n long, first long")
    found = jaccard._candidates(members, prints, 0.8)
    got = {r["node"]: r["root"] for r in connected_components(found).collect()}
    near = {(i, j) for i in range(31) for j in range(i) if band(i) == band(j) and (bits[i] ^ bits[j]).sum() <= jaccard.RADIUS}
    assert len(near) > 150 and all(got.get(i, i) == got.get(j, j) for i, j in near)
    assert sorted(i for i in range(31) if got.get(i, i) == i) == [0, 20, 24, 25, 26, 27, 30]


def test_rows_of_large_groups_do_not_grow_with_bands_or_parts(spark):
    import numpy as np

    from leakflow.llm import jaccard
    from leakflow.llm.components import connected_components

    words = "row_id long, " + ", ".join(f"fp{i} long" for i in range(8))
    prints = spark.createDataFrame([(i, *([1 << i] * 8)) for i in range(40)], words)
    members = spark.createDataFrame([(band, i, 100, 40, 0) for band in range(100) for i in range(40)], "band long, row_id long, size long, n long, first long")
    assert jaccard._candidates(members, prints, 0.8).count() == 39  # not one for each band

    rng = np.random.default_rng(13)
    common = rng.integers(0, 10**9, 200)
    sets = [np.append(common, rng.integers(10**9, 2 * 10**9, 5 if i < 200 else 120)) for i in range(210)]  # the last ten are like nobody
    sets += [np.append(common, np.array([1, 2, 3])), np.append(common[:180], np.array([1, 2, 3]))]
    table = spark.createDataFrame([(i, len(s), [7], " ".join(f"w{x}" for x in s)) for i, s in enumerate(sets)], "row_id long, size long, bands array<long>, text_ string")
    was, jaccard.HUBS = jaccard.HUBS, 0
    near = stage(jaccard.links(table.select("row_id", "size", "bands"), table.select("row_id", "text_"), 1, 0.8, part=20), "links")
    jaccard.HUBS = was
    roots = {r["node"]: r["root"] for r in connected_components(near).collect()}
    assert set(roots) == {*range(1, 200), 210, 211} and set(roots.values()) == {0}
    assert near.count() < 500  # two parts in a task each would make some 20 links for each of 66 tasks


def test_near_duplicates_broadcast_bits_and_large_groups_alone(spark, monkeypatch):
    """Spark would collect tables of up to 10 MB in the driver, many at a time."""
    from leakflow.llm import components, jaccard

    plans = []

    def told(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return stage(df, label)

    for module in (components, jaccard):
        monkeypatch.setattr(module, "stage", told)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = simhash.drop_near_duplicates(docs)
    plans.append(("kept", made._jdf.queryExecution().executedPlan().toString()))
    built = {key for _, plan in plans for key in re.findall(r"BroadcastHashJoin \[(\w+)", plan)}
    assert len(plans) > 15 and built <= {"shiftright", "group"}  # bits, and the names of large groups
    assert sum(label == "edges" and "Join" in plan for label, plan in plans) <= 2  # those that components begin with: a round is windows alone
    assert 0 < made.count() < docs.count()


def test_marked_rows_are_those_of_the_ids(spark, monkeypatch):
    ids = [*range(0, 300, 3), 63, 127, (7 << 33) + 63, (7 << 33) + 64, 1 << 40]
    rows = spark.createDataFrame([(i, f"t{i}") for i in [*range(400), *((7 << 33) + j for j in range(130))]], "row_id long, t string")
    flagged = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2 == 1) for i in sorted(set(ids))], "row_id long, odd boolean")
    want = sorted((r["row_id"], r["t"], r["row_id"] % 5 != 0 and r["row_id"] % 2 == 1) for r in rows.collect() if r["row_id"] in ids)
    for most in (100_000, 0):
        monkeypatch.setattr(staging, "MARKS", most)
        assert sorted(map(tuple, staging.marked(rows, flagged, "odd").collect())) == want
        repeated = flagged.unionByName(flagged).select("row_id")
        assert sorted(r[0] for r in staging.marked(rows, repeated).collect()) == [x[0] for x in want]
        assert sorted(r[0] for r in staging.marked(rows, repeated, apart=True).collect()) == sorted(r["row_id"] for r in rows.collect() if r["row_id"] not in ids)
