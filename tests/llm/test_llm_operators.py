"""The operators against brute force on small awkward tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")

from leakflow.llm import bpe, decontaminate, kdtopk, linespread, mixing, packing, quality, secretfreq, simhash, warc  # noqa: E402
from leakflow.llm.components import connected_components  # noqa: E402

LOW = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["row_id", "fp0", "n_words", "n_words_", "key", "score", "stats", "s", "c0", "c1", "text_", "piv", "row_id_", "found_", "cdf__", "copy_no", "mix_key", "root"]


def awkward(spark, more=()):
    rnd = random.Random(5)
    words = ["alpha", "Beta", "gamma", "délta", "x1", "the", "of", "12", "Zed.", "so,"]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    base = text(60)
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "  \n\t ", None, None, None), (None, text(20), "fr", "b", 5), (5, base, "en", "a", 1), (6, base, "en", "b", 1), (6, base, "en", "b", 1)]
    rows += [(7, base + " tail", "en", "c", 1), (8, text(30000), "en", "a", 1), (9, "one", "en", "b", 1), (10, "One two", "en", "c", 1), (11, "é ñ 日本", "de", "d", 1)]
    rows += [(20 + i, text(rnd.randint(1, 80)) + "\n" + text(5), "en", rnd.choice("abcd"), 1) for i in range(40)]
    return spark.createDataFrame([*rows, *more], DOCS)


def with_clashes(df):
    for name in CLASH:
        df = df.selectExpr("*", f"'x' AS {name}") if name not in df.columns else df
    return df


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


# --- components


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 60)] + [(3000 + rnd.randint(0, 80), 3000 + rnd.randint(0, 80)) for _ in range(60)] + [(7, 7), (None, 4)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if None not in (a, b) and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 1 packing


def test_capacities_find_the_tightest_row():
    rnd = random.Random(2)
    tree, held = packing.Capacities(50), []
    for i in range(400):
        if rnd.random() < 0.5:
            c = rnd.randint(0, 50)
            tree.add(c, i)
            held.append(c)
        else:
            size = rnd.randint(0, 50)
            want = min((c for c in held if c >= size), default=None)
            got = tree.take(size)
            assert (got and got[0]) == want
            if got:
                held.remove(want)


def test_best_fit_decreasing_is_that_of_a_plain_search():
    rnd = random.Random(3)
    for length in (1, 7, 64):
        sizes = [rnd.randint(1, length) for _ in range(300)]
        rows_, free = [], []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fit = [r for r in range(len(free)) if free[r] >= sizes[i]]
            if fit:
                best = min(free[r] for r in fit)
                r = [x for x in fit if free[x] == best]
                r = r[0]
            else:
                rows_.append([])
                free.append(length)
                r = len(free) - 1
            rows_[r].append(i)
            free[r] -= sizes[i]
        got = packing.best_fit_decreasing(sizes, length)
        assert sorted(i for r in got for i in r) == list(range(300))
        assert sorted(sum(sizes[i] for i in r) for r in got) == sorted(length - f for f in free)


def test_packing_round_trip(spark):
    docs = with_clashes(awkward(spark))
    path = public_tokenizers.path("byte_bpe_50k.json")
    packs = packing.staged_packs(packing.pack(docs, path, length=64, pad_id=7, block_tokens=5000))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    want = sorted((r["doc_id"], tok.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect() if r["doc_id"] is not None and r["doc_id"] != 6 and r["text"])
    got = {}
    for r in sorted(packing.unpack(packs).collect(), key=lambda r: r["piece_start"]):
        if r["doc_id"] is not None and r["doc_id"] != 6:
            ids = got.setdefault(r["doc_id"], [])
            assert len(ids) == r["piece_start"] and 0 < len(r["ids"]) <= 64
            ids += r["ids"]
    assert sorted(got.items()) == want
    for r in packs.collect():
        ids, pos, cuts = np.frombuffer(r["token_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2"), r["cu_seqlens"]
        assert len(ids) == len(pos) == 64 and cuts[0] == 0 and cuts[-1] == r["n_tokens"] <= 64 and (ids[cuts[-1] :] == 7).all()
        assert pos.tolist() == [i for a, b in zip(cuts, [*cuts[1:], 64]) for i in range(b - a)][:64]
        assert len(cuts) == len(r["doc_ids"]) + 1 == len(r["piece_starts"]) + 1
    assert packs.select("pack_id").distinct().count() == packs.count()
    assert packing.pack(docs.limit(0), path).count() == 0


# --- 2 quality


def test_quality_rules(spark):
    rnd = random.Random(4)
    good = lambda: " ".join(rnd.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "do"]) for _ in range(60)) + "."
    bad = lambda: " ".join(rnd.choice(["SPAM!!", "BUY!!", "NOW$$$", "FREE###"]) for _ in range(60))
    docs = spark.createDataFrame([(i, good() if i % 3 else bad(), "en", "a", 1) for i in range(300)] + [(None, good(), "en", "a", 1), (900, None, None, None, None), (901, "", "en", "a", 0), (7, good(), "en", "a", 1)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(900, None, None), (None, 1, 0), (5000, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(with_clashes(docs), labels).toPandas()
    assert len(got) == 304 and got.score.between(0, 1).all() and got.predicted.equals((got.score >= 0.3).astype("int32"))
    import zlib

    assert all(r.held_out == (zlib.crc32(str(int(r.doc_id)).encode()) % 5 == 0) for r in got.dropna().itertuples())
    assert quality.accuracy(got, labels.toPandas()) > 0.98
    kept = quality.drop_rejected(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] % 3 for r in kept.filter("doc_id < 300").collect()} == {1, 2}
    none = quality.quality_scores(docs, labels.limit(0)).toPandas()
    assert (none.score == 0.5).all()
    one = quality.quality_scores(docs, labels.filter("quality = 1")).toPandas()
    assert (one.score > 0.99).all()
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_rules_compile_to_the_same_predicates(spark):
    sample = spark.createDataFrame([(("a " * i + "B!! " * (50 - i)), float(i > 25)) for i in range(50)], "text string, label double")
    stats = sample.select(quality.statistics("text").alias("stats"), "label")
    model = quality.fit(stats, trees=5)
    table = stats.select("stats.*", model.score("stats").alias("got")).toPandas()
    for r in table.itertuples():
        total = model.bias + sum(w for rule, w in model.rules if all(lo < r[1 + i] <= hi for i, (lo, hi) in rule.bounds.items()))
        assert abs(1 / (1 + np.exp(-total)) - r.got) < 1e-9


# --- 3 decontamination


def brute_hits(docs, items, window=10):
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pat.findall((t or "").translate(LOW))
    found = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            found.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for key, text in docs:
        w, hit, which = words(text), set(), set()
        for n in {len(k) for k in found}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in found:
                    hit |= set(range(i, i + n))
                    which |= found[tuple(w[i : i + n])]
        names = sorted(str(x) for x in which if x is not None)
        out.append((key, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_winnowing_is_brute_force(spark):
    rnd = random.Random(6)
    vocab = ["aa", "Bb", "cé", "d1", "日本", "e", "ff"]
    text = lambda n: "".join(rnd.choice(vocab) + rnd.choice([" ", ", ", "-\n"]) for _ in range(n))
    items = [(1, text(12)), (2, text(25)), (3, "aa Bb"), (4, ""), (5, None), (None, text(15)), (10, text(9)), (2, text(11)), (11, "solo")]
    docs = [(i, text(rnd.randint(0, 40))) for i in range(60)] + [(100, items[0][1]), (101, "x " + items[1][1].upper() + " y"), (102, None), (103, ""), (104, "q" * 3_000_000), (105, "SOLO."), (None, items[5][1]), (106, " ".join(t or "" for _, t in items)), (100, items[0][1])]
    docs += [(200, "x " * 5 + "".join(t + " " for t in ["aa"] * 30)), (201, text(20) + items[1][1][: len(items[1][1]) // 2])]
    got = decontaminate.contamination(with_clashes(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute_hits(docs, items)
    none = spark.createDataFrame([], "item_id long, text string")
    frame = awkward(spark)
    assert decontaminate.contamination(frame, none).filter("contaminated").count() == 0
    assert decontaminate.contamination(frame.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    kept = decontaminate.drop_contaminated(frame, spark.createDataFrame([(1, frame.filter("doc_id = 5").first()["text"])], "item_id long, text string"))
    assert kept.columns == frame.columns and not {5, 6, 7} & {r["doc_id"] for r in kept.collect()} and kept.filter("doc_id = 9").count() == 1


# --- 4 line spread


def test_line_spread_is_exact(spark):
    rnd = random.Random(8)
    pool = [f"line {i}" for i in range(30)]
    data = [(i, "\n".join(rnd.choice(["  ", ""]) + pool[min(29, int(rnd.expovariate(0.15)))] + rnd.choice([" ", ""]) for _ in range(6)), "en", rnd.choice("abcdefghijkl"), 1) for i in range(80)]
    data += [(100, None, "en", "a", 1), (101, "", "en", None, 1), (102, "\n\n", None, "a", 1), (None, "line 0\nother", "en", None, 1), (5, "line 1", "en", "z", 1), (5, "line 1", "en", "z", 1)]
    for sites in (2, 6, 9):
        spread = {}
        for _, t, _, s, _ in data:
            for x in (t or "").split("\n"):
                spread.setdefault(x.strip(" "), set()).add(s)
        bad = {k for k, v in spread.items() if k and len(v - {None}) >= sites}
        want = []
        for key, t, *_ in data:
            lines = [] if t is None else t.split("\n")
            kept = [x for x in lines if x.strip(" ") not in bad]
            want.append((key, len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)))
        got = linespread.drop_shared_lines(with_clashes(spark.createDataFrame(data, DOCS)), sites)
        assert rows(got, "doc_id", "n_lines", "n_removed", "clean_text") == sorted(want, key=repr)
    assert linespread.drop_shared_lines(spark.createDataFrame([], DOCS)).count() == 0


# --- 5 SimHash


def brute_fingerprint(text, shingle):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(data, shingle=3, radius=2):
    prints = [brute_fingerprint(t, shingle) for _, t in data]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(data):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((k, f"{p:016x}", least.get(find(i))) for i, ((k, _), p) in enumerate(zip(data, prints))), key=repr)


def test_simhash_components_are_brute_force(spark):
    docs = with_clashes(awkward(spark))
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows(simhash.components(docs), "doc_id", "fingerprint", "component_id") == brute_components(data)
    assert simhash.components(docs.limit(0)).count() == 0


def test_hot_buckets_lose_no_connection(spark):
    rnd = random.Random(9)
    seeds = [rnd.getrandbits(64) for _ in range(4)]
    prints = set(seeds)
    for s in seeds[:2]:
        for _ in range(150):
            s ^= 1 << rnd.randint(0, 30) ^ 0
            prints.add(s)
    prints |= {0, (1 << 64) - 1, 1 << 63, 3 << 62}
    prints = sorted(prints)
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    nodes = spark.createDataFrame(signed, "row_id long, fp0 long")
    got = {r["node"]: r["root"] for r in connected_components(simhash.links(nodes, 1, 2, bucket=4)).collect()}
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(len(prints)) if find(i) != i}
    pairs = {tuple(sorted((r["u"], r["v"]))) for r in simhash.links(nodes, 1, 2, bucket=10_000).collect()}
    assert pairs == {(j, i) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2}


def test_large_buckets_of_wide_fingerprints_lose_no_connection(spark):
    rnd = random.Random(12)
    start = [rnd.getrandbits(64) for _ in range(2)]
    prints = []
    for _ in range(3):  # chains whose ends are far apart, all with the same low half of the first word
        now = [start[0] ^ rnd.getrandbits(32) << 32, rnd.getrandbits(64)]
        for _ in range(40):
            now = [now[0] ^ 1 << rnd.randint(32, 63) ^ 1 << rnd.randint(32, 63), now[1] ^ 1 << rnd.randint(0, 63) ^ 1 << rnd.randint(0, 63) ^ 1 << rnd.randint(0, 63)]
            prints.append(tuple(now))
    prints = sorted(set(prints))
    signed = [(i, *(p - (1 << 64) if p >> 63 else p for p in ps)) for i, ps in enumerate(prints)]
    nodes = spark.createDataFrame(signed, "row_id long, fp0 long, fp1 long")
    apart = lambda i, j: sum((a ^ b).bit_count() for a, b in zip(prints[i], prints[j]))
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if apart(i, j) <= 6:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    want = {i: find(i) for i in range(len(prints)) if find(i) != i}
    for part in (10, 512):
        found = simhash.links(nodes, 2, 6, parts=2, same=1, bucket=4, part=part).collect()
        assert all(apart(r["u"], r["v"]) <= 6 for r in found)
        edges = spark.createDataFrame(found, "u long, v long")
        assert {r["node"]: r["root"] for r in connected_components(edges).collect()} == want


def test_near_duplicates_go_and_others_stay(spark):
    rnd = random.Random(10)
    vocab = [f"w{i}" for i in range(3000)]
    data = []
    for i in range(40):
        words = rnd.choices(vocab, k=300)
        data.append((10 * i, " ".join(words)))
        if i < 20:
            for k in range(3):
                near = list(words)
                for _ in range(2):
                    near[rnd.randrange(300)] = "changed"
                data.append((10 * i + 1 + k, " ".join(near)))
    data += [(5000, data[0][1]), (5000, data[0][1]), (None, data[0][1]), (6000, None), (6001, "")]
    docs = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in data], DOCS)
    kept = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect())
    assert set(10 * i for i in range(40)) <= set(kept) and 6000 in kept and 6001 not in kept and 5000 not in kept and None not in kept
    assert len(kept) <= 41 + 3


def test_whole_rows_pass_whatever_their_columns_are_called(spark):
    docs = with_clashes(awkward(spark))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20, 60)], "doc_id long, quality int, toxic int")
    item = spark.createDataFrame([(1, docs.filter("doc_id = 5").first()["text"])], "item_id long, text string")
    for made in (quality.drop_rejected(docs, labels, 0.0), simhash.drop_near_duplicates(docs), decontaminate.drop_contaminated(docs, item)):
        assert made.columns == docs.columns and 9 in {r["doc_id"] for r in made.collect()} and {r["key"] for r in made.collect()} == {"x"}
    mixed = mixing.mix(docs, {}, epochs=5.0)
    assert sorted(mixed.columns) == sorted(docs.columns) and dict(mixed.dtypes)["copy_no"] == "bigint" and mixed.count() > 0
    scored = quality.with_score(docs, quality.RuleEnsemble(0.0, []))
    assert sorted(scored.columns) == sorted(docs.columns) and {r["score"] for r in scored.collect()} == {0.5}


# --- 6 token counts


def test_token_counts_are_the_librarys(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, rnd = Tokenizer.from_file(path), random.Random(11)
    signs = [*"aab'stredvlm  \n\t́éßñ½²१3x!_-.,\x1c\x85日本😀", "'s", "'re", "'ll", "n't", "<|endoftext|>", " ' s"]
    texts = ["".join(rnd.choices(signs, k=rnd.randint(0, 60))) for _ in range(400)] + [None, "", "a" * 5000, "ab" * 3000, " \n \n ", ("word " * 300_000)]
    frame = with_clashes(spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "x"), (3, texts[3])], "doc_id long, text string"))
    want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in [*enumerate(texts), (None, "x"), (3, texts[3])]]
    assert rows(bpe.token_counts(frame, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert bpe.token_counts(frame.limit(0), path).count() == 0


# --- 7 WARC


def test_warc_round_trip(spark):
    pages = [(i, f"http://h/{i % 7}", f"<p>{i % 5}</p>" if i % 3 else f"<p>{i}é</p>") for i in range(60)]
    pages += [(100, None, None), (101, "http://x/\r\n y", ""), (None, "u", "<p>1</p>"), (59, "u", pages[59][2]), (102, "u", "z" * 2_000_000), (None, "u", "only")]
    for least in (0, 9):
        got = warc.round_trip(with_clashes(spark.createDataFrame(pages, "page_id long, url string, html string")), least)
        best, count = {}, {}
        for key, _, html in pages:
            h = html or ""
            count[h] = count.get(h, 0) + 1
            if key is not None:
                best[h] = max(best.get(h, key), key)
        want = []
        for key, _, html in pages:
            h = html or ""
            other = best.get(h) if len(h.encode()) >= least and count[h] > 1 else None
            revisit = other is not None and other != key
            want.append((key, len(h.encode()), warc.digest(h.encode()), "revisit" if revisit else "response", other if revisit else None))
        assert rows(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_reader_finds_faults():
    import gzip
    import io

    one, two = warc.record(1, "http://a/", b"hello"), warc.record(2, "http://b/", b"x" * 100_000)
    read = list(warc.read_records(io.BytesIO(one + two).read, with_payload=True))
    assert [r.payload for r in read] == [b"hello", b"x" * 100_000]
    assert all(r.fields["warc-type"] == "response" for r in read)
    small = io.BytesIO(one + two)
    assert len(list(warc.read_records(lambda n: small.read(7)))) == 2
    plain = gzip.decompress(one)
    for broken in (plain.replace(b"hello", b"jello"), plain[:-4], re.sub(rb"msgtype=response\r\nContent-Length: \d+", b"msgtype=response\r\nContent-Length: 900", plain), plain + b"more", b"HTTP" + plain[4:]):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(gzip.compress(broken)).read))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO((one + two)[:-20]).read))


# --- 8 top-k


def test_top_k_is_brute_force(spark):
    rnd = np.random.default_rng(12)
    data = [(i, [float(x) for x in rnd.integers(-2, 3, 6) / 8]) for i in range(700)]
    data += [(1000, None), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1200, [float("nan")] * 6), (1300, [float("inf")] * 6), (None, [1.0] * 6), (300, data[5][1]), (300, data[5][1]), (1400, [1.0, 2.0]), (1401, [0.5, 1e4]), (1500, [])]
    got = kdtopk.top_k(with_clashes(spark.createDataFrame(data, "vec_id long, embedding array<float>")), shard_rows=200)
    good = [(k, np.floor(np.array(v, np.float32).astype(float) * 1024).astype(int)) for k, v in data if k is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for i, (k, q) in enumerate(good):
        if k % 100 == 0:
            scored = sorted((-int(q @ v), o) for j, (o, v) in enumerate(good) if j != i and len(v) == len(q))
            want += [(k, r + 1, o, -s) for r, (s, o) in enumerate(scored[:10])]
    assert rows(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert kdtopk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- 9 mixing


def test_mixing_replicates_to_weights(spark):
    rnd = random.Random(13)
    data = [(i, "x" * rnd.randint(5, 15), "en", "big" if i % 3 else f"s{i % 7}", 1) for i in range(6000)]
    docs = spark.createDataFrame(data, DOCS)
    weights = {"big": 3.0, "s0": 0.0, "s1": 2.0}
    got = mixing.mix(docs, weights).toPandas()
    sizes = got.assign(n=got.text.str.len()).groupby("source").n.sum()
    total = sum(len(d[1]) for d in data)
    all_weights = 3.0 + 2.0 + 5
    for s, w in {"big": 3, "s1": 2, "s2": 1, "s3": 1}.items():
        assert abs(sizes[s] / total - w / all_weights) < 0.15 * w / all_weights + 0.01
    assert "s0" not in sizes
    assert got.groupby("doc_id").copy_no.apply(lambda c: sorted(c) == list(range(1, len(c) + 1))).all()
    again = mixing.mix(docs.repartition(7), weights).toPandas()
    key = ["doc_id", "copy_no", "mix_key"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    odd = spark.createDataFrame([(None, "abc", "en", None, 1), (1, None, "en", "a", 1), (2, "", "en", "b", 1), (3, "abc", "en", "a", 1), (3, "abc", "en", "a", 1)], DOCS)
    assert set(mixing.mix(odd, {}, epochs=40.0).toPandas().source) == {None, "a"}
    assert mixing.mix(odd.limit(0), {}).count() == 0


def test_poisson_inversion(spark):
    from math import exp, factorial

    from pyspark.sql import functions as F

    for rate in (0.3, 2.5, 30.0):
        cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(rate)).alias("c")).first()["c"]
        want = np.cumsum([exp(-rate) * rate**k / factorial(k) for k in range(len(cdf))])
        assert np.allclose(cdf, want) and cdf[-1] > 1 - 1e-14


def test_many_sources_take_the_salted_join(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 9, "en", f"s{i % 50}", 1) for i in range(500)], DOCS)
    want = rows(mixing.mix(docs, {}), "doc_id", "copy_no", "mix_key")
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    assert rows(mixing.mix(docs, {}), "doc_id", "copy_no", "mix_key") == want


# --- 10 secrets


def brute_secrets(data):
    assign = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    access, hexes, owned = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+"), re.compile(r"[A-Za-z0-9+/_-]{20,}")
    found, holders = [], {}
    for key, text, owner, repo in data:
        t = text or ""
        spans = [(m.start(), 0, "assign", m.end(), m[2]) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, "access", m.end(), m[0]) for m in access.finditer(t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end(), m[0]) for m in hexes.finditer(t) if len(m[0]) >= 24]
        more = [(m.start(), 3, "owned", m.end(), m[0]) for m in owned.finditer(t) if all(re.search(p, m[0]) for p in ("[A-Z]", "[a-z]", "[0-9]")) and not any(a < m.end() and m.start() < b for a, _, _, b, _ in spans)]
        found.append((key, spans, more))
        for s in spans + more:
            holders.setdefault(s[4], set()).add((owner, repo))
    live = lambda s: len({o for o, _ in holders[s[4]]}) <= 1 and len(holders[s[4]]) <= 2
    listed = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, k, b, _ in sorted(spans))
    out = []
    for key, spans, more in found:
        count = [sum(s[1] == i for s in spans) for i in range(3)]
        out.append((key, *count, hashlib.sha256(listed(spans).encode()).hexdigest(), listed(spans + [m for m in more if live(m)]), sum(map(live, spans + more)), sum(not live(s) for s in spans + more)))
    return sorted(out, key=repr)


def test_secret_spans_are_brute_force(spark):
    rnd = random.Random(14)
    body = lambda n, signs="abcdefghijABCDEFGHIJ0123456789": "".join(rnd.choices(signs, k=n))
    shared, key = body(24) + "aB1", "AK" + "IA" + body(16, "ABC123")
    parts = ["pass" + "word = ", "TOKEN:", "api_key='", "Secret\" : ", "passwd=", key, "AKIA", body(24, "0123abcdef"), body(30, "0123abcdef"), shared, "é😀 ", "\n", " ", "token=tok", body(25) + "zZ9", "pass" + "word=token :abcdefgh", "ſecret=abcdefgh"]
    data = [(i, "".join(rnd.choice(parts) if rnd.random() < 0.6 else body(rnd.randint(1, 12)) for _ in range(rnd.randint(0, 14))), rnd.choice("abc"), rnd.choice("xyz")) for i in range(120)]
    data += [(200, None, "a", "x"), (201, "", None, None), (None, "token=" + shared, None, "x"), (1, data[1][1], data[1][2], data[1][3])]
    docs = spark.createDataFrame([(k, t, r, o, 1) for k, t, o, r in data], DOCS)
    want = brute_secrets([(k, t, o, (o, r)) for k, t, o, r in data])
    got = secretfreq.scan(with_clashes(docs))
    assert rows(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_copied") == want
    assert secretfreq.scan(docs.limit(0)).count() == 0


# --- hard cases: hashes that collide, very long texts, tiny sources, repeated labels


def test_colliding_hashes_change_no_tokens():
    from tokenizers import Tokenizer

    path, rnd = public_tokenizers.path("byte_bpe_50k.json"), random.Random(21)
    merges, tok = bpe.Merges(path), Tokenizer.from_file(path)
    merges.hash_bits = 6
    for _ in range(3):
        texts = [" ".join("".join(rnd.choices("abcdeé ", k=rnd.randint(1, 9))) for _ in range(60)) for _ in range(20)]
        ids, counts = merges.encode(texts)
        want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_secrets_of_a_very_long_text(spark):
    rnd = random.Random(22)
    hexes = ["".join(rnd.choices("0123456789abcdef", k=24)) for _ in range(20_000)]
    text = "\n".join(h + (" token=Abcdef12" if i % 3 else " Qq1" + h[:20] + "Z ") for i, h in enumerate(hexes))
    docs = spark.createDataFrame([(1, text, "en", "a", 1), (2, "x", "en", "a", 1)], DOCS)
    want = brute_secrets([(1, text, "a", ("a", "en")), (2, "x", "a", ("a", "en"))])
    assert rows(secretfreq.scan(docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_copied") == want


def test_secrets_that_are_everywhere_are_broadcast(spark, monkeypatch):
    data = [(i, "token=abcdef123 " + ("token=only%06d" % i), "en", f"s{i % 3}", 1) for i in range(200)]
    docs = spark.createDataFrame(data, DOCS)
    cols = ["doc_id", "spans", "n_live", "n_copied"]
    plain = rows(secretfreq.scan(docs), *cols)
    monkeypatch.setattr(secretfreq, "HOT_PLACES", 50)
    assert rows(secretfreq.scan(docs), *cols) == plain and {r[2:] for r in plain} == {(1, 1)}


def test_lines_of_a_very_long_text(spark):
    lines = [f"line {i}" for i in range(30_000)]
    data = [(i, "\n".join(lines[i % 2 :: 1]), "en", f"s{i}", 1) for i in range(5)] + [(9, "own\n" + "\n".join(lines[:3]), "en", "s0", 1)]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["clean_text"]) for r in linespread.drop_shared_lines(spark.createDataFrame(data, DOCS), 5).collect()}
    assert got[0] == (30_000, 29_999, "line 0") and got[1] == (29_999, 29_999, "") and got[9] == (4, 2, "own\nline 0")


def test_a_tiny_source_beside_a_large_one(spark):
    from math import sqrt

    data = [(1, "x", "en", "tiny", 1), (2, "y" * 300_000, "en", "large", 1), (3, "z" * 300_000, "en", "large", 1)]
    got = mixing.mix(spark.createDataFrame(data, DOCS), {}).select("doc_id", "copy_no", "mix_key").toPandas()
    rate = 600_001 / 2
    n = int((got.doc_id == 1).sum())
    assert abs(n - rate) < 6 * sqrt(rate) and not got.duplicated(["doc_id", "copy_no"]).any()
    # by hand: the parts' draws
    parts = -(-600_001 // (2 * 64))
    part_rate, want = rate / parts, 0
    cdf, p = [], np.exp(-part_rate)
    for k in range(300):
        cdf.append(p if not cdf else cdf[-1] + p)
        p *= part_rate / (k + 1)
    for i in range(parts):
        key = "17:1" if i == 0 else f"17:1:part {i}"
        u = (int(hashlib.md5(key.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        want += int(np.searchsorted(cdf, u, side="left"))
    assert n == want


def test_repeated_ids_and_labels_stay_within_the_sample(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i % 600} " + "w " * (i % 50), "en", "a", 1) for i in range(1800)], DOCS)
    labels = spark.createDataFrame([(i % 5, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    sample = quality.labelled_sample(with_clashes(docs), labels, max_rows=100)
    assert sample.count() == 100
    assert quality.labelled_sample(docs, labels.filter("false")).count() == 0
    long = spark.createDataFrame([(1, "A" * 3_000_000, "en", "a", 1), (2, "good words here " * 200_000, "en", "a", 1)], DOCS)
    assert quality.with_score(long, quality.RuleEnsemble(0.0, [(quality.Rule({0: (1.0, np.inf)}), 1.0)])).filter("score > 0.5").count() == 2


def test_archives_open_with_info_and_ids_are_unique(spark, tmp_path):
    pages = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, "http://c/", "own"), (4, "http://d/", "twice"), (4, "http://d/", "twice"), (5, "u", ""), (None, None, "")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    files = warc.write_archives(warc.with_revisits(frame), str(tmp_path))
    records = [(i, r.fields) for row in files.collect() for i, r in enumerate(warc.read_records(open(tmp_path / row["file"], "rb").read))]
    assert all((f["warc-type"] == "warcinfo") == (i == 0) for i, f in records)
    ids = [f["warc-record-id"] for _, f in records]
    assert len(set(ids)) == len(ids)
    (revisit,) = [f for _, f in records if f["warc-type"] == "revisit" and f.get("page-id") == "1"]
    (response,) = [f for _, f in records if f.get("page-id") == "2"]
    assert revisit["warc-refers-to"] == response["warc-record-id"] and revisit["warc-refers-to-target-uri"] == "http://b/" and revisit["warc-refers-to-date"] == response["warc-date"]
    assert sum(f["warc-type"] == "response" and f.get("page-id") == "4" for _, f in records) == 2


def test_top_k_of_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(kdtopk, "BLOCK_ROWS", 3)
    monkeypatch.setattr(kdtopk, "TASK_BLOCKS", 1)
    rnd = np.random.default_rng(23)
    data = [(i, [float(x) for x in rnd.normal(size=4)]) for i in range(900)]
    got = kdtopk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<float>"), every=10, shard_rows=100)
    q = np.floor(np.array([v for _, v in data], np.float32).astype(float) * 1024).astype(int)
    want = []
    for i in range(0, 900, 10):
        scored = sorted((-int(q[i] @ q[j]), j) for j in range(900) if j != i)
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:10])]
    assert rows(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
