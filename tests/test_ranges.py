"""Large files by byte ranges, and windows that a watermark closes."""

import random
from datetime import datetime, timedelta

import pytest

from leakflow.session import new_path
from leakflow.sources import ranges
from leakflow.streaming import scans


def text(seed, n):
    rnd = random.Random(seed)
    return "".join(rnd.choice(["word ", "é", "日本", "\n", "\n\n", "\n \t\n", "x" * 30, "\r\n"]) for _ in range(n)).encode()


@pytest.mark.parametrize("size, ahead", [(200, 50), (64, 10)])
def test_ranges_have_the_chunks_and_lines_of_one_range(spark, tmp_path, size, ahead):
    whole = {"a.txt": text(1, 3000), "b/c.txt": text(2, 40), "b/bad.txt": b"\xff\xfe" * 300 + b"\n\n" + b"\x80" * 300, "empty.txt": b"", "long.txt": b"y" * 5000, "end.txt": text(3, 100)[: size * 3]}
    (tmp_path / "b").mkdir()
    for name, data in whole.items():
        (tmp_path / name).write_bytes(data)
    found = []
    for chunks in (1, 3, 10_000):
        rows = ranges.range_fragments(spark, f"file://{tmp_path}", size, ahead, chunks).collect()
        found.append(sorted((r["path"].split(str(tmp_path) + "/")[1], r["start_line"], r["raw"]) for r in rows))
    assert found[0] == found[1] == found[2] and len(found[0]) > 100
    for name, data in whole.items():
        own = [b"".join(ranges._chunks(f"file://{tmp_path}/{name}", len(data), k, size, ahead, 2)) for k in range(-(-len(data) // (2 * size)))]
        assert b"".join(own) == data
        pieces = list(ranges._chunks(f"file://{tmp_path}/{name}", len(data), 0, size, ahead, 10_000)) if data else []
        assert all(len(p) <= size + ahead + 3 for p in pieces) and [(r[1], r[2]) for r in found[0] if r[0] == name] == sorted((1 + b"".join(pieces[:i]).count(b"\n"), p.decode("utf-8", "replace")) for i, p in enumerate(pieces))
    with pytest.raises(ValueError):
        ranges.range_fragments(spark, f"file://{tmp_path}", 100, 100)


def test_windows_and_sessions_close_whatever_the_order(spark):
    start = datetime(2024, 1, 1)
    rnd = random.Random(4)
    rows = [(start + timedelta(minutes=m), rnd.choice("ab"), m // 600) for m in sorted(rnd.sample(range(1800), 300))]
    late = [(start + timedelta(minutes=5), "a", 2), (start + timedelta(minutes=1199), "a", 2)]  # two windows: one closed long ago, one still open
    for shuffled in (False, True):
        events = rows + late
        if shuffled:
            rnd.shuffle(events)
        table = spark.createDataFrame(events, "ts timestamp, kind string, part int").repartition(3)
        hours = scans.run_in_parts(table, "part", new_path(spark, "w"), lambda s: scans.windowed_counts(s, "ts", "kind", "1 hour", "1 hour")).collect()
        want = {}
        done = max(r[0] for r in rows) - timedelta(hours=1)
        for ts, kind, _ in rows + late[1:]:
            w = ts.replace(minute=0)
            if w + timedelta(hours=1) <= done:
                want[(w, kind)] = want.get((w, kind), 0) + 1
        assert {(r["window_start"], r["kind"]): r["n"] for r in hours} == want and len(hours) == len(want)
        sessions = scans.run_in_parts(table, "part", new_path(spark, "s"), lambda s: scans.session_counts(s, "ts", "kind", "20 minutes", "1 hour")).collect()
        made = []
        for kind in "ab":
            now = None
            for ts in sorted(t for t, k, _ in rows + late[1:] if k == kind):
                if now and ts <= now[1]:  # a session's end belongs to it
                    now = (now[0], ts + timedelta(minutes=20), now[2] + 1)
                else:
                    made += [(*now, kind)] if now else []
                    now = (ts, ts + timedelta(minutes=20), 1)
            made.append((*now, kind))
        want = sorted(m for m in made if m[1] <= done)
        assert sorted((r["session_start"], r["session_end"], r["n"], r["kind"]) for r in sessions) == want
