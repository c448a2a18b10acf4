"""Joins, ranks and sweeps over intervals against brute force, and at sizes that pairs would not survive."""

import random
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heapscribe import registry
from heapscribe.operators import aliasing, groups, intervals, layout, replay

from .conftest import DATA


@pytest.fixture(scope="module")
def boxes():
    rnd = random.Random(11)
    return [(i, i % 7, lo := rnd.randrange(300), lo + rnd.choice([0, 1, 5, 40, 120])) for i in range(400)]


def frame(spark, rows, names="id long, g long, lo long, hi long"):
    return spark.createDataFrame(rows, names)


@pytest.mark.parametrize("width", [1, 7, 64, 1000])
def test_interval_join(spark, boxes, width):
    left, right = boxes[:200], [(i, g, lo, hi) for i, g, lo, hi in boxes[200:]]
    other = frame(spark, right, "other long, g long, from long, to long")
    got = [(r.id, r.other) for r in intervals.interval_join(frame(spark, left), other, ("lo", "from"), ("hi", "to"), width, ("g",)).select("id", "other").collect()]
    want = [(a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[2] < b[3] and b[2] < a[3] and a[2] < a[3] and b[2] < b[3]]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("chunk", [1, 10, 10_000])
def test_alias_counts(spark, boxes, chunk):
    got = {r.id: r.aliases for r in intervals.alias_counts(frame(spark, boxes), ["g"], "id", chunk=chunk).collect()}
    real = [b for b in boxes if b[2] < b[3]]
    assert got == {a[0]: sum(a[0] != b[0] and a[1] == b[1] and a[2] < b[3] and b[2] < a[3] for b in real) for a in real}


def test_alias_counts_of_ranges_over_one_another(spark):
    n = 100_000
    nested = spark.range(n).selectExpr("1L AS g", "id", "id AS lo", f"{2 * n}L - id AS hi")
    got = intervals.alias_counts(nested, ["g"], "id", chunk=1000)
    assert got.agg(F.min("aliases"), F.max("aliases"), F.count("*")).first() == (n - 1, n - 1, n)


def test_running_aggregates_over_chunks(spark, boxes):
    df = intervals.running(frame(spark, boxes), ["g"], ["lo", "id"], F.expr("lo div 50"), {"s": ("sum", F.col("hi")), "m": ("max", F.col("hi"))}, before=True)
    groups = defaultdict(list)
    for b in sorted(boxes, key=lambda b: (b[1], b[2], b[0])):
        groups[b[1]].append(b)
    want = {b[0]: (sum(x[3] for x in own[:k]), max((x[3] for x in own[:k]), default=None)) for own in groups.values() for k, b in enumerate(own)}
    assert {r.id: (r.s, r.m) for r in df.collect()} == want


def first_fit(rows):
    ends, out = [], {}
    for i, lo, hi in sorted(rows, key=lambda r: (r[1], r[0])):
        k = next((k for k, e in enumerate(ends) if e <= lo), len(ends))
        ends[k : k + 1] = [hi]
        out[i] = k
    return out


def test_lanes_of_many_ranges(spark):
    rnd = random.Random(3)
    rows = [(i, i % 2, lo := rnd.randrange(3_000_000), lo + rnd.randint(0, 900)) for i in range(100_000)]
    rows = [(i, g, lo, max(hi, lo)) for i, g, lo, hi in rows]
    df = frame(spark, rows)
    got = {r.id: r.lane for r in intervals.lanes(df, "g", chunk=50_000).collect()}
    for g in (0, 1):
        want = first_fit([(i, lo, hi) for i, h, lo, hi in rows if h == g])
        assert all(got[i] == lane for i, lane in want.items())
    parts = intervals.sections(df.select("g", "id", "lo", "hi"), "g", 50_000)
    assert parts.select("g", "section").distinct().count() > 10  # and so several tasks pack one group


def test_lanes_tree():
    lanes = intervals.Lanes()
    assert [lanes.place(*x) for x in [(0, 10), (5, 15), (10, 20), (12, 14), (15, 16), (15, 30), (15, 40), (16, 17)]] == [0, 1, 0, 2, 1, 2, 3, 1]


def brute_changes(rows):
    """Per time: the bytes of each usage, an address at a time."""
    times = sorted({t for r in rows for t in (r[2], r[3]) if t is not None})
    out, former = [], defaultdict(int)
    for t in times:
        now = defaultdict(int)
        for p in range(max(r[1] for r in rows)):
            live = [r[4] for r in rows if r[0] <= p < r[1] and r[2] <= t and (r[3] is None or t < r[3])]
            if live:
                now[max(live)] += 1
        out += [(t, u, now[u] - former[u]) for u in sorted(now.keys() | former.keys()) if now[u] != former[u]]
        former = now
    return out


@pytest.mark.parametrize("seed", range(6))
def test_charges_fall_when_the_top_range_ends(spark, seed):
    rnd = random.Random(seed)
    groups = {g: [(lo := rnd.randrange(60), lo + rnd.randint(1, 30), t := rnd.randrange(25), rnd.choice([None, t + rnd.randint(1, 12)]), rnd.randrange(13)) for _ in range(rnd.randint(1, 25))] for g in range(8)}
    df = spark.createDataFrame([(g, *r) for g, rows in groups.items() for r in rows], "g long, lo long, hi long, a long, b long, usage int")
    odd = spark.createDataFrame([(0, 5, 5, 1, None, 3), (0, 1, 9, 4, 4, 3), (0, 1, 9, None, 8, 3), (0, None, 9, 1, 8, 3)], df.schema)
    for stretch in (1 << 20, 16):
        got = defaultdict(lambda: defaultdict(int))
        for r in aliasing.changes(df.union(odd), ["g"], "lo", "hi", "a", "b", stretch=stretch).collect():
            got[r.g][r.ts, r.usage] += r.delta
        assert {g: sorted((*k, v) for k, v in c.items() if v) for g, c in got.items()} == {g: brute_changes(rows) for g, rows in groups.items()}


def test_charges_of_the_documented_case(spark):
    """Render target, texture and buffer get 4096 bytes each; as they end from the top, the next has their bytes."""
    df = spark.createDataFrame([(1, 0, 4096, 0, 10, 6), (1, 2048, 8192, 0, 20, 5), (1, 0, 12288, 0, 30, 3)], "g long, lo long, hi long, a long, b long, usage int")
    got = sorted((r.ts, r.usage, r.delta) for r in aliasing.changes(df, ["g"], "lo", "hi", "a", "b").collect())
    assert got == [(0, 3, 4096), (0, 5, 4096), (0, 6, 4096), (10, 3, 2048), (10, 5, 2048), (10, 6, -4096), (20, 3, 6144), (20, 5, -6144), (30, 3, -12288)]


def test_charges_of_ten_thousand_ranges_in_one_place(spark):
    n = 10_000
    df = spark.range(n).selectExpr("1L AS g", "id AS lo", f"{2 * n}L - id AS hi", "id AS a", f"{3 * n}L - id AS b", "cast(id % 13 AS int) AS usage")
    began = time.time()
    got = aliasing.changes(df, ["g"], "lo", "hi", "a", "b").groupBy("usage").agg(F.sum("delta").alias("d")).collect()
    assert all(r.d == 0 for r in got) and time.time() - began < 60


@pytest.mark.parametrize("n", [1, 2, 5, 12, 33])
def test_groups_of_one_size_together_or_alone(spark, n):
    """Cells of many groups at once give what a sweep of each gives, and groups that are cut by batches stay whole."""
    rnd = random.Random(n)
    made = [[(lo := rnd.randrange(40), lo + rnd.randint(1, 20), t := rnd.randrange(15), rnd.choice([None, t + rnd.randint(1, 9)]), rnd.randrange(13)) for _ in range(n)] for _ in range(40)]
    table = [np.array([[aliasing.NEVER if r[k] is None else r[k] for r in g] for g in made]) for k in range(5)]
    want = sorted((g, *x) for g, rows in enumerate(made) for x in aliasing.swept(rows))
    assert sorted(zip(*[x.tolist() for x in aliasing.celled(*table)], strict=True)) == want
    df = spark.createDataFrame([(g, *r) for g, rows in enumerate(made) for r in rows], "g long, lo long, hi long, a long, b long, usage int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(tuple, aliasing.changes(df, ["g"], "lo", "hi", "a", "b").collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("rows", [1, 7, 10_000])
def test_small_and_large_groups_have_one_top(spark, rows):
    """Groups of every size from 1 to 70, whole or cut by batches, against each byte's least rank."""
    rnd = random.Random(5)
    made = [(g, g * 100 + i, lo := rnd.randrange(90), lo + rnd.choice([0, 1, 9, 30])) for g in range(1, 71, 3) for i in range(g)]
    made += [(None, i, i, i + 2) for i in range(40)]
    want = {}
    for g, i, lo, hi in made:
        for p in range(lo, hi):
            want[g, p] = max(want.get((g, p), -1), i)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = intervals.topmost(spark.createDataFrame(made, "g long, id long, lo long, hi long"), ["g"], [F.col("id").desc()]).collect()
        dated = intervals.topmost(spark.createDataFrame([(*r[:2], float(r[2]), float(r[3])) for r in made], "g long, id long, lo double, hi double"), ["g"], [F.col("id").desc()]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(r._e - r._s for r in got) == len(want) and {(r.g, p): r.id for r in got for p in range(r._s, r._e)} == want
    assert sorted(map(tuple, got), key=str) == sorted(((r.g, r.id, int(r.lo), int(r.hi), int(r._s), int(r._e)) for r in dated), key=str)


@pytest.mark.parametrize("name", ["j06_a14_f18_p38_backing_bytes", "a14_f18_p38_allocation_backing", "f19_in_preferred_heap"])
def test_the_mapped_state_is_worked_out_once(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    assert len(df.collect()) > 0
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1 and plan.count("Scan parquet") <= 4


@pytest.mark.parametrize("name", ["j06_a14_f18_p38_backing_bytes", "a14_f18_p38_allocation_backing", "f19_in_preferred_heap"])
def test_mappings_are_ranked_by_their_own_numbers(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    assert len(df.collect()) > 0
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1 and "DESC NULLS LAST" not in plan  # no sort by them


@pytest.mark.parametrize("kind", ["long", "int", "double"])
@pytest.mark.parametrize("rows", [1, 10_000])
def test_the_last_of_many_writers(spark, kind, rows):
    """Small groups and large ones, with numbers that are missing, below 0 or not whole, against a byte at a time."""
    rnd = random.Random(8)
    made = []
    for g in (1, 2, 9, 32, 33, 90):
        seqs = rnd.sample(range(-200, 200), g)
        made += [(g, lo := rnd.randrange(90), lo + rnd.randint(0, 30), None if k == 0 else float(q) if kind == "double" else q, k, k % 4 == 0) for k, q in enumerate(seqs)]
    want = {}
    for g, lo, hi, _, place, unmap in sorted(made, key=lambda r: (r[3] is not None, r[3] or 0)):
        for p in range(lo, hi):
            want[g, p] = None if unmap else place
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = intervals.last_writer(spark.createDataFrame(made, f"g long, lo long, hi long, seq {kind}, pa long, unmap boolean"), ["g"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(r.width for r in got) == sum(v is not None for v in want.values()) and {(r.g, p): r.pa for r in got for p in range(r._s, r._e)} == {k: v for k, v in want.items() if v is not None}


def test_writers_of_one_number_have_one_top(spark):
    """Which of them is open, but each byte has one; rows that hold nulls need not compare."""
    made = [(g, 0, 10, 7, None if k % 2 else k, False) for g, n in ((1, 5), (2, 50)) for k in range(n)]
    got = intervals.last_writer(spark.createDataFrame(made, "g long, lo long, hi long, seq long, pa long, unmap boolean"), ["g"]).collect()
    assert sorted((r.g, r._s, r._e) for r in got) == [(1, 0, 10), (2, 0, 10)]


def test_batches_are_put_together():
    batches = [pa.RecordBatch.from_pydict({"x": pa.array(range(n), pa.int64())}) for n in [3, 0, 1, 2, *[1] * 9]]
    got = list(groups.gathered(iter(batches)))
    assert [b.num_rows for b in got] == [11, 4] and pa.Table.from_batches(got) == pa.Table.from_batches(batches).combine_chunks()
    wide = pa.RecordBatch.from_pydict({"x": pa.array(np.zeros(groups.BYTES // 8, np.int64))})
    assert [b.num_rows for b in groups.gathered(iter([batches[0], wide, batches[2]]))] == [3 + wide.num_rows, 1]


def test_backing_of_ranges_that_share_a_key(spark):
    """Bytes of one key add up, each of its ranges has one row, and a range without mappings has nothing."""
    maps = spark.createDataFrame([(1, 0, 10, 1, 0, False), (1, 5, 15, 2, 4294967296, False), (1, 8, 9, 3, 0, True), (1, 14, 15, 4, 5, False)], "alloc_id long, lo long, hi long, seq long, pa long, unmap boolean")
    ranges = spark.createDataFrame([(1, 7, 0, 10), (1, 7, 0, 10), (1, 8, 6, 20), (2, 9, 0, 5), (None, 10, 0, 5), (1, None, 0, 5)], "alloc_id long, res_id long, lo long, hi long")
    got = registry.backing(lambda v: maps if v == "maps" else registry.proxies.query(spark, DATA, v), ranges, "res_id").collect()
    assert sorted(map(tuple, got)) == [(7, 8, 0, 10, 0), (7, 8, 0, 10, 0), (8, 7, 0, 0, 1), (9, 0, 0, 0, 0), (10, 0, 0, 0, 0)]


def test_a_timeline_works_its_changes_out_once(spark):
    df = spark.createDataFrame([(1, 0, 9, 0, 10, 6), (1, 2, 8, 0, None, 5)], "g long, lo long, hi long, a long, b long, usage int")
    line = intervals.step_timeline(aliasing.changes(df, ["g"], "lo", "hi", "a", "b"), "usage", 3)
    assert len(line.collect()) == 8
    plan = line._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1 and "ReusedExchange" in plan


def test_a_long_gap_is_no_array(spark):
    df = spark.createDataFrame([(0, 1, 5), (3000 * 200_000_000, 1, 7)], "ts long, heap int, delta long")
    line = intervals.step_timeline(df, "heap", 3000)
    assert line.agg(F.count("*"), F.sum("value"), F.max("bucket")).first() == (200_000_001, 5 * 200_000_000 + 12, 200_000_000)


def test_nested_treemap(spark):
    rnd = random.Random(6)
    rows = [(i % 3 or None, f"k{rnd.randrange(5)}", i, rnd.choice([1, 2, 50, 3000, 40_000])) for i in range(3000)] + [(1, "k0", 5000, 0), (1, "k0", 5001, None)]
    df = spark.createDataFrame(rows, "heap int, kind string, id long, size long")
    got = layout.nested(df, ["heap", "kind", "id"], width=300.0, height=200.0).collect()
    total = sum(r[3] for r in rows if r[3])
    assert all(abs(r.w * r.h - r["size"] / total * 60_000) < 1e-6 for r in got)
    assert {(r.heap, r["size"]) for r in got if r.depth == 1} == {(h, sum(x[3] for x in rows[:3000] if x[0] == h)) for h in (None, 1, 2)}
    children = defaultdict(list)
    for r in got:
        children[(r.heap, r.kind)[: r.depth - 1]].append(r)
    parents = {(): (0.0, 0.0, 300.0, 200.0)} | {(r.heap, r.kind)[: r.depth]: (r.x, r.y, r.w, r.h) for r in got if r.depth < 3 and not r.folded}
    for path, own in children.items():
        x, y, w, h = parents[path]
        assert abs(sum(r.w * r.h for r in own) - w * h) < 1e-6 and len(own) <= w * h / layout.VISIBLE + 1 and sum(r.folded for r in own) <= 1
        assert all(r.x > x - 1e-6 and r.y > y - 1e-6 and r.x + r.w < x + w + 1e-6 and r.y + r.h < y + h + 1e-6 for r in own)
        for k, a in enumerate(own):
            assert not any(min(a.x + a.w, b.x + b.w) - max(a.x, b.x) > 1e-6 and min(a.y + a.h, b.y + b.h) - max(a.y, b.y) > 1e-6 for b in own[:k])
    assert sum(r.items for r in got if r.depth == 3 or r.folded) == 3000
    assert layout.nested(df.limit(0), ["heap", "id"]).count() == 0


# --- replay ----------------------------------------------------------------------------------

TOKEN = "trace_id string, stream_index long, seq long, offset long, ts long, kind int, va long, size long, pref array<int>, owner long, driver_id long, is_system boolean, resource_type int, create_flags int, usage_flags int, after int"


def tokens(spark, rows):
    """rows of (seq, kind, va, size); times are ten times the numbers."""
    return spark.createDataFrame([("t", 0, s, s * 16, s * 10, k, va, size, [0], 0, 0, False, 0, 0, 0, 0) for s, k, va, size in rows], TOKEN)


def stepped(rows):
    """Token by token: (seq, taken, end) of allocations, (seq, base) of binds."""
    live, taken, ended, found = {}, {}, {}, {}
    for s, k, va, size in sorted(rows):
        over = [b for b, (e, _) in live.items() if b <= va < e]
        if k == 12:
            taken[s] = not over
            if not over:
                live[va] = va + size, s
        elif k == 11:
            if va in live:
                ended[live.pop(va)[1]] = s
        elif over:
            found[s] = max(over)
    return {(s, t, ended.get(s)) for s, t in taken.items()}, found


@pytest.mark.parametrize("region", [replay.REGION, 64, 4096])
def test_sweep_is_a_step_for_each_token(spark, monkeypatch, region):
    monkeypatch.setattr(replay, "REGION", region)
    rnd = random.Random(region)
    rows = [(s, rnd.choice([12, 12, 11, 7]), rnd.randrange(60) * 16, rnd.choice([16, 64, 400, 1200])) for s in range(1500)]
    state = replay.swept(tokens(spark, rows)).collect()
    taken, found = stepped(rows)
    assert {(r.seq, r.taken, r.end_seq) for r in state if r.kind == 12} == taken
    assert {r.seq: r.base for r in state if r.kind == 7} == found
    ends = {r.offset // 16: r.valid_to for r in replay.rejects(tokens(spark, rows)).collect()}
    frees = defaultdict(list)
    for s, k, va, _ in rows:
        if k == 11:
            frees[va].append(s)
    assert ends == {s: next((10 * f for f in frees[va] if f > s), None) for s, k, va, _ in rows if k == 12 and (s, False, None) in taken}


def test_live_map():
    rnd, block = random.Random(1), replay.Live.BLOCK
    replay.Live.BLOCK = 4
    try:
        for width in (30, 200, 5000):
            live, brute = replay.Live(), {}
            for _ in range(3000):
                v = rnd.randrange(width)
                assert list(live.over(v)) == sorted((b for b, e in brute.items() if b <= v < e), reverse=True)
                if rnd.random() < 0.6 and v not in brute:
                    brute[v] = v + rnd.choice([1, 2, 10, 50, 300])
                    live.add(v, brute[v], (v,))
                elif brute:
                    b = rnd.choice(list(brute))
                    assert live.pop(b) == (b,) and brute.pop(b)
                else:
                    assert live.pop(v) is None
    finally:
        replay.Live.BLOCK = block


def test_reuse_and_ladders_are_one_pass(spark):
    def made(n, kind, va, size):
        return spark.range(n).selectExpr("'t' AS trace_id", "0L AS stream_index", "id AS seq", "id * 16 AS offset", "id AS ts", f"{kind} AS kind", f"{va} AS va", f"{size} AS size", "array(0) AS pref", "0L AS owner", "0L AS driver_id", "false AS is_system", "0 AS resource_type", "0 AS create_flags", "0 AS usage_flags", "0 AS after")

    began = time.time()
    again = replay.allocations(made(200_000, "if(id % 2 = 0, 12, 11)", "4096L", "4096L"))
    assert again.where("valid_to = valid_from + 1").count() == 100_000
    ladder = replay.swept(made(10_000, "12", "id * 16", "1000000000L"))
    assert ladder.where("taken").count() == 1 and ladder.count() == 10_000
    assert time.time() - began < 60
