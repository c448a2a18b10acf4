"""Interval operators and column functions against brute force and hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from heapscribe.functions import enums, scalars
from heapscribe.operators import intervals, layout


@pytest.fixture(scope="module")
def ranges(spark):
    rnd, rows = random.Random(1), []
    for g in range(25):
        for i in range(rnd.randint(1, 9)):
            lo = rnd.randrange(60)
            rows.append((g, g * 100 + i, lo, lo + rnd.randint(1, 25), rnd.randint(3, 8)))
    return rows, spark.createDataFrame(rows, "g long, id long, lo long, hi long, usage int").cache()


def by_group(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_islands_and_gaps(spark, ranges):
    rows, df = ranges
    merged = intervals.islands(df, ["g"])
    whole = spark.createDataFrame([(g, 90) for g in range(27)], "g long, size long")
    covered, free = {}, {}
    for source, out in ((merged, covered), (intervals.gaps(merged, whole, ["g"], "size"), free)):
        for r in source.collect():
            assert r.lo < r.hi
            out.setdefault(r.g, []).extend(range(r.lo, r.hi))
    groups = by_group(rows)
    for g in range(27):
        want = {b for r in groups.get(g, []) for b in range(r[2], r[3])}
        assert sorted(covered.get(g, [])) == sorted(want)
        assert sorted(free.get(g, [])) == sorted(set(range(90)) - want)


def test_winners_charge_each_byte_once(ranges):
    rows, df = ranges
    got = {r.id: r.bytes for r in intervals.winners(df, ["g"], [F.col("usage").desc(), (F.col("hi") - F.col("lo")), F.col("id").desc()]).groupBy("id").agg(F.sum("width").alias("bytes")).collect()}
    want = {}
    for own in by_group(rows).values():
        for b in range(100):
            over = [r for r in own if r[2] <= b < r[3]]
            if over:
                best = min(over, key=lambda r: (-r[4], r[3] - r[2], -r[1]))
                want[best[1]] = want.get(best[1], 0) + 1
    assert got == want


def test_lanes(ranges):
    rows, df = ranges
    got = {r.id: r.lane for r in intervals.lanes(df, "g").collect()}
    for own in by_group(rows).values():
        ends = []
        for _, i, lo, hi, _ in sorted(own, key=lambda r: (r[2], r[1])):
            lane = next((k for k, e in enumerate(ends) if e <= lo), len(ends))
            ends[lane : lane + 1] = [hi]
            assert got[i] == lane


def test_range_join(spark, ranges):
    rows, df = ranges
    points = spark.createDataFrame([(p, p * 3 % 80, p % 25) for p in range(200)], "p long, x long, g long")
    got = {(r.p, r.id) for r in intervals.range_join(points, df, "x", "lo", "hi", 7, on=("g",)).select("p", "id").collect()}
    assert got == {(p, r[1]) for p in range(200) for r in rows if r[0] == p % 25 and r[2] <= p * 3 % 80 < r[3]}


def test_documented_aliasing(spark):
    """RT [0,4096), texture [2048,8192), buffer [0,12288): 4096 bytes each, all bound."""
    df = spark.createDataFrame([(1, 1, 0, 4096, 6), (1, 2, 2048, 8192, 5), (1, 3, 0, 12288, 3)], "g long, id long, lo long, hi long, usage int")
    got = intervals.winners(df, ["g"], [F.col("usage").desc(), F.col("hi") - F.col("lo"), F.col("id").desc()]).groupBy("id").agg(F.sum("width").alias("w")).collect()
    assert {r.id: r.w for r in got} == {1: 4096, 2: 4096, 3: 4096}


def test_step_timeline_fills_forward(spark):
    df = spark.createDataFrame([(0, 0, 8192), (3100, 1, 4096), (9000, 0, -8192), (9000, 0, 8192)], "ts long, heap int, delta long").union(spark.createDataFrame([(9100, 0, 0)], "ts long, heap int, delta long"))
    got = {(r.heap, r.bucket): r.value for r in intervals.step_timeline(df, "heap", 3000).collect()}
    assert [got[0, b] for b in range(4)] == [8192] * 4 and [got[1, b] for b in range(4)] == [0, 4096, 4096, 4096]


def test_many_ranges_over_each_other(spark):
    """Work follows the ranges, not their pairs: 20,000 nested ones in one group; empty ranges cut, null ends are left out."""
    n = 20_000
    nested = spark.range(n).selectExpr("1L AS g", "id", "id AS lo", f"{2 * n}L - id AS hi")
    got = intervals.topmost(nested, ["g"], [F.col("id").desc()])
    assert got.count() == 2 * n - 1
    assert got.where("_s < lo OR _e > hi").count() == 0 and got.agg(F.sum(F.col("_e") - F.col("_s"))).first()[0] == 2 * n
    odd = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 4, 4), (1, 3, 2, None), (None, 4, 0, 3), (None, 5, 1, 2), (None, 6, 5, 6)], "g long, id long, lo long, hi long")
    rows = [(r.g, r.id, r._s, r._e) for r in intervals.topmost(odd, ["g"], [F.col("id").desc()]).collect()]
    assert sorted(rows, key=str) == sorted([(1, 1, 0, 4), (1, 1, 4, 10), (None, 4, 0, 1), (None, 5, 1, 2), (None, 4, 2, 3), (None, 6, 5, 6)], key=str)
    assert intervals.topmost(odd.limit(0), ["g"], [F.col("id")]).count() == 0


def test_last_writer(spark):
    df = spark.createDataFrame([(1, 0, 10, 1, 100, False), (1, 5, 15, 2, 200, False), (1, 7, 8, 3, 0, True)], "g long, lo long, hi long, seq long, pa long, unmap boolean")
    got = sorted((r.pa, r.width) for r in intervals.last_writer(df, ["g"]).collect())
    assert got == [(100, 5), (200, 2), (200, 2), (200, 5)]


def test_layout(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([6, 6, 4, 3, 2, 2, 1])], "grp long, id long, size long")
    got = layout.nested(df, ["grp", "id"], width=6, height=4, visible=0).where("depth = 2").collect()
    assert abs(sum(r.w * r.h for r in got) - 24) < 1e-9
    for r in got:
        assert r.x >= -1e-9 and r.y >= -1e-9 and r.x + r.w <= 6 + 1e-9 and r.y + r.h <= 4 + 1e-9


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: scalars.memory_text(F.lit(1023)), "1,023 bytes"),
        (lambda: scalars.memory_text(F.lit(1024)), "1.00 KiB"),
        (lambda: scalars.memory_text(F.lit(1536)), "1.50 KiB"),
        (lambda: scalars.nanoseconds(F.lit(25), F.lit(10_000_000)), 2500.0),
        (lambda: scalars.nanoseconds(F.lit(25), F.lit(999_999)), None),
        (lambda: scalars.fnv1a32(F.lit(4660).cast("long")), 2236145867),
        (lambda: scalars.flags_text(F.lit(192)), "INDEX_BUFFER | VERTEX_BUFFER (192)"),
        (lambda: scalars.flags_text(F.lit(0)), "None"),
        (lambda: scalars.flags_text(F.lit(4096)), "RAY_TRACING (4096)"),
        (lambda: scalars.buffer_usage(F.lit(4096)), 4),
        (lambda: scalars.buffer_usage(F.lit(4097)), 3),
        (lambda: scalars.subscription(F.lit(800), F.lit(1000)), "Under"),
        (lambda: scalars.subscription(F.lit(801), F.lit(1000)), "Close"),
        (lambda: scalars.subscription(F.lit(1001), F.lit(1000)), "Over"),
        (lambda: scalars.size_bucket(F.lit(524287).cast("long")), 0),
        (lambda: scalars.size_bucket(F.lit(1 << 20).cast("long")), 1),
        (lambda: scalars.size_bucket(F.lit(1 << 31).cast("long")), 11),
        (lambda: scalars.slider_bytes(F.lit(1)), 256),
        (lambda: scalars.slider_bytes(F.lit(24)), None),
        (lambda: scalars.page_bytes(F.lit(5)), 2097152),
        (lambda: scalars.page_bytes(F.lit(0)), 0),
        (lambda: enums.named(F.lit(7), enums.USAGES), "Depth stencil texture"),
        (lambda: scalars.hash128_text(F.lit(0), F.lit(0)), "N/A"),
        (lambda: scalars.range_text(F.lit(0), F.lit(None).cast("long")), "0 bytes - ∞"),
    ],
)
def test_scalars(spark, column, want):
    assert one(spark, column()) == want
