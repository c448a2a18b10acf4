"""Naming, implicit marks and histories on hand-made tokens."""

import pytest
from pyspark.sql import functions as F

from heapscribe.functions import sheets
from heapscribe.operators import history, naming, replay
from heapscribe.sources import trace

TOKEN = "trace_id string, stream_index long, seq long, offset long, ts long, kind int, va long, size long, pref array<int>, owner long, driver_id long, is_system boolean, resource_type int, create_flags int, usage_flags int, after int, user_kind int, correlation_id long, name string, delay long, implicit int, op long, unmap boolean, pa long"
FIELDS = [f.split()[0] for f in TOKEN.split(", ")]
BUFFER, IMAGE, HEAP = 1, 0, 11


def tape(spark, rows):
    """rows of (time, kind, fields); numbers follow the order."""
    plain = {"trace_id": "t", "stream_index": 0, "is_system": False, "pref": [0], "owner": 0, "delay": 0}
    full = [plain | {"seq": k, "offset": 16 * k, "ts": t, "kind": kind} | fields for k, (t, kind, fields) in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(f) for f in FIELDS) for r in full], TOKEN)


def create(t, driver, kind):
    return t, trace.CREATE, {"driver_id": driver, "resource_type": kind}


def user(t, what, driver, **fields):
    return t, trace.USERDATA, {"user_kind": what, "driver_id": driver} | fields


def name(t, ident, text, delay=0):
    return user(t, trace.NAME_2 if delay else trace.NAME, ident, name=text, delay=delay)


def correlate(t, driver, ident):
    return user(t, trace.CORRELATION, driver, correlation_id=ident)


def named(spark, rows):
    return sorted((r.driver_id, r.create_ts, r.event_time, r.name) for r in naming.names(tape(spark, rows)).collect())


def test_names_without_correlations_go_by_driver_id(spark):
    """G12: names at 5 and 9."""
    rows = [create(3, 1, IMAGE), name(5, 1, "a"), name(9, 1, "b"), create(10, 1, BUFFER), name(12, 1, "c"), name(13, 2, "nobody"), create(14, 3, 6), name(15, 3, "no such type")]
    assert named(spark, rows) == [(1, 3, 5, "a"), (1, 3, 9, "b"), (1, 10, 12, "c")]
    at = lambda t: {(r.create_seq): r.name for r in naming.names_at(naming.names(tape(spark, rows)), F.lit(t)).collect()}
    assert at(7)[0] == "a" and at(4)[0] == "a" and at(9)[0] == "b"


def test_names_through_correlations(spark):
    rows = [
        create(1, 1, IMAGE), create(2, 2, BUFFER), name(3, 1, "image by driver id"), name(4, 2, "buffer by driver id"),
        name(5, 70, "before its correlation"), correlate(6, 1, 70), name(7, 70, "after it"), create(8, 1, IMAGE), name(9, 70, "still the first"),
        correlate(10, 1, 70), name(11, 70, "the second"), correlate(12, 2, 80), name(13, 2, "renamed buffer"), name(14, 80, "buffer by correlation"),
    ]
    assert named(spark, rows) == [
        (1, 1, 5, "before its correlation"), (1, 1, 7, "after it"), (1, 1, 9, "still the first"), (1, 8, 11, "the second"), (2, 2, 4, "buffer by driver id"), (2, 2, 14, "buffer by correlation"),
    ]


def test_delays_set_names_back(spark):
    rows = [create(10, 1, BUFFER), name(30, 1, "late", delay=15), name(31, 1, "too early", delay=25), name(5_000, 1, "before the trace", delay=6_000), name(20, 1, "second at 15", delay=5)]
    assert named(spark, rows) == [(1, 10, 15, "late")]


def bind(t, driver, va, size=4096):
    return t, trace.BIND, {"driver_id": driver, "va": va, "size": size}


def allocate(t, va, size=65536):
    return t, trace.ALLOCATE, {"va": va, "size": size}


@pytest.mark.parametrize("heap_first", [True, False])
def test_a_resource_and_its_heap_are_not_both_implicit(spark, heap_first):
    marks = [user(20, trace.MARK_2, 2, implicit=trace.IMPLICIT_HEAP), user(21, trace.MARK_2, 2, implicit=trace.IMPLICIT_RESOURCE)]
    rows = [
        allocate(1, 0x10000), create(2, 1, HEAP), create(3, 2, IMAGE), create(4, 3, BUFFER), create(5, 4, IMAGE), bind(6, 1, 0x10000, 65536), bind(7, 2, 0x10000), bind(8, 3, 0x12000), bind(9, 4, 0x10000),
        *(marks if heap_first else marks[::-1]), user(22, trace.MARK, 3, implicit=0), user(23, trace.MARK_2, 4, implicit=trace.IMPLICIT_HEAP), user(24, trace.MARK_2, 99, implicit=trace.IMPLICIT_RESOURCE),
    ]
    tokens = tape(spark, rows)
    state = replay.swept(tokens)
    assert [(r.heap.driver_id, r.paired.driver_id) for r in naming.pairs(tokens, state).collect()] == [(1, 2)]
    found = naming.implicit(tokens, state)
    assert sorted((r.driver_id, r.kind) for r in found.collect()) == [(1, "heap"), (3, "resource")]
    assert {r.driver_id for r in naming.visible(replay.lives(tokens), found).collect()} == {2, 4}


def test_address_history(spark):
    """A base that others use again, a heap bound elsewhere, and references that list what was bound by then."""
    ref = lambda t, va, op=0: (t, trace.REFERENCE, {"va": va, "op": op})
    rows = [
        allocate(1, 0x10000), create(2, 1, BUFFER), bind(3, 1, 0x10000), ref(4, 0x10100), create(5, 2, BUFFER), bind(6, 2, 0x14000, 0x1000), ref(7, 0x13000, 1), (8, trace.FREE, {"va": 0x10000}),
        ref(9, 0x10100), allocate(10, 0x10000, 4096), (11, trace.CPU_MAP, {"va": 0x10FFF, "unmap": False}), (12, trace.DESTROY, {"driver_id": 1}), allocate(13, 0x80000), (14, trace.TABLE_UPDATE, {"va": 0x11000, "size": 4096, "unmap": False, "pa": 0}),
        allocate(15, 0x30000, 4096),
    ]
    tokens = tape(spark, rows)
    state, asked = replay.swept(tokens), spark.createDataFrame([("t", 0x10008), ("t", 0x14800), ("t", 5)], "trace_id string, address long")
    got = history.full(tokens, state, asked).collect()
    at = lambda a: [(r.ts, r.event, r.bound) for r in sorted(got, key=lambda r: r.seq) if r.address == a]
    assert at(0x10008) == [(1, "allocate", None), (2, "create", None), (3, "bind", None), (4, "make resident", [1]), (7, "evict", [1]), (8, "free", None), (9, "make resident", None), (10, "allocate", None), (11, "cpu map", None), (12, "destroy", None), (14, "map to host", None)]
    assert at(0x14800) == [(1, "allocate", None), (4, "make resident", []), (5, "create", None), (6, "bind", None), (7, "evict", [2]), (8, "free", None), (9, "make resident", None), (10, "allocate", None), (11, "cpu map", None), (14, "map to host", None)]
    assert not at(5)
    both = history.full(tokens, state, asked.where("address = 65544"), everything=True).collect()
    assert {r.driver_id for r in both if r.event == "create"} == {1, 2}
    assert [(r.ts, r.event) for r in sorted(history.basic(tokens, asked.where("address = 83968")).collect())] == [(1, "allocate"), (8, "free")]
    every = {r.ts: r.bound for r in history.every(tokens, state).collect() if r.event in ("make resident", "evict")}
    assert every == {4: [1], 7: [1, 2]}


def test_resource_history_goes_by_identity(spark):
    rows = [
        allocate(1, 0x10000), create(2, 1, BUFFER), bind(3, 1, 0x11000), (4, trace.REFERENCE, {"va": 0x1F000, "op": 0}), name(5, 1, "mine"), (6, trace.TABLE_UPDATE, {"va": 0x11800, "size": 4096, "unmap": True}), (6, trace.TABLE_UPDATE, {"va": 0x11800, "size": 8192, "unmap": True}),
        (7, trace.TABLE_UPDATE, {"va": 0x12000, "size": 4096, "unmap": True}), (8, trace.FREE, {"va": 0x10000}), allocate(9, 0x10000), (10, trace.REFERENCE, {"va": 0x11000, "op": 1}), (11, trace.DESTROY, {"driver_id": 1}), name(12, 1, "too late"), create(13, 1, BUFFER),
    ]
    tokens = tape(spark, rows)
    asked = spark.createDataFrame([("t", 1, 1)], "trace_id string, driver_id long, create_seq long")
    got = history.of_resources(tokens, replay.swept(tokens), asked, naming.names(tokens)).collect()
    assert sorted((r.ts, r.event) for r in got) == [(1, "allocate"), (2, "create"), (3, "bind"), (4, "make resident"), (5, "name"), (6, "unmap"), (8, "free"), (11, "destroy")]


def test_property_sheets(spark):
    bits = 5 | 3 << 20 | 1 << 35 | 1919 << 37 | 1079 << 51 | 2 << 79 | 3 << 82 | 4 << 85 | 5 << 88 | 4 << 99 | 2 << 114 | 16 << 125 | 1 << 130 | 8294400 << 131
    rows = [(1, 0, bits.to_bytes(39, "little")), (2, 1, (192 << 8 | 1536 << 24).to_bytes(11, "little")), (3, 12, bytes(19)), (4, 12, bytes([0, 2, 0, 0, 0, 0, 0, 0, 1, 255, 0, 0, 0, 0, 0, 0, 0, 9, 1])), (5, 4, b""), (6, 1, None), (7, 1, b"\x00")]
    got = sheets.properties(spark.createDataFrame(rows, "id long, resource_type int, payload binary"), ["id"]).collect()
    of = lambda k: {r.property: r.value for r in got if r.id == k}
    image = of(1)
    assert (image["X Dimension"], image["Y Dimension"], image["Image type"], image["Swizzle"], image["Mip levels"], image["Sample count"], image["Max base alignment"], image["Presentable"], image["Image size"]) == ("1,920", "1,080", "2D", "XYZW", "4", "4", "64.00 KiB", "True", "7.91 MiB")
    assert image["Create flags"] == "INVARIANT | SHAREABLE (5)" and image["Usage flags"] == "SHADER_READ | SHADER_WRITE (3)" and len(image) == 26
    assert of(2) == {"Create flags": "None", "Usage flags": "INDEX_BUFFER | VERTEX_BUFFER (192)", "Size": "1.50 KiB"}
    assert of(3)["Internal Pipeline hash"] == "N/A" and of(4)["Internal Pipeline hash"] == "0100000000000002" + "00000000000000ff" and of(4)["Stage mask"] == "PS | VS (9)"
    assert not of(5) and set(of(6).values()) == {None} and of(7)["Create flags"] == "None" and of(7)["Size"] is None
