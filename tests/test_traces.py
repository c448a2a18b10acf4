"""Binary traces, replay, sinks and streams on small fixtures."""

import io
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from heapscribe.operators import replay, residency
from heapscribe.sources import snapshots, trace
from heapscribe.streaming import timeline


def pack(kind, tick=0, **fields):
    size, spec = trace.TOKENS[kind]
    bits = kind | tick << 4
    for n, _, low in spec:
        bits |= int(fields.get(n, 0)) << low
    for k, p in enumerate(fields.get("pref", [])):
        bits |= p << 82 + 2 * k
    return bits.to_bytes(size, "little")


def start(clock, frequency=10_000_000):
    return struct.pack("<QI", clock // 32 << 4, frequency)


def chunk(kind, payload, version=(1, 8)):
    return trace.CHUNK_HEADER.pack(kind, version[1], version[0], trace.CHUNK_HEADER.size + len(payload), 0) + payload


def container(*parts):
    return trace.FILE_HEADER.pack(trace.MAGIC, 1, 0, 0, trace.FILE_HEADER.size, *[0] * 9) + b"".join(parts)


@pytest.fixture(scope="module")
def tokens(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("traces")
    buffer = (3 | 64 << 8 | 4096 << 24).to_bytes(11, "little")
    first = [
        start(6400),
        pack(trace.ALLOCATE, 1, pages=1, va=0x1000, owner=2, pref=[1, 3, 0, 0], importance=2),
        bytes([trace.TIME_DELTA | 2 << 4]) + (100).to_bytes(2, "little"),
        pack(trace.ALLOCATE, va=0x1000, pages=5),  # its base is live: ignored
        pack(trace.CREATE, driver_id=7, resource_type=1) + buffer,
        pack(trace.BIND, 1, driver_id=7, va=0x1000, size=4096),
        pack(trace.BIND, 1, driver_id=7, va=0x2000, size=4096),  # buffers are bound anew
        pack(trace.UPDATE, 15, driver_id=7, after=4096),  # doesn't move the clock
        (trace.USERDATA | trace.NAME << 8 | 9 << 12).to_bytes(4, "little") + b"name\0" + (7).to_bytes(4, "little"),
        pack(trace.DESTROY, 15, driver_id=7),
        pack(trace.FREE, 2, va=0x1000),
    ]
    second = [start(3200), pack(trace.TABLE_UPDATE, 1, va=4, pa=9, pages=2, page_size=1, update_type=1, process_id=5), pack(trace.CPU_MAP, va=0x3000, unmap=1)]
    data = [chunk(trace.DATA, struct.pack("<QQ", p, 1) + b"".join(x)) for p, x in ((11, first), (12, second))]
    segment = chunk(trace.SEGMENT, struct.pack("<QQiI", 1 << 32, 1 << 33, 0, 3))
    points = [chunk(trace.SNAPSHOT, struct.pack("<Qi4x", 640, len(n)) + n) for n in (b"one", b"")]
    (folder / "a.rmv").write_bytes(container(*data, segment, *points, chunk(trace.PROCESS_START, b"")))
    return trace.read_chunks(spark, f"file://{folder}").cache(), trace.rebased(trace.read_tokens(spark, f"file://{folder}")).cache()


def test_decode(tokens):
    _, rows = tokens
    got = [(r.kind, r.ts, r.process_id) for r in rows.orderBy("stream_index", "offset").collect()]
    base = 3200
    assert got == [(0, 3200, 11), (12, base + 32, 11), (12, base + 3232, 11), (13, base + 3232, 11), (7, base + 3264, 11), (7, base + 3296, 11), (1, base + 3296, 11), (4, base + 3296, 11), (15, base + 3296, 11), (11, base + 3360, 11), (0, 0, 12), (3, 32, 5), (10, 32, 12)]
    a = rows.where("kind = 12").orderBy("offset").first()
    assert (a.va, a.size, a.owner, a.pref) == (0x1000, 8192, 2, [1, 2, 3, 3])
    assert rows.where("kind = 4").first().name == "name"


def test_side_chunks(tokens):
    chunked, _ = tokens
    assert [tuple(r)[1:] for r in trace.read_segments(chunked).collect()] == [(3, 0, 1 << 32, 1 << 33)]
    assert [(r.ts, r.name) for r in trace.read_snapshot_points(chunked).collect()] == [(640, "one")]
    assert [(r.process_id, r.physical_memory) for r in trace.read_process_starts(chunked).collect()] == [(0, 0)]


def test_adapters(spark, tmp_path):
    def adapter(name, family):
        return chunk(trace.ADAPTER, struct.pack("<128s11I", name, family, 0xC1, 0x744C, 500, 2500, 6, 16, 384, 960, 96, 1249))

    (tmp_path / "a.rmv").write_bytes(container(adapter(b"A device", 0x91)))
    (tmp_path / "b.rmv").write_bytes(container(adapter(b"x" * 128, 0x8E)))
    (tmp_path / "c.rmv").write_bytes(container())
    a, b = trace.read_adapters(trace.read_chunks(spark, f"file://{tmp_path}")).orderBy("trace_id").collect()
    assert (a.name, a.family, a.supported, a.device_text, a.memory_type, a.bus_width, a.bandwidth, a.most_memory_clock) == ("A device", 0x91, True, "744CC1", "GDDR6", 384, 960 << 20, 1249)
    assert (b.name, b.supported) == ("x" * 128, False)


@pytest.mark.parametrize("raw", [b"", b"x" * 100, container(b"\0" * 5), container(chunk(trace.DATA, b"")[:-6] + struct.pack("<iI", 4, 0))])
def test_broken_containers(raw):
    with pytest.raises(ValueError, match="f.rmv"):
        list(trace.chunks(io.BytesIO(raw), len(raw), "f.rmv"))


def test_broken_streams():
    for raw in (bytes([2]), start(0) + pack(trace.FREE, va=1)[:-1], pack(trace.CREATE, resource_type=40)):
        with pytest.raises(ValueError, match="stream 0"):
            list(trace.decode([raw], (1, 8), "f", 0, 0, 0))


def user(kind, payload):
    return (trace.USERDATA | kind << 8 | len(payload) << 12).to_bytes(4, "little") + payload


def stream(seed, n, version):
    """Random tokens of all kinds, and what a token-at-a-time reading of them gives: (kind, offset, ts, some fields)."""
    rnd, raw, rows, now = random.Random(seed), bytearray(), [], 0
    extra = trace.PAYLOADS
    for k in range(n):
        kind, tick, at = rnd.choice([*trace.TOKENS, trace.TIME_DELTA, trace.USERDATA]) if k else trace.TIMESTAMP, rnd.randrange(16), len(raw)
        now += tick * 32 if kind in trace.TICKING else 0
        if kind == trace.TIME_DELTA:
            size = rnd.randrange(8)
            value = rnd.randrange(256**size) if size < 4 else rnd.randrange(1000)
            raw += bytes([kind | size << 4]) + value.to_bytes(size, "little")
            now += value * 32
            continue
        if kind == trace.TIMESTAMP:
            clock = rnd.randrange(1000, 10**6)
            raw += start(clock * 32)
            now = clock * 32 if k == 0 else now
            rows.append((kind, at, now, ()))
        elif kind == trace.USERDATA:
            what, ident, delay = rnd.choice([0, 1, 2, 4, 5, 6, 7]), rnd.randrange(1 << 32), rnd.randrange(1 << 40)
            name = "name " + "é" * rnd.choice([0, 1, 30, 3000])
            body = {0: name.encode() + b"\0" + ident.to_bytes(4, "little"), 6: name.encode() + b"\0" + ident.to_bytes(4, "little") + delay.to_bytes(8, "little"), 4: struct.pack("<II", ident, 77), 5: ident.to_bytes(4, "little"), 7: struct.pack("<IQB", ident, delay, 1)}.get(what, b"x" * rnd.randrange(9))
            raw += (kind | tick << 4 | what << 8 | len(body) << 12).to_bytes(4, "little") + body
            rows.append((kind, at, now, (what, name if what in (0, 6) else None, ident if what in (0, 4, 5, 6, 7) else None, {6: delay, 7: delay, 0: 0, 5: 0}.get(what), {5: 2, 7: 1}.get(what), 77 if what == 4 else None)))
        else:
            spec = trace.TOKENS[kind][1]
            fields = {c: rnd.randrange(1 << high - low + 1) for c, high, low in spec}
            more = b""
            if kind == trace.CREATE:
                fields["resource_type"] = resource = rnd.choice(list(extra))
                more = rnd.randbytes(extra[resource] + (resource == 0 and version >= (1, 6)))
                if resource == trace.POOL:
                    more = more[:2] + bytes([d := rnd.randrange(5)]) + rnd.randbytes(4 * d)
            raw += pack(kind, tick, **fields) + more
            shown = {trace.BIND: ("va", "size", "driver_id"), trace.CREATE: ("driver_id", "resource_type"), trace.FREE: ("va",), trace.DESTROY: ("driver_id",), trace.REFERENCE: ("op", "va", "queue")}.get(kind, ())
            rows.append((kind, at, now, tuple(fields[c] for c in shown)))
    return bytes(raw), rows


@pytest.mark.parametrize("version", [(1, 5), (1, 8)])
@pytest.mark.parametrize("seed", range(4))
def test_decode_in_blocks_of_any_size(seed, version):
    raw, want = stream(seed, 1500, version)
    rnd = random.Random(seed)
    columns = {trace.BIND: ("va", "size", "driver_id"), trace.CREATE: ("driver_id", "resource_type"), trace.FREE: ("va",), trace.DESTROY: ("driver_id",), trace.REFERENCE: ("op", "va", "queue"), trace.USERDATA: ("user_kind", "name", "driver_id", "delay", "implicit", "correlation_id")}
    for sizes in ([len(raw)], [1, 2, 3, 5], [64, 1000], [7]):
        blocks, at = [], 0
        while at < len(raw):
            size = rnd.choice(sizes)
            blocks.append(raw[at : at + size])
            at += size
        rows = [r for batch in trace.decode(blocks if sizes != [7] else blocks[:200] + [raw[1400:]], version, "f", 3, 5, 6) for r in batch.to_pylist()]
        assert [(r["kind"], r["offset"], r["ts"], tuple(r[c] for c in columns.get(r["kind"], ()))) for r in rows] == want
        assert all(r["stream_index"] == 3 and r["thread_id"] == 6 for r in rows)


def test_a_token_over_two_chunks(spark, tmp_path):
    raw, want = stream(9, 400, (1, 8))
    head = struct.pack("<QQ", 1, 2)
    cuts = [0, 13, 400, 401, len(raw)]
    other = chunk(trace.DATA, struct.pack("<QQ", 1, 3) + start(64))
    parts = [chunk(trace.DATA, head + raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    (tmp_path / "a.rmv").write_bytes(container(parts[0], other, *parts[1:]))
    rows = trace.read_tokens(spark, f"file://{tmp_path}", streams="thread").collect()
    assert sorted((r.kind, r.offset, r.ts) for r in rows if r.thread_id == 2) == sorted(w[:3] for w in want) and sum(r.thread_id == 3 for r in rows) == 1
    with pytest.raises(Exception, match="stream"):
        trace.read_tokens(spark, f"file://{tmp_path}").collect()
    (tmp_path / "b.txt").write_bytes(b"")
    with pytest.raises(Exception, match="not one of"):
        trace.read_tokens(spark, f"file://{tmp_path}").collect()


def test_residency_stream_is_the_batch(spark, tmp_path):
    """Tokens in any order over several micro-batches end in the state that the batch gives."""
    rnd = random.Random(7)
    rows = [("t", a := rnd.randrange(12), seq, seq * 3, rnd.choice(["add", "remove", "map", "unmap"]) if a else "map") for seq in range(600)]
    df = spark.createDataFrame(rows, "trace_id string, alloc_seq long, seq long, ts long, what string")
    want = {(r.trace_id, r.alloc_seq): tuple(r)[2:] for r in residency.residency(df).collect()}
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    for k in range(4):
        spark.createDataFrame(shuffled[k::4], df.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = residency.residency_stream(stream).writeStream.format("memory").queryName("touched").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {}
    for r in spark.table("touched").collect():  # the last state of each allocation stands last
        got[r.trace_id, r.alloc_seq] = tuple(r)[2:-1]
    assert got == want


def test_replay(tokens):
    _, rows = tokens
    (a,) = replay.allocations(rows).collect()
    assert (a.base, a.size, a.valid_from, a.valid_to) == (0x1000, 8192, 3232, 6560)
    (r,) = replay.resources(rows).collect()
    assert (r.driver_id, r.usage, r.size, r.address, r.destroy_ts) == (7, 4, 4096, 0x2000, 6496)
    (m,) = replay.mappings(rows).collect()
    assert (m.lo, m.hi, m.pa, m.unmap) == (4 << 12, 6 << 12, 9 << 12, False)
    assert replay.state_at(replay.allocations(rows), 4000).count() == 1 and replay.state_at(replay.allocations(rows), 6560).count() == 0


def test_replay_rejects_bases_within_live_allocations(spark):
    rnd, rows = random.Random(4), []
    for t in ("a", "b"):
        for seq in range(150):
            make = rnd.random() < 0.6
            rows.append((t, 0, seq, seq, 10 * seq, trace.ALLOCATE if make else trace.FREE, rnd.randrange(24) * 0x1000, rnd.choice([1, 2, 5, 9]) * 0x1000 if make else None, [0], 1))
    rows += [("c", 0, i, i, i, trace.ALLOCATE, va, size, [0], 1) for i, (va, size) in enumerate([(0x1000, 0x8000), (0x4000, 0x9000), (0xA000, 0x1000), (0x9000, 1 << 33), (1 << 32, 0x1000)])]
    tokens = spark.createDataFrame(rows, "trace_id string, stream_index int, offset long, seq long, ts long, kind int, va long, size long, pref array<int>, owner int")
    live, taken, ignored = {}, {}, set()
    for t, _, at, _, ts, kind, va, size, *_ in rows:
        if kind == trace.FREE:
            if (t, va) in live:
                taken[live.pop((t, va))[0]][1] = ts
        elif any(u == t and lo <= va < lo + n for (u, lo), (_, n) in live.items()):
            ignored.add((t, at))
        else:
            live[t, va], taken[t, at] = ((t, at), size), [ts, None]
    got = replay.allocations(tokens).collect()
    assert {(r.trace_id, r.offset): [r.valid_from, r.valid_to] for r in got} == taken and len(got) == len(taken)
    assert {(r.trace_id, r.offset) for r in replay.rejects(tokens).collect()} == ignored and ("c", 2) in taken


def test_snapshot_points(spark, tmp_path):
    path = f"file://{tmp_path}/points"
    snapshots.add(spark.createDataFrame([("a", "first", 5, 10), ("b", "second", 6, 20)], "id string, name string, ts long, total long"), path)
    snapshots.rename(spark, path, "a", "renamed")
    snapshots.remove(spark, path, "b")
    assert [(r.id, r.name, r.ts, r.total, r.version) for r in snapshots.points(spark, path).collect()] == [("a", "renamed", 5, 10, 1)]
    rows = spark.createDataFrame([("Size", '4 "KiB"'), ("Heap", "Local")], "name string, value string")
    snapshots.export_properties(rows, f"{path}-csv")
    assert sorted(r.value for r in spark.read.option("header", True).option("escape", "\\").csv(f"{path}-csv").collect()) == ['4 "KiB"', "Local"]
    snapshots.export_properties(rows, f"{path}-text", "text", 8)
    assert sorted(r.value for r in spark.read.text(f"{path}-text").collect()) == ["Heap    Local", 'Size    4 "KiB"']


def test_streaming_timeline(spark, tmp_path):
    rows = [(i * 700, i % 2, 4096 if i % 3 else -4096) for i in range(60)]
    df = spark.createDataFrame(rows, "ts long, heap int, delta long")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = timeline.live_byte_changes(stream).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = {(r.bucket, r.heap): r.change for r in df.groupBy(F.expr("ts div 3000").alias("bucket"), "heap").agg(F.sum("delta").alias("change")).collect()}
    assert {(r.bucket, r.heap): r.change for r in spark.table("live").collect()} == want


def test_late_rows_are_counted(spark, tmp_path):
    late = timeline.LateRows()
    spark.streams.addListener(late)
    try:
        for k, ts in enumerate([[10_000_000, 10_000_500], [5_000, 10_001_000], [6_000, 9_000]]):
            spark.createDataFrame([(t, 1, 4096) for t in ts], "ts long, heap int, delta long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema("ts long, heap int, delta long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        query = timeline.live_byte_changes(stream).writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):
            if late.lost["late"]:
                break
            time.sleep(0.1)
        assert late.lost["late"] >= 2
    finally:
        spark.streams.removeListener(late)
