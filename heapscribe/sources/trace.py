"""Reader of binary trace containers, a Python data source: chunk lists with token streams in their data chunks.

The driver reads chunk headers only; each stream is decoded by one task, which reads and
decodes its bytes block by block, so files of any size are read in bounded memory.
Broken files raise errors that name the file and offset.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from heapscribe.functions import enums, scalars

#: Fixed values of the container and token formats.
MAGIC = 0x494E494D
FILE_HEADER, CHUNK_HEADER = struct.Struct("<4Ii9i"), struct.Struct("<IhhiI")
DATA, SEGMENT, PROCESS_START, SNAPSHOT, ADAPTER = 3, 4, 5, 6, 7
QUANTUM = 32
EXTENSIONS = (".rmv", ".rgd")
LEAST_FAMILY = 0x8F
ADAPTER_FIELDS = ("family", "revision", "device", "least_engine_clock", "most_engine_clock", "memory_type", "operations_per_clock", "bus_width", "bandwidth", "least_memory_clock", "most_memory_clock")
TIMESTAMP, UPDATE, TABLE_UPDATE, USERDATA, MISC, REFERENCE, BIND, PROCESS, PAGE_REFERENCE, CPU_MAP, FREE, ALLOCATE, CREATE, TIME_DELTA, DESTROY = 0, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15
#: Token: (bytes, fields as (column, high bit, low bit)).
TOKENS: dict[int, tuple[int, tuple[tuple[str, int, int], ...]]] = {
    TIMESTAMP: (12, (("frequency", 95, 64),)),
    UPDATE: (14, (("driver_id", 39, 8), ("subresource", 71, 40), ("update_type", 77, 72), ("before", 92, 78), ("after", 107, 93))),
    TABLE_UPDATE: (18, (("va", 43, 8), ("pa", 79, 44), ("pages", 99, 80), ("page_size", 102, 100), ("unmap", 103, 103), ("process_id", 135, 104), ("update_type", 137, 136), ("controller", 138, 138))),
    MISC: (2, (("op", 11, 8),)),
    REFERENCE: (8, (("op", 8, 8), ("va", 56, 9), ("queue", 63, 57))),
    BIND: (17, (("va", 55, 8), ("size", 99, 56), ("is_system", 100, 100), ("driver_id", 135, 104))),
    PROCESS: (6, (("process_id", 39, 8), ("event", 47, 40))),
    PAGE_REFERENCE: (10, ()),
    CPU_MAP: (8, (("va", 55, 8), ("unmap", 56, 56))),
    FREE: (7, (("va", 55, 8),)),
    ALLOCATE: (12, (("pages", 31, 8), ("owner", 33, 32), ("va", 81, 34), ("importance", 92, 90), ("is_external", 93, 93))),
    CREATE: (7, (("driver_id", 39, 8), ("owner", 41, 40), ("commit", 47, 46), ("resource_type", 53, 48))),
    DESTROY: (5, (("driver_id", 39, 8),)),
}
#: Tokens whose header moves the clock; update, page reference and destroy don't.
TICKING = {TABLE_UPDATE, USERDATA, MISC, REFERENCE, BIND, PROCESS, CPU_MAP, FREE, ALLOCATE, CREATE}
#: Payload bytes of a create token by resource type; images have one byte more from version 1.6 and descriptor pools four more for each description.
PAYLOADS = {0: 38, 1: 11, 2: 1, 3: 1, 4: 0, 5: 0, 6: 12, 7: 1, 8: 4, 9: 6, 10: 0, 11: 10, 12: 19, 13: 4, 14: 3, 15: 44, 16: 1, 17: 17}
PAYLOAD_FIELDS = {1: (("create_flags", 7, 0), ("usage_flags", 23, 8), ("size", 87, 24)), 11: (("create_flags", 4, 0), ("size", 68, 5), ("page_size", 73, 69)), 0: (("create_flags", 19, 0), ("usage_flags", 34, 20))}
NAME, CORRELATION, MARK, NAME_2, MARK_2 = 0, 4, 5, 6, 7
IMPLICIT_HEAP, IMPLICIT_RESOURCE = 1, 2
MARKED = {1: IMPLICIT_HEAP, 2: IMPLICIT_RESOURCE}  # by the heap type that a mark names
_LONGS = ("frequency", "driver_id", "subresource", "update_type", "before", "after", "va", "pa", "pages", "page_size", "controller", "op", "queue", "size", "event", "owner", "importance", "commit", "resource_type", "create_flags", "usage_flags", "user_kind", "delay", "correlation_id", "implicit")
_FLAGS = ("unmap", "is_system", "is_external")
SCHEMA = pa.schema([("trace_id", pa.string()), ("stream_index", pa.int64()), ("offset", pa.int64()), ("ts", pa.int64()), ("process_id", pa.int64()), ("thread_id", pa.int64()), ("kind", pa.int64()), *[(n, pa.int64()) for n in _LONGS], *[(n, pa.bool_()) for n in _FLAGS], ("pref", pa.list_(pa.int32())), ("name", pa.string()), ("payload", pa.binary())])
DDL = ", ".join(f"`{f.name}` {'string' if f.type == pa.string() else 'boolean' if f.type == pa.bool_() else 'binary' if f.type == pa.binary() else 'array<int>' if f.name == 'pref' else 'long'}" for f in SCHEMA)


class Chunk(NamedTuple):
    """Where a chunk's payload lies in its file."""

    type: int
    index: int
    version: tuple[int, int]
    at: int
    size: int


def chunks(file: BinaryIO, length: int, name: str) -> Iterator[Chunk]:
    """The chunks of a container, by their headers alone; sizes are checked against the file."""
    head = file.read(FILE_HEADER.size)
    if len(head) < FILE_HEADER.size or FILE_HEADER.unpack(head)[0] != MAGIC:
        raise ValueError(f"{name}: not a trace container")
    at = FILE_HEADER.unpack(head)[4]
    while at < length:
        if at < FILE_HEADER.size or at + CHUNK_HEADER.size > length:
            raise ValueError(f"{name}: chunk header at {at} lies outside the file")
        file.seek(at)
        identifier, minor, major, size, _ = CHUNK_HEADER.unpack(file.read(CHUNK_HEADER.size))
        if size < CHUNK_HEADER.size or at + size > length:
            raise ValueError(f"{name}: chunk at {at} has size {size}")
        yield Chunk(identifier & 0xFF, identifier >> 8 & 0xFF, (major, minor), at + CHUNK_HEADER.size, size - CHUNK_HEADER.size)
        at += size


_SIZES = np.zeros(256, np.int64)  # by a token's first byte; 0: its size stands further in, or there is no such token
for _kind, (_size, _) in TOKENS.items():
    _SIZES[_kind::16] = _size
_SIZES[TIME_DELTA::16] = 1 + (np.arange(16) & 7)
_PAYLOADS = np.full(64, -1, np.int64)
for _kind, _size in PAYLOADS.items():
    _PAYLOADS[_kind] = _size
_TICKS = np.isin(np.arange(16), list(TICKING))
POOL = 14  # fixed value: descriptor pools have a payload of variable size


def _long(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Little-endian integers of up to 8 bytes at each place; what lies beyond the data is 0."""
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        place = at + k
        out |= np.where(place < len(data), data[np.minimum(place, len(data) - 1)], 0).astype(np.uint64) << np.uint64(8 * k)
    return out


def _field(data: np.ndarray, at: np.ndarray, high: int, low: int) -> np.ndarray:
    first = low // 8
    return (_long(data, at + first, high // 8 - first + 1) >> np.uint64(low % 8) & np.uint64((1 << high - low + 1) - 1)).astype(np.int64)


def _sizes(data: np.ndarray, version: tuple[int, int]) -> np.ndarray:
    """The size that a token at each place would have; 0: there can be none. Only places where a token begins count."""
    kind = data & 15
    out = _SIZES[data]
    at = np.flatnonzero(kind == USERDATA)
    out[at] = 4 + (_long(data, at, 4) >> np.uint64(12)).astype(np.int64)
    at = np.flatnonzero(kind == CREATE)
    of = _field(data, at, 53, 48)
    extra = _PAYLOADS[of] + ((of == 0) & (version >= (1, 6)))
    extra += 4 * np.where(of == POOL, _long(data, at + 9, 1).astype(np.int64), 0)
    out[at] = np.where(_PAYLOADS[of] < 0, 0, 7 + extra)
    return out


def decode(blocks: Iterable[bytes], version: tuple[int, int], name: str, stream: int, process: int, thread: int) -> Iterator[pa.RecordBatch]:
    """Token rows of one stream, whose bytes come in blocks of any size: a token that a block or chunk cuts is carried on to the next.

    A block's token starts are found by following a table of sizes, and each kind's fields are taken
    from all its tokens at once. Time deltas only move the clock and aren't rows. A token that is cut off at the stream's end is an error.
    """
    carry, before, now, seen = b"", 0, 0, False
    for block in blocks:
        raw = carry + block
        data = np.frombuffer(raw, np.uint8)
        sizes = memoryview(_sizes(data, version)) if len(data) else memoryview(b"")
        starts, at, length = [], 0, len(data)
        while at < length:
            size = sizes[at]
            if not size:
                what = f"resource type {raw[at + 6] & 63}" if raw[at] & 15 == CREATE else f"token kind {raw[at] & 15}"
                raise ValueError(f"{name}, stream {stream}: {what} at {before + at}")
            if at + size > length:  # of what isn't here yet, sizes are no larger than they will be, and no smaller than what is here
                break
            starts.append(at)
            at += size
        carry = raw[at:]
        if starts:
            batch, now, seen = _rows(data, np.array([*starts, at], np.int64), version, (name, stream, process, thread), before, now, seen)
            yield batch
        before += at
    if carry:
        raise ValueError(f"{name}, stream {stream}: token at {before} is cut off")


def _rows(data: np.ndarray, starts: np.ndarray, version: tuple[int, int], of: tuple, before: int, now: int, seen: bool) -> tuple[pa.RecordBatch, int, bool]:
    """The tokens at `starts`, whose last place is where they end, as a batch; the clock after them; whether the stream has told its time."""
    lengths, starts = np.diff(starts), starts[:-1]
    kind = (data[starts] & 15).astype(np.int64)
    step = np.where(_TICKS[kind], data[starts] >> 4, 0).astype(np.int64)
    delta = np.flatnonzero(kind == TIME_DELTA)
    width = (data[starts[delta]] >> 4 & 7).astype(np.int64)
    for w in np.unique(width).tolist():
        step[delta[width == w]] = _long(data, starts[delta[width == w]] + 1, w).astype(np.int64)
    clock = now + np.cumsum(step * QUANTUM)
    first = np.flatnonzero(kind == TIMESTAMP)
    if len(first) and not seen:
        k, seen = first[0], True
        clock[k:] += _field(data, starts[k : k + 1], 63, 4)[0] * QUANTUM - clock[k]
    now = int(clock[-1])
    shown = kind != TIME_DELTA
    starts, kind, clock, lengths = starts[shown], kind[shown], clock[shown], lengths[shown]
    n = len(starts)
    name, stream, process, thread = of
    values: dict[str, tuple[np.ndarray, np.ndarray]] = {c: (np.zeros(n, np.int64), np.zeros(n, bool)) for c in (*_LONGS, *_FLAGS)}
    values["process_id"] = np.full(n, process, np.int64), np.ones(n, bool)
    text, pref = [None] * n, np.zeros((n, 4), np.int32)

    def put(column: str, at: np.ndarray, value) -> None:
        values[column][0][at] = value
        values[column][1][at] = True

    for k, (size, spec) in TOKENS.items():
        at = np.flatnonzero(kind == k)
        for column, high, low in spec if len(at) else ():
            put(column, at, _field(data, starts[at], high, low))
        if k == TABLE_UPDATE:
            for column in ("va", "pa"):
                values[column][0][at] <<= 12
        elif k == ALLOCATE and len(at):
            values["pages"][0][at] += 1
            put("size", at, values["pages"][0][at] << 12)
            wanted = np.stack([np.minimum(_field(data, starts[at], 83 + 2 * j, 82 + 2 * j), 2) for j in range(4)], axis=1)
            importance = values["importance"][0][at, None] if version >= (1, 6) else 4
            pref[at] = np.where(np.arange(4) < importance, wanted, 3)
        elif k == CREATE and len(at):
            for resource, fields in PAYLOAD_FIELDS.items():
                own = at[values["resource_type"][0][at] == resource]
                for column, high, low in fields:
                    put(column, own, _field(data, starts[own] + size, high, low))
    for at in np.flatnonzero(kind == USERDATA).tolist():  # few, and of any length
        head = int(_long(data, starts[at : at + 1], 4)[0])
        payload = data[starts[at] + 4 : starts[at] + 4 + (head >> 12)].tobytes()
        for column, value in _user(head >> 8 & 15, payload).items():
            if column == "name":
                text[at] = value
            else:
                put(column, at, value)
    columns = {"trace_id": pa.array([name] * n, pa.string()), "stream_index": pa.array(np.full(n, stream, np.int64)), "offset": pa.array(starts + before), "ts": pa.array(clock), "thread_id": pa.array(np.full(n, thread, np.int64)), "kind": pa.array(kind)}
    for column, (value, there) in values.items():
        columns[column] = pa.array(value.astype(bool) if column in _FLAGS else value, mask=~there)
    made = kind == ALLOCATE
    edge = np.concatenate([[0], np.cumsum(4 * made)]).astype(np.int32)
    columns["pref"] = pa.ListArray.from_arrays(pa.array(edge, mask=np.append(~made, False)), pa.array(pref[made].ravel()))
    columns["name"] = pa.array(text, pa.string())
    size = np.where(kind == CREATE, lengths - TOKENS[CREATE][0], 0)
    inside = np.repeat(starts + TOKENS[CREATE][0], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    present = np.packbits(kind == CREATE, bitorder="little").tobytes()
    columns["payload"] = pa.Array.from_buffers(pa.binary(), n, [pa.py_buffer(present), pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    return pa.RecordBatch.from_arrays([columns[f.name] for f in SCHEMA], schema=SCHEMA), now, seen


def _user(kind: int, payload: bytes) -> dict:
    """Columns of a user-data token. Names and marks carry the id that they are for in driver_id; implicit is what a mark marks (0: not said)."""
    word = lambda at, size=4: int.from_bytes(payload[at : at + size], "little")
    out = {"user_kind": kind}
    tail = {NAME: 4, NAME_2: 12}.get(kind)
    if tail and len(payload) > tail:
        at = len(payload) - tail
        out |= {"name": payload[:at].split(b"\0")[0].decode(errors="replace"), "driver_id": word(at), "delay": word(at + 4, 8) if kind == NAME_2 else 0}
    elif kind == CORRELATION and len(payload) == 8:
        out |= {"driver_id": word(0), "correlation_id": word(4)}
    elif kind == MARK and len(payload) >= 4:
        out |= {"driver_id": word(len(payload) - 4), "delay": 0, "implicit": IMPLICIT_RESOURCE}
    elif kind == MARK_2 and len(payload) >= 12:
        out |= {"driver_id": word(0), "delay": word(4, 8), "implicit": MARKED.get(payload[12], 0) if len(payload) > 12 else 0}
    return out


BLOCK = 1 << 20  # bytes of a stream that are decoded at a time


def _opened(path: str) -> tuple[BinaryIO, int]:
    from pyarrow.fs import FileSystem

    fs, inner = FileSystem.from_uri(path)
    return fs.open_input_file(inner), fs.get_file_info(inner).size


def _files(path: str) -> list[str]:
    """The files of a folder, or the file itself, as URIs in order. Files of other kinds are an error."""
    from pyarrow.fs import FileSelector, FileSystem, FileType

    fs, inner = FileSystem.from_uri(path)
    info = fs.get_file_info(inner)
    found = [f.path for f in fs.get_file_info(FileSelector(inner)) if f.type == FileType.File] if info.type == FileType.Directory else [inner]
    root = path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"
    for f in found:
        if not f.lower().endswith(EXTENSIONS):
            raise ValueError(f"{f}: not one of {EXTENSIONS}")
    return [root + f for f in sorted(found)]


@dataclass
class Part(InputPartition):
    """A stream: the payloads of its chunks in one file, in order. Or, to read side chunks, a file."""

    path: str
    number: int
    pieces: list[Chunk]


class TraceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.what, self.streams = options["path"], options.get("what", "tokens"), options.get("streams", "chunk")
        if self.streams not in ("chunk", "thread"):
            raise ValueError(f"streams is chunk or thread, not {self.streams}")

    def partitions(self) -> list[Part]:
        """Reads chunk headers only; a stream becomes one task, as its clock can't be known without its beginning."""
        out = []
        for path in _files(self.path):
            file, length = _opened(path)
            with file:
                found = list(enumerate(chunks(file, length, path)))
                if self.what == "chunks":
                    out.append(Part(path, 0, [c for _, c in found]))
                    continue
                streams: dict[tuple, Part] = {}
                for k, c in found:
                    if c.type == DATA:
                        file.seek(c.at)
                        key = struct.unpack("<QQ", file.read(16)) if self.streams == "thread" and c.size >= 16 else k
                        streams.setdefault(key, Part(path, k, [])).pieces.append(c)
                out += streams.values()
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        file, _ = _opened(part.path)
        with file:
            if self.what == "chunks":
                for k, c in enumerate(part.pieces):
                    file.seek(c.at)
                    payload = None if c.type == DATA else file.read(c.size)
                    yield pa.RecordBatch.from_pylist([{"trace_id": part.path, "chunk": k, "type": c.type, "index": c.index, "major": c.version[0], "minor": c.version[1], "payload": payload}], schema=_CHUNKS)
                return
            first = part.pieces[0]
            file.seek(first.at)
            if first.size < 16:
                raise ValueError(f"{part.path}: data chunk at {first.at} has no stream header")
            process, thread = struct.unpack("<QQ", file.read(16))

            def blocks() -> Iterator[bytes]:
                for c in part.pieces:
                    at, end = c.at + 16, c.at + c.size
                    while at < end:
                        file.seek(at)
                        yield (got := file.read(min(BLOCK, end - at)))
                        at += len(got)

            yield from decode(blocks(), first.version, part.path, part.number, process, thread)


_CHUNKS = pa.schema([("trace_id", pa.string()), *[(n, pa.int32()) for n in ("chunk", "type", "index", "major", "minor")], ("payload", pa.binary())])


class TraceSource(DataSource):
    """spark.read.format("memtrace"): tokens of the traces at a path, or (option what=chunks) their chunks, without the payloads of data chunks.

    Option streams: chunk (each data chunk is a stream of its own) or thread (those of one process and thread in a file are one stream in their order).
    """

    @classmethod
    def name(cls) -> str:
        return "memtrace"

    def schema(self) -> str:
        return DDL if self.options.get("what", "tokens") == "tokens" else "trace_id string, chunk int, type int, index int, major int, minor int, payload binary"

    def reader(self, schema) -> TraceReader:
        return TraceReader(dict(self.options))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """trace_id, chunk (its number in the file), type, index, major, minor, payload (null for data chunks) of the files at path, a URI."""
    spark.dataSource.register(TraceSource)
    return spark.read.format("memtrace").option("what", "chunks").load(path)


def read_tokens(spark: SparkSession, path: str, streams: str = "chunk") -> DataFrame:
    """Tokens of the files at path, a URI; streams as in TraceSource."""
    spark.dataSource.register(TraceSource)
    return spark.read.format("memtrace").option("streams", streams).load(path)


def rebased(tokens: DataFrame) -> DataFrame:
    """Clocks from the earliest stream start of each trace, and `seq`, the total order (ts, stream, offset) as a sortable struct."""
    from pyspark.sql.window import Window

    start = F.min(F.when(F.col("kind") == TIMESTAMP, F.col("ts"))).over(Window.partitionBy("trace_id"))
    return tokens.withColumn("ts", F.col("ts") - F.coalesce(start, F.lit(0))).withColumn("seq", F.struct("ts", "stream_index", "offset"))


def _integer(first: int, size: int):
    parts = [F.conv(F.hex(F.substring("payload", first + k, 1)), 16, 10).cast("long") * F.lit(1 << 8 * k) for k in range(size)]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def read_segments(chunked: DataFrame) -> DataFrame:
    return chunked.where(F.col("type") == SEGMENT).select("trace_id", _integer(21, 4).alias("index"), _integer(17, 4).alias("heap"), _integer(1, 7).alias("base"), _integer(9, 7).alias("size"))


def read_adapters(chunked: DataFrame) -> DataFrame:
    """The device that made a trace; clocks in MHz, `bandwidth` in bytes a second. Traces without the chunk have no row."""
    name = F.expr("cast(substring(payload, 1, coalesce(nullif(locate(chr(0), cast(substring(payload, 1, 128) AS string)), 0) - 1, 128)) AS string)")
    field = {c: _integer(129 + 4 * k, 4) for k, c in enumerate(ADAPTER_FIELDS)}
    out = chunked.where(F.col("type") == ADAPTER).select("trace_id", name.alias("name"), *[v.alias(c) for c, v in field.items()])
    device = scalars.device_id(F.col("device").bitwiseAND(0xFFFF).cast("int"), F.col("revision").bitwiseAND(0xFF).cast("int"))
    return out.withColumns({"memory_type": enums.named(F.col("memory_type"), enums.MEMORY_TYPES), "bandwidth": scalars.bandwidth_bytes(F.col("bandwidth")), "device_text": device, "supported": F.col("family") >= LEAST_FAMILY})


def read_snapshot_points(chunked: DataFrame) -> DataFrame:
    """Names and times; a point without a name is removed."""
    points = chunked.where(F.col("type") == SNAPSHOT).withColumn("_n", _integer(9, 4))
    return points.where("_n > 0").select("trace_id", _integer(1, 7).alias("ts"), F.expr("cast(substring(payload, 17, cast(_n AS int)) AS string)").alias("name"))


def read_process_starts(chunked: DataFrame) -> DataFrame:
    """The format's stub: process 0 with no memory for each chunk."""
    return chunked.where(F.col("type") == PROCESS_START).select("trace_id", F.lit(0).cast("long").alias("process_id"), F.lit(0).cast("long").alias("physical_memory"))
