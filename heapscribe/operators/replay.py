"""Replay of decoded tokens as validity intervals: one ordered pass for each stretch of address space, windows by key for the rest."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from ..sources import trace
from . import intervals, lineage

REGION = 1 << 26  # bytes of address space that are swept together, with those that allocations tie to them
PAGE = 4096
#: Fixed values of the format.
IMAGE, REBINDABLE, SHAREABLE, SPARSE, CLIENT_DRIVER = 0, (1, 11, 15), 1 << 2, 1 << 6, 2


class Live:
    """Live allocations by base. Sorted blocks of bases, and over them a tree of how far their members reach: each step costs about the logarithm of their number."""

    BLOCK = 512

    def __init__(self):
        self.rows: dict[int, tuple[int, tuple]] = {}  # base: end, row
        self.blocks: list[list[int]] = [[]]
        self._plant([-1])

    def _plant(self, far: list[int]) -> None:
        """far: how far each block reaches."""
        self.first = [b[0] if b else 0 for b in self.blocks]
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.reach = [-1] * (2 * self.width)
        self.reach[self.width : self.width + len(far)] = far
        for k in range(self.width - 1, 0, -1):
            self.reach[k] = max(self.reach[2 * k], self.reach[2 * k + 1])

    def _reach(self, k: int) -> int:
        return max((self.rows[b][0] for b in self.blocks[k]), default=-1)

    def _far(self) -> list[int]:
        return self.reach[self.width : self.width + len(self.blocks)]

    def _grown(self, k: int, reach: int) -> None:
        k += self.width
        while k and self.reach[k] < reach:
            self.reach[k] = reach
            k //= 2

    def add(self, base: int, end: int, row: tuple) -> None:
        k = max(0, bisect_right(self.first, base) - 1)
        block = self.blocks[k]
        insort(block, base)
        self.rows[base] = end, row
        self.first[k] = block[0]
        if len(block) > 2 * self.BLOCK:
            far = self._far()
            self.blocks[k : k + 1] = [block[: self.BLOCK], block[self.BLOCK :]]
            self._plant([*far[:k], self._reach(k), self._reach(k + 1), *far[k + 1 :]])
        else:
            self._grown(k, end)

    def pop(self, base: int) -> tuple | None:
        """Takes out the row at a base; None: nothing lives there."""
        if base not in self.rows:
            return None
        k = max(0, bisect_right(self.first, base) - 1)
        block = self.blocks[k]
        del block[bisect_left(block, base)]
        end, row = self.rows.pop(base)
        if not block and len(self.blocks) > 1:
            far = self._far()
            del self.blocks[k], far[k]
            self._plant(far)
        elif self.reach[self.width + k] == end:
            if block:
                self.first[k] = block[0]
            at = self.width + k
            self.reach[at] = self._reach(k)
            while at := at // 2:
                self.reach[at] = max(self.reach[2 * at], self.reach[2 * at + 1])
        elif block:
            self.first[k] = block[0]
        return row

    def over(self, place: int) -> Iterator[int]:
        """Bases of the live allocations that hold a place, the greatest first."""
        k = bisect_right(self.first, place) - 1
        while k >= 0 and (k := self._before(k, place)) >= 0:
            block = self.blocks[k]
            for base in reversed(block[: bisect_right(block, place)]):
                if self.rows[base][0] > place:
                    yield base
            k -= 1

    def _before(self, k: int, place: int) -> int:
        """The last block up to k that reaches beyond a place; -1: none."""
        at = self.width + k
        while self.reach[at] <= place:
            while at and not at & 1:  # a left child: what lies before it hangs on a node above
                at //= 2
            if at <= 1:
                return -1
            at -= 1
        while at < self.width:
            at = 2 * at + 1
            if self.reach[at] <= place:
                at -= 1
        return at - self.width


_HELD = ("stream_index", "offset", "va", "size", "pref", "owner", "ts")


def regions(tokens: DataFrame) -> DataFrame:
    """tokens with region: the first of the bins of REGION bytes that allocations which reach over their edges tie together. No allocation ever lies in two regions."""
    binned = tokens.withColumn("_bin", F.expr(f"va div {REGION}"))
    last = F.expr(f"(va + greatest(coalesce(size, 0), 1) - 1) div {REGION}")
    wide = binned.where(F.col("kind") == trace.ALLOCATE).withColumn("_last", last).where("_last > _bin")
    edges = wide.select("trace_id", F.explode(F.expr("sequence(_bin + 1, _last)")).alias("_bin")).distinct()
    runs = edges.withColumn("_run", F.col("_bin") - F.row_number().over(Window.partitionBy("trace_id").orderBy("_bin")))
    tied = runs.select("trace_id", "_bin", (F.min("_bin").over(Window.partitionBy("trace_id", "_run")) - 1).alias("_first"))
    return binned.join(tied, ["trace_id", "_bin"], "left").withColumn("region", F.coalesce("_first", "_bin")).drop("_bin", "_first")


def swept(tokens: DataFrame) -> DataFrame:
    """One pass over each region's tokens in order: a written table with a row for each allocate token (taken; end_seq and end_ts of the free that ends it) and for each bind, residency reference and CPU map that finds an allocation (base and alloc_seq: of several that hold its address, that with the greatest base).

    An allocation whose base lies within a live one is not taken, and itself rejects nothing.
    A region's tokens stream by; memory holds what lives at one time.
    """
    on_system = _on_system() if "is_system" in tokens.columns else F.lit(False)  # tokens of allocations alone have no such column
    on_place = tokens.where(F.col("kind").isin(trace.ALLOCATE, trace.FREE, trace.REFERENCE, trace.CPU_MAP) | (F.col("kind") == trace.BIND) & ~on_system)
    types = {f.name: f.dataType.simpleString() for f in tokens.schema}
    schema = f"trace_id {types['trace_id']}, seq {types['seq']}, kind int, taken boolean, base long, alloc_seq {types['seq']}, end_seq {types['seq']}, end_ts long, " + ", ".join(f"{c} {types[c]}" for c in _HELD)
    rows = regions(on_place).select("trace_id", "region", "seq", F.col("kind").cast("int").alias("kind"), *_HELD)
    # A shared image's allocation has the number of its bind and comes before it.
    ordered = rows.repartition("trace_id", "region").sortWithinPartitions("trace_id", "region", "seq", F.col("kind").desc())

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, live, out, target = None, Live(), [], None

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(target)
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, target, strict=True)], schema=target)
            out.clear()
            return batch

        def rest() -> None:
            out.extend((*group[:1], row[0], trace.ALLOCATE, True, None, None, None, None, *row[1:]) for _, row in live.rows.values())

        for batch in batches:
            if target is None:
                f = batch.schema.field
                long = pa.int64()
                target = pa.schema([f("trace_id"), f("seq"), ("kind", pa.int32()), ("taken", pa.bool_()), ("base", long), ("alloc_seq", f("seq").type), ("end_seq", f("seq").type), ("end_ts", long), *[f(c) for c in _HELD]])
            for trace_id, region, seq, kind, *held in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (trace_id, region) != group:
                    if group:
                        rest()
                    group, live = (trace_id, region), Live()
                va, size, ts = held[2], held[3] or 0, held[6]
                if kind == trace.FREE:
                    if row := live.pop(va):
                        out.append((trace_id, row[0], trace.ALLOCATE, True, None, None, seq, ts, *row[1:]))
                elif kind != trace.ALLOCATE:
                    base = next((b for b in live.over(va) if live.rows[b][1][4]), None)  # an empty allocation holds no address
                    if base is not None:
                        out.append((trace_id, seq, kind, None, base, live.rows[base][1][0], None, None, *[None] * len(held)))
                elif next(live.over(va), None) is not None:
                    out.append((trace_id, seq, kind, False, None, None, None, None, *held))
                else:
                    live.add(va, va + max(size, 1), (seq, *held))
                if len(out) >= 20_000:
                    yield made()
        if target is not None:
            rest()
            yield made()

    return lineage.cut(ordered.mapInArrow(sweep, schema), "swept")


def _taken(state: DataFrame) -> DataFrame:
    return state.where((F.col("kind") == trace.ALLOCATE) & F.col("taken"))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("trace_id", "stream_index", "offset", F.col("va").alias("base"), "size", "pref", "owner", F.col("ts").alias("valid_from"), F.col("end_ts").alias("valid_to"))


def allocations(tokens: DataFrame) -> DataFrame:
    """trace_id, stream_index, offset, base, size, pref, owner, valid_from, valid_to (null: open): an allocation ends at the next free of its base; one whose base lies within a live allocation is ignored."""
    return _shown(_taken(swept(tokens)))


def rejects(tokens: DataFrame) -> DataFrame:
    """The allocations that are ignored, in the same columns; valid_to is the next free of their base all the same."""
    ignored = swept(tokens).where((F.col("kind") == trace.ALLOCATE) & ~F.col("taken")).drop("end_ts")
    frees = tokens.where(F.col("kind") == trace.FREE).select("trace_id", "va", "seq", F.col("ts").alias("_freed"))
    both = ignored.unionByName(frees, allowMissingColumns=True)
    later = Window.partitionBy("trace_id", "va").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return _shown(both.withColumn("end_ts", F.last("_freed", True).over(later)).where("kind IS NOT NULL"))


def lives(tokens: DataFrame) -> DataFrame:
    """Tokens of resources with `episode`, numbered by the creates of their driver id, and what the create says: create_seq, created, created_type. What comes before the first create or after an episode's destroy changes nothing."""
    events = tokens.where(F.col("kind").isin(trace.CREATE, trace.BIND, trace.UPDATE, trace.DESTROY))
    numbered = events.withColumn("episode", F.sum((F.col("kind") == trace.CREATE).cast("int")).over(_upto("trace_id", "driver_id"))).where("episode > 0")
    ended = F.max(F.col("kind") == trace.DESTROY).over(_before("trace_id", "driver_id", "episode"))
    first = {"create_seq": "seq", "created": "ts", "created_type": "resource_type"}
    named = numbered.withColumns({n: F.first(c).over(_upto("trace_id", "driver_id", "episode")) for n, c in first.items()})
    return named.withColumn("_ended", F.coalesce(ended, F.lit(False))).where("NOT _ended").drop("_ended")


def _upto(*by: str):
    return Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)


def _before(*by: str):
    return Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)


def _usage(kind: Column, flags: Column) -> Column:
    return F.when(kind == 1, scalars.buffer_usage(flags)).when(kind == 0, 5).when(kind == 11, 2).when(kind == 12, 11).when(kind.isin(13, 14), 10).when(kind == 15, 9).when(kind == 2, 12).otherwise(8)


def _on_system(is_system: str = "is_system", va: str = "va") -> Column:
    """Bound to system memory without an address: such a bind finds no allocation."""
    return F.coalesce(F.col(is_system), F.lit(False)) & (F.col(va) == 0)


def with_shared(tokens: DataFrame) -> DataFrame:
    """tokens, and an allocate token for the first bind of each shareable image: its memory may belong to another process.

    Like any allocation it counts only if no live one holds its base, that is if the bind finds none.
    """
    alive = lives(tokens)
    image = F.max((F.col("kind") == trace.CREATE) & (F.col("resource_type") == IMAGE) & (F.col("create_flags").bitwiseAND(SHAREABLE) != 0)).over(_upto("trace_id", "driver_id", "episode"))
    former = F.count(F.when(F.col("kind") == trace.BIND, 1)).over(_before("trace_id", "driver_id", "episode"))
    first = alive.withColumns({"_image": image, "_former": former}).where((F.col("kind") == trace.BIND) & F.col("_image") & (F.col("_former") == 0) & (F.col("size") >= PAGE) & ~_on_system())
    made = first.withColumns({"kind": F.lit(trace.ALLOCATE).cast(tokens.schema["kind"].dataType), "size": F.expr(f"size div {PAGE} * {PAGE}"), "owner": F.lit(CLIENT_DRIVER).cast(tokens.schema["owner"].dataType), "pref": F.array(*[F.lit(0)] * 4)})
    return tokens.unionByName(made.select(*tokens.columns))


def spans(tokens: DataFrame) -> DataFrame:
    """The states of each resource as intervals: trace_id, driver_id, valid_from, valid_to (null: open), resource_type, usage, create_flags, create_ts, bind_ts, address, size, base, alloc_seq, create_seq (the number of its create, which with the driver id is its identity).

    A create ends the former resource of its driver id. A bind counts as long as none has
    found an allocation (base; null: none). Buffers, heaps and command allocators that are
    bound are created anew by a further bind, which binds them unless it is to system
    memory without an address; others ignore it. An update replaces the usage flags.
    """
    return spans_of(tokens, swept(with_shared(tokens)))


def spans_of(tokens: DataFrame, state: DataFrame) -> DataFrame:
    """`spans` where swept(with_shared(tokens)) is at hand."""
    found = state.where(F.col("kind") == trace.BIND).select("trace_id", "seq", "base", "alloc_seq")
    alive = lives(tokens).join(found, ["trace_id", "seq"], "left")
    upto, before = _upto("trace_id", "driver_id", "episode"), _before("trace_id", "driver_id", "episode")
    is_, created = lambda k: F.col("kind") == k, F.col("kind") == trace.CREATE
    hit = F.when(is_(trace.BIND), F.col("base").isNotNull())
    alive = alive.withColumns({"_type": F.last(F.when(created, F.col("resource_type")), True).over(upto), "_image_flags": F.last(F.when(created, F.coalesce("create_flags", F.lit(0))), True).over(upto)})
    rebindable = F.col("_type").isin(*REBINDABLE)
    alive = alive.withColumn("_bound", F.coalesce(F.when(rebindable, F.last(hit, True).over(before)).otherwise(F.max(hit).over(before)), F.lit(False)))
    alive = alive.where(~is_(trace.BIND) | ~F.col("_bound") | rebindable)
    again = is_(trace.BIND) & F.col("_bound")
    place = F.when(again & _on_system() | created, F.struct(*[F.lit(None).cast(state.schema["alloc_seq"].dataType if c == "alloc_seq" else "long").alias(c) for c in ("ts", "va", "size", "base", "alloc_seq")]))
    place = place.when(is_(trace.BIND), F.struct("ts", "va", "size", "base", "alloc_seq"))
    out = alive.withColumns({
        "_place": F.last(place, True).over(upto),
        "_flags": F.last(F.when(created, F.col("usage_flags")).when(is_(trace.UPDATE), F.col("after")), True).over(upto),
        "create_ts": F.last(F.when(created | again, F.col("ts")), True).over(upto),
        "valid_to": F.lead("ts").over(Window.partitionBy("trace_id", "driver_id").orderBy("seq")),
    }).where(~is_(trace.DESTROY))
    return out.select("trace_id", "driver_id", F.col("ts").alias("valid_from"), "valid_to", F.col("_type").alias("resource_type"), _usage(F.col("_type"), F.col("_flags")).alias("usage"), F.col("_image_flags").alias("create_flags"), "create_ts", F.col("_place.ts").alias("bind_ts"), F.col("_place.va").alias("address"), F.col("_place.size").alias("size"), F.col("_place.base").alias("base"), F.col("_place.alloc_seq").alias("alloc_seq"), "create_seq")


def heap_changes(tokens: DataFrame) -> DataFrame:
    """(trace_id, ts, heap, delta): bytes by first preferred heap, as allocations come and go. The bind of a partly resident image moves its allocation's bytes to heap 3 (none)."""
    state = swept(with_shared(tokens))
    taken = _taken(state).select("trace_id", F.col("seq").alias("alloc_seq"), "ts", "size", F.element_at("pref", 1).alias("heap"), F.col("end_ts").alias("_free"))
    sparse = spans_of(tokens, state).where((F.col("resource_type") == IMAGE) & (F.col("create_flags").bitwiseAND(SPARSE) != 0) & F.col("alloc_seq").isNotNull())
    moved = sparse.groupBy("trace_id", "alloc_seq").agg(F.min("bind_ts").alias("_moved"))
    changes = F.expr("""array(struct(ts, heap, size AS delta), struct(_moved AS ts, heap, -size AS delta), struct(_moved AS ts, 3 AS heap, size AS delta),
      struct(_free AS ts, if(_moved IS NULL, heap, 3) AS heap, -size AS delta))""")
    return taken.join(moved, ["trace_id", "alloc_seq"], "left").select("trace_id", F.explode(changes).alias("c")).select("trace_id", "c.*").where("ts IS NOT NULL")


def names(tokens: DataFrame) -> DataFrame:
    """(trace_id, driver_id, create_ts, event_time, name): names of buffers, images and heaps that live at the name's time, which its delay sets back; times before the trace don't count."""
    marks = tokens.where(F.col("kind").isin(trace.CREATE, trace.DESTROY)).select("trace_id", "driver_id", F.col("ts").alias("event_time"), F.lit(0).alias("_order"), "seq", F.when((F.col("kind") == trace.CREATE) & F.col("resource_type").isin(0, 1, 11), F.col("ts")).alias("_created"), F.lit(None).cast("string").alias("name"))
    named = tokens.where((F.col("kind") == trace.USERDATA) & F.col("user_kind").isin(trace.NAME, trace.NAME_2) & F.col("name").isNotNull()).withColumn("event_time", F.expr("ts - coalesce(delay, 0)")).where("event_time >= 0")
    both = marks.union(named.select("trace_id", "driver_id", "event_time", F.lit(1), "seq", F.lit(None).cast("long"), "name"))
    mark = F.when(F.col("_order") == 0, F.struct("_created"))
    seen = intervals.asof_last(both, mark, ["trace_id", "driver_id"], ["event_time", "_order", "seq"], "_mark")
    return seen.where("_order = 1 AND _mark._created IS NOT NULL").select("trace_id", "driver_id", F.col("_mark._created").alias("create_ts"), "event_time", "name")


def resources(tokens: DataFrame) -> DataFrame:
    """trace_id, driver_id, episode, resource_type, usage, size, create_ts, bind_ts, address, destroy_ts, one row for each create: of its binds the last counts for buffers, heaps and command allocators, the first for others. `spans` has each state."""
    kind = lambda k, c: F.when(F.col("kind") == k, F.col(c))
    flags = F.max_by("_flags", F.when(F.col("_flags").isNotNull(), F.col("seq")))
    numbered = lives(tokens).withColumn("_flags", F.coalesce(kind(trace.CREATE, "usage_flags"), kind(trace.UPDATE, "after")))
    rebindable = F.max(kind(trace.CREATE, "resource_type")).isin(*REBINDABLE)
    at_bind = F.when(F.col("kind") == trace.BIND, F.col("seq"))
    first, last = (f(F.struct("ts", "va", "size"), at_bind) for f in (F.min_by, F.max_by))
    grouped = numbered.groupBy("trace_id", "driver_id", "episode").agg(
        F.max(kind(trace.CREATE, "resource_type")).alias("resource_type"), F.min(kind(trace.CREATE, "ts")).alias("create_ts"), F.min(kind(trace.DESTROY, "ts")).alias("_destroyed"),
        F.max(kind(trace.CREATE, "size")).alias("_size"), flags.alias("_flags"), F.when(rebindable, last).otherwise(first).alias("_bind"),
    )
    following = F.lead("create_ts").over(Window.partitionBy("trace_id", "driver_id").orderBy("episode"))
    return grouped.select("trace_id", "driver_id", "episode", "resource_type", _usage(F.col("resource_type"), F.col("_flags")).alias("usage"), F.coalesce("_bind.size", "_size").alias("size"), "create_ts", F.col("_bind.ts").alias("bind_ts"), F.col("_bind.va").alias("address"), F.coalesce("_destroyed", following).alias("destroy_ts"))


def state_at(rows: DataFrame, t: int, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Rows whose interval holds t; both tests reach a Parquet scan."""
    return rows.where((F.col(start) <= t) & (F.col(end).isNull() | (F.col(end) > t)))


def mappings(tokens: DataFrame) -> DataFrame:
    """Page-table updates as ranges (trace_id, lo, hi, seq, pa, unmap); only updates of type UPDATE count."""
    updates = tokens.where((F.col("kind") == trace.TABLE_UPDATE) & (F.col("update_type") == 1))
    return updates.select("trace_id", F.col("va").alias("lo"), (F.col("va") + F.col("pages") * scalars.page_bytes(F.col("page_size"))).alias("hi"), "seq", "pa", "unmap")
