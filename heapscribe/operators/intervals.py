"""Interval algebra as joins, windows and aggregates."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType
from pyspark.sql.window import Window

from . import groups

STRETCH = 1 << 16  # buckets that one array holds at most
WHOLE = (ByteType, ShortType, IntegerType, LongType)


def range_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, width: int, on: tuple[str, ...] = (), how: str = "inner") -> DataFrame:
    """Rows of points with the half-open intervals that hold them. Bins of `width` make it an equi join, so no side is broadcast and nothing is multiplied out.

    An interval stands in every bin that it touches and a point in one, so no pair comes twice.
    """
    binned = intervals.withColumn("_bin", F.explode(F.expr(f"sequence({low} div {width}, greatest({high} - 1, {low}) div {width})")))
    placed = points.withColumn("_bin", F.expr(f"{point} div {width}"))
    keys = ["_bin", *on]
    left, right = placed.alias("p"), binned.alias("i")
    cond = (F.col(f"p.{point}") >= F.col(f"i.{low}")) & (F.col(f"p.{point}") < F.col(f"i.{high}"))
    for k in keys:
        cond = cond & (F.col(f"p.{k}") == F.col(f"i.{k}"))
    return left.join(right, cond, how).drop(F.col("p._bin"), F.col("i._bin"), *[F.col(f"i.{k}") for k in on])


def interval_join(left: DataFrame, right: DataFrame, low: tuple[str, str], high: tuple[str, str], width: int, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows whose half-open intervals overlap; low and high name the ends of left and of right, `on` further keys.

    Both sides stand in every bin of `width` that they touch, and a pair counts in the first bin that
    they share, so it is an equi join, no side is broadcast and no pair comes twice. Empty
    intervals overlap nothing.
    """

    def binned(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.where(F.col(lo) < F.col(hi)).withColumn("_bin", F.explode(F.expr(f"sequence({lo} div {width}, ({hi} - 1) div {width})")))

    a, b = binned(left, low[0], high[0]).alias("a"), binned(right, low[1], high[1]).alias("b")
    cond = (F.col(f"a.{low[0]}") < F.col(f"b.{high[1]}")) & (F.col(f"b.{low[1]}") < F.col(f"a.{high[0]}"))
    for k in ("_bin", *on):
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    first = F.expr(f"a._bin = greatest(a.{low[0]} div {width}, b.{low[1]} div {width})")
    return a.join(b, cond & first).drop(F.col("a._bin"), F.col("b._bin"), *[F.col(f"b.{k}") for k in on])


def running(df: DataFrame, by: list[str], order: list[str], chunk: Column, values: dict[str, tuple[str, Column]], before: bool = False) -> DataFrame:
    """df with running aggregates in `order` within `by`: values has (sum or max, column) by name. before: without the row itself.

    `chunk` must ascend with the order. A window runs within a chunk only, and a row for each chunk
    carries on what the former ones come to, so a group of any size is the work of many tasks.
    """
    cols = df.columns
    chunked = df.withColumn("_chunk", chunk)
    inner = Window.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    outer = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    agg = {"sum": F.sum, "max": F.max}
    totals = chunked.groupBy(*by, "_chunk").agg(*[agg[f](c).alias(f"_{n}") for n, (f, c) in values.items()])
    offsets = totals.select(*by, "_chunk", *[agg[f](f"_{n}").over(outer).alias(f"_{n}") for n, (f, _) in values.items()])
    own = chunked.withColumns({n: agg[f](c).over(inner) for n, (f, c) in values.items()})
    cond = F.col("r._chunk").eqNullSafe(F.col("o._chunk"))
    for k in by:
        cond = cond & F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}"))
    join = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest}
    return own.alias("r").join(offsets.alias("o"), cond).select(*[F.col(f"r.{c}") for c in cols], *[join[f](F.col(f"r.{n}"), F.col(f"o._{n}")).alias(n) for n, (f, _) in values.items()])


def alias_counts(df: DataFrame, by: list[str], key: str, low: str = "lo", high: str = "hi", chunk: int = 1 << 20) -> DataFrame:
    """(by, key, aliases): how many other ranges of its group each range overlaps, without pairing them.

    Of n ranges those that start before my end, less those that end by my start, overlap me: two ranks
    among all ends, which one running count gives. `key` tells the ranges of a group apart; empty ranges aren't counted.
    """
    ends = F.explode(F.array(F.struct(F.col(low).alias("at"), F.lit(1).alias("opens")), F.struct(F.col(high).alias("at"), F.lit(0).alias("opens")))).alias("p")
    points = df.where(F.col(low) < F.col(high)).select(*by, key, ends).select(*by, key, "p.at", "p.opens")
    counted = running(points, by, ["at", "opens"], F.expr(f"at div {chunk}"), {"_opened": ("sum", F.col("opens")), "_closed": ("sum", 1 - F.col("opens"))})
    return counted.groupBy(*by, key).agg((F.sum(F.when(F.col("opens") == 1, -F.col("_closed")).otherwise(F.col("_opened"))) - 1).alias("aliases"))


def asof_last(events: DataFrame, value: Column, by: list[str], order: list[str], out: str) -> DataFrame:
    """The latest non-null value at or before each row, within `by`: an as-of join as one window over the union of both sides."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn(out, F.last(value, ignorenulls=True).over(w))


def islands(df: DataFrame, by: list[str], low: str = "lo", high: str = "hi") -> DataFrame:
    """Merged ranges (by, lo, hi); touching ones stay apart, as two islands of one total."""
    order = Window.partitionBy(*by).orderBy(low, high)
    before = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.select(*by, low, high, F.when(before.isNull() | (F.col(low) >= before), 1).otherwise(0).alias("_new"))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_island").agg(F.min(low).alias("lo"), F.max(high).alias("hi")).drop("_island")


def gaps(merged: DataFrame, whole: DataFrame, by: list[str], size: str) -> DataFrame:
    """(by, lo, hi): what the islands leave of [0, size) of each row of `whole`; rows without islands are one gap."""
    ends = whole.select(*by, F.col(size).alias("lo"), F.col(size).alias("hi"))
    order = Window.partitionBy(*by).orderBy("lo", "hi")
    both = merged.select(*by, "lo", "hi").unionByName(ends)
    lagged = both.withColumn("_from", F.lag("hi", 1, 0).over(order))
    return lagged.where("lo > _from").select(*by, F.col("_from").alias("lo"), F.col("lo").alias("hi"))


def cover(df: DataFrame, by: list[str], low: str = "lo", high: str = "hi") -> DataFrame:
    """Elementary segments with the ranges over them: df's columns and _s, _e."""
    points = df.select(*by, F.explode(F.array(low, high)).alias("_s")).distinct()
    segments = points.withColumn("_e", F.lead("_s").over(Window.partitionBy(*by).orderBy("_s"))).where("_e IS NOT NULL")
    cond = (F.col(f"d.{low}") <= F.col("g._s")) & (F.col(f"d.{high}") >= F.col("g._e"))
    for k in by:
        cond = cond & (F.col(f"d.{k}") == F.col(f"g.{k}"))
    return df.alias("d").join(segments.alias("g"), cond).select("d.*", "g._s", "g._e")


def celled(lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """(group, range, from, to): of many groups of n ranges at once, arrays of groups by ranges, the range of the least rank over each elementary segment."""
    order = np.argsort(rank, axis=1)
    first, last = (np.take_along_axis(x, order, 1) for x in (lo, hi))
    points = np.sort(np.concatenate([lo, hi], axis=1), axis=1)
    top = np.full((len(lo), points.shape[1] - 1), -1)
    for k in range(lo.shape[1] - 1, -1, -1):
        top[(first[:, k, None] <= points[:, :-1]) & (points[:, 1:] <= last[:, k, None])] = k
    g, s = np.nonzero((top >= 0) & (points[:, :-1] < points[:, 1:]))
    return g, order[g, top[g, s]], points[g, s], points[g, s + 1]


def topmost(df: DataFrame, by: list[str], order: list[Column] | str, low: str = "lo", high: str = "hi") -> DataFrame:
    """Of the ranges over each elementary segment the first by `order`: df's columns and _s, _e.

    Ranks come from a window, or from a column of whole numbers that `order` names, the greatest
    first and nulls last; then one pass over a group's ranges, sorted by their start,
    holds the open ones in a heap. So n ranges give at most 2n rows and a task's memory is
    the ranges open at one place, however many lie over each other. Small groups of whole
    numbers are worked out many at once instead. Empty ranges only cut
    segments; ranges without a start or end are left out.
    """
    latest = order if isinstance(order, str) else None
    # The window brings a group together in either case; by the start it needs no other sort than the pass does.
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*(order if latest is None else [low])))
    ranked = df.where(F.col(low).isNotNull() & F.col(high).isNotNull()).withColumn("_n", number)
    schema = df.withColumns({"_s": F.col(low), "_e": F.col(low)}).schema
    placed = ranked.select(*by, *[c for c in ranked.columns if c not in by])
    names, most = df.columns, groups.SMALL if all(isinstance(df.schema[c].dataType, WHOLE) for c in (low, high)) else 0

    def sweep(batches):
        target, place, open_, ends, out = None, None, [], [], []

        def column(batch, name):
            return batch.column(batch.schema.get_field_index(name))

        def ranks(batch):
            if latest is None:
                return column(batch, "_n").to_numpy(zero_copy_only=False)
            return ~pc.fill_null(column(batch, latest).cast(pa.int64()), -(1 << 63)).to_numpy(zero_copy_only=False)

        def advance(to):
            nonlocal place
            while ends:
                while ends and ends[0] <= place:
                    heapq.heappop(ends)
                if not ends or to is not None and place >= to:
                    break
                stop = ends[0] if to is None else min(ends[0], to)
                while open_[0][1] <= place:
                    heapq.heappop(open_)
                out.append((*open_[0][3], place, stop))
                place = stop

        def flushed():
            columns = zip(*out, strict=True) if out else [()] * len(target)
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, target, strict=True)], schema=target)
            out.clear()
            return batch

        def swept(batch, ended):
            """Goes on with the open group by these rows; ended: they are its last."""
            nonlocal place
            rows = zip(*[column(batch, n).to_pylist() for n in names], strict=True)
            for row, rank, number, at, end in zip(rows, ranks(batch).tolist(), *[column(batch, n).to_pylist() for n in ("_n", low, high)], strict=True):
                advance(at)
                place = at
                heapq.heappush(open_, (rank, end, number, row))
                heapq.heappush(ends, end)
            if ended:
                advance(None)
                open_.clear()
                ends.clear()

        def together(batch, starts, sizes):
            lo, hi = (column(batch, n).to_numpy(zero_copy_only=False) for n in (low, high))
            rank, made = ranks(batch), []
            for first, rows in groups.even(starts, sizes, lambda n: 8 * n):
                g, k, begins, stops = celled(lo[rows], hi[rows], rank[rows])
                at = pa.array(first[g] + k)
                made.append(pa.RecordBatch.from_arrays([*[column(batch, n).take(at) for n in names], pa.array(begins, target.field("_s").type), pa.array(stops, target.field("_e").type)], schema=target))
            if made:
                yield pa.concat_batches(made)

        tail, streamed = None, None  # rows of the open group: all of them, or the last of those that went to the heaps
        for batch in groups.gathered(batches):
            if target is None:
                fields = [batch.schema.field(n) for n in names]
                target = pa.schema([*fields, batch.schema.field(low).with_name("_s"), batch.schema.field(high).with_name("_e")])
            if streamed is not None:
                goes_on = pa.concat_batches([streamed, batch])
                starts, _ = groups.bounds(goes_on, len(by))
                cut = int(starts[1]) - 1 if len(starts) > 1 else batch.num_rows
                swept(batch.slice(0, cut), cut < batch.num_rows)
                if cut == batch.num_rows:
                    yield flushed()
                    continue
                batch, streamed = batch.slice(cut), None
            elif tail is not None:
                batch = pa.concat_batches([tail, batch])
            starts, sizes = groups.bounds(batch, len(by))
            yield from together(batch, starts[:-1][sizes[:-1] <= most], sizes[:-1][sizes[:-1] <= most])
            for k in np.flatnonzero(sizes[:-1] > most).tolist():
                swept(batch.slice(int(starts[k]), int(sizes[k])), True)
            tail = batch.slice(int(starts[-1]))
            if len(tail) > most:
                swept(tail, False)
                tail, streamed = None, tail.slice(len(tail) - 1)
            if out:
                yield flushed()
        if streamed is not None:
            swept(streamed.slice(1), True)
            yield flushed()
        elif tail is not None:
            yield from together(tail, np.array([0]), np.array([len(tail)]))

    return placed.sortWithinPartitions(*by, low).mapInArrow(sweep, schema)


def winners(df: DataFrame, by: list[str], order: list[Column] | str, low: str = "lo", high: str = "hi") -> DataFrame:
    """`topmost` with each segment's width."""
    return topmost(df, by, order, low, high).withColumn("width", F.col("_e") - F.col("_s")).drop("_s", "_e")


def step_timeline(deltas: DataFrame, series: str, bucket: int) -> DataFrame:
    """(bucket, series, value) for all buckets from 0 to the last and all series, from rows (ts, series, delta).

    Deltas are summed for each bucket before anything is ordered, so a window holds one row for each
    bucket that changes; the stretch from a change to the next one is filled in from its row alone.
    Rows without a time count nowhere, those before time 0 in bucket 0.
    """
    timed = deltas.where("ts IS NOT NULL").select(F.greatest(F.floor(F.col("ts") / bucket).cast("long"), F.lit(0)).alias("bucket"), series, "delta")
    order = Window.partitionBy(series).orderBy("bucket")
    steps = timed.groupBy("bucket", series).agg(F.sum("delta").alias("delta"))
    # One row, of the sums and with them, so that both uses share one shuffle and what is below it runs once.
    end = F.broadcast(steps.agg(F.max(F.struct("bucket", "delta")).alias("_top")).select(F.col("_top.bucket").alias("_last")))
    steps = steps.select("bucket", series, F.sum("delta").over(order).alias("_run"), F.lead("bucket").over(order).alias("_next"), (F.row_number().over(order) == 1).alias("_first"))
    ends = steps.crossJoin(end).selectExpr("bucket", series, "_run", "if(_first, 0L, bucket) AS _from", "coalesce(_next - 1, _last) AS _upto")  # end: one row
    # First by STRETCH buckets, then each of these by single ones, so no array holds a long stretch whole.
    parts = ends.withColumn("_part", F.explode(F.expr(f"sequence(_from div {STRETCH}, _upto div {STRETCH})")))
    filled = parts.withColumn("_at", F.explode(F.expr(f"sequence(greatest(_from, _part * {STRETCH}), least(_upto, _part * {STRETCH} + {STRETCH - 1}))")))
    return filled.select(F.col("_at").alias("bucket"), series, F.when(F.col("_at") >= F.col("bucket"), F.col("_run")).otherwise(0).alias("value"))


def top_and_other(df: DataFrame, by: list[str], name: str, value: str, k: int, other: str = "Other") -> DataFrame:
    """Per group the k largest names and the sum of the rest."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).desc(), name))
    labelled = df.withColumn(name, F.when(rank <= k, F.col(name)).otherwise(other))
    return labelled.groupBy(*by, name).agg(F.sum(value).alias(value))


def overlap_bytes(ranges: DataFrame, mapped: DataFrame, by: list[str], kind: str) -> DataFrame:
    """ranges' columns, kind and bytes: how much of each range lies under mappings (by, lo, hi, kind)."""
    cond = (F.col("a.lo") < F.col("b.hi")) & (F.col("b.lo") < F.col("a.hi"))
    for k in by:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    width = F.least("a.hi", "b.hi") - F.greatest("a.lo", "b.lo")
    return ranges.alias("a").join(mapped.alias("b"), cond).select("a.*", F.col(f"b.{kind}").alias(kind), width.alias("bytes"))


def last_writer(maps: DataFrame, by: list[str]) -> DataFrame:
    """Page-table state from map and unmap events (by, lo, hi, seq, pa, unmap): per elementary range the last event's mapping. Ranges, never pages."""
    order = "seq" if isinstance(maps.schema["seq"].dataType, WHOLE) else [F.col("seq").desc()]
    return topmost(maps, by, order).where("NOT unmap").withColumn("width", F.col("_e") - F.col("_s"))


def sections(df: DataFrame, by: str, chunk: int) -> DataFrame:
    """df with section: numbers of the stretches of (lo, id) between which no range of the group is open."""
    order = ["lo", "id"]
    reached = running(df, [by], order, F.expr(f"lo div {chunk}"), {"_reach": ("max", F.col("hi"))}, before=True)
    begun = reached.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("lo") >= F.col("_reach")), 1).otherwise(0)).drop("_reach")
    return running(begun, [by], order, F.expr(f"lo div {chunk}"), {"section": ("sum", F.col("_new"))}).drop("_new")


class Lanes:
    """First-fit lanes: a tree over lanes of the least end in each half finds the first free one in the logarithm of their number."""

    FREE = -(1 << 63)

    def __init__(self):
        self.width, self.ends = 1, [self.FREE] * 2

    def place(self, lo: int, hi: int) -> int:
        if self.ends[1] > lo:  # all are taken: as many again
            leaves = self.ends[self.width :] + [self.FREE] * self.width
            self.width *= 2
            self.ends = [self.FREE] * self.width + leaves
            for k in range(self.width - 1, 0, -1):
                self.ends[k] = min(self.ends[2 * k], self.ends[2 * k + 1])
        k = 1
        while k < self.width:
            k = 2 * k if self.ends[2 * k] <= lo else 2 * k + 1
        lane = k - self.width
        self.ends[k] = hi
        while k := k // 2:
            self.ends[k] = min(self.ends[2 * k], self.ends[2 * k + 1])
        return lane


def lanes(df: DataFrame, by: str, chunk: int = 1 << 20) -> DataFrame:
    """First-fit lanes of overlapping ranges (by, id, lo, hi) in order of (lo, id).

    Greedy, so not a window frame: where no range is open every lane is free, so a group falls into
    sections that are packed by themselves. They arrive sorted, and one pass keeps the ends of the current section's lanes.
    """
    import pandas as pd

    def pack(frames):
        group, packed = None, Lanes()
        for pdf in frames:
            out = []
            for g, section, lo, hi in zip(pdf[by].tolist(), pdf["section"].tolist(), pdf["lo"].tolist(), pdf["hi"].tolist(), strict=True):
                if (g, section) != group:
                    group, packed = (g, section), Lanes()
                out.append(packed.place(lo, hi))
            yield pdf.drop(columns="section").assign(lane=pd.Series(out, index=pdf.index, dtype="int32"))

    cut = sections(df.select(by, "id", "lo", "hi"), by, chunk)
    ordered = cut.repartition(by, "section").sortWithinPartitions(by, "section", "lo", "id")
    return ordered.mapInPandas(pack, f"{by} long, id long, lo long, hi long, lane int")
