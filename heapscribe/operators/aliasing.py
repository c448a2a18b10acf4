"""Bytes that aliased ranges are charged with over time: an address counts for the highest usage that lives over it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import groups

STRETCH = 1 << 20  # bytes of address space that one sweep covers
NEVER = (1 << 63) - 1  # the end of what lives on
USAGES = 13  # fixed value: number of usages, of which a higher one wins


class Charges:
    """Bytes by usage over elementary segments, while ranges come and go.

    A tree over the segments: a range counts at the few nodes that make it up, and a node's
    bytes are those of its two halves, with all that is less than its own highest usage raised to it. A change
    costs the logarithm of the number of segments, however many ranges lie over one another.
    """

    def __init__(self, points: list[int]):
        segments = max(1, len(points) - 1)
        self.width = 1 << (segments - 1).bit_length()
        self.counts: list[dict[int, int]] = [{} for _ in range(2 * self.width)]
        self.bytes = [[0] * (USAGES + 1) for _ in range(2 * self.width)]  # first those that nothing covers
        for k in range(len(points) - 1):
            self.bytes[self.width + k][0] = points[k + 1] - points[k]
        self.plain = [b[0] for b in self.bytes]
        for k in range(self.width - 1, 0, -1):
            self.bytes[k][0] = self.bytes[2 * k][0] + self.bytes[2 * k + 1][0]

    @property
    def total(self) -> list[int]:
        return self.bytes[1]

    def _sum(self, k: int) -> None:
        own = [self.plain[k]] + [0] * USAGES if k >= self.width else [a + b for a, b in zip(self.bytes[2 * k], self.bytes[2 * k + 1], strict=True)]
        if self.counts[k]:
            top = max(self.counts[k]) + 1
            own[: top + 1] = [0] * top + [sum(own[: top + 1])]
        self.bytes[k] = own

    def change(self, first: int, last: int, usage: int, by: int) -> None:
        """One range more (or, by -1, less) of a usage over the segments from first to before last."""
        low, high = first + self.width, last + self.width
        while low < high:
            for k in ([low] if low & 1 else []) + ([high - 1] if high & 1 else []):
                counts = self.counts[k]
                counts[usage] = counts.get(usage, 0) + by
                if not counts[usage]:
                    del counts[usage]
                self._sum(k)
            low, high = (low + 1) // 2, high // 2
        low, high = (first + self.width) // 2, (last - 1 + self.width) // 2
        while low:
            self._sum(low)
            if high != low:
                self._sum(high)
            low, high = low // 2, high // 2


def swept(rows: list[tuple[int, int, int, int | None, int]]) -> list[tuple[int, int, int]]:
    """(ts, usage, delta) from ranges (lo, hi, start, end, usage): what changes at each time, once for all that happens then."""
    points = sorted({x for r in rows for x in r[:2]})
    place = {p: k for k, p in enumerate(points)}
    events = sorted([(r[2], 1, r) for r in rows] + [(r[3], -1, r) for r in rows if r[3] is not None], key=lambda e: e[0])
    charges, former, out = Charges(points), [0] * (USAGES + 1), []
    for k, (ts, by, (lo, hi, _, _, usage)) in enumerate(events):
        charges.change(place[lo], place[hi], usage, by)
        if k + 1 == len(events) or events[k + 1][0] != ts:
            now = charges.total
            out += [(ts, u - 1, now[u] - former[u]) for u in range(1, USAGES + 1) if now[u] != former[u]]
            former = now
    return out


def celled(lo: np.ndarray, hi: np.ndarray, start: np.ndarray, end: np.ndarray, usage: np.ndarray) -> tuple[np.ndarray, ...]:
    """(group, ts, usage, delta) as `swept` has them, for many groups of n ranges at once: arrays of groups by ranges, `end` NEVER for none.

    Each range takes the cells, of a segment and a time, that no range of a higher usage has, so n ranges cost n cubed.
    """
    order = np.argsort(-usage, axis=1, kind="stable")
    lo, hi, start, end, usage = (np.take_along_axis(x, order, 1) for x in (lo, hi, start, end, usage))
    points, times = (np.sort(np.concatenate(x, axis=1), axis=1) for x in ((lo, hi), (start, end)))
    widths, (count, n) = np.diff(points), lo.shape
    free, held = np.ones((count, 2 * n - 1, 2 * n), bool), np.empty((count, n, 2 * n), np.int64)
    for k in range(n):
        over = (lo[:, k, None] <= points[:, :-1]) & (points[:, 1:] <= hi[:, k, None])
        lives = (start[:, k, None] <= times) & (times < end[:, k, None])
        mine = free & over[:, :, None] & lives[:, None, :]
        held[:, k] = (widths[:, :, None] * mine).sum(axis=1)
        free &= ~mine
    for k in range(n - 1, 0, -1):  # one row for each usage
        same = usage[:, k] == usage[:, k - 1]
        held[:, k - 1] += np.where(same[:, None], held[:, k], 0)
        held[same, k] = 0
    delta = np.diff(held, axis=2, prepend=0)
    delta *= (times != NEVER)[:, None, :]
    g, k, t = np.nonzero(delta)
    return g, times[g, t], usage[g, k], delta[g, k, t]


def changes(df: DataFrame, by: list[str], low: str, high: str, start: str, end: str, usage: str = "usage", stretch: int = STRETCH) -> DataFrame:
    """(by, ts, usage, delta): how the bytes charged to each usage change over time within `by`.

    A range lives from `start` to before `end` (null: on); when the highest over an address ends, the next one has it.
    Charges of different addresses add up, so ranges are cut at multiples of `stretch`, and
    each stretch is swept by itself: a group of any size is the work of many tasks, and one holds the ranges of a stretch.
    Empty ranges and lives, and rows without a range, a start or a usage, change nothing.
    """
    real = df.where((F.col(low) < F.col(high)) & F.col(start).isNotNull() & F.col(usage).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start))))
    binned = real.select(*by, F.col(low).alias("_lo"), F.col(high).alias("_hi"), F.col(start).cast("long").alias("_from"), F.col(end).cast("long").alias("_to"), F.col(usage).cast("int").alias("_usage"), F.explode(F.expr(f"sequence({low} div {stretch}, ({high} - 1) div {stretch})")).alias("_bin"))
    cut = binned.withColumns({"_lo": F.expr(f"greatest(_lo, _bin * {stretch})"), "_hi": F.expr(f"least(_hi, (_bin + 1) * {stretch})")})
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{b}` {types[b]}" for b in by) + ", ts long, usage int, delta long"
    keys = [*by, "_bin"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch: pa.RecordBatch, first: np.ndarray, found) -> pa.RecordBatch:
            g, *columns = found
            at = pa.array(first[np.asarray(g, np.int64)])
            named = [batch.column(k).take(at) for k in range(len(by))] + [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64()), strict=True)]
            return pa.RecordBatch.from_arrays(named, schema=pa.schema([*[batch.schema.field(k) for k in range(len(by))], ("ts", pa.int64()), ("usage", pa.int32()), ("delta", pa.int64())]))

        for batch in groups.whole(batches, len(keys)):
            lo, hi, start, end, usage = (batch.column(len(keys) + k).fill_null(NEVER if k == 3 else 0).to_numpy(zero_copy_only=False) for k in range(5))
            starts, sizes = groups.bounds(batch, len(keys))
            for first, rows in groups.even(starts, sizes, lambda n: 4 * n * n):
                yield made(batch, first, celled(lo[rows], hi[rows], start[rows], end[rows], usage[rows]))
            for first, size in zip(starts[sizes > groups.SMALL].tolist(), sizes[sizes > groups.SMALL].tolist(), strict=True):
                rows = slice(first, first + size)
                ends = [None if e == NEVER else e for e in end[rows].tolist()]
                found = swept(list(zip(lo[rows].tolist(), hi[rows].tolist(), start[rows].tolist(), ends, usage[rows].tolist(), strict=True)))
                yield made(batch, np.array([first]), ([0] * len(found), *(zip(*found, strict=True) if found else ([], [], []))))

    rows = cut.select(*keys, "_lo", "_hi", "_from", "_to", "_usage")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(sweep, schema)
