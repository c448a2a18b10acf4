"""Groups of rows that arrive sorted, for work that takes many small ones at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SMALL = 32  # rows of a group that is worked out beside others of its size
CELLS = 1 << 21  # cells of such groups that are held at once
GATHERED, BYTES = 8, 1 << 25  # batches, and their bytes, that are worked out at once


def bounds(batch: pa.RecordBatch, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Where groups of equal leading columns begin, and their sizes."""
    new = np.zeros(max(0, batch.num_rows - 1), bool)
    for column in batch.columns[:keys]:
        a, b = column.slice(1), column.slice(0, len(new))
        new |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        if column.null_count:
            new |= pc.xor(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.flatnonzero(new) + 1]) if batch.num_rows else np.zeros(0, np.int64)
    return starts, np.diff(starts, append=batch.num_rows)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, several put together into one, and none without rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if len(held) == GATHERED or sum(b.nbytes for b in held) >= BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def whole(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut anew so that none ends within a group; a group that lies over many is put together once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [held[-1].slice(held[-1].num_rows - 1)] if held else []
        edge = int(bounds(pa.concat_batches([*last, batch]), keys)[0][-1]) - len(last)
        if held and edge >= 0:
            yield pa.concat_batches([*held, batch.slice(0, edge)])
            held = [batch.slice(edge)]
        elif not held and edge > 0:
            yield batch.slice(0, edge)
            held = [batch.slice(edge)]
        else:
            held.append(batch)
    if held:
        yield pa.concat_batches(held)


def even(starts: np.ndarray, sizes: np.ndarray, cells: Callable[[int], int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Small groups by their size: (their first rows, their rows as groups by rows), no more than CELLS cells at once; `cells` is those of a group of n."""
    for n in np.unique(sizes[sizes <= SMALL]).tolist():
        of_size, step = starts[sizes == n], max(1, CELLS // cells(n))
        for k in range(0, len(of_size), step):
            first = of_size[k : k + step]
            yield first, first[:, None] + np.arange(n)
