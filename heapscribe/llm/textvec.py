"""Vectorised word and shingle hashing over Arrow string buffers.

Words are byte runs; their 64-bit hashes come from prefix sums of a polynomial
over a random byte table, so a whole slice of documents is hashed without a loop over words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=U)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 2**64)
_ABC = _rng.integers(0, 2**64, 6, dtype=U) | U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACED = np.ones(256, dtype=bool)  # words between white space
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, dtype=bool)  # words of ASCII letters and digits and of all that isn't ASCII
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=U)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(z: np.ndarray) -> np.ndarray:
    z = z ^ (z >> U(30))
    z *= U(0xBF58476D1CE4E5B9)
    z ^= z >> U(27)
    z *= U(0x94D049BB133111EB)
    z ^= z >> U(31)
    return z


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def piece_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """64-bit hashes of byte ranges that ascend and don't overlap; case matters."""
    out = np.empty(len(start), U)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + step, "right")))
        low, high = start[at], end[to - 1]
        sums = np.zeros(high - low + 1, U)
        np.cumsum(_BYTE[data[low:high]] * _power(_BASE, high - low), out=sums[1:])
        a, b = start[at:to] - low, end[at:to] - low
        out[at:to] = mix((sums[b] - sums[a]) * _power(_INVERSE, high - low)[a] + (b - a).astype(U) * _ABC[5])
        at = to
    return out


@dataclass
class Words:
    """Words of some documents: first word of each document (len docs + 1), hash, byte range in the buffer."""

    first: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray, step: int = 1 << 20) -> Words:
    """All words of the documents; works through `step` bytes at a time, cut where no word is split."""
    total, at, parts = len(data), 0, []
    first_byte = np.zeros(total + 1, dtype=bool)
    first_byte[off] = True
    while at < total:
        to = min(total, at + step)
        while to < total and table[LOWER[data[to]]] and not first_byte[to]:  # to the end of the word
            ahead = LOWER[data[to : to + 4096]]
            stop = np.flatnonzero(~table[ahead] | first_byte[to : to + len(ahead)])
            to += int(stop[0]) if len(stop) else len(ahead)
        low = LOWER[data[at:to]]
        is_word = table[low]
        before = np.empty_like(is_word)
        before[0], before[1:] = False, is_word[:-1]
        fb = first_byte[at : to + 1]
        before[fb[:-1]] = False
        after = np.empty_like(is_word)
        after[-1], after[:-1] = False, is_word[1:]
        after[fb[1:]] = False
        start = np.flatnonzero(is_word & ~before)
        end = np.flatnonzero(is_word & ~after) + 1
        sums = np.zeros(len(low) + 1, dtype=U)
        np.cumsum(_BYTE[low] * _power(_BASE, len(low)), out=sums[1:])
        h = (sums[end] - sums[start]) * _power(_INVERSE, len(low))[start]
        h += (end - start).astype(U) * _ABC[5]
        parts.append((mix(h), start + at, end + at))
        at = to
    if not parts:
        return Words(np.zeros(len(off), np.int64), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    h, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Words(np.searchsorted(start, off), h, start, end)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Per document: the sorted distinct 64-bit hashes of its shingles of `size` words; fewer words make one shingle."""
    data, off = strings(column)
    w = words(data, off, SPACED)
    n = len(w.hash)
    rolled = np.zeros(0, U)
    if n >= size:
        rolled = np.zeros(n - size + 1, U)
        for k in range(size):
            rolled += w.hash[k : n - size + 1 + k] * _ABC[k % 4] * U(2 * (k // 4) + 1)
        rolled = mix(rolled)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= size:
            x = np.sort(rolled[a : b - size + 1])
            keep = np.empty(len(x), dtype=bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif b > a:
            short = U(b - a)
            for k, h in enumerate(w.hash[a:b]):
                with np.errstate(over="ignore"):
                    short = short + h * _ABC[k % 4] * U(2 * (k // 4) + 1)
            out.append(mix(np.array([short], U) * _ABC[4]))
        else:
            out.append(np.zeros(0, U))
    return out
