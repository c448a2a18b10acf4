"""N-gram Jaccard join: a size-aware heavy-light set similarity join over word shingles.

Documents become sets of 64-bit shingle hashes; equal sets are one node. Two nodes a, b
link when den * |a & b| >= num * |a | b|, which needs an overlap of
c(a, b) = ceil(num (|a|+|b|) / (num+den)).

* Light sets (few shingles) enumerate all their subsets of the fixed sizes c that a
  partner can need. Sets that share a subset of size c and whose sizes need no more
  than c overlap for certain: no check follows.
* Heavy sets scan inverted lists. Shingles have one global order: rare ones first, those
  that stand in many documents last, ties by hash. Of n shingles the first
  n - ceil(num n / den) + 1 are filed, so two linked sets meet in a list; passages that many
  documents share end the order and are filed by hardly any. The order rests on counts over
  all documents (`hot_shingles`); any order gives the same links. In a list, sets are
  compared by parity signatures, of four bits for each shingle in which they may differ: each shingle of the symmetric
  difference flips one bit, so signatures that differ in more bits than linked sets can
  rule a pair out. Unrelated sets that meet by chance end here. What is left spans
  candidate groups, and each group is joined exactly by scanning the inverted lists of its
  members' shingles. Long lists and large groups are cut into tiles, and each pair of tiles
  is a task of its own.

The boundary is the size from which enumerating subsets costs more rows than the filed
shingles and the share of a check (`boundary`). Only spanning links leave a task, never
all pairs of a group, and no link between different sets is lost. Results are connected
components.

Null and empty texts have the empty set and link with nothing. A null doc_id takes part,
but can't be a component's id unless it stands alone. Repeated rows and equal sets are one
node and get one component; ties don't matter, as a component is named by its smallest
doc_id. Texts of any length are one set. Other columns than doc_id, text and `key` are not
read, whatever their names; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of_bytes, load, materialize
from .graph import components
from .textvec import U, mix, shingle_sets

SIZE, NUM, DEN = 3, 90, 100
TILE_DOCS, TILE_SHINGLES = 512, 500_000
TILE_LIST = 4096  # members of an inverted list that one task compares, or of each of two tiles
FILTER_WORDS = 1 << 18  # 64-bit words of the smallest filter of candidates: 2 MB
MOST_WORDS = 1 << 21  # and of the largest: 16 MB; one of more candidates lets more of the others pass, and exact joins follow
RANGES, CELLS = 512, 1 << 23  # shingles are counted in RANGES * CELLS cells, each range of them by one task at a time
HOT, MOST_HOT = 4, 1 << 20  # least count of a shingle that goes behind the others, and the most that are told apart: 5 MB, broadcast


def overlap(a: int, b: int, num: int, den: int) -> int:
    return -(-num * (a + b) // (num + den))


def filed(n: int, num: int, den: int) -> int:
    """How many of n shingles, the first in the global order, a set is filed under: one of them at least is in each linked set."""
    return n - -(-num * n // den) + 1


@cache
def subset_sizes(n: int, num: int, den: int) -> tuple[int, ...]:
    """Overlaps that a set of n elements can need with another set: one of its own size may be another only if some element may differ."""
    sizes = set()
    for b in range(-(-n * num // den), n * den // num + 1):
        c = overlap(n, b, num, den)
        if c <= min(n, b) and not (b == n and c == n):
            sizes.add(c)
    return tuple(sorted(sizes))


@cache
def boundary(num: int, den: int) -> int:
    """The largest size for which subsets are cheaper: subsets' rows against filed shingles and a quarter of a set's check."""
    n = 1
    while sum(comb(n, c) for c in subset_sizes(n, num, den)) <= filed(n, num, den) + (n + 64) / 4:
        n += 1
    return n - 1


def subsets(x: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of the fixed-size subsets of a light set; the low byte of a key is the subset's size."""
    n = len(x)
    if n > boundary(num, den):
        return np.zeros(0, U)
    y, keys = mix(x ^ U(0xA24BAED4963EE407)), []
    total = y.sum(dtype=U)
    for c in subset_sizes(n, num, den):
        without = np.array([y[list(i)].sum(dtype=U) for i in combinations(range(n), n - c)], dtype=U) if c < n else np.zeros(1, U)
        keys.append(mix(total - without + U(c)) & U(0xFFFFFFFFFFFFFF00) | U(c))
    return np.concatenate(keys) if keys else np.zeros(0, U)


def signature(x: np.ndarray, num: int, den: int) -> bytes:
    """Bit b: parity of the number of shingles that fall to b of a power of two of bits.

    They are four times as many as shingles in which linked sets of this size differ: unrelated sets' signatures differ in half of them.
    """
    bits = 1 << max(6, (8 * len(x) * (den - num) // (den + num)).bit_length())
    return np.packbits((np.bincount((x & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def digest(x: np.ndarray) -> int:
    """64-bit id of a set, as a signed long."""
    return int(mix(mix(x ^ U(0x632BE59BD9B4E019)).sum(dtype=U, keepdims=True) + U(len(x))).view(np.int64)[0])


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)))


def hot_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells (top 32 bits of the hash, ascending) of shingles that stand in many texts, and the binary logarithm of their counts.

    All texts are counted, a text once for each task that has it. Tasks send sorted cells as differences, by range; a range's counts
    fit in a fixed array. Of the counts from HOT the highest come back, MOST_HOT at most.
    """

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, parts, held = set(), [], 0

        def packed() -> pa.RecordBatch:
            cells = np.sort(np.concatenate(parts)).astype(np.int64)
            cut = np.searchsorted(cells, np.arange(RANGES + 1) * CELLS)
            rows = [(r, np.diff(cells[a:b] - r * CELLS, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()) for r, a, b in zip(range(RANGES), cut, cut[1:], strict=False) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())], names=["range", "cells"])

        for batch in batches_of_bytes(batches, "_text", 1 << 20):
            for x in shingle_sets(batch.column(0), size):
                node = digest(x) if len(x) else None
                if node is not None and node not in seen:
                    seen.add(node)
                    parts.append((x >> U(32)).astype(np.uint32))
                    held += len(x)
            if held >= 1 << 22:
                yield packed()
                parts, held = [], 0
        if parts:
            yield packed()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, now, touched, few = np.zeros(CELLS, np.int32), None, [], 0

        def hot() -> pa.RecordBatch:
            if few < CELLS // 8:  # a few cells: no walk through all
                own = np.unique(np.concatenate(touched))
                at = own[counts[own] >= HOT]
                out = pa.array(np.log2(counts[at]).astype(np.int32))
                counts[own] = 0
            else:
                at = np.flatnonzero(counts >= HOT)
                out = pa.array(np.log2(counts[at]).astype(np.int32))
                counts[:] = 0
            return pa.RecordBatch.from_arrays([pa.array(at + now * CELLS), out], names=["cell", "class"])

        for batch in batches:
            for r, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if r != now:
                    if now is not None:
                        yield hot()
                    now, touched, few = r, [], 0
                low, middle, high = np.frombuffer(raw.as_buffer(), np.uint8).reshape(3, -1).astype(np.int64)
                at = np.cumsum(low | middle << 8 | high << 16)
                first = _runs(at)
                counts[at[first]] += np.diff(np.append(first, len(at))).astype(np.int32)
                few += len(first)
                touched = [*touched, at[first]] if few < CELLS // 8 else []
        if now is not None:
            yield hot()

    rows = docs.select(F.col("text").alias("_text")).mapInArrow(sent, "range int, cells binary").repartition("range").sortWithinPartitions("range")
    found = materialize(rows.mapInArrow(counted, "cell long, class int"), "hot")
    total, least = 0, 64
    for row in sorted(found.groupBy("class").count().collect(), reverse=True):  # at most 31 rows
        total += row["count"]
        if total > MOST_HOT:
            break
        least = row["class"]
    got = found.where(F.col("class") >= least).orderBy("cell").toArrow()
    return got["cell"].to_numpy().astype(np.uint32), got["class"].to_numpy().astype(np.int8)


def signed(docs: DataFrame, size: int, num: int, den: int, key: str | None = None) -> DataFrame:
    """doc_id, n_shingles, node, heavy, light, signature, row_key (0 without `key`): keys stand once per node and task, copies have none."""
    source = docs.select("doc_id", F.col("text").alias("_text"), (F.col(key) if key else F.lit(0)).cast("long").alias("_row"))
    shared = docs.sparkSession.sparkContext.broadcast(hot_shingles(docs, size))
    light_most = boundary(num, den)
    heavy_least = -(-(light_most + 1) * num // den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, classes = shared.value
        seen, none = set(), np.zeros(0, U)

        def first(x: np.ndarray) -> np.ndarray:
            """The shingles that x is filed under."""
            k = filed(len(x), num, den)
            if not len(cells):
                return x[:k]
            own = (x >> U(32)).astype(np.uint32)
            at = np.minimum(np.searchsorted(cells, own), len(cells) - 1)
            return x[np.argsort(np.where(cells[at] == own, classes[at], 0), kind="stable")[:k]]

        for batch in batches_of_bytes(batches, "_text", 1 << 20):
            sets = shingle_sets(batch.column(1), size)
            nodes, heavy, light, bits = [], [], [], []
            for x in sets:
                node = digest(x) if len(x) else None
                new = node is not None and node not in seen
                seen.add(node)
                nodes.append(node)
                large = new and len(x) >= heavy_least
                heavy.append(first(x) if large else none)
                bits.append(signature(x, num, den) if large else None)
                light.append(subsets(x, num, den) if new else none)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(nodes, pa.int64()), _lists(heavy), _lists(light), pa.array(bits, pa.binary()), batch.column(2)], names=["doc_id", "n_shingles", "node", "heavy", "light", "signature", "row_key"])

    return source.mapInArrow(run, "doc_id long, n_shingles long, node long, heavy array<long>, light array<long>, signature binary, row_key long")


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def sure_links(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of light sets: of those that share a subset, each with the smallest one, where the subset is as large as their sizes need."""
    keyed = nodes.select(F.explode("light").alias("key"), "n", "node")
    heads = keyed.groupBy("key").agg(F.min(F.struct("n", "node")).alias("head"), F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key", "head")
    enough = num * (F.col("n") + F.col("head.n")) <= (num + den) * F.col("key").bitwiseAND(F.lit(255))
    linked = keyed.join(heads, "key").where((F.col("node") != F.col("head.node")) & enough)
    return linked.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct()


class Members:
    """Members of inverted lists, whose signatures can be compared many pairs at a time."""

    def __init__(self, n: np.ndarray, raw: pa.Array, num: int, den: int):
        self.n, self.num, self.den = n, num, den
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        self.at, self.size, self.data = offsets[:-1], np.diff(offsets), np.frombuffer(raw.buffers()[2], np.uint8)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def table(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of `size` bytes, longer ones folded, and the row in them of each member."""
        if size not in self.tables:
            own = np.flatnonzero(self.size == size)
            rows = self.data[self.at[own][:, None] + np.arange(size)]
            place = np.full(len(self.n), -1)
            place[own] = np.arange(len(own))
            if (self.size > size).any():
                more, where = self.table(2 * size)
                folded = np.flatnonzero(where >= 0)
                place[folded] = len(own) + where[folded]
                rows = np.concatenate([rows, more[:, :size] ^ more[:, size:]])
            self.tables[size] = np.ascontiguousarray(rows), place
        return self.tables[size]

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs (a, b) may link, by their sizes and signatures."""
        total = self.n[a] + self.n[b]
        spare = total - 2 * -(-self.num * total // (self.num + self.den))
        out = np.abs(self.n[a] - self.n[b]) <= spare
        size = np.minimum(self.size[a], self.size[b])
        for s in np.unique(size[out]).tolist():
            rows, place = self.table(s)
            pick = np.flatnonzero(out & (size == s))
            for part in np.array_split(pick, max(1, len(pick) * s >> 24)):
                flips = np.bitwise_count(rows[place[a[part]]].view(U) ^ rows[place[b[part]]].view(U)).sum(axis=1, dtype=np.int64)
                out[part] = flips <= spare[part]
        return out


SMALL_LIST = 16


def spanned(start: np.ndarray, end: np.ndarray, members: Members) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members that connect what pairs that may link connect in each list [start, end)."""
    left, right, size = [], [], end - start
    for s in range(2, SMALL_LIST + 1):
        at = start[size == s]
        if len(at):
            i, j = np.triu_indices(s, 1)
            a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            ok = members.near(a, b)
            left.append(a[ok])
            right.append(b[ok])
    for low, high in zip(start[size > SMALL_LIST].tolist(), end[size > SMALL_LIST].tolist(), strict=True):
        apart, reached = np.arange(low, high), []
        while len(apart):
            if reached:
                x = reached.pop()
            else:
                x, apart = int(apart[0]), apart[1:]
            ok = members.near(np.full(len(apart), x), apart)
            new = apart[ok]
            left.append(np.full(len(new), x))
            right.append(new)
            reached += new.tolist()
            apart = apart[~ok]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def pointers(lists: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) from rows (key, i, j, node, n, signature), sorted by (key, i, j) and each of these together in one partition."""

    def out(rows: pa.Table) -> pa.RecordBatch:
        key, i, j, node, n = (rows.column(c).to_numpy() for c in range(5))
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        a, b = spanned(first, np.append(first[1:], len(key)), Members(n, rows.column(5).combine_chunks().cast(pa.binary()), num, den))
        pairs = np.unique(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.concat_tables([*([held] if held else []), pa.Table.from_batches([batch])])
            if held.num_rows >= 4 * TILE_LIST or held.nbytes > 32 << 20:
                key, i, j = (held.column(c).to_numpy() for c in range(3))
                cut = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))
                if len(cut):
                    yield out(held.slice(0, cut[-1] + 1).combine_chunks())
                    held = held.slice(cut[-1] + 1).combine_chunks()
        if held and held.num_rows:
            yield out(held.combine_chunks())

    return lists.select("key", "i", "j", "node", "n", "signature").mapInArrow(run, "a long, b long")


def candidates(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that span what heavy sets may link, from one row (node, n, heavy, signature) for each set."""
    rows = nodes.where("signature IS NOT NULL")
    keyed = rows.select(F.explode("heavy").alias("key"), "n")
    shared = keyed.groupBy("key").agg(F.count("*").alias("k"), F.min("n").alias("least"), F.max("n").alias("most"))
    shared = shared.where(f"k > 2 OR k = 2 AND {den} * least >= {num} * most")  # two sets must be of like size
    shared = materialize(shared.select("key", F.ceil(F.col("k") / TILE_LIST).cast("int").alias("t")), "shared")
    bits = nodes.sparkSession.sparkContext.broadcast(node_filter(shared.withColumnRenamed("key", "node")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heavy = batch.column(1)
            keys = heavy.flatten().to_numpy()
            keep = filtered(bits.value, keys)
            node = np.repeat(batch.column(0).to_numpy(), np.diff(heavy.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(node[keep])], names=["key", "node"])

    met = rows.select("node", "heavy").mapInArrow(run, "key long, node long").join(shared, "key")
    placed = met.withColumn("tile", F.expr("cast(pmod(xxhash64(node), t) AS int)")).withColumn("other", F.explode(F.expr("sequence(0, t - 1)")))
    placed = placed.select("key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "node")
    lists = placed.join(rows.select("node", "n", "signature"), "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return pointers(lists, num, den).distinct()


def scan(sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning links of a tile (all of side 0) or between two tiles, by scanning the inverted lists of each set's shingles."""
    n = np.array([len(x) for x in sets])
    cross, parent, out = side.any(), list(range(len(sets))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(flat, kind="stable")
    sorted_, lists = flat[order], owner[order]
    starts = _runs(sorted_)
    lengths = np.diff(np.append(starts, len(sorted_)))
    which = np.empty(len(flat), np.int64)
    which[order] = np.repeat(np.arange(len(starts)), lengths)
    ends = np.cumsum(n)
    for i in range(len(sets)):
        if cross and side[i]:
            continue
        mine = which[ends[i] - n[i] : ends[i]]
        mine = mine[lengths[mine] > 1]
        if not len(mine):
            continue
        size = lengths[mine]
        upto = np.cumsum(size)
        at = np.arange(upto[-1]) + np.repeat(starts[mine] - upto + size, size)
        shared = np.bincount(lists[at], minlength=len(sets))
        ok = (num + den) * shared >= num * (n + n[i])
        if cross:
            ok &= side == 1
        else:
            ok[: i + 1] = False
        for j in np.flatnonzero(ok).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                out.append((i, j))
    return out


def checked(tiles: DataFrame, num: int, den: int) -> DataFrame:
    """From rows (grp, i, j, side, node, shingles), each (grp, i, j) together in one partition: the spanning links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sides, sets = None, [], [], []

        def links() -> pa.RecordBatch:
            found = scan(sets, np.array(sides), num, den) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            rows = zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True)
            for grp, i, j, side, node, raw in rows:
                if key != (grp, i, j):
                    if key:
                        yield links()
                    key, nodes, sides, sets = (grp, i, j), [], [], []
                nodes.append(node)
                sides.append(side)
                sets.append(np.frombuffer(raw, U))
        if key:
            yield links()

    return tiles.select("grp", "i", "j", "side", "node", "shingles").mapInArrow(run, "a long, b long")


def filter_words(nodes: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """A bit set of `words` words that holds all of `nodes` (column node) and a few others by chance, as (w, bits)."""
    return nodes.select(F.expr(f"shiftrightunsigned(node, 40) & {words - 1}").cast("int").alias("w"), F.expr("shiftleft(1L, cast(node & 63 AS int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))


def node_filter(nodes: DataFrame) -> np.ndarray:
    """filter_words as an array, of about 16 bits for each of the nodes within FILTER_WORDS and MOST_WORDS."""
    words = min(MOST_WORDS, max(FILTER_WORDS, 1 << (nodes.count() // 4).bit_length()))
    bits = np.zeros(words, np.int64)
    got = filter_words(nodes, words).toArrow()
    bits[got["w"].to_numpy()] = got["bits"].to_numpy()
    return bits


def filtered(bits: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Which of the nodes (signed longs) may be in the filter."""
    x = nodes.view(U)
    return (bits[(x >> U(40) & U(len(bits) - 1)).astype(np.int64)].view(U) >> (x & U(63)) & U(1)) == 1


def candidate_sets(docs: DataFrame, candidates: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of candidate nodes. A filter of bounded size spares the others' shuffle; an exact join follows."""
    shared = docs.sparkSession.sparkContext.broadcast(node_filter(candidates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches_of_bytes(batches, "_text", 1 << 20):
            sets = [x for x in shingle_sets(batch.column(0), size) if len(x)]
            ids = np.array([digest(x) for x in sets], np.int64)
            nodes, raw = [], []
            for i in np.flatnonzero(filtered(shared.value, ids)).tolist():
                if (node := int(ids[i])) not in seen:
                    seen.add(node)
                    nodes.append(node)
                    raw.append(sets[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(raw, pa.binary())], names=["node", "shingles"])

    return docs.select(F.col("text").alias("_text")).mapInArrow(run, "node long, shingles binary")


def join(docs: DataFrame, size: int = SIZE, num: int = NUM, den: int = DEN, key: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id per row of docs (doc_id, text).

    With a long column `key` that tells rows of one doc_id apart, also row_key, alone (no other
    row in the component) and kept: (doc_id, row_key) is the component's first, null ids last.
    """
    rows = materialize(signed(docs, size, num, den, key), "signed", compression="zstd")
    # One row for each set: copies in different tasks meet here.
    nodes = rows.where("size(heavy) > 0 OR size(light) > 0").select("node", F.col("n_shingles").alias("n"), "heavy", "light", "signature").dropDuplicates(["node"])
    nodes = materialize(nodes, "nodes")
    sure = sure_links(nodes, num, den)
    groups = materialize(components(candidates(nodes, num, den)), "groups")
    members = groups.join(nodes.select("node", "n"), "node").select("node", F.col("component").alias("grp"), "n")
    tiles = members.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / TILE_DOCS), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("t"))
    members = materialize(members.join(tiles, "grp").select("node", "grp", "t", F.expr("cast(pmod(xxhash64(node), t) AS int)").alias("tile")), "members")
    sets = candidate_sets(docs, members, size).dropDuplicates(["node"]).join(members, "node")
    spread = sets.withColumn("k", F.explode(F.expr("sequence(0, t - 1)"))).select("grp", F.least("tile", "k").alias("i"), F.greatest("tile", "k").alias("j"), (F.col("tile") > F.col("k")).cast("int").alias("side"), "node", "shingles")
    spread = spread.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    links = materialize(checked(spread, num, den), "links")
    merged = materialize(components(links.union(sure)), "components")
    names = ["doc_id", "n_shingles", *(["row_key"] if key else [])]
    classed = rows.select(*names, "node").join(merged, "node", "left").select(*names, F.coalesce("component", "node").alias("class"))
    # Written, so that the join's sides are plain and Spark can split a class of very many copies.
    first = [F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")] if key else []
    least = materialize(classed.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), *first, F.count("*").alias("copies")).where("copies > 1").drop("copies"), "least")
    joined, out = classed.join(least, "class", "left"), ["doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id")]
    if key:
        first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row_key") == F.col("first.row_key"))
        out += ["row_key", F.col("first").isNull().alias("alone"), (F.col("first").isNull() | first).alias("kept")]
    return joined.select(*out)


def op5_jaccard(spark, sf_dir: str) -> DataFrame:
    return join(load(spark, sf_dir, "documents"))


#: Brute force: all pairs that share a shingle, and labels passed along links until none changes.
ORACLE = r"""
WITH RECURSIVE
spelled AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) END AS g
  FROM spelled),
-- Equal sets are one node, named by their smallest doc_id.
nodes AS (SELECT min(doc_id) AS node, list_sort(g) AS g FROM grams WHERE len(g) > 0 GROUP BY ALL),
single AS (SELECT node, len(g) AS n, unnest(g) AS s FROM nodes),
shared AS (SELECT a.node AS a, b.node AS b, a.n AS na, b.n AS nb, count(*) AS k FROM single a JOIN single b ON a.s = b.s AND a.node < b.node AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 90 * (na + nb - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS seen FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.seen = e.a),
named AS (SELECT node, min(seen) AS least FROM reach GROUP BY node)
SELECT d.doc_id, CAST(len(d.g) AS BIGINT) AS n_shingles, coalesce(m.least, n.node, d.doc_id) AS component_id
FROM grams d LEFT JOIN nodes n ON list_sort(d.g) = n.g LEFT JOIN named m ON n.node = m.node
"""
