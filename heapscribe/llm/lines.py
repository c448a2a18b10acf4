"""Line dedup by a segment-partition edit join.

Distinct lines are compared in code points. Lines of n points, n the shorter's, may differ
by `allowed(n)` edits: one for each `per` points, `tau` at most. Two lines link when their
edit distance is no more than that; where it is none, only equal lines do, which are one
node at any length. A line of n points is cut into allowed(n) + 1 segments of even length.
Of two linked lines the shorter (or equally long) has a segment that stands unchanged
in the longer near the same place, so each line is filed under (its length, segment
number, segment) and probes, for each length down to its own less tau, the few places
that the multi-match-aware bounds leave for each segment.

A filed or probing line carries a 28-bit parity signature of its points; an edit flips
at most two bits of it, so a list yields only pairs whose signatures differ in at most
2 tau bits. Lists with few such pairs emit them; from a list with many, or too long to be
compared in one go, its members become a group that is cut into tiles, and each pair of tiles is a task of its own that
only keeps spanning links. All are verified by banded bit-parallel edit distance, many
pairs at a time. Linked lines form classes (connected components); of each class the
first occurrence by doc_id and line number stays.

Lines are split at line feeds; lines of white space only don't count. Null and empty
texts have no lines; a null doc_id sorts last. Repeated rows are documents of their own,
whose lines after the first row's go (which of equal rows comes first is arbitrary). Lines
of any length are compared whole. Other columns than doc_id and text are not read, whatever
their names; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of_bytes, load, materialize
from .graph import components
from .jaccard import filtered, node_filter
from .textvec import U, mix

TAU, PER = 2, 12  # at most two edits, and one for each 12 code points
SIGNATURE_BITS = 28
PAIRS_A_MEMBER = 4  # lists with more pairs than this for each member become groups
TILE = 1024
_POINT = 0x9E3779B97F4A7C15
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(max(n, 1), base, dtype=U)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class Lines:
    """The lines of some texts as one run of code points, with their places and 64-bit ids."""

    def __init__(self, texts: list[str | None]):
        found = [[x for x in (t or "").split("\n") if x and not x.isspace()] for t in texts]
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        self.text = [x for lines in found for x in lines]
        self.n = np.fromiter(map(len, self.text), np.int64, len(self.text))
        self.start = np.cumsum(self.n) - self.n
        self.points = np.frombuffer("".join(self.text).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = len(self.points)
        hashed = mix((self.points.astype(U) + U(1)) * U(_POINT))
        self.sums = np.zeros(size + 1, U)
        np.cumsum(hashed * _powers(_BASE, size), out=self.sums[1:])
        self.inverse = _powers(_INVERSE, size + 1)
        self.node = mix(self.hash(self.start, self.start + self.n) + self.n.astype(U)).view(np.int64)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def signature(self, which: np.ndarray) -> np.ndarray:
        """Bit b: parity of the number of points whose hash falls to b."""
        kind = (self.points * np.uint32(0x9E3779B1)) >> np.uint32(16)
        bits = np.int64(1) << (kind % np.uint32(SIGNATURE_BITS)).astype(np.int64)
        run = np.zeros(len(bits) + 1, np.int64)
        np.bitwise_xor.accumulate(bits, out=run[1:])
        return run[self.start[which] + self.n[which]] ^ run[self.start[which]]


def allowed(n: np.ndarray, tau: int, per: int) -> np.ndarray:
    """Edits by which a line of n code points and a longer one may differ."""
    return np.clip(n // per, 0, tau)


def segments(n: np.ndarray, tau: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, length) of each of the tau + 1 segments; the last ones are longer by one where n doesn't divide."""
    parts = tau + 1
    short, longer = n // parts, n % parts
    out = []
    for i in range(parts):
        extra = np.maximum(0, i - (parts - longer))
        out.append((i * short + extra, short + (i >= parts - longer)))
    return out


def keys(lines: Lines, which: np.ndarray, tau: int, per: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(lines, keys, role): role 0 files a line, role 1 + d probes for lines shorter by d. The shorter line's length sets the edits and so the segments."""

    def tagged(at: np.ndarray, size: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
        return mix(lines.hash(at, at + size) + length.astype(U) * U(0xD6E8FEB86659FD93) + U((i + 1) * 0xA24BAED4963EE407 % 2**64))

    for edits in range(1, tau + 1):
        for d in range(edits + 1):
            own = which[allowed(lines.n[which] - d, tau, per) == edits]
            start, n = lines.start[own], lines.n[own]
            for i, (p, size) in enumerate(segments(n - d, edits)):
                if not d:
                    yield own, tagged(start + p, size, n, i), 0
                low = max(-i, d - (edits - i))
                high = min(i, d + (edits - i))
                for shift in range(low, high + 1):
                    fits = (p + shift >= 0) & (p + shift + size <= n)
                    yield own[fits], tagged((start + p + shift)[fits], size[fits], (n - d)[fits], i), 1 + d


def linked(a: list[np.ndarray], b: list[np.ndarray], tau: int, per: int) -> np.ndarray:
    """Which pairs of code-point arrays are within the edits that the shorter one's length allows."""
    edits = allowed(np.minimum([len(x) for x in a], [len(x) for x in b]), tau, per) if a else np.zeros(0, int)
    out = np.zeros(len(a), bool)
    for t in range(1, tau + 1):
        pick = np.flatnonzero(edits == t)
        out[pick] = within([a[i] for i in pick], [b[i] for i in pick], t)
    return out


def within(a: list[np.ndarray], b: list[np.ndarray], tau: int) -> np.ndarray:
    """Whether edit distances of pairs of code-point arrays are at most tau: banded bit vectors, all pairs step by step together.

    Bit 63 - 2 tau + k of a pair's words stands for row t - tau + k of the band at column t.
    """
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    out = np.zeros(len(a), bool)
    near = np.flatnonzero(np.abs(na - nb) <= tau)
    near = near[np.argsort(-nb[near], kind="stable")]
    top, below = U(63), U(62)
    for at in range(0, len(near), 4096):
        pick = near[at : at + 4096]
        m, k = int(nb[pick].max(initial=0)), len(pick)
        rows = np.zeros((m + 2 * tau + tau + 1, k), np.uint32)
        columns = np.zeros((m + 1, k), np.uint32)
        for j, x in enumerate(pick.tolist()):  # points are shifted by one: 0 matches nothing
            rows[tau : tau + len(a[x]), j] = a[x].astype(np.uint32) + 1
            columns[: len(b[x]), j] = b[x].astype(np.uint32) + 1
            columns[len(b[x]) :, j] = 0xFFFFFFFF
        vp = np.full(k, (2**64 - 1) << (63 - tau) & (2**64 - 1), U)
        vn, score = np.zeros(k, U), np.full(k, tau, np.int64)
        lengths, size = nb[pick], na[pick]
        over = lengths + tau - size
        done = lengths == 0
        out[pick[done]] = size[done] <= tau
        for t in range(m):
            live = int(np.searchsorted(-lengths, -t, "left"))  # pairs are in descending length; these have a column t
            if live < len(vp):
                vp, vn, score = vp[:live], vn[:live], score[:live]
            x = np.zeros(live, U)
            for i in range(2 * tau + 1):
                x |= (rows[t + i, :live] == columns[t, :live]).astype(U) << U(63 - 2 * tau + i)
            d0 = (((x & vp) + vp) ^ vp) | x | vn
            hp, hn = vn | ~(d0 | vp), d0 & vp
            score += 1 - (d0 >> top).astype(np.int64)
            d1 = d0 >> U(1)
            vp, vn = hn | ~(d1 | hp), d1 & hp
            ends = np.flatnonzero(lengths[:live] == t + 1)
            if len(ends):
                distance = score[ends].copy()
                for r in range(2 * tau):
                    use = over[ends] > r
                    bit = below - U(r)
                    distance -= np.where(use, (vp[ends] >> bit & U(1)).astype(np.int64) - (vn[ends] >> bit & U(1)).astype(np.int64), 0)
                out[pick[ends]] = distance <= tau
    return out


def _new_lines(lines: Lines, seen: set) -> np.ndarray:
    new = []
    for i, node in enumerate(lines.node.tolist()):
        if node not in seen:
            seen.add(node)
            new.append(i)
    return np.array(new, np.int64)


def line_nodes(docs: DataFrame) -> DataFrame:
    """doc_id, _row, nodes: the ids of a document's lines in their order."""
    source = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_bytes(batches, "_text", 2 << 20):
            lines = Lines(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(lines.first.astype(np.int32)), pa.array(lines.node))], names=["doc_id", "_row", "nodes"])

    return source.mapInArrow(run, "doc_id long, _row long, nodes array<long>")


def filed(docs: DataFrame, tau: int, per: int) -> DataFrame:
    """(key, node, info) rows of each task's distinct lines that are long enough; info: signature * 8 + role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches_of_bytes(batches, "_text", 2 << 20):
            lines = Lines(batch.column(0).to_pylist())
            which = _new_lines(lines, seen)
            which = which[lines.n[which] >= per]
            if not len(which):
                continue
            signature = np.zeros(len(lines.n), np.int64)
            signature[which] = lines.signature(which)
            for own, key, role in keys(lines, which, tau, per):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(lines.node[own]), pa.array((signature[own] * 8 + role).astype(np.int32))], names=["key", "node", "info"])

    return docs.select(F.col("text").alias("_text")).mapInArrow(run, "key long, node long, info int")


def listed(rows: DataFrame, tau: int) -> DataFrame:
    """From rows sorted by key, node and info within partitions: candidate pairs (a, b, grp null) or, from lists with many, members (a, b null, grp)."""

    def of_list(node: np.ndarray, role: np.ndarray, signature: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Pairs of a list; None where they, or the pairs to compare, are too many."""
        at, probe = np.flatnonzero(role == 0), np.flatnonzero(role > 0)
        if len(at) * len(probe) > 4 * TILE**2:
            return None
        found, count, limit = [], 0, PAIRS_A_MEMBER * len(node)
        for x in range(0, len(probe), 1024):
            block = probe[x : x + 1024]
            near = np.bitwise_count(signature[block][:, None] ^ signature[at][None, :]) <= 2 * tau
            i, j = np.nonzero(near)
            i, j = node[block[i]], node[at[j]]
            keep = i != j
            i, j = np.minimum(i, j)[keep], np.maximum(i, j)[keep]
            pairs = np.unique(np.stack([i, j]), axis=1)
            count += pairs.shape[1]
            if count > limit and count > 64:
                return None
            found.append(pairs)
        return tuple(np.concatenate(found, axis=1)) if found else (node[:0], node[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "grp"]

        def out(part: np.ndarray) -> Iterator[pa.RecordBatch]:
            key, node, info = part
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            role = info & 7
            filed_here = np.add.reduceat((role == 0).astype(np.int64), edge) > 0
            probed = np.add.reduceat((role > 0).astype(np.int64), edge) > 0
            least, most = np.minimum.reduceat(node, edge), np.maximum.reduceat(node, edge)
            ends = np.append(edge[1:], len(key))
            pairs, members = [], []
            for q in np.flatnonzero(filed_here & probed & (least != most)).tolist():
                s = slice(edge[q], ends[q])
                got = of_list(node[s], role[s], info[s] >> 3)
                if got is None:
                    own = np.unique(node[s])
                    grp = int(mix(mix(own.view(U)).sum(dtype=U, keepdims=True)).view(np.int64)[0])
                    members.append((own, grp))
                elif len(got[0]):
                    pairs.append(got)
            if pairs:
                a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=names)
            for own, grp in members:
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.nulls(len(own), pa.int64()), pa.array(np.full(len(own), grp))], names=names)

        held: list[np.ndarray] = []
        for batch in batches:
            part = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            # A line that several tasks hold stands in its lists once for each of them; they are neighbours here.
            part = part[:, np.concatenate([[True], (part[:, 1:] != part[:, :-1]).any(axis=0)])] if part.shape[1] else part
            cut = int(np.searchsorted(part[0], part[0][-1], "left")) if part.shape[1] else 0
            if held and part.shape[1] and held[0][0, -1] != part[0, -1]:  # the key that was held ends here
                yield from out(np.concatenate([*held, part[:, :cut]], axis=1))
                held = []
            elif cut:
                yield from out(part[:, :cut])
            if cut < part.shape[1]:
                held.append(part[:, cut:])
        if held:
            yield from out(np.concatenate(held, axis=1))

    return rows.mapInArrow(run, "a long, b long, grp long")


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, line) of wanted nodes; a filter of fixed size spares the others' shuffle, exact joins follow."""
    shared = docs.sparkSession.sparkContext.broadcast(node_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches_of_bytes(batches, "_text", 2 << 20):
            lines = Lines(batch.column(0).to_pylist())
            likely = np.flatnonzero(filtered(shared.value, lines.node))
            fresh = []
            for i in likely.tolist():
                if (node := int(lines.node[i])) not in seen:
                    seen.add(node)
                    fresh.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(lines.node[np.array(fresh, np.int64)]), pa.array([lines.text[i] for i in fresh], pa.string())], names=["node", "line"])

    return docs.select(F.col("text").alias("_text")).mapInArrow(run, "node long, line string").dropDuplicates(["node"])


def _points(line: str) -> np.ndarray:
    return np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)


def verified(pairs: DataFrame, tau: int, per: int) -> DataFrame:
    """(a, b) of the rows (a, b, x, y) whose lines x and y link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of_bytes(iter([batch]), "x", 1 << 20):
                ok = linked(list(map(_points, part.column(2).to_pylist())), list(map(_points, part.column(3).to_pylist())), tau, per)
                yield part.select(["a", "b"]).filter(pa.array(ok))

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def tiled(rows: DataFrame, tau: int, per: int) -> DataFrame:
    """From (grp, i, j, side, node, line), each (grp, i, j) together in one partition: spanning links (a, b) of a tile or between two."""

    def links(nodes: list[int], sides: list[int], lines: list[str]) -> pa.RecordBatch:
        points = [_points(x) for x in lines]
        all_ = Lines.__new__(Lines)
        all_.n = np.array([len(p) for p in points], np.int64)
        all_.start = np.cumsum(all_.n) - all_.n
        all_.points = np.concatenate(points)
        signature = all_.signature(np.arange(len(points)))
        side, parent, found = np.array(sides), np.arange(len(points)), []
        cross = bool(side.any())

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i in range(len(points)):
            if cross and side[i]:
                continue
            near = (np.bitwise_count(signature ^ signature[i]) <= 2 * tau) & (np.abs(all_.n - all_.n[i]) <= tau)
            near &= (side == 1) if cross else (np.arange(len(points)) > i)
            mine = root(i)
            todo = [j for j in np.flatnonzero(near).tolist() if root(j) != mine]
            if todo:
                ok = linked([points[i]] * len(todo), [points[j] for j in todo], tau, per)
                for j, good in zip(todo, ok.tolist(), strict=True):
                    if good and root(j) != root(i):
                        parent[root(j)] = root(i)
                        found.append((nodes[i], nodes[j]))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sides, lines = None, [], [], []
        for batch in batches:
            for grp, i, j, side, node, line in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != (grp, i, j):
                    if len(nodes) > 1:
                        yield links(nodes, sides, lines)
                    key, nodes, sides, lines = (grp, i, j), [], [], []
                nodes.append(node)
                sides.append(side)
                lines.append(line)
        if len(nodes) > 1:
            yield links(nodes, sides, lines)

    return rows.select("grp", "i", "j", "side", "node", "line").mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, tau: int = TAU, per: int = PER) -> DataFrame:
    """(node, component) of all lines that are linked with a different line."""
    rows = filed(docs, tau, per).repartition("key").sortWithinPartitions("key", "node", "info")
    found = materialize(listed(rows, tau).distinct(), "line_candidates", compression="zstd")
    pairs, members = found.where("grp IS NULL").select("a", "b"), found.where("grp IS NOT NULL").select(F.col("a").alias("node"), "grp").distinct()
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(members.select("node")).distinct()
    texts = materialize(line_texts(docs, wanted), "line_texts", compression="zstd")
    spelled = pairs.join(texts.select(F.col("node").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("line").alias("y")), "b")
    tiles = members.groupBy("grp").agg(F.ceil(F.count("*") / TILE).cast("int").alias("t"))
    placed = members.join(tiles, "grp").select("node", "grp", "t", F.expr("cast(pmod(xxhash64(node), t) AS int)").alias("tile"))
    spread = placed.withColumn("k", F.explode(F.expr("sequence(0, t - 1)"))).select("grp", F.least("tile", "k").alias("i"), F.greatest("tile", "k").alias("j"), (F.col("tile") > F.col("k")).cast("int").alias("side"), "node")
    grouped = spread.join(texts, "node").repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    links = materialize(verified(spelled, tau, per).union(tiled(grouped, tau, per)), "line_links")
    return materialize(components(links), "line_classes")


def dedup(docs: DataFrame, tau: int = TAU, per: int = PER) -> DataFrame:
    """Per row of docs (doc_id, text): n_lines, n_kept and removed, the ascending numbers (from 0, of lines that count) of lines that repeat or nearly repeat an earlier one."""
    nodes = materialize(line_nodes(docs), "line_nodes", compression="zstd")
    joined = classes(docs, tau, per)
    single = nodes.select("doc_id", "_row", F.posexplode("nodes").alias("line", "node"))
    # The first place of each line, then of each class: both aggregates are summed before the shuffle.
    first = single.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "_row", "line")).alias("place"), F.count("*").alias("n"))
    classed = first.join(joined, "node", "left").withColumn("class", F.coalesce("component", "node"))
    least_place = classed.groupBy("class").agg(F.min("place").alias("place"), F.sum("n").alias("n"))
    kept = least_place.select(F.col("place._row").alias("_row"), F.col("place.line").alias("line"))
    kept = kept.groupBy("_row").agg(F.collect_list("line").alias("kept"))
    everything = "sequence(0, size(nodes) - 1)"
    removed = F.expr(f"CASE WHEN size(nodes) = 0 THEN cast(array() AS array<int>) ELSE array_except({everything}, coalesce(kept, cast(array() AS array<int>))) END")
    return nodes.join(kept, "_row", "left").select("doc_id", F.size("nodes").cast("long").alias("n_lines"), removed.alias("removed")).withColumn("n_kept", F.col("n_lines") - F.size("removed"))


def op7_lines(spark, sf_dir: str) -> DataFrame:
    return dedup(load(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_kept", "removed")
