"""Benchmark decontamination with an FM-index per training shard.

Each task builds FM-indexes over shards of its documents: word symbols, a suffix array
by prefix doubling, its Burrows-Wheeler transform in a wavelet matrix, and positions
sampled every SAMPLE words. All windows of the benchmark are searched backwards through
wavelet ranks at once, occurrences are located by walking to sampled positions, and
their spans are merged per document.

Words outside the benchmark's vocabulary can't lie in an occurrence, so a shard holds
only stretches of benchmark words that are long enough for the shortest window; each
stretch ends with a separator that sorts by place.

Windows are broadcast in blocks of at most BLOCK_WINDOWS; more of them take one pass
per block, with the spans so far carried along in a written table. Null texts have no
words; an item whose text has none is never found; items of equal text are all counted.
The windows of an item whose id is null are hits like others; it is no member of `items`.
Repeated rows are searched each by itself, texts of any length whole; other columns go
along, those of the result's names are replaced. No documents give no rows, no items no hits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of_bytes, load, materialize
from .textvec import ALNUM, strings, words

WINDOW, SAMPLE, SHARD, BLOCK_WINDOWS, PERCENT = 13, 8, 400_000, 200_000, 5


class FMIndex:
    """Over symbols >= 1 and separators 0; `starts` are the positions after which a walk must not go further back."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, sigma: int):
        n = len(text)
        self.n = n
        # Separators are different from each other and below all words.
        seps = text == 0
        rank = np.where(seps, np.cumsum(seps) - 1, text + seps.sum()).astype(np.int64)
        k = 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - k if k < n else 0] = rank[k:] + 1
            key = rank * np.int64(n + sigma + 2) + after
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
            rank = new
            if k >= n or new[order[-1]] == n - 1:
                break
            k *= 2
        self.bwt = text[order - 1]
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        marked = np.zeros(n, bool)
        marked[::SAMPLE] = marked[starts] = True
        self.sampled = marked[order]
        self.slot = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]
        self.bits = max(1, int(sigma).bit_length())
        self.zeros, self.split, seq = [], [], self.bwt
        for bit in range(self.bits - 1, -1, -1):
            one = (seq >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            self.split.append(int(self.zeros[-1][-1]))
            seq = np.concatenate([seq[~one], seq[one]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before `at`."""
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            z, one = self.zeros[level], (symbol >> bit & 1).astype(bool)
            zl, zh = z[low], z[high]
            low = np.where(one, self.split[level] + low - zl, zl)
            high = np.where(one, self.split[level] + high - zh, zh)
        return high - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns (equal lengths, one per row) by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for column in patterns.T[::-1]:
            c = column[live]
            low[live], high[live] = self.less[c] + self.rank(c, low[live]), self.less[c] + self.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walks back until a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        away = np.flatnonzero(~self.sampled[rows])
        while len(away):
            c = self.bwt[rows[away]]
            rows[away] = self.less[c] + self.rank(c, rows[away])
            steps[away] += 1
            away = away[~self.sampled[rows[away]]]
        return self.positions[self.slot[rows]] + steps


@dataclass
class Windows:
    """A block of windows: the sorted vocabulary of word hashes, patterns by length (symbols from 1), item ids of each pattern."""

    vocabulary: np.ndarray
    patterns: dict[int, np.ndarray]
    items: dict[int, list[list[int]]]


def windows_of(benchmark: DataFrame, window: int) -> DataFrame:
    """Rows (key: the window's word hashes, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = strings(batch.column(1))
            w = words(data, off, ALNUM)
            ids, keys = [], []
            for i, item in enumerate(batch.column(0).to_pylist()):
                h = w.hash[w.first[i] : w.first[i + 1]].view(np.int64)
                for at in range(max(1, len(h) - window + 1) if len(h) else 0):
                    ids.append(item)
                    keys.append(h[at : at + window])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["item_id", "key"])

    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, key array<long>").groupBy("key").agg(F.collect_set("item_id").alias("items"))


def blocks_of(windows: DataFrame, limit: int) -> Iterator[Windows]:
    count = windows.count()
    parts = max(1, -(-count // limit))
    for part in range(parts):
        got = windows.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).toArrow().to_pylist()
        got.sort(key=lambda r: r["key"])
        vocabulary = np.unique(np.array([h for r in got for h in r["key"]], np.int64))
        by = defaultdict(list)
        for r in got:
            by[len(r["key"])].append(r)
        yield Windows(vocabulary, {n: np.searchsorted(vocabulary, np.array([r["key"] for r in rs], np.int64)) + 1 for n, rs in by.items()}, {n: [sorted(r["items"]) for r in rs] for n, rs in by.items()})


def _merged(spans: np.ndarray) -> np.ndarray:
    """Sorted, merged half-open spans (n x 2); touching ones become one."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    far = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > far[:-1]])
    return np.stack([spans[new, 0], np.append(far[:-1][new[1:]], far[-1])], axis=1)


class Shard:
    """Collects documents' stretches of benchmark words and finds windows in them."""

    def __init__(self, windows: Windows):
        self.windows = windows
        self.least = min(windows.patterns, default=0)
        self.reset()

    def reset(self) -> None:
        self.symbols, self.doc, self.word, self.size = [], [], [], 0

    def add(self, first_doc: int, w, docs: int) -> None:
        """w: the Words of `docs` documents, numbered from first_doc in the shard."""
        v = self.windows.vocabulary
        if not len(v) or not len(w.hash):
            return
        h = w.hash.view(np.int64)
        at = np.minimum(np.searchsorted(v, h), len(v) - 1)
        known = v[at] == h
        doc = np.repeat(np.arange(docs), np.diff(w.first))
        edge = np.concatenate([[True], (doc[1:] != doc[:-1]) | (known[1:] != known[:-1])])
        begin = np.flatnonzero(edge)
        length = np.diff(np.append(begin, len(h)))
        good = known[begin] & (length >= self.least)
        begin, length = begin[good], length[good]
        if not len(begin):
            return
        ends = np.cumsum(length + 1)
        index = np.arange(ends[-1]) - np.repeat(ends - length - 1 - begin, length + 1)
        last = ends - 1
        index[last] = 0
        symbols = at[index] + 1
        symbols[last] = 0
        owner = doc[index] + first_doc
        self.symbols.append(symbols)
        self.doc.append(owner)
        self.word.append(index - w.first[:-1][doc[index]])
        self.size += len(symbols)

    def find(self) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[int]]]:
        """Word spans and items by document of the shard."""
        spans, items = defaultdict(list), defaultdict(set)
        if not self.size:
            return spans, items
        text, doc, word = (np.concatenate(x) for x in (self.symbols, self.doc, self.word))
        starts = np.concatenate([[0], np.flatnonzero(text[:-1] == 0) + 1])
        index = FMIndex(text, starts, len(self.windows.vocabulary))
        present = np.diff(index.less) > 0
        for n, patterns in self.windows.patterns.items():
            possible = np.flatnonzero(present[patterns].all(axis=1))
            low, high = index.search(patterns[possible])
            hits = np.flatnonzero(high > low)
            if not len(hits):
                continue
            counts = (high - low)[hits]
            ends = np.cumsum(counts)
            rows = np.arange(ends[-1]) + np.repeat(low[hits] - ends + counts, counts)
            where, which = index.locate(rows), np.repeat(possible[hits], counts)
            pairs = np.unique(np.stack([doc[where], which]), axis=1)
            for d, p in pairs.T.tolist():
                items[d].update(self.windows.items[n][p])
            order = np.lexsort((word[where], doc[where]))
            d, a = doc[where][order], word[where][order]
            for i, j in zip(*(x.tolist() for x in (lambda s: (s, np.append(s[1:], len(d))))(np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])))), strict=True):
                spans[int(d[i])].extend(map(tuple, _merged(np.stack([a[i:j], a[i:j] + n], axis=1)).tolist()))
        return spans, items


def search(docs: DataFrame, windows: Windows, text: str = "text") -> DataFrame:
    """Adds _words, _spans (merged word spans) and _items to docs, or joins them to those that a former block has found."""
    plain = [c for c in docs.columns if c not in ("_words", "_spans", "_items")]
    former = "_spans" in docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    at = plain.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in plain) + ", _words long, _spans array<struct<a:int,b:int>>, _items array<long>"
    span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting, docs_in, bytes_in = Shard(shared.value), [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, docs_in, bytes_in
            spans, items = shard.find()
            first = 0
            for batch, n_words in waiting:
                rows = range(first, first + batch.num_rows)
                s, i = [spans.get(d, []) for d in rows], [items.get(d, set()) for d in rows]
                if former:
                    s = [x + [(q["a"], q["b"]) for q in old] for x, old in zip(s, batch.column("_spans").to_pylist(), strict=True)]
                    i = [x | set(old) for x, old in zip(i, batch.column("_items").to_pylist(), strict=True)]
                s = [[{"a": a, "b": b} for a, b in _merged(np.array(x, np.int64).reshape(-1, 2)).tolist()] for x in s]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in plain], pa.array(n_words), pa.array(s, span), pa.array([sorted(y for y in x if y is not None) for x in i], pa.list_(pa.int64()))], names=[*plain, "_words", "_spans", "_items"])
                first += batch.num_rows
            shard.reset()
            waiting, docs_in, bytes_in = [], 0, 0

        for batch in batches_of_bytes(batches, text, 2 << 20):
            data, off = strings(batch.column(at))
            w = words(data, off, ALNUM)
            shard.add(docs_in, w, batch.num_rows)
            waiting.append((batch, np.diff(w.first).astype(np.int64)))
            docs_in += batch.num_rows
            bytes_in += len(data)
            if shard.size >= SHARD or bytes_in >= 32 << 20:
                yield from flush()
        if waiting:
            yield from flush()

    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT, block_windows: int = BLOCK_WINDOWS, text: str = "text") -> DataFrame:
    """Adds to docs, in place of columns of these names: n_words, removal_spans (merged word spans that benchmark windows cover), n_hit, items (ids found), contaminated (n_hit at least `percent` per cent of the words)."""
    found = docs.drop("_words", "_spans", "_items", "n_words", "removal_spans", "n_hit", "items", "contaminated")
    blocks = blocks_of(materialize(windows_of(benchmark, window), "windows"), block_windows)
    for k, block in enumerate(blocks):
        found = search(found if not k else materialize(found, "searched"), block, text)
    n_hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda x, s: x + s["b"] - s["a"])
    out = found.withColumn("n_hit", n_hit).withColumnsRenamed({"_words": "n_words", "_spans": "removal_spans", "_items": "items"})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent))


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, load(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string")))), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


#: Windows as strings, joined: brute force over whole tables.
ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM starts),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes WHERE len(w) >= k),
hits AS (SELECT p.r, p.k, p.i, x.item_id FROM places p JOIN windows x ON p.k = x.k AND array_to_string(p.w[p.i : p.i + p.k - 1], ' ') = x.s),
covered AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS word FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
       coalesce(n.ids, sha256('')) AS items_sha256, coalesce(c.n_hit > 0 AND 20 * c.n_hit >= len(d.w), false) AS contaminated
FROM docs d LEFT JOIN covered c ON d.r = c.r LEFT JOIN named n ON d.r = n.r
"""
