"""Source divergence audit: how far the word use of each source lies from that of the other sources of its language.

Two passes. The first writes each text in a plain form (its terms, one space apart) in
chunks of bounded size, together with every chunk's distinct terms and the number of
documents that have them; their sums are exact document frequencies. The second brings
each chunk the terms of its own that its language keeps and recounts their occurrences
with an Aho-Corasick automaton of these terms, padded with the delimiter. So no automaton
holds more terms than its chunk has, however large the vocabulary gets.

The counts become sparse postings: of each term the sources that have it, and how often. A pair of sources is
worked out from them alone: what a term that neither source has is worth is one product,
a term that one of them has is counted by its frequency, and only terms that both have
meet in pairs.

Null text, lang and source are ''. Texts without terms, and empty ones, make their
(lang, source) group occur. A language that keeps no term gives pairs of value 0. Repeated
rows are documents of their own; texts of any length are scanned whole. Equal values rank by
the item's UTF-8 bytes. Other columns aren't read, whatever their names; no rows give no rows.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches_of_bytes, load, materialize

LEAST_DOCS, SCALE, SMOOTH, TOP = 3, 1_000_000_000, 1, 200
CHUNK = 32 << 20  # characters of plain text
PAIRS = 1 << 20  # pairs of sources that are worked out at a time
#: Bytes of terms: ASCII letters, of which capitals become small, and all that isn't ASCII. Others become the delimiter.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_CHUNKS = "chunk long, lang string, sources array<string>, texts binary, term string, docs long"
_CHUNKS_ARROW = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("sources", pa.list_(pa.string())), ("texts", pa.binary()), ("term", pa.string()), ("docs", pa.int64())])


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows of documents (chunk, lang, sources, texts: those of some documents in plain form, a line each, compressed) and of terms (chunk, lang, term, docs)."""
    source = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        first, number, held, packer = TaskContext.get().partitionId() << 32, 0, 0, zstandard.ZstdCompressor(level=3)
        seen: dict[str, Counter] = defaultdict(Counter)

        def batch_of(n: int, **columns) -> pa.RecordBatch:
            columns["chunk"] = [first + number] * n
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _CHUNKS_ARROW], schema=_CHUNKS_ARROW)

        def terms() -> Iterator[pa.RecordBatch]:
            for lang, counts in seen.items():
                names, docs_of = [t.decode() for t in counts], list(counts.values())
                for at in range(0, len(names), 50_000):
                    part = names[at : at + 50_000]
                    yield batch_of(len(part), lang=[lang] * len(part), term=part, docs=docs_of[at : at + 50_000])
            seen.clear()

        for batch in batches_of_bytes(batches, "text", 2 << 20):
            by_lang = defaultdict(lambda: ([], []))
            for lang, source, text in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                words = text.encode().translate(PLAIN).split()
                seen[lang].update(set(words))
                sources, texts = by_lang[lang]
                sources.append(source)
                texts.append(b" ".join(words))
                held += len(texts[-1])
            yield batch_of(len(by_lang), lang=list(by_lang), sources=[x for x, _ in by_lang.values()], texts=[packer.compress(b"\n".join(x)) for _, x in by_lang.values()])
            if held >= size:
                yield from terms()
                number, held = number + 1, 0
        yield from terms()

    return source.mapInArrow(run, _CHUNKS)


def recount(chunked: DataFrame, groups: Groups, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, sources, counts): the kept terms' occurrences in each chunk, by number of source, from a written table of chunks."""
    # One shuffle both adds up a term's documents and leaves it in its chunks' rows; these go on as one row for each chunk and task.
    found = chunked.where("term IS NOT NULL").select("chunk", "lang", "term", F.sum("docs").over(Window.partitionBy("lang", "term")).alias("docs"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows() -> list[pa.RecordBatch]:
            got = pa.Table.from_batches(held).group_by(["chunk", "lang"]).aggregate([("term", "list")])
            held.clear()
            words = got.column("term_list").combine_chunks()
            return pa.table({"chunk": got.column("chunk"), "lang": got.column("lang"), "terms": pc.binary_join(words, " ")}).to_batches()

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= 32 << 20:
                yield from rows()
                size = 0
        if held:
            yield from rows()

    words = found.where(F.col("docs") >= least_docs).select("chunk", "lang", "term").mapInArrow(packed, "chunk long, lang string, terms string")
    words = words.select("chunk", "lang", "terms", F.lit(None).cast("array<string>").alias("sources"), F.lit(None).cast("binary").alias("texts"))
    texts = chunked.where("term IS NULL").select("chunk", "lang", F.lit(None).cast("string").alias("terms"), "sources", "texts")
    target = pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        import zstandard

        group, names, automaton, hits, packer = None, [], None, {}, zstandard.ZstdDecompressor()

        def counted() -> Iterator[pa.RecordBatch]:
            if not hits:
                return
            number = groups.numbers(group[1])
            ids = np.concatenate([np.frombuffer(x, np.int32) for x in hits.values()])
            which = np.repeat(np.array([number[s] for s in hits], np.int64), [len(x) for x in hits.values()])
            keys, counts = np.unique(ids.astype(np.int64) << 32 | which, return_counts=True)
            term, source = keys >> 32, (keys & 0xFFFFFFFF).astype(np.int32)
            first = np.flatnonzero(np.diff(term, prepend=-1))
            edge = pa.array(np.append(first, len(term)).astype(np.int32))
            out = pa.Table.from_arrays([pa.array([group[1]] * len(first)), pa.array(names).take(pa.array(term[first])), pa.ListArray.from_arrays(edge, pa.array(source)), pa.ListArray.from_arrays(edge, pa.array(counts.astype(np.int64)))], schema=target)
            yield from out.to_batches(max_chunksize=20_000)

        for batch in batches_of_bytes(batches, "texts", 4 << 20):
            for chunk, lang, terms, sources, texts in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if (chunk, lang) != group:
                    yield from counted()
                    group, names, automaton, hits = (chunk, lang), [], None, {}
                if terms is not None:  # these come first
                    names += terms.split(" ")
                elif names:
                    if automaton is None:
                        automaton = ahocorasick.Automaton()
                        for i, name in enumerate(names):
                            automaton.add_word(f" {name} ", i)
                        automaton.make_automaton()
                    for source, text in zip(sources, packer.decompress(texts).decode().split("\n"), strict=True):
                        hits.setdefault(source, array("i")).extend(map(itemgetter(1), automaton.iter(f" {text} ")))
        yield from counted()

    both = words.unionByName(texts).repartition("chunk").sortWithinPartitions("chunk", "lang", F.col("terms").isNull())
    return both.mapInArrow(run, "lang string, term string, sources array<int>, counts array<long>")


def postings(counted: DataFrame) -> DataFrame:
    """(lang, term, sources, counts) with one row for each term, and rows without a term: each task's totals of a language by source."""
    target = pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def lists(lang: list, term: list, row: np.ndarray, source: np.ndarray, count: np.ndarray) -> pa.Table:
        """Sums by (row, source), as one list for each row."""
        keys, which = np.unique(row << 32 | source, return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, which, count)
        first = np.flatnonzero(np.diff(keys >> 32, prepend=-1))
        edge = pa.array(np.append(first, len(keys)).astype(np.int32))
        return pa.Table.from_arrays([pa.array(lang, pa.string()), pa.array(term, pa.string()), pa.ListArray.from_arrays(edge, pa.array((keys & 0xFFFFFFFF).astype(np.int32))), pa.ListArray.from_arrays(edge, pa.array(total))], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, totals = None, defaultdict(Counter)

        def merged(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = rows.combine_chunks()
            both = pa.table({"lang": rows.column("lang"), "term": rows.column("term")})
            lang, term = both.column("lang").to_pylist(), both.column("term").to_pylist()
            new = np.array([True, *[a != b or x != y for a, b, x, y in zip(term[1:], term, lang[1:], lang, strict=False)]])
            each = pc.list_value_length(rows.column("sources")).to_numpy()
            row = np.repeat(np.cumsum(new) - 1, each).astype(np.int64)
            source, count = (pc.list_flatten(rows.column(c)).to_numpy().astype(np.int64) for c in ("sources", "counts"))
            at = np.flatnonzero(new).tolist()
            out = lists([lang[i] for i in at], [term[i] for i in at], row, source, count)
            by_lang = np.repeat(np.array([lang[i] for i in at], object), pc.list_value_length(out.column("sources")).to_numpy())
            s, n = (pc.list_flatten(out.column(c)).to_numpy() for c in ("sources", "counts"))
            for name in set(lang):
                mine = by_lang == name
                sums = np.zeros(int(s.max()) + 1, np.int64)
                np.add.at(sums, s[mine], n[mine])
                for k in np.flatnonzero(sums).tolist():
                    totals[name][k] += int(sums[k])
            yield from out.to_batches()

        for batch in batches:
            held = pa.concat_tables([*([held] if held else []), pa.Table.from_batches([batch])])
            if held.num_rows >= 50_000:  # all but the last term are whole
                lang, term = held.column("lang"), held.column("term")
                last = pc.and_(pc.equal(lang, lang[-1]), pc.equal(term, term[-1])).to_numpy()
                if cut := int(len(last) - last[::-1].argmin()) if not last.all() else 0:
                    yield from merged(held.slice(0, cut))
                    held = held.slice(cut)
        if held and held.num_rows:
            yield from merged(held)
        for name, sums in totals.items():
            yield from lists([name], [None], np.zeros(len(sums), np.int64), np.array(list(sums), np.int64), np.array(list(sums.values()), np.int64)).to_batches()

    ordered = counted.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return ordered.mapInArrow(run, "lang string, term string, sources array<int>, counts array<long>")


@dataclass
class Groups:
    """The sources of each language, numbered in order; with their totals and the number of kept terms, once these are known.

    Tasks get it whole: it has a row for each source, and the result has one for each pair of them, so it is the square root of the result at most.
    """

    sources: dict[str, list[str]]
    totals: dict[str, np.ndarray] = field(default_factory=dict)
    terms: dict[str, int] = field(default_factory=dict)

    def numbers(self, lang: str) -> dict[str, int]:
        return {s: k for k, s in enumerate(self.sources[lang])}

    def none(self, lang: str) -> np.ndarray:
        """The share, by source, of a term that the source doesn't have."""
        return share(np.zeros(len(self.sources[lang]), np.int64), self.totals[lang] + SMOOTH * self.terms[lang])


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / whole), by long division in steps of a thousand: no product leaves 64 bits."""
    out, rest = np.divmod(count + SMOOTH, whole)
    step = 1
    while step < SCALE:
        digit, rest = np.divmod(rest * 1000, whole)
        out, step = out * 1000 + digit, step * 1000
    return out + 1


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def scored(stored: DataFrame, groups: Groups, top: int = TOP) -> DataFrame:
    """From postings, partial rows (lang, source, other, term, p, value): of a pair of sources, what the terms that both have add to the terms taken one by one (other set);
    how many terms of a source have share p (p set); terms of a source with their value, among them its `top` best (term set)."""
    target = pa.schema([("lang", pa.string()), ("source", pa.int32()), ("other", pa.int32()), ("term", pa.string()), ("p", pa.int64()), ("value", pa.int64())])

    def rows(lang: str, n: int, **columns) -> pa.RecordBatch:
        columns["lang"] = [lang] * n
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in target], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[str, dict[int, int]] = defaultdict(dict)
        often: dict[str, Counter] = defaultdict(Counter)
        best: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)  # sources, values, terms

        def leading(lang: str) -> None:
            source, value, term = (np.concatenate(x) for x in zip(*best[lang], strict=True))
            order = np.lexsort((term, -value, source))
            place = np.arange(len(order)) - np.repeat(f := np.flatnonzero(np.diff(source[order], prepend=-1)), np.diff(np.append(f, len(order))))
            best[lang] = [tuple(x[order[place < top]] for x in (source, value, term))]

        def meet(lang: str, size: np.ndarray, source: np.ndarray, p: np.ndarray) -> None:
            """Adds the pairs within each of some terms, of `size` postings each, PAIRS at a time."""
            p0, width = groups.none(lang), len(groups.sources[lang])
            each = np.repeat(size, size)  # as many partners has each posting, itself among them
            begin = np.repeat(np.cumsum(size) - size, size)
            upto, at = np.cumsum(each), 0
            while at < len(each):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
                a = np.repeat(np.arange(at, to), each[at:to])
                b = np.arange(len(a)) - np.repeat(np.cumsum(each[at:to]) - each[at:to] - begin[at:to], each[at:to])
                a, b = a[a != b], b[a != b]
                pa_, pb, qa, qb = p[a], p[b], p0[source[a]], p0[source[b]]
                part = _f(pa_, pb) - _f(pa_, qb) - _f(qa, pb) + _f(qa, qb)
                key = source[a].astype(np.int64) * width + source[b]
                if width * width <= len(key):  # few sources: sums in a square of them, else by sorting
                    keys, which = np.arange(width * width), key
                else:
                    keys, which = np.unique(key, return_inverse=True)
                total, met = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
                np.add.at(total, which, part)
                met[which] = True
                mine = pairs[lang]
                for k, v in zip(keys[met].tolist(), total[met].tolist(), strict=True):
                    mine[k] = mine.get(k, 0) + v
                at = to

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, mine in pairs.items():
                keys, width = np.array(list(mine), np.int64), len(groups.sources[lang])
                yield rows(lang, len(keys), source=(keys // width).astype(np.int32), other=(keys % width).astype(np.int32), value=list(mine.values()))
            pairs.clear()

        for batch in batches:
            langs = pc.unique(batch.column(0)).to_pylist()
            for lang in langs:
                own = batch.filter(pc.equal(batch.column(0), lang)) if len(langs) > 1 else batch
                size = pc.list_value_length(own.column(2)).to_numpy().astype(np.int64)
                source, n = pc.list_flatten(own.column(2)).to_numpy(), pc.list_flatten(own.column(3)).to_numpy()
                v, totals = groups.terms[lang], groups.totals[lang]
                p = share(n, totals[source] + SMOOTH * v)
                q = np.repeat(share(np.add.reduceat(n, np.cumsum(size) - size), totals.sum() + SMOOTH * v), size)
                keys, counts = np.unique(p << 20 | source, return_counts=True) if len(totals) <= 1 << 20 else np.unique(np.stack([p, source]), axis=1, return_counts=True)
                values = zip((keys >> 20).tolist(), (keys & 0xFFFFF).tolist(), strict=True) if keys.ndim == 1 else zip(*keys.tolist(), strict=True)
                often[lang].update(dict(zip(values, counts.tolist(), strict=True)))
                more = np.flatnonzero(p > q)
                if len(more):
                    term = np.array([t.encode() for t in own.column(1).to_pylist()], object)
                    best[lang].append((source[more], _f(p[more], q[more]), term[np.repeat(np.arange(len(size)), size)[more]]))
                    if sum(len(x[0]) for x in best[lang]) > 4 * top * len(totals) + 200_000:
                        leading(lang)
                meet(lang, size, source, p)
            if sum(map(len, pairs.values())) > 4 * PAIRS:
                yield from flushed()
        yield from flushed()
        for lang, counts in often.items():
            yield rows(lang, len(counts), source=[k[1] for k in counts], p=[k[0] for k in counts], value=list(counts.values()))
        for lang in best:
            leading(lang)
            source, value, term = best[lang][0]
            yield rows(lang, len(source), source=source, term=[t.decode() for t in term], value=value)

    return stored.where("term IS NOT NULL").mapInArrow(run, "lang string, source int, other int, term string, p long, value long")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: the other sources of the language, and the terms that the source uses more than its language does."""
    spark = docs.sparkSession
    chunked = materialize(chunks(docs), "chunks", compression="zstd")
    sources = defaultdict(list)
    for lang, source in sorted(chunked.where("term IS NULL").select("lang", F.explode("sources").alias("source")).distinct().collect()):
        sources[lang].append(source)
    groups = Groups(dict(sources))
    stored = materialize(postings(recount(chunked, groups, least_docs)), "postings", compression="zstd")
    groups.totals = {lang: np.zeros(len(names), np.int64) for lang, names in sources.items()}
    each = stored.where("term IS NULL").select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", "x.sources").agg(F.sum("x.counts"))
    for lang, k, n in each.collect():
        groups.totals[lang][k] = n
    groups.terms = dict.fromkeys(sources, 0) | dict(stored.where("term IS NOT NULL").groupBy("lang").count().collect())
    found = materialize(scored(stored, groups, top), "scored")

    rows = [(lang, k, name, groups.terms[lang], int(p)) for lang, names in sources.items() for k, (name, p) in enumerate(zip(names, groups.none(lang) if groups.terms[lang] else np.ones(len(names), np.int64), strict=True))]
    table = spark.createDataFrame(rows, "lang string, k int, name string, terms long, p0 long")
    mine, other = table.select("lang", F.col("k").alias("source"), F.col("name").alias("own"), "terms", "p0"), table.select("lang", F.col("k").alias("other"), F.col("name").alias("item"), F.col("p0").alias("q0"))
    f = lambda p, q: f"({p} - {q}) * ({p} - {q}) div {q}"
    often = found.where("p IS NOT NULL").groupBy("lang", "source", "p").agg(F.sum("value").alias("n")).join(mine, ["lang", "source"]).join(other, "lang").where("source <> other")
    ones = often.selectExpr("lang", "source", "other", f"n * ({f('p', 'q0')} - {f('p0', 'q0')}) AS value")
    others = often.selectExpr("lang", "other AS source", "source AS other", f"n * ({f('q0', 'p')} - {f('q0', 'p0')}) AS value")
    neither = mine.join(other, "lang").where("source <> other").selectExpr("lang", "source", "other", f"terms * ({f('p0', 'q0')}) AS value")
    both = found.where("other IS NOT NULL").select("lang", "source", "other", "value")
    pairs = neither.unionByName(ones).unionByName(others).unionByName(both).groupBy("lang", "source", "other").agg(F.sum("value").alias("value")).join(other.drop("q0"), ["lang", "other"])
    used = found.where("term IS NOT NULL").select("lang", "source", F.col("term").alias("item"), "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    out = None
    for part, df, most in (("pair", pairs, None), ("term", used, top)):
        ranked = df.select("lang", "source", "item", "value").withColumn("rank", place)
        ranked = ranked if most is None else ranked.where(F.col("rank") <= most)
        named = ranked.join(mine, ["lang", "source"]).select("lang", F.col("own").alias("source"), F.lit(part).alias("part"), "item", "value", "rank")
        out = named if out is None else out.unionByName(named)
    return out


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(load(spark, sf_dir, "documents"))


#: Every group with every kept term of its language, as a plain product.
ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT g.lang, g.source, g.term, g.n, CAST(1 + CAST(1000000000 AS HUGEINT) * (g.n + 1) // (g.total + v.v) AS HUGEINT) AS p FROM grid g JOIN v ON v.lang = g.lang),
whole AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM counts GROUP BY lang, term),
q AS (SELECT w.lang, w.term, CAST(1 + CAST(1000000000 AS HUGEINT) * (w.n + 1) // (w.total + v.v) AS HUGEINT) AS q FROM whole w JOIN v ON v.lang = w.lang),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM (SELECT DISTINCT lang, source FROM docs) a JOIN (SELECT DISTINCT lang, source FROM docs) b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST((p.p - q.q) * (p.p - q.q) // q.q AS BIGINT) AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) u)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
