"""Target-distribution importance resampling over hashed word runs.

Features of a text are its runs of 1 to n words, hashed to buckets by CRC-32. One scan of a document
keeps a ring of running CRC states, one for each of the last n starts; a word extends
each of them by a space and itself and opens a new one, so no run is ever put together
as a string. The buckets of a document, with their counts, are written once, next to
each task's totals; the totals give the gain of every bucket, and a document's weight is
the sum of its features' gains. Adding Gumbel noise that depends on doc_id and a seed
turns the highest scores into a draw without replacement in proportion to the weights.

Null and empty texts have no features and weight 0; documents of fewer than `least_words` words are
never drawn. A null doc_id is '' for the noise and comes last among equal scores; repeated
rows have features of their own, and rows alike in doc_id and score are interchangeable. Texts of
any length are one scan. An empty target gives gains from its smoothed zeros. Other columns
aren't read, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of_bytes, load, materialize, prefix_sums

RUN, BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 10_000, 2024, 10, 20
#: Bytes of words: ASCII digits and letters, of which capitals become small, and all that isn't ASCII. Others become a space.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def run_hashes(words: list[bytes], longest: int) -> array:
    """CRC-32 of every run of 1 to `longest` words, joined by one space, in one scan."""
    out, ring = array("L"), []
    for word in words:
        if ring:
            ring = [crc32(word, crc32(b" ", state)) for state in ring]
            out.extend(ring)
        state = crc32(word)
        out.append(state)
        if longest > 1:
            ring = [*ring[-(longest - 2) :], state] if longest > 2 else [state]
    return out


_HASHED = "doc_id long, n_words long, n_features long, buckets array<int>, counts array<long>, total boolean"
_HASHED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("total", pa.bool_())])


def hashed(docs: DataFrame, longest: int = RUN, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """A row for each document (doc_id, n_words, n_features, its buckets and their counts), and one of totals for each task."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def rows(ids, words, features, found, total) -> pa.RecordBatch:
        ends = np.cumsum([0, *[len(b) for b, _ in found]]).astype(np.int32)
        flat = [np.concatenate([x[k] for x in found]) if found else np.zeros(0) for k in (0, 1)]
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(f.astype(t))) for f, t in zip(flat, (np.int32, np.int64), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(features, pa.int64()), *lists, pa.array([total] * len(found), pa.bool_())], schema=_HASHED_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for batch in batches_of_bytes(batches, "text", 2 << 20):
            n_words, n_features, found = [], [], []
            for text in batch.column(1).to_pylist():
                words = text.encode().translate(PLAIN).split()
                hashes = np.frombuffer(run_hashes(words, longest), np.uint64)
                which, counts = np.unique(hashes % buckets, return_counts=True)
                which = which.astype(np.int64)
                totals[which] += counts
                n_words.append(len(words))
                n_features.append(len(hashes))
                found.append((which, counts))
            yield rows(batch.column(0), n_words, n_features, found, False)
        used = np.flatnonzero(totals)
        if len(used):
            yield rows([None], [None], [int(totals.sum())], [(used, totals[used])], True)

    return source.mapInArrow(run, _HASHED)


def totals(table: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket, from a table of `hashed`: at most `buckets` rows come to the driver."""
    summed = table.where("total").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy("x.buckets").agg(F.sum("x.counts").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in summed.collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln) of how much likelier a bucket is in the target, both smoothed by one."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + float(k)) / ((s + 1.0) * (t_all + float(k))))) for s, t in zip(source.tolist(), target.tolist(), strict=True)]


def noise(doc_id: int | None, seed: int) -> int:
    """floor(1000 times Gumbel noise) from the first 32 bits of a SHA-256 sum."""
    h = int.from_bytes(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(table: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of the documents of a table of `hashed`."""
    by_bucket = np.array(gain, np.int64)
    target = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, counts = batch.column(3), batch.column(4).flatten().to_numpy(zero_copy_only=False)
            sums = np.concatenate([[0], np.cumsum(by_bucket[lists.flatten().to_numpy(zero_copy_only=False)] * counts)]).astype(np.int64)
            edge = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            weight = sums[edge[1:]] - sums[edge[:-1]]
            score = weight + np.array([noise(d, seed) for d in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], pa.array(weight), pa.array(score)], schema=target)

    rows = table.where("NOT total").select("doc_id", "n_words", "n_features", "buckets", "counts")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, longest: int = RUN, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn); `target` needs a column text."""
    table = materialize(hashed(docs, longest, buckets), "hashed")
    wanted = materialize(hashed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets), "target")
    scored = weighed(table, gains(totals(table, buckets), totals(wanted, buckets)), seed)
    able = F.col("n_words") >= least_words
    draw = table.where("NOT total").agg(F.count_if(able)).first()[0] * percent // 100
    queued = scored.select("doc_id", "n_features", "weight", "score", F.when(able, 0).otherwise(1).alias("_unable"), (-F.col("score")).alias("_down"), F.when(able, 1).otherwise(0).cast("long").alias("_one"))
    ranked = prefix_sums(queued, ["_unable", "_down", "doc_id"], "_one", "_rank")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when((F.col("_unable") == 0) & (F.col("_rank") <= draw), F.col("_rank")).cast("long").alias("rank"))


def op13_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


#: CRC-32 by its table, over the distinct words.
ORACLE = r"""
WITH tab AS (SELECT list(list_reduce([CAST(i AS BIGINT)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
words AS (SELECT r, unnest(w) AS word FROM docs),
hashes AS (SELECT word, xor(list_reduce([4294967295] || list_transform(range(1, len(hex(word)) // 2 + 1), lambda k: CAST('0x' || substr(hex(word), 2 * k - 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM (SELECT word FROM words UNION ALL SELECT word FROM items) u), tab),
s AS (SELECT bucket, count(*) AS n FROM words JOIN hashes USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM items JOIN hashes USING (word) GROUP BY bucket),
gains AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM words) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM items) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t ON t.bucket = s.bucket),
weights AS (SELECT w.r, CAST(sum(g.gain) AS BIGINT) AS weight FROM words w JOIN hashes h ON h.word = w.word JOIN gains g ON g.bucket = h.bucket GROUP BY w.r),
scored AS (SELECT d.r, d.doc_id, CAST(len(d.w) AS BIGINT) AS n_features, coalesce(x.weight, 0) AS weight,
    coalesce(x.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM docs d LEFT JOIN weights x ON x.r = d.r),
drawn AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN d.rank <= (SELECT count(*) FROM drawn) * 10 // 100 THEN d.rank END AS rank FROM scored s LEFT JOIN drawn d ON d.r = s.r
"""
