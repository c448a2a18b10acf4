"""Quality classifier: similarity-weighted nearest-neighbour voting in a latent-semantic space.

A text's terms are n-grams of its compressed character-class sequence (runs of letters
count once), its words, word repeats and word lengths, hashed to a fixed number of columns. The
labelled documents' weighted term matrix is factored (truncated SVD through its Gram
matrix); the labelled vectors, at most MAX_LABELLED, are broadcast, and every document
is compared with all of them in blocks of exact cosine products. The k nearest vote,
weighted by a power of their similarity.

Null and empty texts have no terms; their score is the share of label 1 among the
labelled. Rows with a null label are not learnt from; doc_ids with several labels count
once per label. No labelled row at all gives 0.5 throughout. Equal texts get equal scores,
repeated rows too; of neighbours that tie for the last place any may vote. Texts of any
length are read whole. `score` keeps all other columns, whatever their names, and replaces
one of its own name; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of_bytes, load
from .textvec import SPACED, strings, words

MAX_LABELLED = 6000  # bound of the labelled sample that is learnt from and broadcast
TERMS, DIMENSIONS, NEIGHBOURS, POWER, BLOCK = 1024, 48, 21, 4, 256
THRESHOLD = 0.3

_CLASS = np.arange(256, dtype=np.int64)
_CLASS[97:123] = _CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48


def terms(column: pa.Array) -> np.ndarray:
    """Documents x TERMS: square roots of relative term frequencies; all zero without text."""
    data, off = strings(column)
    n = len(off) - 1
    if not len(data):
        return np.zeros((n, TERMS), np.float32)
    c = _CLASS[data]
    new = np.ones(len(c), dtype=bool)
    new[1:] = c[1:] != c[:-1]
    new[off[:-1][off[:-1] < len(c)]] = True
    at = np.flatnonzero(new)
    seq, doc = c[at], np.searchsorted(off, at, "right") - 1
    kinds, salt = [(doc, seq * 7919 + 1)], [0.5]
    for k in (2, 3, 4):
        if len(seq) >= k:
            code = np.zeros(len(seq) - k + 1, np.int64)
            for i in range(k):
                code = code * 1_000_003 + seq[i : len(seq) - k + 1 + i] + 31 * k
            same = doc[k - 1 :] == doc[: len(doc) - k + 1]
            kinds.append((doc[: len(doc) - k + 1][same], code[same]))
            salt.append(1.0)
    w = words(data, off, SPACED)
    if len(w.hash):
        owner = np.searchsorted(off, w.start, "right") - 1
        again = np.zeros(len(w.hash), np.int64)
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])
        kinds.append((owner, 500_009 + again))
        salt.append(2.0)
        kinds.append((owner, 700_001 + np.minimum(w.end - w.start, 24) // 3))
        salt.append(0.5)
        kinds.append((owner, w.hash.view(np.int64)))
        salt.append(0.5)
    out = np.zeros((n, TERMS), np.float32)
    for (d, code), weight in zip(kinds, salt, strict=True):
        z = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)
        counts = np.bincount(d * TERMS + z.astype(np.int64), minlength=n * TERMS).reshape(n, TERMS)
        total = counts.sum(axis=1, keepdims=True)
        out += weight * np.sqrt(counts / np.maximum(total, 1)).astype(np.float32)
    return out


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.idf) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(x), BLOCK):
            block = x[at : at + BLOCK]
            sims = self.project(block) @ self.vectors.T
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(sims, near, axis=1), 0).astype(np.float64) ** POWER
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
            known = (block.any(axis=1)) & (total > 0)
            out[at : at + BLOCK][known] = vote[known]
        return np.clip(out, 0, 1)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    weighed = x * idf
    values, axes = np.linalg.eigh((weighed.T @ weighed).astype(np.float64))
    model = Model(idf, np.ascontiguousarray(axes[:, ::-1][:, :DIMENSIONS]).astype(np.float32), np.zeros(0), y.astype(np.float64), float(y.mean()))
    model.vectors = np.ascontiguousarray(model.project(x))
    return model


def fold(doc_id) -> F.Column:
    """crc32 of doc_id as text, modulo 5; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = MAX_LABELLED) -> Model:
    """Fits on at most `bound` labelled documents of the folds 1 to 4, chosen by a hash of doc_id."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("_label")).where(fold(F.col("doc_id")) != 0)
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "_label").limit(bound)
    rows = docs.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "_label", "_text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_bytes(batches, "_text", 1 << 20):
            packed = [r.tobytes() for r in terms(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc_id", "label", "terms"])

    got = rows.mapInArrow(features, "doc_id long, label int, terms binary").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    x = np.frombuffer(b"".join(got["terms"].to_pylist()), np.float32).reshape(-1, TERMS)
    return fit(x, got["label"].to_numpy())


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the column `out` to docs, in place of one of that name; the model (a few MB, bounded) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(out)
    names = [*docs.columns, out]
    at = names.index(text)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, `{out}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_bytes(batches, text, 1 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(terms(batch.column(at))))], names=names)

    return docs.mapInArrow(run, schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, load(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
