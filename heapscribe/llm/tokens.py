"""Token ids as Parquet list columns, with controlled row groups, pages and page indexes.

`write_tokens` encodes every whole text, appends the end id and writes files whose
rows ascend by document across the whole data set: column `tokens` is a list of
int32 with dictionary (or, as an option, delta) encoding, `n_tokens` and `doc_id`
are small columns of their own. Row groups and pages are small and carry column
and offset indexes, so a reader of a document range or of the metadata alone skips
the rest. `read_tokens` reads such files back, by document range if asked.

Nulls: a null text is empty and holds the end id only; a null doc_id sorts first.
Rows of one doc_id stand in the order of their texts (null first) and are several tasks' work
where these begin differently; equal ones are interchangeable. Each row carries its number within its file, so offsets follow the stored
order. Texts of any length are one row; columns beyond doc_id and text are not read,
whatever their names; no rows give no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of_bytes, load, scratch_path
from .textvec import piece_hashes, strings

END_ID = 2
SPECIAL = "<|endoftext|>"  # fixed value of the vocabulary
CACHE = 2_000_000
LEAD = 64  # characters of a text by which rows of one doc_id are dealt out


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts with the tokenizers library, once per distinct word.

    The vocabulary's pre-tokenizer always cuts before a space that a visible character
    follows, so texts are cut there (where that character is ASCII or Latin), pieces are
    known by 64-bit hashes of their bytes, and each distinct piece is encoded once and
    remembered (the memory is bounded and starts anew when full). New pieces are encoded
    in long strings and told apart by the tokens' byte lengths. A text with a special
    token's string is encoded whole.
    """

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism; a pool of threads in each would only cost memory
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), cache
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # a byte-level vocabulary spells each byte as one character
        self.reset()

    def reset(self) -> None:
        self.known, self.start, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Adds pieces that aren't known."""
        spaced = np.array([x[:1] == b" " and x[1:2] > b" " for x in pieces], bool)
        ids, counts = [], np.zeros(len(pieces), np.int64)
        inner = np.flatnonzero(spaced)
        for at in range(0, len(inner), 1000):
            group = inner[at : at + 1000]
            (found,) = self.encode_all([b"".join([pieces[i] for i in group]).decode()])
            found = np.array(found, np.int32)
            token_start = np.cumsum(self.bytes_of[found]) - self.bytes_of[found]
            ends = np.cumsum([len(pieces[i]) for i in group])
            counts[group] = np.bincount(np.searchsorted(ends, token_start, "right"), minlength=len(group))
            ids.append(found)
        single = np.flatnonzero(~spaced)
        for at in range(0, len(single), 1000):
            for i, x in zip(single[at : at + 1000], self.encode_all([pieces[i].decode() for i in single[at : at + 1000]]), strict=True):
                counts[i] = len(x)
                ids.append(np.array(x, np.int32))
        order = np.concatenate([inner, single])
        starts = np.zeros(len(pieces), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order] + len(self.flat)
        self.flat = np.concatenate([self.flat, *ids])
        where = np.searchsorted(self.known, hashes)  # both are sorted
        self.known = np.insert(self.known, where, hashes)
        self.start = np.insert(self.start, where, starts)
        self.length = np.insert(self.length, where, counts.astype(np.int32))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of ids of each text."""
        data, off = strings(column)
        n = len(off) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        raw = data.tobytes()
        cut = np.zeros(len(data) + 1, bool)
        visible = (data[1:] > 0x20) & (data[1:] < 0x7F) | (data[1:] >= 0xC3) & (data[1:] <= 0xC8)
        cut[:-2] = (data[:-1] == 0x20) & visible
        # A space that ends one text isn't followed by the next text's first character.
        cut[off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))] - 1] = False
        cut[off] = True
        cut[len(data)] = False
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        h = piece_hashes(data, start, end)
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if len(self.known) + new.sum() > self.limit and len(self.known):
            self.reset()
            new[:] = True
        if new.any():
            self.learn(distinct[new], [raw[start[i] : end[i]] for i in first[new]])
        at = np.searchsorted(self.known, distinct)[which]
        length, source = self.length[at].astype(np.int64), self.start[at]
        upto = np.cumsum(length)
        flat = self.flat[np.arange(upto[-1]) + np.repeat(source - upto + length, length)]
        sums = np.concatenate([[0], upto])
        edge = sums[np.searchsorted(start, off)]
        counts = np.diff(edge)
        if SPECIAL.encode() in raw:
            parts = np.split(flat, edge[1:-1])
            for i in range(n):
                if SPECIAL.encode() in (text := raw[off[i] : off[i + 1]]):
                    parts[i] = np.array(self.encode_all([text.decode()])[0], np.int32)
            flat, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return flat, counts


_encoders: dict[str, Encoder] = {}


def worker_encoder(vocabulary: str) -> Encoder:
    """The worker process's encoder: its next tasks find the words that former ones have met."""
    if vocabulary not in _encoders:
        _encoders.clear()
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def encode(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc_id, n_tokens, tokens (with the end id) and row, the number within the partition, in the order of the rows."""
    source = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    target = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32())), ("row", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at = worker_encoder(vocabulary), 0
        for batch in batches_of_bytes(batches, "_text", 1 << 19):
            ids, n = encoder(batch.column(1))
            ends = np.cumsum(n + 1)
            flat = np.full(ends[-1], END_ID, np.int32)
            flat[np.delete(np.arange(ends[-1]), ends - 1)] = ids
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n + 1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(np.arange(at, at + len(n)))], schema=target)
            at += len(n)

    return source.mapInArrow(run, "doc_id long, n_tokens long, tokens array<int>, row long")


def write_tokens(df: DataFrame, path: str, vocabulary: str, encoding: str = "dictionary", row_group_mb: int = 32, page_kb: int = 256, id_column: str = "doc_id", text: str = "text") -> None:
    """Writes the token files in ascending doc_id order; `part` numbers the files in that order. encoding: dictionary or delta."""
    keyed = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"), F.substring(text, 1, LEAD).alias("lead"))
    # Rows that share an id, or have none, spread over ranges of their texts' beginnings.
    order = [F.col("doc_id").asc_nulls_first(), F.col("lead").asc_nulls_first()]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    options = {"parquet.block.size": row_group_mb << 20, "parquet.page.size": page_kb << 10, "parquet.page.row.count.limit": 2000, "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "parquet.writer.version": "v1" if encoding == "dictionary" else "v2", "compression": "zstd"}
    encode(ordered, vocabulary).withColumn("part", F.spark_partition_id()).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The token rows, or those of a document range: the bounds reach the files' row groups and pages."""
    out = spark.read.schema("doc_id long, n_tokens long, tokens array<int>, row long, part int").parquet(path)
    if first is not None:
        out = out.where(F.col("doc_id") >= first)
    if last is not None:
        out = out.where(F.col("doc_id") <= last)
    return out


def summary(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 from files of write_tokens; reads each file once for the ids and once for the counts."""
    offsets = stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).selectExpr("part", "coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")

    def crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(2)
            at, flat = tokens.offsets.to_numpy(), np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False), "<u4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at).astype(np.int64)), batch.column(1), batch.column(3), pa.array(crc, pa.int64())], names=["doc_id", "n_tokens", "part", "row", "ids_crc32"])

    rows = stored.select("doc_id", "part", "tokens", "row").mapInArrow(crcs, "doc_id long, n_tokens long, part int, row long, ids_crc32 long")
    running = rows.selectExpr("*", "sum(n_tokens) OVER (PARTITION BY part ORDER BY row ROWS UNBOUNDED PRECEDING) AS run")
    return running.join(offsets, "part").select("doc_id", (F.col("before") + F.col("run") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def token_rows(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, vocabulary or default_vocabulary())
    return summary(read_tokens(spark, path))


def op9_tokens(spark, sf_dir: str) -> DataFrame:
    return token_rows(load(spark, sf_dir, "documents"))
