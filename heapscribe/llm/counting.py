"""Token counts through a cache that is keyed by digests.

A text's key is the SHA-256 sum of its normalised content, and that of the tokenizer: its
file and the library's name and version. Counts are stored under both in a Parquet
table that is partitioned by the tokenizer's digest. A run brings the stored digests and its texts together,
encodes each distinct text that isn't stored once, appends the new counts to the table
and joins every document to its count. Two runs at once may store a count twice; it is
the same count, and reads take one. A run that breaks off leaves the table as it was.

SentencePiece reads a space and U+2581 alike, so for its models the normalised content has
one for the other; other tokenizers' content is the text itself. Null is empty and has 0 tokens.
Texts of any length are encoded whole; repeated rows, null doc_ids and texts that occur in
many documents share a count. Other columns aren't read, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of_bytes, load, scratch_path

LIMIT = 4096
SEEN = 500_000  # digests that a task remembers to send a text once
MEMORY = 1_000_000  # segments of text whose counts a worker remembers
SPACE = "▁"  # SentencePiece's mark of a space

_BPE = 2  # fixed value of the model format


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def version(path: str) -> str:
    """The tokenizer's digest: library, its version and the vocabulary file."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode() + f.read()).hexdigest()


class PieceCounter:
    """Numbers of tokens as the SentencePiece library gives them.

    A BPE model never merges over a boundary that none of its pieces spans. Where no piece
    has a space after another character, a text's count is therefore the sum over its words,
    each with the spaces before it (one more stands before the text), and each distinct word is
    encoded once and remembered. Texts of other models are encoded whole.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library, self.limit, self.known = sentencepiece.SentencePieceProcessor(model_file=path), memory, {}
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.library.serialized_model_proto())
        plain = spec.normalizer_spec
        spans = any(SPACE in p.piece.lstrip(SPACE) for p in spec.pieces)
        self.by_word = spec.trainer_spec.model_type == _BPE and not spans and any(p.piece == SPACE for p in spec.pieces)
        self.by_word &= not plain.precompiled_charsmap and plain.add_dummy_prefix and not plain.remove_extra_whitespaces and plain.escape_whitespaces
        self.segments, (self.lead,) = re.compile(" *[^ ]+| +"), self.whole(["a"])

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode(texts, num_threads=1)]

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self.whole(texts)
        return [self.one(t) if t else 0 for t in texts]

    def one(self, text: str) -> int:
        counts, known = Counter(self.segments.findall(" " + text.replace(SPACE, " "))), self.known
        new = [s for s in counts if s not in known]
        if new:
            if len(known) + len(new) > self.limit:
                known.clear()
                new = list(counts)
            for s, n in zip(new, self.whole(["a" + s for s in new]), strict=True):
                known[s] = n - self.lead
        return sum(k * known[s] for s, k in counts.items())


class JsonCounter:
    """Numbers of tokens as the tokenizers library gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


_counters: dict[str, PieceCounter | JsonCounter] = {}


def worker_counter(path: str, wanted: str) -> PieceCounter | JsonCounter:
    """The worker process's counter of the tokenizer `wanted`; another file or library there is an error, not another count."""
    if wanted not in _counters:
        if (have := version(path)) != wanted:
            raise ValueError(f"{path} is the tokenizer {have} on this worker; the driver's is {wanted}")
        _counters.clear()
        _counters[wanted] = PieceCounter(path) if path.endswith(".model") else JsonCounter(path)
    return _counters[wanted]


def stored(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of the tokenizer; the table needn't exist yet."""
    schema = "digest binary, n_tokens long, tokenizer string"
    try:
        table = spark.read.schema(schema).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        table = spark.createDataFrame([], schema)
    return table.where(F.col("tokenizer") == tokenizer).select("digest", "n_tokens")


def _digest(text: str, path: str) -> F.Column:
    content = F.coalesce(F.col(text), F.lit(""))
    return F.unhex(F.sha2(F.replace(content, F.lit(SPACE), F.lit(" ")) if path.endswith(".model") else content, 256))


def misses(docs: DataFrame, known: DataFrame, vocabulary: str, tokenizer: str, text: str = "text") -> DataFrame:
    """(digest, n_tokens) of each distinct text that isn't among the known ones.

    A task sends a text once, so a text that fills a third of all rows comes in as few rows
    as there are tasks. Stored digests sort before texts, so one pass sees what to leave out.
    """
    texts = docs.select(_digest(text, vocabulary).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keep = []
            for k, digest in enumerate(batch.column(0).to_pylist()):
                if digest not in seen:
                    keep.append(k)
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(digest)
            yield batch.take(pa.array(keep, pa.int64()))

    target = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches_of_bytes(batches, "text", 4 << 20):
            keep = []
            for k, digest in enumerate(batch.column(0).to_pylist()):
                if digest != last and batch.column(1)[k].is_valid:
                    keep.append(k)
                last = digest
            if keep:
                rows = batch.take(pa.array(keep, pa.int64()))
                counts = worker_counter(vocabulary, tokenizer)(rows.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts, pa.int64())], schema=target)

    both = texts.mapInArrow(once, "digest binary, text string").unionByName(known.select("digest", F.lit(None).cast("string").alias("text")))
    return both.repartition("digest").sortWithinPartitions("digest", F.col("text").isNotNull()).mapInArrow(encode, "digest binary, n_tokens long")


def count_tokens(docs: DataFrame, cache: str, vocabulary: str | None = None, limit: int = LIMIT, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; `cache` is a table in a store that driver and executors share, kept from run to run."""
    spark, path = docs.sparkSession, vocabulary or default_vocabulary()
    tokenizer = version(path)
    new = misses(docs, stored(spark, cache, tokenizer), path, tokenizer, text)
    new.withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = stored(spark, cache, tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    keyed = docs.select(F.col(id_column).alias("doc_id"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), _digest(text, path).alias("digest"))
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op12_counts(spark, sf_dir: str) -> DataFrame:
    """With a cache of its own, so that a run's work is that of its input."""
    return count_tokens(load(spark, sf_dir, "documents"), scratch_path(spark, "token_counts"))
