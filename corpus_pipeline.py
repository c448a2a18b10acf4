"""The corpus pipeline: five stages from documents to token rows, each a written table that the next one reads.

Documents are told apart by doc_id and the text's hash, so different texts with one
doc_id, or with none, are documents of their own. Null and empty texts pass the first
three stages and have no words for the mix, which leaves them out. Repeated rows are
copies of each other, of which the second stage keeps one. Texts of any length are taken
whole. Columns of other names, whatever they are, go along to the last stage; no
documents give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heapscribe.llm import fmindex, jaccard, mixing, quality, tokens
from heapscribe.llm.common import load, materialize


#: Words of a shingle and the least similarity (80 of 100) of near duplicates. op5_jaccard's contract has its own.
NEAR = (5, 80, 100)


def _hidden(docs: DataFrame) -> DataFrame:
    """Columns under names that no operator adds."""
    return docs.select(*[F.col(f"`{c}`").alias(f"d_{c}") for c in docs.columns])


def _shown(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`d_{c}`").alias(c) for c in docs.columns])


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier doesn't reject."""
    model = quality.learn(docs, load(spark, sf_dir, "labels"))
    return _shown(quality.score(_hidden(docs), model, text="d_text").where(F.col("score") >= quality.THRESHOLD), docs)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the first by doc_id (null last) and the text's hash.

    Rows with one doc_id and one text are copies of each other, so (doc_id, hash) tells apart
    all that can be kept and dropped. Only rows that a filter of fixed size names are joined.
    """
    keyed = _hidden(docs).withColumn("key", F.xxhash64("d_text"))
    asked = keyed.select(F.col("d_doc_id").alias("doc_id"), F.col("d_text").alias("text"), "key")
    found = jaccard.join(asked, *NEAR, key="key").where("NOT alone")
    touched = found.groupBy("doc_id", "row_key").agg(F.first("kept").alias("kept"), F.count("*").alias("copies")).where("NOT kept OR copies > 1")
    touched = materialize(touched.select("doc_id", "row_key", "kept"), "touched")
    words = jaccard.filter_words(touched.select(F.xxhash64("doc_id", "row_key").alias("node")))
    placed = keyed.withColumn("node", F.xxhash64("d_doc_id", "key")).withColumn("at", F.expr(f"cast(shiftrightunsigned(node, 40) & {jaccard.FILTER_WORDS - 1} AS int)"))
    words = F.broadcast(materialize(words, "filter"))
    marked = placed.join(words, F.col("at") == F.col("w"), "left")
    in_filter = "coalesce(shiftrightunsigned(bits, cast(node & 63 AS int)) & 1, 0) = 1"
    named = materialize(marked.where(in_filter).select(*keyed.columns), "named")
    named = named.join(touched, _same("d_doc_id", "doc_id") & (F.col("key") == F.col("row_key")), "left")
    first = named.where("kept").dropDuplicates(["d_doc_id", "key"])
    parts = marked.where(f"NOT {in_filter}"), named.where("kept IS NULL"), first
    clear, other, first = (_shown(p, docs) for p in parts)
    return clear.union(other).union(first)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the benchmark contaminates."""
    found = fmindex.decontaminate(_hidden(docs), load(spark, sf_dir, "benchmark"), text="d_text")
    return _shown(found.where(~F.col("contaminated")), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    keyed = _hidden(docs).withColumn("key", F.xxhash64("d_text"))
    asked = keyed.select(F.col("d_doc_id").alias("doc_id"), F.col("d_source").alias("source"), F.col("d_text").alias("text"), "key")
    # Rows equal in all three columns are alike to the mix and share what it takes of them.
    same = mixing.mix(asked, key="key").groupBy("doc_id", "source", "key").agg(F.expr("cast(sum(taken div greatest(size, 1)) AS int)").alias("times"), F.count("*").alias("copies"))
    taken = same.where("times > 0").select("doc_id", "source", F.col("key").alias("row_key"), "times", "copies")
    rows = keyed.join(taken, _same("d_doc_id", "doc_id") & _same("d_source", "source") & (F.col("key") == F.col("row_key")))
    single = rows.where("copies = 1").select(*keyed.columns, "times")
    at = F.row_number().over(Window.partitionBy("d_doc_id", "d_source", "key").orderBy("key"))
    several = rows.where("copies > 1").withColumn("at", at).withColumn("times", F.expr("cast(times div copies + if(at <= times % copies, 1, 0) AS int)")).where("times > 0")
    both = single.union(several.select(*keyed.columns, "times"))
    return _shown(both.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("times")))), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token rows in doc_id order, read back from the token files."""
    return tokens.token_rows(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", classify),
    ("jaccard", deduplicate),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokenize),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
