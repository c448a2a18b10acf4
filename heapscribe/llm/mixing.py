"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every source gets a target: its weight's share of the budget, but at most `repeats`
times its own size, the excess going to the others by weight. Documents stand in a
hash-shuffled order within their source and up to `repeats` rounds of it; an entry's
virtual finish time is the source's cumulative size up to it, divided by the target.
All entries are sorted by that time over range partitions and the mix is cut where the
cumulative size reaches the budget.

Null or empty texts have size 0 and are never taken; a null source is a source of its
own and comes last; repeated rows are entries of their own. Reruns agree, as the order
depends on doc_id and a seed alone; equal finish times go by source, hash and doc_id, and
rows alike in these and in size are interchangeable. Texts are counted whole whatever
their length. Other columns than doc_id, source, text and `key` are not read, whatever
their names; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE, load, materialize, prefix_sums

WEIGHTS = (5, 2, 1)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = 3) -> DataFrame:
    """source, source_size -> rank, target. One row per source, so its windows are small."""
    weighed = sources.selectExpr("source", "source_size", "row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank", "sum(source_size) OVER () AS budget")
    weighed = weighed.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    # From the source that reaches its cap first: what is left, by weight of those not yet capped.
    filled = weighed.selectExpr(
        "*", f"{repeats} * source_size / w AS full",
        f"(budget - coalesce(sum({repeats} * source_size) OVER (ORDER BY {repeats} * source_size / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY {repeats} * source_size / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level",
    )
    level = filled.selectExpr("*", "min(CASE WHEN full >= level THEN full END) OVER () AS first_open")
    level = level.selectExpr("*", "min(CASE WHEN full = first_open THEN level END) OVER () AS shared")
    return level.selectExpr("source", "source_size", "cast(rank AS int) AS rank", f"least({repeats} * source_size, w * shared) AS target")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = 3, seed: int = 17, key: str | None = None) -> DataFrame:
    """Adds size, source_size, target and taken (words that the mix takes, repeats counted) to doc_id, source and text's other columns.

    `docs` needs doc_id, source and text; the result has doc_id, source and the four.
    A column `key` that tells rows of one doc_id apart joins the hash and the result.
    """
    keys = [key] if key else []
    sized = docs.select("doc_id", "source", *keys, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_RE)).cast("long").alias("size"))
    # The top 60 bits of an MD5 sum, which other engines have too.
    name = F.concat_ws(" ", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), *[F.col(k).cast("string") for k in keys])
    sized = sized.withColumn("shuffled", F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long"))
    sized = materialize(sized, "sizes")  # so that range sampling doesn't count the texts again
    ordered = prefix_sums(sized, ["shuffled", "doc_id", "size", *keys], "size", "upto", by="source")
    per_source = ordered.groupBy("source").agg(F.sum("size").alias("source_size"))
    budget = per_source.agg(F.sum("source_size")).first()[0] or 0
    goal = targets(per_source, weights, repeats).withColumnRenamed("source", "_source")
    placed = ordered.join(goal, ordered.source.eqNullSafe(goal._source)).drop("_source")
    finish = f"transform(sequence(0, cast(least({repeats - 1}, floor(target / source_size)) AS int)), e -> struct((e * source_size + upto) / target AS finish, rank, shuffled, doc_id))"
    placed = placed.withColumn("entries", F.expr(f"CASE WHEN size > 0 AND target > 0 THEN {finish} END"))
    entries = placed.select(F.explode("entries").alias("e"), "size").select("e.*", "size")
    queue = prefix_sums(entries, ["finish", "rank", "shuffled", "doc_id"], "size", "total")
    last = queue.where(F.col("total") <= budget).agg(F.max(F.struct("finish", "rank", "shuffled", "doc_id")).alias("last")).first()[0]
    if last is None:
        taken = F.lit(0)
    else:
        cut = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["rank"]).alias("rank"), F.lit(last["shuffled"]).alias("shuffled"), F.lit(last["doc_id"]).cast("long").alias("doc_id"))
        taken = F.col("size") * F.coalesce(F.size(F.filter("entries", lambda e: e <= cut)), F.lit(0))
    taken = F.when(F.col("entries").isNull(), 0).otherwise(taken).cast("long")
    return placed.select("doc_id", "source", *keys, "size", "source_size", F.col("target").cast("double").alias("target"), taken.alias("taken"))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix over whole tables: running sums by windows, the cut by a maximum.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17 ' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS shuffled
  FROM documents),
ordered AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY shuffled, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM sized),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][rank % 3 + 1] AS w, (SELECT sum(size) FROM sized) AS budget FROM sources),
-- A source is at its cap if it is so at the level at which sources that fill up no later are all at theirs.
levels AS (
  SELECT a.source, a.source_size, a.rank, a.w, CAST(3 * a.source_size AS DOUBLE) / a.w AS fills,
         (a.budget - coalesce((SELECT sum(3 * b.source_size) FROM weighed b WHERE CAST(3 * b.source_size AS DOUBLE) / b.w < CAST(3 * a.source_size AS DOUBLE) / a.w OR (CAST(3 * b.source_size AS DOUBLE) / b.w = CAST(3 * a.source_size AS DOUBLE) / a.w AND b.rank < a.rank)), 0))::DOUBLE
         / (SELECT sum(b.w) FROM weighed b WHERE CAST(3 * b.source_size AS DOUBLE) / b.w > CAST(3 * a.source_size AS DOUBLE) / a.w OR (CAST(3 * b.source_size AS DOUBLE) / b.w = CAST(3 * a.source_size AS DOUBLE) / a.w AND b.rank >= a.rank)) AS level
  FROM weighed a),
shared AS (SELECT level FROM levels WHERE fills >= level ORDER BY fills, rank LIMIT 1),
goals AS (SELECT source, source_size, rank, least(CAST(3 * source_size AS DOUBLE), w * (SELECT level FROM shared)) AS target FROM levels),
entries AS (
  SELECT o.doc_id, o.source, o.size, o.shuffled, g.rank, (e.e * g.source_size + o.upto) / g.target AS finish
  FROM ordered o JOIN goals g ON o.source IS NOT DISTINCT FROM g.source, (SELECT unnest([0, 1, 2]) AS e) e
  WHERE o.size > 0 AND g.target > 0 AND e.e <= least(2, floor(g.target / g.source_size))),
queued AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, shuffled, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM entries),
counted AS (SELECT doc_id, count(*) AS times FROM queued WHERE total <= (SELECT sum(size) FROM sized) GROUP BY doc_id)
SELECT o.doc_id, o.size, g.source_size, g.target, CAST(o.size * coalesce(c.times, 0) AS BIGINT) AS taken
FROM ordered o JOIN goals g ON o.source IS NOT DISTINCT FROM g.source LEFT JOIN counted c ON o.doc_id = c.doc_id
"""
