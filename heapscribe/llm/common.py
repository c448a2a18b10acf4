"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_dir

#: Bytes that are word characters of the "white space" rule: all but 0x20 and 0x09-0x0D.
WORD_RE = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of sf_dir. Texts can be long, so where the session has Spark's default, its Arrow batches are set to fewer rows from here on."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/heapscribe/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def batches_of_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = 16 << 20, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that one holds about `limit` bytes of `column` (at least one row) and at most `rows` rows."""
    for batch in batches:
        at, total = 0, batch.num_rows
        size = batch.column(batch.schema.get_field_index(column)).nbytes
        step = min(rows, max(1, int(total * limit / max(size, 1))))
        while at < total:
            yield batch.slice(at, min(step, total - at))
            at += step


def prefix_sums(df: DataFrame, order: list[str], value: str, out: str, by: str | None = None) -> DataFrame:
    """Adds `out`: the inclusive running sum of `value` in `order` (within `by`), without one task seeing a whole group.

    The rows are range-partitioned on the order columns and written once, so that a row's
    partition is fixed; the sums of whole partitions (one row per partition and group) give
    each partition its offset, and a window runs inside one partition only.
    Equal rows may swap places; the multiset of results is the same.
    """
    keys = ([by] if by else []) + order
    ranged = df.repartitionByRange(*[F.col(k).asc_nulls_last() for k in keys]).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "prefix_sums")
    group = [by] if by else []
    sums = ranged.groupBy("_part", *group).agg(F.sum(value).alias("_sum"))
    window = ", ".join(f"`{g}`" for g in group)
    offsets = sums.selectExpr("_part", *[f"`{g}`" for g in group], f"coalesce(sum(_sum) OVER ({f'PARTITION BY {window} ' if group else ''}ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before")
    local = ", ".join(["_part", *[f"`{g}`" for g in group]])
    ordered = ", ".join(f"`{k}` ASC NULLS LAST" for k in order)
    running = ranged.selectExpr("*", f"sum(`{value}`) OVER (PARTITION BY {local} ORDER BY {ordered} ROWS UNBOUNDED PRECEDING) AS _run")
    cond = F.col("r._part") == F.col("o._part")
    for g in group:
        cond = cond & F.col(f"r.{g}").eqNullSafe(F.col(f"o.{g}"))
    cols = [F.col(f"r.`{c}`") for c in df.columns]
    return running.alias("r").join(offsets.alias("o"), cond, "left").select(*cols, (F.col("r._run") + F.coalesce(F.col("o._before"), F.lit(0))).alias(out))
