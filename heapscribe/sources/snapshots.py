"""Sink of snapshot points: an append-only Parquet table whose latest version of each id counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, version long, name string, ts long, virtual_allocations long, resource_count long, total long, bound long, unbound long, committed array<long>, deleted boolean"


def _latest(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), "version").alias("r")).select("id", "r.*")


def points(spark: SparkSession, path: str) -> DataFrame:
    """The points that aren't removed."""
    return _latest(spark, path).where("NOT deleted")


def add(summary: DataFrame, path: str) -> None:
    """Appends rows (id, name, ts and the summary's columns); Spark's committer makes them visible at once or not at all."""
    known = summary.columns
    typed = summary.sparkSession.createDataFrame([], SCHEMA).schema
    cols = [F.coalesce(F.col(f.name), F.lit(False)).alias(f.name) if f.name == "deleted" and f.name in known else F.col(f.name).cast(f.dataType) if f.name in known else F.lit(False if f.name == "deleted" else 0 if f.name == "version" else None).cast(f.dataType).alias(f.name) for f in typed]
    summary.select(*cols).write.mode("append").parquet(path)


def _revise(spark: SparkSession, path: str, id_: str, **changes) -> None:
    row = _latest(spark, path).where(F.col("id") == id_).withColumn("version", F.col("version") + 1)
    for k, v in changes.items():
        row = row.withColumn(k, F.lit(v))
    row.write.mode("append").parquet(path)


def remove(spark: SparkSession, path: str, id_: str) -> None:
    """A tombstone: the newest version is marked as deleted."""
    _revise(spark, path, id_, deleted=True)


def rename(spark: SparkSession, path: str, id_: str, name: str) -> None:
    """A new version with the summary as it was."""
    _revise(spark, path, id_, name=name)


def export_properties(properties: DataFrame, path: str, style: str = "csv", width: int = 32) -> None:
    """(name, value) rows as CSV with every value quoted, or as text with aligned values."""
    if style == "csv":
        properties.select("name", "value").write.option("quoteAll", True).option("header", True).mode("overwrite").csv(path)
    else:
        properties.select(F.concat(F.rpad("name", width, " "), "value").alias("line")).write.mode("overwrite").text(path)
