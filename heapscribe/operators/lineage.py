"""Lineage cuts that outlive lost executors: tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, a session on one machine gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='heapscribe-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a written table of its own: what reads it never computes df again."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/heapscribe/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
