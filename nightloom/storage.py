"""Tables between the parts of a long plan, in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder stands in on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    return base.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written and read again: computed once, and not lost with an executor."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str | Column) -> DataFrame:
    """The rows with their number (from 0) in an order: sorted by ranges, so that no task sees them all."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    laid = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "ordered")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    offsets, total = [], 0
    for at, n in sorted((r["part"], r["n"]) for r in laid.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        offsets.append((at, total))
        total += n
    before = df.sparkSession.createDataFrame(offsets, "part long, before long")
    return laid.join(F.broadcast(before), part == F.col("part")).withColumn("number", F.col("before") + within).drop("place", "part", "before")
