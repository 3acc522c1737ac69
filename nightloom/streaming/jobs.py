"""Jobs as streams: state, progress, admission, expiry, and folders of new files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.jobs import KEPT_SECONDS
from ..sources.fits import MAX_UPLOAD, SUFFIXES, accepted, decoded_files

# fixed values: jobs in flight that are taken on, and how the states follow each other
MOST_IN_FLIGHT = 6
RANK = {"queued": 0, "running": 1, "done": 2, "error": 2}
FINAL = ("done", "error")


def rank(status) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv)), status)


def latest_state(events: DataFrame) -> DataFrame:
    """id, status, ts of events(id, status, ts): the furthest state of each job, the last event of it.

    A job never goes back: an event that comes late doesn't undo a later state. One row of state a job."""
    step = F.struct(rank(F.col("status")).alias("rank"), "ts", "status")
    return events.where(rank(F.col("status")).isNotNull()).groupBy("id").agg(F.max(step).alias("s")).select("id", "s.status", "s.ts")


def progress(events: DataFrame) -> DataFrame:
    """id, stage, fraction, ts: each job's last report; fractions are those of the stage."""
    return events.groupBy("id").agg(F.max_by(F.struct("stage", "fraction", "ts"), "ts").alias("p")).select("id", "p.*")


def in_flight(events: DataFrame) -> DataFrame:
    """One row: jobs that have been taken on and are not over, from events(id, status)."""
    change = F.when(F.col("status") == "queued", 1).when(F.col("status").isin(*FINAL), -1).otherwise(0)
    return events.agg(F.coalesce(F.sum(change), F.lit(0)).cast("long").alias("in_flight")).withColumn("taken", F.col("in_flight") < MOST_IN_FLIGHT)


def expiring(events: DataFrame, seconds: int = KEPT_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Stream of id, ended, expires: jobs that are over, once each while the watermark keeps them."""
    over = events.where(F.col("status").isin(*FINAL)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])
    return over.select("id", F.col("ts").alias("ended"), (F.col("ts") + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))).alias("expires"))


def job_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of Parquet files with job events, at most MOST_IN_FLIGHT files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", MOST_IN_FLIGHT).parquet(path)


def new_frames(spark: SparkSession, path: str) -> DataFrame:
    """A stream of FITS files as images; what is refused comes with an error."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").option("maxFilesPerTrigger", MOST_IN_FLIGHT).load(path)
    return decoded_files(accepted(files.where(F.col("length") <= MAX_UPLOAD)).where("refused is null"))


def each_batch(frames: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """work(images) on every batch of new frames, its rows under `target`/batch=n. A batch that runs
    again after a failure replaces its own rows, so each frame has one result."""

    def run(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return frames.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
