"""Job tracking over jobs(id, status, created_at, terminated_at, seconds)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import numbered

# fixed values: what the event types of the log stand for
STATUS = {"view": "queued", "click": "queued", "signup": "running", "purchase": "done", "error": "error"}
FIRST_GUESS, WORKERS, KEPT_SECONDS = 60.0, 2, 3600
#: Rows of an ordered log that a window sees at a time.
STRETCH = 10_000


def jobs_of(events: DataFrame) -> DataFrame:
    status = F.element_at(F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv)), F.col("event_type"))
    jobs = events.select(F.col("event_id").cast("long").alias("id"), status.alias("status"), F.col("ts").cast("timestamp_ntz").alias("created_at"), F.col("value").cast("double").alias("seconds"))
    end = F.col("created_at") + F.make_dt_interval(secs=F.round("seconds", 6).cast("decimal(18,6)"))
    return jobs.withColumn("terminated_at", F.when(F.col("status").isin("done", "error"), end))


def queue_positions(jobs: DataFrame) -> DataFrame:
    """id, position: the rank among queued and running jobs, 0 for finished ones."""
    live = numbered(jobs.where(F.col("status").isin("queued", "running")).select("id", "created_at"), "created_at", "id")
    rank = live.select("id", (F.col("number") + 1).alias("position"))
    return jobs.select("id").join(rank, "id", "left").select("id", F.coalesce("position", F.lit(0).cast("long")).alias("position"))


def rolling_seconds(jobs: DataFrame, last: int = 20) -> DataFrame:
    """id, mean_seconds: over the last successful jobs up to each successful job."""
    ended = numbered(jobs.where("status = 'done'").select("id", "seconds", "terminated_at"), "terminated_at", "id")
    # stretches of the log, each with the last rows of the one before
    stretch = F.floor(F.col("number") / STRETCH)
    own = ended.withColumns({"stretch": stretch, "own": F.lit(True)})
    lent = ended.where(F.col("number") % STRETCH >= STRETCH - last + 1).withColumns({"stretch": stretch + 1, "own": F.lit(False)})
    frame = Window.partitionBy("stretch").orderBy("number").rowsBetween(1 - last, 0)
    return own.unionByName(lent).withColumn("mean_seconds", F.avg("seconds").over(frame)).where("own").select("id", "mean_seconds")


def mean_now(jobs: DataFrame, last: int = 20) -> DataFrame:
    """One row: the mean of the last successful jobs, or the first guess."""
    recent = jobs.where("status = 'done'").orderBy(F.desc("terminated_at"), F.desc("id")).limit(last)
    return recent.agg(F.coalesce(F.avg("seconds"), F.lit(FIRST_GUESS)).alias("mean"))


def etas(jobs: DataFrame, progress: float | Column = 0.0) -> DataFrame:
    """id, position, eta in seconds; null for finished jobs. `progress` may be a column of jobs."""
    progress = progress if isinstance(progress, Column) else F.lit(progress)
    placed = queue_positions(jobs).join(jobs.select("id", "status", progress.cast("double").alias("progress")), "id").crossJoin(F.broadcast(mean_now(jobs)))
    waits = F.ceil(F.greatest(F.col("position") - WORKERS, F.lit(0)) / WORKERS) * F.col("mean") + F.col("mean")
    eta = F.when(F.col("status") == "running", F.greatest(F.lit(0.0), F.col("mean") * (1 - F.col("progress")))).when(F.col("status") == "queued", waits)
    return placed.select("id", "position", eta.alias("eta"))


def load_class(jobs: DataFrame) -> DataFrame:
    counts = jobs.agg(F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status") == "running").alias("running"))
    load = F.when((F.col("queued") == 0) & (F.col("running") == 0), "idle").when(F.col("queued") == 0, "busy").otherwise("backed_up")
    return counts.select("queued", "running", load.alias("load"))


def expired(jobs: DataFrame, seconds: int = KEPT_SECONDS) -> DataFrame:
    """id of finished jobs that ended `seconds` or more before the log's last creation."""
    now = jobs.agg(F.max("created_at").alias("now"))
    late = F.col("terminated_at") + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)")) <= F.col("now")
    return jobs.where("terminated_at is not null").crossJoin(F.broadcast(now)).where(late).select("id")


def ordered_stages(jobs: DataFrame, order: tuple[str, ...], column: str = "stages") -> DataFrame:
    """The stage names of each row, each once, in the given order; unknown ones last, by name."""
    known = F.array(*map(F.lit, order))
    place = lambda s: F.when(F.array_contains(known, s), F.array_position(known, s)).otherwise(len(order) + 1)
    keyed = F.array_sort(F.transform(F.array_distinct(column), lambda s: F.struct(place(s).alias("place"), s.alias("name"))))
    return jobs.withColumn(column, F.transform(keyed, lambda k: k["name"]))


def unknown_stages(jobs: DataFrame, order: tuple[str, ...], column: str = "stages") -> DataFrame:
    """Names that no stage has."""
    return jobs.withColumn("unknown", F.array_sort(F.array_except(column, F.array(*map(F.lit, order)))))


def friendly_error(column: Column, folder: str = "", most: int = 200) -> Column:
    """An error for users: without the working folder, and short."""
    return F.substring(F.replace(column, F.lit(folder), F.lit("")) if folder else column, 1, most)
