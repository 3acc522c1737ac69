"""Frames as relations of pixels: pixels(frame_id, y, x, r, g, b), all values DOUBLE in [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b")
#: The synthetic sky.
SKY_H, SKY_W, SKY_STARS = 96, 128, 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, h: int, w: int) -> DataFrame:
    return spark.range(h * w).select(F.floor(F.col("id") / w).cast("int").alias("y"), (F.col("id") % w).cast("int").alias("x"))


def heat_frame(spark: SparkSession, sf_dir: str, size: int = 32) -> DataFrame:
    """A frame of average quantities, discounts and taxes; cells without rows are 0."""
    line = table(spark, sf_dir, "lineitem")
    y, x = F.col("l_orderkey") % size, (F.col("l_partkey") + 13 * F.col("l_linenumber")) % size
    cells = line.select(y.cast("int").alias("y"), x.cast("int").alias("x"), *(F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax")))
    cells = cells.groupBy("y", "x").agg((F.avg("l_quantity") / 50.0).alias("r"), (F.avg("l_discount") / 0.1).alias("g"), (F.avg("l_tax") / 0.08).alias("b"))
    full = grid(spark, size, size).join(cells, ["y", "x"], "left")
    return full.select(F.lit("heat").alias("frame_id"), "y", "x", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in CHANNELS))


def sky_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """star (key), sy, sx, amp, t of the planted stars."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where(key.between(1, SKY_STARS)).select(
        key.cast("long").alias("star"), (8 + (key * 37) % 80).cast("int").alias("sy"), (8 + (key * 53) % 112).cast("int").alias("sx"),
        (0.35 + 0.5 * ((key * 17) % 101) / 100.0).alias("amp"), ((F.col("c_nationkey") - 12) / 12.0).alias("t"),
    )


def sky_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise, a wide blob and stars of 5 x 5 pixels, by integer arithmetic only."""
    px = grid(spark, SKY_H, SKY_W)
    blob = F.exp(-(F.pow(F.col("y") - 48, F.lit(2)) + F.pow(F.col("x") - 64, F.lit(2))) / 400.0)
    for c, k, a in (("r", 0, 0.10), ("g", 331, 0.08), ("b", 662, 0.06)):
        px = px.withColumn(c, 0.02 + 0.02 * ((F.col("y") * 7919 + F.col("x") * 104729 + k) % 1009) / 1009.0 + a * blob)
    stars = sky_stars(spark, sf_dir)
    cell = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    stamp = stars.withColumn("dy", cell).withColumn("dx", cell)
    weight = F.greatest(F.lit(0.0), 1.0 - 0.25 * (F.abs("dy") + F.abs("dx")))
    tint = {"r": 1 + 0.2 * F.col("t"), "g": F.lit(1.0), "b": 1 - 0.2 * F.col("t")}
    stamp = stamp.select((F.col("sy") + F.col("dy")).alias("y"), (F.col("sx") + F.col("dx")).alias("x"), *((F.col("amp") * weight * tint[c]).alias(f"s{c}") for c in CHANNELS))
    stamp = stamp.groupBy("y", "x").agg(*(F.max(f"s{c}").alias(f"s{c}") for c in CHANNELS))
    return px.join(stamp, ["y", "x"], "left").select(F.lit("sky").alias("frame_id"), "y", "x", *(F.greatest(F.col(c), F.coalesce(f"s{c}", F.lit(0.0))).alias(c) for c in CHANNELS))


def luma() -> Column:
    """The unweighted mean of the channels."""
    return (F.col("r") + F.col("g") + F.col("b")) / 3.0


def clip(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def with_stats(px: DataFrame, *aggregates: Column) -> DataFrame:
    """Pixels beside their frame's aggregates: one row per frame, joined back on frame_id.

    Spark broadcasts the statistics by their size; with very many frames it joins by sorting.
    """
    return px.join(px.groupBy("frame_id").agg(*aggregates), "frame_id")


def rounded(df: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    """Keys, and every other DOUBLE column rounded, off exact halves and without negative zeros."""
    kinds = dict(df.dtypes)
    return df.select(*((F.round(F.col(c) + 1e-9, digits) + 0.0).alias(c) if kinds[c] == "double" and c not in keys else F.col(c) for c in df.columns))
