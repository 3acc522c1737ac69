"""Aggregates of frames: robust statistics, trimmed medians, clipping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import CHANNELS, luma

SIGMA = 1.4826


def median_mad(values: DataFrame, column: str = "v", floor: float = 0.0) -> DataFrame:
    """frame_id, med, sigma: the median and 1.4826 times the median absolute deviation."""
    med = values.groupBy("frame_id").agg(F.median(column).alias("med"))
    return values.join(med, "frame_id").groupBy("frame_id").agg(F.first("med").alias("med"), F.greatest(F.median(F.abs(F.col(column) - F.col("med"))) * SIGMA, F.lit(floor)).alias("sigma"))


def sigma_clip(values: DataFrame, sigma: float = 2.5, rounds: int = 5, column: str = "v") -> DataFrame:
    """frame_id, med, n: of the values within sigma deviations, re-tested on all values each round.

    Where the kept values do not deviate at all, or none would be left, the frame's last choice stays."""
    now = values.select("frame_id", F.col(column).alias("v")).withColumn("keep", F.lit(True))
    for _ in range(rounds):
        marks = median_mad(now.where("keep")).withColumnsRenamed({"med": "m0", "sigma": "s0"})
        met = now.join(marks, "frame_id").withColumn("near", F.abs(F.col("v") - F.col("m0")) <= sigma * F.col("s0"))
        stays = F.col("s0") == 0
        now = met.select("frame_id", "v", F.when(stays, F.col("keep")).otherwise(F.col("near")).alias("keep"))
    return now.where("keep").groupBy("frame_id").agg(F.median("v").alias("med"), F.count("*").alias("n"))


def trimmed_median(px: DataFrame, cutoff: float = 2.5) -> DataFrame:
    """Per-channel medians of the pixels within cutoff^2 * 3 of the mean by Mahalanobis distance.

    Falls back to plain medians below 16 pixels, kept or in all, or where the covariance is singular.
    """
    pairs = [(a, b) for i, a in enumerate(CHANNELS) for b in CHANNELS[i:]]
    stats = px.groupBy("frame_id").agg(
        F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in CHANNELS), *(F.median(c).alias(f"plain_{c}") for c in CHANNELS),
        *((F.var_samp(a) + 1e-8 if a == b else F.covar_samp(a, b)).alias(f"s_{a}{b}") for a, b in pairs),
    )
    s = {(a, b): F.col(f"s_{a}{b}") for a, b in pairs}
    s |= {(b, a): v for (a, b), v in s.items()}

    def minor(i, j):
        rows, cols = [c for c in CHANNELS if c != i], [c for c in CHANNELS if c != j]
        sign = (-1) ** (CHANNELS.index(i) + CHANNELS.index(j))
        return sign * (s[rows[0], cols[0]] * s[rows[1], cols[1]] - s[rows[0], cols[1]] * s[rows[1], cols[0]])

    det = sum((s["r", c] * minor("r", c) for c in CHANNELS[1:]), s["r", "r"] * minor("r", "r"))
    stats = stats.withColumn("det", det).withColumns({f"i_{a}{b}": minor(a, b) / F.nullif(F.col("det"), F.lit(0.0)) for a, b in pairs})
    d = {c: F.col(c) - F.col(f"mean_{c}") for c in CHANNELS}
    d2 = sum((d[a] * d[b] * F.col(f"i_{a}{b}") * (1 if a == b else 2) for a, b in pairs), F.lit(0.0))
    near = px.join(stats, "frame_id").withColumn("near", F.coalesce(d2 < cutoff * cutoff * 3, F.lit(False)))
    out = near.groupBy("frame_id").agg(F.count_if("near").alias("kept"), *(F.median(F.when(F.col("near"), F.col(c))).alias(f"near_{c}") for c in CHANNELS), *(F.first(f"plain_{c}").alias(f"plain_{c}") for c in CHANNELS))
    return out.select("frame_id", "kept", *(F.when(F.col("kept") >= 16, F.col(f"near_{c}")).otherwise(F.col(f"plain_{c}")).alias(c) for c in CHANNELS))


def luma_values(px: DataFrame) -> DataFrame:
    return px.select("frame_id", "y", "x", luma().alias("v"))
