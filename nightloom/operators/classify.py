"""What a frame shows: metrics of its stars, sky and largest bright region, and the rules on them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import clip, with_stats
from .neighbourhood import dilate, peaks, row_runs
from .stats import luma_values, median_mad

# fixed values: the levels that the rules compare with
BRIGHT, STAR_SIGMA, LEAST_SKY, LEAST_REGION = 0.05, 8.0, 1024, 16
DOMINANT, WIDE, NEBULA = 0.60, 0.20, 0.10
STAR_DENSITY, DARK_SKY, LIT_SKY, CLUSTER_REGION, FILAMENT = 1300.0, 0.03, 0.08, 0.005, 0.85


def prestretched(px: DataFrame) -> DataFrame:
    """values(frame_id, y, x, v): luma between its 5 % and 99.95 % points, on an asinh curve."""
    lit = with_stats(luma_values(px), F.percentile("v", F.array(F.lit(0.05), F.lit(0.9995))).alias("p"))
    low, high = F.col("p")[0], F.col("p")[1]
    curve = F.asinh(clip((F.col("v") - low) / (high - low)) * 25.0) / math.asinh(25.0)
    return lit.select("frame_id", "y", "x", F.when(high > low, curve).otherwise(0.0).alias("v"))


def joined_runs(runs: pd.DataFrame) -> pd.DataFrame:
    """For applyInPandas over a frame's row runs: the first run (in raster order) of each one's region."""
    runs = runs.sort_values(["y", "x0"], ignore_index=True)
    y, x0, x1 = (runs[c].to_numpy() for c in ("y", "x0", "x1"))
    above = np.searchsorted(y, y - 1)  # the first run of the row before
    own = np.searchsorted(y, y)
    parent = np.arange(len(runs))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(runs)):
        # runs of a row are apart and in order, so those that touch this one are neighbours
        j = above[i] + np.searchsorted(x1[above[i] : own[i]], x0[i])
        while j < own[i] and x0[j] <= x1[i]:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
            j += 1
    return runs.assign(region=np.array([root(i) for i in range(len(runs))], np.int64))


def regions(mask: DataFrame) -> DataFrame:
    """frame_id, y, x0, x1, region: row runs of set places, joined over edges. One task holds a frame's
    runs, which are fewer than its pixels."""
    runs = row_runs(mask).select("frame_id", F.col("y").cast("long").alias("y"), F.col("x0").cast("long").alias("x0"), F.col("x1").cast("long").alias("x1"))
    return runs.groupBy("frame_id").applyInPandas(joined_runs, "frame_id string, y long, x0 long, x1 long, region long")


def largest_region(mask: DataFrame) -> DataFrame:
    """frame_id, area, elongation of each frame's largest region; the first in raster order of equals.

    Second moments come from the runs in closed form; below LEAST_REGION pixels the elongation is 0.
    """
    squares = lambda k: k * (k + 1) * (2 * k + 1) / 6
    n = (F.col("x1") - F.col("x0") + 1).cast("double")
    mid = (F.col("x0") + F.col("x1")) / 2
    x0, x1, y = F.col("x0").cast("double"), F.col("x1").cast("double"), F.col("y").cast("double")
    sums = regions(mask).groupBy("frame_id", "region").agg(
        F.sum(n).alias("n"), F.sum(n * y).alias("y"), F.sum(n * mid).alias("x"),
        F.sum(n * y * y).alias("yy"), F.sum(squares(x1) - squares(x0 - 1)).alias("xx"), F.sum(n * mid * y).alias("xy"),
    )
    best = sums.groupBy("frame_id").agg(F.max_by(F.struct("n", "y", "x", "yy", "xx", "xy"), F.struct(F.col("n"), -F.col("region"))).alias("b")).select("frame_id", "b.*")
    best = best.select("frame_id", "n", *((F.col(a + b) / F.col("n") - F.col(a) * F.col(b) / (F.col("n") * F.col("n"))).alias("c" + a + b) for a, b in ("yy", "xx", "xy")))
    half = F.sqrt(F.pow((F.col("cyy") - F.col("cxx")) / 2, F.lit(2)) + F.col("cxy") * F.col("cxy"))
    major, minor = (F.col("cyy") + F.col("cxx")) / 2 + half, F.greatest((F.col("cyy") + F.col("cxx")) / 2 - half, F.lit(0.0))
    shape = F.when((F.col("n") >= LEAST_REGION) & (major > 1e-9), F.sqrt(F.greatest(1 - minor / major, F.lit(0.0)))).otherwise(0.0)
    return best.select("frame_id", F.col("n").alias("area"), shape.alias("elongation"))


def metrics(px: DataFrame, h: int, w: int) -> DataFrame:
    """frame_id, sky, density, fraction, elongation of every frame."""
    v = prestretched(px)
    whole = median_mad(v, floor=1e-6).join(v.groupBy("frame_id").agg(F.count("*").alias("pixels")), "frame_id")
    stars = peaks(v, STAR_SIGMA).groupBy("frame_id").agg(F.count("*").alias("stars"))
    high = v.join(whole, "frame_id").where(F.col("v") > F.col("med") + STAR_SIGMA * F.col("sigma"))
    dark = v.join(dilate(high, h, w), ["frame_id", "y", "x"], "left_anti").groupBy("frame_id").agg(F.count("*").alias("dark"), F.median("v").alias("dark_median"))
    out = whole.join(stars, "frame_id", "left").join(dark, "frame_id", "left").join(largest_region(v.where(F.col("v") > BRIGHT)), "frame_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        "frame_id", F.when(F.col("dark") > LEAST_SKY, F.col("dark_median")).otherwise(F.col("med")).alias("sky"),
        zero(F.col("stars") / (F.col("pixels") / 1e6)).alias("density"), zero(F.col("area") / F.col("pixels")).alias("fraction"), zero(F.col("elongation")).alias("elongation"),
    )


def label():
    """The kind of frame, from its metrics; the first rule that holds counts."""
    sky, density, fraction, elongation = (F.col(c) for c in ("sky", "density", "fraction", "elongation"))
    cluster = (density > STAR_DENSITY) & (sky < DARK_SKY) & (fraction > CLUSTER_REGION) & (elongation < FILAMENT)
    rules = [
        (fraction > DOMINANT, "nebula_dominant"), (fraction > WIDE, "nebula_wide"), (fraction > NEBULA, "nebula"), (cluster, "cluster"),
        ((sky > DARK_SKY) & (sky < LIT_SKY), "galaxy"), (sky > LIT_SKY, "nebula"), ((density > STAR_DENSITY) | (elongation > FILAMENT), "nebula_filament"),
    ]
    return F.coalesce(*(F.when(holds, F.lit(kind)) for holds, kind in rules), F.lit("galaxy"))


def classified(px: DataFrame, h: int, w: int) -> DataFrame:
    return metrics(px, h, w).withColumn("label", label())
