"""The colour stage and hot-pixel repair on pixels; see functions.kernels for their forms on images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import CHANNELS, clip, luma, with_stats
from ..functions.pixels import colour_matrix, each, green_clip
from .neighbourhood import gaussian, median_filter
from .stats import median_mad, trimmed_median

#: Masks with fewer pixels give way to the whole frame.
LEAST = 64


def middles(px: DataFrame, inside, prefix: str, trimmed: bool) -> DataFrame:
    """frame_id and each channel's median among the pixels that `inside` holds for."""
    chosen = with_stats(px, F.count_if(inside).alias("held")).where(inside | (F.col("held") < LEAST))
    if trimmed:
        got = trimmed_median(chosen)
    else:
        got = chosen.groupBy("frame_id").agg(*(F.median(c).alias(c) for c in CHANNELS))
    return got.select("frame_id", *(F.col(c).alias(f"{prefix}{c}") for c in CHANNELS))


def colour(px: DataFrame, h: int | None = None, w: int | None = None, dark: float = 25, low: float = 40, high: float = 80, strength: float = 1.0, green: float = 0.0, highpass: float = 0.0, lowpass: float = 0.0, trimmed: bool = True, protect: float | None = 99, matrix=None) -> DataFrame:
    """Colour matrix, pedestal, white balance, green removal, chroma high-pass and low-pass, clip.

    h and w, one shape for all frames, are needed for the chroma filters only. Masks and the star taper
    use the luma before the pedestal is taken off."""
    out = px if matrix is None else colour_matrix(px, matrix)
    points = [dark, low, high, *([] if protect is None else [protect])]
    out = with_stats(out.withColumn("light", luma()), F.percentile(luma(), F.array(*(F.lit(p / 100) for p in points))).alias("marks"))
    mark = lambda i: F.col("marks")[i]
    top = F.when(mark(2) > mark(1), mark(2)).otherwise(mark(1) + 1e-6)
    out = out.join(middles(out, F.col("light") <= mark(0), "low_", trimmed), "frame_id")
    out = each(out, lambda v, c: F.greatest(v - F.col(f"low_{c}"), F.lit(0.0)))
    out = out.join(middles(out, (F.col("light") >= mark(1)) & (F.col("light") <= top), "mid_", trimmed), "frame_id")
    goal = (F.col("mid_r") + F.col("mid_g") + F.col("mid_b")) / 3
    taper = clip((F.col("light") - mark(3)) / F.greatest(mark(3), F.lit(1e-6))) if protect is not None else F.lit(0.0)

    def balanced(v, c):
        gain = F.when(F.col(f"mid_{c}") > 1e-6, goal / F.col(f"mid_{c}")).otherwise(1.0)
        gain = 1 + strength * (gain - 1)
        return F.when(goal > 0, v * (gain * (1 - taper) + taper)).otherwise(v)

    out = each(out, balanced).select(*px.columns)
    if green > 0:
        out = green_clip(out, green)
    if highpass > 0:
        slow = chroma_blurred(out, h, w, highpass)
        out = each(out.join(slow, ["frame_id", "y", "x"]), lambda v, c: F.greatest(v - F.col(f"slow_{c}"), F.lit(0.0))).select(*px.columns)
    if lowpass > 0:
        slow = chroma_blurred(out, h, w, lowpass)
        lit = out.join(slow, ["frame_id", "y", "x"]).withColumn("light", luma())
        out = each(lit, lambda v, c: F.greatest(F.col("light") + F.col(f"slow_{c}"), F.lit(0.0))).select(*px.columns)
    return each(out, lambda v, c: clip(v))


def chroma_blurred(px: DataFrame, h: int, w: int, sigma: float) -> DataFrame:
    """frame_id, y, x and the blurred difference of each channel from luma."""
    out = None
    for c in CHANNELS:
        soft = gaussian(px.select("frame_id", "y", "x", (F.col(c) - luma()).alias("v")), h, w, sigma).withColumnRenamed("v", f"slow_{c}")
        out = soft if out is None else out.join(soft, ["frame_id", "y", "x"])
    return out


def chroma_smooth(px: DataFrame, h: int, w: int, radius: float) -> DataFrame:
    if radius <= 0:
        return px
    lit = px.join(chroma_blurred(px, h, w, radius), ["frame_id", "y", "x"]).withColumn("light", luma())
    return each(lit, lambda v, c: clip(F.col("light") + F.col(f"slow_{c}"))).select(*px.columns)


def cosmetic(px: DataFrame, h: int, w: int, neighborhood: int = 3, sigma: float = 6.0) -> DataFrame:
    """Pixels far above their neighbourhood's median take that median, channel by channel."""
    if neighborhood < 3:
        raise ValueError("a neighbourhood has 3 pixels at least")
    out = px
    for c in CHANNELS:
        local = median_filter(px.select("frame_id", "y", "x", F.col(c).alias("v")), h, w, neighborhood // 2)
        rest = px.join(local, ["frame_id", "y", "x"]).select("frame_id", "y", "x", "vmed", (F.col(c) - F.col("vmed")).alias("v"))
        limit = median_mad(rest).select("frame_id", (F.col("sigma") * sigma).alias("limit"))
        mended = rest.join(limit, "frame_id").select("frame_id", "y", "x", F.when((F.col("limit") > 0) & (F.col("v") > F.col("limit")), F.col("vmed")).alias("mended"))
        out = out.join(mended, ["frame_id", "y", "x"]).withColumn(c, F.coalesce("mended", c)).drop("mended")
    return out
