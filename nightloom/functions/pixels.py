"""Pointwise operators: each takes pixels and returns pixels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import CHANNELS, clip, luma, with_stats

# fixed values: the colour matrix of the preset camera
PRESET_MATRIX = ((0.92, -0.05, 0.13), (-0.05, 0.95, 0.10), (-0.02, -0.03, 1.05))


def each(px: DataFrame, body) -> DataFrame:
    """`body(column, name)` in place of every channel."""
    return px.withColumns({c: body(F.col(c), c) for c in CHANNELS})


def both(v: Column, other: Column, body: Column) -> Column:
    """`body` where both frames have the pixel; the query fails where only one has it."""
    return F.when(v.isNull() | other.isNull(), F.raise_error(F.lit("the frames differ in shape")).cast("double")).otherwise(body)


def dark_subtract(px: DataFrame, dark: DataFrame | None, scale: float = 1.0) -> DataFrame:
    """Pixels less a dark frame (y, x, r, g, b), clipped; no dark frame changes nothing. Shapes must agree."""
    if dark is None:
        return px
    d = dark.select("y", "x", *(F.col(c).alias(f"d_{c}") for c in CHANNELS))
    frames = px.select("frame_id").distinct().join(d)
    met = px.join(frames, ["frame_id", "y", "x"], "full")
    return each(met, lambda v, c: both(v, F.col(f"d_{c}"), clip(v - scale * F.col(f"d_{c}")))).select(*px.columns)


def colour_matrix(px: DataFrame, matrix=PRESET_MATRIX) -> DataFrame:
    if matrix == "preset":
        matrix = PRESET_MATRIX
    if len(matrix) != 3 or any(len(row) != 3 for row in matrix):
        raise ValueError("a colour matrix has three rows of three numbers")
    mixed = [sum((F.col(c) * w for c, w in zip(CHANNELS[1:], row[1:])), F.col("r") * row[0]) for row in matrix]
    return px.withColumns({c: F.greatest(v, F.lit(0.0)) for c, v in zip(CHANNELS, mixed)})


def green_clip(px: DataFrame, amount: float) -> DataFrame:
    """Average-neutral removal of green."""
    return px.withColumn("g", F.col("g") * (1 - amount) + F.least(F.col("g"), (F.col("r") + F.col("b")) / 2.0) * amount)


def stretch(px: DataFrame, black: float = 0.1, white: float = 99.9, factor: float = 25.0) -> DataFrame:
    """Per-channel black points, then one white point of the luma, then an asinh curve."""
    marks = with_stats(px, *(F.percentile(c, F.lit(black / 100)).alias(f"black_{c}") for c in CHANNELS))
    lowered = each(marks, lambda v, c: F.greatest(v - F.col(f"black_{c}"), F.lit(0.0))).drop(*(f"black_{c}" for c in CHANNELS))
    lit = with_stats(lowered, F.percentile(luma(), F.lit(white / 100)).alias("white"))
    top = F.greatest("white", F.lit(1e-6))
    return each(lit, lambda v, c: F.asinh(clip(v / top) * factor) / math.asinh(factor)).drop("white")


def s_curve(v: Column, strength: float) -> Column:
    if strength <= 0:
        return v
    a = 1 + strength
    return (F.tanh(a * (2 * v - 1)) / math.tanh(a) + 1) / 2


def linear_saturation(px: DataFrame, amount: float) -> DataFrame:
    mid = px.withColumn("l", luma())
    return each(mid, lambda v, c: F.col("l") + (v - F.col("l")) * amount).drop("l")


def hsv_saturation(px: DataFrame, amount: float) -> DataFrame:
    """Saturation scaled at fixed hue and value, in closed form."""
    ends = px.withColumns({"top": F.greatest(*CHANNELS), "low": F.least(*CHANNELS)})
    ends = ends.withColumn("s", F.when(F.col("top") > 0, (F.col("top") - F.col("low")) / F.col("top")).otherwise(0.0))
    ratio = F.when(F.col("s") > 0, clip(F.col("s") * amount) / F.col("s")).otherwise(1.0)
    return each(ends.withColumn("k", ratio), lambda v, c: F.col("top") - (F.col("top") - v) * F.col("k")).drop("top", "low", "s", "k")


def curves(px: DataFrame, contrast: float = 0.6, saturation: float = 1.2, preserve: float | None = 99.0, gains=None, mode: str = "linear") -> DataFrame:
    """S-curve, luma-weighted channel gains, saturation that tapers off on stars, clip."""
    if mode not in ("linear", "hsv"):
        raise ValueError(f"unknown saturation mode {mode!r}")
    if gains is not None and len(gains) != 3:
        raise ValueError("channel gains are three numbers")
    out = each(px, lambda v, c: s_curve(clip(v), contrast))
    if gains is not None:
        out = out.withColumn("l", luma())
        if preserve is not None:
            out = with_stats(out, F.percentile("l", F.lit(preserve / 100)).alias("t"))
            over = clip((F.col("l") - F.col("t")) / F.greatest(1 - F.col("t"), F.lit(1e-6)))
        else:
            out, over = out.withColumn("t", F.lit(1.0)), F.lit(0.0)
        out = out.withColumn("w", F.col("l") * (1 - over))
        out = out.withColumns({c: F.col(c) * (1 + (g - 1) * F.col("w")) for c, g in zip(CHANNELS, gains)}).drop("l", "t", "w")
    if mode == "hsv":
        out = hsv_saturation(each(out, lambda v, c: clip(v)), saturation)
    elif preserve is None or saturation == 1:
        out = linear_saturation(out, saturation)
    else:
        lit = with_stats(out.withColumn("l", luma()), F.percentile(luma(), F.lit(preserve / 100)).alias("t"))
        taper = saturation - (saturation - 1) * clip((F.col("l") - F.col("t")) / F.greatest("t", F.lit(1e-6)))
        lit = lit.withColumn("s", F.when(F.col("t") > 0, taper).otherwise(saturation))
        out = each(lit, lambda v, c: F.col("l") + (v - F.col("l")) * F.col("s")).drop("l", "t", "s")
    return each(out, lambda v, c: clip(v))


def screen_blend(a: DataFrame, b: DataFrame) -> DataFrame:
    """1 - (1 - a)(1 - b) of two frames; their shapes must agree."""
    other = b.select("frame_id", "y", "x", *(F.col(c).alias(f"o_{c}") for c in CHANNELS))
    met = a.join(other, ["frame_id", "y", "x"], "full")
    return each(met, lambda v, c: both(v, F.col(f"o_{c}"), 1 - (1 - clip(v)) * (1 - clip(F.col(f"o_{c}"))))).select(*a.columns)


def crop(px: DataFrame, h: int, w: int, top: int = 0, left: int = 0, bottom: int | None = None, right: int | None = None) -> DataFrame:
    """A box: first edges inclusive, last exclusive, negative ones from the far side; re-based to (0, 0)."""
    edge = lambda v, n, d: d if v is None else v + n if v < 0 else v
    t, b, le, r = edge(top, h, 0), edge(bottom, h, h), edge(left, w, 0), edge(right, w, w)
    if not (0 <= t < b <= h and 0 <= le < r <= w):
        raise ValueError("the box is empty or leaves the frame")
    box = px.where(F.col("y").between(t, b - 1) & F.col("x").between(le, r - 1))
    return box.withColumns({"y": F.col("y") - t, "x": F.col("x") - le})


def quantise16(px: DataFrame) -> DataFrame:
    """Channels as whole numbers of 16 bits, halves to even."""
    return each(px, lambda v, c: F.rint(clip(v) * 65535).cast("int"))
