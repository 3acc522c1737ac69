"""Neighbourhood operators on values(frame_id, y, x, v)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_row():
    return Window.partitionBy("frame_id", "y").orderBy("x")


def by_column():
    return Window.partitionBy("frame_id", "x").orderBy("y")


def max_filter(values: DataFrame, radius: int = 3) -> DataFrame:
    """The maximum of a square: rows first, then columns (windows cut at the edge equal reflection)."""
    rows = values.withColumn("rowmax", F.max("v").over(by_row().rangeBetween(-radius, radius)))
    return rows.withColumn("vmax", F.max("rowmax").over(by_column().rangeBetween(-radius, radius))).drop("rowmax")


def laplacian(values: DataFrame) -> DataFrame:
    """The five-point stencil; an edge pixel stands in for its missing neighbour."""
    side = lambda f, w: F.coalesce(f("v").over(w), F.col("v"))
    total = side(F.lag, by_row()) + side(F.lead, by_row()) + side(F.lag, by_column()) + side(F.lead, by_column())
    return values.withColumn("lap", total - 4 * F.col("v"))


def gradient(values: DataFrame) -> DataFrame:
    """Central differences inside, one-sided ones at the edges; and their magnitude."""

    def slope(w):
        before, after = F.lag("v").over(w), F.lead("v").over(w)
        return F.when(before.isNull(), after - F.col("v")).when(after.isNull(), F.col("v") - before).otherwise((after - before) / 2)

    slopes = values.withColumns({"gy": slope(by_column()), "gx": slope(by_row())})
    return slopes.withColumn("grad", F.sqrt(F.col("gy") * F.col("gy") + F.col("gx") * F.col("gx")))


def mirrored(k, n):
    """Index k reflected into 0..n-1 (d c b a | a b c d | d c b a), as often as needed."""
    m = F.pmod(k, 2 * n)
    return F.least(m, 2 * n - 1 - m)


def median_filter(values: DataFrame, h: int, w: int, radius: int = 1, edge: str = "nearest") -> DataFrame:
    """The median of a square by a stencil: each pixel is sent to the places that it counts for."""
    offsets = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    asked = values.select("frame_id", "y", "x").withColumn("dy", offsets).withColumn("dx", offsets)
    place = (lambda k, n: F.least(F.greatest(k, F.lit(0)), F.lit(n - 1))) if edge == "nearest" else (lambda k, n: mirrored(k, F.lit(n)))
    asked = asked.select("frame_id", "y", "x", place(F.col("y") + F.col("dy"), h).alias("ny"), place(F.col("x") + F.col("dx"), w).alias("nx"))
    source = values.select("frame_id", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("v").alias("nv"))
    return asked.join(source, ["frame_id", "ny", "nx"]).groupBy("frame_id", "y", "x").agg(F.median("nv").alias("vmed"))


def dilate(mask: DataFrame, h: int, w: int, steps: int = 3) -> DataFrame:
    """Places within `steps` moves (up, down, left, right) of a set place (frame_id, y, x)."""
    step = F.explode(F.sequence(F.lit(-steps), F.lit(steps)))
    ball = mask.select("frame_id", "y", "x").withColumn("dy", step).withColumn("dx", step).where(F.abs("dy") + F.abs("dx") <= steps)
    moved = ball.select("frame_id", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"))
    return moved.where(F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1)).distinct()


def gaussian(values: DataFrame, h: int, w: int, sigma: float) -> DataFrame:
    """A separable Gaussian, cut at four sigma, with reflected edges."""
    radius = int(4 * sigma + 0.5)
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(kernel)
    weight = F.element_at(F.array(*(F.lit(k / total) for k in kernel)), F.col("d") + radius + 1)
    away = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    out = values
    for axis, n in (("y", h), ("x", w)):
        asked = out.select("frame_id", "y", "x").withColumn("d", away).withColumn("n", mirrored(F.col(axis) + F.col("d"), F.lit(n)))
        other = "x" if axis == "y" else "y"
        source = out.select("frame_id", F.col(axis).alias("n"), F.col(other).alias(other), "v")
        out = asked.join(source, ["frame_id", "n", other]).groupBy("frame_id", "y", "x").agg(F.sum(F.col("v") * weight).alias("v"))
    return out


def peaks(values: DataFrame, threshold: float = 6.0, radius: int = 3, top: int | None = None) -> DataFrame:
    """frame_id, star_id, y, x, v: places that are their square's maximum and stand out of the sky."""
    from .stats import median_mad

    marks = median_mad(values, floor=1e-6)
    found = max_filter(values, radius).join(marks, "frame_id").where((F.col("v") >= F.col("vmax")) & (F.col("v") > F.col("med") + threshold * F.col("sigma")))
    order = Window.partitionBy("frame_id").orderBy(F.desc("v"), "y", "x")
    found = found.withColumn("star_id", F.row_number().over(order))
    return (found if top is None else found.where(F.col("star_id") <= top)).select("frame_id", "star_id", "y", "x", "v")


def row_runs(mask: DataFrame) -> DataFrame:
    """Runs of set places in each row: frame_id, y, x0, x1 (gaps and islands)."""
    islands = mask.withColumn("isle", F.col("x") - F.row_number().over(by_row()))
    return islands.groupBy("frame_id", "y", "isle").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("isle")
