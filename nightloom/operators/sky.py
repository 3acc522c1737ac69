"""Sky geometry, catalog matching, aperture photometry and the colour fit, over any number of frames.

A projection is one for all frames (``Projection``) or a table with a row for each frame: frame_id,
ra0, dec0, x0, y0, cd11, cd12, cd21, cd22, and optionally maps a and b of distortion terms (see
``sources.fits.projections``) and, for fields of view, h and w. Everything is keyed by frame_id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import CHANNELS, clip, luma
from ..sources.fits import distorted
from .neighbourhood import peaks
from .stats import luma_values, median_mad

PLACE = ("ra0", "dec0", "x0", "y0", "cd11", "cd12", "cd21", "cd22")
#: Pixels per degree where the matrix says nothing; rounds of the inverse distortion.
SCALE, ROUNDS = 1800.0, 6


@dataclass(frozen=True)
class Projection:
    """A gnomonic projection: crval in degrees, crpix counted from 0, cd in degrees per pixel."""

    ra0: float
    dec0: float
    x0: float
    y0: float
    cd: tuple[float, float, float, float]

    def columns(self) -> dict[str, Column]:
        return {k: F.lit(float(v)) for k, v in zip(PLACE, (self.ra0, self.dec0, self.x0, self.y0, *self.cd))}


def placed(df: DataFrame, p: Projection | DataFrame) -> DataFrame:
    """df with its frame's projection beside each row."""
    if isinstance(p, Projection):
        return df.withColumns(p.columns())
    return df.join(p.select("frame_id", *PLACE, *(c for c in ("a", "b") if c in p.columns)), "frame_id")


def unplaced(df: DataFrame) -> DataFrame:
    return df.drop(*PLACE, "a", "b")


def pixel_to_world(df: DataFrame, p: Projection | DataFrame) -> DataFrame:
    """ra and dec of the columns x and y."""
    df = placed(df, p)
    c = F.col
    u, v = c("x") - c("x0"), c("y") - c("y0")
    if "a" in df.columns:
        u, v = u + distorted(c("a"), u, v), v + distorted(c("b"), u, v)
    xi, eta = F.radians(u * c("cd11") + v * c("cd12")), F.radians(u * c("cd21") + v * c("cd22"))
    d0 = F.radians("dec0")
    down = F.cos(d0) - eta * F.sin(d0)
    ra = F.pmod(F.degrees(F.atan2(xi, down)) + c("ra0"), F.lit(360.0))
    dec = F.degrees(F.atan2(F.sin(d0) + eta * F.cos(d0), F.sqrt(xi * xi + down * down)))
    return unplaced(df.withColumns({"ra": ra, "dec": dec}))


def world_to_pixel(df: DataFrame, p: Projection | DataFrame) -> DataFrame:
    """px and py of the columns ra and dec; null on the far side of the sky."""
    return unplaced(projected(placed(df, p)))


def projected(df: DataFrame) -> DataFrame:
    """px and py of ra and dec in the projection beside them; distortion is inverted by fixed-point rounds."""
    c = F.col
    a, d, d0 = F.radians(c("ra") - c("ra0")), F.radians("dec"), F.radians("dec0")
    depth = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(a)
    xi = F.degrees(F.cos(d) * F.sin(a) / depth)
    eta = F.degrees((F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(a)) / depth)
    det = c("cd11") * c("cd22") - c("cd12") * c("cd21")
    df = df.withColumns({"u0": F.when(depth > 0, (xi * c("cd22") - eta * c("cd12")) / det), "v0": F.when(depth > 0, (eta * c("cd11") - xi * c("cd21")) / det)})
    if "a" in df.columns:
        # a loop inside one expression, since nested columns would be written out again and again
        back = lambda s: F.struct((c("u0") - distorted(c("a"), s["u"], s["v"])).alias("u"), (c("v0") - distorted(c("b"), s["u"], s["v"])).alias("v"))
        start = F.struct(c("u0").alias("u"), c("v0").alias("v"))
        df = df.withColumn("uv", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, _: back(s)))
        df = df.withColumns({"u": c("uv")["u"], "v": c("uv")["v"]}).drop("uv")
    else:
        df = df.withColumns({"u": c("u0"), "v": c("v0")})
    return df.withColumns({"px": c("u") + c("x0"), "py": c("v") + c("y0")}).drop("u", "v", "u0", "v0")


def field_of_view(catalog: DataFrame, p: Projection | DataFrame, h: int | None = None, w: int | None = None, margin: float = 0.2, box: float = 3.0) -> DataFrame:
    """Catalog rows inside the frame and its margin: a box first, then the projection.

    With one projection the scan takes the declinations as a filter. With a table (and its h and w),
    frames and rows meet by zones of a degree, and each row comes once for each frame that sees it.
    """
    reach = box + margin
    c = F.col
    if isinstance(p, Projection):
        near = catalog.where((c("dec") > p.dec0 - reach) & (c("dec") < p.dec0 + reach))
        near = near.withColumns(p.columns()).withColumns({"h": F.lit(h), "w": F.lit(w)})
    else:
        frames = p if h is None else p.withColumns({"h": F.lit(h), "w": F.lit(w)})
        asked = frames.withColumn("zone", F.explode(F.sequence(F.floor(c("dec0") - reach).cast("int"), F.floor(c("dec0") + reach).cast("int"))))
        near = catalog.withColumn("zone", F.floor("dec").cast("int")).join(asked, "zone").drop("zone")
        near = near.where((c("dec") > c("dec0") - reach) & (c("dec") < c("dec0") + reach))
    across = reach / F.greatest(F.cos(F.radians("dec0")), F.lit(0.05))
    near = near.where(F.abs(F.pmod(c("ra") - c("ra0") + 540, F.lit(360.0)) - 180) < across)
    top = F.greatest(*(F.abs(k) for k in PLACE[4:]))
    edge = margin * F.when(top > 0, 1 / top).otherwise(SCALE)
    seen = projected(near)
    inside = (c("px") > -edge) & (c("px") < c("w") + edge) & (c("py") > -edge) & (c("py") < c("h") + edge)
    return unplaced(seen.where(inside).drop("h", "w"))


def nearest(stars: DataFrame, catalog: DataFrame, arcsec: float = 2.0, cos_dec: float | None = None) -> DataFrame:
    """frame_id, star_id, src_id, sep, ...: each star's nearest catalog row within the tolerance, by a zone join.

    Declinations fall into zones as high as the tolerance; a star asks its own zone and both next
    ones, so the join has an equality key. Right ascensions may wrap at 360. A catalog with frame_id
    (a field of view of many frames) is matched frame by frame; one without serves every frame.
    """
    tol = arcsec / 3600.0
    zone = lambda c: F.floor(c / tol).cast("long")
    own = "frame_id" in catalog.columns
    mean = F.cos(F.radians(F.avg("dec"))).alias("k")
    if cos_dec is not None:
        asked = stars.withColumn("k", F.lit(cos_dec))
    elif own:
        asked = stars.join(catalog.groupBy("frame_id").agg(mean), "frame_id")
    else:
        asked = stars.crossJoin(F.broadcast(catalog.agg(mean)))
    asked = asked.select("frame_id", "star_id", F.col("ra").alias("sra"), F.col("dec").alias("sdec"), "k", F.explode(F.array(*(zone(F.col("dec")) + i for i in (-1, 0, 1)))).alias("zone"))
    met = asked.join(catalog.withColumn("zone", zone(F.col("dec"))), ["frame_id", "zone"] if own else ["zone"])
    dra = (F.pmod(F.col("ra") - F.col("sra") + 540, F.lit(360.0)) - 180) * F.col("k")
    d2 = dra * dra + (F.col("dec") - F.col("sdec")) * (F.col("dec") - F.col("sdec"))
    best = Window.partitionBy("frame_id", "star_id").orderBy("d2", "src_id")
    ranked = met.withColumn("d2", d2).where(F.col("d2") <= tol * tol).withColumn("n", F.row_number().over(best))
    return ranked.where("n = 1").drop("n", "zone", "k", "sra", "sdec").withColumn("sep", F.sqrt("d2") * 3600).drop("d2")


def photometry(px: DataFrame, stars: DataFrame, h: int | None = None, w: int | None = None, aperture: int = 3, inner: int = 5, outer: int = 8) -> DataFrame:
    """frame_id, star_id, r, g, b: mean of the aperture less median of the ring, at least 0; 0 near the edge.

    Without h and w, stars have them as columns."""
    high, wide = (F.col("h"), F.col("w")) if h is None else (F.lit(h), F.lit(w))
    offset = F.explode(F.sequence(F.lit(-outer), F.lit(outer)))
    inside = (F.col("y") >= outer) & (F.col("y") < high - outer) & (F.col("x") >= outer) & (F.col("x") < wide - outer)
    patch = stars.select("frame_id", "star_id", "y", "x", inside.alias("inside")).withColumn("dy", offset).withColumn("dx", offset)
    d2 = F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")
    patch = patch.withColumn("d2", d2).where(F.col("d2") < outer * outer)
    patch = patch.select("frame_id", "star_id", "d2", "inside", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"))
    met = patch.join(px, ["frame_id", "y", "x"], "left")
    core, ring = F.col("d2") <= aperture * aperture, (F.col("d2") >= inner * inner) & (F.col("d2") < outer * outer)
    value = lambda c: F.greatest(F.avg(F.when(core, F.col(c))) - F.median(F.when(ring, F.col(c))), F.lit(0.0))
    return met.groupBy("frame_id", "star_id").agg(*(F.when(F.min(F.col("inside").cast("int")) == 1, value(c)).otherwise(0.0).alias(c) for c in CHANNELS))


def colour_targets(df: DataFrame, reference: float | None = 0.82, amplitude: float = 0.08) -> DataFrame:
    """tr, tg, tb from phot_bp_mean_mag and phot_rp_mean_mag: linear in colour, floored, of sum 1.

    Without a reference, each frame's median colour is its own."""
    colour = F.col("phot_bp_mean_mag") - F.col("phot_rp_mean_mag")
    if reference is None:
        # a frame's matched stars are few: as many as were asked for at most
        df = df.withColumn("middle", F.median(colour).over(Window.partitionBy("frame_id")))
        o = (colour - F.col("middle")) * amplitude
    else:
        o = (colour - reference) * amplitude
    raw = [F.greatest(F.lit(1 / 3) + k * o, F.lit(1e-3)) for k in (1, 0, -1)]
    total = raw[0] + raw[1] + raw[2]
    return df.withColumns({f"t{c}": v / total for c, v in zip(CHANNELS, raw)}).drop("middle")


def colour_gains(measured: DataFrame, lo: float = 0.85, hi: float = 1.20) -> DataFrame:
    """frame_id, n, gr, gg, gb: least-squares gain of each channel over stars, of mean 1, clamped."""
    total = F.col("r") + F.col("g") + F.col("b")
    m = {c: F.col(c) / total for c in CHANNELS}
    sums = measured.groupBy("frame_id").agg(F.count("*").alias("n"), *(F.sum(m[c] * F.col(f"t{c}")).alias(f"mt{c}") for c in CHANNELS), *(F.sum(m[c] * m[c]).alias(f"mm{c}") for c in CHANNELS))
    gain = {c: F.when(F.col(f"mm{c}") < 1e-12, 1.0).otherwise(F.col(f"mt{c}") / F.col(f"mm{c}")) for c in CHANNELS}
    sums = sums.withColumns({f"g{c}": gain[c] for c in CHANNELS})
    mean = (F.col("gr") + F.col("gg") + F.col("gb")) / 3
    sums = sums.withColumn("mean", mean)
    return sums.select("frame_id", "n", *(clip(F.when(F.col("mean") > 1e-6, F.col(f"g{c}") / F.col("mean")).otherwise(F.col(f"g{c}")), lo, hi).alias(f"g{c}") for c in CHANNELS))


MATRIX = tuple(f"m{i}{j}" for i in range(3) for j in range(3))


def colour_matrices(measured: DataFrame) -> DataFrame:
    """frame_id, n, m00 ... m22: the least-squares 3 x 3 matrix from measured to target colours, each row of sum 1.

    Only the sums of products, one row a frame, are solved outside the JVM."""
    total = F.col("r") + F.col("g") + F.col("b")
    m = {c: F.col(c) / total for c in CHANNELS}
    products = [F.sum(m[a] * m[b]).alias(f"p{a}{b}") for a in CHANNELS for b in CHANNELS] + [F.sum(m[a] * F.col(f"t{b}")).alias(f"q{a}{b}") for a in CHANNELS for b in CHANNELS]
    sums = measured.groupBy("frame_id").agg(F.count("*").alias("n"), *products)

    def solve(frames):
        for f in frames:
            rows = []
            for _, r in f.iterrows():
                p, q = (np.array([[r[f"{k}{a}{b}"] for b in CHANNELS] for a in CHANNELS]) for k in "pq")
                m = np.linalg.lstsq(p, q, rcond=None)[0].T
                rows.append((r["frame_id"], r["n"], *(m / np.where(np.abs(m.sum(1, keepdims=True)) > 1e-6, m.sum(1, keepdims=True), 1)).ravel()))
            yield pd.DataFrame(rows, columns=["frame_id", "n", *MATRIX])

    return sums.mapInPandas(solve, "frame_id string, n long, " + ", ".join(f"{c} double" for c in MATRIX))


def star_colours(px: DataFrame, catalog: DataFrame, p: Projection | DataFrame, h: int | None = None, w: int | None = None, n_detect: int = 200, arcsec: float = 2.0, reference: float | None = 0.82, amplitude: float = 0.08, aperture: int = 3, inner: int = 5, outer: int = 8) -> DataFrame:
    """Measured (r, g, b) and wanted (tr, tg, tb) colours of the matched, usable stars of each frame."""
    stars = peaks(luma_values(px), top=n_detect)
    if h is None:
        stars = stars.join(p.select("frame_id", "h", "w"), "frame_id")
    world = pixel_to_world(stars, p)
    pairs = nearest(world, field_of_view(catalog, p, h, w), arcsec)
    light = photometry(px, stars, h, w, aperture, inner, outer).where(F.least(*CHANNELS) > 1e-5)
    return colour_targets(light.join(pairs, ["frame_id", "star_id"]), reference, amplitude)


def calibrate(px: DataFrame, catalog: DataFrame, p: Projection | DataFrame, h: int | None = None, w: int | None = None, min_matches: int = 20, mode: str = "diagonal", **settings) -> DataFrame:
    """frame_id, n and the three gains, or with mode "full" the nine terms of a matrix, of each frame.

    A frame with under min_matches usable stars keeps its colours."""
    if mode not in ("diagonal", "full"):
        raise ValueError(f"unknown mode {mode!r}")
    colours = star_colours(px, catalog, p, h, w, **settings)
    names, neutral = ([f"g{c}" for c in CHANNELS], [1.0] * 3) if mode == "diagonal" else (MATRIX, [float(i == j) for i in range(3) for j in range(3)])
    fitted = colour_gains(colours) if mode == "diagonal" else colour_matrices(colours)
    every = px.select("frame_id").distinct().join(fitted, "frame_id", "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return every.select("frame_id", n.alias("n"), *(F.when(n >= min_matches, F.col(c)).otherwise(v).alias(c) for c, v in zip(names, neutral)))


def apply_gains(px: DataFrame, gains: DataFrame, strength: float = 0.5, weighted: bool = True, signal_percentile: float = 95) -> DataFrame:
    """Pixels with their frame's gains or matrix dialled in, by luma above the sky if weighted."""
    s = min(1.0, max(0.0, strength))
    lit = px.join(gains.drop("n"), "frame_id")
    if "gr" in gains.columns:
        calibrated = {c: clip(F.col(c) * (1 + s * (F.col(f"g{c}") - 1))) for c in CHANNELS}
    else:
        mixed = lambda i: sum((F.col(f"m{i}{j}") * F.col(c) for j, c in enumerate(CHANNELS)), F.lit(0.0))
        calibrated = {c: clip(F.col(c) + s * (mixed(i) - F.col(c))) for i, c in enumerate(CHANNELS)}
    if not weighted:
        return lit.withColumns(calibrated).select(*px.columns)
    values = luma_values(px)
    marks = median_mad(values, floor=1e-6).join(values.groupBy("frame_id").agg(F.percentile("v", F.lit(signal_percentile / 100)).alias("top")), "frame_id")
    lit = lit.join(marks, "frame_id").withColumn("sky", F.col("med") + 2 * F.col("sigma"))
    weight = F.pow(clip((luma() - F.col("sky")) / F.greatest(F.col("top") - F.col("sky"), F.lit(1e-6))), F.lit(2))
    lit = lit.withColumn("weight", weight)
    return lit.withColumns({c: F.col(c) * (1 - F.col("weight")) + v * F.col("weight") for c, v in calibrated.items()}).select(*px.columns)
