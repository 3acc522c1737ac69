"""The registered queries of the frame engine, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import CHANNELS, SKY_H, SKY_W, clip, heat_frame, luma, rounded, sky_frame, sky_stars, table, with_stats
from .functions import pixels
from .operators import classify, jobs, neighbourhood, sky, stats
from .sources import headers

SKY_PROJECTION = sky.Projection(180.0, 0.0, 64.0, 48.0, (-0.001, 0.0, 0.0, 0.001))


def star_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planted stars, and decoys all over the sky."""
    stars = sky_stars(spark, sf_dir).select(
        F.col("star").alias("src_id"), (180.0 - (F.col("sx") - 64) * 0.001).alias("ra"), ((F.col("sy") - 48) * 0.001).alias("dec"),
        (10.41 + 0.5 * F.col("t")).alias("phot_bp_mean_mag"), (9.59 - 0.5 * F.col("t")).alias("phot_rp_mean_mag"),
    )
    key = F.col("o_orderkey")
    decoys = table(spark, sf_dir, "orders").select((key + 1_000_000).cast("long").alias("src_id"), ((key * 137.508) % 360).alias("ra"), ((key * 73) % 180 - 90).cast("double").alias("dec"), F.lit(10.0).alias("phot_bp_mean_mag"), F.lit(10.0).alias("phot_rp_mean_mag"))
    return stars.unionByName(decoys)


# ------------------------------------------------------------------------------ SQL pieces

HEAT = """
cells AS (
  SELECT l_orderkey % 32 AS y, (l_partkey + 13 * l_linenumber) % 32 AS x,
    avg(l_quantity) / 50.0e0 AS r, avg(l_discount) / 0.1e0 AS g, avg(l_tax) / 0.08e0 AS b
  FROM lineitem GROUP BY 1, 2),
px AS (
  SELECT CAST(i // 32 AS INTEGER) AS y, CAST(i % 32 AS INTEGER) AS x, coalesce(r, 0e0) AS r, coalesce(g, 0e0) AS g, coalesce(b, 0e0) AS b
  FROM range(1024) t(i) LEFT JOIN cells ON cells.y = i // 32 AND cells.x = i % 32)"""

SKY = """
stars AS (
  SELECT c_custkey AS star, 8 + (c_custkey * 37) % 80 AS sy, 8 + (c_custkey * 53) % 112 AS sx,
    0.35e0 + 0.5e0 * ((c_custkey * 17) % 101) / 100.0e0 AS amp, (c_nationkey - 12) / 12.0e0 AS t
  FROM customer WHERE c_custkey BETWEEN 1 AND 60),
stamp AS (
  SELECT sy + dy AS y, sx + dx AS x,
    max(amp * greatest(0e0, 1e0 - 0.25e0 * (abs(dy) + abs(dx))) * (1 + 0.2e0 * t)) AS r,
    max(amp * greatest(0e0, 1e0 - 0.25e0 * (abs(dy) + abs(dx)))) AS g,
    max(amp * greatest(0e0, 1e0 - 0.25e0 * (abs(dy) + abs(dx))) * (1 - 0.2e0 * t)) AS b
  FROM stars, (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx) GROUP BY 1, 2),
base AS (
  SELECT i // 128 AS y, i % 128 AS x,
    0.02e0 + 0.02e0 * (((i // 128) * 7919 + (i % 128) * 104729 + 0) % 1009) / 1009.0e0 + 0.10e0 * exp(-(power(i // 128 - 48, 2) + power(i % 128 - 64, 2)) / 400.0e0) AS r,
    0.02e0 + 0.02e0 * (((i // 128) * 7919 + (i % 128) * 104729 + 331) % 1009) / 1009.0e0 + 0.08e0 * exp(-(power(i // 128 - 48, 2) + power(i % 128 - 64, 2)) / 400.0e0) AS g,
    0.02e0 + 0.02e0 * (((i // 128) * 7919 + (i % 128) * 104729 + 662) % 1009) / 1009.0e0 + 0.06e0 * exp(-(power(i // 128 - 48, 2) + power(i % 128 - 64, 2)) / 400.0e0) AS b
  FROM range(12288) t(i)),
px AS (
  SELECT CAST(base.y AS INTEGER) AS y, CAST(base.x AS INTEGER) AS x, greatest(base.r, coalesce(stamp.r, 0e0)) AS r, greatest(base.g, coalesce(stamp.g, 0e0)) AS g, greatest(base.b, coalesce(stamp.b, 0e0)) AS b
  FROM base LEFT JOIN stamp ON stamp.y = base.y AND stamp.x = base.x)"""

DETECT = (
    SKY
    + """,
v AS (SELECT y, x, (r + g + b) / 3.0e0 AS v FROM px),
med AS (SELECT median(v) AS med FROM v),
mad AS (SELECT greatest(1.4826e0 * median(abs(v - med)), 1e-6) AS sigma FROM v, med),
rowmax AS (SELECT y, x, v, max(v) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM v),
vmax AS (SELECT y, x, v, max(m) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM rowmax),
det AS (
  SELECT CAST(row_number() OVER (ORDER BY v DESC, y, x) AS INTEGER) AS star_id, y, x, v
  FROM vmax, med, mad WHERE v >= m AND v > med + 6 * sigma)"""
)

CATALOG = """
cat AS (
  SELECT star AS src_id, 180.0e0 - (sx - 64) * 0.001e0 AS ra, (sy - 48) * 0.001e0 AS dec, 10.41e0 + 0.5e0 * t AS bp, 9.59e0 - 0.5e0 * t AS rp FROM stars
  UNION ALL
  SELECT o_orderkey + 1000000, (o_orderkey * 137.508e0) % 360, CAST((o_orderkey * 73) % 180 - 90 AS DOUBLE), 10.0e0, 10.0e0 FROM orders),
near AS (SELECT * FROM cat WHERE dec > -3.2e0 AND dec < 3.2e0 AND abs((ra - 180 + 540) % 360 - 180) < 3.2e0),
proj AS (
  SELECT *, sin(radians(ra - 180)) * cos(radians(dec)) / (cos(radians(dec)) * cos(radians(ra - 180))) AS xi, sin(radians(dec)) / (cos(radians(dec)) * cos(radians(ra - 180))) AS eta FROM near),
fov AS (
  SELECT *, degrees(xi) / -0.001e0 + 64 AS px, degrees(eta) / 0.001e0 + 48 AS py FROM proj
  WHERE degrees(xi) / -0.001e0 + 64 > -200 AND degrees(xi) / -0.001e0 + 64 < 328 AND degrees(eta) / 0.001e0 + 48 > -200 AND degrees(eta) / 0.001e0 + 48 < 296)"""

WORLD = """
std AS (SELECT star_id, y, x, radians((x - 64) * -0.001e0) AS xi, radians((y - 48) * 0.001e0) AS eta FROM det),
world AS (SELECT star_id, y, x, (degrees(atan2(xi, 1e0)) + 180.0e0) % 360 AS ra, degrees(atan2(eta, sqrt(xi * xi + 1e0))) AS dec FROM std),
k AS (SELECT cos(radians(avg(dec))) AS k FROM fov),
cand AS (
  SELECT w.star_id, f.src_id, f.bp, f.rp, power((f.ra - w.ra) * k, 2) + power(f.dec - w.dec, 2) AS d2
  FROM world w, fov f, k WHERE power((f.ra - w.ra) * k, 2) + power(f.dec - w.dec, 2) <= power(2.0e0 / 3600, 2)),
pairs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY star_id ORDER BY d2, src_id) AS n FROM cand) WHERE n = 1)"""

LIGHT = """
patch AS (
  SELECT star_id, y + dy AS y, x + dx AS x, dy * dy + dx * dx AS d2 FROM det, (SELECT unnest(range(-8, 9)) AS dy), (SELECT unnest(range(-8, 9)) AS dx)
  WHERE y >= 8 AND y < 88 AND x >= 8 AND x < 120),
light AS (
  SELECT star_id, greatest(avg(r) FILTER (WHERE d2 <= 9) - median(r) FILTER (WHERE d2 >= 25 AND d2 < 64), 0e0) AS r,
    greatest(avg(g) FILTER (WHERE d2 <= 9) - median(g) FILTER (WHERE d2 >= 25 AND d2 < 64), 0e0) AS g,
    greatest(avg(b) FILTER (WHERE d2 <= 9) - median(b) FILTER (WHERE d2 >= 25 AND d2 < 64), 0e0) AS b
  FROM patch JOIN px USING (y, x) GROUP BY 1)"""

FIT = """
raw AS (
  SELECT star_id, l.r / (l.r + l.g + l.b) AS mr, l.g / (l.r + l.g + l.b) AS mg, l.b / (l.r + l.g + l.b) AS mb,
    greatest(1e0 / 3 + (bp - rp - 0.82e0) * 0.08e0, 1e-3) AS ar, 1e0 / 3 AS ag, greatest(1e0 / 3 - (bp - rp - 0.82e0) * 0.08e0, 1e-3) AS ab
  FROM light l JOIN pairs USING (star_id) WHERE least(l.r, l.g, l.b) > 1e-5),
g0 AS (
  SELECT count(*) AS n, sum(mr * ar / (ar + ag + ab)) / sum(mr * mr) AS r, sum(mg * ag / (ar + ag + ab)) / sum(mg * mg) AS g, sum(mb * ab / (ar + ag + ab)) / sum(mb * mb) AS b FROM raw),
gains AS (
  SELECT n, CASE WHEN n >= 20 THEN least(greatest(3 * r / (r + g + b), 0.85e0), 1.2e0) ELSE 1e0 END AS gr,
    CASE WHEN n >= 20 THEN least(greatest(3 * g / (r + g + b), 0.85e0), 1.2e0) ELSE 1e0 END AS gg,
    CASE WHEN n >= 20 THEN least(greatest(3 * b / (r + g + b), 0.85e0), 1.2e0) ELSE 1e0 END AS gb FROM g0)"""

JOBS = """
jobs AS (
  SELECT event_id AS id, ts AS created_at, value AS seconds,
    CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'queued' WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' END AS status,
    CASE WHEN event_type IN ('purchase', 'error') THEN ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) END AS terminated_at
  FROM events)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            # off exact halves, as rounded() does
            ORACLES[name] = re.sub(r", ([46])\) \+ 0e0", r" + 1e-9, \1) + 0e0", sql)
        return f

    return register


def pixel_sql(ctes: str, select: dict[str, str], source: str = "px", frame: str = HEAT) -> str:
    """SQL that gives y, x and rounded channels."""
    columns = ", ".join(f"round({v}, 6) + 0e0 AS {k}" for k, v in select.items())
    return f"WITH {frame}{',' if ctes else ''}{ctes} SELECT y, x, {columns} FROM {source}"


def channels(px: DataFrame) -> DataFrame:
    return px.select("y", "x", *CHANNELS)


RGB = {c: c for c in CHANNELS}
LUMA = "(r + g + b) / 3.0e0"


# ------------------------------------------------------------------------------ pointwise


@query("map_luma", pixel_sql("", {"luma": LUMA}))
def map_luma(spark, d):
    return heat_frame(spark, d).select("y", "x", luma().alias("luma"))


@query("map_clip", pixel_sql("", {c: f"least(greatest({c} * 2 - 0.7e0, 0e0), 1e0)" for c in CHANNELS}))
def map_clip(spark, d):
    return channels(pixels.each(heat_frame(spark, d), lambda v, c: clip(v * 2 - 0.7)))


@query("map_dark_subtract", pixel_sql("", {c: f"least(greatest(px.{c} - 0.5e0 * s.{c}, 0e0), 1e0)" for c in CHANNELS}, "px JOIN (SELECT y, x, r * 0.5e0 AS r, g * 0.5e0 AS g, b * 0.5e0 AS b FROM px) s USING (y, x)"))
def map_dark_subtract(spark, d):
    px = heat_frame(spark, d)
    return channels(pixels.dark_subtract(px, pixels.each(px, lambda v, c: v * 0.5), 0.5))


@query("map_colour_matrix", pixel_sql("", {"r": "greatest(r * 0.92e0 - 0.05e0 * g + 0.13e0 * b, 0e0)", "g": "greatest(-0.05e0 * r + 0.95e0 * g + 0.10e0 * b, 0e0)", "b": "greatest(-0.02e0 * r - 0.03e0 * g + 1.05e0 * b, 0e0)"}))
def map_colour_matrix(spark, d):
    return channels(pixels.colour_matrix(heat_frame(spark, d)))


@query("map_green_clip", pixel_sql("", {"r": "r", "g": "g * 0.5e0 + least(g, (r + b) / 2e0) * 0.5e0", "b": "b"}))
def map_green_clip(spark, d):
    return channels(pixels.green_clip(heat_frame(spark, d), 0.5))


STRETCH = """
black AS (SELECT quantile_cont(r, 0.001e0) AS r, quantile_cont(g, 0.001e0) AS g, quantile_cont(b, 0.001e0) AS b FROM px),
low AS (SELECT px.y, px.x, greatest(px.r - black.r, 0e0) AS r, greatest(px.g - black.g, 0e0) AS g, greatest(px.b - black.b, 0e0) AS b FROM px, black),
white AS (SELECT greatest(quantile_cont((r + g + b) / 3.0e0, 0.999e0), 1e-6) AS w FROM low),
st AS (SELECT y, x, asinh(least(r / w, 1e0) * 25e0) / asinh(25e0) AS r, asinh(least(g / w, 1e0) * 25e0) / asinh(25e0) AS g, asinh(least(b / w, 1e0) * 25e0) / asinh(25e0) AS b FROM low, white)"""


@query("map_stretch", pixel_sql(STRETCH, RGB, "st", SKY))
def map_stretch(spark, d):
    return channels(pixels.stretch(sky_frame(spark, d)))


@query("map_s_curve", pixel_sql("", {c: f"(tanh(1.6e0 * (2 * {c} - 1)) / tanh(1.6e0) + 1) / 2" for c in CHANNELS}))
def map_s_curve(spark, d):
    return channels(pixels.each(heat_frame(spark, d), lambda v, c: pixels.s_curve(v, 0.6)))


@query("map_linear_saturation", pixel_sql("", {c: f"{LUMA} + ({c} - {LUMA}) * 1.4e0" for c in CHANNELS}))
def map_linear_saturation(spark, d):
    return channels(pixels.linear_saturation(heat_frame(spark, d), 1.4))


HSV = """
ends AS (SELECT *, greatest(r, g, b) AS top, CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0e0 END AS s FROM px),
k AS (SELECT *, CASE WHEN s > 0 THEN least(greatest(s * 1.4e0, 0e0), 1e0) / s ELSE 1e0 END AS k FROM ends)"""


@query("map_hsv_saturation", pixel_sql(HSV, {c: f"top - (top - {c}) * k" for c in CHANNELS}, "k"))
def map_hsv_saturation(spark, d):
    return channels(pixels.hsv_saturation(heat_frame(spark, d), 1.4))


CURVES = """
sc AS (SELECT y, x, (tanh(1.6e0 * (2 * least(r, 1e0) - 1)) / tanh(1.6e0) + 1) / 2 AS r, (tanh(1.6e0 * (2 * least(g, 1e0) - 1)) / tanh(1.6e0) + 1) / 2 AS g, (tanh(1.6e0 * (2 * least(b, 1e0) - 1)) / tanh(1.6e0) + 1) / 2 AS b FROM px),
t AS (SELECT quantile_cont((r + g + b) / 3.0e0, 0.99e0) AS t FROM sc),
sl AS (SELECT sc.*, (r + g + b) / 3.0e0 AS l, CASE WHEN t > 0 THEN 1.2e0 - 0.2e0 * least(greatest(((r + g + b) / 3.0e0 - t) / greatest(t, 1e-6), 0e0), 1e0) ELSE 1.2e0 END AS s FROM sc, t)"""


@query("map_curves", pixel_sql(CURVES, {c: f"least(greatest(l + ({c} - l) * s, 0e0), 1e0)" for c in CHANNELS}, "sl", SKY))
def map_curves(spark, d):
    return channels(pixels.curves(sky_frame(spark, d)))


GAINS = {"r": 1.4, "g": 0.95, "b": 0.75}
TINTED = (
    CURVES[: CURVES.index("t AS (")]
    + "t AS (SELECT quantile_cont((r + g + b) / 3.0e0, 0.99e0) AS t FROM sc),\nw AS (SELECT sc.*, (r + g + b) / 3.0e0 * (1 - least(greatest(((r + g + b) / 3.0e0 - t) / greatest(1 - t, 1e-6), 0e0), 1e0)) AS w FROM sc, t),\ntg AS (SELECT y, x, "
    + ", ".join(f"least(greatest({c} * (1 + ({g}e0 - 1) * w), 0e0), 1e0) AS {c}" for c, g in GAINS.items())
    + " FROM w),"
    + HSV.replace("FROM px", "FROM tg").replace("1.4e0", "1.25e0")
)


@query("map_curves_hsv", pixel_sql(TINTED, {c: f"least(greatest(top - (top - {c}) * k, 0e0), 1e0)" for c in CHANNELS}, "k", SKY))
def map_curves_hsv(spark, d):
    return channels(pixels.curves(sky_frame(spark, d), saturation=1.25, gains=tuple(GAINS.values()), mode="hsv"))


@query("map_screen_blend", pixel_sql("", {c: f"1 - (1 - least({c}, 1e0)) * (1 - least({c} * 0.5e0, 1e0))" for c in CHANNELS}))
def map_screen_blend(spark, d):
    px = heat_frame(spark, d)
    return channels(pixels.screen_blend(px, pixels.each(px, lambda v, c: v * 0.5)))


@query("map_quantise16", "WITH " + HEAT + " SELECT y, x, " + ", ".join(f"CAST(round_even(least({c}, 1e0) * 65535, 0) AS INTEGER) AS {c}" for c in CHANNELS) + " FROM px")
def map_quantise16(spark, d):
    return channels(pixels.quantise16(heat_frame(spark, d)))


@query("flt_crop", "WITH " + HEAT + " SELECT CAST(y - 4 AS INTEGER) AS y, CAST(x - 8 AS INTEGER) AS x, round(r, 6) + 0e0 AS r, round(g, 6) + 0e0 AS g, round(b, 6) + 0e0 AS b FROM px WHERE y >= 4 AND y < 28 AND x >= 8 AND x < 30")
def flt_crop(spark, d):
    return channels(pixels.crop(heat_frame(spark, d), 32, 32, 4, 8, -4, 30))


BAND = """
l AS (SELECT y, x, (r + g + b) / 3.0e0 AS l FROM px), p AS (SELECT quantile_cont(l, 0.4e0) AS lo, quantile_cont(l, 0.8e0) AS hi FROM l)"""


@query("flt_percentile_band", f"WITH {HEAT},{BAND} SELECT y, x, round(l, 6) + 0e0 AS luma FROM l, p WHERE l >= lo AND l <= CASE WHEN hi <= lo THEN lo + 1e-6 ELSE hi END")
def flt_percentile_band(spark, d):
    lit = with_stats(heat_frame(spark, d).withColumn("luma", luma()), F.percentile(luma(), F.lit(0.4)).alias("lo"), F.percentile(luma(), F.lit(0.8)).alias("hi"))
    top = F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1e-6).otherwise(F.col("hi"))
    return lit.where((F.col("luma") >= F.col("lo")) & (F.col("luma") <= top)).select("y", "x", "luma")


# ------------------------------------------------------------------------------ aggregates

POINTS = (0.05, 0.25, 0.5, 0.75, 0.999)


@query("agg_percentiles", f"WITH {HEAT} SELECT " + ", ".join(f"round(quantile_cont({LUMA}, {p}e0), 6) + 0e0 AS p{int(p * 1000)}" for p in POINTS) + " FROM px")
def agg_percentiles(spark, d):
    got = heat_frame(spark, d).agg(F.percentile(luma(), F.array(*(F.lit(p) for p in POINTS))).alias("p"))
    return got.select(*(F.col("p")[i].alias(f"p{int(p * 1000)}") for i, p in enumerate(POINTS)))


@query("agg_range", f"WITH {SKY} SELECT " + ", ".join(f"round(min({c}), 6) + 0e0 AS low_{c}, round(max({c}), 6) + 0e0 AS high_{c}" for c in CHANNELS) + " FROM px")
def agg_range(spark, d):
    return sky_frame(spark, d).groupBy("frame_id").agg(*(f(c).alias(f"{n}_{c}") for c in CHANNELS for n, f in (("low", F.min), ("high", F.max)))).drop("frame_id")


@query("agg_median_mad", f"WITH {SKY}, v AS (SELECT {LUMA} AS v FROM px), m AS (SELECT median(v) AS med FROM v) SELECT round(med, 6) + 0e0 AS med, round(1.4826e0 * median(abs(v - med)), 6) + 0e0 AS sigma FROM v, m GROUP BY med")
def agg_median_mad(spark, d):
    return stats.median_mad(stats.luma_values(sky_frame(spark, d))).select("med", "sigma")


def _clip_sql(rounds: int) -> str:
    out, source = f"WITH {SKY}, v AS (SELECT {LUMA} AS v FROM px), k0 AS (SELECT v FROM v)", "k0"
    for i in range(rounds):
        out += f", m{i} AS (SELECT median(v) AS m FROM {source}), s{i} AS (SELECT 1.4826e0 * median(abs(v - m)) AS s FROM {source}, m{i}), k{i + 1} AS (SELECT v FROM v, m{i}, s{i} WHERE s = 0 OR abs(v - m) <= 2.5e0 * s)"
        source = f"k{i + 1}"
    return out + f" SELECT round(median(v), 6) + 0e0 AS med, count(*) AS n FROM {source}"


@query("flt_sigma_clip", _clip_sql(3))
def flt_sigma_clip(spark, d):
    return stats.sigma_clip(stats.luma_values(sky_frame(spark, d)), 2.5, 3).select("med", "n")


PAIRS = [(a, b) for i, a in enumerate(CHANNELS) for b in CHANNELS[i:]]
TRIMMED = f"""
m AS (SELECT avg(r) AS mr, avg(g) AS mg, avg(b) AS mb, {", ".join(f"{f'var_samp({a}) + 1e-8' if a == b else f'covar_samp({a}, {b})'} AS {a}{b}" for a, b in PAIRS)} FROM px),
i AS (SELECT *, rr * (gg * bb - gb * gb) - rg * (rg * bb - gb * rb) + rb * (rg * gb - gg * rb) AS det FROM m),
d AS (
  SELECT r, g, b, (power(r - mr, 2) * (gg * bb - gb * gb) + power(g - mg, 2) * (rr * bb - rb * rb) + power(b - mb, 2) * (rr * gg - rg * rg)
    + 2 * (r - mr) * (g - mg) * (rb * gb - rg * bb) + 2 * (r - mr) * (b - mb) * (rg * gb - rb * gg) + 2 * (g - mg) * (b - mb) * (rg * rb - rr * gb)) / det AS d2 FROM px, i)"""


@query("agg_trimmed_median", f"WITH {SKY},{TRIMMED} SELECT count(*) AS kept, " + ", ".join(f"round(median({c}), 6) + 0e0 AS {c}" for c in CHANNELS) + " FROM d WHERE d2 < 18.75e0")
def agg_trimmed_median(spark, d):
    return stats.trimmed_median(sky_frame(spark, d)).select("kept", *CHANNELS)


# ------------------------------------------------------------------------------ neighbourhoods

V = f"v AS (SELECT y, x, {LUMA} AS v FROM px)"


@query("nbr_max_filter", f"WITH {SKY}, {V}, rm AS (SELECT *, max(v) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM v) SELECT y, x, round(max(m) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) + 0e0 AS vmax FROM rm")
def nbr_max_filter(spark, d):
    return neighbourhood.max_filter(stats.luma_values(sky_frame(spark, d))).select("y", "x", "vmax")


@query("nbr_median_filter", f"WITH {HEAT}, {V}, a AS (SELECT y, x, least(greatest(y + dy, 0), 31) AS ny, least(greatest(x + dx, 0), 31) AS nx FROM v, (SELECT unnest(range(-1, 2)) AS dy), (SELECT unnest(range(-1, 2)) AS dx)) SELECT a.y, a.x, round(median(v.v), 6) + 0e0 AS vmed FROM a JOIN v ON v.y = ny AND v.x = nx GROUP BY 1, 2")
def nbr_median_filter(spark, d):
    return neighbourhood.median_filter(stats.luma_values(heat_frame(spark, d)), 32, 32).select("y", "x", "vmed")


SIDES = "coalesce(lag(v) OVER r, v) + coalesce(lead(v) OVER r, v) + coalesce(lag(v) OVER c, v) + coalesce(lead(v) OVER c, v) - 4 * v"


@query("nbr_laplacian", f"WITH {HEAT}, {V} SELECT y, x, round({SIDES}, 6) + 0e0 AS lap FROM v WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y)")
def nbr_laplacian(spark, d):
    return neighbourhood.laplacian(stats.luma_values(heat_frame(spark, d))).select("y", "x", "lap")


@query("agg_noise_estimate", f"WITH {SKY}, {V}, l AS (SELECT {SIDES} AS l FROM v WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y)), m AS (SELECT median(l) AS m FROM l) SELECT round(least(greatest(1.4826e0 * median(abs(l - m)) / sqrt(8e0), 1e-4), 0.3e0), 6) + 0e0 AS noise FROM l, m")
def agg_noise_estimate(spark, d):
    lap = neighbourhood.laplacian(stats.luma_values(sky_frame(spark, d))).select("frame_id", F.col("lap").alias("v"))
    return stats.median_mad(lap).select(clip(F.col("sigma") / F.sqrt(F.lit(8.0)), 1e-4, 0.3).alias("noise"))


SLOPE = "CASE WHEN lag(v) OVER {w} IS NULL THEN lead(v) OVER {w} - v WHEN lead(v) OVER {w} IS NULL THEN v - lag(v) OVER {w} ELSE (lead(v) OVER {w} - lag(v) OVER {w}) / 2 END"


@query("nbr_gradient", f"WITH {HEAT}, {V}, g AS (SELECT y, x, {SLOPE.format(w='c')} AS gy, {SLOPE.format(w='r')} AS gx FROM v WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y)) SELECT y, x, round(sqrt(gy * gy + gx * gx), 6) + 0e0 AS grad FROM g")
def nbr_gradient(spark, d):
    return neighbourhood.gradient(stats.luma_values(heat_frame(spark, d))).select("y", "x", "grad")


@query("nbr_dilate", f"WITH {SKY}, {V}, o AS (SELECT dy, dx FROM (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx) WHERE abs(dy) + abs(dx) <= 3) SELECT DISTINCT CAST(y + dy AS INTEGER) AS y, CAST(x + dx AS INTEGER) AS x FROM v, o WHERE v > 0.3e0 AND y + dy BETWEEN 0 AND 95 AND x + dx BETWEEN 0 AND 127")
def nbr_dilate(spark, d):
    mask = stats.luma_values(sky_frame(spark, d)).where("v > 0.3")
    return neighbourhood.dilate(mask, SKY_H, SKY_W).select("y", "x")


def mirror_sql(k: str, n: int) -> str:
    m = f"((({k}) % {2 * n} + {2 * n}) % {2 * n})"
    return f"least({m}, {2 * n - 1} - {m})"


GAUSS = f"""WITH {HEAT}, {V}, k AS (SELECT d, exp(-0.5e0 * power(d / 1.5e0, 2)) AS w FROM (SELECT unnest(range(-6, 7)) AS d)), s AS (SELECT sum(w) AS s FROM k),
p1 AS (SELECT a.y, a.x, sum(v.v * w / s) AS v FROM v a JOIN k ON true JOIN s ON true JOIN v ON v.x = a.x AND v.y = {mirror_sql('a.y + d', 32)} GROUP BY 1, 2),
p2 AS (SELECT a.y, a.x, sum(v.v * w / s) AS v FROM p1 a JOIN k ON true JOIN s ON true JOIN p1 v ON v.y = a.y AND v.x = {mirror_sql('a.x + d', 32)} GROUP BY 1, 2)"""


@query("nbr_gaussian", GAUSS + " SELECT y, x, round(v, 6) + 0e0 AS v FROM p2")
def nbr_gaussian(spark, d):
    return neighbourhood.gaussian(stats.luma_values(heat_frame(spark, d)), 32, 32, 1.5).select("y", "x", "v")


@query("nbr_unsharp", GAUSS + " SELECT px.y, px.x, " + ", ".join(f"round(least(greatest({c} + 0.4e0 * ({LUMA} - p2.v), 0e0), 1e0), 6) + 0e0 AS {c}" for c in CHANNELS) + " FROM px JOIN p2 ON p2.y = px.y AND p2.x = px.x")
def nbr_unsharp(spark, d):
    px = heat_frame(spark, d)
    soft = neighbourhood.gaussian(stats.luma_values(px), 32, 32, 1.5).withColumnRenamed("v", "soft")
    return channels(pixels.each(px.join(soft, ["frame_id", "y", "x"]).withColumn("l", luma()), lambda v, c: clip(v + 0.4 * (F.col("l") - F.col("soft")))))


@query("nbr_row_runs", f"WITH {SKY}, {V}, i AS (SELECT y, x, x - row_number() OVER (PARTITION BY y ORDER BY x) AS k FROM v WHERE v > 0.05e0) SELECT y, min(x) AS x0, max(x) AS x1 FROM i GROUP BY y, k")
def nbr_row_runs(spark, d):
    return neighbourhood.row_runs(stats.luma_values(sky_frame(spark, d)).where("v > 0.05")).select("y", "x0", "x1")


# ------------------------------------------------------------------------------ sky


@query("num_detect_stars", f"WITH {DETECT} SELECT star_id, y, x, round(v, 6) + 0e0 AS v FROM det")
def num_detect_stars(spark, d):
    return neighbourhood.peaks(stats.luma_values(sky_frame(spark, d)), top=200).select("star_id", "y", "x", "v")


@query("flt_field_of_view", f"WITH {SKY},{CATALOG} SELECT src_id, round(px, 4) + 0e0 AS px, round(py, 4) + 0e0 AS py FROM fov")
def flt_field_of_view(spark, d):
    seen = sky.field_of_view(star_catalog(spark, d), SKY_PROJECTION, SKY_H, SKY_W)
    return rounded(seen.select("src_id", "px", "py"), digits=4)


@query("sky_pixel_to_world", f"WITH {DETECT},{CATALOG},{WORLD} SELECT star_id, round(ra, 6) + 0e0 AS ra, round(dec, 6) + 0e0 AS dec FROM world")
def sky_pixel_to_world(spark, d):
    return sky.pixel_to_world(neighbourhood.peaks(stats.luma_values(sky_frame(spark, d)), top=200), SKY_PROJECTION).select("star_id", "ra", "dec")


@query("join_nearest", f"WITH {DETECT},{CATALOG},{WORLD} SELECT star_id, src_id, round(sqrt(d2) * 3600, 4) + 0e0 AS sep FROM pairs")
def join_nearest(spark, d):
    stars = sky.pixel_to_world(neighbourhood.peaks(stats.luma_values(sky_frame(spark, d)), top=200), SKY_PROJECTION)
    pairs = sky.nearest(stars, sky.field_of_view(star_catalog(spark, d), SKY_PROJECTION, SKY_H, SKY_W))
    return rounded(pairs.select("star_id", "src_id", "sep"), digits=4)


@query("agg_photometry", f"WITH {DETECT},{LIGHT} SELECT star_id, round(r, 6) + 0e0 AS r, round(g, 6) + 0e0 AS g, round(b, 6) + 0e0 AS b FROM light")
def agg_photometry(spark, d):
    px = sky_frame(spark, d)
    return sky.photometry(px, neighbourhood.peaks(stats.luma_values(px), top=200), SKY_H, SKY_W).drop("frame_id")


@query("flagship_calibration", f"WITH {DETECT},{CATALOG},{WORLD},{LIGHT},{FIT} SELECT n, round(gr, 6) AS gr, round(gg, 6) AS gg, round(gb, 6) AS gb FROM gains")
def flagship_calibration(spark, d):
    return sky.calibrate(sky_frame(spark, d), star_catalog(spark, d), SKY_PROJECTION, SKY_H, SKY_W).drop("frame_id")


APPLY = """
v2 AS (SELECT (r + g + b) / 3.0e0 AS v FROM px),
marks AS (SELECT quantile_cont(v, 0.95e0) AS p95 FROM v2),
w AS (
  SELECT px.*, gr, gg, gb, power(least(greatest(((r + g + b) / 3.0e0 - (med + 2 * sigma)) / greatest(p95 - (med + 2 * sigma), 1e-6), 0e0), 1e0), 2) AS w FROM px, gains, med, mad, marks)"""


@query("num_apply_gains", f"WITH {DETECT},{CATALOG},{WORLD},{LIGHT},{FIT},{APPLY} SELECT y, x, " + ", ".join(f"round({c} * (1 - w) + least(greatest({c} * (1 + 0.5e0 * (g{c} - 1)), 0e0), 1e0) * w, 6) + 0e0 AS {c}" for c in CHANNELS) + " FROM w")
def num_apply_gains(spark, d):
    px = sky_frame(spark, d)
    return channels(sky.apply_gains(px, sky.calibrate(px, star_catalog(spark, d), SKY_PROJECTION, SKY_H, SKY_W)))


# ------------------------------------------------------------------------------ jobs


def job_rows(spark, d):
    return jobs.jobs_of(table(spark, d, "events"))


@query("win_queue_position", f"WITH {JOBS} SELECT id, CASE WHEN status IN ('queued', 'running') THEN row_number() OVER (PARTITION BY status IN ('queued', 'running') ORDER BY created_at, id) ELSE 0 END AS position FROM jobs")
def win_queue_position(spark, d):
    return jobs.queue_positions(job_rows(spark, d))


@query("win_rolling_mean", f"WITH {JOBS} SELECT id, round(avg(seconds) OVER (ORDER BY terminated_at, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) + 0e0 AS mean_seconds FROM jobs WHERE status = 'done'")
def win_rolling_mean(spark, d):
    return jobs.rolling_seconds(job_rows(spark, d))


ETA = f"""WITH {JOBS}, m AS (SELECT coalesce(avg(seconds), 60e0) AS mean FROM (SELECT seconds FROM jobs WHERE status = 'done' ORDER BY terminated_at DESC, id DESC LIMIT 20)),
q AS (SELECT id, status, CASE WHEN status IN ('queued', 'running') THEN row_number() OVER (PARTITION BY status IN ('queued', 'running') ORDER BY created_at, id) ELSE 0 END AS position FROM jobs)
SELECT id, position, round(CASE status WHEN 'running' THEN greatest(mean, 0e0) WHEN 'queued' THEN ceil(greatest(position - 2, 0) / 2e0) * mean + mean END, 6) + 0e0 AS eta FROM q, m"""


@query("win_eta", ETA)
def win_eta(spark, d):
    return jobs.etas(job_rows(spark, d))


@query("agg_load_class", f"WITH {JOBS}, c AS (SELECT count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'running') AS running FROM jobs) SELECT *, CASE WHEN queued = 0 AND running = 0 THEN 'idle' WHEN queued = 0 THEN 'busy' ELSE 'backed_up' END AS load FROM c")
def agg_load_class(spark, d):
    return jobs.load_class(job_rows(spark, d))


@query("str_expired_jobs", f"WITH {JOBS}, n AS (SELECT max(created_at) AS now FROM jobs) SELECT id FROM jobs, n WHERE terminated_at + INTERVAL 3600 SECOND <= now")
def str_expired_jobs(spark, d):
    return jobs.expired(job_rows(spark, d))


# ------------------------------------------------------------------------------ headers and kinds


@query("src_header", "SELECT n_nationkey, CASE WHEN n_nationkey < 20 THEN CAST(2 * n_nationkey * 100 * 3 * 1000 AS BIGINT) END AS size, CASE n_regionkey WHEN 0 THEN 'BGGR' WHEN 1 THEN 'GRBG' ELSE 'RGGB' END AS pattern FROM nation")
def src_header(spark, d):
    """Headers made of nations: size is null where the number of axes is refused."""
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    said = {
        "BITPIX": F.lit("16 / bits"), "NAXIS": F.when(key < 20, F.lit("3")).otherwise(F.lit("5")), "NAXIS1": (key * 100).cast("string"), "NAXIS2": F.lit("1000"), "NAXIS3": F.lit("3"),
        "CFAPAT": F.when(region == 0, F.lit("'bggr'")).when(region == 1, F.lit("'GRBG  '")).otherwise(F.lit("'none'")),
    }
    header = F.concat(*(F.rpad(F.concat(F.lit(f"{k:<8}= "), v), headers.CARD, F.lit(" ")) for k, v in said.items()))
    values = table(spark, d, "nation").select("n_nationkey", headers.header_values(header).alias("v"))
    return values.select("n_nationkey", headers.declared_bytes(F.col("v")).alias("size"), headers.colour_pattern(F.col("v")).alias("pattern"))


@query("num_classify")
def num_classify(spark, d):
    return classify.classified(sky_frame(spark, d), SKY_H, SKY_W)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalog_images  # noqa: F401  registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
