"""Registered queries over images, files, several frames, catalogs and streams, and their SQL."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from .catalog import CATALOG, DETECT, FIT, GAUSS, HEAT, LIGHT, LUMA, RGB, SKY, SKY_PROJECTION, STRETCH, V, WORLD, channels, mirror_sql, pixel_sql, query, star_catalog
from .frames import CHANNELS, SKY_H, SKY_W, heat_frame, rounded, sky_frame, table
from .functions import kernels, pixels
from .images import array_of, on_images, to_images, to_pixels, with_kernel
from .operators import colour, jobs, neighbourhood, sky, stats
from .plans import profiles, runner
from .sinks import files
from .sources import catalogs, fits
from .storage import kept, shared_folder
from .streaming import jobs as streams

# ------------------------------------------------------------------------------ several frames

TINT = {"r": 0.9, "g": 1.0, "b": 1.1}


def two_frames(spark, d):
    """The sky, and the same sky in other colours; and each one's projection."""
    px = sky_frame(spark, d)
    px = px.unionByName(pixels.each(px, lambda v, c: v * TINT[c]).withColumn("frame_id", F.lit("sky2")))
    p = SKY_PROJECTION
    rows = [(name, p.ra0, p.dec0, p.x0, p.y0, *p.cd, SKY_H, SKY_W) for name in ("sky", "sky2")]
    return px, spark.createDataFrame(rows, "frame_id string, " + ", ".join(f"{c} double" for c in sky.PLACE) + ", h int, w int")


def tinted(sql: str) -> str:
    """SQL over the sky frame, over the second frame."""
    for c in CHANNELS:
        sql = sql.replace(f"greatest(base.{c}, coalesce(stamp.{c}, 0e0)) AS {c}", f"{TINT[c]}e0 * greatest(base.{c}, coalesce(stamp.{c}, 0e0)) AS {c}")
    return sql


def for_both(ctes: str, select: str) -> str:
    one = f"(WITH {ctes} SELECT 'sky' AS frame_id, {select})"
    return f"SELECT * FROM {one} UNION ALL SELECT * FROM {tinted(one).replace(chr(39) + 'sky' + chr(39), chr(39) + 'sky2' + chr(39))}"


@query("flagship_calibration_frames", for_both(f"{DETECT},{CATALOG},{WORLD},{LIGHT},{FIT}", "n, round(gr, 6) AS gr, round(gg, 6) AS gg, round(gb, 6) AS gb FROM gains"))
def flagship_calibration_frames(spark, d):
    px, where = two_frames(spark, d)
    return sky.calibrate(px, star_catalog(spark, d), where)


@query("join_nearest_frames", for_both(f"{DETECT},{CATALOG},{WORLD}", "star_id, src_id, round(sqrt(d2) * 3600, 4) + 0e0 AS sep FROM pairs"))
def join_nearest_frames(spark, d):
    px, where = two_frames(spark, d)
    stars = sky.pixel_to_world(neighbourhood.peaks(stats.luma_values(px), top=200), where)
    return rounded(sky.nearest(stars, sky.field_of_view(star_catalog(spark, d), where)).select("frame_id", "star_id", "src_id", "sep"), digits=4)


MEDIAN_TARGETS = FIT.replace("0.82e0", "(SELECT median(bp - rp) FROM light JOIN pairs USING (star_id) WHERE least(light.r, light.g, light.b) > 1e-5)")


@query("flagship_median_reference", f"WITH {DETECT},{CATALOG},{WORLD},{LIGHT},{MEDIAN_TARGETS} SELECT n, round(gr, 6) AS gr, round(gg, 6) AS gg, round(gb, 6) AS gb FROM gains")
def flagship_median_reference(spark, d):
    return sky.calibrate(sky_frame(spark, d), star_catalog(spark, d), SKY_PROJECTION, SKY_H, SKY_W, reference=None).drop("frame_id")


def _det(a: str, b: str, c: str) -> str:
    """The determinant of three columns of the symmetric products, by SQL."""
    return f"({a}r * ({b}g * {c}b - {b}b * {c}g) - {b}r * ({a}g * {c}b - {a}b * {c}g) + {c}r * ({a}g * {b}b - {a}b * {b}g))"


FULL = FIT[: FIT.index("g0 AS")] + "p AS (SELECT count(*) AS n, " + ", ".join(f"sum(m{a} * m{b}) AS {a}{b}" for a in CHANNELS for b in CHANNELS) + ", " + ", ".join(f"sum(m{a} * a{b} / (ar + ag + ab)) AS q{b}{a}" for a in CHANNELS for b in CHANNELS) + " FROM raw), c AS (SELECT n, " + ", ".join(f"{_det(*(('q' + t) if k == s else k for k in CHANNELS))} / {_det('r', 'g', 'b')} AS {t}_{s}" for t in CHANNELS for s in CHANNELS) + " FROM p)"
FULL_SELECT = "n, " + ", ".join(f"round({t}_{s} / ({' + '.join(f'{t}_{k}' for k in CHANNELS)}), 6) + 0e0 AS m{i}{j}" for i, t in enumerate(CHANNELS) for j, s in enumerate(CHANNELS)) + " FROM c"


@query("agg_colour_matrix", f"WITH {DETECT},{CATALOG},{WORLD},{LIGHT},{FULL} SELECT {FULL_SELECT}")
def agg_colour_matrix(spark, d):
    return sky.calibrate(sky_frame(spark, d), star_catalog(spark, d), SKY_PROJECTION, SKY_H, SKY_W, mode="full").drop("frame_id")


@query("sky_distortion", f"WITH {DETECT} SELECT star_id, round(CAST(x AS DOUBLE), 6) AS px, round(CAST(y AS DOUBLE), 6) AS py FROM det")
def sky_distortion(spark, d):
    """Detections to the sky and back through a distorted projection, parsed from a header."""
    said = {"CTYPE1": "RA---TAN-SIP", "CTYPE2": "DEC--TAN-SIP", "CRVAL1": "180", "CRVAL2": "0", "CRPIX1": "65", "CRPIX2": "49", "CD1_1": "-0.001", "CD1_2": "0", "CD2_1": "0", "CD2_2": "0.001", "A_2_0": "1e-5", "A_1_1": "2e-6", "B_0_2": "-1e-5", "B_2_0": "3e-6"}
    header = spark.createDataFrame([("sky", said)], "frame_id string, v map<string,string>")
    where = fits.parsed_wcs(header)
    stars = neighbourhood.peaks(stats.luma_values(sky_frame(spark, d)), top=200)
    return sky.world_to_pixel(sky.pixel_to_world(stars, where).drop("x", "y"), where).select("star_id", "px", "py")


# ------------------------------------------------------------------------------ colour, stretch, repair

SAMPLED = "SELECT count(*) FROM px WHERE {0}"


def _middle(name: str, source: str, inside: str) -> str:
    return f"{name} AS (SELECT " + ", ".join(f"median({c}) AS {c}" for c in CHANNELS) + f" FROM {source}, marks WHERE {inside})"


WB = f"""
mx AS (SELECT y, x, greatest(r * 0.92e0 - 0.05e0 * g + 0.13e0 * b, 0e0) AS r, greatest(-0.05e0 * r + 0.95e0 * g + 0.10e0 * b, 0e0) AS g, greatest(-0.02e0 * r - 0.03e0 * g + 1.05e0 * b, 0e0) AS b FROM px),
li AS (SELECT *, {LUMA} AS l FROM mx),
marks AS (SELECT quantile_cont(l, 0.25e0) AS dk, quantile_cont(l, 0.4e0) AS lo, quantile_cont(l, 0.8e0) AS hi, quantile_cont(l, 0.99e0) AS tp FROM li),
{_middle("ped", "li", "l <= dk")},
lw AS (SELECT y, x, l, greatest(li.r - ped.r, 0e0) AS r, greatest(li.g - ped.g, 0e0) AS g, greatest(li.b - ped.b, 0e0) AS b FROM li, ped),
{_middle("mid", "lw", "l >= lo AND l <= hi")},
wb AS (SELECT y, x, """ + ", ".join(f"lw.{c} * ((1 + 0.6e0 * (CASE WHEN mid.{c} > 1e-6 THEN (mid.r + mid.g + mid.b) / 3 / mid.{c} ELSE 1e0 END - 1)) * (1 - least(greatest((l - tp) / greatest(tp, 1e-6), 0e0), 1e0)) + least(greatest((l - tp) / greatest(tp, 1e-6), 0e0), 1e0)) AS {c}" for c in CHANNELS) + """ FROM lw, mid, marks),
sc AS (SELECT y, x, r, g * 0.15e0 + least(g, (r + b) / 2e0) * 0.85e0 AS g, b FROM wb)"""


@query("num_colour", pixel_sql(WB, {c: f"least(greatest({c}, 0e0), 1e0)" for c in CHANNELS}, "sc", SKY))
def num_colour(spark, d):
    return channels(colour.colour(sky_frame(spark, d), strength=0.6, green=0.85, trimmed=False, matrix="preset"))


@query("num_colour_trimmed")
def num_colour_trimmed(spark, d):
    return channels(colour.colour(sky_frame(spark, d), green=0.5))


def chroma_sql(frame: str, n: int, channel: str) -> str:
    """GAUSS over a channel's difference from luma, with names of its own."""
    body = GAUSS[GAUSS.index("k AS (SELECT d") :]
    for name in ("p1", "p2"):
        body = re.sub(rf"\b{name}\b", f"{name}{channel}", body)
    body = body.replace("FROM v a", f"FROM v{channel} a").replace("JOIN v ON", f"JOIN v{channel} v ON")
    kernel, rest = body[: body.index("p1")], body[body.index("p1") :]
    return (kernel if channel == "r" else "") + f"v{channel} AS (SELECT y, x, {channel} - {LUMA} AS v FROM px),\n" + rest


SMOOTH = ",\n".join(chroma_sql(HEAT, 32, c) for c in CHANNELS)


@query("nbr_chroma_smooth", f"WITH {HEAT}, {SMOOTH} SELECT px.y, px.x, " + ", ".join(f"round(least(greatest((px.r + px.g + px.b) / 3.0e0 + p2{c}.v, 0e0), 1e0), 6) + 0e0 AS {c}" for c in CHANNELS) + " FROM px " + " ".join(f"JOIN p2{c} ON p2{c}.y = px.y AND p2{c}.x = px.x" for c in CHANNELS))
def nbr_chroma_smooth(spark, d):
    return channels(colour.chroma_smooth(heat_frame(spark, d), 32, 32, 1.5))


AUTO = """
vv AS (SELECT (r + g + b) / 3.0e0 AS v FROM px),
fl AS (SELECT quantile_cont(v, 0.1e0) AS f FROM vv),
lo AS (SELECT v FROM vv, fl WHERE v <= f + 1e-6),
lm AS (SELECT median(v) AS m, count(*) AS n FROM lo),
kn AS (SELECT any_value(m) + 1.5e0 * 1.4826e0 * median(abs(v - m)) AS k, any_value(n) AS n FROM lo, lm),
bp AS (SELECT CASE WHEN any_value(n) < 16 THEN 0.1e0 ELSE avg(CASE WHEN v < k THEN 1e0 ELSE 0e0 END) * 100 END AS p FROM vv, kn),
pt AS (SELECT p / 100 AS s, (p / 100) * ((SELECT count(*) FROM vv) - 1) AS i FROM bp),
""" + ",\n".join(f"""od{c} AS (SELECT {e} AS v, row_number() OVER (ORDER BY {e}) - 1 AS k FROM px),
q{c} AS (SELECT min(v) + (max(v) - min(v)) * (any_value(i) - floor(any_value(i))) AS q FROM od{c}, pt WHERE k = floor(i) OR k = ceil(i))""" for c, e in (("l", LUMA), *((c, c) for c in CHANNELS))) + """,
fa AS (SELECT least(greatest(-12 * log10(greatest((SELECT quantile_cont(v, 0.999e0) FROM vv) - q, 1e-6) + 1e-6) - 10, 6e0), 30e0) AS f FROM ql),
dn AS (SELECT y, x, greatest(px.r - qr.q, 0e0) AS r, greatest(px.g - qg.q, 0e0) AS g, greatest(px.b - qb.q, 0e0) AS b FROM px, qr, qg, qb),
wh AS (SELECT greatest(quantile_cont((r + g + b) / 3.0e0, 0.999e0), 1e-6) AS w FROM dn),
au AS (SELECT y, x, """ + ", ".join(f"asinh(least({c} / w, 1e0) * f) / asinh(f) AS {c}" for c in CHANNELS) + " FROM dn, wh, fa)"


@query("map_auto_stretch", pixel_sql("fx AS (SELECT y, x, " + ", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in CHANNELS) + " FROM px)," + AUTO.replace("FROM px", "FROM fx").replace("px.", "fx."), {c: f"CAST(CAST({c} AS FLOAT) AS DOUBLE)" for c in CHANNELS}, "au", SKY))
def map_auto_stretch(spark, d):
    """Black percentile and factor derived from each frame, by the kernel on images."""
    return channels(to_pixels(with_kernel(sky_images(spark, d), kernels.stretch, black_percentile="auto", stretch="auto")))


def _repair(c: str) -> str:
    return f"""a{c} AS (SELECT a.y, a.x, any_value(a.{c}) AS v, median(n.{c}) AS m FROM px a, (SELECT unnest(range(-1, 2)) AS dy), (SELECT unnest(range(-1, 2)) AS dx), px n WHERE n.y = least(greatest(a.y + dy, 0), 31) AND n.x = least(greatest(a.x + dx, 0), 31) GROUP BY a.y, a.x),
b{c} AS (SELECT median(v - m) AS m0 FROM a{c}), d{c} AS (SELECT 2e0 * 1.4826e0 * median(abs(v - m - m0)) AS t FROM a{c}, b{c}),
e{c} AS (SELECT y, x, CASE WHEN t > 0 AND v - m > t THEN m ELSE v END AS {c} FROM a{c}, d{c})"""


@query("nbr_cosmetic", f"WITH {HEAT}, {', '.join(_repair(c) for c in CHANNELS)} SELECT y, x, round(r, 6) + 0e0 AS r, round(g, 6) + 0e0 AS g, round(b, 6) + 0e0 AS b FROM er JOIN eg USING (y, x) JOIN eb USING (y, x)")
def nbr_cosmetic(spark, d):
    return channels(colour.cosmetic(heat_frame(spark, d), 32, 32, 3, 2.0))


# ------------------------------------------------------------------------------ images and files

FLOAT = {c: f"CAST(CAST({c} AS FLOAT) AS DOUBLE)" for c in CHANNELS}


def heat_images(spark, d):
    return to_images(heat_frame(spark, d))


def sky_images(spark, d):
    return to_images(sky_frame(spark, d))


@query("src_images", pixel_sql("", FLOAT))
def src_images(spark, d):
    return channels(to_pixels(heat_images(spark, d)))


def decoded_levels(encoded, read):
    """y, x and the samples of encoded files."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                a = read(content.as_py()).astype(np.int32)
                y, x = (g.ravel().astype(np.int32) for g in np.indices(a.shape[:2]))
                yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(x), *(pa.array(np.ascontiguousarray(a[..., c].ravel())) for c in range(3))], ["y", "x", *CHANNELS])

    return encoded.select("content").mapInArrow(run, "y int, x int, r int, g int, b int")


LEVELS = "WITH " + HEAT + " SELECT y, x, " + ", ".join(f"CAST(round_even(least({FLOAT[c]}, 1e0) * 65535, 0) AS INTEGER) AS {c}" for c in CHANNELS) + " FROM px"


@query("snk_png", LEVELS)
def snk_png(spark, d):
    return decoded_levels(files.encoded(heat_images(spark, d), "png"), files.read_png)


@query("snk_tiff", LEVELS)
def snk_tiff(spark, d):
    return decoded_levels(files.encoded(heat_images(spark, d), "tiff"), files.read_tiff)


@query("src_fits", pixel_sql("f AS (SELECT y, x, " + ", ".join(f"{v} AS {c}" for c, v in FLOAT.items()) + " FROM px), t AS (SELECT greatest(max(r), max(g), max(b)) AS t FROM f)", {c: f"CAST(CAST({c} / t AS FLOAT) AS DOUBLE)" for c in CHANNELS}, "f, t"))
def src_fits(spark, d):
    """A frame as a FITS file, read again: floats come back over their greatest value."""
    written = files.encoded(heat_images(spark, d), "fits").withColumnRenamed("name", "path")
    return channels(to_pixels(fits.decoded_files(written)))


def thumbs(encoded):
    return decoded_levels(encoded, files.read_png)


@query("snk_thumbnail", "WITH " + HEAT + ", f AS (SELECT y, x, " + ", ".join(f"CAST(CAST({c} * 0.2e0 AS FLOAT) AS DOUBLE) AS {c}" for c in CHANNELS) + f" FROM px), q AS (SELECT quantile_cont({LUMA}, 0.05e0) AS lo, quantile_cont({LUMA}, 0.999e0) AS hi FROM f), n AS (SELECT y, x, " + ", ".join(f"ln(1 + 200 * least(greatest(({c} - lo) / greatest(hi - lo, 1e-6), 0e0), 1e0)) AS {c}" for c in CHANNELS) + " FROM f, q), t AS (SELECT greatest(max(r), max(g), max(b)) AS t FROM n) SELECT y, x, " + ", ".join(f"CAST(floor({c} / t * 255 + 1e-9) AS INTEGER) AS {c}" for c in CHANNELS) + " FROM n, t")
def snk_thumbnail(spark, d):
    dim = to_images(pixels.each(heat_frame(spark, d), lambda v, c: v * 0.2))
    return thumbs(files.thumbnails(dim))


LIFT = "f AS (SELECT y, x, " + ", ".join(f"{v} AS {c}" for c, v in FLOAT.items()) + f" FROM px), q AS (SELECT quantile_cont({LUMA}, 0.05e0) AS lo, quantile_cont({LUMA}, 0.999e0) AS hi FROM f), n AS (SELECT y, x, " + ", ".join(f"ln(1 + 200 * least(greatest(({c} - lo) / greatest(hi - lo, 1e-6), 0e0), 1e0)) AS {c}" for c in CHANNELS) + " FROM f, q), t AS (SELECT greatest(max(r), max(g), max(b)) AS t FROM n)"
BYTES = "SELECT y, x, " + ", ".join(f"CAST(floor({c} / t * 255 + 1e-9) AS INTEGER) AS {c}" for c in CHANNELS) + " FROM n, t"


@query("snk_before_preview", f"WITH {SKY}, {LIFT} {BYTES}")
def snk_before_preview(spark, d):
    return thumbs(files.before_previews(sky_images(spark, d)))


@query("snk_debug_preview", f"WITH {HEAT}, n AS (SELECT y, x, " + ", ".join(f"ln(1 + 1000 * greatest({v}, 0e0)) AS {c}" for c, v in FLOAT.items()) + f" FROM px), t AS (SELECT greatest(max(r), max(g), max(b)) AS t FROM n) {BYTES}")
def snk_debug_preview(spark, d):
    return thumbs(files._mapped(heat_images(spark, d), "png", lambda a: files.png(files.debug_preview(a))))


def mosaic_file(image: np.ndarray) -> bytes:
    """An image through an RGGB filter, as a raw file."""
    y, x = np.indices(image.shape[:2])
    return files.mosaic_fits(files.levels(np.take_along_axis(image, ((y % 2) + (x % 2))[..., None], 2)[..., 0]).astype(np.int64), BAYERPAT="RGGB")


def _taps(name: str, taps: np.ndarray) -> str:
    rows = ", ".join(f"({i - 2}, {j - 2}, {float(taps[i, j])!r}e0)" for i in range(5) for j in range(5) if taps[i, j])
    return f"{name} AS (SELECT m.y, m.x, sum(n.v * w) AS v FROM mo m, (VALUES {rows}) k(dy, dx, w), mo n WHERE n.y = 31 - abs(31 - abs(m.y + dy)) AND n.x = 31 - abs(31 - abs(m.x + dx)) GROUP BY m.y, m.x)"


MOSAIC = ", ".join([
    f"""mo AS (SELECT y, x, round_even(least(CASE WHEN y % 2 + x % 2 = 0 THEN {FLOAT['r']} WHEN y % 2 + x % 2 = 2 THEN {FLOAT['b']} ELSE {FLOAT['g']} END, 1e0) * 65535, 0) / 65535e0 AS v FROM px)""",
    _taps("gn", kernels.GREEN), _taps("al", kernels.ALONG), _taps("ac", kernels.ACROSS), _taps("co", kernels.CORNER),
    """de AS (SELECT y, x, CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN mo.v WHEN y % 2 = 1 AND x % 2 = 1 THEN co.v WHEN y % 2 = 0 THEN al.v ELSE ac.v END AS r,
      CASE WHEN (y + x) % 2 = 1 THEN mo.v ELSE gn.v END AS g,
      CASE WHEN y % 2 = 1 AND x % 2 = 1 THEN mo.v WHEN y % 2 = 0 AND x % 2 = 0 THEN co.v WHEN y % 2 = 1 THEN al.v ELSE ac.v END AS b
      FROM mo JOIN gn USING (y, x) JOIN al USING (y, x) JOIN ac USING (y, x) JOIN co USING (y, x))""",
])


@query("num_demosaic", f"WITH {HEAT}, {MOSAIC} SELECT y, x, " + ", ".join(f"round(CAST(CAST(least(greatest({c}, 0e0), 1e0) AS FLOAT) AS DOUBLE), 5) + 0e0 AS {c}" for c in CHANNELS) + " FROM de")
def num_demosaic(spark, d):
    """Raw 16-bit mosaics, decoded and interpolated."""
    raw = files._mapped(heat_images(spark, d), "fits", mosaic_file).withColumnRenamed("name", "path")
    return rounded(channels(to_pixels(fits.decoded_files(raw))), digits=5)


WIDE = GAUSS.replace("/ 1.5e0", "/ 20e0").replace("range(-6, 7)", "range(-80, 81)").replace(f"{LUMA} AS v", "CAST(CAST(r AS FLOAT) AS DOUBLE) AS v")


@query("nbr_gaussian_wide", WIDE + " SELECT y, x, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 5) + 0e0 AS v FROM p2")
def nbr_gaussian_wide(spark, d):
    """A blur wider than the frame, by the kernel on images."""
    out = to_pixels(with_kernel(heat_images(spark, d), kernels.blur_each, sigma=20.0))
    return rounded(out.select("y", "x", F.col("r").alias("v")), digits=5)


@query("nbr_starless", f"WITH {HEAT}, o AS (SELECT dy, dx FROM (SELECT unnest(range(-7, 8)) AS dy), (SELECT unnest(range(-7, 8)) AS dx)), a AS (SELECT px.y, px.x, {mirror_sql('px.y + dy', 32)} AS ny, {mirror_sql('px.x + dx', 32)} AS nx FROM px, o) SELECT a.y, a.x, " + ", ".join(f"round(least(median(CAST(CAST(px.{c} AS FLOAT) AS DOUBLE)), 1e0), 6) + 0e0 AS {c}" for c in CHANNELS) + " FROM a JOIN px ON px.y = a.ny AND px.x = a.nx GROUP BY a.y, a.x")
def nbr_starless(spark, d):
    return channels(to_pixels(with_kernel(heat_images(spark, d), lambda a: kernels.split_stars(a, 7)[1])))


STAGES = {
    "num_background": lambda a: kernels.background(a), "num_deconvolution": lambda a: kernels.deconvolve(a), "num_denoise": lambda a: kernels.denoise(a), "num_denoise_half": lambda a: kernels.denoise(a, downsample_factor=2),
    "nbr_clahe": lambda a: kernels.clahe(a, kernel_size=32), "nbr_chroma_edges": lambda a: kernels.chroma_smooth_off_edges(a, 4.0),
}
for _name, _kernel in STAGES.items():
    query(_name)(lambda spark, d, k=_kernel: channels(to_pixels(with_kernel(sky_images(spark, d), k))))


@query("agg_ssim")
def agg_ssim(spark, d):
    """The likeness of the sky to itself stretched, as 8-bit pictures."""
    import pandas as pd

    pairs = sky_images(spark, d)

    def score(frames):
        for f in frames:
            a = [array_of(h, w, x) for h, w, x in zip(f["h"], f["w"], f["data"])]
            yield pd.DataFrame({"frame_id": f["frame_id"], "ssim": [kernels.ssim(np.rint(x * 255), np.rint(kernels.stretch(x) * 255)) for x in a]})

    return pairs.select("frame_id", "h", "w", "data").mapInPandas(score, "frame_id string, ssim double")


# ------------------------------------------------------------------------------ the runner


@query("run_profile", f"WITH {SKY}, b AS (SELECT 1) SELECT 'sky' AS frame_id, CAST(96 AS INTEGER) AS h, CAST(128 AS INTEGER) AS w, 'background,color,stretch,bm3d_denoise,sharpen,curves' AS stages, CAST(NULL AS VARCHAR) AS error")
def run_profile(spark, d):
    out = runner.run(sky_images(spark, d), "default")
    return out.select("frame_id", "h", "w", F.concat_ws(",", "done").alias("stages"), "error")


CHAIN = STRETCH.replace("FROM px", "FROM fl").replace("px.", "fl.").replace("0.001e0", "0.002e0").replace("0.999e0", "0.9997e0").replace("25e0", "11e0")


@query("run_stretch_only", pixel_sql("fl AS (SELECT y, x, " + ", ".join(f"{v} AS {c}" for c, v in FLOAT.items()) + " FROM px)," + CHAIN, FLOAT, "st", SKY))
def run_stretch_only(spark, d):
    """One stage of a profile through the runner's machinery."""
    work = runner.applied(("stretch",), {"cluster": profiles.profile("cluster")}, runner.KERNELS, None)
    labelled = sky_images(spark, d).withColumn("label", F.lit("cluster"))
    return channels(to_pixels(on_images(labelled, work, extra=("label",))))


@query("ctl_profiles")
def ctl_profiles(spark, d):
    return spark.createDataFrame(profiles.rows(), "profile string, stage string, setting string, value string")


# ------------------------------------------------------------------------------ catalogs

STARS = "WITH c AS (SELECT o_orderkey AS src_id, (o_orderkey * 137.508e0) % 360 AS ra, CAST((o_orderkey * 73) % 180 - 90 AS DOUBLE) AS dec, 6 + (o_orderkey % 100) / 10.0e0 AS g, CASE WHEN o_orderkey % 7 <> 0 THEN 6.3e0 END AS bp, 5.9e0 AS rp FROM orders)"


def orders_catalog(spark, d):
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        key.cast("long").alias("src_id"), ((key * 137.508) % 360).alias("RA_ICRS"), ((key * 73) % 180 - 90).cast("double").alias("DE_ICRS"), (6 + (key % 100) / 10.0).alias("Gmag"),
        F.when(key % 7 != 0, 6.3).alias("BPmag"), F.lit(5.9).alias("RPmag"),
    )


@query("src_catalog_bands", f"{STARS} SELECT src_id, round(ra, 6) + 0e0 AS ra, round(dec, 6) + 0e0 AS dec FROM c WHERE g < 12 AND bp IS NOT NULL AND rp IS NOT NULL")
def src_catalog_bands(spark, d):
    """A mirror's table, renamed, filtered and read in four bands."""
    return catalogs.in_bands(catalogs.renamed(orders_catalog(spark, d)), 12.0).select("src_id", "ra", "dec")


@query("snk_catalog", f"{STARS} SELECT CAST(floor(dec) AS INTEGER) AS zone, count(*) AS n, round(sum(CAST(CAST(g AS FLOAT) AS DOUBLE)), 4) AS g FROM c GROUP BY 1")
def snk_catalog(spark, d):
    path = f"{shared_folder(spark)}/catalog-{d.rstrip('/').rsplit('/', 1)[-1]}"
    files.write_catalog(catalogs.renamed(orders_catalog(spark, d)), path)
    back = catalogs.read_catalog(spark, path)
    return rounded(back.groupBy(F.floor("dec").cast("int").alias("zone")).agg(F.count("*").alias("n"), F.sum("phot_g_mean_mag").alias("g")), digits=4)


@query("src_upload", "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'suffix' WHEN n_nationkey % 7 = 0 THEN 'size' WHEN n_regionkey = 2 THEN 'format' END AS refused FROM nation")
def src_upload(spark, d):
    key = F.col("n_nationkey")
    made = table(spark, d, "nation").select("n_nationkey", F.when(key % 5 == 0, "a/b.txt").otherwise("a/b.FITS").alias("path"), F.when(key % 7 == 0, fits.MAX_UPLOAD + 1).otherwise(2880).cast("long").alias("length"), F.when(F.col("n_regionkey") == 2, "GIF89a").otherwise("SIMPLE  =                    T").cast("binary").alias("content"))
    return fits.accepted(made).select("n_nationkey", "refused")


# ------------------------------------------------------------------------------ stages and streams

NAMES = ("curves", "load", "zebra", "stretch", "background", "apple", "export", "color")


def seen_stages(spark, d):
    key = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", F.filter(F.array(*map(F.lit, NAMES)), lambda s, i: (key + i) % 3 != 0).alias("stages"))


def _place(order) -> str:
    return "CASE s " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(order)) + f" ELSE {len(order)} END"


SEEN = "WITH s AS (SELECT n_nationkey, unnest([" + ", ".join(f"'{n}'" for n in NAMES) + "]) AS s, unnest(range(8)) AS i FROM nation)"


@query("top_stage_order", f"{SEEN} SELECT n_nationkey, string_agg(s, ',' ORDER BY {_place(runner.ORDER)}, s) AS stages FROM s WHERE (n_nationkey + i) % 3 <> 0 GROUP BY 1")
def top_stage_order(spark, d):
    return jobs.ordered_stages(seen_stages(spark, d), runner.ORDER).select("n_nationkey", F.concat_ws(",", "stages").alias("stages"))


@query("set_unknown_stages", f"{SEEN} SELECT n_nationkey, coalesce(string_agg(s, ',' ORDER BY s) FILTER (WHERE {_place(runner.ORDER)} = {len(runner.ORDER)}), '') AS unknown FROM s WHERE (n_nationkey + i) % 3 <> 0 GROUP BY 1")
def set_unknown_stages(spark, d):
    return jobs.unknown_stages(seen_stages(spark, d), runner.ORDER).select("n_nationkey", F.concat_ws(",", "unknown").alias("unknown"))


def event_states(events):
    return jobs.jobs_of(events).select((F.col("id") % 500).alias("id"), "status", F.col("created_at").cast("timestamp").alias("ts"))


def streamed(spark, d, shape, mode: str):
    """`shape` over the event log as a stream that ends; the table that it leaves in the shared folder."""
    import uuid

    source = table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/event[s].parquet")
    target = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch, number):
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{target}/out")

    shape(event_states(stream)).writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{target}/out")


STATES = "WITH e AS (SELECT event_id % 500 AS id, ts, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'queued' WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' END AS status FROM events), k AS (SELECT *, CASE status WHEN 'queued' THEN 0 WHEN 'running' THEN 1 ELSE 2 END AS rank FROM e WHERE status IS NOT NULL)"


@query("str_job_states", f"{STATES} SELECT id, status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank DESC, ts DESC, status DESC) AS n FROM k) WHERE n = 1")
def str_job_states(spark, d):
    return streamed(spark, d, streams.latest_state, "complete").select("id", "status")


@query("str_in_flight", f"{STATES} SELECT CAST(sum(CASE WHEN status = 'queued' THEN 1 WHEN status IN ('done', 'error') THEN -1 ELSE 0 END) AS BIGINT) AS in_flight FROM e")
def str_in_flight(spark, d):
    return streamed(spark, d, streams.in_flight, "complete").select("in_flight")


@query("str_progress", f"{STATES} SELECT id, max(ts) AS ts FROM e GROUP BY 1")
def str_progress(spark, d):
    shape = lambda e: streams.progress(e.withColumns({"stage": F.lit("load"), "fraction": F.lit(0.5)}))
    return streamed(spark, d, shape, "complete").select("id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("str_expiring")
def str_expiring(spark, d):
    return streamed(spark, d, streams.expiring, "append").select("id", "expires")


@query("run_auto")
def run_auto(spark, d):
    """Frames classified, each run under the profile of its kind."""
    out = kept(runner.run(sky_images(spark, d), "auto", ["bm3d_denoise.chroma_blur=2"]), "auto")
    return out.select("frame_id", "h", "w", F.concat_ws(",", "done").alias("stages"), "error")
