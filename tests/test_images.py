"""Kernels, files, coordinates, the runner and streams against plain numpy and small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.functions import kernels, pixels
from nightloom.images import array_of, bytes_of, on_images, to_images, to_pixels, with_kernel
from nightloom.operators import colour, sky
from nightloom.plans import profiles, runner
from nightloom.sinks import files
from nightloom.sources import catalogs, fits
from nightloom.storage import kept
from nightloom.streaming import jobs as streams

RNG = np.random.default_rng(5)


def scene(h=48, w=64, seed=5):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    blob = np.exp(-((y - h / 2) ** 2 + (x - w / 2) ** 2) / 200)[..., None] * [0.3, 0.2, 0.25]
    out = 0.05 + 0.1 * (x / w)[..., None] + blob + rng.normal(0, 0.01, (h, w, 3))
    out.reshape(-1, 3)[rng.choice(h * w, 25, replace=False)] = 1.0
    return np.clip(out, 0, 1)


def pixel_rows(spark, image, name="a"):
    y, x = (g.ravel().tolist() for g in np.indices(image.shape[:2]))
    flat = image.reshape(-1, 3).tolist()
    return spark.createDataFrame([(name, a, b, *v) for a, b, v in zip(y, x, flat)], "frame_id string, y int, x int, r double, g double, b double")


def image_rows(spark, *images):
    rows = [(f"f{i}", a.shape[0], a.shape[1], bytearray(bytes_of(a)), {}, [], None) for i, a in enumerate(images)]
    return spark.createDataFrame(rows, "frame_id string, h int, w int, data binary, header map<string,string>, done array<string>, error string")


def arrays(images):
    return {r["frame_id"]: array_of(r["h"], r["w"], bytes(r["data"])) for r in images.collect()}


# ------------------------------------------------------------------------------ kernels


def mirrored(i, n):
    i %= 2 * n
    return min(i, 2 * n - 1 - i)


@pytest.mark.parametrize("sigma", [0.7, 2.0, 9.0])
def test_blur(sigma):
    """Any width, also beyond the plane, against the sum over reflected neighbours."""
    a = RNG.random((7, 11))
    radius = int(4 * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    taps /= taps.sum()
    rows = sum(t * a[[mirrored(i + k, 7) for i in range(7)]] for k, t in zip(range(-radius, radius + 1), taps))
    both = sum(t * rows[:, [mirrored(i + k, 11) for i in range(11)]] for k, t in zip(range(-radius, radius + 1), taps))
    assert np.allclose(kernels.blur(a, sigma), both)


def test_medians():
    a = RNG.random((9, 12))
    for radius, edge, place in ((1, "edge", lambda i, n: min(max(i, 0), n - 1)), (3, "symmetric", mirrored)):
        wanted = [[np.median([a[place(y + i, 9), place(x + j, 12)] for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)]) for x in range(12)] for y in range(9)]
        assert np.allclose(kernels.median_square(a, radius, edge), wanted)


@pytest.mark.parametrize("value", [0.0, 0.5, 1.0])
def test_constant_frames_stay(value):
    a = np.full((48, 64, 3), value)
    for kernel in (kernels.background, kernels.denoise, kernels.clahe, kernels.cosmetic, kernels.sharpen, lambda x: kernels.chroma_smooth(x, 5), lambda x: kernels.chroma_smooth_off_edges(x, 5)):
        assert np.allclose(kernel(a), a, atol=1e-6)


def test_every_kernel_keeps_shape_and_range():
    a = scene()
    for kernel in (kernels.background, kernels.colour, kernels.stretch, kernels.curves, kernels.denoise, kernels.sharpen, kernels.clahe, kernels.deconvolve, kernels.cosmetic, lambda x: kernels.split_stars(x)[0]):
        out = kernel(a)
        assert out.shape == a.shape and np.isfinite(out).all() and out.min() >= 0 and out.max() <= 1


def test_background_takes_a_slope_off():
    y, x = np.mgrid[:96, :128]
    slope = (0.1 + 0.2 * x / 128 + 0.1 * (y / 96) ** 2)[..., None] * np.ones(3)
    out = kernels.background(slope + RNG.normal(0, 0.002, slope.shape))
    assert np.ptp(kernels.blur(out[..., 0], 4)) < 0.02
    of = kernels.thin_plate(np.array([[0.0, 0], [0, 10], [10, 0], [10, 10], [5, 5]]), np.array([0.0, 1, 2, 3, 1.5]), 0.0)
    assert np.allclose(of(np.array([[0.0, 0], [10, 10], [2, 7]])), [0, 3, 0.4 + 0.7])
    with pytest.raises(ValueError):
        kernels.background(slope, sky_mask=np.ones((2, 2), bool))


def test_denoise_lowers_noise_and_keeps_edges():
    y, x = np.mgrid[:96, :96]
    clean = (0.2 + 0.6 * ((x // 16 + y // 16) % 2))[..., None] * np.ones(3)
    noisy = np.clip(clean + RNG.normal(0, 0.05, clean.shape), 0, 1)
    out = kernels.denoise(noisy, sigma=0.05)
    assert ((out - clean) ** 2).mean() < 0.1 * ((noisy - clean) ** 2).mean()
    # an isolated tile gives what a large frame gives there
    wide = np.tile(noisy, (4, 4, 1))
    assert np.abs(kernels.denoise(wide, sigma=0.05)[:96, :96] - kernels.denoise(wide[:200, :200], sigma=0.05)[:96, :96]).max() < 0.1
    assert kernels.noise(np.full((64, 64, 3), 0.1) + RNG.normal(0, 0.02, (64, 64, 3))) == pytest.approx(0.02 / np.sqrt(3) * np.sqrt(20 / 8), rel=0.15)


def test_deconvolution_sharpens_a_blurred_point():
    a = np.zeros((64, 64, 3))
    a[32, 32] = 1
    soft = kernels.blur_each(a, 2.0)
    assert kernels.deconvolve(soft, psf_sigma=2.0, iterations=15).max() > 2 * soft.max()
    with pytest.raises(ValueError):
        kernels.deconvolve(a, iterations=0)


def test_chroma_stays_at_edges():
    a = np.zeros((64, 64, 3))
    a[:, :32], a[:, 32:] = (0.8, 0.1, 0.1), (0.05, 0.05, 0.4)
    plain, kept = kernels.chroma_smooth(a, 6), kernels.chroma_smooth_off_edges(a, 6, 0.005)
    assert np.abs(kept[:, 28:36] - a[:, 28:36]).mean() < 0.5 * np.abs(plain[:, 28:36] - a[:, 28:36]).mean()


def test_stars_split_and_come_back():
    a = scene(64, 64)
    stars, starless = kernels.split_stars(a, 3)
    assert starless.max() < 0.6 and stars.max() > 0.5
    assert np.abs(kernels.screen(stars, starless) - a).mean() < 0.03
    with pytest.raises(ValueError):
        kernels.screen(a, a[:5])


def test_clahe_raises_local_contrast():
    a = np.clip(0.4 + RNG.normal(0, 0.02, (64, 64, 1)) * np.ones(3), 0, 1)
    assert kernels.clahe(a, kernel_size=32).std() > 2 * a.std()
    with pytest.raises(ValueError):
        kernels.clahe(a, blend=1.5)


def test_resize_and_likeness():
    a = scene(96, 96)
    small = kernels.resize(a, 48, 48)
    assert small.shape == (48, 48, 3) and abs(small.mean() - a.mean()) < 0.01
    p = np.rint(a * 255)
    assert kernels.ssim(p, p) == pytest.approx(1) and kernels.ssim(p, np.rint(RNG.random(a.shape) * 255)) < 0.2


def test_demosaic_of_a_grey_slope_is_exact():
    y, x = np.mgrid[:20, :24]
    plane = 0.1 + 0.01 * x + 0.02 * y
    for pattern in ("RGGB", "BGGR", "GRBG", "GBRG"):
        out = kernels.demosaic(plane, pattern)
        assert np.allclose(out[3:-3, 3:-3], plane[3:-3, 3:-3, None])


# ------------------------------------------------------------------------------ both forms agree


def test_pixel_and_image_forms_agree(spark):
    a = scene(24, 32).astype(np.float32).astype(float)
    px = pixel_rows(spark, a)
    pairs = [
        (colour.colour(px, green=0.5, protect=99), kernels.colour(a, green_clip=0.5)),
        (colour.colour(px, 24, 32, highpass=2.0, lowpass=1.0, trimmed=False, protect=None), kernels.colour(a, pre_stretch_chroma_smooth=2.0, pre_stretch_chroma_lowpass=1.0, mahalanobis_wb=False, star_protect_percentile=None)),
        (colour.cosmetic(px, 24, 32), kernels.cosmetic(a)),
        (pixels.stretch(px), kernels.stretch(a)),
        (pixels.curves(px, gains=(1.4, 0.95, 0.75), mode="hsv"), kernels.curves(a, channel_gains=(1.4, 0.95, 0.75), saturation_mode="hsv")),
        (pixels.curves(px, gains=(1.1, 1.0, 0.9), preserve=None), kernels.curves(a, channel_gains=(1.1, 1.0, 0.9), star_preserve_percentile=None)),
    ]
    for df, wanted in pairs:
        got = np.zeros(a.shape)
        for r in df.collect():
            got[r["y"], r["x"]] = r["r"], r["g"], r["b"]
        assert np.abs(got - wanted).max() < 1e-6


def test_shapes_must_agree(spark):
    px = pixel_rows(spark, scene(6, 8))
    for bad in (pixels.dark_subtract(px, px.where("y < 5")), pixels.screen_blend(px, px.where("x > 0"))):
        with pytest.raises(Exception, match="differ in shape"):
            bad.collect()


# ------------------------------------------------------------------------------ files


def test_files_round_trip(spark, tmp_path):
    a = scene(10, 14).astype(np.float32).astype(float)
    frames = image_rows(spark, a, a[:, ::-1])
    for kind, read in (("png", files.read_png), ("tiff", files.read_tiff)):
        files.write_files(files.encoded(frames, kind), str(tmp_path / kind))
        assert (read((tmp_path / kind / f"f1.{kind}").read_bytes()) == files.levels(a[:, ::-1])).all()
    files.write_files(files.encoded(frames, "fits"), str(tmp_path / "fits"))
    back = arrays(fits.read_fits(spark, str(tmp_path / "fits")))
    assert np.allclose(back["f0"], np.float32(a / a.max()))
    assert not list(tmp_path.glob("*/.f*"))
    with pytest.raises(ValueError):
        files.encoded(frames, "gif")


def test_kinds_of_files(spark):
    mono = RNG.integers(2000, 32000, (16, 24))
    raw = files.mosaic_fits(mono, BAYERPAT="GBRG")
    cube = files.fits(scene(8, 6))
    empty = b"".join([files.card("SIMPLE", True), files.card("BITPIX", 8), files.card("NAXIS", 0), b"END".ljust(80)]).ljust(2880)
    extension = b"".join([files.card("XTENSION", "IMAGE"), *(files.card(k, v) for k, v in (("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 4), ("NAXIS2", 4))), b"END".ljust(80)]).ljust(2880) + bytes(range(16)).ljust(2880, b"\0")
    huge = b"".join([files.card("SIMPLE", True), files.card("BITPIX", 16), files.card("NAXIS", 2), files.card("NAXIS1", 90000), files.card("NAXIS2", 90000), b"END".ljust(80)]).ljust(2880)
    plane = b"".join([files.card("SIMPLE", True), files.card("BITPIX", 8), *(files.card(k, v) for k, v in (("NAXIS", 3), ("NAXIS1", 5), ("NAXIS2", 4), ("NAXIS3", 2))), b"END".ljust(80)]).ljust(2880) + bytes(32).ljust(2880, b"\0")
    made = {"raw.fits": raw, "cube.fits": cube, "ext.fits": empty + extension, "none.fits": empty, "huge.fits": huge, "cut.fits": cube[:3000], "junk.fits": b"x" * 100, "plane.fits": plane, "long.fits": b" " * 2880 * 6}
    got = {r["frame_id"]: r for r in fits.decoded_files(spark.createDataFrame([(f"/tmp/up/{k}", bytearray(v)) for k, v in made.items()], "path string, content binary")).collect()}
    assert np.allclose(array_of(16, 24, bytes(got["raw"]["data"])), kernels.demosaic(mono / 65535, "GBRG"), atol=1e-6)
    assert (got["cube"]["h"], got["cube"]["w"]) == (8, 6) and got["cube"]["header"]["BUNIT"] == "normalized"
    assert got["ext"]["error"] is None and got["ext"]["h"] == 4
    assert {k for k, r in got.items() if r["error"]} == {"none", "huge", "cut", "junk", "plane", "long"}
    assert all("/" not in r["error"] for r in got.values() if r["error"])


def test_uploads(spark):
    rows = [("a.fits", 10, b"SIMPLE  = T"), ("a.png", 10, b"SIMPLE  = T"), ("b.FIT", fits.MAX_UPLOAD + 1, b"SIMPLE  = T"), ("c.fts", 10, b"simple")]
    got = fits.accepted(spark.createDataFrame([(p, n, bytearray(c)) for p, n, c in rows], "path string, length long, content binary"))
    assert [r["refused"] for r in got.collect()] == [None, "suffix", "size", "format"]


def test_thumbnails():
    dim, lit = scene(20, 30) * 0.1, scene(20, 30)
    assert files.thumbnail(dim).max() == 255 and (files.thumbnail(lit) == (lit * 255).astype("u1")).all()
    assert files.thumbnail(np.zeros((900, 1200, 3))).shape == (300, 400, 3)
    assert files.debug_preview(lit).max() == 255


def test_coordinates(spark):
    base = {"CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN", "CRVAL1": "83.6", "CRVAL2": "22.0", "CRPIX1": "51", "CRPIX2": "41"}
    heads = {"cd": {**base, "CD1_1": "-0.001", "CD1_2": "0.0002", "CD2_1": "0.0002", "CD2_2": "0.001"}, "cdelt": {**base, "CDELT1": "-0.001", "CDELT2": "0.001"}, "zero": {**base, "CD1_1": "0", "CD2_2": "0"}, "flat": {**base, "CDELT1": "0", "CDELT2": "0"}, "bad": {**base, "CRVAL1": "east"}, "none": {}}
    heads["sip"] = {**heads["cd"], "A_2_0": "1e-5", "A_0_2": "-2e-5", "B_1_1": "3e-5"}
    where = fits.parsed_wcs(spark.createDataFrame(list(heads.items()), "frame_id string, v map<string,string>"))
    assert {r["frame_id"] for r in where.collect()} == {"cd", "cdelt", "sip"}
    points = spark.createDataFrame([(f, x, y) for f in ("cd", "cdelt", "sip") for x, y in ((0.0, 0.0), (50.0, 40.0), (99.0, 10.0))], "frame_id string, x double, y double")
    back = sky.world_to_pixel(sky.pixel_to_world(points, where), where)
    assert all(abs(r["px"] - r["x"]) < 1e-6 and abs(r["py"] - r["y"]) < 1e-6 for r in back.collect())
    middle = sky.pixel_to_world(points.where("x = 50"), where).collect()
    assert all(r["ra"] == pytest.approx(83.6) and r["dec"] == pytest.approx(22.0) for r in middle)


def test_catalogs(spark, tmp_path):
    rows = spark.createDataFrame([(float(i), i % 90 - 45.0, 5.0 + i % 10, None if i % 4 == 0 else 6.0, 5.5) for i in range(360)], "RA_ICRS double, DE_ICRS double, Gmag double, BPmag double, RPmag double")
    named = catalogs.renamed(rows)
    assert catalogs.in_bands(named, 12.0).count() == named.where("phot_g_mean_mag < 12 and phot_bp_mean_mag is not null").count()
    path = str(tmp_path / "stars")
    assert not catalogs.catalog_exists(spark, path)
    files.write_catalog(named, path)
    assert catalogs.catalog_exists(spark, path) and catalogs.read_catalog(spark, path).count() == 360

    def fails():
        raise OSError("away")

    assert catalogs.first_of(fails, lambda: rows.limit(0), lambda: rows).count() == 360
    with pytest.raises(OSError):
        catalogs.first_of(lambda: rows.limit(0), fails)


# ------------------------------------------------------------------------------ runner and streams


def test_runner(spark):
    a = scene(64, 80)
    broken = image_rows(spark, a, a[:32, :40], a).withColumn("error", F.when(F.col("frame_id") == "f2", "was refused"))
    out = runner.run(broken, "nebula", ["bm3d_denoise.chroma_blur=3", "stars.radius=2", "clahe.kernel_size=32"], dark=np.full(a.shape, 0.01))
    rows = {r["frame_id"]: r for r in out.collect()}
    assert rows["f0"]["done"] == ["dark_subtract", "cosmetic", "background", "color", "stretch", "stars", "bm3d_denoise", "sharpen", "clahe", "curves", "recombine"]
    assert (rows["f0"]["h"], rows["f0"]["w"]) == (64, 80) and rows["f2"]["error"] == "was refused"
    assert "shape" in rows["f1"]["error"] and rows["f1"]["data"] is None
    with pytest.raises(ValueError):
        runner.run(broken, "default", ["nonsense.x=1"])


def test_stages_of_a_profile_are_the_kernels(spark):
    a = scene(40, 48)
    got = arrays(runner.run(image_rows(spark, a), {"bm3d_denoise": {"sigma": 1e-4}, "stretch": {"stretch": 20}}))["f0"]
    wanted = a.astype(np.float32).astype(float)
    for kernel in (kernels.background,):
        wanted = kernel(wanted)
    wanted = wanted.astype(np.float32).astype(float)
    for kernel in (kernels.colour, lambda x: kernels.stretch(x, stretch=20), lambda x: kernels.denoise(x, sigma=1e-4), kernels.sharpen, kernels.curves):
        wanted = kernel(wanted)
    assert np.abs(got - wanted).max() < 1e-6


def test_calibration_within_the_runner(spark):
    """Two frames with stars of known colour, one of them tinted: each gets its own gains."""
    h, w, rng = 120, 160, np.random.default_rng(3)
    stars = [(12 + 16 * (i // 9), 12 + 16 * (i % 9), (i % 5 - 2) / 2) for i in range(54)]
    base = np.clip(rng.normal(0.03, 0.001, (h, w, 3)), 0, 1)
    for y, x, t in stars:
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                base[y + dy, x + dx] += max(0, 1 - 0.25 * (abs(dy) + abs(dx))) * 0.5 * np.array([1 + 0.24 * t, 1, 1 - 0.24 * t])
    head = {"CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN", "CRVAL1": "180", "CRVAL2": "0", "CRPIX1": "81", "CRPIX2": "61", "CD1_1": "-0.001", "CD1_2": "0", "CD2_1": "0", "CD2_2": "0.001"}
    frames = image_rows(spark, base, base * [0.9, 1.0, 1.1], base).withColumn("header", F.when(F.col("frame_id") != "f2", F.create_map(*(F.lit(x) for kv in head.items() for x in kv))).otherwise(F.create_map().cast("map<string,string>")))
    rows = [(i, 180 - (x - 80) * 0.001, (y - 60) * 0.001, 10.0, 10.41 + 0.5 * t, 9.59 - 0.5 * t) for i, (y, x, t) in enumerate(stars)]
    catalog = spark.createDataFrame(rows, "src_id long, ra double, dec double, phot_g_mean_mag double, phot_bp_mean_mag double, phot_rp_mean_mag double")
    where = fits.projections(frames).join(frames.select("frame_id", "h", "w"), "frame_id")
    fit = kept(sky.calibrate(to_pixels(frames), catalog, where), "gains")
    got = {r["frame_id"]: r for r in fit.collect()}
    assert got["f0"]["n"] == got["f1"]["n"] == 54 and got["f2"]["n"] == 0
    gains = {k: (r["gr"], r["gg"], r["gb"]) for k, r in got.items()}
    assert gains["f0"] == pytest.approx((1, 1, 1), abs=0.03) and gains["f2"] == (1, 1, 1)
    assert gains["f1"][0] / gains["f0"][0] == pytest.approx(1 / 0.9, rel=0.03) and gains["f1"][2] / gains["f0"][2] == pytest.approx(1 / 1.1, rel=0.03)
    settings = {"spcc": {"strength": 1.0, "luma_weighted": False}, "bm3d_denoise": {"sigma": 1e-4}}
    done = {r["frame_id"]: r["done"] for r in runner.run(frames, settings, catalog=catalog).collect()}
    assert "spcc" in done["f0"] and "spcc" in done["f1"] and "spcc" not in done["f2"]
    # the fitted gains on pixels and on images
    px = to_pixels(frames.where("frame_id = 'f1'"))
    wide = sky.apply_gains(px, fit, 0.8)
    image = np.zeros((h, w, 3))
    for r in wide.collect():
        image[r["y"], r["x"]] = r["r"], r["g"], r["b"]
    g = got["f1"]
    assert np.abs(image - kernels.recolour((base * [0.9, 1.0, 1.1]).astype(np.float32).astype(float), np.diag([g["gr"], g["gg"], g["gb"]]), 0.8)).max() < 1e-6


def test_a_stage_of_ones_own(spark):
    runner.register("invert", lambda a: 1 - a, after="curves")
    try:
        assert runner.AFTER[-1] == "invert"
        plain = {"bm3d_denoise": {"sigma": 1e-4}}
        a = scene(32, 32)
        one, two = (arrays(runner.run(image_rows(spark, a), s))["f0"] for s in (plain, {**plain, "invert": {}}))
        assert np.allclose(one + two, 1, atol=1e-6)
        with pytest.raises(ValueError):
            runner.register("invert", lambda a: a, after="curves")
    finally:
        runner.KERNELS.pop("invert")
        runner.AFTER = tuple(s for s in runner.AFTER if s != "invert")


def test_order_and_profiles():
    assert runner.in_order(["zebra", "curves", "load", "apple", "curves"]) == ["load", "curves", "apple", "zebra"]
    assert profiles.value_of("1,") == (1, "") and profiles.value_of(" 1e3 ") == 1000.0
    assert ("nebula_wide", "stars", None, "null") in profiles.rows()
    assert profiles.overridden(profiles.profile("nebula"), ["bm3d_denoise.strength=2"])["bm3d_denoise"]["strength"] == 2


def test_files_to_files_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.fits").write_bytes(files.mosaic_fits(RNG.integers(2000, 32000, (64, 96)), BAYERPAT="RGGB"))
    (tmp_path / "in" / "two.fits").write_bytes(b"SIMPLE  = nothing else")
    rows = {r["frame_id"]: r for r in runner.run_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), "default").collect()}
    assert rows["one"]["done"][0] == "load" and rows["one"]["error"] is None and rows["two"]["error"]
    assert files.read_png((tmp_path / "out" / "one.png").read_bytes()).shape == (64, 96, 3)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["one.png"]
    work = lambda batch: with_kernel(batch, kernels.stretch)
    for _ in range(2):  # the second run finds nothing new
        streams.each_batch(streams.new_frames(spark, str(tmp_path / "in")), work, str(tmp_path / "results"), str(tmp_path / "state")).awaitTermination()
    got = {r["frame_id"]: r["error"] for r in spark.read.parquet(str(tmp_path / "results")).collect()}
    assert got["one"] is None and got["two"]


def test_errors_are_values(spark):
    def refuse(row, image):
        if row["frame_id"] == "f1":
            raise ValueError("no /tmp/secret/place for this")
        return image * 0.5

    got = {r["frame_id"]: r["error"] for r in on_images(image_rows(spark, scene(8, 8), scene(8, 8)), refuse).collect()}
    assert got["f0"] is None and got["f1"] == "ValueError: no place for this"


def test_pixels_and_images(spark):
    a = scene(9, 7).astype(np.float32).astype(float)
    assert np.array_equal(arrays(to_images(pixel_rows(spark, a, "f")))["f"], a)
