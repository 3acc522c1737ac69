"""Applies a profile's stages to images, each frame with its own settings.

Stages are one pass over the images, without a shuffle. Where frames are to be calibrated photometrically,
the pass is cut there: the calibration is a relational plan over the pixels of all frames. A frame that a
stage refuses keeps the message, and the others go on.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..images import on_images, to_pixels
from ..operators import classify, sky
from ..sources.fits import projections, read_fits
from ..storage import kept
from . import profiles

#: Stages in order; those in ALWAYS run with their defaults where a profile says nothing.
BEFORE = ("dark_subtract", "cosmetic", "background")
AFTER = ("color", "deconv", "stretch", "stars", "starless_stretch", "bm3d_denoise", "sharpen", "clahe", "curves")
ORDER = ("load", *BEFORE, "spcc", *AFTER, "recombine", "export")
ALWAYS = ("background", "color", "stretch", "bm3d_denoise", "sharpen", "curves")
#: Any size: places beyond a frame's edges have no pixels.
ANY = 1 << 30

KERNELS: dict[str, Callable[..., np.ndarray]] = {
    "dark_subtract": kernels.dark_subtract, "cosmetic": kernels.cosmetic, "background": kernels.background, "color": kernels.colour, "deconv": kernels.deconvolve,
    "stretch": kernels.stretch, "starless_stretch": kernels.stretch, "bm3d_denoise": kernels.denoise, "sharpen": kernels.sharpen, "clahe": kernels.clahe, "curves": kernels.curves,
}


def register(name: str, kernel: Callable[..., np.ndarray], after: str) -> None:
    """A stage of one's own, kernel(image, **settings), that runs behind another if a profile has settings for it."""
    global BEFORE, AFTER
    if name in KERNELS:
        raise ValueError(f"there is a stage {name!r}")
    place = lambda names: (*names[: names.index(after) + 1], name, *names[names.index(after) + 1 :])
    if after in BEFORE:
        BEFORE = place(BEFORE)
    elif after in AFTER:
        AFTER = place(AFTER)
    else:
        raise ValueError(f"there is no stage {after!r}")
    KERNELS[name] = kernel


def asked(settings: dict, stage: str) -> dict | None:
    """A stage's settings: None if it doesn't run."""
    own = settings.get(stage)
    return {} if own is None and stage in ALWAYS else own


def applied(stages: Iterable[str], settings_of: dict[str, dict], chain: dict[str, Callable], dark: np.ndarray | None):
    """For on_images: the stages of a frame's settings, in order."""

    def work(row: dict, image: np.ndarray) -> np.ndarray:
        settings, stars = settings_of[row["label"]], None
        for stage in stages:
            own = asked(settings, stage)
            if stage == "dark_subtract":
                if dark is None:
                    continue
                own = {"dark": dark, **(own or {})}
            if own is None or stage == "starless_stretch" and stars is None:
                continue
            if stage == "stars":
                stars, image = kernels.split_stars(image, **own)
            else:
                image = chain[stage](image, **own)
            row["done"].append(stage)
        if stars is not None:
            image = kernels.screen(stars, image)
            row["done"].append("recombine")
        return image

    return work


def labelled(images: DataFrame) -> DataFrame:
    """images with the kind of each frame as label; what can't be classified is default."""
    kinds = classify.classified(to_pixels(images), ANY, ANY).select("frame_id", "label")
    return images.join(kinds, "frame_id", "left").withColumn("label", F.coalesce("label", F.lit("default")))


def resolved(profile: str | dict, overrides: Iterable[str] = ()) -> dict[str, dict]:
    """The settings of each label that frames can have under a profile ("auto": by their kind)."""
    overrides = list(overrides)
    if isinstance(profile, dict):
        return {"given": profiles.overridden(profile, overrides)}
    names = list(profiles.SETTINGS) if profile == "auto" else [profile]
    return {n: profiles.overridden(profiles.profile(n), overrides) for n in names}


def run(images: DataFrame, profile: str | dict = "auto", overrides: Iterable[str] = (), dark: np.ndarray | None = None, catalog: DataFrame | None = None) -> DataFrame:
    """images after all stages of the profile; done names them."""
    settings_of = resolved(profile, overrides)
    for settings in settings_of.values():
        unknown = set(settings) - set(KERNELS) - {"stars", "spcc"}
        if unknown:
            raise ValueError(f"no such stages: {sorted(unknown)}")
    chain = dict(KERNELS)
    named = labelled(kept(images, "loaded")) if profile == "auto" else images.withColumn("label", F.lit(next(iter(settings_of))))
    if catalog is None or all(asked(s, "spcc") is None for s in settings_of.values()):
        return on_images(named, applied((*BEFORE, *AFTER), settings_of, chain, dark), extra=("label",))
    named = kept(named, "named")
    label = named.select("frame_id", "label")
    linear = kept(on_images(named, applied(BEFORE, settings_of, chain, dark), extra=("label",)), "linear")
    out = calibrated(linear, label, settings_of, catalog).join(label, "frame_id")
    return on_images(out, applied(AFTER, settings_of, chain, dark), extra=("label",))


def calibrated(images: DataFrame, label: DataFrame, settings_of: dict[str, dict], catalog: DataFrame) -> DataFrame:
    """Frames of labels that ask for it, with their gains applied; frames without coordinates stay."""
    out = images.withColumn("gains", F.lit(None).cast("string"))
    for name, settings in settings_of.items():
        own = asked(settings, "spcc")
        if own is None:
            continue
        own = {"solar_reference_bp_rp": 0.82, "strength": 0.5, "luma_weighted": True, **own}
        mine = images.join(label.where(F.col("label") == name).select("frame_id"), "frame_id", "left_semi")
        where = projections(mine).join(mine.select("frame_id", "h", "w"), "frame_id")
        px = to_pixels(mine.join(where.select("frame_id"), "frame_id", "left_semi"))
        extra = {k: own[v] for k, v in (("arcsec", "tol_arcsec"), ("n_detect", "n_detect"), ("amplitude", "color_amplitude"), ("aperture", "aperture_r"), ("inner", "annulus_inner"), ("outer", "annulus_outer"), ("mode", "mode")) if v in own}
        fit = sky.calibrate(px, catalog, where, min_matches=own.get("min_matches", 20), reference=own["solar_reference_bp_rp"], **extra)
        terms = [c for c in fit.columns if c not in ("frame_id", "n")]
        told = fit.where(F.col("n") >= own.get("min_matches", 20)).select("frame_id", F.to_json(F.struct(F.array(*terms).alias("terms"), F.lit(own["strength"]).cast("double").alias("strength"), F.lit(bool(own["luma_weighted"])).alias("weighted"))).alias("told"))
        out = out.join(told, "frame_id", "left").withColumn("gains", F.coalesce("told", "gains")).drop("told")

    def work(row: dict, image: np.ndarray) -> np.ndarray:
        if row["gains"] is None:
            return image
        given = json.loads(row["gains"])
        terms = np.array(given["terms"], float)
        matrix = np.diag(terms) if len(terms) == 3 else terms.reshape(3, 3)
        row["done"].append("spcc")
        return kernels.recolour(image, matrix, given["strength"], given["weighted"])

    return on_images(out, work, extra=("gains",))


def in_order(stages: Iterable[str]) -> list[str]:
    """Stage names in the order of the pipeline, unknown ones last by name."""
    known = {s: i for i, s in enumerate(ORDER)}
    return sorted(set(stages), key=lambda s: (known.get(s, len(known)), s))


def sweep(images: DataFrame, variations: dict[str, list[str]], profile: str | dict = "auto", **settings) -> DataFrame:
    """Every frame under every named list of overrides; frame ids get the variation's name."""
    out = None
    for name, overrides in variations.items():
        made = run(images, profile, overrides, **settings).withColumn("frame_id", F.concat("frame_id", F.lit(f"@{name}")))
        out = made if out is None else out.unionByName(made)
    if out is None:
        raise ValueError("no variations")
    return out


def run_files(spark: SparkSession, source: str, target: str, profile: str | dict = "auto", overrides: Iterable[str] = (), format: str = "png", catalog: DataFrame | None = None, dark: np.ndarray | None = None) -> DataFrame:
    """FITS files under `source` to files under `target`; returns frame_id, done, error of each."""
    from ..sinks.files import encoded, format_of, write_files

    format_of(f"x.{format}")
    out = kept(run(read_fits(spark, source), profile, overrides, dark, catalog), "frames")
    write_files(encoded(out, format), target)
    return out.select("frame_id", "done", "error")
