"""Headers, profiles and the kinds of frames against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.operators import classify
from nightloom.plans import profiles
from nightloom.sources import headers


def card(key, value):
    return f"{key:<8}= {value}".ljust(80)


def test_headers(spark):
    image = "".join([card("SIMPLE", "T / standard"), card("BITPIX", "16"), card("NAXIS", "2"), card("NAXIS1", "7"), card("NAXIS1", "1920"), card("NAXIS2", "1080 / rows"), card("BAYERPAT", "'gbrg    '"), "END".ljust(80), card("NAXIS", "9")])
    huge = card("BITPIX", "-32") + card("NAXIS", "2") + card("NAXIS1", "90000") + card("NAXIS2", "90000")
    packed = card("XTENSION", "'BINTABLE'") + card("ZNAXIS", "2") + card("ZBITPIX", "8") + card("ZNAXIS1", "65536") + card("ZNAXIS2", "65536")
    world = "".join(card(k, "1") for k in headers.WCS_KEYS)
    data = spark.createDataFrame([(i, h) for i, h in enumerate((image, huge, packed, world, "", None))], "id int, h string")
    v = data.select("id", headers.header_values(F.col("h")).alias("v"))
    got = v.select("id", headers.declared_bytes(F.col("v")).alias("size"), headers.colour_pattern(F.col("v")).alias("p"), headers.has_wcs(F.col("v")).alias("w")).orderBy("id").collect()
    assert [r["size"] for r in got[:5]] == [1920 * 1080 * 2, None, None, 0, 0]
    assert got[0]["p"] == "GBRG" and got[1]["p"] == "RGGB"
    assert got[3]["w"] and not got[0]["w"]


def test_profiles():
    wide = profiles.profile("nebula_wide")
    assert wide["stars"] is None and wide["background"]["grid"] == 32 and wide["background"]["downscale"] == 8
    assert profiles.profile("nebula")["stars"] == {"radius": 7}
    with pytest.raises(KeyError):
        profiles.profile("comet")
    got = profiles.overridden(wide, ["curves.channel_gains=1,2.5,x", "clahe.blend=none", "color.mahalanobis_wb=True"])
    assert got["curves"]["channel_gains"] == (1, 2.5, "x") and got["clahe"] == {"blend": None} and got["color"]["mahalanobis_wb"] is True
    assert "clahe" not in wide
    for bad in ("curves=1", "curves.x", "stars.radius=3"):
        with pytest.raises(ValueError):
            profiles.overridden(wide, [bad])


def test_regions(spark):
    mask = np.random.default_rng(1).random((24, 31)) < 0.55
    seen, best = np.zeros(mask.shape, bool), []
    for y, x in zip(*np.nonzero(mask)):
        todo, own = [(y, x)], []
        while todo:
            p = todo.pop()
            if 0 <= p[0] < 24 and 0 <= p[1] < 31 and mask[p] and not seen[p]:
                seen[p] = True
                own.append(p)
                todo += [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
        best = max(best, own, key=len)
    low, high = np.linalg.eigvalsh(np.cov(np.array(best).T, ddof=0))
    places = spark.createDataFrame([("f", int(y), int(x)) for y, x in zip(*np.nonzero(mask))], "frame_id string, y int, x int")
    got = classify.largest_region(places).first()
    assert got["area"] == len(best)
    assert got["elongation"] == pytest.approx(np.sqrt(1 - low / high))


def test_labels(spark):
    cases = [((0, 0, 0.7, 0), "nebula_dominant"), ((0, 0, 0.6, 0), "nebula_wide"), ((0, 0, 0.15, 0), "nebula"), ((0.01, 1400, 0.01, 0.2), "cluster"), ((0.05, 1400, 0.01, 0.9), "galaxy"), ((0.09, 0, 0, 0), "nebula"), ((0.03, 1400, 0, 0), "nebula_filament"), ((0.08, 0, 0, 0), "galaxy")]
    data = spark.createDataFrame([(i, *map(float, m)) for i, (m, _) in enumerate(cases)], "i int, sky double, density double, fraction double, elongation double")
    assert [r["label"] for r in data.withColumn("label", classify.label()).orderBy("i").collect()] == [want for _, want in cases]
