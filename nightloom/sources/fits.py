"""FITS files as images, and world coordinates from their headers.

Files are read through Spark's binaryFile source, so any store that Spark reads will do; decoding
is one pass in Python over (path, content). A file that is refused becomes a row with an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import demosaic, unit
from ..images import IMAGES, bytes_of, message
from .headers import BITPIX, CARD, MAX_BYTES, MAX_DIM, PATTERN_KEYS, PATTERNS, WCS_KEYS

# fixed values of the format, and limits on what is walked
RECORD, MAX_RECORDS, MAX_EXTENSIONS = 2880, 5, 16
MAGIC, MAX_UPLOAD, SUFFIXES = b"SIMPLE  =", 500 << 20, ("fit", "fits", "fts")
SAMPLES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


class Refused(ValueError):
    """A file that is no readable frame."""


def header_at(content: bytes, start: int, most: int = MAX_RECORDS) -> tuple[dict[str, str], int]:
    """The valued cards of the header that starts here (the last of repeated keys counts), and where its data begin."""
    values: dict[str, str] = {}
    for k in range(most):
        record = content[start + k * RECORD : start + (k + 1) * RECORD]
        if len(record) < RECORD:
            raise Refused("a header record is cut short")
        for i in range(0, RECORD, CARD):
            card = record[i : i + CARD].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return values, start + (k + 1) * RECORD
            if "=" in card[:10]:
                values[key] = card.split("=", 1)[1].split("/", 1)[0].strip().strip("'").strip()
    raise Refused(f"no END within {most} header records")


def whole(values: dict[str, str], key: str, default: int = 0) -> int:
    try:
        return int(float(values.get(key, default)))
    except (ValueError, OverflowError):
        return default


def declared(values: dict[str, str]) -> tuple[int, tuple[int, ...], int]:
    """(BITPIX, axes, bytes with groups and parameters); refuses sizes beyond the guard."""
    packed = values.get("ZIMAGE", "").startswith("T") or values.get("XTENSION") == "BINTABLE" and "ZNAXIS" in values
    for z in ("Z", "") if packed else ("",):
        bits, n = whole(values, f"{z}BITPIX", 8), whole(values, f"{z}NAXIS")
        axes = tuple(whole(values, f"{z}NAXIS{i + 1}") for i in range(max(0, min(n, 4))))
        if not 0 <= n <= 4 or bits not in BITPIX or any(d > MAX_DIM for d in axes):
            raise Refused("the declared shape is out of bounds")
        size = abs(bits) // 8 * math.prod(axes) if axes and min(axes) > 0 else 0
        if size > MAX_BYTES:
            raise Refused(f"the declared image has {size} bytes")
    return bits, axes, (size + abs(bits) // 8 * whole(values, "PCOUNT")) * max(1, whole(values, "GCOUNT", 1))


def units(content: bytes):
    """(header, raw array or None) of the primary unit and up to MAX_EXTENSIONS extensions."""
    at = 0
    for _ in range(1 + MAX_EXTENSIONS):
        if at >= len(content):
            return
        values, data = header_at(content, at)
        bits, axes, size = declared(values)
        image = values.get("XTENSION", "IMAGE") == "IMAGE"
        array = None
        if image and axes and min(axes) > 0:
            count = math.prod(axes)
            if data + count * abs(bits) // 8 > len(content):
                raise Refused("the data are cut short")
            array = np.frombuffer(content, SAMPLES[bits], count, data).reshape(axes[::-1])
        yield values, array
        at = data + -(-size // RECORD) * RECORD


def physical(values: dict[str, str], raw: np.ndarray) -> np.ndarray:
    """Samples with BSCALE and BZERO; the usual offset of unsigned integers keeps them integers."""
    try:
        scale, zero = float(values.get("BSCALE", 1)), float(values.get("BZERO", 0))
    except ValueError:
        scale, zero = 1.0, 0.0
    if scale == 1 and zero == 0:
        return raw
    if scale == 1 and raw.dtype.kind == "i" and zero == 2 ** (8 * raw.dtype.itemsize - 1):
        return (raw.astype(np.int64) + int(zero)).astype(f"u{raw.dtype.itemsize}")
    return raw.astype(np.float64) * scale + zero


def normalised(raw: np.ndarray, bits: int) -> np.ndarray:
    """Samples in [0, 1]: integers by their range, floats by their greatest value if it is positive."""
    if bits > 0:
        return unit(raw.astype(np.float64) / (2.0**bits - 1))
    values = raw.astype(np.float64)
    top = np.nanmax(values) if np.isfinite(values).any() else 0.0
    return unit(np.nan_to_num(values / top if top > 0 else values))


def pattern_of(values: dict[str, str]) -> str:
    found = (values.get(k, "").strip().upper() for k in PATTERN_KEYS)
    return next((p for p in found if p in PATTERNS), "RGGB")


def laid_out(samples: np.ndarray, values: dict[str, str]) -> np.ndarray:
    """(h, w, 3): three or four planes first or last, or a mosaic."""
    if samples.ndim == 3 and samples.shape[0] in (3, 4):
        return np.moveaxis(samples[:3], 0, 2)
    if samples.ndim == 3 and samples.shape[2] in (3, 4):
        return samples[..., :3]
    if samples.ndim == 2:
        return demosaic(samples, pattern_of(values))
    raise Refused(f"no frame has the shape {samples.shape}")


def decoded(content: bytes) -> tuple[np.ndarray, dict[str, str]]:
    """The first unit with data, as an image, and its header."""
    for values, raw in units(content):
        if raw is not None:
            return laid_out(normalised(physical(values, raw), whole(values, "BITPIX")), values), values
    raise Refused("no unit has data")


def read_fits(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """images(frame_id = file name without suffix, ...) of the FITS files under a path or glob."""
    source = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").option("recursiveFileLookup", str(recursive).lower())
    return decoded_files(source.load(path).select("path", "content"))


def decoded_files(files: DataFrame) -> DataFrame:
    """images of files(path, content)."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                image, header, error = None, {}, None
                try:
                    image, header = decoded(content.as_py())
                except Exception as e:  # noqa: BLE001  a file's failure is a value
                    error = message(e)
                h, w, data = (image.shape[0], image.shape[1], bytes_of(image)) if image is not None else (None, None, None)
                name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([data], pa.binary()), pa.array([list(header.items())], pa.map_(pa.string(), pa.string())), pa.array([["load"] if error is None else []], pa.list_(pa.string())), pa.array([error], pa.string())],
                    ["frame_id", "h", "w", "data", "header", "done", "error"],
                )

    return files.select("path", "content").mapInArrow(run, IMAGES)


def accepted(files: DataFrame) -> DataFrame:
    """files(path, length, content) with a column `refused`: null, or why an upload is not taken."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn("refused", F.when(~suffix.isin(*SUFFIXES), "suffix").when(F.col("length") > MAX_UPLOAD, "size").when(F.substring("content", 1, len(MAGIC)) != F.lit(MAGIC), "format"))


def projections(images: DataFrame) -> DataFrame:
    """frame_id, ra0, dec0, x0, y0, cd11, cd12, cd21, cd22 (reference pixel from 0) and the polynomial
    distortion terms a, b (maps of "p_q"); no row for frames without usable coordinates."""
    return parsed_wcs(images.where("error is null").select("frame_id", F.col("header").alias("v")))


def parsed_wcs(headers: DataFrame) -> DataFrame:
    """The same from (frame_id, v: map of header values)."""
    number = lambda k: F.col("v")[k].try_cast("double")
    plain = {k: number(k) for k in ("CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2")}
    cd_keys = [f"CD{i}_{j}" for i in (1, 2) for j in (1, 2)]
    has_cd = F.exists(F.array(*map(F.lit, cd_keys)), lambda k: F.map_contains_key("v", k))
    turn = {k: F.coalesce(number(k.replace("CD", "PC")), F.lit(1.0 if k in ("CD1_1", "CD2_2") else 0.0)) for k in cd_keys}
    step = {1: F.coalesce(number("CDELT1"), F.lit(1.0)), 2: F.coalesce(number("CDELT2"), F.lit(1.0))}
    cd = {k: F.when(has_cd, F.coalesce(number(k), F.lit(0.0))).otherwise(turn[k] * step[int(k[2])]) for k in cd_keys}
    terms = lambda letter: F.map_from_entries(F.filter(F.transform(F.map_entries("v"), lambda e: F.struct(F.regexp_extract(e["key"], f"^{letter}_([0-9]_[0-9])$", 1).alias("key"), e["value"].try_cast("double").alias("value"))), lambda e: (e["key"] != "") & e["value"].isNotNull()))
    out = headers.where(F.forall(F.array(*map(F.lit, WCS_KEYS)), lambda k: F.map_contains_key("v", k)))
    out = out.select(
        "frame_id", plain["CRVAL1"].alias("ra0"), plain["CRVAL2"].alias("dec0"), (plain["CRPIX1"] - 1).alias("x0"), (plain["CRPIX2"] - 1).alias("y0"),
        *(cd[k].alias(f"cd{k[2]}{k[4]}") for k in cd_keys), terms("A").alias("a"), terms("B").alias("b"),
    )
    known = F.array("ra0", "dec0", "x0", "y0")
    return out.where(F.forall(known, lambda x: x.isNotNull()) & F.exists(F.array("cd11", "cd12", "cd21", "cd22"), lambda x: x != 0))


def distorted(terms: Column, u: Column, v: Column) -> Column:
    """The polynomial sum of terms["p_q"] u^p v^q."""
    one = lambda e: e["value"] * F.pow(u, F.substring(e["key"], 1, 1).cast("int")) * F.pow(v, F.substring(e["key"], 3, 1).cast("int"))
    return F.aggregate(F.map_entries(terms), F.lit(0.0), lambda s, e: s + one(e))
