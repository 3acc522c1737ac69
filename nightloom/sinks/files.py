"""Frames as PNG, TIFF and FITS files; catalogs as Parquet.

`encoded` gives (name, content) rows, in parallel over frames and without any file. `write_files` puts
them under a path that all executors reach, by a data source writer: each file under a name of its own
first, then renamed, so that a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.kernels import luma, unit
from ..images import array_of

RECORD, CARD = 2880, 80
FORMATS = {"png": "png", "tif": "tiff", "tiff": "tiff", "fit": "fits", "fits": "fits", "fts": "fits"}
MEDIA = {"png": "image/png", "tiff": "image/tiff", "fits": "application/fits"}


def format_of(name: str) -> str:
    """The format that a file name asks for."""
    suffix = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if suffix not in FORMATS:
        raise ValueError(f"no writer for {name!r}")
    return FORMATS[suffix]


def levels(image: np.ndarray, bits: int = 16) -> np.ndarray:
    return np.rint(unit(image) * (2**bits - 1)).astype(">u2" if bits == 16 else "u1")


def png(samples: np.ndarray) -> bytes:
    """Samples (h, w, 3), or (h, w) for grey, of 8 or 16 bits."""
    h, w = samples.shape[:2]
    rows = samples.reshape(h, -1).view("u1")
    body = np.concatenate([np.zeros((h, 1), "u1"), rows], 1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8 * samples.dtype.itemsize, 2 if samples.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body, 6)) + chunk(b"IEND", b"")


def read_png(content: bytes) -> np.ndarray:
    """Samples of a PNG as `png` writes it (no filters, no palette)."""
    at, parts, h, w, bits, kind = 8, [], 0, 0, 8, 2
    while at < len(content):
        size, name = struct.unpack(">I4s", content[at : at + 8])
        data = content[at + 8 : at + 8 + size]
        if name == b"IHDR":
            w, h, bits, kind = struct.unpack(">IIBB", data[:10])
        elif name == b"IDAT":
            parts.append(data)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), "u1").reshape(h, -1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return np.ascontiguousarray(rows[:, 1:]).view(">u2" if bits == 16 else "u1").reshape((h, w, 3) if kind == 2 else (h, w))


def tiff(samples: np.ndarray) -> bytes:
    """One strip of 16-bit RGB, deflated, little-endian."""
    h, w = samples.shape[:2]
    body = zlib.compress(samples.astype("<u2").tobytes(), 6)
    short, long = 3, 4
    bits_at = 8 + len(body) + len(body) % 2
    # fixed values: tags of the format
    tags = [(256, long, 1, w), (257, long, 1, h), (258, short, 3, bits_at), (259, short, 1, 8), (262, short, 1, 2), (273, long, 1, 8), (277, short, 1, 3), (278, long, 1, h), (279, long, 1, len(body)), (284, short, 1, 1)]
    entries = b"".join(struct.pack("<HHI", t, k, n) + (struct.pack("<HH", v, 0) if k == short and n == 1 else struct.pack("<I", v)) for t, k, n, v in tags)
    table = bits_at + 6
    return struct.pack("<2sHI", b"II", 42, table) + body + b"\0" * (len(body) % 2) + struct.pack("<HHH", 16, 16, 16) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0)


def read_tiff(content: bytes) -> np.ndarray:
    """Samples of a TIFF as `tiff` writes it."""
    (table,) = struct.unpack("<I", content[4:8])
    (n,) = struct.unpack("<H", content[table : table + 2])
    tags = {}
    for i in range(n):
        tag, kind, count, value = struct.unpack("<HHII", content[table + 2 + 12 * i : table + 14 + 12 * i])
        tags[tag] = value & 0xFFFF if kind == 3 and count == 1 else value
    body = zlib.decompress(content[tags[273] : tags[273] + tags[279]])
    return np.frombuffer(body, "<u2").reshape(tags[257], tags[256], 3)


def card(key: str, value) -> bytes:
    shown = f"{'T' if value else 'F':>20}" if isinstance(value, bool) else f"'{value:<8}'" if isinstance(value, str) else f"{value:>20}"
    return f"{key:<8}= {shown}"[:CARD].ljust(CARD).encode("ascii", "replace")


def fits(image: np.ndarray, header: dict[str, str] | None = None, comments: tuple[str, ...] = ("processed frame",)) -> bytes:
    """A cube of three float32 planes; `header` adds cards that are no part of the layout."""
    cube = np.ascontiguousarray(np.moveaxis(image, 2, 0), ">f4")
    cards = [card("SIMPLE", True), card("BITPIX", -32), card("NAXIS", 3), *(card(f"NAXIS{i + 1}", n) for i, n in enumerate(cube.shape[::-1])), card("BUNIT", "normalized")]
    cards += [card(k, v) for k, v in (header or {}).items() if len(k) <= 8 and not k.startswith(("SIMPLE", "BITPIX", "NAXIS", "BUNIT", "EXTEND", "BZERO", "BSCALE", "END"))]
    cards += [f"COMMENT {c}"[:CARD].ljust(CARD).encode("ascii", "replace") for c in comments] + [b"END".ljust(CARD)]
    head, body = b"".join(cards), cube.tobytes()
    return head.ljust(-(-len(head) // RECORD) * RECORD) + body.ljust(-(-len(body) // RECORD) * RECORD, b"\0")


def mosaic_fits(samples: np.ndarray, **cards) -> bytes:
    """A mosaic of unsigned 16-bit samples, stored with the format's offset."""
    head = [card("SIMPLE", True), card("BITPIX", 16), card("NAXIS", 2), card("NAXIS1", samples.shape[1]), card("NAXIS2", samples.shape[0]), card("BZERO", 32768), card("BSCALE", 1), *(card(k, v) for k, v in cards.items()), b"END".ljust(CARD)]
    body = (samples.astype(np.int64) - 32768).astype(">i2").tobytes()
    text = b"".join(head)
    return text.ljust(-(-len(text) // RECORD) * RECORD) + body.ljust(-(-len(body) // RECORD) * RECORD, b"\0")


def _mapped(images: DataFrame, suffix: str, encode: Callable[[np.ndarray], bytes]) -> DataFrame:
    def run(batches):
        for batch in batches:
            for frame, h, w, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                yield pa.RecordBatch.from_arrays([pa.array([f"{frame}.{suffix}"]), pa.array([encode(array_of(h, w, data.as_py()))], pa.binary())], ["name", "content"])

    return images.where("error is null").select("frame_id", "h", "w", "data").mapInArrow(run, "name string, content binary")


def encoded(images: DataFrame, format: str = "png") -> DataFrame:
    """name, content: every frame without an error as a file of 16-bit PNG, 16-bit TIFF or float FITS."""
    kind = format_of(f"x.{format}")
    return _mapped(images, format, {"png": lambda a: png(levels(a)), "tiff": lambda a: tiff(levels(a)), "fits": fits}[kind])


# ------------------------------------------------------------------------------ previews


def lifted(image: np.ndarray, force: bool = False) -> np.ndarray:
    """Dark frames through a logarithm between two percentiles of luma."""
    light = luma(image)
    if not force and light.max() >= 0.2:
        return unit(image)
    low, high = np.percentile(light, [5, 99.9])
    n = unit((image - low) / max(high - low, 1e-6))
    curve = np.log1p(200 * n)
    return curve / max(curve.max(), 1e-6)


def thumbnail(image: np.ndarray, size: tuple[int, int] = (300, 300)) -> np.ndarray:
    """Every step-th pixel, lifted if dark, as 8 bits (cut, not rounded)."""
    step = max(1, min(image.shape[0] // size[0], image.shape[1] // size[1]))
    return (unit(lifted(image[::step, ::step])) * 255).astype("u1")


def thumbnails(images: DataFrame) -> DataFrame:
    return _mapped(images, "png", lambda a: png(thumbnail(a)))


def before_previews(images: DataFrame) -> DataFrame:
    """Full-size previews of raw frames, always lifted."""
    return _mapped(images, "png", lambda a: png((unit(lifted(a, force=True)) * 255).astype("u1")))


def debug_preview(image: np.ndarray) -> np.ndarray:
    curve = np.log1p(1000 * np.maximum(image, 0))
    return (curve / max(curve.max(), 1e-12) * 255).astype("u1")


# ------------------------------------------------------------------------------ writers


class FrameFiles(DataSource):
    """spark.dataSource: df(name, content).write.format("framefiles").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "framefiles"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool):
        return FrameWriter(self.options["path"])


class FrameWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> WriterCommitMessage:
        import uuid

        from pyarrow import fs

        where, folder = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}" if not self.path.startswith("file:") else self.path.replace("file:", "file://", 1))
        where.create_dir(folder, recursive=True)
        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with where.open_output_stream(own) as out:
                    out.write(content)
                where.move(own, f"{folder}/{name}")
        return WriterCommitMessage()


def write_files(files: DataFrame, path: str) -> None:
    """files(name, content) as files under a path that all executors share."""
    files.sparkSession.dataSource.register(FrameFiles)
    files.select("name", "content").write.format("framefiles").mode("append").save(path)


def write_catalog(catalog: DataFrame, path: str) -> None:
    """Catalog rows as float32, sorted by declination zone so that a field of view prunes row groups."""
    narrow = [F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in catalog.dtypes]
    zone = F.floor("dec").cast("int")
    catalog.select(*narrow).repartitionByRange(zone, "ra").sortWithinPartitions(zone, "ra").write.mode("overwrite").option("compression", "zstd").parquet(path)
