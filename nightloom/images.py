"""Frames as images: one row per frame, for operators that need whole planes.

images(frame_id, h, w, data, header, done, error): data holds h * w * 3 little-endian float32, row by row;
done names the stages that ran; a frame that a stage refuses keeps the message in error, and the
other frames go on. A row is bounded by the sources' size guard, and many frames run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import CHANNELS

IMAGES = "frame_id string, h int, w int, data binary, header map<string,string>, done array<string>, error string"
PIXELS = "frame_id string, y int, x int, r double, g double, b double"
#: Rows of pixels that leave a task at a time.
CHUNK = 1 << 16
MESSAGE = 200


def array_of(h: int, w: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<f4").reshape(h, w, 3).astype(np.float64)


def bytes_of(image: np.ndarray) -> bytes:
    return np.ascontiguousarray(image, "<f4").tobytes()


def message(e: Exception) -> str:
    """An error for a table: without paths, and short."""
    words = [w.rsplit("/", 1)[-1] if "/" in w else w for w in f"{type(e).__name__}: {e}".split()]
    return " ".join(words)[:MESSAGE]


def to_images(px: DataFrame) -> DataFrame:
    """Pixels, one group a frame, as images; missing pixels are 0."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        h, w = int(frame["y"].max()) + 1, int(frame["x"].max()) + 1
        image = np.zeros((h, w, 3))
        image[frame["y"], frame["x"]] = frame[list(CHANNELS)].to_numpy()
        return pd.DataFrame([(frame["frame_id"].iloc[0], h, w, bytes_of(image), {}, [], None)], columns=["frame_id", "h", "w", "data", "header", "done", "error"])

    return px.select("frame_id", "y", "x", *CHANNELS).groupBy("frame_id").applyInPandas(build, IMAGES)


def to_pixels(images: DataFrame) -> DataFrame:
    """The pixels of the images without an error."""

    def run(batches):
        for batch in batches:
            for frame, h, w, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                flat = np.frombuffer(data.as_py(), "<f4").reshape(-1, 3).astype(np.float64)
                for i in range(0, h * w, CHUNK):
                    at, part = np.arange(i, min(h * w, i + CHUNK)), flat[i : i + CHUNK]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([frame] * len(at), pa.string()), pa.array((at // w).astype(np.int32)), pa.array((at % w).astype(np.int32)), *(pa.array(np.ascontiguousarray(part[:, c])) for c in range(3))],
                        ["frame_id", "y", "x", *CHANNELS],
                    )

    return images.where("error is null").select("frame_id", "h", "w", "data").mapInArrow(run, PIXELS)


def on_images(images: DataFrame, work: Callable[[dict, np.ndarray], np.ndarray], *, extra: tuple[str, ...] = ()) -> DataFrame:
    """Every image replaced by work(row, image), without a shuffle. Rows with an error pass through.

    `row` holds frame_id, header and the `extra` columns; work may append names to row["done"].
    """
    names = ["frame_id", "h", "w", "data", "header", "done", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                row["header"], row["done"] = dict(row["header"] or {}), list(row["done"] or [])
                if row["error"] is None:
                    try:
                        image = work(row, array_of(row["h"], row["w"], row["data"]))
                        row["h"], row["w"], row["data"] = image.shape[0], image.shape[1], bytes_of(image)
                    except Exception as e:  # noqa: BLE001  one frame's failure is a value, not the job's
                        row["error"], row["data"] = message(e), None
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), pa.string()]
                values = [row["frame_id"], row["h"], row["w"], row["data"], list(row["header"].items()), row["done"], row["error"]]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    return images.select(*names, *extra).mapInArrow(run, IMAGES)


def with_kernel(images: DataFrame, kernel: Callable[..., np.ndarray], **settings) -> DataFrame:
    """kernel(image, **settings) on every image."""
    return on_images(images, lambda row, image: kernel(image, **settings))


def dense(images: DataFrame, tasks: int | None = None) -> DataFrame:
    """The images dealt evenly over tasks, by frame."""
    n = tasks or images.sparkSession.sparkContext.defaultParallelism
    return images.repartition(n, F.col("frame_id"))
