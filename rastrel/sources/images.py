"""Image files in and out: decoded by Spark's image source, written as PNG by the tasks that hold the pixels."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = ("b", "g", "r", "a")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, height, width, channels, y, x, b, g, r, a) of the images under path, values of 0 to 255.

    A gray image has three equal channels; without transparency a is 255. A file that is no image, an empty one, or one
    of another number of channels raises an error, as does a path without images.
    """
    found = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")
    checked = found.withColumn("data", F.when((F.col("height") > 0) & F.col("nChannels").isin(1, 3, 4), F.col("data")).otherwise(
        F.raise_error(F.concat(F.lit("not an image of 1, 3 or 4 channels: "), F.col("origin"))).cast("binary")
    ))
    names = ["origin", "height", "width", "channels", "y", "x", *CHANNELS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin, height, width, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                cells = np.frombuffer(data, np.uint8).reshape(-1, n).astype(np.int32)
                planes = [cells[:, 0]] * 3 if n == 1 else [cells[:, k] for k in range(3)]
                y, x = np.divmod(np.arange(height * width, dtype=np.int32), np.int32(width))
                size = len(y)
                whole = [pa.array([origin] * size), *(pa.array(np.full(size, v, np.int32)) for v in (height, width, n))]
                yield pa.RecordBatch.from_arrays([*whole, *map(pa.array, (y, x, *planes, cells[:, 3] if n == 4 else np.full(size, 255, np.int32)))], names)

    schema = "origin string, " + ", ".join(f"{n} int" for n in names[1:])
    return checked.select("origin", "height", "width", "nChannels", "data").mapInArrow(run, schema)


def png(image: np.ndarray) -> bytes:
    """A PNG of bytes (height, width) or (height, width, 3 or 4)."""
    high, wide = image.shape[:2]
    n = 1 if image.ndim == 2 else image.shape[2]
    lines = np.zeros((high, 1 + wide * n), np.uint8)
    lines[:, 1:] = image.reshape(high, -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", wide, high, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def bmp(image: np.ndarray) -> bytes:
    """A BMP of bytes (height, width) or (height, width, 3), 24 bits a pixel, from the last row up."""
    high, wide = image.shape[:2]
    rows = np.zeros((high, -(-3 * wide // 4) * 4), np.uint8)
    rows[:, : 3 * wide] = (np.repeat(image[..., None], 3, 2) if image.ndim == 2 else image[..., 2::-1]).reshape(high, -1)
    head = struct.pack("<IiiHHIIiiII", 40, wide, high, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + head + rows[::-1].tobytes()


FORMS = {"png": png, "bmp": bmp}


def encoded(df: DataFrame, key: str, channels: tuple[str, ...] = ("r", "g", "b"), form: str = "png") -> DataFrame:
    """(key, png or bmp) of images with pixels (key, y, x, channels): values are cut off to whole numbers and kept in 0..255."""
    kind = df.schema[key].dataType.simpleString()

    def run(name: tuple, part: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((int(part["y"].max()) + 1, int(part["x"].max()) + 1, len(channels)), np.uint8)
        image[part["y"], part["x"]] = np.clip(np.trunc(part[list(channels)].to_numpy(float)), 0, 255)
        return pd.DataFrame({key: [name[0]], form: [FORMS[form](image[..., 0] if len(channels) == 1 else image)]})

    return df.select(key, "y", "x", *channels).groupBy(key).applyInPandas(run, f"{key} {kind}, {form} binary")


def save(images: DataFrame, folder: str, key: str, name: str = "{}.png", form: str = "png") -> None:
    """Writes (key, png) as files of a folder that all executors reach: a path, or the address of a store that Arrow knows
    (file, hdfs, s3, gs). A file appears when it is whole, so a task that runs again does no harm."""
    def run(rows) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(folder))
        store.create_dir(root, recursive=True)
        for row in rows:
            path = f"{root}/{name.format(row[key])}"
            part = f"{path}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(row[form])
            store.move(part, path)

    images.select(key, form).foreachPartition(run)


#: Frames (percent of the way) that are kept by name.
KEY_FRAMES = (0, 25, 50, 75, 100)


def save_frames(frames: DataFrame, folder: str, colour: int = 0, channels: tuple[str, ...] = ("r", "g", "b")) -> None:
    """Frames with pixels (frame, y, x, channels) as frame files, the key frames also as N_colorC.png."""
    made = encoded(frames, "frame", channels).persist()
    save(made, folder, "frame")
    save(made.where(F.col("frame").isin(*KEY_FRAMES)), folder, "frame", "{}_color" + f"{colour}.png")
    made.unpersist()


def draw_points(df: DataFrame, points: list[tuple[float, float]], height: int, width: int, radius: int = 2, colour: tuple[int, int, int] = (255, 0, 0)) -> DataFrame:
    """df (r, g, b) with a dot at each normalised control point."""
    near = F.lit(False)
    for px, py in points:
        dx, dy = F.col("x") - (px * width - 0.5), F.col("y") - (py * height - 0.5)
        near |= dx * dx + dy * dy <= radius * radius
    return df.withColumns({c: F.when(near, float(v)).otherwise(F.col(c)) for c, v in zip("rgb", colour)})
