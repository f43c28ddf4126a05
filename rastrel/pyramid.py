"""Halves the images of a folder until a side is 8 pixels or less: python -m rastrel.pyramid INPUT FOLDER

Level N of an image goes to FOLDER/N.bmp, or where INPUT has several, to FOLDER/IMAGE-N.bmp."""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rastrel.operators.pyramids import halvings
from rastrel.session import session
from rastrel.sources import images


def run(spark: SparkSession, source: str, folder: str) -> float:
    """Seconds that it took. Images of one size go together."""
    began = time.perf_counter()
    found = images.read_images(spark, source)
    stem = F.regexp_replace(F.regexp_extract("origin", r"([^/]*)$", 1), r"\.[^.]*$", "")
    found = found.select(stem.alias("image_id"), "height", "width", "y", "x", "r", "g", "b")
    sizes = found.groupBy("height", "width").agg(F.count_distinct("image_id").alias("n")).collect()  # as many as there are sizes
    alone = sum(s["n"] for s in sizes) == 1
    for size in sizes:
        own = found.where((F.col("height") == size["height"]) & (F.col("width") == size["width"]))
        for level, (_, _, made) in enumerate(halvings(own, size["height"], size["width"]), 1):
            images.save(images.encoded(made, "image_id", form="bmp"), folder, "image_id", f"{level}.bmp" if alone else "{}-" + f"{level}.bmp", "bmp")
    return time.perf_counter() - began


if __name__ == "__main__":
    print(f"{run(session(), sys.argv[1], sys.argv[2]):.3f} s")
