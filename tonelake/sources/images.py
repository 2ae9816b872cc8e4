"""Pages from image files, read by Spark's own image source (PNG, JPEG, BMP, GIF)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "score_id long, path string, page int, width int, height int, rgba binary, error string"


def on_white(pixels: np.ndarray) -> np.ndarray:
    """``(h, w, 4)`` opaque RGBA of grey, BGR or BGRA pixels laid on white paper."""
    h, w, channels = pixels.shape
    colour = np.repeat(pixels, 3, 2) if channels == 1 else pixels[..., 2::-1]
    if channels == 4:
        alpha = pixels[..., 3:].astype(np.float64) / 255
        colour = np.floor(colour * alpha + 255 * (1 - alpha) + 0.5).astype(np.uint8)
    return np.concatenate([colour, np.full((h, w, 1), 255, np.uint8)], 2)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """One page per image file, for :func:`tonelake.operators.omr.recognise`.

    ``score_id`` is a hash of the path.  A file that cannot be decoded is a
    row with ``error`` and without pixels.
    """
    rows = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(path).select("image.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for sid, origin, w, h, channels, data in zip(b["score_id"], b["origin"], b["width"], b["height"], b["nChannels"], b["data"]):
                if w > 0 and h > 0:
                    out.append((sid, origin, 0, w, h, on_white(np.frombuffer(data, np.uint8).reshape(h, w, channels)).tobytes(), None))
                else:
                    out.append((sid, origin, 0, None, None, None, "Could not decode image"))
            pages = pd.DataFrame(out, columns=[c.split()[0] for c in PAGES.split(", ")])
            yield pages.astype({"width": "Int64", "height": "Int64"})

    return rows.select(F.xxhash64("origin").alias("score_id"), "origin", "width", "height", "nChannels", "data").mapInPandas(run, PAGES)
