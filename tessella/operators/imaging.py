"""Quality rows and tiles of images, in Arrow batches over the `image` source's struct.

The JVM decodes (PNG, TIFF, JPEG); bytes arrive in BGR order. A file that cannot be
decoded has height -1: it gives a quality row without readings, or an error in strict
mode. One image is in memory at a time, tiles leave as they are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import pixels as P
from tessella.functions.text import fingerprint

QC_SCHEMA = "image_id string, decode_ok boolean, width int, height int, background_reference_rgb array<double>, tissue_fraction double, focus_score double, tiles_eligible int, status string"
TILE_SCHEMA = "image_id string, x int, y int, w int, h int, valid_w int, valid_h int, tissue_fraction double, place int, png binary"


def decoded(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """RGB from the source's rows; grey becomes three channels, alpha goes on white."""
    if channels not in (1, 3, 4) or height < 1 or width < 1 or len(data) != height * width * channels:
        raise ValueError(f"{len(data)} bytes for {height} x {width} pixels of {channels} channels")
    flat = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(flat, 3, axis=2)
    rgb = flat[..., [2, 1, 0]]
    return P.over_white(np.concatenate([rgb, flat[..., 3:]], axis=2)) if channels == 4 else np.ascontiguousarray(rgb)


def images(spark, path: str) -> DataFrame:
    """(image_id, path, height, width, n_channels, data) of the images below a folder."""
    rows = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path)
    origin = F.coalesce("image.origin", F.lit(""))
    return rows.select(F.regexp_extract(origin, r"([^/\\]+?)(?:\.[^./\\]*)?\z", 1).alias("image_id"), origin.alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("n_channels"), "image.data")


def several_frames(contents: DataFrame) -> DataFrame:
    """(path, frames) of the files (path, content) that hold more than one picture."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "frames": [P.frame_count(bytes(c)) for c in batch["content"]]})

    return contents.select("path", "content").mapInPandas(count, "path string, frames int").filter("frames > 1")


def quality(frames: DataFrame, settings: P.Settings, strict: bool = False) -> DataFrame:
    """One quality row for each image."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.height is None or r.height <= 0:
                    if strict:
                        raise ValueError(f"cannot decode {r.image_id}")
                    out.append((r.image_id, False, None, None, None, None, None, 0, "read_error"))
                    continue
                rgb = decoded(int(r.height), int(r.width), int(r.n_channels), r.data)
                ground = P.background(rgb, settings)
                mask = P.tissue_mask(rgb, ground, settings)
                eligible = sum(f > 0 and f >= settings.min_tissue for *_, f in P.tile_fractions(mask, settings))
                out.append((r.image_id, True, int(r.width), int(r.height), [float(v) for v in ground], float(mask.mean()), P.focus(rgb), int(eligible), "ok"))
            yield pd.DataFrame(out, columns=["image_id", "decode_ok", "width", "height", "background_reference_rgb", "tissue_fraction", "focus_score", "tiles_eligible", "status"])

    return frames.select("image_id", "height", "width", "n_channels", "data").mapInPandas(work, QC_SCHEMA)


def tiles(frames: DataFrame, settings: P.Settings) -> DataFrame:
    """The eligible tiles of each image in raster order, at most max_tiles of them when that is set."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.height is None or r.height <= 0:
                    continue
                rgb = decoded(int(r.height), int(r.width), int(r.n_channels), r.data)
                mask = P.tissue_mask(rgb, P.background(rgb, settings), settings)
                chosen = [t for t in P.tile_fractions(mask, settings) if t[4] > 0 and t[4] >= settings.min_tissue]
                chosen = chosen[: settings.max_tiles] if settings.max_tiles else chosen
                size = settings.tile_size
                for at in range(0, len(chosen), 64):
                    rows = [(r.image_id, x, y, size, size, w, h, f, at + k + 1, P.encode_png(P.crop(rgb, x, y, size))) for k, (x, y, w, h, f) in enumerate(chosen[at : at + 64])]
                    yield pd.DataFrame(rows, columns=["image_id", "x", "y", "w", "h", "valid_w", "valid_h", "tissue_fraction", "place", "png"])

    return frames.select("image_id", "height", "width", "n_channels", "data").mapInPandas(work, TILE_SCHEMA)


def tile_ids(rows: DataFrame, digest: Column, config_id: str) -> DataFrame:
    """With tile_id, content_tile_id (without the image's id) and the member's name."""
    shared = {"image_sha256": digest, "x": F.col("x"), "y": F.col("y"), "w": F.col("w"), "h": F.col("h"), "config_id": F.lit(config_id)}
    named = rows.withColumn("tile_id", fingerprint(image_id=F.col("image_id"), **shared)).withColumn("content_tile_id", fingerprint(**shared))
    return named.withColumn("patch_member", F.concat(F.lit("patches/"), "tile_id", F.lit(".png")))


def review_reasons(tissue: Column, duplicated: Column, focus: Column, eligible: Column, blur_threshold: float) -> Column:
    """The named reasons for a review, in order; an empty list passes."""
    blurred = F.lit(blur_threshold > 0) & (focus < blur_threshold)
    rules = [("no_tissue", tissue <= 0), ("duplicate_source_content", duplicated), ("focus_below_review_threshold", blurred), ("no_tiles_met_tissue_threshold", eligible == 0)]
    return F.array_compact(F.array(*[F.when(c, n) for n, c in rules]))
