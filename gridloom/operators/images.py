"""Measures of pictures, which come as plain bytes of red, green and blue, row by row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# The weights of grey, the bounds of clipped and glaring pixels, and how each measure is scaled.
GREY, SHIFT = (4899, 9617, 1868), 14
DARK, BRIGHT, GLARE_VALUE, GLARE_SATURATION = 4, 251, 242, 45
SHARP, CLIPPED, GLARE = 500.0, 2.5, 6.0
MEASURES = ("sharpness", "exposure", "highlight_retention", "glare_resistance")


def grey(rgb: np.ndarray) -> np.ndarray:
    """Grey values 0..255 of (height x width x 3) bytes."""
    total = sum(rgb[..., i].astype(np.int64) * w for i, w in enumerate(GREY))
    return (total + (1 << SHIFT - 1)) >> SHIFT


def shrunk(picture: np.ndarray, size: int) -> np.ndarray:
    """(size x size) means over equal areas, rounded; pixels on a border count by their share."""

    def weights(n: int) -> np.ndarray:
        edges = np.arange(size + 1) * n / size
        pixel = np.arange(n)
        return np.clip(np.minimum(edges[1:, None], pixel + 1) - np.maximum(edges[:-1, None], pixel), 0, None) * size / n

    return np.rint(weights(picture.shape[0]) @ picture @ weights(picture.shape[1]).T)


def median_hash_of(picture: np.ndarray) -> str:
    """64 hex digits: which of 16 x 16 areas are brighter than their median."""
    small = shrunk(picture.astype(np.float64), 16)
    bits = (small > np.median(small)).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):064x}"


def quality(rgb: np.ndarray) -> tuple[float, ...]:
    """The ``MEASURES`` of one picture, each between 0 and 1."""
    g = grey(rgb)
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    edges = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    spread = float(edges.astype(np.float64).var())
    value, low = rgb.max(-1).astype(np.int64), rgb.min(-1).astype(np.int64)
    saturation = np.rint(np.where(value > 0, 255.0 * (value - low) / np.maximum(value, 1), 0.0))
    clipped = float(((g <= DARK) | (g >= BRIGHT)).mean())
    glare = float(((value >= GLARE_VALUE) & (saturation <= GLARE_SATURATION)).mean())
    return (
        spread / (spread + SHARP), max(0.0, 1.0 - abs(float(g.mean()) - 127.5) / 127.5), max(0.0, 1.0 - clipped * CLIPPED), max(0.0, 1.0 - glare * GLARE),
    )


def measure_pictures(pictures: DataFrame, weights: tuple[float, ...] = (0.4, 0.2, 0.2, 0.2)) -> DataFrame:
    """``(id, hash, sharpness, exposure, highlight_retention, glare_resistance, score)`` of ``pictures(id, width, height,
    rgb)``, rounded to 6 digits; the score is the weighted sum. A picture whose bytes are not ``3 * width * height``, or
    that has a null, has null measures. One narrow pass; pictures are looked at one by one."""
    kind = pictures.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for width, height, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if not width or not height or data is None or len(data) != 3 * width * height:
                    rows.append((None,) * 6)
                    continue
                rgb = np.frombuffer(data, dtype=np.uint8).reshape(height, width, 3)
                q = quality(rgb)
                score = sum(a * b for a, b in zip(q, weights, strict=True))
                rows.append((median_hash_of(grey(rgb)), *(round(x, 6) for x in (*q, min(1.0, max(0.0, score))))))
            columns = [pa.array([r[i] for r in rows], pa.string() if i == 0 else pa.float64()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "hash", *MEASURES, "score"])

    src = pictures.selectExpr("id", "cast(width as int) width", "cast(height as int) height", "rgb")
    return src.mapInArrow(run, f"id {kind}, hash string, " + ", ".join(f"{m} double" for m in (*MEASURES, "score")))
