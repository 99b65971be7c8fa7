"""Detected quadrilaterals against expected ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORNERS = ((0, 0), (1, 0), (1, 1), (0, 1))  # of a unit square, clockwise from the upper left


def grid_quad(position: Column, width: Column, height: Column, rows: int = 3, columns: int = 3) -> Column:
    """The quadrilateral of a place in an even grid of boards on a page."""
    column, row = position % columns, F.floor(position / columns)
    x = lambda c: ((column + c) * width / columns).cast("double")
    y = lambda c: ((row + c) * height / rows).cast("double")
    return F.array(*[F.struct(x(a).alias("x"), y(b).alias("y")) for a, b in CORNERS])


def corner_errors(expected: Column, actual: Column) -> Column:
    """Distances of the four corners, rounded to 4 digits."""
    return F.zip_with(expected, actual, lambda e, a: F.round(F.hypot(e["x"] - a["x"], e["y"] - a["y"]), 4))


def golden_join(golden: DataFrame, detected: DataFrame) -> DataFrame:
    """``golden(image, position, quad, ...)`` with what was ``detected(image, position, id, quad)`` in its place.

    ``matches`` counts the distinct detections of a place; ``status`` is ``matched`` for exactly one of four corners, else
    ``missing`` or ``duplicated``; ``errors`` holds the corner distances of matched places. Rows with a null image or
    position match nothing; a repeated detection of equal id counts once; extra columns of ``golden`` are kept.
    """
    found = detected.where(F.size("quad") == 4).groupBy("image", "position").agg(F.count_distinct("id").alias("matches"), F.min_by("quad", "id").alias("_quad"))
    j = golden.join(found, ["image", "position"], "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    status = F.when(F.col("matches") == 1, "matched").when(F.col("matches") == 0, "missing").otherwise("duplicated")
    return j.withColumn("status", status).withColumn("errors", F.when(F.col("matches") == 1, corner_errors(F.col("quad"), F.col("_quad"))))


def geometry_quality(golden: DataFrame, detected: DataFrame) -> DataFrame:
    """One row over ``golden(image, position, quad, diagonal)``: images, shares of images with any detection and with
    exactly the expected positions, the share of positions found, and the nearest-rank p95 of the corner error as a share
    of the page's diagonal, where each corner of a board that is not matched counts as 1. Shares of nothing are null."""
    j = golden_join(golden, detected)
    extra = detected.select("image", "position").distinct().join(golden.select("image", "position"), ["image", "position"], "left_anti").groupBy("image").agg(F.count("*").alias("extra"))
    any_ = detected.select("image").distinct().withColumn("_any", F.lit(True))
    per = j.groupBy("image").agg(F.count("*").alias("n"), F.count_if(F.col("matches") >= 1).alias("found")).join(extra, "image", "left").join(any_, "image", "left")
    shares = per.agg(
        F.count("*").alias("images"), F.round(F.try_divide(F.count("_any"), F.count("*")), 6).alias("detected_share"),
        F.round(F.try_divide(F.count_if((F.col("n") == F.col("found")) & F.col("extra").isNull()), F.count("*")), 6).alias("expected_share"),
        F.round(F.try_divide(F.sum("found"), F.sum("n")), 6).alias("position_accuracy"),
    )
    share = F.coalesce(F.transform("errors", lambda e: F.round(e / F.col("diagonal"), 6)), F.array_repeat(F.lit(1.0), 4))
    errors = j.select(F.explode(share).alias("error")).agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY error)").alias("p95"))
    return shares.join(errors)  # a row each


def homographies(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """(n x 3 x 3) projective maps that take the four points of ``source`` (n x 4 x 2) to those of ``target``."""
    n = len(source)
    x, y, u, v = source[..., 0], source[..., 1], target[..., 0], target[..., 1]
    a, zero, one = np.zeros((n, 8, 8)), np.zeros_like(x), np.ones_like(x)
    a[:, 0::2] = np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], axis=-1)
    a[:, 1::2] = np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], axis=-1)
    b = np.stack([u, v], axis=-1).reshape(n, 8, 1)
    return np.concatenate([np.linalg.solve(a, b)[..., 0], np.ones((n, 1))], axis=1).reshape(n, 3, 3)


def line_errors(matched: DataFrame, columns: int = 5, rows: int = 3, width: float = 500.0, height: float = 300.0) -> DataFrame:
    """``(image, position, axis, line, error)`` of ``matched(image, position, expected, actual)`` quadrilaterals: how far,
    on a board of ``width`` x ``height``, each inner grid line lies from its place when the board is cut out along the
    actual corners instead of the expected ones; the mean of both ends, rounded to 4 digits. Quadrilaterals that are not
    of four corners, or have no projective map, give no rows."""
    unit = np.array(CORNERS, dtype=np.float64) * [width, height]
    ends = [("vertical", k, np.array([[width * k / columns, 0.0], [width * k / columns, height]])) for k in range(1, columns)]
    ends += [("horizontal", k, np.array([[0.0, height * k / rows], [width, height * k / rows]])) for k in range(1, rows)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            quads = [np.array([[[p["x"], p["y"]] for p in q] for q in batch.column(i).to_pylist()], dtype=np.float64).reshape(-1, 4, 2) for i in (2, 3)]
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            board = np.broadcast_to(unit, quads[0].shape)
            for i, (image, position) in enumerate(keys):
                try:
                    there = homographies(board[i : i + 1], quads[0][i : i + 1])[0]
                    back = homographies(quads[1][i : i + 1], board[i : i + 1])[0]
                except np.linalg.LinAlgError:
                    continue
                for axis, k, points in ends:
                    p = (back @ there @ np.column_stack([points, np.ones(2)]).T).T
                    if not np.all(np.abs(p[:, 2]) > 1e-12):
                        continue
                    at = 0 if axis == "vertical" else 1
                    wrong = np.round(np.abs(p[:, at] / p[:, 2] - points[:, at]), 4)
                    out.append((image, position, axis, k, round(float(wrong.mean()), 4)))
            types = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["image", "position", "axis", "line", "error"])

    full = lambda c: (F.size(c) == 4) & F.forall(c, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    src = matched.where(full("expected") & full("actual")).select("image", F.col("position").cast("int"), "expected", "actual")
    return src.mapInArrow(run, "image string, position int, axis string, line int, error double")
