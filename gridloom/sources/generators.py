"""Generated layouts."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def affine_layouts(spark: SparkSession, count: int, symbols: int = 11, cells: int = 15, factor: int = 1_234_567_891_011, offset: int = 987_654_321) -> DataFrame:
    """Boards by number: the digits to base ``symbols`` of ``(factor * (n - 1) + offset) mod symbols ** cells``.

    Any row can be made alone, and with a factor that shares no divisor with ``symbols`` no two boards are equal. The
    product needs more than 64 bits, so it is a decimal of 38 digits.
    """
    big = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    code = ((F.col("id") - 1).cast("decimal(19,0)") * F.lit(str(factor)).cast("decimal(18,0)") + F.lit(str(offset)).cast("decimal(18,0)")) % big(symbols**cells)
    rows = spark.range(1, count + 1).select(F.col("id").alias("sequence_number"), code.cast("bigint").alias("code"))
    digit = lambda i: (F.expr(f"code div {symbols ** (cells - 1 - i)}L") % symbols + 1).cast("int")
    return rows.select("sequence_number", F.array(*[digit(i) for i in range(cells)]).alias("cells"))


def mock_layouts(spark: SparkSession, seed: int, symbols: int = 11, cells: int = 15, count: int = 1000, repeated: int = 6) -> DataFrame:
    """``count`` boards of a seeded sequence, the last ``repeated`` equal to the ones from 101 on, all others
    different. The generator is sequential, so the (few) rows are made on the driver."""
    rng, seen, rows = random.Random(seed), set(), []
    while len(rows) < count - repeated:
        board = tuple(rng.randint(1, symbols) for _ in range(cells))
        if board not in seen:
            seen.add(board)
            rows.append(board)
    rows += [rows[100 + i] for i in range(repeated)]
    return spark.createDataFrame([(i + 1, list(b)) for i, b in enumerate(rows)], "sequence_number bigint, cells array<int>")
