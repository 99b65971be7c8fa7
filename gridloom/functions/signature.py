"""Fixed-width signatures of boards as Column expressions.

A signature is the concatenation of zero-padded decimal cells. It is an equality key, and a prefix of whole cells is
a prefix of the string, so prefix search is a pushed-down ``startswith``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CODE = 32_767


def cell_width(max_code: int) -> int:
    """Digits that the largest code needs."""
    if not 1 <= max_code <= MAX_CODE:
        raise ValueError(f"codes are 1..{MAX_CODE}")
    return len(str(max_code))


def encode_signature(cells: Column, width: int) -> Column:
    """Null for null or empty boards, null cells and codes outside of 1..32767 or wider than ``width``."""
    ok = (F.size(cells) > 0) & F.forall(cells, lambda c: F.coalesce(c.between(1, min(MAX_CODE, 10**width - 1)), F.lit(False)))
    return F.when(ok, F.concat_ws("", F.transform(cells, lambda c: F.lpad(c.cast("string"), width, "0"))))


def encode_prefix(cells: Column, width: int) -> Column:
    """The signature of the cells before the first null; null where a value follows a null (no prefix board)."""
    holes = F.size(F.filter(cells, lambda c: c.isNull()))
    filled = F.slice(cells, 1, F.size(cells) - holes)
    ok = F.forall(filled, lambda c: F.coalesce(c.between(1, min(MAX_CODE, 10**width - 1)), F.lit(False)))
    return F.when(ok, F.concat_ws("", F.transform(filled, lambda c: F.lpad(c.cast("string"), width, "0"))))


def decode_signature(signature: Column, width: int, cells: int | None = None) -> Column:
    """The cells; null for other than ASCII digits, a broken width, a zero cell or a wrong number of cells."""
    n = F.length(signature) / width
    out = F.when(F.length(signature) == 0, F.array().cast("array<int>")).otherwise(
        F.transform(F.sequence(F.lit(0), (F.greatest(n, F.lit(1)) - 1).cast("int")), lambda i: F.substring(signature, i * width + 1, F.lit(width)).cast("int"))
    )
    ok = signature.rlike(rf"^(?:[0-9]{{{width}}})*\z")
    out = F.when(ok, out)
    good = F.forall(out, lambda c: c.between(1, MAX_CODE))
    if cells is not None:
        good = good & (F.size(out) == cells)
    return F.when(good, out)


def cyclic_next(sequence: Column, count: Column | int, steps: Column | int = 1) -> Column:
    """The place ``steps`` after ``sequence`` in a cycle of ``count`` places that begins with 1."""
    n = F.lit(count) if isinstance(count, int) else count
    k = F.lit(steps) if isinstance(steps, int) else steps
    return F.pmod(sequence - 1 + k, n) + 1
