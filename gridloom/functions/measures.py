"""Distances, information measures and guards as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE_INTEGER = 2**53 - 1


def safe(value: Column, what: str = "value") -> Column:
    """``value``, or an error where it leaves the integers that a double holds exactly."""
    return F.when(F.abs(value) > SAFE_INTEGER, F.raise_error(F.lit(f"{what} is outside of the safe integers"))).otherwise(value)


def hex_distance(a: Column, b: Column, digits: int) -> Column:
    """Share of differing bits of two hex strings of ``digits`` digits; 1 where the lengths differ."""
    step = 15
    starts = range(1, digits + 1, step)
    piece = lambda c, i: F.conv(F.substring(c, i, min(step, digits - i + 1)), 16, 10).cast("bigint")
    bits = sum((F.bit_count(piece(a, i).bitwiseXOR(piece(b, i))) for i in starts), F.lit(0))
    fits = (F.length(a) == digits) & (F.length(b) == digits)
    return F.when(fits, bits / F.lit(float(4 * digits))).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.lit(1.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def mean_abs_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference, at most 1; 1 for empty vectors and different lengths."""
    same = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(same, F.least(F.lit(1.0), total / F.size(a))).otherwise(F.lit(1.0))


def softmax(a: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp((x - top) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def entropy(p: Column) -> Column:
    """Entropy divided by its maximum; 0 for fewer than two classes."""
    h = F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.ln(F.greatest(x, F.lit(1e-15)))).otherwise(0.0))
    return F.when(F.size(p) > 1, h / F.ln(F.size(p).cast("double"))).otherwise(F.lit(0.0))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence to base 2."""
    m = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    kl = lambda a: F.aggregate(F.zip_with(a, m, lambda x, y: F.when(x > 0, x * F.log2(x / y)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return (kl(p) + kl(q)) / 2


def wilson_lower(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of the Wilson interval of a share; 0 without observations."""
    p = hits / n
    z2 = z * z
    centre, spread = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return F.when(n > 0, F.greatest(F.lit(0.0), (centre - spread) / (1 + z2 / n))).otherwise(F.lit(0.0))


def natural_key(name: Column, digits: int = 12) -> Column:
    """Sort key in which runs of digits compare as numbers and text without case. Longer ones than ``digits`` come after
    those, by their length and then their digits."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), 1)

    def number(p: Column) -> Column:
        n = F.ltrim(p, F.lit("0"))
        return F.when(F.length(n) <= digits, F.lpad(n, digits, "0")).otherwise(F.concat(F.lit(":"), F.lpad(F.length(n).cast("string"), 10, "0"), n))

    return F.concat_ws("", F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), number(p)).otherwise(p)))


def set_digest(row: Column) -> Column:
    """Aggregates of a digest of all rows that does not depend on their order: the SHA-256 of each row's text is cut into
    five numbers, which are summed; the sums and the count are hashed again. Sums have partial steps, so no rows are
    brought together."""
    h = F.sha2(row, 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(5)]
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), *parts), 256)
