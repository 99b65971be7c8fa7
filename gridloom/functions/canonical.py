"""Canonical JSON, codes and perceptual hashes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(fields: dict[str, Column]) -> Column:
    """One JSON object with its keys in order, no blanks and nulls written out. Values may be objects of this kind given as
    nested dictionaries. Strings are written as they are, so the digest is the same in every engine for ASCII only."""

    def built(value: Column | dict) -> Column:
        return F.struct(*[built(value[k]).alias(k) for k in sorted(value)]) if isinstance(value, dict) else value

    return F.to_json(built(fields), {"ignoreNullFields": "false"})


def job_key(job_type: Column, game: Column, payload: dict[str, Column]) -> Column:
    """The SHA-256 by which a job is known: requests of equal type, game and payload are one job."""
    return F.sha2(canonical_json({"jobType": job_type, "gameId": game, "inputPayload": payload}), 256)


def code_base(value: Column, index: Column) -> Column:
    """A code from a name: other characters become ``_``; without any, ``SYMBOL_`` and the index."""
    base = F.substring(F.btrim(F.regexp_replace(F.trim(value), "[^A-Za-z0-9_-]", "_"), F.lit("_-")), 1, 56)
    return F.when(base == "", F.format_string("SYMBOL_%02d", index.cast("int"))).otherwise(base)


def proper_name(value: Column) -> Column:
    """A name from a code: ``_`` and ``-`` are blanks, words begin with a capital."""
    return F.initcap(F.trim(F.regexp_replace(value, "[_-]+", " ")))


def median_hash(pixels: Column) -> Column:
    """64 hex digits of 256 grey values: a bit is set where the value is above the median of all. Null for another number
    of values."""
    # Named once in an array of one row: a lambda's value is not worked out again for every use.
    one = F.array(F.struct(pixels.alias("p"), F.array_sort(pixels).alias("o")))
    one = F.transform(one, lambda x: F.struct(x["p"].alias("p"), ((F.get(x["o"], F.lit(127)) + F.get(x["o"], F.lit(128))) / 2).alias("m")))
    bits = F.transform(one, lambda x: F.transform(x["p"], lambda v: F.when(v > x["m"], 1).otherwise(0)))
    at = lambda b, i: F.get(b, i)
    digit = lambda b, j: F.lower(F.hex(at(b, j * 4) * 8 + at(b, j * 4 + 1) * 4 + at(b, j * 4 + 2) * 2 + at(b, j * 4 + 3)))
    text = F.transform(bits, lambda b: F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: digit(b, j))))
    return F.when(F.size(pixels) == 256, F.get(text, F.lit(0)))
