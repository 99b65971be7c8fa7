"""Column expressions that bring names, digests and fingerprints to one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c "
PLACEHOLDERS = ("", "unknown", "n/a")


def bare(c: Column) -> Column:
    """Lower case without surrounding blanks."""
    return F.lower(F.btrim(c, F.lit(BLANKS)))


def name_key(c: Column) -> Column:
    """:func:`bare`, and null for null, blank and placeholder names, which stand for nothing."""
    b = bare(c)
    return F.when(b.isin(*PLACEHOLDERS), None).otherwise(b)


def digest_key(c: Column) -> Column:
    """A digest without blanks, letter case and a leading ``sha256:``; null and blank are null."""
    b = bare(F.regexp_replace(bare(c), "^sha256:", ""))
    return F.when(b == "", None).otherwise(b)


def digest_bytes(c: Column) -> Column:
    """:func:`digest_key` packed: 32 bytes of a SHA-256, and other spellings as they are behind a zero byte. What is spelt
    plainly is packed as it stands."""
    k = digest_key(c)
    other = F.when(k.rlike("^[0-9a-f]{64}$"), F.unhex(k)).otherwise(F.concat(F.lit(b"\x00"), F.encode(k, "UTF-8")))
    return F.when((F.length(c) == 64) & c.rlike(r"^[0-9a-f]{64}\z"), F.unhex(c)).otherwise(other)


def hex_word(c: Column, start: int, digits: int) -> Column:
    """``digits`` (at most 15) hex digits from ``start`` (1-based) as a bigint."""
    return F.conv(F.substring(c, start, digits), 16, 10).cast("bigint")


def fingerprint_words(c: Column) -> tuple[Column, Column]:
    """(high, low) 64 bits of a fingerprint of 32 hex digits; nulls where it is anything else."""
    f = bare(c)
    ok = f.rlike("^[0-9a-f]{32}$")

    def word(start: int) -> Column:
        return F.when(ok, F.shiftleft(hex_word(f, start, 8), 32).bitwiseOR(hex_word(f, start + 8, 8)))

    return word(1), word(17)


def path_key(c: Column) -> Column:
    r"""The place a path leads to: ``\`` read as ``/``; empty, ``.`` and ``..`` segments resolved; case kept.

    ``..`` at the root stays there. The common case, a path without such segments, takes no loop.
    """
    p = F.translate(c, "\\", "/")
    plain = ~p.rlike(r"(^|/)\.{0,2}(/|$)")
    resolved = F.aggregate(
        F.split(p, "/"), F.array().cast("array<string>"),
        lambda done, s: F.when((s == "") | (s == "."), done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))),
    )
    return F.when(plain, p).otherwise(F.array_join(resolved, "/"))
