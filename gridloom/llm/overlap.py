"""Records of evaluation splits that are, exactly or almost, in the training split too.

Three kinds of link tie an evaluation sample to a training sample: the same crop digest, the same place (image
digest, board, cell), or fingerprints that differ in few bits. The first two are equalities. The third is an exact
prefix-filter join. A fingerprint of 128 bits is cut into ``B`` blocks, and its shingles are the pairs of blocks with
their positions. Within a distance of ``d`` at least ``B - d`` blocks agree, so at least ``(B - d)(B - d - 1) / 2`` of
the ``B (B - 1) / 2`` shingles do, and both fingerprints, sorted from rare to frequent, share one of a prefix that
leaves out one shingle less than these. ``B`` follows from the distance asked for and from nothing else, so the join
works in the same way at every size: for ``d = 6`` there are 9 blocks and shingles of 28 to 30 bits, of which the 34
rarest of 36 are the prefix, so a shingle that very many fingerprints share is met only by those that have little else.

How rare a shingle is is told by how often its two blocks occur, from a table of at most ``B * 2**16`` counters. The
evaluation side's prefixes are the index, the training side probes it, the length filter keeps fingerprints of one
length together (others have no distance), the position filter drops meetings after which too few shingles are left,
and the distance itself decides. Nothing is lost: the filters are implied by the distance. Fingerprints are joined once
each, however many samples carry them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.keys import bare, digest_bytes, fingerprint_words
from gridloom.runtime import cut, pick

BITS, BLOCK_BITS = 128, 16
MOST_DISTANCE = 20  # beyond it shingles would be too short to tell fingerprints apart
EVALUATION = ("validation", "test")


@dataclass(frozen=True)
class Overlap:
    """``samples``: the rows with normalised keys. ``near``: pairs of distinct fingerprints (e_hi, e_lo, t_hi, t_lo)
    of the evaluation and the training side; the fingerprints of ``samples`` are the membership."""

    samples: DataFrame
    near: DataFrame

    def pairs(self) -> DataFrame:
        """``(sample_id_a, sample_id_b)``, each pair of different samples once, the smaller id first."""
        e = self.samples.where("is_eval").select("sample_id", "digest", "place", "hi", "lo")
        t = self.samples.where("is_train").select("sample_id", "digest", "place", "hi", "lo")

        def keyed(side: DataFrame, name: str) -> DataFrame:
            keys = F.array(F.struct(F.lit(0).alias("kind"), F.col("digest").alias("key")), F.struct(F.lit(1).alias("kind"), F.col("place").alias("key")))
            return side.select(F.col("sample_id").alias(name), F.explode(keys).alias("k")).select(name, "k.kind", "k.key").where("key is not null").distinct()

        # Only keys that both sides have can make a pair: their 8-byte hashes are compared before the ids move.
        both = self.samples.select("is_eval", "is_train", F.explode(F.array(F.xxhash64(F.lit(0), "digest"), F.xxhash64(F.lit(1), "place"))).alias("h"))
        both = both.groupBy("h").agg(F.bool_or("is_eval").alias("e"), F.bool_or("is_train").alias("t")).where("e and t").select("h")
        both = cut(both, "overlap-keys")
        shared = lambda side, name: keyed(side, name).withColumn("h", F.xxhash64("kind", "key")).join(both, "h", "left_semi")
        exact = shared(e, "a").join(shared(t, "b"), ["h", "kind", "key"]).select("a", "b")
        ids = self.samples.where("hi is not null")
        left = ids.where("is_eval").select(F.col("sample_id").alias("a"), F.col("hi").alias("e_hi"), F.col("lo").alias("e_lo")).distinct()
        right = ids.where("is_train").select(F.col("sample_id").alias("b"), F.col("hi").alias("t_hi"), F.col("lo").alias("t_lo")).distinct()
        almost = self.near.join(left, ["e_hi", "e_lo"]).join(right, ["t_hi", "t_lo"]).select("a", "b")
        return exact.unionByName(almost).where("a <> b").select(F.least("a", "b").alias("sample_id_a"), F.greatest("a", "b").alias("sample_id_b")).distinct()

    def report(self) -> DataFrame:
        """A row for each evaluation split and source group: samples, and how many of them have a link of each kind.

        No pair of samples is formed: an evaluation sample is looked up by its keys. A link to another row of the
        same sample id counts as well: that sample is in both splits.
        """
        train = self.samples.where("is_train")
        e = self.samples.where("is_eval").select("sample_id", "split", "source_group", "digest", "place", "hi", "lo").distinct()
        has = lambda keys, name: keys.distinct().withColumn(name, F.lit(True))
        e = e.join(has(train.select("digest").where("digest is not null"), "same_crop"), "digest", "left")
        e = e.join(has(train.select("place").where("place is not null"), "same_place"), "place", "left")
        e = e.join(has(self.near.select(F.col("e_hi").alias("hi"), F.col("e_lo").alias("lo")), "near_crop"), ["hi", "lo"], "left")
        flags = ["same_crop", "same_place", "near_crop"]
        one = e.groupBy("split", "source_group", "sample_id").agg(*[F.coalesce(F.bool_or(x), F.lit(False)).alias(x) for x in flags])
        return one.groupBy(F.col("split").alias("split_name"), "source_group").agg(
            F.count("*").alias("samples"), *[F.count_if(F.col(x)).alias(x) for x in flags], F.count_if(F.greatest(*flags)).alias("overlapping"),
        )


def cross_split_overlap(samples: DataFrame, max_distance: int = 6) -> Overlap:
    """Find all links between the training rows and the validation and test rows of ``samples``.

    Defined results: null or blank digests and fingerprints, places with a null part and null splits match
    nothing; a fingerprint that is not 32 hex digits has no distance to any other; a sample whose rows lie in
    several splits is on both sides, but not paired with itself; repeated rows change nothing; rows with a null
    sample id are left out, as no pair can name them; empty tables give empty results; columns beyond those read
    are ignored.
    """
    if not 0 <= max_distance <= MOST_DISTANCE:
        raise ValueError(f"max_distance must be in 0..{MOST_DISTANCE}")
    samples = pick(samples, "sample_id", "split_name", "source_group", "crop_checksum_sha256", "source_image_checksum_sha256", "board_index", "cell_index", "crop_fingerprint")
    split = bare(F.col("split_name"))
    image = digest_bytes(F.col("source_image_checksum_sha256"))
    place = F.when(image.isNotNull() & F.col("board_index").isNotNull() & F.col("cell_index").isNotNull(), F.concat(F.encode(F.concat_ws("/", "board_index", "cell_index", F.lit("")), "UTF-8"), image))
    hi, lo = fingerprint_words(F.col("crop_fingerprint"))
    norm = samples.where(F.col("sample_id").isNotNull() & split.isin("train", *EVALUATION)).select(
        "sample_id", split.alias("split"), bare(F.col("source_group")).alias("source_group"), digest_bytes(F.col("crop_checksum_sha256")).alias("digest"), place.alias("place"), hi.alias("hi"), lo.alias("lo"),
        (split == "train").alias("is_train"), split.isin(*EVALUATION).alias("is_eval"),
    )
    norm = cut(norm, "overlap-samples")
    return Overlap(norm, cut(near_pairs(norm.where("is_eval"), norm.where("is_train"), max_distance), "overlap-near"))


@dataclass(frozen=True)
class Shingles:
    """The blocks and shingles for a distance."""

    max_distance: int

    @property
    def blocks(self) -> int:
        return max(BITS // BLOCK_BITS, self.max_distance + 3)

    @property
    def size(self) -> int:
        return comb(self.blocks, 2)

    @property
    def shared(self) -> int:
        """How many shingles two fingerprints within the distance share at least."""
        return comb(self.blocks - self.max_distance, 2)

    @property
    def prefix(self) -> int:
        return self.size - self.shared + 1

    def codes(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """(fingerprints x blocks): position and value of each block as one number."""
        hi, lo = hi.view(np.uint64), lo.view(np.uint64)
        out = np.empty((len(hi), self.blocks), dtype=np.int64)
        start = 0
        for i in range(self.blocks):
            width = BITS // self.blocks + (i < BITS % self.blocks)
            end = start + width
            if end <= 64:
                value = hi >> np.uint64(64 - end)
            elif start >= 64:
                value = lo >> np.uint64(BITS - end)
            else:
                value = (hi << np.uint64(end - 64)) | (lo >> np.uint64(BITS - end))
            out[:, i] = (value & np.uint64((1 << width) - 1)).astype(np.int64) + (i << BLOCK_BITS)
            start = end
        return out


def _block_counts(prints: DataFrame, kind: Shingles) -> tuple[np.ndarray, np.ndarray]:
    """How many fingerprints of the evaluation side, and of both sides, have each block."""
    n = kind.blocks << BLOCK_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, n), dtype=np.int64)
        for batch in batches:
            side, hi, lo = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            code = kind.codes(hi, lo)
            counts[0] += np.bincount(code[side == 1].ravel(), minlength=n)
            counts[1] += np.bincount(code.ravel(), minlength=n)
        there = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(counts[0][there]), pa.array(counts[1][there])], names=["block", "e", "n"])

    got = prints.mapInArrow(run, "block int, e bigint, n bigint").groupBy("block").agg(F.sum("e").alias("e"), F.sum("n").alias("n")).toArrow()  # at most B * 2**16 rows
    out = np.zeros((2, n), dtype=np.int64)
    out[:, got["block"].to_numpy()] = got["e"].to_numpy(), got["n"].to_numpy()
    return out[0], out[1]


def _prefixes(prints: DataFrame, kind: Shingles, counts) -> DataFrame:
    """``(hi, lo, at, shingle)``: the prefix of each fingerprint, from rare to frequent, with 1-based places. Shingles
    with a block that no evaluation fingerprint has keep their places but do not come out."""
    first, second = np.array(list(combinations(range(kind.blocks), 2))).T
    length = kind.prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, n = counts.value
        often = n.astype(np.float64)
        for batch in batches:
            hi, lo = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            code = kind.codes(hi, lo)
            a, b = code[:, first], code[:, second]
            order = np.lexsort((b, a, often[a] * often[b]), axis=1)[:, :length]
            a, b = np.take_along_axis(a, order, 1), np.take_along_axis(b, order, 1)
            shingle = np.where((e[a] > 0) & (e[b] > 0), (a << 32) | b, -1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, shingle.size + 1, length), pa.int32()), pa.array(shingle.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], names=["hi", "lo", "shingles"])

    out = prints.mapInArrow(run, "hi bigint, lo bigint, shingles array<bigint>")
    return out.select("hi", "lo", F.posexplode("shingles").alias("at", "shingle")).where("shingle >= 0").select("hi", "lo", (F.col("at") + 1).cast("int").alias("at"), "shingle")


def near_pairs(evaluation: DataFrame, training: DataFrame, max_distance: int = 6) -> DataFrame:
    """``(e_hi, e_lo, t_hi, t_lo)``: all pairs of distinct fingerprints within ``max_distance`` bits."""
    kind = Shingles(max_distance)
    e = cut(evaluation.where("hi is not null").select("hi", "lo").distinct(), "overlap-eval-fingerprints")
    t = cut(training.where("hi is not null").select("hi", "lo").distinct(), "overlap-train-fingerprints")
    both = e.select(F.lit(1).alias("side"), "hi", "lo").unionByName(t.select(F.lit(0).alias("side"), "hi", "lo"))
    counts = e.sparkSession.sparkContext.broadcast(_block_counts(both, kind))
    a, b = _prefixes(e, kind, counts).alias("a"), _prefixes(t, kind, counts).alias("b")
    possible = F.lit(1) + F.least(F.lit(kind.size) - F.col("a.at"), F.lit(kind.size) - F.col("b.at")) >= F.lit(kind.shared)
    distance = F.bit_count(F.col("a.hi").bitwiseXOR(F.col("b.hi"))) + F.bit_count(F.col("a.lo").bitwiseXOR(F.col("b.lo")))
    met = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & possible & (distance <= max_distance))
    return met.select(F.col("a.hi").alias("e_hi"), F.col("a.lo").alias("e_lo"), F.col("b.hi").alias("t_hi"), F.col("b.lo").alias("t_lo")).distinct()
