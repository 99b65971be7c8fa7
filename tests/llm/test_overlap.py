import random

import numpy as np
import pytest

from gridloom.llm.overlap import Shingles, cross_split_overlap, near_pairs
from tests.conftest import rows

SCHEMA = "sample_id string, split_name string, source_group string, crop_checksum_sha256 string, source_image_checksum_sha256 string, board_index int, cell_index int, crop_fingerprint string, hi string, DIGEST string"


def frame(spark, data):
    return spark.createDataFrame([(*d, "x", "y") for d in data], SCHEMA)


def made_up(seed, n=150):
    rng = random.Random(seed)
    bases = [rng.getrandbits(128) for _ in range(8)] + [0]
    out = []
    for i in range(n):
        f = rng.choice(bases)
        for _ in range(rng.randrange(10)):
            f ^= 1 << rng.randrange(128)
        f = f"{f:032x}"
        d = f"{rng.randrange(60):064x}"
        out.append((
            f"s{rng.randrange(n)}", rng.choice(["train", "TRAIN ", "validation", "test", "Test", None, "other"]), rng.choice(["g", "h ", None]), rng.choice([d, d.upper(), f"sha256:{d}", f" {d}\t", None, ""]),
            rng.choice([f"{rng.randrange(20):064x}", None]), rng.choice([0, 1, None]), rng.choice([0, 1, None]), rng.choice([f, f.upper(), None, "", f[:-1], "zz" * 16]) if rng.random() < 0.5 else f))
    return out


def plain(data, most=6):
    digest = lambda d: (lambda x: x[7:] if x.startswith("sha256:") else x)((d or "").strip().lower()) or None
    keys = []
    for s, split, _, d, i, b, c, f in data:
        f = (f or "").strip().lower()
        ok = len(f) == 32 and all(x in "0123456789abcdef" for x in f)
        keys.append((s, (split or "").strip().lower(), digest(d), (digest(i), b, c) if None not in (digest(i), b, c) else None, int(f, 16) if ok else None))
    out = set()
    for a in keys:
        for b in keys:
            if a[1] == "train" and b[1] in ("validation", "test") and a[0] != b[0]:
                if (a[2] and a[2] == b[2]) or (a[3] and a[3] == b[3]) or (a[4] is not None and b[4] is not None and (a[4] ^ b[4]).bit_count() <= most):
                    out.add((min(a[0], b[0]), max(a[0], b[0])))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    data = made_up(seed)
    assert rows(cross_split_overlap(frame(spark, data)).pairs()) == plain(data)


def test_other_distances(spark):
    data = made_up(5, 80)
    for most in (0, 3, 7, 12):
        assert rows(cross_split_overlap(frame(spark, data), most).pairs()) == plain(data, most)
    with pytest.raises(ValueError):
        cross_split_overlap(frame(spark, data), 21)


def test_many_fingerprints_at_a_larger_distance(spark):
    rng = np.random.default_rng(3)
    bases = rng.integers(-(2**63), 2**63, (60, 2))
    near = np.repeat(bases, 100, axis=0)
    for _ in range(5):
        at = rng.integers(0, 128, len(near))
        near[np.arange(len(near)), at // 64] ^= np.left_shift(np.int64(1), at % 64)
    side = lambda x: spark.createDataFrame([(int(h), int(l)) for h, l in x], "hi bigint, lo bigint")
    e, t = near[:3000], near[3000:]
    t = np.concatenate([t, e[:200], [[0, 0]]])
    u, v = np.unique(e, axis=0), np.unique(t, axis=0)
    far = np.bitwise_count((u[:, None, :] ^ v[None, :, :]).view(np.uint64)).sum(-1)
    want = sorted((*map(int, u[i]), *map(int, v[j])) for i, j in zip(*np.nonzero(far <= 7), strict=True))
    assert len(want) > 200 and rows(near_pairs(side(e), side(t), 7)) == sorted(want, key=repr)


@pytest.mark.parametrize("distance", range(0, 21))
def test_fingerprints_within_the_distance_share_enough_of_the_prefix(distance):
    kind, rng = Shingles(distance), np.random.default_rng(distance)
    x = rng.integers(-(2**63), 2**63, (200, 2))
    y = x.copy()
    for i in range(len(y)):
        for at in rng.choice(128, distance, replace=False):
            y[i, at // 64] ^= np.left_shift(np.int64(1), np.int64(at % 64))
    a, b = (kind.codes(z[:, 0].copy(), z[:, 1].copy()) for z in (x, y))
    assert ((a == b).sum(1) >= kind.blocks - distance).all() and (a < kind.blocks << 16).all() and 1 <= kind.prefix <= kind.size
    bits = [128 // kind.blocks + (i < 128 % kind.blocks) for i in range(kind.blocks)]
    whole = [int(np.uint64(h)) << 64 | int(np.uint64(l)) for h, l in x.view(np.uint64)]
    for row, value in zip(a, whole, strict=True):
        again = 0
        for i, w in enumerate(bits):
            again = again << w | int(row[i]) - (i << 16)
        assert again == value


def test_report(spark):
    d, e, f = "a" * 64, "b" * 64, "0" * 32
    data = [("t1", "train", "g", d, None, None, None, f), ("v1", "validation", "G", d, None, None, None, None), ("v2", "validation", "g", e, None, None, None, "0" * 31 + "7"), ("v2", "validation", "g", e, None, None, None, "0" * 31 + "7"),
            ("v3", "validation", None, None, None, None, None, None), ("x1", "test", "g", None, None, None, None, "f" * 32)]
    got = {(r["split_name"], r["source_group"]): tuple(r)[2:] for r in cross_split_overlap(frame(spark, data)).report().collect()}
    assert got == {("validation", "g"): (2, 1, 0, 1, 2), ("validation", None): (1, 0, 0, 0, 0), ("test", "g"): (1, 0, 0, 0, 0)}


def test_many_copies_of_one_fingerprint_are_joined_once(spark):
    f = "0123456789abcdef" * 2
    data = [(f"t{i}", "train", "g", None, None, None, None, f) for i in range(30)] + [(f"v{i}", "test", "g", None, None, None, None, f) for i in range(20)]
    o = cross_split_overlap(frame(spark, data))
    assert o.near.count() == 1 and o.pairs().count() == 600


def test_empty(spark):
    o = cross_split_overlap(frame(spark, []))
    assert o.pairs().count() == 0 and o.report().count() == 0
