import random

import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from gridloom.functions.keys import path_key
from gridloom.operators import compaction
from gridloom.operators.compaction import _whole_frames, compact_files, joinable, record_digest, resolved, restored, stored_frame, unframed

FILES = [
    (1, "a/x.png", b"same"), (2, "a/./x.png", b"same"), (3, "b\\..\\a\\x.png", b"same"), (4, "a/x.png", b"other"), (5, "A/x.png", b"same"), (6, "e.bin", b""), (7, None, b"n"), (8, None, b"n"), (9, "null.bin", None),
    (10, "l.jsonl", b'{"a":1}\n{"a":2}'), (11, "m.jsonl", b'{"b":1}\n'), (12, "c.csv", b"h1,h2\n1,2\n"), (13, "d.csv", b"h1,h2\n3,4"), (14, "o.csv", b"other\n5"), (15, "z.zst", zstandard.compress(b"frame")), (16, "bad.zst", zstandard.compress(b"frame")[:-2]),
    (17, "big.bin", b"0123456789" * 50_000), (18, "empty.csv", b""), (19, "plain.csv", b"no newline"), (20, "b/../a/x.png", b"other"),
]


def local(uri):
    return uri.removeprefix("file://")


def test_paths_resolve_as_the_expression_does(spark):
    rng = random.Random(2)
    paths = ["/".join(rng.choice(["a", "B", ".", "..", "", "...", "ż"]) for _ in range(rng.randint(1, 6))).replace("/", rng.choice(["/", "\\"]), rng.randint(0, 3)) for _ in range(400)]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", path_key(F.col("p")).alias("k")).collect()
    assert all(resolved(r["p"]) == r["k"] for r in got)


def test_a_full_filter_only_moves_more_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, f"{i % 700}.png", b"%d" % (i % 700)) for i in range(1000)], "file_id bigint, crop_relative_path string, payload binary")
    for bits in (6, 26):
        c = compact_files(df, folder=str(tmp_path / f"p{bits}"), filter_bits=bits)
        assert c.index.count() == 700 and c.copies().count() == 300 and c.members().count() == 600 and sum(r["wrong"] for r in c.validate().collect()) == 0
        assert (c.files.count() == 1000) == (bits == 6)


def test_many_headers_leave_no_small_packs(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, f"{i}.csv", b"h%d\n%d" % (i % 60, i)) for i in range(600)], "file_id bigint, crop_relative_path string, payload binary").coalesce(1)
    c = compact_files(df, folder=str(tmp_path / "p"))
    assert c.packs().count() <= compaction.OPEN_PACKS + 1 and sum(r["wrong"] for r in c.validate().collect()) == 0 and c.index.count() == 600


def test_the_same_packs_come_out_again(spark, tmp_path):
    df = spark.createDataFrame([(i, f"{i % 90}.png", b"%d" % (i % 90) * 50) for i in range(100)], "file_id bigint, crop_relative_path string, payload binary")
    names = [sorted(r["pack"].rsplit("/", 1)[1] for r in compact_files(df, 1000, folder=str(tmp_path / str(i))).packs().collect()) for i in range(2)]
    assert names[0] == names[1] and len(names[0]) > 3


def test_frames_are_recognised_by_their_headers():
    whole = [zstandard.ZstdCompressor(write_checksum=c, write_content_size=w).compress(d) for d in (b"", b"x", b"ab" * 200_000, bytes(range(256)) * 1000) for c in (0, 1) for w in (0, 1)] + [stored_frame(b"q" * 300_000)]
    skipped = b"\x53\x2a\x4d\x18\x03\x00\x00\x00abc"
    for f in whole:
        assert _whole_frames(f) and _whole_frames(f + whole[0] + skipped + f)
        assert not any(_whole_frames(f[:-k]) for k in range(1, min(len(f), 40))) and not _whole_frames(f + b"x") and not _whole_frames(skipped[:-1])


def test_everything_comes_back_once(spark, tmp_path):
    df = spark.createDataFrame([(*f, "k") for f in FILES], "file_id bigint, crop_relative_path string, payload binary, record string")
    c = compact_files(df, target_bytes=1000, folder=str(tmp_path / "packs"))
    pairs = sorted((r["file_id_a"], r["file_id_b"]) for r in c.copies().collect())
    assert pairs == [(1, 2), (1, 3), (2, 3), (4, 20), (7, 8)]
    index = c.index.collect()
    assert len(index) == len(FILES) - 4
    v = c.validate().collect()
    assert sum(r["records"] for r in v) == len(index) and not any(r["wrong"] for r in v)
    content = dict((i, p or b"") for i, _, p in FILES)
    for r in index:
        with open(local(r["pack"]), "rb") as f:
            header = f.read(r["header_bytes"])
            f.seek(r["pack_offset"])
            data = restored(r["how"], header, f.read(r["stored_bytes"]), r["record_bytes"])
        assert data == content[r["file_id"]] and record_digest(r["path"], data) == bytes(r["record"])
    (tmp_path / "packs" / "pack-lost.zst").write_bytes(b"x")
    assert c.remove_strays() == ["pack-lost.zst"] and sum(r["records"] for r in c.validate().collect()) == len(index)
    frames = next(r["pack"] for r in index if r["how"] == "framed")
    assert unframed(open(local(frames), "rb").read())  # a pack of frames is a zstandard file
    packs = [open(local(p), "rb").read() for p in {r["pack"] for r in index if r["how"] == "headed"}]
    assert all(p.count(p.split(b"\n")[0] + b"\n") == 1 for p in packs)


def test_a_damaged_pack_is_noticed(spark, tmp_path):
    df = spark.createDataFrame([(i, f"{i}.png", bytes([i]) * 9) for i in range(20)], "file_id bigint, crop_relative_path string, payload binary")
    c = compact_files(df, folder=str(tmp_path / "p"))
    r = c.index.where("file_id = 3").first()
    with open(local(r["pack"]), "r+b") as f:
        f.seek(r["pack_offset"] + r["stored_bytes"] - 1)
        f.write(b"\xff")
    assert sum(x["wrong"] for x in c.validate().collect()) == 1


def test_empty_table(spark):
    c = compact_files(spark.createDataFrame([], "file_id bigint, crop_relative_path string, payload binary"))
    assert c.copies().count() == 0 and c.packs().count() == 0 and c.validate().count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from(["x.png", "x.jsonl", "x.csv", "x.zst"]))
def test_joinable_round_trip(data, path):
    how, header, stored = joinable(path, data)
    assert restored(how, header, stored, len(data)) == data


def test_frames_of_all_sizes():
    for n in (0, 1, 255, 256, 65_791, 65_792, 131_072, 131_073, 400_000):
        assert unframed(stored_frame(b"\x28" * n)) == b"\x28" * n
