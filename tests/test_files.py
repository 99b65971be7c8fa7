"""Files found, attested and published."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from gridloom.sources.files import attest_files, discover_images, jpeg_size, publish_curated, write_files
from tests.conftest import rows


def jpeg(width, height, note=b""):
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x01\x01\x11\x00\xff\xfe" + (len(note) + 2).to_bytes(2, "big") + note + b"\xff\xd9"


def test_discovery(spark, tmp_path):
    a, b = jpeg(30, 20), jpeg(5, 6, b"b")
    files = {"x/B.JPG": a, "x/a.jpeg": a, "C.jpg": b, "y/z/broken.jpg": b"no", "y/empty.jpg": b"", "p.Png": a, "notes.txt": b"t", ".jpg": a, "no_extension": a, "y/d.jpg": a}
    write_files(spark.createDataFrame(list(files.items()), "path string, content binary"), str(tmp_path / "root"))
    images, issues, ignored = discover_images(spark, str(tmp_path / "root"))
    got = {r["sha256"]: (r["width"], r["height"], r["files"]) for r in images.collect()}
    assert got == {hashlib.sha256(a).hexdigest(): (30, 20, ["x/a.jpeg", "x/B.JPG", "y/d.jpg"]), hashlib.sha256(b).hexdigest(): (5, 6, ["C.jpg"])}
    assert rows(issues) == [("p.Png", "IMAGE_SOURCE_FORMAT_UNSUPPORTED"), ("y/empty.jpg", "IMAGE_SOURCE_UNREADABLE"), ("y/z/broken.jpg", "IMAGE_SOURCE_UNREADABLE")]
    assert ignored.first()["n"] == 2  # hidden files are none for the scan


@pytest.mark.parametrize("data", [b"", b"\xff\xd8", jpeg(1, 1)[:14], b"\xff\xd8\xff\xd9", b"\xff\xd8\xff\xe0\x00\x01", jpeg(0, 4), b"\x89PNG"])
def test_what_is_no_jpeg_has_no_size(data):
    assert jpeg_size(data) is None


def test_attest(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "a.csv").write_bytes(b"x" * 100)
    (tmp_path / "in" / "big.jsonl").write_bytes(b"x" * 101)
    (tmp_path / "in" / "none.csv").write_bytes(b"")
    (tmp_path / "out.csv").write_bytes(b"secret")
    os.makedirs(tmp_path / "in" / "dir.csv")
    paths = ["sub/a.csv", "big.jsonl", "none.csv", "../out.csv", "sub/../../out.csv", "/etc/passwd.csv", "a\\b.csv", "x.txt", "gone.csv", "dir.csv", "", None, "sub/a.csv", "csv"]
    got = [tuple(r) for r in attest_files(spark.createDataFrame([(p,) for p in paths], "path string"), str(tmp_path / "in"), 100).collect()]
    by = {p: r for p, *r in got}
    assert by["sub/a.csv"] == ["csv", 100, hashlib.sha256(b"x" * 100).hexdigest(), None] and len(got) == len(paths)
    assert by["big.jsonl"][3] == "IMPORT_SOURCE_TOO_LARGE" and by["none.csv"][3] == "IMPORT_SOURCE_EMPTY" and by["gone.csv"][3] == by["dir.csv"][3] == "IMPORT_SOURCE_NOT_FOUND"
    assert all(by[p][3] == "IMPORT_SOURCE_PATH_INVALID" for p in ("../out.csv", "sub/../../out.csv", "/etc/passwd.csv", "a\\b.csv", "", None)) and by["x.txt"][3] == by["csv"][3] == "IMPORT_SOURCE_FORMAT_UNSUPPORTED"


def test_curated_pictures_are_published_once(spark, tmp_path):
    data = [(i * 9 + 1, i * 9 + 9, b"page %d" % i) for i in range(12)]
    df = spark.createDataFrame(data, "range_start bigint, range_end bigint, content binary").withColumn("sha256", F.sha2("content", 256))
    first, again = (publish_curated(df.repartition(k), str(tmp_path / "out")) for k in (1, 3))
    assert first == again and len(os.listdir(tmp_path / "out")) == 1
    folder = first.removeprefix("file://")
    for r in spark.read.parquet(f"{first}/manifest").collect():
        with open(f"{folder}/images/{r['name']}", "rb") as f:
            assert hashlib.sha256(f.read()).hexdigest() == r["sha256"]
    assert "seq_000001-000009__" in " ".join(os.listdir(f"{folder}/images"))
    with pytest.raises(ValueError, match="more than once"):
        publish_curated(df.unionByName(df.limit(1)), str(tmp_path / "out"))
    with pytest.raises(ValueError, match="nothing"):
        publish_curated(df.limit(0), str(tmp_path / "out"))
    with pytest.raises(Exception, match="differs"):
        publish_curated(df.withColumn("sha256", F.sha2(F.lit("x"), 256)), str(tmp_path / "out"))
    assert len(os.listdir(tmp_path / "out")) == 1


def test_device_snapshots(spark, tmp_path):
    import sqlite3

    from gridloom.operators.boards import Game
    from gridloom.sources.snapshots import read_snapshot, validate_snapshot, write_snapshot

    rows_ = [(i, f"{i % 11 + 1:02d}" * 15, i % 7) for i in range(1, 60)]
    df = spark.createDataFrame(rows_, "sequence_number bigint, signature string, payout bigint").repartition(5)
    path = str(tmp_path / "s" / "a.sqlite")
    write_snapshot(df, path, Game())
    assert rows(read_snapshot(spark, path)) == sorted(rows_, key=repr)
    facts = validate_snapshot(spark, path).first().asDict()
    assert facts["valid"] and (facts["layouts"], facts["first"], facts["last"]) == (59, 1, 59)
    with pytest.raises(ValueError, match="already"):
        write_snapshot(df, path, Game())
    for wrong in (df.where("sequence_number <> 9"), df.unionByName(df.limit(1)), df.withColumn("payout", F.lit(-1).cast("bigint")), df.withColumn("signature", F.lit(None).cast("string"))):
        with pytest.raises(Exception, match="not the next one"):
            write_snapshot(wrong, str(tmp_path / "s" / "b.sqlite"), Game())
    assert sorted(os.listdir(tmp_path / "s")) == ["a.sqlite"]
    for change, fact in (("UPDATE layouts SET payout = -3 WHERE sequence_number = 4", "negative"), ("UPDATE layouts SET signature = '9' WHERE sequence_number = 4", "undecodable"), (f"UPDATE layouts SET signature = '{'99' * 15}' WHERE sequence_number = 4", "unknown_symbols")):
        db = sqlite3.connect(path)
        before = db.execute("SELECT payout, signature FROM layouts WHERE sequence_number = 4").fetchone()
        db.execute(change)
        db.commit()
        got = validate_snapshot(spark, path).first().asDict()
        assert not got["valid"] and not got["checksum_equal"] and got[fact] == 1
        db.execute("UPDATE layouts SET payout = ?, signature = ? WHERE sequence_number = 4", before)
        db.commit()
        db.close()
    assert validate_snapshot(spark, path).first()["valid"]


def test_measures_of_pictures(spark):
    import numpy as np

    from gridloom.operators.images import grey, measure_pictures, median_hash_of, quality, shrunk

    rng = np.random.default_rng(4)
    noisy, flat, white = rng.integers(0, 256, (40, 30, 3), dtype=np.uint8), np.full((20, 20, 3), 120, np.uint8), np.full((16, 16, 3), 255, np.uint8)
    assert quality(flat) == (0.0, pytest.approx(1 - 7.5 / 127.5), 1.0, 1.0) and quality(white)[1:] == (0.0, 0.0, 0.0) and quality(noisy)[0] > 0.9
    g = grey(noisy)
    assert abs(shrunk(g.astype(float), 10)[0, 0] - g[:4, :3].mean()) <= 0.5 and shrunk(g.astype(float), 40).shape == (40, 40)
    assert abs(shrunk(np.arange(7.0)[None, :].repeat(7, 0), 3)[0, 0] - (0 * 1 + 1 * 1 + 2 / 3) / (7 / 3)) <= 0.5
    top = np.zeros((32, 32), int)
    top[:16] = 9
    assert median_hash_of(top) == "f" * 32 + "0" * 32
    data = [(i, a.shape[1], a.shape[0], a.tobytes()) for i, a in enumerate((noisy, flat, white))] + [(7, 3, 3, b"short"), (8, None, 2, b""), (9, 1, 1, b"\x01\x02\x03")]
    got = {r["id"]: r for r in measure_pictures(spark.createDataFrame(data, "id bigint, width int, height int, rgb binary")).collect()}
    assert got[7]["score"] is None and got[8]["hash"] is None and got[9]["sharpness"] == 0.0 and got[0]["sharpness"] == round(quality(noisy)[0], 6)
