import random
import time

import pytest
from pyspark.sql import functions as F

from gridloom.sources import sinks
from gridloom.sources.generators import affine_layouts, mock_layouts
from gridloom.sources.lines import read_lines
from gridloom.streaming.grouping import Grouper, distance, group_observations, group_stream
from gridloom.streaming.imports import import_stream
from tests.conftest import rows


def test_lines_that_are_too_large_are_errors(spark, tmp_path):
    from gridloom.operators.bad_rows import load_layout_lines
    from gridloom.sources.lines import judged_line

    (tmp_path / "j.csv").write_bytes(b'schema_version,sequence_number,cells\n1,5,"[1]"\n1,6,"' + b"x" * (2 << 20) + b'"\n')
    got = read_lines(spark, str(tmp_path), split_bytes=4096)
    loaded = load_layout_lines(got.select(F.lit("j").alias("job_id"), "line_number", F.lit("csv").alias("file_format"), judged_line().alias("raw_line")))
    assert loaded.valid.count() == 1 and [(r["line_number"], r["code"]) for r in loaded.bad.collect()] == [(3, "import_record_invalid")]


def test_lines_of_ranges(spark, tmp_path):
    body = b"\n".join([b"first", b"", b"x" * 50, b"tail\r", "łąka".encode(), b"last"])
    (tmp_path / "a.csv").write_bytes(body + b"\n")
    (tmp_path / "b.csv").write_bytes(body)
    (tmp_path / "c.csv").write_bytes(b"")
    want = [(i + 1, x) for i, x in enumerate(body.split(b"\n"))]
    for split in (1, 3, 7, 1000):
        got = read_lines(spark, str(tmp_path), split_bytes=split)
        for name in "ab":
            r = got.where(F.col("path").endswith(f"{name}.csv")).orderBy("line_number").collect()
            assert [(x["line_number"], bytes(x["raw_line"])) for x in r] == want
            assert r[-1]["byte_offset_end"] == len(body) + (name == "a")
    large = read_lines(spark, str(tmp_path / "a.csv"), max_line_bytes=20).where("too_large").collect()
    assert [x["line_number"] for x in large] == [3] and large[0]["raw_line"] is None


def test_patterns_and_uris(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("a.csv", "b.csv", "c.txt", "_x.csv", ".y.csv", "d/e.csv"):
        (tmp_path / name).write_bytes(b"1\n2\n3")
    names = lambda path: sorted({r["path"].rsplit("/", 1)[1] for r in read_lines(spark, path).collect()})
    assert names(str(tmp_path)) == ["a.csv", "b.csv", "c.txt", "e.csv"] and names(f"file://{tmp_path}/*.csv") == ["a.csv", "b.csv"] and names(f"{tmp_path}/a.csv") == ["a.csv"]
    assert names(f"{tmp_path}/none") == [] and read_lines(spark, str(tmp_path / "*.txt"), split_bytes=2).count() == 3


def test_a_file_that_was_changed_is_not_imported_further(spark, tmp_path):
    path = tmp_path / "j.csv"
    path.write_bytes(b"schema_version,sequence_number,cells\n" + b"".join(b'1,%d,"[1]"\n' % i for i in range(1, 9)))

    def run():
        q = import_stream(spark, str(path), "csv", None, str(tmp_path / "out"), str(tmp_path / "ck"), batch_bytes=50)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(r["line_number"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == list(range(2, 10)) and run() == list(range(2, 10))
    path.write_bytes(path.read_bytes().replace(b"1,3,", b"1,4,") + b'1,9,"[1]"\n')
    with pytest.raises(ValueError, match="changed before"):
        run()


def test_stream_import_resumes(spark, tmp_path):
    path = tmp_path / "in.csv"
    lines = [b"schema_version,sequence_number,cells"] + [b'1,%d,"[1,2]"' % i for i in range(1, 24)] + [b"broken"]
    path.write_bytes(b"\n".join(lines[:10]) + b"\n")
    run = lambda: import_stream(spark, str(path), "csv", "job", str(tmp_path / "out"), str(tmp_path / "ck"), batch_bytes=60)

    def until(n):
        q = run()
        for _ in range(240):
            time.sleep(0.25)
            if q.exception():
                raise q.exception()
            try:
                if spark.read.parquet(str(tmp_path / "out")).select("line_number").count() >= n:
                    break
            except Exception:
                pass
        q.stop()

    until(9)
    with open(path, "ab") as f:
        f.write(b"\n".join(lines[10:]) + b"\n")
    until(24)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["line_number"] for r in got.collect()) == list(range(2, 26))
    assert [r["line_number"] for r in got.where("error_code is not null").collect()] == [25]


def test_stream_import_of_a_folder_takes_every_file(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = lambda i: b'1,%d,"[1,2]"\n' % i
    head = b"schema_version,sequence_number,cells\n"
    for name, n in (("a", 1), ("b", 11), ("c", 4)):
        (folder / f"{name}.csv").write_bytes(head + b"".join(map(line, range(1, n + 1))))

    def run():
        q = import_stream(spark, str(folder), "csv", None, str(tmp_path / "out"), str(tmp_path / "ck"), batch_bytes=60)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted((r["job_id"], r["line_number"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    want = [(name, k) for name, n in (("a", 1), ("b", 11), ("c", 4)) for k in range(2, n + 2)]
    assert run() == want
    with open(folder / "a.csv", "ab") as f:
        f.write(line(2))
    (folder / "d.csv").write_bytes(head + line(1))
    assert run() == sorted([*want, ("a", 3), ("d", 2)])


def test_import_query_stages_every_job(spark, data):
    import __spark_entry__ as entry

    pick = lambda df: rows(df.select("job_id", "line_number", "sequence_number", "error_code"))
    q = entry.queries()
    got = pick(q["stm_microbatch_import"](spark, data))
    assert got == sorted(pick(q["src_csv_layouts"](spark, data)) + pick(q["src_jsonl_layouts"](spark, data)), key=repr)


def _observations(seed, n=200):
    rng = random.Random(seed)
    base, out = 0, []
    for i in range(n):
        if rng.random() < 0.15:
            base = rng.getrandbits(64)
        noise = base ^ (1 << rng.randrange(64)) if rng.random() < 0.9 else rng.getrandbits(64)
        out.append((i, f"{noise:016x}", rng.random(), rng.choice((0.5, 0.9, 0.9))))
    return out


def _plain(obs):
    g, out = Grouper(), []
    for o in obs:
        out += g.feed(o)
    return out + g.finish()


def test_grouping(spark):
    runs = {f"r{k}": _observations(k) for k in range(3)}
    df = spark.createDataFrame([(r, *o) for r, obs in runs.items() for o in obs], "run string, `order` bigint, fingerprint string, quality double, geometry double").repartition(5)
    got = {}
    for r in group_observations(df).collect():
        got.setdefault(r["run"], []).append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in got.items()} == {k: _plain(o) for k, o in runs.items()}
    assert group_observations(df.limit(0)).count() == 0


def test_grouping_rules_and_resume():
    a, b, c = "0" * 16, "f" * 16, "0f" * 8
    o = lambda i, f, q=0.5: (i, f, q, 0.9)
    assert [x[1:4] for x in _plain([o(0, a), o(1, a), o(2, b), o(3, b)])] == [(0, 1, 2), (2, 3, 2)]
    assert [x[1:4] for x in _plain([o(0, a), o(1, b), o(2, a)])] == [(0, 0, 1), (1, 1, 1), (2, 2, 1)]  # a lone outlier: the next never rejoins
    assert [x[1:4] for x in _plain([o(0, a), o(1, b)])] == [(0, 0, 1), (1, 1, 1)]
    assert len(_plain([(0, a, 0.5, 0.9), (1, b, 0.5, 0.3)])) == 1  # no boundary without sure geometry
    assert distance(a, c) == 0.5 and distance(a, "0") == 1.0
    obs = _observations(9)
    g, out = Grouper(), []
    for x in obs:
        g = Grouper(g.state)  # resumed after every observation
        out += g.feed(x)
    assert out + g.finish() == _plain(obs)


def test_stateful_stream_equals_batch(spark, tmp_path):
    obs = _observations(4, 60)
    schema = "run string, `order` bigint, fingerprint string, quality double, geometry double"
    for k in range(3):
        spark.createDataFrame([("r", *o) for o in obs[k * 20 : k * 20 + 20]], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = group_stream(s).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r)[1:] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = _plain(obs)
    assert got == want[: len(got)] and len(want) - len(got) <= 2


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "v")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    assert sinks.publish(df, folder, 1, 2)["rows"] == 2
    sinks.upsert_version(spark, folder, 1, spark.createDataFrame([(2, "z"), (3, "c")], "k bigint, v string"), ["k"])
    assert rows(sinks.open_version(spark, folder, 2)) == [(1, "a"), (2, "z"), (3, "c")]
    for broken in (lambda: sinks.publish(df, folder, 1), lambda: sinks.publish(df, folder, 5, 99), lambda: sinks.open_version(spark, folder, 5)):
        try:
            broken()
        except Exception:
            continue
        raise AssertionError("it should have failed")


def test_generators(spark):
    a = affine_layouts(spark, 500)
    assert a.select("cells").distinct().count() == 500 and a.where(F.exists("cells", lambda c: ~c.between(1, 11))).count() == 0
    m = [r["cells"] for r in mock_layouts(spark, 1).orderBy("sequence_number").collect()]
    assert m[100:106] == m[994:] and len({tuple(x) for x in m}) == 994
