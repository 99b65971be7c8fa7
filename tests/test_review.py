"""Matching, deletes, stages, keys and hashes against plain versions."""

import hashlib
import json
import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions.canonical import code_base, job_key, median_hash, proper_name
from gridloom.operators import geometry as G
from gridloom.operators import relational as R
from tests.conftest import rows

QUAD = "array<struct<x double, y double>>"


def quad(points):
    return [(float(x), float(y)) for x, y in points]


def test_golden_join_wants_exactly_one(spark):
    square = quad([(0, 0), (10, 0), (10, 10), (0, 10)])
    golden = spark.createDataFrame([("a", 0, square, 20.0), ("a", 1, square, 20.0), ("b", 0, square, 20.0), ("b", None, square, 20.0)], f"image string, position int, quad {QUAD}, diagonal double")
    moved = quad([(3, 4), (10, 0), (10, 10), (0, 10)])
    detected = spark.createDataFrame([("a", 0, "x", moved), ("a", 0, "x", moved), ("a", 1, "y", square), ("a", 1, "z", square), ("b", 0, "w", square[:3]), (None, 0, "v", square), ("b", 5, "u", square)], f"image string, position int, id string, quad {QUAD}")
    got = {(r["image"], r["position"]): (r["status"], r["matches"], r["errors"]) for r in G.golden_join(golden, detected).collect()}
    assert got[("a", 0)] == ("matched", 1, [5.0, 0.0, 0.0, 0.0]) and got[("a", 1)] == ("duplicated", 2, None) and got[("b", 0)] == ("missing", 0, None) and got[("b", None)] == ("missing", 0, None)
    q = G.geometry_quality(golden.where("position is not null"), detected).first()
    assert q["images"] == 2 and q["detected_share"] == 1.0 and q["expected_share"] == 0.5 and q["p95"] == 1.0 and abs(q["position_accuracy"] - 2 / 3) < 1e-6
    assert G.geometry_quality(golden.limit(0), detected).first()["images"] == 0


def test_lines_under_a_projective_map(spark):
    rng = np.random.default_rng(1)
    unit = np.array(G.CORNERS) * [500.0, 300.0]
    expected = unit * 0.3 + [40, 20] + rng.normal(size=(4, 2))
    same = G.line_errors(spark.createDataFrame([("a", 0, quad(expected), quad(expected)), ("n", 1, None, quad(expected)), ("d", 2, quad(expected), quad([(0, 0)] * 4))], f"image string, position int, expected {QUAD}, actual {QUAD}"))
    assert same.count() == 6 and same.agg(F.max("error")).first()[0] == 0.0
    shifted = G.line_errors(spark.createDataFrame([("a", 0, quad(unit), quad(unit + [7.0, -2.0]))], f"image string, position int, expected {QUAD}, actual {QUAD}"))
    assert {(r["axis"], r["error"]) for r in shifted.collect()} == {("vertical", 7.0), ("horizontal", 2.0)}
    h = G.homographies(unit[None], expected[None])[0]
    p = h @ np.append(unit[2], 1)
    assert np.allclose(p[:2] / p[2], expected[2])


def test_delete_cascade_follows_the_links(spark):
    t = {
        "page": spark.createDataFrame([(1, "j1"), (2, "j2"), (3, None)], "id int, job string"),
        "board": spark.createDataFrame([(10, 1, None), (11, 2, "j1"), (12, 2, None), (13, None, None)], "id int, page int, job string"),
        "cell": spark.createDataFrame([(100, 10), (101, 11), (102, 12), (103, 10), (104, None)], "id int, board int"),
    }
    links = [("page", "job", None, "id"), ("board", "page", "page", "id"), ("board", "job", None, "id"), ("cell", "board", "board", "id")]
    kept, counts = R.delete_cascade(t, links, spark.createDataFrame([("j1",), ("none",)], "key string"))
    assert [tuple(r) for r in counts.orderBy("step").collect()] == [(1, "cell", 3, 2), (2, "board", 2, 2), (3, "page", 1, 2)]
    assert sorted(r["id"] for r in kept["cell"].collect()) == [102, 104] and sorted(r["id"] for r in kept["board"].collect()) == [12, 13]
    assert R.delete_cascade(t, links, spark.createDataFrame([], "key string"))[1].agg(F.sum("deleted")).first()[0] == 0


def test_lookups(spark):
    s = spark.createDataFrame([("A",), ("B",), ("C",), ("A",)], "code string")
    r = spark.createDataFrame([("A", ["1", "2", "9"]), ("B", ["3"]), ("Z", ["1"])], "code string, candidate_ids array<string>")
    c = spark.createDataFrame([("1", "a"), ("2", "a2"), ("3", None), ("1", "a")], "candidate_id string, predicted string")
    assert rows(R.prediction_alias(s, r, c)) == [("A", "a"), ("A", "a2"), ("B", "B"), ("C", "C")]
    b = spark.createDataFrame([(1, "x", 0.5), (1, "y", 0.9), (2, "z", None)], "sequence_number int, id string, conf double")
    o = spark.createDataFrame([(1, 1, "x"), (1, 2, None), (2, 1, "q"), (3, 1, "w")], "sequence_number int, revision int, id string")
    assert rows(R.select_sources(b, o, F.col("conf"))) == [(1, "y", False), (2, "q", True)]
    d = spark.createDataFrame([("f", "a"), ("f", "c"), ("f", "a"), ("g", "?"), ("h", "a"), ("h", "b"), ("h", "c")], "file string, stage string")
    assert rows(R.next_stage(d, ["a", "b", "c"])) == [("f", 1, "b", 1), ("g", 0, "a", 0), ("h", 3, None, 0)]


def test_job_keys_are_those_of_sorted_compact_json(spark):
    df = spark.createDataFrame([("csv", None, 3), ("jsonl", "g", None)], "f string, g string, n int")
    got = df.select("f", "g", "n", job_key(F.lit("import"), F.col("g"), {"z": F.col("f"), "a": F.col("n"), "m": {"y": F.lit(True), "b": F.lit("x")}}).alias("k")).collect()
    for r in got:
        text = json.dumps({"gameId": r["g"], "jobType": "import", "inputPayload": {"a": r["n"], "m": {"b": "x", "y": True}, "z": r["f"]}}, sort_keys=True, separators=(",", ":"))
        assert r["k"] == hashlib.sha256(text.encode()).hexdigest()


def test_hashes_and_codes(spark):
    rng = random.Random(3)
    pictures = [[rng.randrange(256) for _ in range(256)] for _ in range(5)] + [[7] * 256]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pictures)] + [(9, [1, 2])], "i int, p array<int>")
    got = {r["i"]: r["h"] for r in df.select("i", median_hash(F.col("p")).alias("h")).collect()}
    for i, p in enumerate(pictures):
        m = statistics.median(p)
        assert got[i] == f"{int(''.join('1' if x > m else '0' for x in p), 2):064x}"
    assert got[9] is None
    words = spark.createDataFrame([(" A b!c-",), ("--",), ("ok_1",)], "v string")
    assert sorted(r[0] for r in words.select(code_base(F.col("v"), F.lit(4))).collect()) == ["A_b_c", "SYMBOL_04", "ok_1"]
    assert words.select(proper_name(F.lit("red_big-x"))).first()[0] == "Red Big X"
