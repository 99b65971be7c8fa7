import math
import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from gridloom.functions import measures as M
from gridloom.functions.keys import digest_key, name_key, path_key
from gridloom.operators import evaluation as E
from gridloom.operators import relational as R
from gridloom.operators.ordering import block_size, in_ranges, next_set, previous_value, row_numbers, running_sum
from tests.conftest import rows


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables stay in several ranges, so that what passes between ranges is tested too."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sums_and_ranks_cross_blocks(spark):
    rng = random.Random(1)
    keys = sorted(rng.sample(range(-500, 500), 300))
    vals = [rng.choice((None, 1, 5, -2)) for _ in keys]
    df = spark.createDataFrame(list(zip(keys, vals)), "k bigint, v bigint").repartition(4)
    got = {r["k"]: r for r in next_set(row_numbers(running_sum(df, F.col("k"), F.col("v"), "s"), F.col("k"), name="n"), F.col("k"), F.col("v"), "x").collect()}
    total = 0
    for i, (k, v) in enumerate(zip(keys, vals)):
        total += v or 0
        assert (got[k]["s"], got[k]["n"]) == (total, i + 1)
        assert got[k]["x"] == next((w for w in vals[i + 1 :] if w is not None), None)


def test_sparse_keys_make_no_more_ranges_than_tasks(spark):
    df = spark.range(20_000).select((F.col("id") * 1_000_003).alias("k"), (F.col("id") % 7).alias("v")).repartition(5)
    assert in_ranges(df, F.col("k")).select("_part").distinct().count() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = previous_value(row_numbers(df, F.col("k"), name="n"), "k", "p")
    assert got.where("n <> k div 1000003 + 1 or not (p <=> if(k = 0, null, k - 1000003))").count() == 0
    assert running_sum(df, F.col("k"), F.col("v"), "s").agg(F.max("s")).first()[0] == sum(i % 7 for i in range(20_000))
    assert block_size(100) == 1 << 14 and 10**12 // block_size(10**12) <= 1 << 18


def test_ranks_by_several_keys_and_nulls(spark):
    rng = random.Random(4)
    data = [(rng.choice([None, 1, 2]), rng.choice("ab"), i) for i in range(200)]
    df = spark.createDataFrame(data, "a int, b string, c int").repartition(6)
    got = [(r["a"], r["b"], r["c"]) for r in row_numbers(df, F.col("a").desc_nulls_first(), F.asc("b"), F.asc("c"), name="n").orderBy("n").collect()]
    assert got == sorted(data, key=lambda r: (r[0] is not None, -(r[0] or 0), r[1], r[2]))
    assert row_numbers(df.limit(0), F.col("c"), name="n").count() == 0


def test_missing_numbers_in_blocks(spark):
    from gridloom.operators.integrity import dataset_report, missing_sample

    n = 200_000
    df = spark.range(1, n + 1).where("id % 50000 not between 1 and 30").select(F.col("id").alias("sequence_number"))
    want = [i for i in range(1, n + 51) if i > n or 1 <= i % 50_000 <= 30]
    assert [r[0] for r in missing_sample(df, n + 50).collect()] == want[:100]
    assert [r[0] for r in missing_sample(df.limit(0), 5).collect()] == [1, 2, 3, 4, 5]
    b = spark.createDataFrame([(1, [1], "01"), (1, [12], "12"), (9, None, None), (None, [1, 1], "x")], "sequence_number bigint, cells array<int>, signature string")
    got = {r["check_code"]: (r["issue_count"], r["sample"]) for r in dataset_report(b, 3, 5, 1, [1], 2).collect()}
    assert got["count"] == (1, "") and got["missing"] == (2, "2,3") and got["out_of_range"] == (1, "9") and got["duplicate_sequence"] == (1, "1") and got["foreign_symbol"] == (1, "1") and got["cell_count"] == (2, "9")


def test_floor_lookup(spark):
    rng = random.Random(9)
    rules = sorted({rng.randrange(1000) for _ in range(40)})
    probes = [(i, rng.choice([None, -5, 2000, 500, *range(0, 1000, 7)])) for i in range(400)] + [(i, 500) for i in range(400, 600)]
    df = spark.createDataFrame(probes, "i int, at int").repartition(4)
    got = {r["i"]: r["rule"] for r in R.floor_lookup(df, spark.createDataFrame([(r,) for r in [*rules, *rules[:3]]] + [(None,)], "at int"), "at", "rule").collect()}
    assert got == {i: max((r for r in rules if v is not None and r <= v), default=None) for i, v in probes}
    assert R.floor_lookup(df, df.select("at").limit(0), "at", "rule").where("rule is not null").count() == 0


def test_gaps(spark):
    df = spark.createDataFrame([(n,) for n in (None, 3, 3, 4, 9, -2)], "n bigint")
    assert rows(R.gap_ranges(df, "n")) == [(1, 2), (5, 8)]
    assert rows(R.gap_ranges(df, "n", 11)) == [(1, 2), (10, 11), (5, 8)]
    assert [r[0] for r in R.expand_ranges(R.gap_ranges(df, "n", 11), 4).collect()] == [1, 2, 5, 6]
    assert rows(R.gap_ranges(df.limit(0), "n", 3)) == [(1, 3)]


def test_pages(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(10)], "id bigint, v double")
    order = [("v", True), ("id", False)]
    whole = [r["id"] for r in df.orderBy(F.desc("v"), "id").collect()]
    first = R.page(df, order, 4).collect()
    assert [r["id"] for r in first] == whole[:4] and all(r["has_more"] for r in first)
    rest = R.page(df, order, 40, (first[-1]["v"], first[-1]["id"])).collect()
    assert [r["id"] for r in rest] == whole[4:] and not rest[0]["has_more"]
    back = R.page(df, order, 2, (first[-1]["v"], first[-1]["id"]), True).collect()
    assert [r["id"] for r in back] == whole[1:3][::-1]


def test_asof_interpolation(spark):
    a = spark.createDataFrame([("g", 10.0, 1.0), ("g", 20.0, 3.0), ("g", 20.0, 5.0)], "k string, x double, y double")
    p = spark.createDataFrame([("g", x) for x in (5.0, 10.0, 15.0, 20.0, 30.0)] + [("h", 1.0)], "k string, x double")
    got = {(r["k"], r["x"]): r["y"] for r in R.asof_interpolate(p, a, ["k"], "x", "y").collect()}
    assert got == {("g", 5.0): 1.0, ("g", 10.0): 1.0, ("g", 15.0): 2.5, ("g", 20.0): 4.0, ("g", 30.0): 4.0, ("h", 1.0): None}


def test_asof_interpolation_across_ranges(spark):
    rng = random.Random(6)
    anchors = {(k, float(rng.randrange(4000))): float(rng.randrange(100)) for k in ("hot", "b", None) for _ in range(60 if k == "hot" else 9)}
    anchors = {kv: v for kv, v in anchors.items() if not (kv[0] == "hot" and 700 < kv[1] < 2900)}  # a wide hole in the hot key
    probes = sorted({("hot", float(rng.randrange(4000))) for _ in range(1500)} | {(k, float(rng.randrange(4000))) for k in ("b", "c") for _ in range(20)}, key=repr) + [(None, 17.0)]

    def plain(k, x):
        own = sorted((u, v) for (j, u), v in anchors.items() if j == k)
        low, high = [p for p in own if p[0] <= x][-1:], [p for p in own if p[0] >= x][:1]
        if not own:
            return None
        if not low or not high or low == high:
            return (low or high)[0][1]
        (u, v), (w, z) = low[0], high[0]
        return round(v + (z - v) * (x - u) / (w - u), 10)

    schema = "k string, x double"
    assert in_ranges(spark.createDataFrame(probes, schema), F.col("x")).select("_part").distinct().count() > 2
    got = R.asof_interpolate(spark.createDataFrame(probes, schema).repartition(3), spark.createDataFrame([(*kx, v) for kx, v in anchors.items()], schema + ", y double"), ["k"], "x", "y")
    assert {(r["k"], r["x"]): r["y"] for r in got.collect()} == {p: plain(*p) for p in probes}
    assert R.asof_interpolate(spark.createDataFrame([], schema), spark.createDataFrame([], schema + ", y double"), ["k"], "x", "y").count() == 0


def test_upsert_latest_topk(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    n = spark.createDataFrame([(2, "c"), (3, "d")], "k bigint, v string")
    assert rows(R.upsert(t, n, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(R.insert_missing(t, n, ["k"])) == [(1, "a"), (2, "b"), (3, "d")]
    e = spark.createDataFrame([("x", 1, "p"), ("x", 2, None), (None, 1, "q")], "g string, r int, v string")
    assert rows(R.latest_by(e, ["g"], F.col("r"))) == [("x", 2, None), (None, 1, "q")]
    assert rows(R.top_k(e, ["g"], 1, F.desc("r")).select("g", "r")) == [("x", 2), (None, 1)]


def test_nearest_per_class(spark):
    rng = random.Random(3)
    vs = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 3) for i in range(40)] + [(100, None, 1), (101, [0.0] * 4, 1)]
    df = spark.createDataFrame(vs, "vec_id bigint, embedding array<double>, label int")
    got = {}
    for r in R.nearest_per_class(df, df.where("vec_id % 10 = 0"), 2, -1.0, block=8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["class"], r["neighbour_id"]))
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v, _ in vs if v and any(v)}
    for q in (0, 10, 20, 30):
        best = {}
        for i, _, c in vs:
            if i != q and i in unit:
                s = sum(a * b for a, b in zip(unit[q], unit[i]))
                best[c] = max(best.get(c, (-9, 0)), (s, -i))
        want = sorted(best.items(), key=lambda x: (-x[1][0], x[0]))[:2]
        assert sorted(got[q]) == [(k + 1, c, -b[1]) for k, (c, b) in enumerate(want)]
    assert 100 not in got and 101 not in got


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a", 0.9, True), ("a", "b", 0.8, False), ("b", "b", 1.0, True), (None, "b", None, None)], "actual string, predicted string, confidence double, correct boolean")
    m = {r["class"]: r for r in E.class_metrics(E.confusion(df)).collect()}
    assert m["a"]["recall"] == 0.5 and m["b"]["precision"] == 0.5
    assert {r["bin"]: r["n"] for r in E.calibration(df).collect()} == {9: 2, 8: 1}
    s = E.threshold_sweep(df).orderBy(F.desc("threshold")).collect()
    assert [(r["threshold"], r["accepted"], r["hits"]) for r in s] == [(1.0, 1, 1), (0.9, 2, 2), (0.8, 3, 2)]
    assert E.select_threshold(E.threshold_sweep(df), 0.99, "precision").first()["threshold"] == 0.9
    assert E.select_threshold(E.threshold_sweep(df), 2.0).count() == 0
    assert not E.best_threshold(E.threshold_sweep(df), 2.0).first()["passes"]
    t = spark.createDataFrame([("g", 1), ("g", 2), ("g", 2), ("g", 1)], "g string, v int")
    assert E.mode_larger(t, ["g"], "v").first()["v"] == 2
    q = spark.createDataFrame([(float(i),) for i in range(1, 5)], "v double").agg(E.nearest_rank(0.5, "v").alias("a"), E.linear_percentile(0.5, "v").alias("b")).first()
    assert (q["a"], q["b"]) == (2.0, 2.5)


def test_keys_and_measures(spark):
    p = spark.createDataFrame([(x,) for x in ("a//b/./c.png", "a\\b\\..\\c", "../x", "a/..", "/a/b/", "A/b", None, "")], "p string")
    assert [r[0] for r in p.select(path_key(F.col("p"))).collect()] == ["a/b/c.png", "a/c", "x", "", "a/b", "A/b", None, ""]
    n = spark.createDataFrame([(x,) for x in (" Ab ", "N/A", "unknown", "", "\t", None)], "p string")
    assert [r[0] for r in n.select(name_key(F.col("p"))).collect()] == ["ab", None, None, None, None, None]
    d = spark.createDataFrame([(x,) for x in (" SHA256:AB ", "ab\t", "", None)], "p string")
    assert [r[0] for r in d.select(digest_key(F.col("p"))).collect()] == ["ab", "ab", None, None]
    h = spark.createDataFrame([("f" * 32, "0" * 32), ("f" * 31, "0" * 32), (None, "0" * 32)], "a string, b string")
    assert [r[0] for r in h.select(M.hex_distance(F.col("a"), F.col("b"), 32)).collect()] == [1.0, 1.0, None]
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    r = v.select(M.cosine(F.col("a"), F.col("b")), M.jensen_shannon(F.col("a"), F.col("b")), M.entropy(F.col("a")), M.mean_abs_difference(F.col("a"), F.array())).first()
    assert tuple(r) == (0.0, 1.0, 0.0, 1.0)
    names = spark.createDataFrame([("b10",), ("b9",), ("B1",)], "n string")
    assert [x[0] for x in names.orderBy(M.natural_key(F.col("n"))).collect()] == ["B1", "b9", "b10"]


def shannon(p, q):
    m = (p + q) / 2
    part = lambda a: float(sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0))
    return (part(p) + part(q)) / 2


def plain_boards(boards, k):
    """(id, score) one after the other; boards: id -> (source, number, 15 x classes)."""
    top = {i: b[2].argmax(1) for i, b in boards.items()}
    often = Counter(int(x) for t in top.values() for x in t)
    base = {}
    for i, (_, _, p) in boards.items():
        h = sorted((-(np.where(r > 0, r * np.log(np.maximum(r, 1e-15)), 0)).sum() / math.log(len(r)) for r in p), reverse=True)
        base[i] = 0.65 * sum(h[:5]) / 5 + 0.05 * sum(1 - often[int(x)] / max(often.values()) for x in top[i]) / 15
    out, left = [], dict(boards)
    while left and len(out) < k:
        seen = {boards[i][0] for i, _ in out}
        fresh = {i: b for i, b in left.items() if b[0] not in seen} or left
        score = {i: base[i] + 0.15 * min([shannon(b[2].mean(0), boards[j][2].mean(0)) for j, _ in out], default=1.0) + (0.15 if b[0] not in seen else 0) for i, b in fresh.items()}
        best = min(fresh, key=lambda i: (-round(score[i], 9), boards[i][1], i))
        out.append((best, score[best]))
        del left[best]
    return out


def test_boards_to_look_at_one_after_the_other(spark):
    from gridloom.operators.selection import select_boards

    rng = np.random.default_rng(7)
    boards = {f"b{i:02d}": (f"s{i % 6}", i + 1, rng.dirichlet(np.ones(4) * 0.4, 15)) for i in range(20)}
    cells = [(i, s, n, c, [float(x) for x in p[c]]) for i, (s, n, p) in boards.items() for c in range(15)]
    cells += [("short", "s9", 99, c, [0.25] * 4) for c in range(14)] + [("none", "s9", 98, c, None) for c in range(15)] + cells[:20]
    schema = "id string, source string, sequence_number bigint, cell int, probabilities array<double>"
    got = [(r["id"], r["score"]) for r in select_boards(spark.createDataFrame(cells, schema), 12).orderBy("rank").collect()]
    want = plain_boards(boards, 12)
    assert [i for i, _ in got] == [i for i, _ in want] and all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got, want))
    assert len({boards[i][0] for i, _ in got[:6]}) == 6  # every source comes before one comes twice
    assert select_boards(spark.createDataFrame([], schema), 3).count() == 0


def test_temperature_is_that_of_a_fine_search(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(300, 4)) * 3
    label = [int(rng.choice(4, p=np.exp(r / 2.5) / np.exp(r / 2.5).sum())) for r in z]

    def loss(t):
        y = z / t
        return float(np.mean(np.log(np.exp(y - y.max(1, keepdims=True)).sum(1)) - (y - y.max(1, keepdims=True))[np.arange(300), label]))

    best = min(np.exp(np.linspace(math.log(0.05), math.log(20), 20_001)), key=loss)
    df = spark.createDataFrame([([float(x) for x in r], y) for r, y in zip(z, label)] + [(None, 1), ([1.0], 0), ([1.0, 2.0], 7)], "logits array<double>, label int")
    t = E.fit_temperature(df)
    assert abs(t - best) < 2e-3 and loss(t) <= loss(best) + 1e-9
    assert E.fit_temperature(df.limit(0)) == 1.0
def test_natural_keys_of_long_numbers(spark):
    from gridloom.functions.measures import natural_key

    names = ["a2", "a10", "a999999999999", "a1000000000000", "a1000000000001", "a0002000000000000", "a10000000000000", "b1"]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "name string")
    assert [r[0] for r in df.orderBy(natural_key(F.col("name")), "name").collect()] == names
