import itertools

import numpy as np
import pytest

import gridloom.llm.quota_sample as Q
from gridloom.llm.quota_sample import Target, cell_quotas, quota_sample, shortages, solve_cells

SCHEMA = "observation_id string, board_position int, condition_tags array<string>, source_group string, m0 string, BOARD_POSITION int"
TARGETS = "category_kind string, category string, target_share double, min_count int, sample_divisor int"


def frame(spark, data):
    return spark.createDataFrame([(*d, "x", 1) for d in data], SCHEMA)


def test_availability_and_names(spark):
    data = [("o1", 0, ["Glare ", "low_light"], " HALL "), ("o1", None, None, None), ("o2", 0, [], "hall"), ("o3", 1, [None, ""], None), ("o4", 99, ["low-light"], "x"), (None, 0, ["glare"], "hall"), ("o2", 1, ["glare"], "hall")]
    targets = [("board_position", "0", 0.5, 1, 2), ("board_position", "7", 0.0, 1, 2), ("condition_tag", "glare", 0.5, 2, 2), ("condition_tag", "low-light", 0.5, 3, 2), ("source_group", "hall", 1.0, 1, 2), ("other", "x", 0.1, 0, 2)]
    q = quota_sample(frame(spark, data + data[:3]), spark.createDataFrame(targets, TARGETS))
    r = {(x["category_kind"], x["category"]): x for x in q.report.collect()}
    assert {k: v["available"] for k, v in r.items()} == {("board_position", "0"): 2, ("board_position", "7"): 0, ("condition_tag", "glare"): 2, ("condition_tag", "low-light"): 2, ("source_group", "hall"): 2, ("other", "x"): 0}
    assert sorted(tuple(x) for x in q.unreachable().collect()) == [("board_position", "7"), ("condition_tag", "low-light"), ("other", "x")]
    ids = [x["observation_id"] for x in q.sample.collect()]
    assert len(ids) == len(set(ids)) == 2 and set(ids) <= {"o1", "o2", "o3", "o4"}


def test_shares_are_met_where_they_can_be(spark):
    data = [(f"o{i}", i % 9, [t for j, t in enumerate(("a", "b", "c")) if i % (j + 2) == 0], "g" if i % 7 == 0 else "h") for i in range(900)]
    targets = [("board_position", str(p), s, 2, 9) for p, s in enumerate((0.3, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05))] + [("condition_tag", "a", 0.2, 1, 9), ("condition_tag", "b", 0.45, 1, 9), ("source_group", "g", 0.5, 1, 9)]
    q = quota_sample(frame(spark, data), spark.createDataFrame(targets, TARGETS))
    assert q.sample.count() == 100
    for r in q.report.collect():
        assert abs(r["drawn"] - r["wanted"]) <= 1, r
    again = quota_sample(frame(spark, data), spark.createDataFrame(targets, TARGETS))
    assert sorted(map(tuple, again.sample.collect())) == sorted(map(tuple, q.sample.collect()))


@pytest.mark.parametrize("seed", range(6))
def test_quotas_against_all_choices(seed):
    rng = np.random.default_rng(seed)
    targets = [Target("board_position", "0", 0.5, 1), Target("board_position", "1", 0.5, 0), Target("condition_tag", "a", float(rng.choice([0.2, 0.5])), int(rng.integers(0, 3))), Target("source_group", "g", 0.4, 0)]
    members = np.array([[p == 0, p == 1, a, g] for p, a, g in itertools.product((0, 1), (0, 1), (0, 1))][: 6], dtype=bool)
    counts = rng.integers(0, 5, len(members))
    size = int(min(5, counts.sum()))
    goal = np.array([round(t.share * size) for t in targets])
    floor = np.minimum([t.floor for t in targets], members.T @ counts)

    def cost(x):
        got = np.array(x) @ members
        return np.abs(got - goal).sum() + 1000 * np.maximum(0, floor - got).sum()

    best = min(cost(x) for x in itertools.product(*[range(c + 1) for c in counts]) if sum(x) == size)
    got = cell_quotas(members, counts, targets, size)
    assert got.sum() == size and (got <= counts).all() and (got >= 0).all()
    assert cost(got) <= best + 1


@pytest.mark.parametrize("seed", range(60))
def test_the_bound_holds_and_the_deviation_is_reported(seed):
    rng = np.random.default_rng(100 + seed)
    targets = [Target("board_position", "0", 0.5, int(rng.integers(0, 3))), Target("condition_tag", "a", float(rng.choice([0.2, 0.5])), 1), Target("condition_tag", "b", float(rng.choice([0.3, 0.6])), 0), Target("source_group", "g", 0.4, 2)]
    members = np.array(list(itertools.product((0, 1), repeat=4)), dtype=bool)[rng.permutation(16)[:6]]
    counts = rng.integers(0, 4, len(members))
    size = int(min(5, counts.sum()))
    goal = np.array([round(t.share * size) for t in targets])
    floor = np.minimum([t.floor for t in targets], members.T @ counts)

    def cost(x):
        got = np.array(x) @ members
        return int(np.abs(got - goal).sum() + 1000 * np.maximum(0, floor - got).sum())

    x, deviation, least = solve_cells(members, counts, targets, size)
    best = min((cost(x) for x in itertools.product(*[range(c + 1) for c in counts]) if sum(x) == size), default=0)
    assert least <= best <= deviation and (size == 0 or deviation == cost(x)) and deviation - best <= 2


def test_unreachable_targets_come_from_the_shortage_arcs(spark, monkeypatch):
    assert shortages([5, 0, 3, 7], [4, 2, 3, 9]) == [0, 2, 0, 2] and shortages([], []) == []
    assert shortages([5, 0], [4, 2], cost=-1.0) == [4, 2]  # a shortage that pays is taken first
    data = [(f"o{i}", i % 2, None, "g") for i in range(8)]
    targets = spark.createDataFrame([("board_position", "0", 0.5, 1, 2), ("board_position", "5", 0.1, 1, 2)], TARGETS)
    assert [tuple(r) for r in quota_sample(frame(spark, data), targets).unreachable().collect()] == [("board_position", "5")]
    monkeypatch.setattr(Q.shortages, "__defaults__", (-1.0,))
    assert quota_sample(frame(spark, data), targets).unreachable().count() == 2


def test_too_many_cells_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(Q, "MAX_CELLS", 3)
    data = [(f"o{i}", i, None, None) for i in range(9)]
    with pytest.raises(ValueError, match="more than 3"):
        quota_sample(frame(spark, data), spark.createDataFrame([("board_position", str(i), 0.1, 1, 2) for i in range(9)], TARGETS))


def test_empty_and_untargeted(spark):
    t = spark.createDataFrame([("board_position", "0", 0.5, 1, 5)], TARGETS)
    q = quota_sample(frame(spark, []), t)
    assert q.sample.count() == 0 and q.report.first()["slack"] == 1
    q = quota_sample(frame(spark, [(f"o{i}", None, None, None) for i in range(10)]), t.limit(0), size=4)
    assert q.sample.count() == 4 and q.report.count() == 0


def test_many_categories_need_several_words(spark):
    data = [(f"o{i}", None, [f"t{i % 100}"], None) for i in range(400)]
    t = spark.createDataFrame([("condition_tag", f"t{k}", 0.01, 1, 4) for k in range(100)], TARGETS)
    q = quota_sample(frame(spark, data), t)
    assert {r["drawn"] for r in q.report.collect()} == {1} and q.sample.count() == 100


def test_very_full_cells_are_ranked_in_buckets(spark, monkeypatch):
    from gridloom.llm import quota_sample as module

    monkeypatch.setattr(module, "ROWS_PER_RANK", 20)
    data = [(f"o{i}", 0, None, None) for i in range(500)] + [(f"p{i}", 1, None, None) for i in range(7)]
    t = spark.createDataFrame([("board_position", "0", 0.95, 1, 3), ("board_position", "1", 0.05, 5, 3)], TARGETS)
    q = quota_sample(frame(spark, data), t)
    ids = [r["observation_id"] for r in q.sample.collect()]
    assert len(ids) == len(set(ids)) == 169 and sum(i[0] == "p" for i in ids) == 7


def test_draws_from_very_large_counts():
    from gridloom.llm.quota_sample import _draw

    rng = np.random.default_rng(1)
    counts = np.array([10**12, 3 * 10**12, 5], dtype=np.int64)
    x = _draw(rng, counts, 10**12 + 1)
    assert x.sum() == 10**12 + 1 and (x <= counts).all() and abs(int(x[0]) - 25 * 10**10) <= 2
    assert (_draw(rng, counts, int(counts.sum())) == counts).all()


@pytest.mark.parametrize("seed", range(4))
def test_no_exchange_between_any_two_of_many_cells_is_left(seed):
    rng = np.random.default_rng(seed)
    kinds = [("board_position", 9), ("condition_tag", 8), ("source_group", 8)]
    targets = [Target(k, str(i), float(share), 2) for k, n in kinds for i, share in enumerate(rng.dirichlet(np.ones(n)) * (1.8 if k == "condition_tag" else 1.0))]
    cells = sorted({(int(rng.integers(9)), int(rng.integers(1, 256)), int(rng.integers(8))) for _ in range(600)})
    members = np.array([[p == i for i in range(9)] + [bool(t >> i & 1) for i in range(8)] + [g == i for i in range(8)] for p, t, g in cells], dtype=bool)
    counts = rng.integers(1, 8, len(cells))
    size = int(counts.sum()) // 3
    goal = np.array([round(t.share * size) for t in targets])
    floor = np.minimum([t.floor for t in targets], members.T @ counts)

    def cost(got):
        return np.abs(got - goal).sum(-1) + 1000 * np.maximum(0, floor - got).sum(-1)

    x = cell_quotas(members, counts, targets, size)
    assert len(cells) > 500 and x.sum() == size and (x <= counts).all() and (x >= 0).all()
    m = members.astype(np.int64)
    got = x @ m
    best = min(cost(got + m[i][None, :] - m[x > 0]).min() for i in np.flatnonzero(x < counts))
    assert best >= cost(got)
