import random

import pytest

from gridloom.llm import splits
from gridloom.llm.splits import ComponentTable, assign_splits, connected
from tests.conftest import rows

SCHEMA = "sample_id string, source_image_id string, source_group string, comp string, SOURCE_GROUP string"


def frame(spark, data):
    return spark.createDataFrame([(*d, "x", "y") for d in data], SCHEMA)


def components(data):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for row in data:
        keys = [(k, v.strip().lower()) for k, v in zip("sig", row) if v is not None and v.strip().lower() not in ("", "unknown", "n/a")]
        for k in keys:
            a, b = find(keys[0]), find(k)
            parent[b] = a
    out = {}
    for k in list(parent):
        out.setdefault(find(k), set()).add(k)
    return list(out.values())


def pairs(data):
    groups = [sorted(v for k, v in c if k == "g") for c in components(data)]
    return sorted((a, b) for g in groups for a in g for b in g if a < b)


def made_up(seed, n):
    rng = random.Random(seed)
    pick = lambda p, k: rng.choice([f"{p}{rng.randrange(k)}", f" {p.upper()}{rng.randrange(k)}\t", None, "unknown", " N/A ", ""]) if rng.random() < 0.4 else f"{p}{rng.randrange(k)}"
    return [(pick("s", n), pick("i", n // 3), pick("g", n // 4)) for _ in range(n)]


def test_connected_long_chain_and_cycles(spark):
    n = 300
    edges = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(n)] + [("z1", "z2"), ("z2", "z3"), ("z3", "z1"), ("z1", "z1")]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["label"] for r in connected(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert set(got.values()) == {"n0000", "z1"} and len(got) == n + 4
    assert connected(spark.createDataFrame([], "u string, v string")).count() == 0


def test_components_against_union_find(spark):
    data = made_up(3, 80)
    table = assign_splits(frame(spark, data + data[:9]))
    assert rows(table.group_pairs()) == pairs(data)
    got = {r["sample_id"]: r for r in table.assignment().collect()}
    samples = [sorted(v for k, v in c if k == "s") for c in components(data)]
    assert sorted(got) == sorted(x for c in samples for x in c)
    for c in samples:
        assert len({(got[x]["component"], got[x]["split_name"]) for x in c}) <= 1
    assert all(r["split_name"] in ("train", "validation", "test") and r["status"] == "assigned" for r in got.values())


def test_proportions(spark):
    data = [(f"s{i}", f"i{i // 3}", None) for i in range(600)]
    shares = {r["split_name"]: r["share"] for r in assign_splits(frame(spark, data)).shares().collect()}
    assert abs(shares["train"] - 0.7) < 0.02 and abs(shares["validation"] - 0.15) < 0.02 and abs(shares["test"] - 0.15) < 0.02


def test_one_group_with_a_third_of_all_rows(spark):
    data = [(f"s{i}", f"i{i}", "hot") for i in range(100)] + [(f"t{i}", f"j{i}", f"g{i}") for i in range(200)]
    got = assign_splits(frame(spark, data)).assignment()
    assert got.where("sample_id like 's%'").select("split_name").distinct().count() == 1


def test_incremental(spark):
    first = [(f"s{i}", f"i{i}", f"g{i}") for i in range(40)]
    one = assign_splits(frame(spark, first))
    before = {r["sample_id"]: r["split_name"] for r in one.assignment().collect()}
    by = {}
    for s, split in before.items():
        by.setdefault(split, []).append(s[1:])
    a, b = by["train"][:2]  # two components of one split may merge
    c, d = by["train"][2], by["test"][0]  # two of different splits may not
    more = [("new1", f"i{a}", f"g{b}"), ("new2", f"i{c}", f"G{d} "), ("new3", None, "fresh"), ("new4", None, None), ("s0", "i0", "late")]
    two = assign_splits(frame(spark, more), one)
    after = {r["sample_id"]: (r["split_name"], r["status"]) for r in two.assignment().collect()}
    assert after["new1"] == ("train", "assigned")
    for s in ("new2", f"s{c}", f"s{d}"):
        assert after[s] == (None, "quarantined")
    for s, split in before.items():
        if s not in (f"s{c}", f"s{d}"):
            assert after[s] == (split, "assigned"), s
    assert after["new3"][0] and after["new4"][0]
    assert rows(two.group_pairs()) == pairs(first + more)
    third = assign_splits(frame(spark, []), two)  # an empty batch
    assert rows(third.assignment()) == rows(two.assignment())
    assert rows(ComponentTable(spark, two.path).assignment()) == rows(two.assignment())  # the table persists
    whole = two.compacted()
    assert rows(whole.assignment()) == rows(two.assignment()) and len(whole.paths) == 1 and whole.alias.count() == 0
    # A delivery is written as such: what was there before is not written again.
    assert spark.read.parquet(f"{two.path}/samples").count() == 4 and spark.read.parquet(f"{two.path}/components").count() < 8
    assert {r["sample_id"] for r in spark.read.parquet(f"{two.path}/samples").collect()} == {"new1", "new2", "new3", "new4"}


def test_deliveries_one_after_the_other_find_the_same_components(spark):
    data = made_up(11, 120)
    table, kept = None, {}
    for at in range(0, len(data), 30):
        table = assign_splits(frame(spark, data[at : at + 30]), table)
        so_far = data[: at + 30]
        assert rows(table.group_pairs()) == pairs(so_far)
        got = {r["sample_id"]: r for r in table.assignment().collect()}
        samples = [[v for k, v in c if k == "s"] for c in components(so_far)]
        assert sorted(got) == sorted(x for c in samples for x in c)
        for c in samples:
            assert len({got[x]["component"] for x in c}) <= 1 and len({got[x]["split_name"] for x in c}) <= 1
        for x, split in kept.items():
            assert got[x]["split_name"] == split or got[x]["status"] == "quarantined"
        kept = {x: r["split_name"] for x, r in got.items() if r["split_name"]}
        counted = {r["comp"]: r["samples"] for r in table.components.collect()}
        real = {}
        for r in got.values():
            real[r["component"]] = real.get(r["component"], 0) + 1
        assert {c: n for c, n in counted.items() if n} == real
    assert rows(table.compacted().group_pairs()) == pairs(data)


def test_unsettled_labels_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(splits, "MAX_ROUNDS", 2)
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(60)], "u string, v string")
    with pytest.raises(RuntimeError):
        connected(edges)


def test_empty_table(spark):
    t = assign_splits(frame(spark, []))
    assert t.assignment().count() == 0 and t.group_pairs().count() == 0
    t = assign_splits(frame(spark, [(None, None, None), (None, "i", "g"), (None, "I ", "h")]))
    assert t.assignment().count() == 0 and rows(t.group_pairs()) == [("g", "h")]
