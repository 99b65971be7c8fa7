import pytest

from gridloom.llm.mixture import _goals, mix_sources

DOCS = "doc_id bigint, text string, source string, n_tokens int, Source string, copies string"
TARGETS = "source string, target_share double, max_repeats int"


def frame(spark, data):
    return spark.createDataFrame([(*d, 1, "x", "y") for d in data], DOCS)


def docs(n, source, words, start=0):
    return [(start + i, " word" * (1 + (i * 7) % words), source) for i in range(n)]


def test_shares_and_caps(spark):
    data = docs(400, "a", 40) + docs(60, "b", 40, 1000) + docs(5, "c", 10, 2000) + docs(30, "z", 5, 3000) + [(4000, None, "a"), (4001, "", "b"), (4002, "lost", None)]
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 4), ("c", 0.1, 2), ("gone", 0.0, 3)], TARGETS)
    m = mix_sources(frame(spark, data), t, total_tokens=6000)
    s = {r["source"]: r for r in m.shares.collect()}
    got = m.documents.collect()
    assert len({r["doc_id"] for r in got}) == len(got) and all(1 <= r["copies"] <= {"a": 1, "b": 4, "c": 2}[r["source"]] for r in got)
    assert s["c"]["state"] == "at_cap" and s["c"]["tokens_reached"] == 2 * s["c"]["tokens_available"]
    for x in "ab":
        assert s[x]["state"] == "met" and abs(s[x]["tokens_reached"] - s[x]["tokens_wanted"]) <= 45, s[x]
    assert s["z"]["state"] == s[None]["state"] == "no_target" and s["z"]["tokens_reached"] == 0
    assert s["gone"]["state"] == "no_tokens"
    assert abs(sum(r["reached_share"] for r in s.values()) - 1) < 1e-4
    assert s["a"]["tokens_reached"] == sum(r["copies"] * r["n_tokens"] for r in got if r["source"] == "a")


def test_default_size_and_repeatability(spark):
    data = docs(200, "a", 30) + docs(50, "b", 30, 1000)
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 5), ("b", 0.3, 5)], TARGETS)
    one, two = (mix_sources(frame(spark, data).repartition(k), t) for k in (1, 5))
    assert sorted(map(tuple, one.documents.collect())) == sorted(map(tuple, two.documents.collect()))
    r = {x["source"]: x for x in one.shares.collect()}
    assert abs(r["a"]["reached_share"] - 0.5) < 0.02 and r["a"]["newton_rounds"] < 30


def test_one_length_for_all_is_split_by_hash(spark, monkeypatch):
    from gridloom.llm import mixture

    monkeypatch.setattr(mixture, "ROWS_PER_RANK", 20)
    data = [(i, "one two three", "a") for i in range(300)] + [(1000 + i, "one two three", "b") for i in range(100)]
    m = mix_sources(frame(spark, data), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], TARGETS), total_tokens=600)
    s = {r["source"]: r for r in m.shares.collect()}
    assert abs(s["a"]["tokens_reached"] - 300) <= 3 and abs(s["b"]["tokens_reached"] - 300) <= 3


def test_rates_that_are_not_found_are_an_error(spark, monkeypatch):
    from gridloom.llm import mixture

    monkeypatch.setattr(mixture, "MAX_STEPS", 1)
    data = docs(200, "a", 30) + docs(50, "b", 30, 1000)
    with pytest.raises(RuntimeError, match="do not meet"):
        mix_sources(frame(spark, data), spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 5)], TARGETS))


def test_empty(spark):
    t = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    m = mix_sources(frame(spark, []), t)
    assert m.documents.count() == 0 and m.shares.first()["tokens_reached"] == 0
    m = mix_sources(frame(spark, docs(3, "a", 3)), t.limit(0))
    assert m.documents.count() == 0


def test_goals():
    g = _goals({"a": (0.5, 1), "b": (0.5, 2)}, {"a": 100.0, "b": 10.0}, 100.0)
    assert g["b"] == 20 and g["a"] == pytest.approx(80)
    assert _goals({"a": (1.0, 1)}, {}, 10.0) == {"a": 0.0}
