"""States kept in files, late merges and the validation cursor."""

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from gridloom.streaming.checkpoints import check_state, CheckpointInvalid, group_with_checkpoints, late_merge
from gridloom.streaming.grouping import distance, group_observations
from gridloom.streaming.validation import STAGED, validation_progress, validation_stream
from tests.conftest import rows

RUNS = "run string, order bigint, fingerprint string, quality double, geometry double"


def made_up(seed, n=150):
    rng = random.Random(seed)
    base, out = 0, []
    for i in range(n):
        if rng.random() < 0.15:
            base = rng.getrandbits(64)
        noise = base ^ (1 << rng.randrange(64)) if rng.random() < 0.9 else rng.getrandbits(64)
        out.append((i, f"{noise:016x}", rng.random(), rng.choice((0.5, 0.9, 0.9))))
    return out


def test_grouping_goes_on_from_any_place(spark, tmp_path):
    df = spark.createDataFrame([(r, *o) for s, r in enumerate(("a", "b", "c")) for o in made_up(s, 60 + 45 * s)], RUNS).repartition(3)
    want = rows(group_observations(df))
    for stops in ((), (5,), (32,), (33, 70), (64, 64, 149)):
        folder = str(tmp_path / f"s{'-'.join(map(str, stops))}")
        for stop in stops:
            assert group_with_checkpoints(df, folder, stop_after=stop).count() == 0
        assert rows(group_with_checkpoints(df, folder)) == want, stops
        assert rows(group_with_checkpoints(df, folder)) == want  # once more, from the last states
    assert group_with_checkpoints(df.limit(0), str(tmp_path / "none")).count() == 0


def test_states_that_do_not_fit_are_errors(spark, tmp_path):
    df = spark.createDataFrame([("a", *o) for o in made_up(1)], RUNS)
    group_with_checkpoints(df, str(tmp_path / "s"), stop_after=70).count()
    with pytest.raises(Exception, match="changed before its state"):
        group_with_checkpoints(df.where("order <> 3"), str(tmp_path / "s")).count()
    with pytest.raises(Exception, match="fewer observations"):
        group_with_checkpoints(df.where("order < 20"), str(tmp_path / "s")).count()
    name = sorted(glob.glob(str(tmp_path / "s" / "*" / "*.json")))[-1]
    state = json.load(open(name))
    groups = [tuple(g) for f in sorted(glob.glob(str(tmp_path / "s" / "*" / "*.json"))) for g in json.load(open(f))["closed"]]
    check_state(state, groups)
    for change in ({"schema": 2}, {"selector": "x"}, {"processed": -1}, {"finalized": 99}, {"group": None}, {"next": -5}):
        with pytest.raises(CheckpointInvalid):
            check_state({**state, **change}, groups)
    with open(name, "w") as f:
        json.dump({**state, "selector": "other"}, f)
    with pytest.raises(Exception, match="inconsistent"):
        group_with_checkpoints(df, str(tmp_path / "s")).count()


def plain_merge(groups):
    out, done = {}, {}
    for order, a, b, print_, resolved in groups:
        if not resolved or a is None or b is None:
            out[order] = ("open", None, None)
        elif (a, b) in done:
            out[order] = ("duplicate", done[a, b], None)
        else:
            still = [g for g in groups if g[0] < order and out[g[0]][0] == "open"]
            found = [g[0] for g in still if (g[1], g[2]) == (a, b)] or [g[0] for g in still if distance(print_ or "", g[3] or "") <= 0.10]
            if found:
                out[order], out[found[0]], done[a, b] = ("duplicate", found[0], None), ("closed", None, order), found[0]
            else:
                out[order], done[a, b] = ("selected", None, None), order
    return out


def test_late_merges(spark):
    rng = random.Random(8)
    data = {}
    for run in ("r", "s", "t"):
        bases = [rng.getrandbits(64) for _ in range(6)]
        data[run] = [(i, *rng.choice([(k, k + 3) for k in range(5)] + [(None, None)]), rng.choice([f"{rng.choice(bases) ^ (1 << rng.randrange(64)):016x}", None]), rng.random() < 0.5) for i in range(60)]
    df = spark.createDataFrame([(r, *g) for r, gs in data.items() for g in gs], "run string, group_order int, range_start bigint, range_end bigint, fingerprint string, resolved boolean").repartition(4)
    got = {(r["run"], r["group_order"]): (r["status"], r["duplicate_of"], r["closed_by"]) for r in late_merge(df).collect()}
    want = {(run, k): v for run, gs in data.items() for k, v in plain_merge(gs).items()}
    # Of open groups of one range the first is closed; the plain form says the same.
    assert got == want and {v[0] for v in got.values()} == {"open", "closed", "selected", "duplicate"}
    assert late_merge(df.limit(0)).count() == 0


def test_validation_keeps_its_place(spark, tmp_path):
    staged, target, ck = (str(tmp_path / x) for x in ("staged", "target", "ck"))
    part = lambda a, b: spark.createDataFrame([("j", i, [1, 2] if i % 3 else [1], None) for i in range(a, b)], STAGED).coalesce(1).write.mode("append").parquet(staged)
    part(1, 10)

    def run():
        q = validation_stream(spark, staged, target, ck, 2, [1, 2], 1)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return tuple(validation_progress(spark, staged, target).first())

    assert run() == ("j", 9, 9, 6, 3, 9, True)
    part(10, 14)
    assert tuple(validation_progress(spark, staged, target).first()) == ("j", 13, 9, 6, 3, 9, False)
    assert run() == ("j", 13, 13, 9, 4, 13, True)
    assert spark.read.parquet(f"{target}/rows").where(F.col("signature").isNotNull()).count() == 9
    spark.createDataFrame([("j", 1, [1], None)], STAGED).write.mode("overwrite").parquet(staged)
    with pytest.raises(Exception, match="staging changed"):
        validation_progress(spark, staged, target).collect()
