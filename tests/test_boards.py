"""Boards against plain sequential versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions.signature import cell_width, cyclic_next, decode_signature, encode_prefix, encode_signature
from gridloom.operators.boards import Game, check_sequence, cyclic_window, evaluate_payouts, exact_match, forecast_path, forecast_summary, prefix_match
from tests.conftest import rows

GAME = Game()


def plain_matches(cells):
    """Every payline with every symbol: the longest defined length within the run, if it holds the symbol."""
    out = []
    for name, path in GAME.paylines.items():
        line = [cells[r * 5 + c] for c, r in enumerate(path)]
        for s in GAME.symbols:
            run = 0
            while run < 5 and line[run] in (s, 11):
                run += 1
            lengths = [n for (t, n) in GAME.payouts if t == s and n <= run]
            if lengths and s in line[: max(lengths)]:
                out.append((name, s, max(lengths), GAME.payouts[s, max(lengths)], line[: max(lengths)].count(11)))
    return out


def test_payouts_equal_plain_evaluation(spark):
    rng = random.Random(7)
    boards = [[rng.choice((1, 2, 3, 11)) if rng.random() < 0.7 else rng.randint(1, 11) for _ in range(15)] for _ in range(400)] + [[11] * 15, [1] * 15]
    df = spark.createDataFrame([(i + 1, b) for i, b in enumerate(boards)] + [(10_000, None), (10_001, [1, 1, 1])], "sequence_number bigint, cells array<int>")
    got = {r["sequence_number"]: r for r in evaluate_payouts(df).collect()}
    for i, b in enumerate(boards):
        want = plain_matches(b)
        r = got[i + 1]
        assert [tuple(m) for m in r["matches"]] == want and r["payout"] == sum(m[3] for m in want) and r["match_count"] == len(want)
    assert got[10_001]["payout"] == 0  # too few cells: no line is whole
    assert got[10_000]["payout"] == 0


def plain_forecast(pay, start, cost, limit):
    n, net, last, rising, out = len(pay), 0, 0, None, []
    for spin in range(1, min(limit, n - 1) + 1):
        p = pay[(start - 1 + spin) % n]
        net += p - cost
        if net > last:
            rising = (spin, net)
        elif net < last:
            if rising and rising[1] > 0:
                out.append(rising)
            rising = None
        last = net
    return out + ([rising] if rising and rising[1] > 0 else []), net


@pytest.mark.parametrize("seed", range(4))
def test_forecast_equals_sequential_scan(spark, seed):
    rng = random.Random(seed)
    n = rng.choice((1, 2, 9, 60))
    pay = [rng.choice((0, 0, 10, 10, 20, 35)) for _ in range(n)]
    df = spark.createDataFrame([(i + 1, p) for i, p in enumerate(pay)], "sequence_number bigint, payout bigint")
    for start, limit in ((1, 500), (max(1, n // 2), 500), (n, 7)):
        path = forecast_path(df, start, n, 10, limit)
        want, net = plain_forecast(pay, start, 10, limit)
        assert [(r["spin"], r["net"]) for r in path.where("peak").orderBy("spin").collect()] == want
        s = forecast_summary(path).first()
        assert s["final_net"] == net and s["evaluated_spins"] == min(limit, n - 1) and s["peaks"] == len(want)


def test_forecast_refuses_negative_payouts(spark):
    df = spark.createDataFrame([(1, 1), (2, -1)], "sequence_number bigint, payout bigint")
    with pytest.raises(Exception, match="negative"):
        forecast_path(df, 1, 2, 10).collect()


def _steps(spark, numbers):
    return spark.createDataFrame([(i, 10) for i in numbers], "sequence_number bigint, payout bigint")


@pytest.mark.parametrize("numbers", [[1, 2, 4, 5], [1, 2, 3, 3, 4, 5], [1, 2, 2, 4, 5], [1, 2, 3, 4], [1], []])
@pytest.mark.parametrize("of", [lambda p: p, forecast_summary, lambda p: p.where("peak"), lambda p: p.select("spin")])
def test_forecast_refuses_missing_and_repeated_numbers(spark, numbers, of):
    with pytest.raises(Exception, match="missing or repeated"):
        of(forecast_path(_steps(spark, numbers), 1, 5, 10)).collect()


def test_forecast_checks_every_block(spark):
    n = 40_000
    df = spark.range(1, n + 1).select(F.col("id").alias("sequence_number"), F.lit(10).cast("bigint").alias("payout"))
    assert forecast_path(df, 1, n, 10).count() == n - 1
    for lost in ("sequence_number <> 20000", "sequence_number <> 16384", "sequence_number <> 40000", "sequence_number not between 16385 and 32768", "sequence_number < 32769"):
        with pytest.raises(Exception, match="missing or repeated"):
            forecast_summary(forecast_path(df.where(lost), 1, n, 10)).collect()
    assert forecast_path(df.where("sequence_number < 20000"), 1, n, 10, 18_000).count() == 18_000  # nothing is lost within the limit
    assert forecast_path(df.limit(0), 1, 1, 10).count() == 0


def test_forecast_without_a_limit_takes_every_spin(spark):
    n = 500_003
    df = spark.range(1, n + 1).select(F.col("id").alias("sequence_number"), F.when(F.col("id") == n - 1, 100).otherwise(10).cast("bigint").alias("payout"))
    path = forecast_path(df, n, n, 10)
    assert tuple(forecast_summary(path).first()) == (n - 1, 10 * (n - 1) + 90, 10 * (n - 1), 90, 1)
    assert [r["spin"] for r in path.where("peak").collect()] == [n - 1]


def test_signatures(spark):
    df = spark.createDataFrame([([1, 10, 3],), ([],), (None,), ([1, None, 3],), ([1, None, None],), ([0, 1, 2],), ([100, 1, 2],)], "c array<int>")
    got = df.select(encode_signature(F.col("c"), 2), encode_prefix(F.col("c"), 2)).collect()
    assert [r[0] for r in got] == ["011003", None, None, None, None, None, None]
    assert [r[1] for r in got] == ["011003", "", None, None, "01", None, None]
    d = spark.createDataFrame([("011003",), ("01100",), ("0100",), ("",), ("01x0",), (None,), ("٠١",)], "s string")
    assert [r[0] for r in d.select(decode_signature(F.col("s"), 2)).collect()] == [[1, 10, 3], None, None, [], None, None, None]
    assert d.select(decode_signature(F.col("s"), 2, 2)).first()[0] is None
    assert cell_width(11) == 2 and cell_width(32767) == 5
    assert spark.range(1, 4).select(cyclic_next(F.col("id"), 3)).collect()[2][0] == 1
    with pytest.raises(ValueError):
        cell_width(0)


def test_matching(spark):
    df = spark.createDataFrame([(1, "0102"), (2, "0103"), (3, "0102"), (4, "0202")], "sequence_number bigint, signature string")
    kinds = {p: prefix_match(df, p).first()["kind"] for p in ("", "0102", "02", "01", "99")}
    assert kinds == {"": "ambiguous", "0102": "duplicate", "02": "unique", "01": "ambiguous", "99": "none"}
    probes = spark.createDataFrame([("0102",), ("0102",), ("0202",), ("0303",)], "signature string")
    assert rows(exact_match(df, probes)) == [("0102", "duplicate", 2, [1, 3]), ("0202", "unique", 1, [4]), ("0303", "not_found", 0, None)]
    assert exact_match(df, probes, most=1).where("signature = '0102'").first()["at"] is None
    assert [r["spin"] for r in cyclic_window(df, 3, 4, 2).orderBy("spin").collect()] == [1, 2]
    numbers = spark.range(1, 12).select(F.col("id").alias("sequence_number"))
    for start, limit in itertools.product((1, 5, 11), (1, 6, 10, 50, None)):
        got = [(r["spin"], r["sequence_number"]) for r in cyclic_window(numbers, start, 11, limit).orderBy("spin").collect()]
        assert got == [(k, (start - 1 + k) % 11 + 1) for k in range(1, min(limit or 99, 10) + 1)]
    assert check_sequence(df, 4).first()["complete"] and not check_sequence(df, 5).first()["complete"]
    assert prefix_match(df.limit(0), "01").first()["candidate_count"] == 0
