"""Queries of the analytic core: matching, payouts, the cyclic scan and the forecast."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.signature import cyclic_next
from gridloom.operators.boards import check_sequence, cyclic_window, evaluate_payouts, exact_match, forecast_path, forecast_summary, prefix_match
from gridloom.plans.common import GAME, LAYOUTS, PAYOUTS, layouts, payouts
from gridloom.runtime import cut, table

START = 777


def _n(spark, sf):
    return table(spark, sf, "orders").count()


def _prefixes(spark, sf):
    """Match results of several prefixes: none given, one cell, three, six, and one that no board has."""
    boards = layouts(spark, sf)
    out = None
    for p in ("", "03", "030405", "0102030405", "99"):
        one = prefix_match(boards, p).withColumn("prefix", F.lit(p))
        out = one if out is None else out.unionByName(one)
    return out


def _exact(spark, sf):
    boards = layouts(spark, sf)
    probes = boards.where("sequence_number % 50 = 0").select("signature").unionByName(spark.createDataFrame([("9" * 30,)], "signature string"))
    return exact_match(boards, probes).withColumn("at", F.concat_ws(",", F.transform("at", lambda x: x.cast("string"))))


def _next(spark, sf):
    boards, n = layouts(spark, sf).select("sequence_number", "signature"), _n(spark, sf)
    following = boards.select(F.col("sequence_number").alias("next_number"), F.col("signature").alias("next_signature"))
    return boards.withColumn("next_number", cyclic_next(F.col("sequence_number"), n)).join(following, "next_number").select("sequence_number", "signature", "next_number", "next_signature")


def _forecast(spark, sf):
    return forecast_path(payouts(spark, sf), START, _n(spark, sf), GAME.spin_cost)


def _matches(spark, sf):
    m = evaluate_payouts(layouts(spark, sf), GAME).select("sequence_number", F.explode("matches").alias("m"))
    return m.select("sequence_number", "m.*")


def _readiness(spark, sf):
    """Facts of a payout run: layouts, payouts, layouts without one (here: the unevaluated are those that win
    nothing), the sum of matches against the totals, and the issues that follow."""
    p = cut(evaluate_payouts(layouts(spark, sf), GAME).select("sequence_number", "payout", "matches"), "readiness")
    facts = p.agg(F.count("*").alias("layouts"), F.count_if(F.col("payout") > 0).alias("paying"), F.count_if(F.aggregate("matches", F.lit(0).cast("bigint"), lambda s, m: s + m["payout"]) != F.col("payout")).alias("audit_differences"))
    issues = F.array_compact(F.array(F.when(F.col("layouts") == 0, F.lit("empty")), F.when(F.col("paying") < F.col("layouts"), F.lit("missing")), F.when(F.col("audit_differences") > 0, F.lit("audit"))))
    return facts.withColumn("issues", F.concat_ws(",", issues))


QUERIES = {
    "dom_prefix_match": _prefixes,
    "dom_exact_match": _exact,
    "dom_layout_by_sequence": lambda s, d: layouts(s, d).where(F.col("sequence_number") == START).select("sequence_number", "signature"),
    "dom_next_layout": _next,
    "dom_payout_eval": lambda s, d: evaluate_payouts(layouts(s, d), GAME).select("sequence_number", "payout", "match_count"),
    "dom_payout_batch": payouts,
    "dom_payout_matches": _matches,
    "dom_payout_readiness": _readiness,
    "dom_cyclic_payouts": lambda s, d: cyclic_window(payouts(s, d), START, _n(s, d)).select("spin", "sequence_number", "payout"),
    "dom_cyclic_integrity": lambda s, d: check_sequence(layouts(s, d), _n(s, d)),
    "dom_forecast": lambda s, d: _forecast(s, d).where("peak").drop("peak"),
    "dom_forecast_path": lambda s, d: _forecast(s, d).drop("peak"),
    "dom_forecast_summary": lambda s, d: forecast_summary(_forecast(s, d)),
}

_FORECAST = (
    PAYOUTS
    + f""",
scan AS (SELECT (sequence_number - {START} + c.n) % c.n AS spin, sequence_number, payout FROM payouts, (SELECT count(*) AS n FROM orders) c WHERE sequence_number <> {START}),
walk AS (SELECT *, sum(payout) OVER (ORDER BY spin)::bigint AS cumulative_payout, spin * 10 AS cumulative_cost, sign(payout - 10) AS turn FROM scan),
peaks AS (SELECT spin FROM (SELECT spin, turn, lead(turn) OVER (ORDER BY spin) AS following FROM walk WHERE turn <> 0) WHERE turn = 1 AND coalesce(following, -1) = -1)"""
)
_PREFIX = " UNION ALL ".join(
    f"""SELECT '{p}' AS prefix, count(*) AS candidate_count, CASE WHEN count(*) = 0 THEN 'none' WHEN count(*) = 1 THEN 'unique' WHEN count(DISTINCT signature) = 1 THEN 'duplicate' ELSE 'ambiguous' END AS kind,
 CASE WHEN count(DISTINCT signature) = 1 THEN min(signature) END AS signature, CASE WHEN count(*) = 1 THEN min(sequence_number) END AS sequence_number FROM boards WHERE starts_with(signature, '{p}')"""
    for p in ("", "03", "030405", "0102030405", "99")
)

SQL = {
    "dom_prefix_match": f"WITH {LAYOUTS} {_PREFIX}",
    "dom_exact_match": f"""WITH {LAYOUTS}, probes AS (SELECT DISTINCT signature FROM boards WHERE sequence_number % 50 = 0 UNION SELECT repeat('9', 30))
SELECT p.signature, CASE WHEN count(b.signature) = 0 THEN 'not_found' WHEN count(b.signature) = 1 THEN 'unique' ELSE 'duplicate' END AS kind, count(b.signature) AS candidate_count,
 CASE WHEN count(b.signature) BETWEEN 1 AND 20 THEN string_agg(b.sequence_number::varchar, ',' ORDER BY b.sequence_number) ELSE '' END AS at FROM probes p LEFT JOIN boards b ON p.signature = b.signature GROUP BY p.signature""",
    "dom_layout_by_sequence": f"WITH {LAYOUTS} SELECT sequence_number, signature FROM boards WHERE sequence_number = {START}",
    "dom_next_layout": f"""WITH {LAYOUTS} SELECT a.sequence_number, a.signature, b.sequence_number AS next_number, b.signature AS next_signature FROM boards a JOIN boards b ON b.sequence_number = a.sequence_number % (SELECT count(*) FROM orders) + 1""",
    "dom_payout_eval": f"WITH {PAYOUTS} SELECT * FROM payouts",
    "dom_payout_batch": f"WITH {PAYOUTS} SELECT * FROM payouts",
    "dom_payout_matches": f"WITH {PAYOUTS} SELECT * FROM matches",
    "dom_payout_readiness": f"""WITH {PAYOUTS} SELECT count(*) AS layouts, count(*) FILTER (payout > 0) AS paying, 0 AS audit_differences,
 concat_ws(',', CASE WHEN count(*) = 0 THEN 'empty' END, CASE WHEN count(*) FILTER (payout > 0) < count(*) THEN 'missing' END) AS issues FROM payouts""",
    "dom_cyclic_payouts": f"WITH {_FORECAST} SELECT spin, sequence_number, payout FROM scan",
    "dom_cyclic_integrity": f"""WITH {LAYOUTS} SELECT count(*) AS rows, count(DISTINCT sequence_number) AS numbers, min(sequence_number) AS lowest, max(sequence_number) AS highest,
 count(*) = (SELECT count(*) FROM orders) AND count(DISTINCT sequence_number) = count(*) AND min(sequence_number) = 1 AND max(sequence_number) = count(*) AS complete FROM boards""",
    "dom_forecast": f"WITH {_FORECAST} SELECT spin, sequence_number, payout, cumulative_payout, cumulative_cost, cumulative_payout - cumulative_cost AS net FROM walk WHERE spin IN (SELECT spin FROM peaks) AND cumulative_payout > cumulative_cost",
    "dom_forecast_path": f"WITH {_FORECAST} SELECT spin, sequence_number, payout, cumulative_payout, cumulative_cost, cumulative_payout - cumulative_cost AS net FROM walk",
    "dom_forecast_summary": f"""WITH {_FORECAST} SELECT count(*) AS evaluated_spins, sum(payout)::bigint AS final_payout, max(cumulative_cost) AS final_cost, (sum(payout) - max(cumulative_cost))::bigint AS final_net,
 count(*) FILTER (spin IN (SELECT spin FROM peaks) AND cumulative_payout > cumulative_cost) AS peaks FROM walk""",
}
