"""Mixing sources to target shares of tokens by entropy balancing.

Every document starts with the rate 1 ("once"). Among all rates that give each source its share of the tokens,
the ones closest to that start in relative entropy are ``rate = exp(lambda_source * n_tokens / mean)``, cut at the
source's cap on repeats. The multipliers solve a convex dual, one coordinate for a source, by Newton steps whose
gradient and curvature are distributed sums over the (source, n_tokens) histogram. Rates become whole copies by
systematic rounding along (n_tokens, hash): a document gets the floor or the ceiling of its rate, and the tokens
of a source miss their goal by about the length of one document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.bpe import DEFAULT_TOKENIZER, count_tokens
from gridloom.runtime import cut, pick

MAX_SOURCES = 10_000  # of the target table, which a person writes; more is an error
MAX_STEPS = 60
TOLERANCE = 1e-9  # of the goal, at which a source is done
ENOUGH = 1e-6  # of the goal, that a source may miss after all steps; more is an error
ROWS_PER_RANK = 200_000  # documents that one ranking group holds on average at most


@dataclass(frozen=True)
class Mixture:
    """``documents``: (id, source, n_tokens, rate, copies); ``shares``: a row for each target and other source."""

    documents: DataFrame
    shares: DataFrame


def _goals(targets: dict[str, tuple[float, int]], available: dict[str, float], total: float) -> dict[str, float]:
    """Tokens each source shall give. A source that cannot give its share even at its cap gives all it can; what
    is missing then goes to the others in proportion to their shares, until all fit."""
    goal: dict[str, float] = {}
    open_ = {s for s, (share, _) in targets.items() if share > 0}
    left = total
    while open_:
        weight = sum(targets[s][0] for s in open_)
        full = [s for s in open_ if left * targets[s][0] / weight >= targets[s][1] * available.get(s, 0.0)]
        if not full:
            for s in open_:
                goal[s] = left * targets[s][0] / weight
            break
        for s in full:
            goal[s] = targets[s][1] * available.get(s, 0.0)
            left -= goal[s]
            open_.discard(s)
    return goal


def _per_source(values: dict[str, float], source: Column) -> Column:
    entries = [x for s, v in values.items() for x in (F.lit(s), F.lit(float(v)))]
    return F.element_at(F.create_map(*entries), source) if entries else F.lit(None).cast("double")


def mix_sources(documents: DataFrame, source_targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                total_tokens: float | None = None, tokenizer: str = DEFAULT_TOKENIZER, seed: int = 42) -> Mixture:
    """A mixture in which each source has its ``target_share`` of all tokens and no document more than
    ``max_repeats`` copies.

    ``total_tokens``: the size wanted; by default the tokens of all documents of targeted sources. The report has
    ``feasible_tokens``, the largest size at which every source that has tokens at all would meet its share.

    Defined results: texts without tokens (null, empty) get 0 copies; sources that are null or have no target get 0
    copies and a report row with a null target; a target without documents is reported with 0 tokens; no documents
    give an empty mixture; of repeated target rows the largest share and the smallest cap count; repeated ids are
    documents of their own. Extra columns are ignored. The result is the same in every run with the same seed.
    """
    spark = documents.sparkSession
    rows = pick(source_targets, "source", "target_share", "max_repeats").groupBy("source").agg(F.max("target_share").alias("share"), F.min("max_repeats").alias("cap")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    targets = {r["source"]: (float(r["share"] or 0.0), max(0, int(r["cap"] or 0))) for r in rows if r["source"] is not None}

    counted = pick(documents, id_col, source_col, text_col).select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col(text_col).alias("_text"))
    base = cut(count_tokens(counted, ["_id", "_source"], "_text", tokenizer), "mixture-tokens")
    hist = cut(base.groupBy("_source", "n_tokens").agg(F.count("*").alias("n")), "mixture-histogram")
    sums = {r["_source"]: (int(r["docs"]), int(r["tokens"] or 0)) for r in hist.where(F.col("_source").isin(list(targets))).groupBy("_source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("n_tokens")).alias("tokens")).collect()}
    available = {s: float(t) for s, (_, t) in sums.items()}
    total = float(total_tokens) if total_tokens is not None else sum(available.values())
    goal = _goals(targets, available, total)
    feasible = min((targets[s][1] * available[s] / targets[s][0] for s in available if targets[s][0] > 0 and available[s] > 0), default=0.0)

    multiplier, rounds = _solve(hist, targets, available, {s: n for s, (n, _) in sums.items()}, goal)
    mean = {s: available[s] / sums[s][0] for s in multiplier}
    cap = {s: float(targets[s][1]) for s in multiplier}

    def rate(source: Column, n: Column) -> Column:
        tilted = F.exp(F.least(_per_source(multiplier, source) * n / _per_source(mean, source), F.lit(700.0)))
        known = _per_source(multiplier, source).isNotNull()  # least() passes over nulls
        return F.when((n > 0) & known, F.least(_per_source(cap, source), tilted)).otherwise(F.lit(0.0))

    # Ranks are taken inside (source, n_tokens, bucket): a length that very many documents share is split by hash.
    docs = sum(n for n, _ in sums.values())
    buckets = max(1, math.ceil(docs / ROWS_PER_RANK))
    lot = F.xxhash64(F.lit(seed), F.col("_id"))
    cells = base.withColumn("_lot", lot).withColumn("_bucket", F.pmod(F.col("_lot"), F.lit(buckets))).withColumn("rate", rate(F.col("_source"), F.col("n_tokens")))
    active = cells.where("rate > 0")
    # Where each of them starts: prefix sums over the lengths of a source, of which there are as many as its longest text
    # has tokens at most, and within a length over its buckets. No window holds more than one of the two.
    start = cut(active.groupBy("_source", "n_tokens", "_bucket").agg((F.count("*") * F.first("rate")).alias("_mass")), "mixture-masses")
    upto = lambda keys, order: F.coalesce(F.sum("_mass").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    lengths = start.groupBy("_source", "n_tokens").agg(F.sum("_mass").alias("_mass")).withColumn("_first", upto(["_source"], "n_tokens")).drop("_mass")
    start = start.withColumn("_inner", upto(["_source", "n_tokens"], "_bucket")).join(lengths, ["_source", "n_tokens"])
    start = start.select("_source", "n_tokens", "_bucket", (F.col("_first") + F.col("_inner")).alias("_before"))
    offset = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_source")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    ranked = active.withColumn("_k", F.row_number().over(Window.partitionBy("_source", "n_tokens", "_bucket").orderBy("_lot", "_id")))
    here = F.col("_before") + offset
    copies = F.floor(here + F.col("_k") * F.col("rate")) - F.floor(here + (F.col("_k") - 1) * F.col("rate"))
    chosen = ranked.join(start, ["_source", "n_tokens", "_bucket"]).withColumn("copies", F.least(copies, F.ceil(F.col("rate"))).cast("int"))
    chosen = cut(chosen.select("_id", "_source", "n_tokens", "rate", "copies").where("copies > 0"), "mixture-copies")
    out = chosen.select(F.col("_id").alias(id_col), F.col("_source").alias("source"), "n_tokens", F.round("rate", 9).alias("rate"), "copies")
    return Mixture(out, _report(spark, chosen, hist, targets, goal, feasible, rounds))


def _solve(hist: DataFrame, targets: dict, available: dict[str, float], docs: dict[str, int], goal: dict[str, float]) -> tuple[dict[str, float], int]:
    """The dual's multipliers by source, and the number of Newton rounds. One distributed sum a round for all
    sources together; on the driver there are four numbers for a source of the target table. Multipliers that still miss
    a goal after ``MAX_STEPS`` rounds are an error."""
    lam = {s: 0.0 for s in available if available[s] > 0 and goal.get(s, 0.0) > 0}
    low, high = dict.fromkeys(lam, -math.inf), dict.fromkeys(lam, math.inf)
    done, miss = set(), {}
    for s in lam:
        if goal[s] >= targets[s][1] * available[s] * (1 - 1e-12):
            lam[s] = 1e6  # everything at the cap
            done.add(s)
    for step in range(1, MAX_STEPS + 1):
        todo = [s for s in lam if s not in done]
        if not todo:
            return lam, step - 1
        n, t = F.col("n"), F.col("n_tokens")
        x = t / _per_source({s: available[s] / docs[s] for s in todo}, F.col("_source"))
        tilted = F.exp(F.least(_per_source({s: lam[s] for s in todo}, F.col("_source")) * x, F.lit(700.0)))
        cap = _per_source({s: targets[s][1] for s in todo}, F.col("_source"))
        got = hist.where(F.col("_source").isin(todo) & (t > 0)).groupBy("_source").agg(
            F.sum(n * t * F.least(cap, tilted)).alias("value"),
            F.sum(F.when(tilted < cap, n * t * x * tilted).otherwise(0.0)).alias("slope"),
        ).collect()
        for r in got:
            s, off = r["_source"], r["value"] - goal[r["_source"]]
            miss[s] = abs(off) / max(1.0, goal[s])
            if abs(off) <= TOLERANCE * max(1.0, goal[s]):
                done.add(s)
                continue
            (high if off > 0 else low)[s] = lam[s]
            new = lam[s] - off / r["slope"] if r["slope"] > 0 else math.nan
            if not low[s] < new < high[s] or abs(new - lam[s]) > 5:  # outside of the bracket, or a wild step
                if math.isinf(low[s]):
                    new = high[s] - max(1.0, abs(high[s]))
                elif math.isinf(high[s]):
                    new = low[s] + max(1.0, abs(low[s]))
                else:
                    new = (low[s] + high[s]) / 2
            if new == lam[s]:
                done.add(s)
            lam[s] = new
        done |= set(todo) - {r["_source"] for r in got}
    wrong = sorted(s for s in lam if s not in done and miss.get(s, 0.0) > ENOUGH)
    if wrong:
        raise RuntimeError(f"the rates of {wrong} do not meet their shares after {MAX_STEPS} steps")
    return lam, MAX_STEPS


def _report(spark, chosen: DataFrame, hist: DataFrame, targets: dict, goal: dict, feasible: float, rounds: int) -> DataFrame:
    there = hist.groupBy("_source").agg(F.sum("n").alias("docs_available"), F.sum(F.col("n") * F.col("n_tokens")).alias("tokens_available"))
    drawn = chosen.groupBy("_source").agg(F.count("*").alias("docs_used"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_reached"))
    wanted = spark.createDataFrame([(s, share, cap, float(goal.get(s, 0.0))) for s, (share, cap) in sorted(targets.items())] or [], "_source string, target_share double, max_repeats int, tokens_wanted double")
    joined = there.join(wanted, there["_source"].eqNullSafe(wanted["_source"]), "full").select(F.coalesce(there["_source"], wanted["_source"]).alias("_source"), "docs_available", "tokens_available", "target_share", "max_repeats", "tokens_wanted")
    joined = joined.join(drawn, joined["_source"].eqNullSafe(drawn["_source"]), "left").drop(drawn["_source"])
    joined = joined.fillna(0, ["docs_available", "tokens_available", "docs_used", "copies", "most_copies", "tokens_reached"])
    total = F.sum("tokens_reached").over(Window.partitionBy(F.lit(1)))  # a row a source
    share = F.when(total > 0, F.col("tokens_reached") / total).otherwise(F.lit(0.0))
    state = (
        F.when(F.col("target_share").isNull(), "no_target").when(F.col("tokens_available") == 0, "no_tokens")
        .when(F.col("tokens_wanted") >= F.col("max_repeats") * F.col("tokens_available") * (1 - 1e-12), "at_cap").otherwise("met")
    )
    return joined.select(
        F.col("_source").alias("source"), "target_share", F.round(share, 6).alias("reached_share"), "max_repeats", "most_copies", "docs_available", "docs_used", "copies",
        "tokens_available", F.round("tokens_wanted").cast("bigint").alias("tokens_wanted"), "tokens_reached", state.alias("state"), F.lit(int(feasible)).cast("bigint").alias("feasible_tokens"), F.lit(rounds).alias("newton_rounds"),
    )
