"""Metrics of predictions: confusion, calibration, threshold sweeps, percentiles, boundary comparison."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.measures import wilson_lower

SWEEP_BLOCKS = 4096  # of the unit interval


def confusion(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """``(actual, predicted, n)``; rows with a null on either side are left out."""
    return df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """``(class, support, predicted_as, hits, precision, recall, f1)`` from the confusion counts; undefined is 0."""
    a = matrix.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"))
    p = matrix.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("predicted_as"))
    z = lambda c: F.coalesce(c, F.lit(0))
    j = a.join(p, "class", "full").select("class", z("support").alias("support"), z("predicted_as").alias("predicted_as"), z("hits").alias("hits"))
    share = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    j = j.withColumn("precision", share(F.col("hits"), F.col("predicted_as"))).withColumn("recall", share(F.col("hits"), F.col("support")))
    total = F.col("precision") + F.col("recall")
    return j.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def calibration(df: DataFrame, confidence: str = "confidence", correct: str = "correct", bins: int = 10) -> DataFrame:
    """``(bin, n, mean_confidence, accuracy, gap)`` for bins of equal width, the last one closed."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    c = F.col(correct).cast("int")
    out = df.where(F.col(confidence).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(c).alias("accuracy"))
    return out.withColumn("gap", F.abs(F.col("mean_confidence") - F.col("accuracy")))


def calibration_summary(df: DataFrame, confidence: str = "confidence", correct: str = "correct", bins: int = 10) -> DataFrame:
    """One row: n, expected calibration error, Brier score and negative log likelihood of ``correct``."""
    c, p = F.col(correct).cast("int"), F.col(confidence)
    ece = calibration(df, confidence, correct, bins).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))
    q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    rest = df.where(p.isNotNull()).agg(F.count("*").alias("n"), F.avg((p - c) * (p - c)).alias("brier"), F.avg(-F.when(c == 1, F.ln(q)).otherwise(F.ln(1 - q))).alias("nll"))
    return rest.join(ece)  # a row each


def threshold_sweep(df: DataFrame, confidence: str = "confidence", correct: str = "correct", z: float = 1.96) -> DataFrame:
    """For every distinct confidence, as the least accepted one: accepted rows, hits, coverage, precision, and the
    lower Wilson bound. Rows are first counted by confidence, so the running sum goes over distinct values only."""
    by = df.where(F.col(confidence).isNotNull()).groupBy(F.col(confidence).alias("threshold")).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("int")).alias("k"))
    # No global window over the values: blocks of the confidence are summed, accumulated, and finished inside.
    by = by.withColumn("_block", F.floor(F.col("threshold") * SWEEP_BLOCKS))
    before = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = by.groupBy("_block").agg(F.sum("n").alias("_n"), F.sum("k").alias("_k"))
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    sums = sums.select("_block", upto("_n").alias("_n0"), upto("_k").alias("_k0"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_all"))
    down = Window.partitionBy("_block").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    out = by.withColumn("_n", F.sum("n").over(down)).withColumn("_k", F.sum("k").over(down)).join(sums, "_block")
    out = out.select("threshold", (F.col("_n0") + F.col("_n")).alias("accepted"), (F.col("_k0") + F.col("_k")).alias("hits"), ((F.col("_n0") + F.col("_n")) / F.col("_all")).alias("coverage"))
    return out.withColumn("precision", F.col("hits") / F.col("accepted")).withColumn("wilson", wilson_lower(F.col("hits"), F.col("accepted"), z))


def select_threshold(sweep: DataFrame, least: float, bound: str = "wilson") -> DataFrame:
    """The threshold that accepts most among those whose ``bound`` is at least ``least`` (of equals the lowest);
    no row where none passes."""
    best = sweep.where(F.col(bound) >= least).agg(F.max_by(F.struct(*sweep.columns), F.struct("accepted", -F.col("threshold"))).alias("r"))
    return best.where("r is not null").select("r.*")


def best_threshold(sweep: DataFrame, least: float) -> DataFrame:
    """As :func:`select_threshold`, but the most precise threshold where none passes."""
    ok = F.col("precision") >= least
    key = F.struct(ok.cast("int"), F.when(ok, F.col("accepted").cast("double")).otherwise(F.col("precision")), -F.col("threshold"))
    return sweep.agg(F.max_by(F.struct(*sweep.columns, ok.alias("passes")), key).alias("r")).where("r is not null").select("r.*")


def nearest_rank(q: float, column: str) -> Column:
    """The value of rank ``ceil(q * n)``, which is an element of the data."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY `{column}`)")


def linear_percentile(q: float, column: str) -> Column:
    """The percentile interpolated at rank ``(n - 1) * q``."""
    return F.percentile(column, q)


def mode_larger(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of every key; of equally frequent ones the larger."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.max_by(value, F.struct("_n", value)).alias(value))


def boundaries(df: DataFrame, keys: list[str], order: str, size: str) -> DataFrame:
    """The positions after which a group ends: running sums of the groups' sizes."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*keys, F.sum(size).over(w).alias("boundary"))


def compare_boundaries(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: boundaries expected, found and common; missing ones are false merges, superfluous ones false splits."""
    cols = [*keys, "boundary"]
    e, f = expected.select(*cols).distinct().withColumn("_e", F.lit(1)), found.select(*cols).distinct().withColumn("_f", F.lit(1))
    j = e.join(f, cols, "full").groupBy(*keys).agg(F.count("_e").alias("expected"), F.count("_f").alias("found"), F.count_if(F.col("_e").isNotNull() & F.col("_f").isNotNull()).alias("common"))
    return j.withColumn("false_merges", F.col("expected") - F.col("common")).withColumn("false_splits", F.col("found") - F.col("common"))


TEMPERATURES = (0.05, 20.0)  # fixed values: the range of the search


def fit_temperature(df: DataFrame, logits: str = "logits", label: str = "label", points: int = 64, rounds: int = 5) -> float:
    """The temperature that minimises the mean negative log likelihood of ``label`` (an index) under the softmax of
    ``logits``; 1 where no other is better, and for no rows.

    The loss has one minimum along the logarithm of the temperature. Each round is one pass that sums the loss at
    ``points`` places of the range at once and keeps the part around the best, so the range shrinks by ``points / 2`` a
    round, to far less than a step of a golden-section search of 96 passes can tell apart. Rows with a null, an empty or a
    single logit, or a label out of range, are left out.
    """
    low, high = (math.log(t) for t in TEMPERATURES)
    good = df.where((F.size(logits) > 1) & F.forall(logits, lambda x: x.isNotNull()) & (F.col(label) >= 0) & (F.col(label) < F.size(logits)))
    z = F.transform(logits, lambda x: x.cast("double") - F.array_max(F.col(logits)).cast("double"))
    src = good.select(z.alias("z"), F.get(z, F.col(label).cast("int")).alias("own"))

    def losses(at: list[float]) -> list[float]:
        def one(x: float) -> Column:
            t = math.exp(x)
            total = F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp(v / t))
            return F.avg(F.least(-(F.col("own") / t - F.ln(total)), F.lit(-math.log(1e-15))))

        return list(src.agg(*[one(x).alias(f"l{i}") for i, x in enumerate(at)]).first())

    for _ in range(rounds):
        at = [low + (high - low) * i / (points - 1) for i in range(points)]
        got = losses(at)
        if got[0] is None:
            return 1.0
        best = min(range(points), key=lambda i: got[i])
        low, high = at[max(best - 1, 0)], at[min(best + 1, points - 1)]
    middle = (low + high) / 2
    fitted, plain = losses([middle, 0.0])
    return 1.0 if plain <= fitted else math.exp(middle)
