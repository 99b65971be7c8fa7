"""Picking boards to look at: uncertain, unlike each other, from unseen sources, of rare classes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.measures import entropy, jensen_shannon
from gridloom.runtime import cut

# The weights of the four parts of the score, and how many of a board's cells make its uncertainty.
UNCERTAINTY, DIVERSITY, NOVELTY, RARITY = 0.65, 0.15, 0.15, 0.05
WORST_CELLS = 5


def board_features(cells: DataFrame, per_board: int = 15) -> DataFrame:
    """``(id, source, sequence_number, base, mean)`` of ``cells(id, source, sequence_number, cell, probabilities)``.

    ``base`` is the weighted sum of what does not depend on the choice: the mean entropy of the least certain cells, and
    how rare the board's likeliest classes are among all cells. ``mean`` is the mean of the probabilities. Only boards of
    exactly ``per_board`` distinct cells with probabilities come out; repeated cells with equal content count once.
    """
    p = F.col("probabilities")
    c = cells.where(p.isNotNull()).select("id", "source", "sequence_number", "cell", p, entropy(p).alias("h"), (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("top")).distinct()
    whole = c.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("cell").alias("k")).where((F.col("n") == per_board) & (F.col("k") == per_board)).select("id")
    c = cut(c.join(whole, "id", "left_semi"), "selection-cells")
    often = c.groupBy("top").agg(F.count("*").alias("often"))  # a row a class
    most = often.agg(F.max("often").alias("most"))
    c = c.join(often.join(most), "top").withColumn("rare", 1 - F.col("often") / F.col("most"))
    b = c.groupBy("id").agg(
        F.first("source").alias("source"), F.first("sequence_number").alias("sequence_number"), F.avg("rare").alias("rare"),
        F.sort_array(F.collect_list("h"), asc=False).alias("h"), F.collect_list("probabilities").alias("p"),  # per_board rows at most
    )
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = F.aggregate(F.slice("p", 2, per_board - 1), F.get("p", F.lit(0)), lambda s, x: F.zip_with(s, x, lambda u, v: u + v))
    sure = total(F.slice("h", 1, WORST_CELLS)) / F.least(F.size("h"), F.lit(WORST_CELLS))
    return b.select("id", "source", "sequence_number", (UNCERTAINTY * sure + RARITY * F.col("rare")).alias("base"), F.transform(mean, lambda x: x / per_board).alias("mean"))


def select_boards(cells: DataFrame, k: int, per_board: int = 15) -> DataFrame:
    """``(rank, id, score)``: ``k`` boards, one after the other.

    Each time the board of the highest score is taken: its base, how far its mean is from those taken (the smallest
    Jensen-Shannon divergence, 1 for the first), and whether its source is new. While there is a board of a source of which
    none was taken, boards of other sources are passed over. Of equal scores the smaller number, then the smaller id.
    A round is one pass over the boards with one row back, so the boards taken (at most ``k``) are all that is a literal.
    A null source is a source of its own; without boards there are no rows.
    """
    pool = cut(board_features(cells, per_board).withColumn("source", F.coalesce("source", F.lit(""))), "selection-pool")
    taken: list = []
    for _ in range(k):
        far = [jensen_shannon(F.col("mean"), F.from_json(F.lit(json.dumps(r["mean"])), "array<double>")) for r in taken]
        diversity = F.lit(1.0) if not far else far[0] if len(far) == 1 else F.least(*far)
        new = ~F.col("source").isin(sorted({r["source"] for r in taken})) if taken else F.lit(True)
        left = pool.where(~F.col("id").isin([r["id"] for r in taken])) if taken else pool
        scored = left.withColumn("score", F.col("base") + DIVERSITY * diversity + F.when(new, NOVELTY).otherwise(0.0)).withColumn("new", new)
        row, key = F.struct("id", "source", "mean", "score"), F.struct(-F.col("score"), "sequence_number", "id")
        best = scored.agg(F.min_by(row, F.when(F.col("new"), key)).alias("unseen"), F.min_by(row, key).alias("any"), F.count_if("new").alias("n")).first()
        one = best["unseen"] if best["n"] else best["any"]
        if one is None:
            break
        taken.append(one)
    kind = cells.schema["id"].dataType.simpleString()
    return cells.sparkSession.createDataFrame([(i + 1, r["id"], r["score"]) for i, r in enumerate(taken)], f"rank int, id {kind}, score double")
