"""Layouts (numbered boards): matching, evaluation along paylines, and the cyclic forecast."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.measures import safe
from gridloom.functions.signature import encode_signature
from gridloom.operators.ordering import _block, block_size, row_numbers


@dataclass(frozen=True)
class Game:
    """Dimensions and rules of a game; all of it is small, and becomes literals of the plan."""

    rows: int = 3
    columns: int = 5
    spin_cost: int = 10
    width: int = 2
    symbols: tuple[int, ...] = tuple(range(1, 11))
    wildcards: tuple[int, ...] = (11,)
    paylines: dict[str, tuple[int, ...]] = field(default_factory=lambda: {"l1": (0, 0, 0, 0, 0), "l2": (1, 1, 1, 1, 1), "l3": (2, 2, 2, 2, 2), "l4": (0, 1, 2, 1, 0), "l5": (2, 1, 0, 1, 2)})
    payouts: dict[tuple[int, int], int] = field(default_factory=lambda: {(s, n): s * (1, 5, 20, 80)[n - 2] for s in range(1, 11) for n in range(2 if s <= 2 else 3, 6)})


def derive_layouts(orders: DataFrame, game: Game = Game()) -> DataFrame:
    """Layouts from a key table: (sequence_number, cells, signature), boards by integer arithmetic on the key."""
    k = F.col("o_orderkey")
    cells = F.transform(F.sequence(F.lit(0), F.lit(game.rows * game.columns - 1)), lambda i: (F.pmod(k * 7919 + i * i * 104729 + k * i * 31, F.lit(1000003)) % 11 + 1).cast("int"))
    numbered = row_numbers(orders.select("o_orderkey"), k, name="sequence_number")
    return numbered.select("sequence_number", cells.alias("cells")).withColumn("signature", encode_signature(F.col("cells"), game.width))


# --- matching ---------------------------------------------------------------------------------------------------


def prefix_match(layouts: DataFrame, prefix: str) -> DataFrame:
    """One row: the number of boards that begin with ``prefix``, and the suggestion.

    ``unique``: one board, with its number; ``duplicate``: several places of one signature, no number;
    ``ambiguous`` and ``none`` suggest nothing. One aggregate over a pushed-down prefix filter.
    """
    hit = layouts.where(F.col("signature").startswith(prefix)).agg(F.count("*").alias("n"), F.min("signature").alias("lo"), F.max("signature").alias("hi"), F.min("sequence_number").alias("at"))
    kind = F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "unique").when(F.col("lo") == F.col("hi"), "duplicate").otherwise("ambiguous")
    return hit.select(F.col("n").alias("candidate_count"), kind.alias("kind"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("signature"), F.when(F.col("n") == 1, F.col("at")).alias("sequence_number"))


def exact_match(layouts: DataFrame, signatures: DataFrame, most: int = 20) -> DataFrame:
    """For every probe of ``signatures(signature)``: ``not_found``, ``unique`` or ``duplicate``, the count, and the
    places in order, which are given for at most ``most`` places, else null. Probes are taken once each."""
    probes = signatures.select("signature").distinct()
    hits = layouts.join(probes, "signature", "left_semi").groupBy("signature").agg(F.count("*").alias("n"))
    few = layouts.join(hits.where(F.col("n") <= most).select("signature"), "signature", "left_semi").groupBy("signature").agg(F.array_sort(F.collect_list("sequence_number")).alias("at"))
    kind = F.when(F.col("n").isNull(), "not_found").when(F.col("n") == 1, "unique").otherwise("duplicate")
    return probes.join(hits, "signature", "left").join(few, "signature", "left").select("signature", kind.alias("kind"), F.coalesce("n", F.lit(0)).alias("candidate_count"), "at")


def cyclic_window(df: DataFrame, start: int, count: int, limit: int | None = None) -> DataFrame:
    """The rows after ``start`` in cyclic order, with ``spin`` 1, 2, ...: all ``count - 1``, or the first ``limit``.

    They are one or two ranges of the number, which the scan can skip by. Numbers outside of 1..``count`` are no rows.
    """
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    last = start + min(count - 1 if limit is None else limit, count - 1)
    n = F.col("sequence_number")
    inside = n.between(start + 1, min(last, count))
    if last > count:
        inside = inside | n.between(1, last - count)
    return df.where(inside).withColumn("spin", F.pmod(n - start, F.lit(count)).cast("bigint"))


# --- payouts ----------------------------------------------------------------------------------------------------


def evaluate_payouts(layouts: DataFrame, game: Game = Game()) -> DataFrame:
    """``layouts`` with ``matches`` (payline, symbol, length, payout, wild; in payline order), ``payout`` and
    ``match_count``.

    Only the first cell of a line that is no wildcard can win: a match must hold its symbol, and begins at the first
    column. The length paid is the longest defined one that the run reaches; it must reach beyond the leading
    wildcards. Rules and paylines are literals, so this is a narrow projection without a join or shuffle; every
    step is a ``transform`` over the lines, which names its values once. Boards with too few cells win nothing on
    the lines they lack; a null board has no matches.
    """
    n, top = game.columns, max(game.symbols)
    rules = sorted(game.payouts)
    reach = [max((k for t, k in rules if t == s and k <= r), default=0) for s in range(top + 1) for r in range(n + 1)]
    pays = [game.payouts.get((s, r), 0) for s in range(top + 1) for r in range(n + 1)]
    # One literal each: the floor lookup "longest defined length" and the payout, by symbol * (n + 1) + length.
    table = lambda values: F.array(*[F.lit(int(v)) for v in values])
    is_wild = lambda c: c.isin(*game.wildcards)
    until = lambda flags: F.when(F.array_position(flags, False) == 0, F.size(flags)).otherwise(F.array_position(flags, False) - 1).cast("int")
    lines = F.array(*[F.struct(F.lit(name).alias("payline"), F.array(*[F.get("cells", F.lit(r * n + c)) for c, r in enumerate(path)]).alias("line")) for name, path in game.paylines.items()])
    lines = F.transform(F.filter(lines, lambda x: F.forall(x["line"], lambda c: c.isNotNull())), lambda x: F.struct(x["payline"].alias("payline"), x["line"].alias("line"), until(F.transform(x["line"], is_wild)).alias("lead")))
    lines = F.transform(lines, lambda x: F.struct(x["payline"].alias("payline"), x["line"].alias("line"), x["lead"].alias("lead"), F.get(x["line"], x["lead"]).alias("symbol")))
    lines = F.filter(lines, lambda x: x["symbol"].between(0, top))
    lines = F.transform(lines, lambda x: F.struct(x["payline"].alias("payline"), x["line"].alias("line"), x["lead"].alias("lead"), x["symbol"].alias("symbol"),
                                                  F.get(table(reach), x["symbol"] * (n + 1) + until(F.transform(x["line"], lambda c: is_wild(c) | (c == x["symbol"])))).alias("length")))
    won = F.transform(F.filter(lines, lambda x: x["length"] > x["lead"]), lambda x: F.struct(
        x["payline"].alias("payline"), x["symbol"].alias("symbol"), x["length"].alias("length"), F.get(table(pays), x["symbol"] * (n + 1) + x["length"]).cast("bigint").alias("payout"),
        F.size(F.filter(F.slice(x["line"], 1, x["length"]), is_wild)).alias("wild")))
    out = layouts.withColumn("matches", won)
    return out.withColumn("payout", F.aggregate("matches", F.lit(0).cast("bigint"), lambda s, m: s + m["payout"])).withColumn("match_count", F.size("matches"))


# --- forecast ---------------------------------------------------------------------------------------------------


def forecast_path(payouts: DataFrame, start: int, count: int, cost: int, limit: int | None = None) -> DataFrame:
    """(spin, sequence_number, payout, cumulative_payout, cumulative_cost, net, peak) after ``start``, in cyclic
    order: all ``count - 1`` spins, or the first ``limit`` of them. ``peak``: a positive local maximum of the net; of a
    plateau the first spin, and an open rise at the end.

    Whether the net rises or falls at a spin depends on its payout only, so a peak is a rise whose next spin that
    is not flat falls, or is missing. Sums and the look ahead work in blocks. An impossible input (a missing or
    repeated number, a null or negative payout) is an error, never a partial result. Blocks are checked for their
    number of rows, and within them every spin for its place.
    """
    spins = count - 1 if limit is None else min(limit, count - 1)
    size = block_size(spins)
    scan = cyclic_window(payouts, start, count, limit).select("spin", "sequence_number", "payout")
    bad = F.coalesce(F.col("payout") < 0, F.lit(True))
    scan = scan.withColumn("payout", F.when(bad, F.raise_error(F.lit("payouts must not be negative or null"))).otherwise(F.col("payout")))
    turn = F.signum((F.col("payout") - cost).cast("double")).cast("int")
    scan = scan.withColumn("_turn", F.when(turn != 0, turn)).withColumn("_block", _block(F.col("spin"), size))
    # A row for each block: what was paid before it, and which way the first turn after it goes.
    blocks = scan.groupBy("_block").agg(F.count("*").alias("_rows"), F.sum("payout").alias("_sum"), F.min_by("_turn", F.when(F.col("_turn").isNotNull(), F.col("spin"))).alias("_head"))
    # Every block that there must be, so that one without any row is noticed.
    blocks = payouts.sparkSession.range(-(-(spins + 1) // size) if spins > 0 else 0).select(F.col("id").alias("_block")).join(blocks, "_block", "left")
    up = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", "_rows", F.coalesce(F.sum("_sum").over(up), F.lit(0)).alias("_before"), F.last("_head", ignorenulls=True).over(down).alias("_after"))
    forth = Window.partitionBy("_block").orderBy("spin").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("_block").orderBy(F.desc("spin")).rowsBetween(Window.unboundedPreceding, -1)
    path = scan.withColumn("_inside", F.sum("payout").over(forth)).withColumn("_next", F.last("_turn", ignorenulls=True).over(back)).withColumn("_place", F.row_number().over(forth)).join(blocks, "_block", "right")
    first = F.greatest(F.col("_block") * size, F.lit(1))
    whole = (F.col("_rows") == F.least((F.col("_block") + 1) * size - 1, F.lit(spins)) - first + 1) & (F.col("_place") == F.col("spin") - first + 1)
    checked = lambda c: F.when(F.coalesce(whole, F.lit(False)), c).otherwise(F.raise_error(F.lit("sequence numbers must not be missing or repeated")).cast("boolean"))
    path = path.where(checked(F.lit(True)))
    path = path.withColumn("_next", F.coalesce("_next", "_after")).withColumn("cumulative_payout", safe(F.col("_before") + F.col("_inside"), "payout")).withColumn("cumulative_cost", safe(F.col("spin") * cost, "cost"))
    path = path.withColumn("net", F.col("cumulative_payout") - F.col("cumulative_cost"))
    peak = F.coalesce(F.col("_turn") == 1, F.lit(False)) & (F.coalesce("_next", F.lit(-1)) == -1) & (F.col("net") > 0)
    # Again in the peak: a filter on it would be split and take rows away before they are checked.
    return path.select("spin", "sequence_number", "payout", "cumulative_payout", "cumulative_cost", "net", checked(peak).alias("peak"))


def forecast_summary(path: DataFrame) -> DataFrame:
    """One row: evaluated spins, final sums and the number of peaks; zeros for an empty scan."""
    z = lambda c: F.coalesce(c, F.lit(0))
    return path.agg(F.count("*").alias("evaluated_spins"), z(F.sum("payout")).alias("final_payout"), z(F.max("cumulative_cost")).alias("final_cost"),
                    (z(F.sum("payout")) - z(F.max("cumulative_cost"))).alias("final_net"), F.count_if(F.col("peak")).alias("peaks"))


def check_sequence(df: DataFrame, count: int) -> DataFrame:
    """One row: rows, distinct numbers, smallest, largest and whether they are exactly 1..``count``."""
    a = df.agg(F.count("*").alias("rows"), F.count_distinct("sequence_number").alias("numbers"), F.min("sequence_number").alias("lowest"), F.max("sequence_number").alias("highest"))
    return a.withColumn("complete", (F.col("rows") == count) & (F.col("numbers") == count) & (F.col("lowest") == 1) & (F.col("highest") == count))
