"""A sample whose shares by several kinds of categories match targets.

Observations are cross-classified: a cell is the set of target categories that an observation has. Only cell counts
reach the driver, at most ``MAX_CELLS`` of them. Two min-cost flows are solved on them.

*What can be had at all.* Every target category is a node that demands its share or its minimum, whichever is larger:

    source -> category (demand) -> its cells (availability) -> sink,    category -> sink (shortage, dear).

What an unreachable target lacks is the flow on its shortage arc, and the report reads it there.

*What to draw.* The cells are arcs of

    source -> board position -> (cells, as capacities) -> source group -> sink,

whose arcs from the source and into the sink carry the margins: a floor (very dear to miss), the target, and the
surplus beyond it. Tags overlap and cannot be nodes of the path; they are prices on the cell arcs, raised and lowered
until their margins fit, and what is left over is removed by exchanges between any two cells (cycles of the residual
network) until none helps. Prices between -1 and 1 make each flow a lower bound of the deviation that any choice of
cells has, so the report says how far from the least possible one the sample is at most. Cells of equal cost share
their quota by a random (hypergeometric) draw, and the records of a cell are drawn by hash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.keys import bare
from gridloom.runtime import cut, pick

BITS = 62
ROUNDS = 16
FLOOR_COST = 1_000.0
SHORTAGE_COST = 1.0  # of a unit on a shortage arc; what is available costs nothing
MAX_CELLS = 1 << 20  # more distinct sets of target categories are an error
ROWS_PER_RANK = 200_000
PAIRS = 1 << 21
KINDS = ("board_position", "condition_tag", "source_group")


class Convex:
    """A convex arc: capacities in order of their unit cost, and how much of them is used."""

    def __init__(self, costs: list[float], caps: list[int]):
        pairs = sorted((c, k) for c, k in zip(costs, caps, strict=True) if k > 0)
        self.cost = [c for c, _ in pairs]
        self.ends = list(np.cumsum([k for _, k in pairs])) if pairs else []
        self.used = self.i = 0

    def forward(self) -> tuple[float, int]:
        while self.i < len(self.ends) and self.used >= self.ends[self.i]:
            self.i += 1
        return (self.cost[self.i], int(self.ends[self.i] - self.used)) if self.i < len(self.ends) else (math.inf, 0)

    def backward(self) -> tuple[float, int]:
        if not self.used:
            return math.inf, 0
        i = self.i
        while i >= len(self.ends) or (i > 0 and self.ends[i - 1] >= self.used):
            i -= 1
        return -self.cost[i], int(self.used - (self.ends[i - 1] if i else 0))

    def push(self, amount: int) -> None:
        self.used += amount
        if amount < 0:
            while self.i > 0 and self.ends[self.i - 1] > self.used:
                self.i -= 1
            self.i = min(self.i, max(len(self.ends) - 1, 0))


def min_cost_flow(nodes: int, arcs: dict[tuple[int, int], Convex], source: int, sink: int, amount: int) -> int:
    """Send up to ``amount`` at the least cost by shortest augmenting paths; the arcs keep the flow."""
    sent = 0
    while sent < amount:
        dist, via = [math.inf] * nodes, [None] * nodes
        dist[source] = 0.0
        steps = []
        for (u, v), arc in arcs.items():
            for a, b, (c, k), sign in ((u, v, arc.forward(), 1), (v, u, arc.backward(), -1)):
                if k:
                    steps.append((a, b, c, k, sign, arc))
        for _ in range(nodes):
            changed = False
            for s in steps:
                if dist[s[0]] + s[2] < dist[s[1]] - 1e-9:
                    dist[s[1]], via[s[1]], changed = dist[s[0]] + s[2], s, True
            if not changed:
                break
        if math.isinf(dist[sink]):
            break
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = via[at][0]
        k = min(amount - sent, *(s[3] for s in path))
        for s in path:
            s[5].push(s[4] * k)
        sent += k
    return sent


@dataclass(frozen=True)
class Target:
    kind: str
    category: str
    share: float
    floor: int


def _draw(rng: np.random.Generator, counts: np.ndarray, take: int) -> np.ndarray:
    """A random split of ``take`` over cells as if records were drawn from them together. Beyond the counts that the
    generator can handle, the exact shares are taken, and only what rounding leaves is drawn."""
    total = int(counts.sum())
    if take >= total:
        return counts.copy()
    if total < 10**9:
        return rng.multivariate_hypergeometric(counts, take, method="marginals")
    exact = [int(c) * take for c in counts]
    out = np.array([e // total for e in exact], dtype=np.int64)
    rest = np.array([e % total for e in exact], dtype=np.float64)
    left = take - int(out.sum())
    if left:
        out[rng.choice(len(counts), left, replace=False, p=rest / rest.sum())] += 1
    return out


def shortages(available: list[int], demands: list[int], cost: float = SHORTAGE_COST) -> list[int]:
    """What each category lacks of its demand: the flow on its shortage arc."""
    n = len(demands)
    sink = 1 + 2 * n
    arcs: dict[tuple[int, int], Convex] = {}
    for i, (there, demand) in enumerate(zip(available, demands, strict=True)):
        category, cells = 1 + i, 1 + n + i
        arcs[0, category] = Convex([0.0], [demand])
        arcs[category, cells] = Convex([0.0], [there])
        arcs[cells, sink] = Convex([0.0], [there])
        arcs[category, sink] = Convex([cost], [demand])
    min_cost_flow(sink + 1, arcs, 0, sink, sum(demands))
    return [int(arcs[1 + i, sink].used) for i in range(n)]


def cell_quotas(members: np.ndarray, counts: np.ndarray, targets: list[Target], size: int, seed: int = 42, rounds: int = ROUNDS) -> np.ndarray:
    """How many records of each cell to draw. ``members``: cells x targets, whether the cell has the category."""
    return solve_cells(members, counts, targets, size, seed, rounds)[0]


def solve_cells(members: np.ndarray, counts: np.ndarray, targets: list[Target], size: int, seed: int = 42, rounds: int = ROUNDS) -> tuple[np.ndarray, int, int]:
    """(quotas, deviation, lower bound): the deviation is the sum of what categories are above or below their share, and
    ``FLOOR_COST`` for each unit below an attainable floor; no choice of quotas has one below the bound."""
    rng = np.random.default_rng(seed)
    size = int(min(size, counts.sum()))
    if size <= 0 or not len(counts):
        return np.zeros(len(counts), dtype=np.int64), 0, 0
    goal = np.array([round(t.share * size) for t in targets], dtype=np.int64)
    floor = np.array([t.floor for t in targets], dtype=np.int64)
    by_kind = {k: [i for i, t in enumerate(targets) if t.kind == k] for k in KINDS}

    def first_of(kind: str) -> np.ndarray:
        own = by_kind[kind]
        if not own:
            return np.zeros(len(counts), dtype=np.int64)
        has = members[:, own]
        return np.where(has.any(1), has.argmax(1), len(own))

    position, group = first_of(KINDS[0]), first_of(KINDS[2])
    np_, ng = len(by_kind[KINDS[0]]) + 1, len(by_kind[KINDS[2]]) + 1
    tags = by_kind[KINDS[1]]

    attainable = np.minimum(floor, members.T @ counts)

    def margin(kind: str, j: int) -> Convex:
        own = by_kind[kind]
        if j == len(own):  # what has no category of this kind
            return Convex([0.0], [size])
        f, t = int(min(attainable[own[j]], size)), int(goal[own[j]])
        return Convex([-FLOOR_COST - 1, 1 - FLOOR_COST, -1.0, 1.0], [min(f, t), max(0, f - t), max(0, t - f), size])

    pairs = {}
    for i, key in enumerate(zip(position.tolist(), group.tolist(), strict=True)):
        pairs.setdefault(key, []).append(i)
    pairs = {k: np.array(v) for k, v in pairs.items()}
    price = np.zeros(len(tags))
    best, best_cost = None, math.inf
    bound = float(np.maximum(0, goal - members.T @ counts).sum())  # what there is not cannot be drawn
    placed = [i for i in range(len(targets)) if i not in tags]

    def costs(x: np.ndarray) -> np.ndarray:
        got = x @ members
        return np.abs(got - goal) + FLOOR_COST * np.maximum(0, attainable - got)

    for r in range(rounds):
        unit = np.round(members[:, tags] @ price, 6) if tags else np.zeros(len(counts))
        arcs: dict[tuple[int, int], Convex] = {}
        for p in range(np_):
            arcs[0, 1 + p] = margin(KINDS[0], p)
        for g in range(ng):
            arcs[1 + np_ + g, 1 + np_ + ng] = margin(KINDS[2], g)
        for (p, g), cells in pairs.items():
            level, where = np.unique(unit[cells], return_inverse=True)
            arcs[1 + p, 1 + np_ + g] = Convex(level.tolist(), np.bincount(where, weights=counts[cells]).astype(np.int64).tolist())
        min_cost_flow(2 + np_ + ng, arcs, 0, 1 + np_ + ng, size)
        x = np.zeros(len(counts), dtype=np.int64)
        for (p, g), cells in pairs.items():
            left = arcs[1 + p, 1 + np_ + g].used
            for level in np.unique(unit[cells]):
                same = cells[unit[cells] == level]
                take = min(left, int(counts[same].sum()))
                if take:
                    x[same] = _draw(rng, counts[same], take)
                left -= take
        cost, off = costs(x), (x @ members)[tags] - goal[tags]
        if cost.sum() < best_cost:
            best, best_cost = x, float(cost.sum())
        if not tags or np.abs(price).max() <= 1:
            bound = max(bound, float(cost[placed].sum()) + (float(price @ off) if tags else 0.0))
        if not tags or not off.any():
            break
        # The first half keeps to prices that give bounds, the second may go beyond for a better start.
        most = 1 if r < rounds // 2 else 3
        price = np.clip(price + off / np.maximum(goal[tags], 1) / (1 + r / 2), -most, most)
    best = _cancel(best, members.astype(np.int64), counts, goal, attainable)
    return best, int(costs(best).sum()), max(0, math.ceil(bound - 1e-3))


def _best_exchange(members: np.ndarray, shared: np.ndarray, into: np.ndarray, out: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[float, int, int]:
    """The least change of cost by one unit into a cell of ``rows`` and out of one of ``columns``, and these cells. What
    both cells have does not change, so its ``shared`` cost is taken off; the pairs are looked at in blocks."""
    best, right = (math.inf, -1, -1), members[columns].T.astype(np.float64)
    step = max(1, PAIRS // max(1, len(columns)))
    for at in range(0, len(rows) if len(columns) else 0, step):
        own = rows[at : at + step]
        gain = into[own][:, None] + out[columns][None, :] - (members[own] * shared) @ right
        i, j = np.unravel_index(np.argmin(gain), gain.shape)
        if gain[i, j] < best[0]:
            best = float(gain[i, j]), int(own[i]), int(columns[j])
    return best


def _cancel(x: np.ndarray, members: np.ndarray, counts: np.ndarray, goal: np.ndarray, floor: np.ndarray, width: int = 40) -> np.ndarray:
    """Move units from one cell to another (a cycle of the residual network) until no such exchange lowers the cost.

    The ``width`` cells that look best by themselves are tried first; only where they have no exchange that helps, all
    pairs of cells are, so the end is one for all pairs. The cost is whole and falls with every move.
    """
    x = x.copy()
    got = x @ members

    def cost(g):
        return np.abs(g - goal) + FLOOR_COST * np.maximum(0, floor - g)

    while True:
        here = cost(got)
        up, down = cost(got + 1) - here, cost(got - 1) - here
        into, out = members @ up, members @ down
        rows, columns = np.flatnonzero(x < counts), np.flatnonzero(x > 0)
        few = rows[np.argsort(into[rows], kind="stable")[:width]], columns[np.argsort(out[columns], kind="stable")[:width]]
        gain, i, j = _best_exchange(members, up + down, into, out, *few)
        if not gain < -1e-9:
            gain, i, j = _best_exchange(members, up + down, into, out, rows, columns)
        if not gain < -1e-9:
            return x
        step = members[i] - members[j]
        most = min(int(counts[i] - x[i]), int(x[j]))
        for kink in (goal, floor):  # as far as no category passes its target or floor
            far = (kink - got)[step == 1]
            near = (got - kink)[step == -1]
            most = min([most, *far[far > 0].tolist(), *near[near > 0].tolist()])
        x[i] += most
        x[j] -= most
        got = got + most * step


@dataclass(frozen=True)
class QuotaSample:
    """``sample``: the drawn observation ids with their cell. ``report``: a row for each target category."""

    sample: DataFrame
    report: DataFrame

    def unreachable(self) -> DataFrame:
        """``(category_kind, category)`` of the targets that leave flow on their shortage arc."""
        return self.report.where("slack > 0").select("category_kind", "category")


def _tag(c: Column) -> Column:
    return F.replace(bare(c), F.lit("_"), F.lit("-"))


def quota_sample(candidates: DataFrame, targets: DataFrame, size: int | None = None, seed: int = 42) -> QuotaSample:
    """Draw ``size`` distinct observations (by default their number divided by ``sample_divisor``, rounded down).

    An observation has a category if any of its rows has it. Tags and groups are compared in lower case without
    surrounding blanks, tags with ``-`` for ``_``. The report has, for each row of ``targets``: ``available``
    observations, ``wanted`` (the larger of share times size and ``min_count``), ``slack`` (the flow on the category's
    shortage arc; its demand is ``wanted`` rounded up), ``drawn``, ``reached_share``, ``missed`` (what the drawn sample
    lacks of ``wanted``, which joint constraints can make larger than the slack), and, alike in all rows, ``deviation``
    and ``least_deviation`` of :func:`solve_cells`.

    Defined results: rows with a null observation id are left out; null positions, tags, tag lists and groups are no
    category; repeated rows and ids count once; a target of an unknown kind has nothing available; repeated target
    categories are reported each, the first of them is balanced; a target table without rows gives a plain random
    sample of ``size`` (0 where that is not given); an empty candidate table gives an empty sample; extra columns
    are ignored.
    """
    spark, candidates = candidates.sparkSession, pick(candidates, "observation_id", "board_position", "condition_tags", "source_group")
    targets = pick(targets, "category_kind", "category", "target_share", "min_count", "sample_divisor")
    rows = [(r["category_kind"], r["category"], float(r["target_share"] or 0), int(r["min_count"] or 0), int(r["sample_divisor"] or 0)) for r in targets.collect()]
    norm = {"board_position": lambda s: s.strip(), "condition_tag": lambda s: s.strip().lower().replace("_", "-"), "source_group": lambda s: s.strip().lower()}
    spots: dict[tuple[str, str], int] = {}
    for kind, category, *_ in rows:
        if kind in norm and category is not None:
            spots.setdefault((kind, norm[kind](category)), len(spots))
    words = max(1, -(-len(spots) // BITS))

    def bit(kind: str, key: Column, word: int) -> Column:
        own = [x for (k, c), i in spots.items() if k == kind and i // BITS == word for x in (F.lit(c), F.lit(1 << (i % BITS)).cast("bigint"))]
        return F.coalesce(F.try_element_at(F.create_map(*own), key), F.lit(0).cast("bigint")) if own else F.lit(0).cast("bigint")

    def mask(word: int) -> Column:
        tags = F.aggregate(F.coalesce("condition_tags", F.array().cast("array<string>")), F.lit(0).cast("bigint"), lambda acc, t: acc.bitwiseOR(bit("condition_tag", F.coalesce(_tag(t), F.lit("")), word)))
        position, group = F.coalesce(F.col("board_position").cast("string"), F.lit("")), F.coalesce(bare(F.col("source_group")), F.lit(""))
        return tags.bitwiseOR(bit("board_position", position, word)).bitwiseOR(bit("source_group", group, word))

    names = [f"m{w}" for w in range(words)]
    masks = candidates.where("observation_id is not null").select("observation_id", *[mask(w).alias(n) for w, n in enumerate(names)])
    obs = cut(masks.groupBy("observation_id").agg(*[F.bit_or(n).alias(n) for n in names]), "quota-observations")
    cells = obs.groupBy(*names).agg(F.count("*").alias("n")).limit(MAX_CELLS + 1).toArrow().sort_by([(n, "ascending") for n in names])
    if cells.num_rows > MAX_CELLS:
        raise ValueError(f"the observations have more than {MAX_CELLS} distinct sets of target categories")
    counts, words_of = cells["n"].to_numpy().astype(np.int64), [cells[n].to_numpy() for n in names]
    members = np.array([words_of[i // BITS] >> (i % BITS) & 1 for i in range(len(spots))], dtype=bool).T.reshape(len(counts), len(spots))
    there = int(counts.sum())
    divisor = next((d for *_, d in rows if d > 0), 0)
    size = (there // divisor if divisor else 0) if size is None else size
    first = {}
    for row in rows:
        if row[0] in norm and row[1] is not None:
            first.setdefault(spots[row[0], norm[row[0]](row[1])], row)
    quotas, deviation, least = solve_cells(members, counts, [Target(k, c, *first[i][2:4]) for (k, c), i in spots.items()], size, seed)

    # Of a cell, the records with the smallest hashes. Very full cells are ranked in buckets of the hash.
    buckets = max(1, math.ceil(there / ROWS_PER_RANK))
    plan = spark.createDataFrame([(*[int(w[i]) for w in words_of], int(quotas[i])) for i in np.flatnonzero(quotas)], ", ".join(f"{n} bigint" for n in names) + ", quota bigint")
    lot = F.xxhash64(F.lit(seed), "observation_id")
    width = F.lit(float(2**64 // buckets + 1))
    live = obs.join(plan, names).withColumn("_lot", lot).withColumn("_bucket", F.floor((F.col("_lot").cast("double") + F.lit(float(2**63))) / width))
    full = live.groupBy(*names, "_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = full.withColumn("_before", before).drop("_n")
    ranked = live.join(full, [*names, "_bucket"]).where("_before < quota").withColumn("_k", F.row_number().over(Window.partitionBy(*names, "_bucket").orderBy("_lot", "observation_id")))
    sample = ranked.where(F.col("_before") + F.col("_k") <= F.col("quota")).select("observation_id", *names)

    available, drawn = members.T @ counts, members.T @ quotas
    index = [spots.get((kind, norm[kind](category))) if kind in norm and category is not None else None for kind, category, *_ in rows]
    have = [0 if i is None else int(available[i]) for i in index]
    wanted = [max(float(floor), share * size) for _, _, share, floor, _ in rows]
    slack = shortages(have, [math.ceil(w) for w in wanted])
    report, taken = [], int(quotas.sum())
    for (kind, category, share, floor, _), i, a, w, short in zip(rows, index, have, wanted, slack, strict=True):
        d = 0 if i is None else int(drawn[i])
        report.append((kind, category, share, floor, size, a, w, short, d, round(d / taken, 6) if taken else 0.0, math.ceil(max(0.0, w - d)), deviation, least))
    schema = "category_kind string, category string, target_share double, min_count int, sample_size bigint, available bigint, wanted double, slack bigint, drawn bigint, reached_share double, missed bigint, deviation bigint, least_deviation bigint"
    return QuotaSample(sample, spark.createDataFrame(report, schema))
