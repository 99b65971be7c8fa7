"""Relational building blocks that Spark has no single operator for."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ordering import in_ranges, previous_value


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of every key by ``order``: one aggregation with a partial step, no window. Ties go to the larger
    row; null keys are a group."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every key with their rank; Spark prunes each partition before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def gap_ranges(df: DataFrame, column: str, expected: int | None = None) -> DataFrame:
    """``(gap_from, gap_to)`` of the numbers from 1 that ``column`` lacks, up to its largest or to ``expected``.

    Nulls and numbers below 1 (and beyond ``expected``) are ignored. Without any number the gap is 1..expected.
    """
    n = df.where(F.col(column) >= 1) if expected is None else df.where(F.col(column).between(1, expected))
    n = n.select(F.col(column).cast("bigint").alias("n")).distinct()
    before = previous_value(n, "n", "p").select((F.coalesce("p", F.lit(0)) + 1).alias("gap_from"), (F.col("n") - 1).alias("gap_to")).where("gap_from <= gap_to")
    if expected is None:
        return before
    tail = n.agg((F.coalesce(F.max("n"), F.lit(0)) + 1).alias("gap_from"), F.lit(expected).cast("bigint").alias("gap_to")).where("gap_from <= gap_to")
    return before.unionByName(tail)


def expand_ranges(gaps: DataFrame, limit: int | None = None) -> DataFrame:
    """``(missing)`` numbers of the gaps, the first ``limit`` in order."""
    if limit is not None:  # a gap can hold a number of the first ``limit`` only near its beginning
        gaps = gaps.orderBy("gap_from").limit(limit).withColumn("gap_to", F.least("gap_to", F.col("gap_from") + limit - 1))
    out = gaps.select(F.explode(F.sequence("gap_from", "gap_to")).alias("missing"))
    return out if limit is None else out.orderBy("missing").limit(limit)


def page(df: DataFrame, keys: list[tuple[str, bool]], size: int, cursor: tuple | None = None, backwards: bool = False) -> DataFrame:
    """``size`` rows after (or before) ``cursor`` in the order of ``keys`` (name, descending), with ``has_more``.

    One more row than asked for is read to know whether there are more; a page before a cursor is read in reverse.
    """
    if cursor is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for (name, desc), value in zip(keys, cursor, strict=True):
            c = F.col(name)
            beyond = beyond | (equal & ((c < value) if desc != backwards else (c > value)))
            equal = equal & (c == value)
        df = df.where(beyond)
    order = [F.col(n).desc_nulls_last() if d != backwards else F.col(n).asc_nulls_last() for n, d in keys]
    rows = df.orderBy(*order).limit(size + 1).withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # size + 1 rows
    return rows.withColumn("has_more", F.max("_n").over(Window.partitionBy(F.lit(1))) > size).where(F.col("_n") <= size).drop("_n")


def asof_interpolate(probes: DataFrame, anchors: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """``probes`` with ``value``: linear between the nearest anchors below and above ``at`` of the same ``keys``, the
    anchor itself on an exact hit, the outermost anchor outside of them, null without anchors. Rounded to 10 digits.

    Both sides are sorted together in ranges, so one key may hold any part of the rows. Inside a range the nearest anchors
    are found by windows; what the first key of a range has before it, and the last one behind it, comes from a table with
    two rows a range. Null keys are keys of their own.
    """
    both = probes.select(*keys, at, F.lit(None).cast("double").alias(value), F.lit(1).alias("_probe")).unionByName(anchors.groupBy(*keys, at).agg(F.avg(value).alias(value)).withColumn("_probe", F.lit(0)))
    key = F.struct(*keys)
    src = in_ranges(both, *[F.asc(k) for k in keys], F.asc(at), F.asc("_probe"))
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("x"), F.col(value).alias("y")))
    src = src.withColumn("_point", point)
    grow = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    near = lambda order: F.last("_point", ignorenulls=True).over(grow(Window.partitionBy("_part", *keys).orderBy(order)))

    edges = src.groupBy("_part").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    marked = src.join(edges, "_part")
    place = F.when(F.col("_point").isNotNull(), F.col("_pos"))
    ends = marked.groupBy("_part").agg(
        F.first("_first").alias("_first"), F.first("_last").alias("_last"),
        F.min_by("_point", F.when(key.eqNullSafe(F.col("_first")), place)).alias("_head"), F.max_by("_point", F.when(key.eqNullSafe(F.col("_last")), place)).alias("_tail"),
    )

    def carried(own: str, of: str, what: str, order, name: str) -> DataFrame:
        """For every range: the point that other ranges in ``order`` have nearest before it for its key ``own``."""
        asks = ends.select("_part", F.col(own).alias("_k"), F.lit(0).alias("_turn"), F.lit(None).cast(ends.schema[what].dataType).alias("_p"))
        tells = ends.select("_part", F.col(of).alias("_k"), F.lit(1).alias("_turn"), F.col(what).alias("_p"))
        w = Window.partitionBy("_k").orderBy(order, "_turn")  # two rows a range
        return asks.unionByName(tells).withColumn("_p", F.last("_p", ignorenulls=True).over(grow(w))).where("_turn = 0").select("_part", F.col("_p").alias(name))

    extra = edges.join(carried("_first", "_last", "_tail", F.asc("_part"), "_above"), "_part").join(carried("_last", "_first", "_head", F.desc("_part"), "_below"), "_part")
    out = src.withColumn("_a", near(F.asc("_pos"))).withColumn("_b", near(F.desc("_pos"))).where("_probe = 1").join(extra, "_part")
    a = F.coalesce("_a", F.when(key.eqNullSafe(F.col("_first")), F.col("_above")))
    b = F.coalesce("_b", F.when(key.eqNullSafe(F.col("_last")), F.col("_below")))
    out = out.select(*keys, at, a.alias("_a"), b.alias("_b"))
    a, b = F.col("_a"), F.col("_b")
    line = F.when(a.isNull(), b["y"]).when(b.isNull() | (a["x"] == b["x"]), a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * (F.col(at) - a["x"]) / (b["x"] - a["x"]))
    return out.select(*keys, at, F.round(line, 10).alias(value))


def floor_lookup(probes: DataFrame, rules: DataFrame, at: str, name: str) -> DataFrame:
    """``probes`` with ``name``: the largest ``at`` of ``rules`` that is not above their own; null where there is none.

    Each distinct value is looked up once, in ranges of the values of both sides, and what a range inherits from those
    before is one row of a small table; the probes are then joined by value. Null values find nothing.
    """
    values = probes.where(F.col(at).isNotNull()).select(at).distinct().withColumn("_rule", F.lit(False)).unionByName(rules.where(F.col(at).isNotNull()).select(at).distinct().withColumn("_rule", F.lit(True)))
    both = in_ranges(values.groupBy(at).agg(F.bool_or("_rule").alias("_rule"), F.bool_or(~F.col("_rule")).alias("_probe")), F.col(at))
    own = F.when(F.col("_rule"), F.col(at))
    tops = both.groupBy("_part").agg(F.max(own).alias("_top"))
    tops = tops.select("_part", F.last("_top", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))  # a row a range
    inside = F.last(own, ignorenulls=True).over(Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_inside", inside).join(tops, "_part").where("_probe").select(at, F.coalesce("_inside", "_before").alias(name))
    return probes.join(found, at, "left")


def upsert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with ``rows`` put in their places: a row of the same keys is replaced, others are added."""
    return target.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def insert_missing(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` and those of ``rows`` whose keys it lacks."""
    return target.unionByName(rows.join(target.select(*keys).distinct(), keys, "left_anti"))


def delete_returning(target: DataFrame, doomed: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(deleted, kept) rows of ``target``: those whose ``on`` is among the values of ``doomed``, and the others. Null is
    among no values."""
    keys = doomed.where(F.col(on).isNotNull()).select(on).distinct()
    return target.join(keys, on, "left_semi"), target.join(keys, on, "left_anti")


def delete_cascade(tables: dict[str, DataFrame], links: list[tuple[str, str, str | None, str]], roots: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete what depends on ``roots(key)``: (kept rows of each table, ``(step, table, deleted, kept)``).

    ``links``: (table, its column, parent table or None for the roots, the parent's key column), parents before their
    children. Each level is a semi-join with the keys deleted above it. Steps are numbered in the order of the deletes,
    children first; a table may be named by several links, and loses a row that any of them reaches.
    """
    gone: dict[str, DataFrame] = {}
    for table, column, parent, key in links:
        above = roots.select("key") if parent is None else gone[parent].select(F.col(key).alias("key"))
        deleted, _ = delete_returning(tables[table].withColumn("_key", F.col(column)), above.withColumnRenamed("key", "_key"), "_key")
        deleted = deleted.select(tables[table].columns)
        gone[table] = deleted if table not in gone else gone[table].unionByName(deleted).distinct()
    kept, counts = {}, None
    for step, table in enumerate(reversed(list(gone)), start=1):
        ways = [(column, parent, key) for t, column, parent, key in links if t == table]
        rest = tables[table]
        for column, parent, key in ways:
            above = roots.select("key") if parent is None else gone[parent].select(F.col(key).alias("key"))
            rest = delete_returning(rest.withColumn("_key", F.col(column)), above.withColumnRenamed("key", "_key"), "_key")[1].drop("_key")
        kept[table] = rest
        one = rest.agg(F.count("*").alias("kept")).join(tables[table].agg(F.count("*").alias("n")))  # a row each
        one = one.select(F.lit(step).alias("step"), F.lit(table).alias("table"), (F.col("n") - F.col("kept")).alias("deleted"), "kept")
        counts = one if counts is None else counts.unionByName(one)
    return kept, counts


def prediction_alias(symbols: DataFrame, resolution: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(code, alias)``: under which predicted codes a symbol occurs.

    ``symbols(code)``, ``resolution(code, candidate_ids array)`` and ``candidates(candidate_id, predicted)`` are looked up
    one after the other; a symbol without a resolution, or whose candidates predict nothing, has its own code.
    """
    ids = resolution.select("code", F.explode("candidate_ids").alias("candidate_id"))
    known = ids.join(candidates, "candidate_id").where("predicted is not null").select("code", F.col("predicted").alias("alias")).distinct()
    return symbols.select("code").distinct().join(known, "code", "left").select("code", F.coalesce("alias", "code").alias("alias"))


def select_sources(candidates: DataFrame, overrides: DataFrame, *order: Column) -> DataFrame:
    """``(sequence_number, id, manual)``: the best candidate of every number by ``order``, or the one that the latest
    ``overrides(sequence_number, revision, id)`` names; an override with a null id falls back to the best."""
    best = latest_by(candidates, ["sequence_number"], *order).select("sequence_number", F.col("id").alias("best"))
    last = overrides.groupBy("sequence_number").agg(F.max_by("id", "revision").alias("chosen"))
    return best.join(last, "sequence_number", "left").select("sequence_number", F.coalesce("chosen", "best").alias("id"), F.col("chosen").isNotNull().alias("manual"))


def next_stage(done: DataFrame, stages: list[str]) -> DataFrame:
    """``(file, completed, next_stage, out_of_order)`` of ``done(file, stage)``: how many stages are done from the first one
    on, the one to run (or run again) next, null when all are, and how many are done beyond it. Unknown stages count
    nothing; repeated rows count once."""
    bit = F.coalesce(F.try_element_at(F.create_map(*[x for i, s in enumerate(stages) for x in (F.lit(s), F.lit(1 << i))]), F.col("stage")), F.lit(0))
    mask = done.groupBy("file").agg(F.bit_or(bit).alias("m"))
    has = F.array(*[F.col("m").bitwiseAND(F.lit(1 << i)) != 0 for i in range(len(stages))])
    first = F.when(F.array_position(has, F.lit(False)) == 0, len(stages)).otherwise(F.array_position(has, F.lit(False)) - 1).cast("int")
    return mask.select("file", first.alias("completed"), F.get(F.array(*map(F.lit, stages)), first).alias("next_stage"), (F.bit_count("m") - first).alias("out_of_order"))


def nearest_per_class(vectors: DataFrame, queries: DataFrame, k: int = 3, least: float = 0.0, id_col: str = "vec_id", vector_col: str = "embedding", class_col: str = "label", block: int = 2048) -> DataFrame:
    """``(query_id, class, similarity, neighbour_id, rank)``: the ``k`` best classes of every query, a class being as
    similar as its most similar member, by cosine; the query itself is left out, as is what is below ``least``.

    Both sides are cut into blocks of about ``block`` rows; block meets block as a matrix product, and only the
    best member of a class in a block goes on. Null and zero vectors have no neighbours. Ties go to the smaller id.
    """

    def blocks(df: DataFrame, prefix: str) -> DataFrame:
        n = max(1, -(-df.count() // block))
        b = df.where(F.col(vector_col).isNotNull()).withColumn("_b", F.pmod(F.xxhash64(id_col), F.lit(n)))
        return b.groupBy("_b").agg(F.collect_list(F.struct(F.col(id_col).alias("i"), F.col(class_col).alias("c"), F.col(vector_col).alias("v"))).alias(prefix)).drop("_b")

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for qs, vs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                q, v = (np.array([r["v"] for r in x], dtype=np.float64) for x in (qs, vs))
                q, v = (np.divide(m, n := np.linalg.norm(m, axis=1, keepdims=True), out=np.full_like(m, np.nan), where=n > 0) for m in (q, v))
                sim = q @ v.T
                ids, classes = np.array([r["i"] for r in vs]), np.array([r["c"] for r in vs])
                sim[np.array([r["i"] for r in qs])[:, None] == ids[None, :]] = np.nan
                for c in np.unique(classes):
                    own = np.flatnonzero(classes == c)
                    own = own[np.argsort(ids[own])]
                    part = np.where(np.isnan(sim[:, own]), -np.inf, np.round(sim[:, own], 9))
                    best = part.argmax(1)
                    for r, j in enumerate(best):
                        if part[r, j] >= least:
                            for to, x in zip(out, (qs[r]["i"], int(c), float(part[r, j]), int(ids[own[j]])), strict=True):
                                to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["query_id", "class", "similarity", "neighbour_id"])

    met = blocks(queries, "q").crossJoin(blocks(vectors, "v"))  # block pairs: a stated query set against all rows
    best = met.repartition(max(8, met.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, "query_id bigint, class bigint, similarity double, neighbour_id bigint")
    best = best.groupBy("query_id", "class").agg(F.max_by(F.struct("similarity", "neighbour_id"), F.struct("similarity", -F.col("neighbour_id"))).alias("b"))
    return top_k(best.select("query_id", "class", "b.similarity", "b.neighbour_id"), ["query_id"], k, F.desc("similarity"), F.asc("class"))
