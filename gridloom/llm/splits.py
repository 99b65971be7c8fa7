"""Splits that keep related records together, kept in a persisted component table.

Records that share a source image, a source group or a sample id, directly or through others, form a component. The
table of components is a chain of folders, one an update, each with what the update added:

* ``keys``        (kind, key, comp): the component of every new image ("i") and group ("g");
* ``samples``     (sample_id, comp): new samples;
* ``components``  (comp, split, samples, status, version): new and changed components, status being ``assigned`` or
  ``quarantined``; of a component the row of the last version counts;
* ``alias``       (comp, root): all components that were merged into another one so far, with the one that is left;
* ``history``     (path): the folders before this one.

What was written stays as it is: a delivery writes rows for itself, for the components it touches and for the merges,
and ``comp`` is read through ``alias``. ``compacted`` writes the whole table into one folder.

An update reads a batch of rows, replaces every key that is known by its component, finds the components of that
contracted graph by hooking and pointer jumping, and merges. A component that has a split keeps it. A merge of
components with different splits has no right answer any more: the result is quarantined, without a split. New
components fill what the splits lack of their proportions.

Sample ids hardly tie anything, but are many, so they are not vertices: a sample is its first anchor (its group, or
else its image), and only a sample whose rows have several anchors adds links, from its first anchor to the others.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.keys import name_key
from gridloom.runtime import cut, new_path, pick, release

PROPORTIONS = {"train": 0.70, "validation": 0.15, "test": 0.15}
SIZE_CLASSES, LOTS = 64, 4096
MAX_ROUNDS = 64


def connected(edges: DataFrame) -> DataFrame:
    """``(node, label)`` of every node of ``edges(u, v)``; the label is the smallest node of the component.

    Each round hooks every node to its smallest neighbour, shortens the chains by pointer jumping until every node
    points to a root, and contracts the graph to its roots. A root whose neighbours all hook to smaller ones is left
    alone in a round, but then meets one of those roots in the next, so a component at least halves in two rounds, and
    the rounds are logarithmic in the nodes. Labels that are not settled after ``MAX_ROUNDS`` are an error. All state is
    in tables of the shared folder; the driver sees counts only.
    """
    both = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    open_ = cut(both, "components-edges")
    labels = None
    for _ in range(MAX_ROUNDS):
        if open_.isEmpty():
            break
        near = open_.unionByName(open_.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.min("v").alias("v"))
        parent = cut(near.select(F.col("u").alias("node"), F.least("u", "v").alias("root")), "components-parents")
        jumped = None
        for _ in range(MAX_ROUNDS):
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            step = cut(parent.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "components-jump")
            settled = step.where("moved").isEmpty()
            release(jumped or parent)
            jumped, parent = step, step.select("node", "root")
            if settled:
                break
        else:
            raise RuntimeError(f"pointer jumping has not ended after {MAX_ROUNDS} steps")
        to = lambda c: parent.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        if labels is None:
            labels = parent.select("node", F.col("root").alias("label"))
        else:
            over = parent.select(F.col("node").alias("label"), "root")
            newer = cut(labels.join(over, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "components-labels")
            release(labels)
            labels = newer
        moved = open_.join(to("u"), "u").join(to("v"), "v").where("ru <> rv")
        fewer = cut(moved.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "components-edges")
        release(open_)
        open_ = fewer
    else:
        raise RuntimeError(f"the components are not found after {MAX_ROUNDS} rounds")
    if labels is None:
        return both.select(F.col("u").alias("node"), F.col("v").alias("label")).limit(0)
    return labels


KEYS = "kind string, key string, comp string"
SAMPLES = "sample_id string, comp string"
COMPONENTS = "comp string, split string, samples bigint, status string, version int"
ALIAS = "comp string, root string"


@dataclass(frozen=True)
class ComponentTable:
    """A version of the persisted table, or, without a path, the empty one."""

    spark: SparkSession
    path: str | None = None

    @cached_property
    def paths(self) -> list[str]:
        """The folders of this version, one for each update."""
        if self.path is None:
            return []
        before = self.spark.read.schema("path string").parquet(f"{self.path}/history")
        return [*sorted(r["path"] for r in before.collect()), self.path]

    def _read(self, name: str, schema: str, paths: list[str] | None = None) -> DataFrame:
        paths = self.paths if paths is None else paths
        if not paths:
            fields = (x.split() for x in schema.split(", "))
            return self.spark.range(1).where(F.lit(False)).select(*[F.lit(None).cast(kind).alias(column) for column, kind in fields])
        return self.spark.read.schema(schema).parquet(*[f"{p}/{name}" for p in paths])

    @property
    def alias(self) -> DataFrame:
        return self._read("alias", ALIAS, [self.path] if self.path else [])

    def _resolved(self, df: DataFrame) -> DataFrame:
        if len(self.paths) < 2:  # nothing was merged yet
            return df
        columns = df.columns
        return df.join(self.alias, "comp", "left").withColumn("comp", F.coalesce("root", "comp")).select(*columns)

    @property
    def keys(self) -> DataFrame:
        return self._resolved(self._read("keys", KEYS))

    @property
    def samples(self) -> DataFrame:
        return self._resolved(self._read("samples", SAMPLES))

    @property
    def components(self) -> DataFrame:
        every = self._read("components", COMPONENTS)
        if len(self.paths) < 2:
            return every.drop("version")
        last = every.groupBy("comp").agg(F.max_by(F.struct("split", "samples", "status"), "version").alias("c")).select("comp", "c.*")
        return last.join(self.alias, "comp", "left_anti")

    def assignment(self) -> DataFrame:
        """``(sample_id, component, split_name, status)``: the split of every sample; null in quarantine."""
        return self.samples.join(self.components, "comp").select("sample_id", F.col("comp").alias("component"), F.col("split").alias("split_name"), "status")

    def shares(self, proportions: dict[str, float] = PROPORTIONS) -> DataFrame:
        """``(split_name, components, samples, share, target_share)``; a null split is the quarantine."""
        by = self.components.groupBy("split").agg(F.count("*").alias("components"), F.sum("samples").alias("samples"))
        goal = self.spark.createDataFrame(list(proportions.items()), "split string, target_share double")
        total = self.components.agg(F.sum("samples").alias("total"))
        out = goal.join(by, "split", "full").crossJoin(F.broadcast(total))  # one row
        return out.select(F.col("split").alias("split_name"), F.coalesce("components", F.lit(0)).alias("components"), F.coalesce("samples", F.lit(0)).alias("samples"),
                          F.round(F.coalesce("samples", F.lit(0)) / F.col("total"), 6).alias("share"), "target_share")

    def groups(self) -> DataFrame:
        """``(source_group, component)``: which groups share a split, as membership in one row a group."""
        return self.keys.where("kind = 'g'").select(F.col("key").alias("source_group"), F.col("comp").alias("component"))

    def group_pairs(self) -> DataFrame:
        """``(source_group_a, source_group_b)``: every pair of groups of one component, the smaller name first. Of a
        component of k groups these are k (k - 1) / 2 rows; :meth:`groups` says the same in k."""
        g = self.groups()
        many = g.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
        g = cut(g.join(many, "component", "left_semi"), "splits-groups")
        a, b = g.select("component", F.col("source_group").alias("source_group_a")), g.select("component", F.col("source_group").alias("source_group_b"))
        return a.join(b, "component").where("source_group_a < source_group_b").select("source_group_a", "source_group_b")

    def compacted(self, path: str | None = None) -> ComponentTable:
        """The same table in one folder without a history."""
        path = path or new_path(self.spark, "splits")
        self.keys.write.parquet(f"{path}/keys")
        self.samples.write.parquet(f"{path}/samples")
        self.components.withColumn("version", F.lit(0)).write.parquet(f"{path}/components")
        self._read("alias", ALIAS, []).write.parquet(f"{path}/alias")
        self._read("history", "path string", []).write.parquet(f"{path}/history")
        return ComponentTable(self.spark, path)

    def update(self, rows: DataFrame, path: str | None = None, proportions: dict[str, float] = PROPORTIONS) -> ComponentTable:
        """The next version, with ``rows`` taken in; it is written to ``path`` (by default in the shared folder).

        ``rows`` needs sample_id, source_image_id and source_group. Names are compared in lower case without
        surrounding blanks; null, blank, ``unknown`` and ``n/a`` tie nothing. Rows without a sample id tie their
        image to their group and count no sample. Repeated rows change nothing; an empty batch gives an equal table.
        """
        path = path or new_path(self.spark, "splits")
        first = self.path is None
        base = pick(rows, "sample_id", "source_image_id", "source_group").select(name_key(F.col("sample_id")).alias("s"), name_key(F.col("source_image_id")).alias("i"), name_key(F.col("source_group")).alias("g"))
        g, i = F.concat(F.lit("g:"), "g"), F.concat(F.lit("i:"), "i")
        if first:
            tagged = base.select("s", i.alias("i"), g.alias("g"), F.col("i").alias("new_i"), F.col("g").alias("new_g"))
        else:  # known keys are replaced by their components
            known = self.keys
            ki = known.where("kind = 'i'").select(F.col("key").alias("i"), F.col("comp").alias("ci"))
            kg = known.where("kind = 'g'").select(F.col("key").alias("g"), F.col("comp").alias("cg"))
            tagged = base.join(ki, "i", "left").join(kg, "g", "left").select("s", F.coalesce("ci", i).alias("i"), F.coalesce("cg", g).alias("g"), F.when(F.col("ci").isNull(), F.col("i")).alias("new_i"), F.when(F.col("cg").isNull(), F.col("g")).alias("new_g"))
            tagged = cut(tagged, "splits-tagged")
        anchored = tagged.select("s", F.coalesce("g", "i").alias("anchor"))
        by_sample = anchored.where("s is not null").groupBy("s").agg(F.min("anchor").alias("low"), F.max("anchor").alias("high"))
        if first:
            by_sample = by_sample.select("*", F.lit(False).alias("known"))
        else:
            old = self.samples.select(F.col("sample_id").alias("s"), F.col("comp").alias("was"))
            by_sample = by_sample.join(old, "s", "left").select("s", F.coalesce("was", "low").alias("low"), F.when(F.col("was").isNotNull() & (F.col("was") != F.col("low")), F.col("low")).otherwise(F.col("high")).alias("high"), F.col("was").isNotNull().alias("known"))
        by_sample = cut(by_sample, "splits-samples")
        torn = by_sample.where("low <> high").select("s", "low")
        links = tagged.where("i is not null and g is not null").select(F.col("i").alias("u"), F.col("g").alias("v")).distinct()
        links = links.unionByName(anchored.where("anchor is not null").join(torn, "s").select(F.col("low").alias("u"), F.col("anchor").alias("v")))
        labels = connected(links)

        # A label that stands for known components takes the name of the smallest of them.
        was = self.components
        if first:
            names, merged = labels.select("node", F.col("label").alias("comp")), None
        else:
            olds = cut(labels.join(was.withColumnRenamed("comp", "node"), "node"), "splits-known")
            merged = olds.groupBy("label").agg(
                F.min("node").alias("name"), F.sum("samples").alias("had"), F.count_distinct("split").alias("splits"), F.min("split").alias("one_split"), F.bool_or(F.col("status") == "quarantined").alias("spoilt"))
            merged = cut(merged, "splits-merged")
            names = cut(labels.join(merged, "label", "left").select("node", F.coalesce("name", "label").alias("comp")), "splits-names")

        def named(df: DataFrame, vertex: Column) -> DataFrame:
            return df.withColumn("_v", vertex).join(names.select(F.col("node").alias("_v"), F.col("comp").alias("_c")), "_v", "left").withColumn("comp", F.coalesce("_c", "_v"))

        own = F.concat(F.lit("s:"), "s")
        fresh = by_sample.where("not known").select(F.col("s").alias("sample_id"), F.coalesce("low", own).alias("v"))
        named(fresh, F.col("v")).select("sample_id", "comp").write.parquet(f"{path}/samples")
        pair = lambda kind, key, v: tagged.where(f"{key} is not null").select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.col(v).alias("v")).distinct()
        named(pair("i", "new_i", "i").unionByName(pair("g", "new_g", "g")), F.col("v")).select("kind", "key", "comp").write.parquet(f"{path}/keys")
        if first:
            alias = self.alias
        else:
            gone = olds.join(merged.select("label", "name"), "label").where("node <> name").select(F.col("node").alias("comp"), F.col("name").alias("root"))
            again = gone.select(F.col("comp").alias("root"), F.col("root").alias("_r"))
            alias = self.alias.join(again, "root", "left").select("comp", F.coalesce("_r", "root").alias("root")).unionByName(gone)
        alias.write.parquet(f"{path}/alias")
        self.spark.createDataFrame([(p,) for p in self.paths], "path string").coalesce(1).write.parquet(f"{path}/history")

        # The components that this update makes or changes, with what they were.
        read = lambda name, schema: self._read(name, schema, [path])
        sizes = read("samples", SAMPLES).groupBy("comp").agg(F.count("*").alias("more")).unionByName(read("keys", KEYS).select("comp", F.lit(0).cast("bigint").alias("more")))
        if first:
            sizes = sizes.groupBy("comp").agg(F.sum("more").alias("more"))
            state = sizes.select("comp", F.col("more").alias("samples"), F.lit(None).cast("string").alias("split"), F.lit(False).alias("spoilt"), F.lit(False).alias("old"))
        else:
            sizes = sizes.unionByName(merged.select(F.col("name").alias("comp"), F.lit(0).cast("bigint").alias("more"))).groupBy("comp").agg(F.sum("more").alias("more"))
            mine = was.select("comp", F.col("split").alias("own_split"), F.col("samples").alias("own_samples"), (F.col("status") == "quarantined").alias("own_spoilt"))
            now = merged.select(F.col("name").alias("comp"), "had", F.when(F.col("splits") <= 1, F.col("one_split")).alias("new_split"), ((F.col("splits") > 1) | F.col("spoilt")).alias("new_spoilt"))
            state = sizes.join(mine, "comp", "left").join(now, "comp", "left").select(
                "comp", (F.coalesce("had", "own_samples", F.lit(0)) + F.col("more")).alias("samples"), F.coalesce("new_split", "own_split").alias("split"),
                F.coalesce("new_spoilt", "own_spoilt", F.lit(False)).alias("spoilt"), F.coalesce("own_spoilt", "new_spoilt").isNotNull().alias("old"))
        state = cut(state, "splits-state")
        rest = None if first else was.join(state.select("comp"), "comp", "left_anti").join(gone.select("comp"), "comp", "left_anti")
        _fill(state, rest, proportions).withColumn("version", F.lit(len(self.paths))).write.parquet(f"{path}/components")
        return ComponentTable(self.spark, path)


def _fill(state: DataFrame, rest: DataFrame | None, proportions: dict[str, float]) -> DataFrame:
    """Give every new component a split. Components are put into at most ``SIZE_CLASSES * LOTS`` lots by size and
    hash; the lots, the heaviest first, go to the split that lacks most of its proportion. Only lots, not
    components, reach the driver; a heavy component is practically alone in its lot. ``rest``: the components that
    stay as they are; they count."""
    lot = F.pmod(F.xxhash64("comp"), F.lit(LOTS)).cast("int")
    state = state.withColumn("_class", F.floor(F.log2(F.greatest("samples", F.lit(1)))).cast("int")).withColumn("_lot", lot)
    new = (~F.col("old")) & (~F.col("spoilt"))
    weights = state.where(new).groupBy("_class", "_lot").agg(F.sum("samples").alias("n")).collect()
    settled = state.where(~new & ~F.col("spoilt")).select("split", "samples")
    settled = settled if rest is None else settled.unionByName(rest.where("split is not null").select("split", "samples"))
    have = {r["split"]: int(r["n"]) for r in settled.groupBy("split").agg(F.sum("samples").alias("n")).collect() if r["split"] in proportions}
    total = sum(int(r["n"]) for r in weights) + sum(have.values())
    lack = {s: p * total - have.get(s, 0) for s, p in proportions.items()}
    rows = []
    for r in sorted(weights, key=lambda r: (-r["n"], r["_class"], r["_lot"])):
        best = max(lack, key=lambda s: (lack[s], s))
        lack[best] -= int(r["n"])
        rows.append((r["_class"], r["_lot"], best))
    chosen = state.sparkSession.createDataFrame(rows, "_class int, _lot int, _given string")
    out = state.join(F.broadcast(chosen), ["_class", "_lot"], "left")  # at most SIZE_CLASSES * LOTS rows
    split = F.when(F.col("spoilt"), None).when(F.col("old"), F.col("split")).otherwise(F.col("_given"))
    return out.select("comp", split.alias("split"), F.col("samples").cast("bigint").alias("samples"), F.when(F.col("spoilt"), "quarantined").otherwise("assigned").alias("status"))


def assign_splits(rows: DataFrame, state: ComponentTable | None = None, proportions: dict[str, float] = PROPORTIONS, path: str | None = None) -> ComponentTable:
    """Take ``rows`` into ``state`` (by default an empty table) and return the new version of the table."""
    return (state or ComponentTable(rows.sparkSession)).update(rows, path, proportions)
