"""Queries of joins and aggregations over the observation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.keys import digest_key, path_key
from gridloom.functions.measures import set_digest
from gridloom.operators import evaluation as E
from gridloom.operators import relational as R
from gridloom.operators.boards import check_sequence
from gridloom.plans.common import LAYOUTS, PAYOUTS, layouts, payouts
from gridloom.plans.windows import BOARDS, IMAGES, boards, images
from gridloom.runtime import table

PREDICTION = "struct<symbolCode:string,confidence:double>"


def cells(s, d):
    """Distinct predicted cells with the board's own code of the same cell as the actual one."""
    o = table(s, d, "cell_observations").select("id", "recognized_board_id", "import_job_id", "row_index", "column_index", F.from_json("prediction", PREDICTION).alias("p")).select("id", "recognized_board_id", "import_job_id", "row_index", "column_index", F.col("p.symbolCode").alias("predicted"), F.col("p.confidence").alias("confidence")).distinct()
    b = table(s, d, "recognized_boards").groupBy(F.col("id").alias("recognized_board_id")).agg(F.max("cells_prediction").alias("codes"))
    b = b.select("recognized_board_id", F.from_json("codes", "array<string>").alias("codes"))
    j = o.join(b, "recognized_board_id").withColumn("actual", F.get("codes", F.col("row_index") * 5 + F.col("column_index"))).drop("codes")
    return j.withColumn("correct", (F.col("actual") == F.col("predicted")))


CELLS = """o AS (SELECT DISTINCT id, recognized_board_id, import_job_id, row_index, column_index, prediction->>'$.symbolCode' AS predicted, (prediction->>'$.confidence')::double AS confidence FROM cell_observations),
b AS (SELECT id AS recognized_board_id, max(cells_prediction) AS codes FROM recognized_boards GROUP BY 1),
cells AS (SELECT o.*, ((codes::json)->>(row_index * 5 + column_index)::int) AS actual, ((codes::json)->>(row_index * 5 + column_index)::int) = predicted AS correct FROM o JOIN b USING (recognized_board_id))"""


def r(x, n=6):
    return F.round(x, n)


def _sweep(s, d):
    return E.threshold_sweep(cells(s, d).where("correct is not null"))


SWEEP = (
    CELLS
    + """,
by_ AS (SELECT confidence AS threshold, count(*) AS n, count(*) FILTER (correct) AS k FROM cells WHERE correct IS NOT NULL AND confidence IS NOT NULL GROUP BY 1),
sums AS (SELECT threshold, (sum(n) OVER (ORDER BY threshold DESC))::bigint AS accepted, (sum(k) OVER (ORDER BY threshold DESC))::bigint AS hits, sum(n) OVER () AS total FROM by_),
sweep AS (SELECT threshold, accepted, hits, accepted / total AS coverage, hits / accepted AS precision,
 greatest(0, (hits / accepted + 1.96*1.96 / (2 * accepted) - 1.96 * sqrt((hits / accepted) * (1 - hits / accepted) / accepted + 1.96*1.96 / (4.0 * accepted * accepted))) / (1 + 1.96*1.96 / accepted)) AS wilson FROM sums)"""
)


def _rounded_sweep(df):
    return df.select("threshold", "accepted", "hits", r("coverage").alias("coverage"), r("precision").alias("precision"), r("wilson").alias("wilson"))


def _floor_lookup(s, d):
    """For every order the largest part size not beyond its key modulo 60, as a rule table."""
    o = table(s, d, "orders").select("o_orderkey", F.pmod(F.col("o_orderkey"), F.lit(60)).cast("int").alias("probe"))
    return R.floor_lookup(o, table(s, d, "part").select(F.col("p_size").alias("probe")), "probe", "rule").select("o_orderkey", "probe", "rule")


def _asof(s, d):
    """The mean board confidence per (page position), anchored at numbers divisible by 10, read at every number."""
    b = boards(s, d).where("sequence_number is not null and board_confidence is not null")
    anchors = b.where("sequence_number % 10 = 0").select("position_index", F.col("sequence_number").cast("double").alias("place"), F.col("board_confidence").alias("value"))
    probes = b.select("position_index", F.col("sequence_number").cast("double").alias("place")).distinct()
    return R.asof_interpolate(probes, anchors, ["position_index"], "place", "value").select("position_index", "place", r("value").alias("value"))


def _label_export(s, d):
    """Samples left-joined with their delivered split as a label: labelled, pending, or conflicting per crop."""
    x = table(s, d, "symbol_crop_samples").select("sample_id", digest_key(F.col("crop_checksum_sha256")).alias("digest"), F.lower(F.trim("split_name")).alias("label")).distinct()
    labels = x.where("label is not null and digest is not null").groupBy("digest").agg(F.count_distinct("label").alias("labels"))
    j = x.join(labels, "digest", "left")
    state = F.when(F.col("labels") > 1, "conflict").when(F.col("label").isNull(), "pending").otherwise("labelled")
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def _metric_dims(s, d):
    """Confidence by several dimensions at once: overall, by position, by status."""
    b = boards(s, d).where("board_confidence is not null")
    aggs = [F.count("*").alias("n"), F.max("board_confidence").alias("most"), r(E.linear_percentile(0.5, "board_confidence")).alias("p50"), r(E.linear_percentile(0.95, "board_confidence")).alias("p95")]
    out = b.agg(*aggs).select(F.lit("all").alias("dim"), F.lit("").alias("value"), "*")
    for dim in ("position_index", "status"):
        out = out.unionByName(b.groupBy(F.coalesce(F.col(dim).cast("string"), F.lit("")).alias("value")).agg(*aggs).withColumn("dim", F.lit(dim)))
    return out


def _boundary(s, d):
    """Groups of events by type changes (expected) against groups of five (found), per user."""
    from pyspark.sql import Window

    e = table(s, d, "events").select("user_id", "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = e.withColumn("k", F.row_number().over(w)).withColumn("new", F.coalesce((F.lag("event_type").over(w) != F.col("event_type")).cast("int"), F.lit(1)))
    e = e.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    expected = E.boundaries(e.groupBy("user_id", "g").agg(F.count("*").alias("size")), ["user_id"], "g", "size")
    found = E.boundaries(e.groupBy("user_id", F.floor((F.col("k") - 1) / 5).alias("g")).agg(F.count("*").alias("size")), ["user_id"], "g", "size")
    return E.compare_boundaries(expected, found, ["user_id"])


def _checksum(s, d):
    """A digest of all payouts, and their number."""
    row = F.concat_ws(":", F.col("sequence_number").cast("string"), F.col("payout").cast("string"))
    return payouts(s, d).agg(F.count("*").alias("rows"), set_digest(row).alias("digest"))


def _source_state(s, d):
    """A digest of the images of every job, which changes when any of its records does."""
    row = F.concat_ws("|", "id", F.coalesce("checksum_sha256", F.lit("")), F.coalesce("status", F.lit("")), F.coalesce(F.col("width").cast("string"), F.lit("")))
    return images(s, d).groupBy("import_job_id").agg(set_digest(row).alias("state"))


def _samples(s, d):
    return table(s, d, "symbol_crop_samples")


QUERIES = {
    # joins
    "join_inner_equi": lambda s, d: table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n")),
    "join_multiway": lambda s, d: table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity")),
    "join_multi_key": lambda s, d: boards(s, d).groupBy("source_image_id", "position_index").agg(F.count("*").alias("boards")).join(_samples(s, d).groupBy("source_image_id", F.col("board_index").alias("position_index")).agg(F.count("*").alias("samples")), ["source_image_id", "position_index"]),
    "join_versioned_fact": lambda s, d: layouts(s, d).select("sequence_number", "signature").withColumn("version", F.pmod("sequence_number", F.lit(3))).join(payouts(s, d).withColumn("version", F.pmod("sequence_number", F.lit(3))), ["version", "sequence_number"]).where("version = 1").select("sequence_number", "signature", "payout"),
    "join_left_selected": lambda s, d: images(s, d).select("id").distinct().join(boards(s, d).where("board_confidence >= 0.95").groupBy(F.col("source_image_id").alias("id")).agg(F.count("*").alias("sure")), "id", "left").select("id", F.coalesce("sure", F.lit(0)).alias("sure")),
    "join_left_anti": lambda s, d: boards(s, d).select("id").distinct().join(table(s, d, "cell_observations").select(F.col("recognized_board_id").alias("id")).distinct(), "id", "left_anti"),
    "join_not_in": lambda s, d: layouts(s, d).join(layouts(s, d).groupBy("signature").count().where("count > 1").select("signature"), "signature", "left_anti").agg(F.min("sequence_number").alias("first_unique"), F.count("*").alias("unique_signatures")),
    "join_set_anti": lambda s, d: images(s, d).select(digest_key(F.col("checksum_sha256")).alias("digest")).distinct().join(_samples(s, d).select(digest_key(F.col("source_image_checksum_sha256")).alias("digest")).distinct(), "digest", "left_anti"),
    "join_semi_in": lambda s, d: table(s, d, "crop_files").select("file_id", path_key(F.col("crop_relative_path")).alias("path")).join(table(s, d, "cell_observations").select(path_key(F.col("crop_relative_path")).alias("path")).distinct(), "path", "left_semi").agg(F.count("*").alias("n")),
    "join_latest_groupmax": lambda s, d: R.latest_by(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey")),
    "join_cross_rules": lambda s, d: table(s, d, "region").crossJoin(F.broadcast(table(s, d, "nation"))).where(F.col("n_regionkey") >= F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n")),
    "join_floor_lookup": _floor_lookup,
    "join_lateral_json": lambda s, d: table(s, d, "recognized_boards").select("id", F.posexplode(F.from_json("cells_prediction", "array<string>")).alias("place", "code")).distinct().groupBy("place", "code").agg(F.count("*").alias("n")),
    "join_label_transfer": lambda s, d: _samples(s, d).where("observation_id is not null").select("sample_id", F.col("observation_id").alias("id")).distinct().join(R.latest_by(cells(s, d).select("id", "predicted", "confidence"), ["id"], F.col("confidence"), F.col("predicted")), "id").select("sample_id", "id", "predicted"),
    "join_nn_cosine": lambda s, d: R.nearest_per_class(table(s, d, "embeddings"), table(s, d, "embeddings").where("vec_id % 50 = 0")).select("query_id", "class", r("similarity").alias("similarity"), "neighbour_id", "rank"),
    "join_asof_interpolate": _asof,
    "join_label_export": _label_export,
    "join_compatible_versions": lambda s, d: table(s, d, "part").select("p_size", "p_brand").distinct().join(table(s, d, "part").select("p_size", F.col("p_brand").alias("other")).distinct(), "p_size").where("p_brand < other").groupBy("p_size").agg(F.count("*").alias("pairs")),
    # aggregations
    "agg_filtered_multi": lambda s, d: boards(s, d).agg(F.count("*").alias("n"), F.count_if(F.col("sequence_number").isNotNull()).alias("numbered"), F.min(F.when(F.col("board_confidence") > 0.9, F.col("sequence_number"))).alias("lowest"), F.max(F.when(F.col("board_confidence") > 0.9, F.col("sequence_number"))).alias("highest"), F.count_distinct(F.when(F.col("board_confidence") > 0.9, F.col("sequence_number"))).alias("numbers")),
    "agg_missing_count": lambda s, d: boards(s, d).where("sequence_number >= 1").agg((F.coalesce(F.max("sequence_number"), F.lit(0)) - F.count_distinct("sequence_number")).alias("missing")),
    "agg_dup_having": lambda s, d: layouts(s, d).groupBy("signature").agg(F.count("*").alias("n")).where("n > 1"),
    "agg_of_agg": lambda s, d: layouts(s, d).groupBy("signature").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("affected"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess")),
    "agg_group_count": lambda s, d: table(s, d, "source_images").groupBy("status", "error_code").agg(F.count("*").alias("n")),
    "agg_conditional_sum": lambda s, d: images(s, d).groupBy("import_job_id").agg(*[F.coalesce(F.sum(F.when(F.col("width") >= w, 1).otherwise(0)), F.lit(0)).alias(f"from_{w}") for w in (1280, 1920, 2560, 4032)]),
    "agg_pivot_status": lambda s, d: boards(s, d).withColumn("kind", F.when(F.col("sequence_number").isNull(), "open").otherwise("numbered")).groupBy("position_index").pivot("kind", ["open", "numbered"]).agg(F.count("id")).fillna(0),
    "agg_bool_or": lambda s, d: _samples(s, d).groupBy(path_key(F.col("crop_relative_path")).alias("path")).agg(F.bool_or(F.col("source_group") != "rig-main-hall").alias("elsewhere")).where("elsewhere").agg(F.count("*").alias("n")),
    "agg_max_plus_one": lambda s, d: boards(s, d).groupBy("source_image_id").agg((F.max("position_index") + 1).alias("next_position")),
    "agg_candidate_rollup": lambda s, d: cells(s, d).where("predicted is not null").groupBy("predicted").agg(F.count("*").alias("n"), r(F.avg("confidence")).alias("mean_confidence"), F.min_by("id", F.struct(-F.coalesce("confidence", F.lit(-1.0)), "id")).alias("representative")),
    "agg_mode_consensus": lambda s, d: E.mode_larger(boards(s, d), ["source_image_id"], "position_index").join(E.mode_larger(boards(s, d).select("source_image_id", F.floor(F.col("board_confidence") * 10).alias("tenth")), ["source_image_id"], "tenth"), "source_image_id"),
    "agg_counter_prefix": lambda s, d: layouts(s, d).select("sequence_number", F.explode(F.sequence(F.lit(1), F.lit(14))).alias("cells"), "signature").groupBy("cells", F.substring("signature", F.lit(1), F.col("cells") * 2).alias("prefix")).agg(F.count("*").alias("n")).groupBy("cells").agg(F.count("*").alias("prefixes"), F.count_if(F.col("n") == 1).alias("unique_prefixes"), F.max("n").alias("most")),
    "agg_confusion": lambda s, d: E.confusion(cells(s, d)),
    "agg_class_metrics": lambda s, d: E.class_metrics(E.confusion(cells(s, d))).select("class", "support", "predicted_as", "hits", r("precision").alias("precision"), r("recall").alias("recall"), r("f1").alias("f1")),
    "agg_calibration": lambda s, d: E.calibration(cells(s, d).where("correct is not null")).select("bin", "n", r("mean_confidence").alias("mean_confidence"), r("accuracy").alias("accuracy"), r("gap").alias("gap")),
    "agg_calibration_summary": lambda s, d: E.calibration_summary(cells(s, d).where("correct is not null")).select("n", r("ece").alias("ece"), r("brier").alias("brier"), r("nll").alias("nll")),
    "agg_threshold_sweep": lambda s, d: _rounded_sweep(_sweep(s, d)),
    "agg_policy_select": lambda s, d: _rounded_sweep(E.select_threshold(_sweep(s, d), 0.5)),
    "agg_best_threshold": lambda s, d: _rounded_sweep(E.best_threshold(_sweep(s, d), 0.999)),
    "agg_percentile_nearest_rank": lambda s, d: table(s, d, "events").groupBy("event_type").agg(*[E.nearest_rank(q, "value").alias(f"p{round(q * 100)}") for q in (0.5, 0.95)]),
    "agg_percentile_linear": lambda s, d: table(s, d, "events").groupBy("event_type").agg(*[r(E.linear_percentile(q, "value")).alias(f"p{round(q * 100)}") for q in (0.5, 0.95)]),
    "agg_metric_by_dims": _metric_dims,
    "agg_complete_groups": lambda s, d: cells(s, d).select("recognized_board_id", (F.col("row_index") * 5 + F.col("column_index")).alias("i"), "correct").groupBy("recognized_board_id").agg(F.count_distinct("i").alias("cells"), F.count_if(F.col("correct") == F.lit(False)).alias("wrong")).groupBy((F.col("cells") == 15).alias("complete"), (F.col("wrong") > 0).alias("corrected")).agg(F.count("*").alias("boards")),
    "agg_boundary_eval": _boundary,
    "agg_argmax_candidate": lambda s, d: table(s, d, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_retailprice", "p_size", -F.col("p_partkey"))).alias("best")),
    "agg_timing_summary": lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.min_by("value", "event_id").alias("first"), F.min("value").alias("least"), E.nearest_rank(0.5, "value").alias("p50"), E.nearest_rank(0.95, "value").alias("p95"), F.max("value").alias("most")),
    "agg_group_tags": lambda s, d: table(s, d, "board_candidates").select("observation_id", "image_id", F.explode("condition_tags").alias("tag")).where("tag is not null").groupBy(F.replace(F.lower(F.trim("tag")), F.lit("_"), F.lit("-")).alias("tag")).agg(F.count("*").alias("n"), F.count_distinct("image_id").alias("images")),
    "agg_digit_length": lambda s, d: boards(s, d).where("sequence_number is not null").groupBy(F.length(F.col("sequence_number").cast("string")).alias("digits")).agg(F.count("*").alias("n"), r(F.avg("sequence_confidence")).alias("mean_confidence")),
    "agg_error_catalog": lambda s, d: cells(s, d).select(F.when(F.col("predicted").isNull(), "absent").when(F.col("actual").isNull(), "unknown").when(F.col("correct"), "exact").when(F.levenshtein("predicted", "actual") <= 2, "close").otherwise("other").alias("kind")).groupBy("kind").agg(F.count("*").alias("n")),
    "agg_checksum": _checksum,
    "agg_source_state": _source_state,
    "agg_storage_inventory": lambda s, d: table(s, d, "crop_files").groupBy(F.element_at(F.split(path_key(F.col("crop_relative_path")), "/"), 1).alias("namespace")).agg(F.count("*").alias("files"), F.sum("byte_size").alias("bytes")),
    "dom_sequence_check": lambda s, d: check_sequence(boards(s, d), table(s, d, "orders").count()).withColumn("complete", F.coalesce("complete", F.lit(False))),
}

_P = """regexp_replace({c}, '(^|/)(\\./)+', '\\1', 'g')"""
from gridloom.plans.repair import _PLACE  # noqa: E402

_DIG = "nullif(regexp_replace(lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13))), '^sha256:', ''), '')"
_SET = "sha256(concat_ws(':', count(*)::varchar, " + ", ".join(f"sum(('0x' || substr(h, {1 + 12 * i}, 12))::hugeint)::varchar" for i in range(5)) + "))"
_DIM = "count(*) AS n, max(board_confidence) AS most, round(quantile_cont(board_confidence, 0.5), 6) AS p50, round(quantile_cont(board_confidence, 0.95), 6) AS p95"

SQL = {
    "join_inner_equi": "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "join_multiway": "SELECT r_name, count(*) AS n, sum(l_quantity::bigint)::bigint AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "join_multi_key": f"WITH {BOARDS}, x AS (SELECT source_image_id, position_index, count(*) AS boards FROM rb GROUP BY 1, 2), y AS (SELECT source_image_id, board_index AS position_index, count(*) AS samples FROM symbol_crop_samples GROUP BY 1, 2) SELECT * FROM x JOIN y USING (source_image_id, position_index)",
    "join_versioned_fact": f"WITH {PAYOUTS} SELECT b.sequence_number, signature, payout FROM boards b JOIN payouts p ON b.sequence_number = p.sequence_number WHERE b.sequence_number % 3 = 1",
    "join_left_selected": f"WITH {BOARDS}, {IMAGES}, i AS (SELECT DISTINCT id FROM si) SELECT i.id, count(rb.id) AS sure FROM i LEFT JOIN rb ON rb.source_image_id = i.id AND rb.board_confidence >= 0.95 GROUP BY 1",
    "join_left_anti": "SELECT DISTINCT id FROM recognized_boards b WHERE NOT EXISTS (SELECT 1 FROM cell_observations c WHERE c.recognized_board_id = b.id)",
    "join_not_in": f"WITH {LAYOUTS} SELECT min(sequence_number) AS first_unique, count(*) AS unique_signatures FROM boards WHERE signature NOT IN (SELECT signature FROM boards GROUP BY 1 HAVING count(*) > 1)",
    "join_set_anti": f"SELECT DISTINCT {_DIG.format(c='checksum_sha256')} AS digest FROM source_images WHERE {_DIG.format(c='checksum_sha256')} IS NULL OR {_DIG.format(c='checksum_sha256')} NOT IN (SELECT {_DIG.format(c='source_image_checksum_sha256')} FROM symbol_crop_samples WHERE source_image_checksum_sha256 IS NOT NULL)",
    "join_semi_in": f"WITH f AS (SELECT {_PLACE.format(c='crop_relative_path')} AS p FROM crop_files), o AS (SELECT DISTINCT {_PLACE.format(c='crop_relative_path')} AS p FROM cell_observations) SELECT count(*) AS n FROM f WHERE p IN (SELECT p FROM o WHERE p IS NOT NULL)",
    "join_latest_groupmax": "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1",
    "join_cross_rules": "SELECT r_name, count(*) AS n FROM region, nation WHERE n_regionkey >= r_regionkey GROUP BY 1",
    "join_floor_lookup": "WITH p AS (SELECT DISTINCT p_size FROM part) SELECT o_orderkey, (o_orderkey % 60)::int AS probe, (SELECT max(p_size) FROM p WHERE p_size <= o_orderkey % 60) AS rule FROM orders",
    "join_lateral_json": "WITH x AS (SELECT DISTINCT id, generate_subscripts(c, 1) - 1 AS place, unnest(c) AS code FROM (SELECT id, from_json(cells_prediction, '[\"VARCHAR\"]') AS c FROM recognized_boards)) SELECT place, code, count(*) AS n FROM x GROUP BY 1, 2",
    "join_label_transfer": f"WITH {CELLS}, l AS (SELECT id, predicted FROM (SELECT id, predicted, row_number() OVER (PARTITION BY id ORDER BY confidence DESC NULLS LAST, predicted DESC NULLS LAST) AS k FROM cells) WHERE k = 1) SELECT DISTINCT sample_id, l.id, predicted FROM symbol_crop_samples s JOIN l ON s.observation_id = l.id",
    "join_nn_cosine": """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS e FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS l FROM v),
s AS (SELECT q.vec_id AS query_id, v.label AS class, v.vec_id AS neighbour_id, round(list_dot_product(q.e, v.e) / (q.l * v.l), 9) AS sim FROM n q JOIN n v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
b AS (SELECT query_id, class, neighbour_id, sim, row_number() OVER (PARTITION BY query_id, class ORDER BY sim DESC, neighbour_id) AS k FROM s WHERE sim >= 0)
SELECT query_id, class, round(sim, 6) AS similarity, neighbour_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, class) AS rank FROM b WHERE k = 1) WHERE rank <= 3""",
    "join_asof_interpolate": f"""WITH {BOARDS}, x AS (SELECT position_index, sequence_number::double AS place, board_confidence AS v FROM rb WHERE sequence_number IS NOT NULL AND board_confidence IS NOT NULL),
a AS (SELECT position_index, place, avg(v) AS v FROM x WHERE place % 10 = 0 GROUP BY 1, 2), p AS (SELECT DISTINCT position_index, place FROM x),
lo AS (SELECT p.*, a.place AS x0, a.v AS y0 FROM p ASOF LEFT JOIN a ON p.position_index = a.position_index AND p.place >= a.place), hi AS (SELECT lo.*, a.place AS x1, a.v AS y1 FROM lo ASOF LEFT JOIN a ON lo.position_index = a.position_index AND lo.place <= a.place)
SELECT position_index, place, round(round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * (place - x0) / (x1 - x0) END, 10), 6) AS value FROM hi""",
    "join_label_export": f"""WITH x AS (SELECT DISTINCT sample_id, {_DIG.format(c='crop_checksum_sha256')} AS digest, lower(trim(split_name)) AS label FROM symbol_crop_samples), l AS (SELECT digest, count(DISTINCT label) AS labels FROM x WHERE label IS NOT NULL AND digest IS NOT NULL GROUP BY 1)
SELECT CASE WHEN labels > 1 THEN 'conflict' WHEN label IS NULL THEN 'pending' ELSE 'labelled' END AS state, count(*) AS n FROM x LEFT JOIN l USING (digest) GROUP BY 1""",
    "join_compatible_versions": "WITH p AS (SELECT DISTINCT p_size, p_brand FROM part) SELECT a.p_size, count(*) AS pairs FROM p a JOIN p b ON a.p_size = b.p_size AND a.p_brand < b.p_brand GROUP BY 1",
    "agg_filtered_multi": f"WITH {BOARDS} SELECT count(*) AS n, count(*) FILTER (sequence_number IS NOT NULL) AS numbered, min(sequence_number) FILTER (board_confidence > 0.9) AS lowest, max(sequence_number) FILTER (board_confidence > 0.9) AS highest, count(DISTINCT sequence_number) FILTER (board_confidence > 0.9) AS numbers FROM rb",
    "agg_missing_count": f"WITH {BOARDS} SELECT coalesce(max(sequence_number), 0) - count(DISTINCT sequence_number) AS missing FROM rb WHERE sequence_number >= 1",
    "agg_dup_having": f"WITH {LAYOUTS} SELECT signature, count(*) AS n FROM boards GROUP BY 1 HAVING count(*) > 1",
    "agg_of_agg": f"WITH {LAYOUTS}, g AS (SELECT count(*) AS n FROM boards GROUP BY signature HAVING count(*) > 1) SELECT count(*) AS groups, coalesce(sum(n), 0)::bigint AS affected, coalesce(sum(n - 1), 0)::bigint AS excess FROM g",
    "agg_group_count": "SELECT status, error_code, count(*) AS n FROM source_images GROUP BY 1, 2",
    "agg_conditional_sum": f"WITH {IMAGES} SELECT import_job_id, " + ", ".join(f"count(*) FILTER (width >= {w}) AS from_{w}" for w in (1280, 1920, 2560, 4032)) + " FROM si GROUP BY 1",
    "agg_pivot_status": f"WITH {BOARDS} SELECT position_index, count(*) FILTER (sequence_number IS NULL) AS open, count(*) FILTER (sequence_number IS NOT NULL) AS numbered FROM rb GROUP BY 1",
    "agg_bool_or": f"WITH x AS (SELECT {_PLACE.format(c='crop_relative_path')} AS p, source_group <> 'rig-main-hall' AS e FROM symbol_crop_samples) SELECT count(*) AS n FROM (SELECT p FROM x GROUP BY 1 HAVING bool_or(e))",
    "agg_max_plus_one": f"WITH {BOARDS} SELECT source_image_id, max(position_index) + 1 AS next_position FROM rb GROUP BY 1",
    "agg_candidate_rollup": f"WITH {CELLS} SELECT predicted, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, first(id ORDER BY -coalesce(confidence, -1), id) AS representative FROM cells WHERE predicted IS NOT NULL GROUP BY 1",
    "agg_mode_consensus": f"""WITH {BOARDS}, a AS (SELECT source_image_id, position_index AS v, count(*) AS n FROM rb WHERE position_index IS NOT NULL GROUP BY 1, 2), b AS (SELECT source_image_id, floor(board_confidence * 10) AS v, count(*) AS n FROM rb WHERE board_confidence IS NOT NULL GROUP BY 1, 2),
x AS (SELECT source_image_id, first(v ORDER BY n DESC, v DESC) AS position_index FROM a GROUP BY 1), y AS (SELECT source_image_id, first(v ORDER BY n DESC, v DESC)::bigint AS tenth FROM b GROUP BY 1) SELECT * FROM x JOIN y USING (source_image_id)""",
    "agg_counter_prefix": f"WITH {LAYOUTS}, p AS (SELECT l.i AS cells, substr(signature, 1, (l.i * 2)::int) AS prefix, count(*) AS n FROM boards, range(1, 15) l(i) GROUP BY 1, 2) SELECT cells, count(*) AS prefixes, count(*) FILTER (n = 1) AS unique_prefixes, max(n) AS most FROM p GROUP BY 1",
    "agg_confusion": f"WITH {CELLS} SELECT actual, predicted, count(*) AS n FROM cells WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY 1, 2",
    "agg_class_metrics": f"""WITH {CELLS}, c AS (SELECT actual, predicted FROM cells WHERE actual IS NOT NULL AND predicted IS NOT NULL), k AS (SELECT actual AS class FROM c UNION SELECT predicted FROM c),
m AS (SELECT class, count(*) FILTER (actual = class) AS support, count(*) FILTER (predicted = class) AS predicted_as, count(*) FILTER (actual = class AND predicted = class) AS hits FROM k, c GROUP BY 1),
q AS (SELECT *, CASE WHEN predicted_as > 0 THEN hits / predicted_as ELSE 0 END AS p, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS r FROM m)
SELECT class, support, predicted_as, hits, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM q""",
    "agg_calibration": f"WITH {CELLS}, x AS (SELECT least(floor(confidence * 10), 9)::int AS bin, confidence, correct::int AS c FROM cells WHERE correct IS NOT NULL AND confidence IS NOT NULL) SELECT bin, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, round(avg(c), 6) AS accuracy, round(abs(avg(confidence) - avg(c)), 6) AS gap FROM x GROUP BY 1",
    "agg_calibration_summary": f"""WITH {CELLS}, x AS (SELECT least(floor(confidence * 10), 9)::int AS bin, confidence AS p, correct::int AS c, greatest(1e-15, least(1 - 1e-15, confidence)) AS q FROM cells WHERE correct IS NOT NULL AND confidence IS NOT NULL),
bb AS (SELECT count(*) AS n, abs(avg(p) - avg(c)) AS gap FROM x GROUP BY bin)
SELECT count(*) AS n, (SELECT round(sum(n * gap) / sum(n), 6) FROM bb) AS ece, round(avg((p - c) * (p - c)), 6) AS brier, round(avg(-CASE WHEN c = 1 THEN ln(q) ELSE ln(1 - q) END), 6) AS nll FROM x""",
    "agg_threshold_sweep": f"WITH {SWEEP} SELECT threshold, accepted, hits, round(coverage, 6) AS coverage, round(precision, 6) AS precision, round(wilson, 6) AS wilson FROM sweep",
    "agg_policy_select": f"WITH {SWEEP} SELECT threshold, accepted, hits, round(coverage, 6) AS coverage, round(precision, 6) AS precision, round(wilson, 6) AS wilson FROM sweep WHERE wilson >= 0.5 ORDER BY accepted DESC, threshold LIMIT 1",
    "agg_best_threshold": f"WITH {SWEEP} SELECT threshold, accepted, hits, round(coverage, 6) AS coverage, round(precision, 6) AS precision, round(wilson, 6) AS wilson FROM sweep ORDER BY precision >= 0.999 DESC, CASE WHEN precision >= 0.999 THEN accepted ELSE precision END DESC, threshold LIMIT 1",
    "agg_percentile_nearest_rank": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1",
    "agg_percentile_linear": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1",
    "agg_metric_by_dims": f"WITH {BOARDS}, x AS (SELECT * FROM rb WHERE board_confidence IS NOT NULL) SELECT 'all' AS dim, '' AS value, {_DIM} FROM x UNION ALL SELECT 'position_index', coalesce(position_index::varchar, ''), {_DIM} FROM x GROUP BY 2 UNION ALL SELECT 'status', coalesce(status, ''), {_DIM} FROM x GROUP BY 2",
    "agg_complete_groups": f"WITH {CELLS}, x AS (SELECT recognized_board_id, count(DISTINCT row_index * 5 + column_index) AS cells, count(*) FILTER (NOT correct) AS wrong FROM cells GROUP BY 1) SELECT cells = 15 AS complete, wrong > 0 AS corrected, count(*) AS boards FROM x GROUP BY 1, 2",
    "agg_boundary_eval": """WITH e AS (SELECT user_id, row_number() OVER w AS k, coalesce((lag(event_type) OVER w <> event_type)::int, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT user_id, k, sum(new) OVER (PARTITION BY user_id ORDER BY k) AS g, max(k) OVER (PARTITION BY user_id) AS n FROM e), a AS (SELECT user_id, max(k) AS b FROM g GROUP BY user_id, g), f AS (SELECT user_id, max(k) AS b FROM g GROUP BY user_id, (k - 1) // 5)
SELECT coalesce(a.user_id, f.user_id) AS user_id, count(a.b) AS expected, count(f.b) AS found, count(*) FILTER (a.b IS NOT NULL AND f.b IS NOT NULL) AS common, count(a.b) - count(*) FILTER (a.b IS NOT NULL AND f.b IS NOT NULL) AS false_merges, count(f.b) - count(*) FILTER (a.b IS NOT NULL AND f.b IS NOT NULL) AS false_splits FROM a FULL JOIN f ON a.user_id = f.user_id AND a.b = f.b GROUP BY 1""",
    "agg_argmax_candidate": "SELECT p_brand, first(p_partkey ORDER BY p_retailprice DESC, p_size DESC, p_partkey) AS best FROM part GROUP BY 1",
    "agg_timing_summary": "SELECT event_type, arg_min(value, event_id) AS first, min(value) AS least, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY 1",
    "agg_group_tags": "WITH x AS (SELECT image_id, unnest(condition_tags) AS t FROM board_candidates) SELECT replace(lower(trim(t)), '_', '-') AS tag, count(*) AS n, count(DISTINCT image_id) AS images FROM x WHERE t IS NOT NULL GROUP BY 1",
    "agg_digit_length": f"WITH {BOARDS} SELECT length(sequence_number::varchar)::int AS digits, count(*) AS n, round(avg(sequence_confidence), 6) AS mean_confidence FROM rb WHERE sequence_number IS NOT NULL GROUP BY 1",
    "agg_error_catalog": f"WITH {CELLS} SELECT CASE WHEN predicted IS NULL THEN 'absent' WHEN actual IS NULL THEN 'unknown' WHEN correct THEN 'exact' WHEN levenshtein(predicted, actual) <= 2 THEN 'close' ELSE 'other' END AS kind, count(*) AS n FROM cells GROUP BY 1",
    "agg_checksum": f"WITH {PAYOUTS}, h AS (SELECT sha256(sequence_number || ':' || payout) AS h FROM payouts) SELECT count(*) AS rows, {_SET} AS digest FROM h",
    "agg_source_state": f"WITH {IMAGES}, h AS (SELECT import_job_id, sha256(concat_ws('|', id, coalesce(checksum_sha256, ''), coalesce(status, ''), coalesce(width::varchar, ''))) AS h FROM si) SELECT import_job_id, {_SET} AS state FROM h GROUP BY 1",
    "agg_storage_inventory": f"SELECT string_split({_PLACE.format(c='crop_relative_path')}, '/')[1] AS namespace, count(*) AS files, sum(byte_size)::bigint AS bytes FROM crop_files GROUP BY 1",
    "dom_sequence_check": f"WITH {BOARDS} SELECT count(*) AS rows, count(DISTINCT sequence_number) AS numbers, min(sequence_number) AS lowest, max(sequence_number) AS highest, coalesce(count(*) = any_value(n.n) AND count(DISTINCT sequence_number) = any_value(n.n) AND min(sequence_number) = 1 AND max(sequence_number) = any_value(n.n), false) AS complete FROM rb, (SELECT count(*) AS n FROM orders) n",
}
