"""Queries of windows, sorts, pages, set operations, filters and projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions.measures import natural_key
from gridloom.operators import relational as R
from gridloom.operators.ordering import row_numbers, running_sum
from gridloom.plans.common import LAYOUTS, PAYOUTS, layouts, payouts
from gridloom.runtime import table


def T(name):
    return lambda s, d: table(s, d, name)


def boards(s, d):
    """Distinct board records; a redelivery of an equal record is none of its own."""
    return table(s, d, "recognized_boards").select("id", "source_image_id", "position_index", "sequence_number", "sequence_confidence", "board_confidence", "status").distinct()


def images(s, d):
    return table(s, d, "source_images").select("id", "import_job_id", "checksum_sha256", "width", "height", "status").distinct()


BOARDS = "rb AS (SELECT DISTINCT id, source_image_id, position_index, sequence_number, sequence_confidence, board_confidence, status FROM recognized_boards)"
IMAGES = "si AS (SELECT DISTINCT id, import_job_id, checksum_sha256, width, height, status FROM source_images)"
LINES = "ll AS (SELECT DISTINCT job_id, line_number, file_format FROM layout_import_lines)"
N_BOARDS = 500


def _rank_source(s, d):
    b = boards(s, d).where("sequence_number is not null").join(images(s, d).select(F.col("id").alias("source_image_id"), "width", "height").groupBy("source_image_id").agg(F.max(F.col("width") * F.col("height")).alias("area")), "source_image_id")
    return R.top_k(b, ["sequence_number"], 1 << 30, F.col("board_confidence").desc_nulls_last(), F.col("sequence_confidence").desc_nulls_last(), F.desc("area"), F.asc("id")).select("sequence_number", "id", "rank")


def _continuity(s, d):
    """Each board's number against the board before it on the page; a missing number before gives no verdict."""
    w = Window.partitionBy("source_image_id").orderBy("position_index", "id")
    p = F.lag("sequence_number").over(w)
    n = F.col("sequence_number")
    verdict = F.when(n.isNull(), "missing").when(p.isNull(), "none").when(n == p, "duplicate").when(n == p + 1, "none").when(n > p + 1, "gap").otherwise("conflict")
    return boards(s, d).select("source_image_id", "position_index", "id", "sequence_number", verdict.alias("verdict"))


def _local_peaks(s, d):
    """Peaks of the running value of every user's events against a cost of 50 an event."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(s, d, "events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("bigint").alias("v")).withColumn("net", F.sum(F.col("v") - 5000).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("turn", F.signum((F.col("v") - 5000).cast("double"))).where("turn <> 0").withColumn("following", F.lead("turn").over(w))
    return e.where("turn = 1 and coalesce(following, -1) = -1 and net > 0").select("user_id", "event_id", "net")


def _monotonic(s, d):
    """Orders of a customer, by date, whose total is not above the one before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice").withColumn("before", F.lag("o_totalprice").over(w))
    return o.where("o_totalprice <= before").select("o_custkey", "o_orderkey")


def _page(s, d, cursor=None, backwards=False):
    return R.page(table(s, d, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", True), ("o_orderkey", False)], 25, cursor, backwards)


def _cursor_codec(s, d):
    """The cursor after every order, coded and read back; one of another scope reads as null."""
    o = table(s, d, "orders").select("o_orderkey")
    c = F.to_json(F.struct(F.lit("orders").alias("scope"), F.col("o_orderkey").alias("after")))
    o = o.withColumn("cursor", F.translate(F.base64(F.encode(c, "UTF-8")), "+/", "-_"))
    back = F.decode(F.unbase64(F.translate("cursor", "-_", "+/")), "UTF-8")
    return o.select("o_orderkey", F.regexp_replace("cursor", "=+$", "").alias("cursor"), F.when(F.get_json_object(back, "$.scope") == "orders", F.get_json_object(back, "$.after").cast("bigint")).alias("after"))


def _dup_range(s, d):
    """Layouts whose first three cells an earlier one has, with the first of these. The first of each range is found by an
    aggregation with a partial step and joined, so that a range with very many layouts can be split."""
    b = layouts(s, d).select("sequence_number", F.substring("signature", 1, 6).alias("range"))
    first = b.groupBy("range").agg(F.min("sequence_number").alias("duplicate_of"))
    return b.join(first, "range").where("duplicate_of < sequence_number").select("sequence_number", "range", "duplicate_of")


QUERIES = {
    # windows
    "win_lag_gap": lambda s, d: R.gap_ranges(boards(s, d), "sequence_number"),
    "win_lag_gap_tail": lambda s, d: R.expand_ranges(R.gap_ranges(boards(s, d), "sequence_number", table(s, d, "orders").count()), 100),
    "win_rownum_lines": lambda s, d: R.top_k(boards(s, d).where("sequence_number is not null").join(boards(s, d).groupBy("sequence_number").count().where("count > 1").select("sequence_number"), "sequence_number", "left_semi"), ["sequence_number"], 3, F.asc("id")).select("sequence_number", "id", "rank"),
    "win_rownum_sig": lambda s, d: R.top_k(layouts(s, d).join(layouts(s, d).groupBy("signature").count().where("count > 1").select("signature"), "signature", "left_semi"), ["signature"], 3, F.asc("sequence_number")).select("signature", "sequence_number", "rank"),
    "win_running_sum": lambda s, d: running_sum(payouts(s, d).select("sequence_number", "payout"), F.col("sequence_number"), F.col("payout"), "total"),
    "win_local_peak": _local_peaks,
    "win_continuity": _continuity,
    "win_rule_monotonic": _monotonic,
    "win_rank_source": _rank_source,
    "win_latest_event": lambda s, d: R.latest_by(table(s, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], F.col("event_id")),
    "win_topk_bounded": lambda s, d: R.top_k(table(s, d, "events").select("user_id", "event_id", "value"), ["user_id"], 3, F.desc("value"), F.asc("event_id")),
    "win_dup_range": _dup_range,
    # sorts, limits, pages
    "sort_multi_key": lambda s, d: row_numbers(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), F.asc("l_suppkey"), F.asc("l_partkey"), F.asc("l_orderkey"), F.asc("l_linenumber"), name="rank"),
    "sort_desc_mixed": lambda s, d: row_numbers(table(s, d, "orders").select("o_orderkey", "o_orderdate"), F.col("o_orderdate").desc_nulls_first(), F.asc("o_orderkey"), name="rank"),
    "sort_natural": lambda s, d: row_numbers(table(s, d, "crop_files").where("crop_relative_path is not null").select("file_id", natural_key(F.col("crop_relative_path")).alias("key")), F.asc("key"), F.asc("file_id"), name="rank"),
    "topk_limit": lambda s, d: table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), F.asc("o_orderkey")).limit(10),
    "page_keyset": lambda s, d: R.page(table(s, d, "orders").select("o_orderkey", "o_custkey"), [("o_orderkey", False)], 25, (1000,)),
    "page_bidirectional": lambda s, d: _page(s, d, (300000.0, 0), True),
    "page_desc_float_cursor": lambda s, d: _page(s, d, (300000.0, 0)),
    "page_cursor_codec": _cursor_codec,
    "sample_bounded": lambda s, d: R.top_k(table(s, d, "lineitem").select("l_suppkey", "l_partkey").distinct(), ["l_suppkey"], 101, F.asc("l_partkey")).groupBy("l_suppkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("p")).select("l_suppkey", F.concat_ws(",", F.transform(F.slice("p", 1, 100), lambda x: x.cast("string"))).alias("sample"), (F.size("p") > 100).alias("truncated")),
    # sets
    "set_union_all_cyclic": lambda s, d: payouts(s, d).where("sequence_number > 777").select(F.lit(0).alias("segment"), "sequence_number", "payout").unionByName(payouts(s, d).where("sequence_number < 777").select(F.lit(1).alias("segment"), "sequence_number", "payout")),
    "set_distinct": lambda s, d: boards(s, d).select("sequence_number").distinct(),
    "set_group_distinct_limit2": lambda s, d: layouts(s, d).where(F.col("signature").startswith("0102")).select("signature").distinct().orderBy("signature").limit(2),
    "set_difference_py": lambda s, d: table(s, d, "symbol_crop_samples").select("observation_id").where("observation_id is not null").subtract(table(s, d, "cell_observations").select("id")),
    # filters
    "flt_range_between": lambda s, d: boards(s, d).where("sequence_number is not null").groupBy(F.col("sequence_number").between(1, N_BOARDS).alias("inside")).agg(F.count("*").alias("n")),
    "flt_prefix_range": lambda s, d: layouts(s, d).where((F.col("signature") >= "0305") & (F.col("signature") < "0305:")).select("sequence_number", "signature"),
    "flt_equality": lambda s, d: table(s, d, "customer").where("c_custkey = 77").select("c_custkey", "c_name"),
    "flt_in_list": lambda s, d: table(s, d, "events").where(F.col("event_type").isin("error", "signup")).groupBy("event_type").agg(F.count("*").alias("n")),
    "flt_null_variant": lambda s, d: table(s, d, "source_images").groupBy(F.col("error_code").isNull().alias("fine"), F.col("processed_at").isNull().alias("open")).agg(F.count("*").alias("n")),
    "flt_optional_conjuncts": lambda s, d: optional(table(s, d, "orders"), o_orderstatus="F", o_orderpriority=None, o_custkey=None).agg(F.count("*").alias("n")),
    "flt_lexicographic": lambda s, d: table(s, d, "lineitem").where(F.struct("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber") > F.struct(F.lit(50).cast("bigint"), F.lit(1000).cast("bigint"), F.lit(7000).cast("bigint"), F.lit(2))).agg(F.count("*").alias("n")),
    # projections
    "prj_case_stage": lambda s, d: boards(s, d).select("id", F.when(F.col("sequence_number").isNull(), "unnumbered").when(F.col("sequence_confidence") < 0.8, "doubtful").when(F.col("board_confidence") >= 0.9, "sure").otherwise(F.coalesce("status", F.lit("none"))).alias("stage")),
    "prj_json_extract": lambda s, d: table(s, d, "cell_observations").select("id", "prediction").distinct().select("id", F.get_json_object("prediction", "$.symbolCode").alias("symbol"), F.get_json_object("prediction", "$.confidence").try_cast("double").alias("confidence")),
    "prj_coalesce_resolved": lambda s, d: boards(s, d).groupBy("source_image_id").agg(F.min("sequence_number").alias("lowest")).join(boards(s, d), "source_image_id").select("id", F.coalesce("sequence_number", "lowest").alias("resolved")).distinct(),
    "prj_quality_score": lambda s, d: boards(s, d).join(images(s, d).groupBy(F.col("id").alias("source_image_id")).agg(F.max(F.col("width") * F.col("height")).alias("area")), "source_image_id").select("id", F.bround(F.col("board_confidence") * 0.45 + F.col("sequence_confidence") * 0.35 + F.least(F.col("area") / 2073600, F.lit(1.0)) * 0.20, 6).alias("score")).select("id", F.round(F.col("score"), 4).alias("score")).distinct(),
}


def optional(df, **equal):
    """Rows that equal every value that is given; a value of None asks for nothing."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


SQL = {
    "win_lag_gap": f"WITH {BOARDS}, n AS (SELECT DISTINCT sequence_number AS n FROM rb WHERE sequence_number >= 1) SELECT p + 1 AS gap_from, n - 1 AS gap_to FROM (SELECT n, lag(n, 1, 0) OVER (ORDER BY n) AS p FROM n) WHERE p + 1 < n",
    "win_lag_gap_tail": f"WITH {BOARDS} SELECT i AS missing FROM range(1, (SELECT count(*) + 1 FROM orders)) r(i) WHERE i NOT IN (SELECT sequence_number FROM rb WHERE sequence_number IS NOT NULL) ORDER BY i LIMIT 100",
    "win_rownum_lines": f"WITH {BOARDS} SELECT * FROM (SELECT sequence_number, id, row_number() OVER (PARTITION BY sequence_number ORDER BY id) AS rank FROM rb WHERE sequence_number IN (SELECT sequence_number FROM rb GROUP BY 1 HAVING count(*) > 1)) WHERE rank <= 3",
    "win_rownum_sig": f"WITH {LAYOUTS} SELECT * FROM (SELECT signature, sequence_number, row_number() OVER (PARTITION BY signature ORDER BY sequence_number) AS rank FROM boards WHERE signature IN (SELECT signature FROM boards GROUP BY 1 HAVING count(*) > 1)) WHERE rank <= 3",
    "win_running_sum": f"WITH {PAYOUTS} SELECT sequence_number, payout, (sum(payout) OVER (ORDER BY sequence_number))::bigint AS total FROM payouts",
    "win_local_peak": "WITH e AS (SELECT user_id, event_id, round(value * 100)::bigint AS v FROM events), f AS (SELECT *, (sum(v - 5000) OVER (PARTITION BY user_id ORDER BY event_id))::bigint AS net, sign(v - 5000) AS turn FROM e), g AS (SELECT *, lead(turn) OVER (PARTITION BY user_id ORDER BY event_id) AS following FROM f WHERE turn <> 0) SELECT user_id, event_id, net FROM g WHERE turn = 1 AND coalesce(following, -1) = -1 AND net > 0",
    "win_continuity": f"WITH {BOARDS}, p AS (SELECT *, lag(sequence_number) OVER (PARTITION BY source_image_id ORDER BY position_index NULLS FIRST, id) AS p FROM rb) SELECT source_image_id, position_index, id, sequence_number, CASE WHEN sequence_number IS NULL THEN 'missing' WHEN p IS NULL THEN 'none' WHEN sequence_number = p THEN 'duplicate' WHEN sequence_number = p + 1 THEN 'none' WHEN sequence_number > p + 1 THEN 'gap' ELSE 'conflict' END AS verdict FROM p",
    "win_rule_monotonic": "SELECT o_custkey, o_orderkey FROM (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) WHERE o_totalprice <= b",
    "win_rank_source": f"WITH {BOARDS}, {IMAGES}, a AS (SELECT id AS source_image_id, max(width * height) AS area FROM si GROUP BY 1) SELECT sequence_number, id, row_number() OVER (PARTITION BY sequence_number ORDER BY board_confidence DESC NULLS LAST, sequence_confidence DESC NULLS LAST, area DESC, id) AS rank FROM rb JOIN a USING (source_image_id) WHERE sequence_number IS NOT NULL",
    "win_latest_event": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "win_topk_bounded": "SELECT * FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3",
    "win_dup_range": f"WITH {LAYOUTS} SELECT * FROM (SELECT sequence_number, substr(signature, 1, 6) AS range, min(sequence_number) OVER (PARTITION BY substr(signature, 1, 6)) AS duplicate_of FROM boards) WHERE duplicate_of < sequence_number",
    "sort_multi_key": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_suppkey, l_partkey, l_orderkey, l_linenumber) AS rank FROM lineitem",
    "sort_desc_mixed": "SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey) AS rank FROM orders",
    "sort_natural": "SELECT *, row_number() OVER (ORDER BY key, file_id) AS rank FROM (SELECT file_id, array_to_string(list_transform(regexp_extract_all(lower(crop_relative_path), '([0-9]+|[^0-9]+)'), lambda p: CASE WHEN p ~ '^[0-9].*' THEN lpad(ltrim(p, '0'), 12, '0') ELSE p END), '') AS key FROM crop_files WHERE crop_relative_path IS NOT NULL)",
    "topk_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "page_keyset": "SELECT o_orderkey, o_custkey, (SELECT count(*) > 25 FROM orders WHERE o_orderkey > 1000) AS has_more FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 25",
    "page_bidirectional": "SELECT o_orderkey, o_totalprice, (SELECT count(*) > 25 FROM orders WHERE o_totalprice > 300000 OR (o_totalprice = 300000 AND o_orderkey < 0)) AS has_more FROM orders WHERE o_totalprice > 300000 OR (o_totalprice = 300000 AND o_orderkey < 0) ORDER BY o_totalprice, o_orderkey DESC LIMIT 25",
    "page_desc_float_cursor": "SELECT o_orderkey, o_totalprice, (SELECT count(*) > 25 FROM orders WHERE o_totalprice < 300000 OR (o_totalprice = 300000 AND o_orderkey > 0)) AS has_more FROM orders WHERE o_totalprice < 300000 OR (o_totalprice = 300000 AND o_orderkey > 0) ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "page_cursor_codec": """SELECT o_orderkey, rtrim(translate(to_base64(encode('{"scope":"orders","after":' || o_orderkey || '}')), '+/', '-_'), '=') AS cursor, o_orderkey AS after FROM orders""",
    "sample_bounded": "SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT l_partkey))[1:100], ',') AS sample, count(DISTINCT l_partkey) > 100 AS truncated FROM lineitem GROUP BY 1",
    "set_union_all_cyclic": f"WITH {PAYOUTS} SELECT 0 AS segment, sequence_number, payout FROM payouts WHERE sequence_number > 777 UNION ALL SELECT 1, sequence_number, payout FROM payouts WHERE sequence_number < 777",
    "set_distinct": f"WITH {BOARDS} SELECT DISTINCT sequence_number FROM rb",
    "set_group_distinct_limit2": f"WITH {LAYOUTS} SELECT signature FROM boards WHERE starts_with(signature, '0102') GROUP BY 1 ORDER BY 1 LIMIT 2",
    "set_difference_py": "SELECT observation_id FROM symbol_crop_samples WHERE observation_id IS NOT NULL EXCEPT SELECT id FROM cell_observations",
    "flt_range_between": f"WITH {BOARDS} SELECT sequence_number BETWEEN 1 AND {N_BOARDS} AS inside, count(*) AS n FROM rb WHERE sequence_number IS NOT NULL GROUP BY 1",
    "flt_prefix_range": f"WITH {LAYOUTS} SELECT sequence_number, signature FROM boards WHERE signature >= '0305' AND signature < '0305:'",
    "flt_equality": "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 77",
    "flt_in_list": "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1",
    "flt_null_variant": "SELECT error_code IS NULL AS fine, processed_at IS NULL AS open, count(*) AS n FROM source_images GROUP BY 1, 2",
    "flt_optional_conjuncts": "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'",
    "flt_lexicographic": "SELECT count(*) AS n FROM lineitem WHERE (l_suppkey, l_partkey, l_orderkey, l_linenumber) > (50, 1000, 7000, 2)",
    "prj_case_stage": f"WITH {BOARDS} SELECT id, CASE WHEN sequence_number IS NULL THEN 'unnumbered' WHEN sequence_confidence < 0.8 THEN 'doubtful' WHEN board_confidence >= 0.9 THEN 'sure' ELSE coalesce(status, 'none') END AS stage FROM rb",
    "prj_json_extract": "SELECT id, prediction->>'$.symbolCode' AS symbol, (prediction->>'$.confidence')::double AS confidence FROM (SELECT DISTINCT id, prediction FROM cell_observations)",
    "prj_coalesce_resolved": f"WITH {BOARDS}, m AS (SELECT source_image_id, min(sequence_number) AS lowest FROM rb GROUP BY 1) SELECT DISTINCT id, coalesce(sequence_number, lowest) AS resolved FROM rb JOIN m USING (source_image_id)",
    "prj_quality_score": f"WITH {BOARDS}, {IMAGES}, a AS (SELECT id AS source_image_id, max(width * height) AS area FROM si GROUP BY 1) SELECT DISTINCT id, round(round(board_confidence * 0.45 + sequence_confidence * 0.35 + least(area / 2073600, 1.0) * 0.20, 6), 4) AS score FROM rb JOIN a USING (source_image_id)",
}
