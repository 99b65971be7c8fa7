"""Queries of matching against expectations, deletes, references, codes and stages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import measures as M
from gridloom.functions.canonical import code_base, job_key, median_hash, proper_name
from gridloom.operators import geometry as G
from gridloom.operators import integrity as I
from gridloom.operators import relational as R
from gridloom.operators.boards import evaluate_payouts
from gridloom.operators.images import measure_pictures
from gridloom.plans.common import GAME, LAYOUTS, PAYOUTS, layouts
from gridloom.plans.evaluation import CELLS, cells
from gridloom.plans.windows import BOARDS, IMAGES, boards, images
from gridloom.runtime import new_path, table
from gridloom.sources import sinks

# The stages of a file in their order, and the seconds a board takes by what must be done on it.
STAGES = ["discovery", "normalization", "board_detection", "board_crops", "sequence_ocr", "symbol_inference", "manual_review", "validation"]
CLEAN, SYMBOL, GEOMETRY = 8.0, 25.0, 90.0
COUNTED = [
    "source_images", "recognized_boards", "cell_observations", "symbol_crop_samples", "board_candidates", "layout_import_lines", "import_report_lines", "crop_files",
    "documents", "orders", "lineitem", "customer", "part",
]


# --- detected against expected ----------------------------------------------------------------------------------


def _golden(s, d):
    """The boards of every page in their places of an even grid, which is where they are expected."""
    pages = images(s, d).groupBy(F.col("id").alias("image")).agg(F.max("width").alias("w"), F.max("height").alias("h")).where("w > 0 and h > 0")
    g = boards(s, d).where("position_index between 0 and 8").select(F.col("source_image_id").alias("image"), F.col("position_index").alias("position")).distinct().join(pages, "image")
    return g.select("image", "position", G.grid_quad(F.col("position"), F.col("w"), F.col("h")).alias("quad"), F.hypot(F.col("w").cast("double"), F.col("h").cast("double")).alias("diagonal"))


def _detected(s, d):
    c = table(s, d, "board_candidates").where("board_position between 0 and 8")
    return c.select(F.col("image_id").alias("image"), F.col("board_position").alias("position"), F.col("observation_id").alias("id"), F.col("detected_source_quad").alias("quad"))


def _golden_quality(s, d):
    """Corner errors of the boards by corner; boards that are not detected exactly once are counted by status."""
    e = G.golden_join(_golden(s, d), _detected(s, d)).select("status", F.posexplode_outer("errors").alias("corner", "error"))
    return e.groupBy("status", "corner").agg(F.count("*").alias("n"), F.round(F.avg("error"), 2).alias("mean_error"), F.max("error").alias("most"))


def _line_quality(s, d):
    """Errors of the inner lines of matched boards by axis and line."""
    found = _detected(s, d).where(F.size("quad") == 4).groupBy("image", "position").agg(F.min_by("quad", "id").alias("actual"), F.count_distinct("id").alias("k")).where("k = 1")
    m = _golden(s, d).join(found, ["image", "position"]).select("image", "position", F.col("quad").alias("expected"), "actual")
    return G.line_errors(m).groupBy("axis", "line").agg(F.count("*").alias("n"), F.round(F.avg("error"), 3).alias("mean_error"), F.max("error").alias("most"))


# --- lookups and sources ----------------------------------------------------------------------------------------


def _alias(s, d):
    c = cells(s, d)
    candidates = c.where("predicted is not null").select(F.md5("predicted").alias("candidate_id"), "predicted").distinct()
    pairs = c.where("actual is not null and predicted is not null").groupBy("actual", "predicted").agg(F.count("*").alias("n")).where("n >= 3")
    resolution = pairs.groupBy(F.col("actual").alias("code")).agg(F.array_sort(F.collect_set(F.md5("predicted"))).alias("candidate_ids"))
    symbols = c.where("actual is not null").select(F.col("actual").alias("code")).unionByName(c.where("predicted is not null").select(F.col("predicted").alias("code")))
    return R.prediction_alias(symbols, resolution, candidates)


def _selection(s, d):
    """The best board of every number; every seventh number was set by hand to its first board, and for every
    fourteenth that was taken back."""
    b = boards(s, d).where("sequence_number is not null").select("sequence_number", "id", "board_confidence", "sequence_confidence")
    first = b.where("sequence_number % 7 = 0").groupBy("sequence_number").agg(F.min("id").alias("id"))
    events = first.select("sequence_number", F.lit(1).alias("revision"), "id").unionByName(first.where("sequence_number % 14 = 0").select("sequence_number", F.lit(2).alias("revision"), F.lit(None).cast("string").alias("id")))
    return R.select_sources(b, events, F.col("board_confidence"), F.col("sequence_confidence"), F.col("id"))


def _reopened(s, d):
    """Boards whose number occurs more than once are reopened, and their staging rows go; the others stay staged."""
    b = boards(s, d).where("sequence_number is not null").select("id", "sequence_number")
    twice = I.continuity_issues(b).where("kind = 'duplicate'").select(F.col("value").alias("sequence_number"))
    gone, kept = R.delete_returning(b, twice, "sequence_number")
    return gone.withColumn("action", F.lit("reopen")).unionByName(kept.withColumn("action", F.lit("stay")))


def _bootstrap(s, d):
    """Predicted codes as symbol candidates, numbered by how often they occur, with a representative cell; accepted
    without a look only where there are as many as the game has symbols."""
    k = cells(s, d).where("predicted is not null").groupBy("predicted").agg(
        F.count("*").alias("n"), F.count_distinct("recognized_board_id").alias("boards"), F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        F.min_by("id", F.struct(-F.coalesce("confidence", F.lit(-1.0)), "id")).alias("representative"),
    )
    total = k.agg((F.count("*") == len(GAME.symbols) + len(GAME.wildcards)).alias("accepted"))
    w = Window.orderBy(F.desc("n"), F.asc("predicted"))  # a row a code, of which a game has 32,767 at most
    return k.withColumn("code", F.row_number().over(w)).join(total)


# --- deletes and references -------------------------------------------------------------------------------------


def _cascade(s, d):
    """All that depends on the jobs whose id begins with 0 to 3."""
    tables = {
        "source_images": table(s, d, "source_images").select("id", "import_job_id"), "recognized_boards": table(s, d, "recognized_boards").select("id", "source_image_id"),
        "cell_observations": table(s, d, "cell_observations").select("id", "recognized_board_id"), "layout_import_lines": table(s, d, "layout_import_lines").select("job_id", "line_number"),
    }
    jobs = tables["source_images"].select(F.col("import_job_id").alias("key")).union(tables["layout_import_lines"].select("job_id")).where("key < '4'").distinct()
    links = [("source_images", "import_job_id", None, "id"), ("layout_import_lines", "job_id", None, "job_id"), ("recognized_boards", "source_image_id", "source_images", "id"), ("cell_observations", "recognized_board_id", "recognized_boards", "id")]
    return R.delete_cascade(tables, links, jobs)[1].drop("step")


def _cte_delete(s, d):
    """The orders of customers that never spent 200,000 at once are deleted, and then the customers that these returned."""
    o, c = table(s, d, "orders").select("o_orderkey", "o_custkey"), table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    cheap = table(s, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("most")).where("most < 200000")
    links, links_left = R.delete_returning(o, cheap, "o_custkey")
    gone, left = R.delete_returning(c, links, "o_custkey")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    one = lambda name, a, b: n(a, "deleted").join(n(b, "kept")).select(F.lit(name).alias("table"), "deleted", "kept")
    return one("orders", links, links_left).unionByName(one("customer", gone, left))


def _counts(s, d):
    out = None
    for name in COUNTED:
        one = table(s, d, name).agg(F.count("*").alias(name))
        out = one if out is None else out.join(one)  # a row each
    return out


def _references(s, d):
    """All paths that any table refers to, by kind of reference."""
    t = lambda name: table(s, d, name)
    jobs = t("source_images").select("import_job_id").distinct()
    refs = {
        "sample": t("symbol_crop_samples").select("crop_relative_path"), "sample_source": t("symbol_crop_samples").select("source_image_relative_path"), "cell": t("cell_observations").select("crop_relative_path"),
        "board": t("recognized_boards").select("board_relative_path"), "candidate": t("board_candidates").select("board_relative_path"), "candidate_source": t("board_candidates").select("source_image_relative_path"),
        "image": t("source_images").select("relative_path"), "file": t("crop_files").select("crop_relative_path"),
        "manifest": jobs.select(F.concat(F.lit("manifests/"), "import_job_id", F.lit(".json"))), "export": jobs.select(F.concat(F.lit("exports/"), "import_job_id")),
        "import": t("layout_import_lines").select("job_id", "file_format").distinct().select(F.concat(F.lit("imports/"), "job_id", F.lit("."), "file_format")),
        "report": t("import_report_lines").select("job_id").distinct().select(F.concat(F.lit("reports/"), "job_id")),
    }
    out = None
    for kind, df in refs.items():
        one = df.toDF("path").select(F.lit(kind).alias("kind"), "path")
        out = one if out is None else out.unionByName(one)
    return out.where("path is not null and path <> ''").groupBy("kind").agg(F.count("*").alias("refs"), F.count_distinct("path").alias("paths"))


def _cleanup(s, d):
    """What deleting a job would take: rows, paths, how many of these other jobs share, and a token of exactly this."""
    jobs = images(s, d).groupBy("id").agg(F.min("import_job_id").alias("job"))
    i = table(s, d, "source_images").select(F.col("import_job_id").alias("job"), F.lit("image").alias("kind"), F.col("relative_path").alias("path"))
    b = table(s, d, "recognized_boards").join(jobs, F.col("source_image_id") == jobs["id"]).select("job", F.lit("board").alias("kind"), F.col("board_relative_path").alias("path"))
    c = table(s, d, "cell_observations").select(F.col("import_job_id").alias("job"), F.lit("cell").alias("kind"), F.col("crop_relative_path").alias("path"))
    refs = i.unionByName(b).unionByName(c).where("job is not null")
    rows = refs.groupBy("job").agg(F.count("*").alias("rows"))
    owners = refs.where("path is not null").groupBy("path").agg(F.min("job").alias("a"), F.max("job").alias("b"))
    held = refs.where("path is not null").select("job", "path").distinct().join(owners, "path").groupBy("job").agg(F.count("*").alias("paths"), F.count_if(F.col("a") != F.col("b")).alias("shared"))
    j = rows.join(held, "job", "left").select("job", "rows", F.coalesce("paths", F.lit(0)).alias("paths"), F.coalesce("shared", F.lit(0)).alias("shared"))
    return j.withColumn("token", F.sha2(F.concat_ws("|", "job", *[F.col(x).cast("string") for x in ("rows", "paths", "shared")]), 256))


# --- sinks ------------------------------------------------------------------------------------------------------


def _normalized(s, d):
    """Rows checked against a game of ten symbols, and a third of them again when it has eleven."""
    n = F.col("sequence_number")
    cells_ = F.when(n % 83 == 0, F.slice("cells", 1, 14)).when(n % 79 == 0, F.concat(F.slice("cells", 1, 14), F.array(F.lit(12)))).otherwise(F.col("cells"))
    raw = layouts(s, d).select(n.alias("line_number"), cells_.alias("cells"), F.lit(None).cast("string").alias("error_code"))
    checked = lambda rows, k: I.normalize_rows(rows, 15, list(range(1, k + 1)), 2).select("line_number", "error_code", "signature")
    folder = new_path(s, "normalized")
    sinks.publish(checked(raw, 10), folder, 1, sort_by=["line_number"])
    sinks.upsert_version(s, folder, 1, checked(raw.where("line_number % 3 = 0"), 11), ["line_number"])
    return sinks.open_version(s, folder, 2)


def _feedback(s, d):
    """Boards with their cells as one row a cell, labelled by the board's reading. The export is known by the state of its
    source, so asking for it twice writes it once."""
    b = table(s, d, "recognized_boards").groupBy("id").agg(F.max("cells_prediction").alias("codes"))
    state = b.agg(M.set_digest(F.concat_ws("|", "id", "codes"))).first()[0]
    codes = F.from_json("codes", "array<string>")
    rows = b.select("id", F.posexplode(F.arrays_zip(F.sequence(F.lit(0), F.size(codes) - 1).alias("cell"), codes.alias("code"))).alias("p", "z")).select("id", F.col("z.cell").alias("cell"), F.col("z.code").alias("code"))
    folder = new_path(s, "feedback")
    first, again = (sinks.export_once(rows, folder, state) for _ in range(2))
    if not (first and not again):
        raise RuntimeError("an export of one state was written twice")
    return sinks.open_export(s, folder, state)


# --- metrics ----------------------------------------------------------------------------------------------------


def _top3(s, d):
    """The three likeliest classes of every vector, read as logits; of equally likely ones the smaller."""
    p = M.softmax(F.transform("embedding", lambda x: x.cast("double")), 0.5)
    e = table(s, d, "embeddings").select("vec_id", F.transform(p, lambda x, i: F.struct((-x).alias("p"), i.alias("i"))).alias("x"))
    return e.select("vec_id", F.concat_ws(",", F.transform(F.slice(F.array_sort("x"), 1, 3), lambda x: x["i"].cast("string"))).alias("top3"))


def _projection(s, d):
    """Boards an hour, as the kinds of boards and their seconds give it."""
    b = boards(s, d).agg((F.count_if(F.col("status") == "corrected") / F.count("*")).alias("symbol"), (F.count_if(F.col("sequence_number").isNull()) / F.count("*")).alias("geometry"))
    seconds = F.greatest(F.lit(0.0), 1 - F.col("symbol") - F.col("geometry")) * CLEAN + F.col("symbol") * SYMBOL + F.col("geometry") * GEOMETRY
    return b.select(F.round(seconds, 4).alias("seconds"), F.round(3600 / seconds, 2).alias("per_hour"), F.round(1000 * seconds / 3600, 3).alias("hours_for_1000"))


def _ocr(s, d):
    """Readings of numbers: without any reason to look again, in conflict with the board before, and to be reviewed."""
    w = Window.partitionBy("source_image_id").orderBy("position_index", "id")
    p, n = F.lag("sequence_number").over(w), F.col("sequence_number")
    verdict = F.when(n == p, "DUPLICATE").when(n > p + 1, "GAP").when(n < p, "CONFLICT")
    reasons = F.array_compact(F.array(F.concat(F.lit("OCR_CONTINUITY_"), verdict), F.when(n.isNull(), F.lit("OCR_MISSING")), F.when(F.col("sequence_confidence") < 0.8, F.lit("OCR_CONFIDENCE_LOW"))))
    r = boards(s, d).withColumn("reasons", reasons)
    exact = F.count_if(F.size("reasons") == 0)
    return r.agg(F.count("*").alias("n"), exact.alias("exact"), F.round(exact / F.count("*"), 6).alias("rate"), F.count_if(F.exists("reasons", lambda x: x.startswith("OCR_CONTINUITY_"))).alias("conflicts"), F.count_if(F.size("reasons") > 0).alias("to_review"))


# --- stages and keys --------------------------------------------------------------------------------------------


def _stages(s, d):
    """What is done on every image, as the tables tell, and what comes next."""
    i, b, c = table(s, d, "source_images"), boards(s, d), table(s, d, "cell_observations")
    cells_ = b.select("id", F.col("source_image_id").alias("file")).join(c.select(F.col("recognized_board_id").alias("id"), F.get_json_object("prediction", "$.symbolCode").alias("code")), "id")
    at = lambda df, stage: df.select("file", F.lit(stage).alias("stage"))
    i, b = i.withColumn("file", F.col("id")), b.withColumn("file", F.col("source_image_id"))
    known = i.select("file").distinct()
    steps = [
        at(i, "discovery"), at(i.where("width > 0"), "normalization"), at(b, "board_detection"), at(cells_, "board_crops"), at(b.where("sequence_number is not null"), "sequence_ocr"),
        at(cells_.where("code is not null"), "symbol_inference"), at(b.where("status in ('accepted', 'corrected')"), "manual_review"), at(i.where("processed_at is not null"), "validation"),
    ]
    done = steps[0]
    for x in steps[1:]:
        done = done.unionByName(x)
    return R.next_stage(done.join(known, "file", "left_semi"), STAGES)


def _job_keys(s, d):
    """Import requests, some of them sent again, by the key of their job."""
    r = table(s, d, "layout_import_lines").where("line_number <= 3").select("job_id", "file_format", "line_number")
    payload = {"schema_version": F.lit(1), "import_kind": F.lit("layout_file"), "source_checksum": F.sha2("job_id", 256), "file_format": F.col("file_format"), "contract_version": F.lit(1)}
    return r.groupBy(job_key(F.lit("import"), F.lit(None).cast("string"), payload).alias("job_key")).agg(F.count("*").alias("requests"))


# --- functions --------------------------------------------------------------------------------------------------


def _slugs(s, d):
    """Codes from the first word of part types, made unique by a number, and names from these."""
    t = table(s, d, "part").select("p_type").distinct()
    base = code_base(F.element_at(F.split("p_type", " "), 1), F.lit(1))
    k = F.row_number().over(Window.partitionBy("base").orderBy("p_type"))  # of codes, of which a game has few
    t = t.withColumn("base", base).withColumn("k", k)
    return t.select("p_type", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("k").cast("string"))).alias("code"), proper_name(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("name"))


def _jokers(s, d):
    """For every match the wildcards in it: where they are, and for which symbol they stand."""
    m = evaluate_payouts(layouts(s, d), GAME).select("sequence_number", "cells", F.explode("matches").alias("m"))
    paths = F.create_map(*[x for name, path in GAME.paylines.items() for x in (F.lit(name), F.array(*map(F.lit, path)))])
    places = F.transform(F.slice(F.element_at(paths, F.col("m.payline")), 1, F.col("m.length")), lambda r, i: r * GAME.columns + i)
    wild = F.filter(places, lambda i: F.get("cells", i).isin(*GAME.wildcards))
    return m.select("sequence_number", F.col("m.payline").alias("payline"), F.col("m.symbol").alias("symbol"), F.explode(wild).alias("cell"))


def _rule_map(s, d):
    """The payout rules of every symbol as one map from length to credits."""
    rows = s.createDataFrame([(a, n, v) for (a, n), v in GAME.payouts.items()], "symbol int, length int, credits int")
    m = rows.groupBy("symbol").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("length", "credits")))).alias("m"))
    return m.select("symbol", F.size("m").alias("lengths"), F.element_at("m", 5).alias("longest"), F.to_json("m").alias("json"))


def _hashes(s, d):
    """The median hash of a made-up picture for every part."""
    k = F.col("p_partkey")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: (k * 31 + i * i * 7919 + i * k) % 251)
    return table(s, d, "part").select("p_partkey", median_hash(pixels).alias("hash"))


def _pictures(s, d):
    """Measures of a made-up picture of 16 x 16 pixels for every supplier."""
    rgb = F.unhex(F.concat(*[F.sha2(F.concat_ws("/", F.col("s_suppkey").cast("string"), F.lit(str(i))), 256) for i in range(24)]))
    return measure_pictures(table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(16).alias("width"), F.lit(16).alias("height"), rgb.alias("rgb")))


QUERIES = {
    "join_golden_quality": _golden_quality,
    "join_golden_lines": _line_quality,
    "agg_geometry_quality": lambda s, d: G.geometry_quality(_golden(s, d), _detected(s, d)),
    "join_prediction_alias": _alias,
    "dom_source_selection": _selection,
    "dom_reopen_conflicts": _reopened,
    "dom_symbol_bootstrap": _bootstrap,
    "dom_cleanup_preview": _cleanup,
    "snk_delete_cascade": _cascade,
    "set_cte_dml": _cte_delete,
    "agg_scalar_subqueries": _counts,
    "set_union_all_refs": _references,
    "snk_upsert_normalized": _normalized,
    "snk_feedback_export": _feedback,
    "agg_top3_alternatives": _top3,
    "agg_weighted_projection": _projection,
    "agg_ocr_summary": _ocr,
    "stm_file_stage_machine": _stages,
    "stm_idempotent_job_key": _job_keys,
    "flt_json_contains": lambda s, d: table(s, d, "recognized_boards").where(F.array_contains(F.from_json("cells_prediction", "array<string>"), "ROPE")).select("id").distinct(),
    "flt_natural_reject": lambda s, d: table(s, d, "lineitem").where("l_partkey = 77").limit(1).agg((F.count("*") > 0).alias("referenced")),
    "fn_slug": _slugs,
    "fn_jokers": _jokers,
    "fn_rule_map": _rule_map,
    "fn_median_hash": _hashes,
    "fn_image_quality": _pictures,
}

_GOLDEN = f"""{BOARDS}, {IMAGES},
g AS (SELECT DISTINCT b.source_image_id AS image, b.position_index AS p, i.w, i.h FROM rb b JOIN (SELECT id, max(width) AS w, max(height) AS h FROM si GROUP BY 1) i ON i.id = b.source_image_id
      WHERE b.position_index BETWEEN 0 AND 8 AND i.w > 0 AND i.h > 0),
t AS (SELECT image_id AS image, board_position AS p, count(DISTINCT observation_id) AS k, arg_min(detected_source_quad, observation_id) AS q FROM board_candidates
      WHERE board_position BETWEEN 0 AND 8 AND len(detected_source_quad) = 4 GROUP BY 1, 2),
j AS (SELECT g.*, coalesce(t.k, 0) AS k, t.q FROM g LEFT JOIN t ON g.image = t.image AND g.p = t.p),
e AS (SELECT image, p, w, h, c.c AS corner, round(sqrt(power((p % 3 + [0, 1, 1, 0][c.c + 1]) * w / 3.0::double - q[c.c + 1].x, 2) + power((p // 3 + [0, 0, 1, 1][c.c + 1]) * h / 3.0::double - q[c.c + 1].y, 2)), 4) AS err
      FROM j, range(0, 4) c(c) WHERE k = 1)"""
_REFS = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, {path} AS path FROM {source}"
    for kind, path, source in (
        ("sample", "crop_relative_path", "symbol_crop_samples"), ("sample_source", "source_image_relative_path", "symbol_crop_samples"), ("cell", "crop_relative_path", "cell_observations"),
        ("board", "board_relative_path", "recognized_boards"), ("candidate", "board_relative_path", "board_candidates"), ("candidate_source", "source_image_relative_path", "board_candidates"),
        ("image", "relative_path", "source_images"), ("file", "crop_relative_path", "crop_files"), ("manifest", "'manifests/' || j || '.json'", "jobs"), ("export", "'exports/' || j", "jobs"),
        ("import", "'imports/' || job_id || '.' || file_format", "(SELECT DISTINCT job_id, file_format FROM layout_import_lines)"), ("report", "'reports/' || job_id", "(SELECT DISTINCT job_id FROM import_report_lines)"),
    )
)
_CASE = "CASE WHEN {n} % 83 = 0 THEN cells[1:14] WHEN {n} % 79 = 0 THEN list_append(cells[1:14], 12) ELSE cells END"

SQL = {
    "join_golden_quality": f"""WITH {_GOLDEN}
SELECT 'matched' AS status, corner::int AS corner, count(*) AS n, round(avg(err), 2) AS mean_error, max(err) AS most FROM e GROUP BY 2
UNION ALL SELECT CASE WHEN k = 0 THEN 'missing' ELSE 'duplicated' END, NULL, count(*), NULL, NULL FROM j WHERE k <> 1 GROUP BY 1""",
    "agg_geometry_quality": f"""WITH {_GOLDEN}, d AS (SELECT DISTINCT image_id AS image, board_position AS p FROM board_candidates WHERE board_position BETWEEN 0 AND 8),
extra AS (SELECT image, count(*) AS n FROM d WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.image = d.image AND g.p = d.p) GROUP BY 1),
per AS (SELECT j.image, count(*) AS n, count(*) FILTER (k >= 1) AS found, any_value(extra.n) AS x, bool_or(a.image IS NOT NULL) AS seen FROM j LEFT JOIN extra ON extra.image = j.image LEFT JOIN (SELECT DISTINCT image FROM d) a ON a.image = j.image GROUP BY 1),
errs AS (SELECT round(err / sqrt(w * w + h * h), 6) AS x FROM e UNION ALL SELECT 1.0 FROM j, range(0, 4) WHERE k <> 1)
SELECT count(*) AS images, round(count(*) FILTER (seen) / count(*), 6) AS detected_share, round(count(*) FILTER (n = found AND x IS NULL) / count(*), 6) AS expected_share, round(sum(found) / sum(n), 6) AS position_accuracy,
 (SELECT quantile_disc(x, 0.95) FROM errs) AS p95 FROM per""",
    "join_prediction_alias": f"""WITH {CELLS}, sym AS (SELECT actual AS code FROM cells WHERE actual IS NOT NULL UNION SELECT predicted FROM cells WHERE predicted IS NOT NULL),
res AS (SELECT actual AS code, predicted FROM cells WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3) SELECT sym.code, coalesce(res.predicted, sym.code) AS alias FROM sym LEFT JOIN res ON sym.code = res.code""",
    "dom_source_selection": f"""WITH {BOARDS}, best AS (SELECT sequence_number, id FROM (SELECT *, row_number() OVER (PARTITION BY sequence_number ORDER BY board_confidence DESC NULLS LAST, sequence_confidence DESC NULLS LAST, id DESC) AS k FROM rb WHERE sequence_number IS NOT NULL) WHERE k = 1),
low AS (SELECT sequence_number, min(id) AS id FROM rb WHERE sequence_number % 7 = 0 AND sequence_number % 14 <> 0 GROUP BY 1)
SELECT best.sequence_number, coalesce(low.id, best.id) AS id, low.id IS NOT NULL AS manual FROM best LEFT JOIN low USING (sequence_number)""",
    "dom_reopen_conflicts": f"WITH {BOARDS} SELECT id, sequence_number, CASE WHEN count(*) OVER (PARTITION BY sequence_number) > 1 THEN 'reopen' ELSE 'stay' END AS action FROM rb WHERE sequence_number IS NOT NULL",
    "dom_symbol_bootstrap": f"""WITH {CELLS}, k AS (SELECT predicted, count(*) AS n, count(DISTINCT recognized_board_id) AS boards, round(avg(confidence), 6) AS mean_confidence, first(id ORDER BY -coalesce(confidence, -1), id) AS representative FROM cells WHERE predicted IS NOT NULL GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY n DESC, predicted) AS code, (SELECT count(*) = 11 FROM k) AS accepted FROM k""",
    "dom_cleanup_preview": f"""WITH {IMAGES}, jobs AS (SELECT id, min(import_job_id) AS job FROM si GROUP BY 1),
refs AS (SELECT import_job_id AS job, relative_path AS path FROM source_images UNION ALL SELECT job, board_relative_path FROM recognized_boards b JOIN jobs ON jobs.id = b.source_image_id UNION ALL SELECT import_job_id, crop_relative_path FROM cell_observations),
own AS (SELECT path, min(job) <> max(job) AS shared FROM refs WHERE path IS NOT NULL AND job IS NOT NULL GROUP BY 1),
h AS (SELECT job, count(*) AS paths, count(*) FILTER (shared) AS shared FROM (SELECT DISTINCT job, path FROM refs WHERE path IS NOT NULL AND job IS NOT NULL) JOIN own USING (path) GROUP BY 1),
r AS (SELECT job, count(*) AS rows FROM refs WHERE job IS NOT NULL GROUP BY 1), x AS (SELECT job, rows, coalesce(paths, 0) AS paths, coalesce(shared, 0) AS shared FROM r LEFT JOIN h USING (job))
SELECT *, sha256(concat_ws('|', job, rows::varchar, paths::varchar, shared::varchar)) AS token FROM x""",
    "snk_delete_cascade": """WITH i AS (SELECT id, coalesce(import_job_id < '4', false) AS gone FROM source_images), b AS (SELECT id, source_image_id IN (SELECT id FROM i WHERE gone) AS gone FROM recognized_boards),
c AS (SELECT recognized_board_id IN (SELECT id FROM b WHERE gone) AS gone FROM cell_observations), l AS (SELECT coalesce(job_id < '4', false) AS gone FROM layout_import_lines),
x AS (SELECT 'source_images' AS t, gone FROM i UNION ALL SELECT 'recognized_boards', gone FROM b UNION ALL SELECT 'cell_observations', gone FROM c UNION ALL SELECT 'layout_import_lines', gone FROM l)
SELECT t AS table, count(*) FILTER (gone) AS deleted, count(*) FILTER (NOT coalesce(gone, false)) AS kept FROM x GROUP BY 1""",
    "set_cte_dml": """WITH gone AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING max(o_totalprice) < 200000)
SELECT 'orders' AS table, count(*) FILTER (o_custkey IN (SELECT o_custkey FROM gone)) AS deleted, count(*) FILTER (o_custkey NOT IN (SELECT o_custkey FROM gone)) AS kept FROM orders
UNION ALL SELECT 'customer', count(*) FILTER (c_custkey IN (SELECT o_custkey FROM gone)), count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM gone)) FROM customer""",
    "agg_scalar_subqueries": "SELECT " + ", ".join(f"(SELECT count(*) FROM {t}) AS {t}" for t in COUNTED),
    "set_union_all_refs": f"WITH jobs AS (SELECT DISTINCT import_job_id AS j FROM source_images), r AS ({_REFS}) SELECT kind, count(*) AS refs, count(DISTINCT path) AS paths FROM r WHERE path <> '' GROUP BY 1",
    "snk_upsert_normalized": f"""WITH {LAYOUTS}, x AS (SELECT sequence_number AS line_number, {_CASE.format(n='sequence_number')} AS c, CASE WHEN sequence_number % 3 = 0 THEN 11 ELSE 10 END AS most FROM boards),
y AS (SELECT line_number, c, CASE WHEN len(c) <> 15 THEN 'import_cell_count_mismatch' WHEN list_max(c) > most THEN 'import_symbol_not_in_rules' END AS error_code FROM x)
SELECT line_number, error_code, CASE WHEN error_code IS NULL THEN array_to_string(list_transform(c, lambda v: lpad(v::varchar, 2, '0')), '') END AS signature FROM y""",
    "snk_feedback_export": "WITH b AS (SELECT id, max(cells_prediction)::json AS c FROM recognized_boards GROUP BY 1) SELECT id, i::int AS cell, c->>i::int AS code FROM b, range(0, 15) r(i) WHERE i < json_array_length(c)",
    "agg_top3_alternatives": "SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(embedding, lambda x, i: {'p': -x::double, 'i': i - 1}))[1:3], lambda e: e.i), ',') AS top3 FROM embeddings",
    "agg_weighted_projection": f"""WITH {BOARDS}, r AS (SELECT count(*) FILTER (status = 'corrected') / count(*) AS s, count(*) FILTER (sequence_number IS NULL) / count(*) AS g FROM rb),
w AS (SELECT greatest(0, 1 - s - g) * 8 + s * 25 + g * 90 AS w FROM r) SELECT round(w, 4) AS seconds, round(3600 / w, 2) AS per_hour, round(1000 * w / 3600, 3) AS hours_for_1000 FROM w""",
    "agg_ocr_summary": f"""WITH {BOARDS}, p AS (SELECT *, lag(sequence_number) OVER (PARTITION BY source_image_id ORDER BY position_index NULLS FIRST, id) AS p FROM rb),
v AS (SELECT coalesce(sequence_number = p OR sequence_number > p + 1 OR sequence_number < p, false) AS conflict, sequence_number IS NULL OR coalesce(sequence_confidence < 0.8, false) AS other FROM p)
SELECT count(*) AS n, count(*) FILTER (NOT conflict AND NOT other) AS exact, round(count(*) FILTER (NOT conflict AND NOT other) / count(*), 6) AS rate, count(*) FILTER (conflict) AS conflicts, count(*) FILTER (conflict OR other) AS to_review FROM v""",
    "stm_file_stage_machine": f"""WITH {BOARDS}, i AS (SELECT id AS file, bool_or(width > 0) AS s1, bool_or(processed_at IS NOT NULL) AS s7 FROM source_images GROUP BY 1),
b AS (SELECT source_image_id AS file, true AS s2, bool_or(sequence_number IS NOT NULL) AS s4, bool_or(status IN ('accepted', 'corrected')) AS s6 FROM rb GROUP BY 1),
c AS (SELECT rb.source_image_id AS file, true AS s3, bool_or(prediction->>'$.symbolCode' IS NOT NULL) AS s5 FROM cell_observations o JOIN rb ON rb.id = o.recognized_board_id GROUP BY 1),
x AS (SELECT i.file, list_transform([true, s1, s2, s3, s4, s5, s6, s7], lambda v: coalesce(v, false)) AS has FROM i LEFT JOIN b ON b.file = i.file LEFT JOIN c ON c.file = i.file),
y AS (SELECT file, has, coalesce(nullif(list_position(has, false), 0), 9)::int - 1 AS completed FROM x)
SELECT file, completed, [{', '.join(f"'{x}'" for x in STAGES)}][completed + 1] AS next_stage, (len(list_filter(has, lambda v: v)) - completed)::int AS out_of_order FROM y""",
    "stm_idempotent_job_key": """SELECT sha256('{"gameId":null,"inputPayload":{"contract_version":1,"file_format":"' || file_format || '","import_kind":"layout_file","schema_version":1,"source_checksum":"' || sha256(job_id) || '"},"jobType":"import"}') AS job_key, count(*) AS requests
FROM layout_import_lines WHERE line_number <= 3 GROUP BY 1""",
    "flt_json_contains": "SELECT DISTINCT id FROM recognized_boards WHERE list_contains(from_json(cells_prediction, '[\"VARCHAR\"]'), 'ROPE')",
    "flt_natural_reject": "SELECT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = 77) AS referenced",
    "fn_slug": """WITH t AS (SELECT DISTINCT p_type, string_split(p_type, ' ')[1] AS base FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_type) AS k FROM t)
SELECT p_type, CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS code, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS name FROM n""",
    "fn_jokers": f"""WITH {PAYOUTS} SELECT m.sequence_number, m.payline, m.symbol::int AS symbol, (p.path[c.c + 1] * 5 + c.c)::int AS cell FROM matches m JOIN paylines p ON p.payline = m.payline JOIN boards b ON b.sequence_number = m.sequence_number, range(0, 5) c(c)
WHERE c.c < m.length AND b.cells[p.path[c.c + 1] * 5 + c.c + 1] = 11""",
    "fn_rule_map": """WITH r AS (SELECT s::int AS symbol, n, s * ([1, 5, 20, 80])[n - 1] AS c FROM range(1, 11) a(s), range(2, 6) b(n) WHERE n >= CASE WHEN s <= 2 THEN 2 ELSE 3 END)
SELECT symbol, count(*)::int AS lengths, (max(c) FILTER (n = 5))::int AS longest, '{' || string_agg('"' || n || '":' || c, ',' ORDER BY n) || '}' AS json FROM r GROUP BY 1""",
    "fn_median_hash": """WITH p AS (SELECT p_partkey, list_transform(range(0, 256), lambda i: (p_partkey * 31 + i * i * 7919 + i * p_partkey) % 251) AS v FROM part), m AS (SELECT *, list_sort(v) AS o FROM p),
b AS (SELECT p_partkey, list_transform(v, lambda x: CASE WHEN 2 * x > o[128] + o[129] THEN 1 ELSE 0 END) AS b FROM m)
SELECT p_partkey, array_to_string(list_transform(range(0, 64), lambda j: substr('0123456789abcdef', (b[4 * j + 1] * 8 + b[4 * j + 2] * 4 + b[4 * j + 3] * 2 + b[4 * j + 4] + 1)::int, 1)), '') AS hash FROM b""",
    "fn_image_quality": """WITH h AS (SELECT s_suppkey AS id, array_to_string(list_transform(range(0, 24), lambda i: sha256(s_suppkey || '/' || i)), '') AS h FROM supplier),
b AS (SELECT id, list_transform(range(0, 768), lambda i: ('0x' || substr(h, (2 * i + 1)::int, 2))::int) AS b FROM h),
p AS (SELECT id, list_transform(range(0, 256), lambda i: (b[3 * i + 1] * 4899 + b[3 * i + 2] * 9617 + b[3 * i + 3] * 1868 + 8192) >> 14) AS g,
 list_transform(range(0, 256), lambda i: greatest(b[3 * i + 1], b[3 * i + 2], b[3 * i + 3])) AS v, list_transform(range(0, 256), lambda i: least(b[3 * i + 1], b[3 * i + 2], b[3 * i + 3])) AS w FROM b),
e AS (SELECT id, g, v, w, list_transform(range(0, 256), lambda i: g[CASE WHEN i < 16 THEN i + 17 ELSE i - 15 END] + g[CASE WHEN i >= 240 THEN i - 15 ELSE i + 17 END] + g[CASE WHEN i % 16 = 0 THEN i + 2 ELSE i END] + g[CASE WHEN i % 16 = 15 THEN i ELSE i + 2 END] - 4 * g[i + 1]) AS l, list_sort(g) AS o FROM p),
m AS (SELECT id, list_avg(list_transform(l, lambda x: x * x)) - power(list_avg(l), 2) AS s, greatest(0, 1 - abs(list_avg(g) - 127.5) / 127.5) AS x, greatest(0, 1 - len(list_filter(g, lambda y: y <= 4 OR y >= 251)) / 256 * 2.5) AS c,
 greatest(0, 1 - len(list_filter(range(1, 257), lambda i: v[i] >= 242 AND round_even(255.0 * (v[i] - w[i]) / v[i], 0) <= 45)) / 256 * 6) AS r, list_transform(g, lambda y: CASE WHEN 2 * y > o[128] + o[129] THEN 1 ELSE 0 END) AS t FROM e)
SELECT id, array_to_string(list_transform(range(0, 64), lambda j: substr('0123456789abcdef', (t[4 * j + 1] * 8 + t[4 * j + 2] * 4 + t[4 * j + 3] * 2 + t[4 * j + 4] + 1)::int, 1)), '') AS hash, round_even(s / (s + 500), 6) AS sharpness, round_even(x, 6) AS exposure,
 round_even(c, 6) AS highlight_retention, round_even(r, 6) AS glare_resistance, round_even(least(1, 0.4 * s / (s + 500) + 0.2 * x + 0.2 * c + 0.2 * r), 6) AS score FROM m""",
}
