"""Queries of the integrity reports, the scalar functions, and the remaining domain operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import measures as M
from gridloom.functions.signature import cell_width, cyclic_next, decode_signature, encode_prefix, encode_signature
from gridloom.operators import integrity as I
from gridloom.operators import relational as R
from gridloom.operators.bad_rows import load_layout_lines
from gridloom.operators.evaluation import fit_temperature
from gridloom.operators.selection import select_boards
from gridloom.plans.common import GAME, LAYOUTS, layouts, stored
from gridloom.plans.evaluation import CELLS, cells
from gridloom.plans.windows import BOARDS, boards
from gridloom.runtime import cut, table

ALLOWED = list(range(1, 12))


def _imported(s, d):
    """All import lines as staged rows, the bad ones with their code, checked against the game."""
    got = load_layout_lines(table(s, d, "layout_import_lines"))
    rows = got.valid.select("job_id", "line_number", "sequence_number", "cells", F.lit(None).cast("string").alias("error_code")).unionByName(got.bad.select("job_id", "line_number", F.col("code").alias("error_code")), allowMissingColumns=True)
    return cut(I.normalize_rows(rows, 15, ALLOWED, 2), "normalized")


def _damaged(s, d):
    """Layouts with known damage: some dropped, some repeated, some with a foreign code or a short board."""
    b = layouts(s, d)
    kept = b.where("sequence_number % 97 <> 0")
    twice = b.where("sequence_number % 89 = 0")
    cells_ = F.when(F.col("sequence_number") % 83 == 0, F.slice("cells", 1, 14)).when(F.col("sequence_number") % 79 == 0, F.concat(F.slice("cells", 1, 14), F.array(F.lit(12)))).otherwise(F.col("cells"))
    return stored(s, d, "damaged", lambda: kept.unionByName(twice).withColumn("cells", cells_))


def _dataset(s, d):
    n = table(s, d, "orders").count()
    return I.dataset_report(_damaged(s, d), n, n, 15, ALLOWED, 2)


def _signatures(s, d):
    b = layouts(s, d).select("sequence_number", "cells", "signature")
    back = decode_signature(F.col("signature"), 2, 15)
    part = F.transform("cells", lambda c, i: F.when(i < F.pmod("sequence_number", F.lit(15)), c))
    return b.select("sequence_number", "signature", (back == F.col("cells")).alias("round_trip"), encode_prefix(part, 2).alias("prefix"), encode_signature(F.transform("cells", lambda c: c * 10), 2).alias("too_wide"),
                    F.lit(cell_width(11)).alias("width"), decode_signature(F.concat(F.lit("00"), F.substring("signature", 3, 28)), 2).isNull().alias("zero_refused"))


def _vectors(s, d):
    """Vector measures of every embedding against the one with id 0, after a softmax of both."""
    e = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    z = e.where("vec_id = 0").select(F.col("v").alias("z"))
    j = e.join(z).withColumn("p", M.softmax(F.col("v"), 0.5)).withColumn("q", M.softmax(F.col("z"), 0.5))
    r = lambda c: F.round(c, 6)
    return j.select("vec_id", r(M.cosine(F.col("v"), F.col("z"))).alias("cosine"), r(M.mean_abs_difference(F.col("v"), F.col("z"))).alias("mean_abs"), r(M.entropy(F.col("p"))).alias("entropy"), r(M.jensen_shannon(F.col("p"), F.col("q"))).alias("js"))


def _strings(s, d):
    n = table(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    slug = F.regexp_replace(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-"), "^-|-$", "")
    return n.select("p_partkey", slug.alias("slug"), F.upper("p_type").alias("upper"), F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("joined"), F.col("p_brand").rlike("^[A-Za-z]+#[0-9]+$").alias("formed"), F.length(F.trim("p_name")).alias("chars"))


def _ints(s, d):
    """Strict decimal casts: ASCII digits only, in range."""
    x = table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    ok = F.col("k").rlike(r"^[0-9]+\z")
    return x.select("event_id", F.when(ok, F.col("k").try_cast("int")).alias("value"), F.sha2(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("k").alias("k"))), 256).alias("digest"))


def _arrays(s, d):
    b = layouts(s, d)
    path = F.array(*[F.lit(x) for x in GAME.paylines["l4"]])
    line = F.transform(path, lambda r, i: F.get("cells", r * 5 + i))
    first = F.get(F.col("own"), F.lit(0))
    fits = F.transform("own", lambda c: (c == first) | (c == 11))
    b = b.select("sequence_number", line.alias("own"), "cells")
    length = F.when(F.array_position(fits, F.lit(False)) == 0, F.size("own")).otherwise(F.array_position(fits, F.lit(False)) - 1).cast("int")
    jokers = F.filter(F.transform("cells", lambda c, i: F.when(c == 11, i)), lambda x: x.isNotNull())
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    return b.select("sequence_number", text("own").alias("line"), length.alias("prefix"), text(jokers).alias("jokers"), text(F.array_distinct("cells")).alias("distinct"), F.forall("cells", lambda c: c.between(1, 32767)).alias("valid"))


def _dates(s, d):
    i = table(s, d, "source_images").where("processed_at is not null and created_at is not null")
    i = i.select("id", F.timestamp_diff("SECOND", F.col("created_at"), F.col("processed_at")).alias("seconds")).distinct()
    return i.select("id", "seconds", F.when(F.col("seconds") > 0, F.round(F.lit(60.0) / F.col("seconds"), 6)).alias("per_minute"))


def _hamming(s, d):
    """Distance of every fingerprint to one fixed fingerprint, as a share of its bits."""
    fixed = "0123456789abcdef" * 2
    f = table(s, d, "symbol_crop_samples").select(F.lower("crop_fingerprint").alias("f")).distinct().where("f is not null")
    return f.select("f", M.hex_distance(F.col("f"), F.lit(fixed), 32).alias("distance"))


def _suggest(s, d):
    """How often the nearest classes of a queried vector hold its own label: coverage, top-1 and top-3."""
    e = table(s, d, "embeddings")
    near = R.nearest_per_class(e, e.where("vec_id % 50 = 0"), 3, 0.2)
    j = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label").join(near, "query_id", "left")
    one = j.groupBy("query_id").agg(F.count("class").alias("k"), F.bool_or((F.col("class") == F.col("label")) & (F.col("rank") == 1)).alias("t1"), F.bool_or(F.col("class") == F.col("label")).alias("t3"))
    return one.agg(F.count("*").alias("queries"), F.count_if(F.col("k") > 0).alias("covered"), F.count_if(F.col("t1")).alias("top1"), F.count_if(F.col("t3")).alias("top3"))


def _active(s, d):
    """Ten boards to look at. A cell's probabilities are its confidence for the predicted code and the rest in equal parts
    for all others; a cell without a prediction is even."""
    c = R.latest_by(cells(s, d).select("recognized_board_id", (F.col("row_index") * 5 + F.col("column_index")).alias("cell"), "predicted", "confidence"), ["recognized_board_id", "cell"], F.col("confidence"), F.col("predicted"))
    codes = sorted(r[0] for r in c.where("predicted is not null").select("predicted").distinct().collect())  # of a game, 32,767 at most
    n, sure = len(codes), F.coalesce("confidence", F.lit(1.0 / max(1, len(codes))))
    p = F.transform(F.array(*map(F.lit, codes)), lambda x: F.when(F.col("predicted").isNull(), 1.0 / n).when(x == F.col("predicted"), sure).otherwise((1 - sure) / (n - 1)))
    b = boards(s, d).groupBy(F.col("id").alias("recognized_board_id")).agg(F.min("source_image_id").alias("source"), F.max("sequence_number").alias("sequence_number"))
    j = c.join(b, "recognized_board_id").where("sequence_number > 0")
    return select_boards(j.select(F.col("recognized_board_id").alias("id"), "source", "sequence_number", "cell", p.alias("probabilities")), 10).withColumn("score", F.round("score", 6))


def _temperature(s, d):
    """The temperature at which the embeddings, read as logits, are calibrated for their labels."""
    e = table(s, d, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double") * 10).alias("logits"))
    return s.createDataFrame([(round(fit_temperature(e), 6),)], "temperature double")


def _n(s, d):
    return table(s, d, "orders").count()


QUERIES = {
    "prj_normalize_row": lambda s, d: _imported(s, d).select("job_id", "line_number", "sequence_number", "error_code", "foreign", "signature"),
    "dom_import_integrity": lambda s, d: I.import_report(_imported(s, d)),
    "dom_import_error_counts": lambda s, d: _imported(s, d).where("error_code is not null").groupBy("error_code").agg(F.count("*").alias("n")),
    "dom_dataset_validate": _dataset,
    "dom_continuity": lambda s, d: I.continuity_issues(boards(s, d)),
    "dom_completeness": lambda s, d: I.completeness(boards(s, d), _n(s, d)),
    "dom_suggest_eval": _suggest,
    "dom_active_learning": _active,
    "fn_temperature": _temperature,
    "fn_signature": _signatures,
    "fn_vectors": _vectors,
    "fn_strings": _strings,
    "fn_cast_json_hash": _ints,
    "fn_arrays": _arrays,
    "fn_dates": _dates,
    "fn_hamming": _hamming,
    "fn_cyclic": lambda s, d: layouts(s, d).select("sequence_number", cyclic_next(F.col("sequence_number"), _n(s, d), 7).alias("seventh"), M.safe(F.col("sequence_number") * 1000).alias("checked")),
    "fn_wilson": lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("k"), F.count("*").alias("n")).select("user_id", F.round(M.wilson_lower(F.col("k"), F.col("n")), 6).alias("wilson")),
    "fn_map": lambda s, d: layouts(s, d).select("sequence_number", F.map_from_entries(F.transform(F.array_distinct("cells"), lambda c: F.struct(c.alias("k"), F.size(F.filter("cells", lambda x: x == c)).alias("v")))).alias("m")).select("sequence_number", F.size("m").alias("symbols"), F.array_max(F.map_values("m")).alias("most")),
}

_DMG = f"""{LAYOUTS}, damaged AS (SELECT sequence_number, signature, CASE WHEN sequence_number % 83 = 0 THEN cells[1:14] WHEN sequence_number % 79 = 0 THEN list_append(cells[1:14], 12) ELSE cells END AS cells
 FROM (SELECT * FROM boards WHERE sequence_number % 97 <> 0 UNION ALL SELECT * FROM boards WHERE sequence_number % 89 = 0)), n AS (SELECT count(*) AS n FROM orders),
issues AS (SELECT 'missing' AS c, r.i AS s FROM n, range(1, n.n + 1) r(i) WHERE r.i NOT IN (SELECT sequence_number FROM damaged) UNION ALL SELECT 'duplicate_sequence', sequence_number FROM damaged GROUP BY 2 HAVING count(*) > 1
 UNION ALL SELECT 'cell_count', sequence_number FROM damaged WHERE len(cells) <> 15 UNION ALL SELECT 'foreign_symbol', sequence_number FROM damaged WHERE list_contains(cells, 12)
 UNION ALL SELECT 'signature', sequence_number FROM damaged WHERE array_to_string(list_transform(cells, lambda c: lpad(c::varchar, 2, '0')), '') <> signature),
ranked AS (SELECT c, s, row_number() OVER (PARTITION BY c ORDER BY s) AS k FROM issues), codes(c) AS (VALUES ('missing'), ('out_of_range'), ('duplicate_sequence'), ('cell_count'), ('foreign_symbol'), ('signature')),
agg AS (SELECT codes.c AS check_code, count(s) AS issue_count, coalesce(string_agg(s::varchar, ',' ORDER BY s) FILTER (k <= 100), '') AS sample FROM codes LEFT JOIN ranked USING (c) GROUP BY 1
 UNION ALL SELECT 'count', (SELECT abs(count(*) - any_value(n)) FROM damaged, n), '' UNION ALL SELECT 'duplicate_signature', (SELECT count(*) FROM (SELECT 1 FROM damaged GROUP BY signature HAVING count(*) > 1)), '')"""
_SOFT = "list_transform({v}, lambda x: exp((x - list_max({v})) / 0.5))"



def _shannon(a: str, b: str) -> str:
    """The Jensen-Shannon divergence of two lists."""
    half = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: CASE WHEN {a}[i] > 0 THEN {a}[i] * log2(2 * {a}[i] / ({a}[i] + {b}[i])) ELSE 0 END))"
    return f"({half.format(a=a, b=b)} + {half.format(a=b, b=a)}) / 2"


# One step of the recursion is one board.
_ACTIVE = f"""WITH RECURSIVE {BOARDS}, {CELLS},
c AS (SELECT recognized_board_id AS id, row_index * 5 + column_index AS cell, predicted, confidence FROM cells QUALIFY row_number() OVER (PARTITION BY recognized_board_id, row_index * 5 + column_index ORDER BY confidence DESC NULLS LAST, predicted DESC NULLS LAST) = 1),
k AS (SELECT list(DISTINCT predicted ORDER BY predicted) AS codes, count(DISTINCT predicted) AS n FROM c WHERE predicted IS NOT NULL),
bd AS (SELECT id, min(source_image_id) AS source, max(sequence_number) AS seq FROM rb GROUP BY 1 HAVING max(sequence_number) > 0),
p AS (SELECT c.id, source, seq, cell, list_transform(codes, lambda x: CASE WHEN predicted IS NULL THEN 1.0::double / n WHEN x = predicted THEN coalesce(confidence, 1.0::double / n) ELSE (1 - coalesce(confidence, 1.0::double / n)) / (n - 1) END) AS p FROM c JOIN bd ON bd.id = c.id, k),
w AS (SELECT *, -list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) / ln(len(p)) AS h, list_position(p, list_max(p)) AS top FROM p WHERE id IN (SELECT id FROM p GROUP BY 1 HAVING count(DISTINCT cell) = 15)),
often AS (SELECT top, count(*) AS n FROM w GROUP BY 1),
means AS (SELECT id, i, avg(p[i]) AS m FROM w, range(1, (SELECT n + 1 FROM k)) r(i) GROUP BY 1, 2), mean AS (SELECT id, list(m ORDER BY i) AS mean FROM means GROUP BY 1),
pool AS (SELECT w.id, any_value(source) AS source, any_value(seq) AS seq, 0.65 * list_avg(list_reverse_sort(list(h))[1:5]) + 0.05 * avg(1 - often.n / (SELECT max(n) FROM often)) AS base, any_value(mean) AS mean FROM w JOIN often USING (top) JOIN mean ON mean.id = w.id GROUP BY 1),
pick AS (SELECT 0 AS rank, NULL::VARCHAR AS id, 0.0::double AS score, []::DOUBLE[][] AS means, []::VARCHAR[] AS sources, []::VARCHAR[] AS ids
 UNION ALL SELECT rank + 1, b.id, b.score, list_append(means, b.mean), list_append(sources, b.source), list_append(ids, b.id) FROM (
  SELECT rank, means, sources, ids, arg_min({{'id': id, 'score': score, 'mean': mean, 'source': source}}, (list_contains(sources, source), -score, seq, id)) AS b FROM (
   SELECT pick.rank, pick.means, pick.sources, pick.ids, pool.id, pool.source, pool.seq, pool.mean, base + 0.15 * coalesce(list_min(list_transform(pick.means, lambda o: {_shannon('pool.mean', 'o')})), 1) + CASE WHEN list_contains(pick.sources, pool.source) THEN 0 ELSE 0.15 END AS score
   FROM pick, pool WHERE pick.rank < 10 AND NOT list_contains(pick.ids, pool.id)) GROUP BY ALL))
SELECT rank, id, round(score, 6) AS score FROM pick WHERE rank > 0"""

SQL = {
    "dom_active_learning": _ACTIVE,
    "dom_dataset_validate": f"WITH {_DMG} SELECT check_code, issue_count, sample, CASE WHEN issue_count = 0 THEN 'ok' WHEN check_code = 'duplicate_signature' THEN 'warning' ELSE 'blocked' END AS status FROM agg",
    "dom_continuity": f"WITH {BOARDS}, n AS (SELECT sequence_number AS v FROM rb WHERE sequence_number IS NOT NULL) SELECT 'duplicate' AS kind, v AS value, count(*) AS n FROM n GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'gap', p + 1, v - p - 1 FROM (SELECT v, lag(v) OVER (ORDER BY v) AS p FROM (SELECT DISTINCT v FROM n)) WHERE p < v - 1 UNION ALL SELECT 'empty', NULL, 0 WHERE NOT EXISTS (SELECT 1 FROM n)",
    "dom_completeness": f"""WITH {BOARDS}, e AS (SELECT count(*) AS n FROM orders), m AS (SELECT i FROM e, range(1, e.n + 1) r(i) WHERE i NOT IN (SELECT sequence_number FROM rb WHERE sequence_number IS NOT NULL))
SELECT count(sequence_number) AS accepted, count(DISTINCT sequence_number) FILTER (sequence_number BETWEEN 1 AND e.n) AS unique_in_range, count(*) FILTER (NOT sequence_number BETWEEN 1 AND e.n) AS out_of_range, (SELECT count(*) FROM (SELECT 1 FROM rb WHERE sequence_number IS NOT NULL GROUP BY sequence_number HAVING count(*) > 1)) AS duplicates,
 (SELECT count(*) FROM m) AS missing, (SELECT coalesce(string_agg(i::varchar, ',' ORDER BY i), '') FROM (SELECT i FROM m ORDER BY i LIMIT 100)) AS first_missing FROM rb, e""",
    "dom_suggest_eval": """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS e FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS l FROM v),
s AS (SELECT q.vec_id AS query_id, q.label AS own, v.label AS class, max(round(list_dot_product(q.e, v.e) / (q.l * v.l), 9)) AS sim FROM n q JOIN n v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, class) AS rank FROM s WHERE sim >= 0.2), o AS (SELECT query_id, bool_or(class = own AND rank = 1) AS t1, bool_or(class = own) AS t3 FROM r WHERE rank <= 3 GROUP BY 1)
SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0) AS queries, count(*) AS covered, count(*) FILTER (t1) AS top1, count(*) FILTER (t3) AS top3 FROM o""",
    "fn_signature": f"WITH {LAYOUTS} SELECT sequence_number, signature, true AS round_trip, substr(signature, 1, (2 * (sequence_number % 15))::int) AS prefix, CASE WHEN list_max(cells) <= 9 THEN array_to_string(list_transform(cells, lambda c: (c * 10)::varchar), '') END AS too_wide, 2 AS width, true AS zero_refused FROM boards",
    "fn_vectors": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v FROM embeddings), j AS (SELECT v.vec_id, v.v, z.v AS z FROM v, (SELECT v FROM v WHERE vec_id = 0) z),
e AS (SELECT *, {_SOFT.format(v='v')} AS a, {_SOFT.format(v='z')} AS b FROM j), p AS (SELECT *, list_transform(a, lambda x: x / list_sum(a)) AS p, list_transform(b, lambda x: x / list_sum(b)) AS q FROM e)
SELECT vec_id, round(list_dot_product(v, z) / sqrt(list_dot_product(v, v) * list_dot_product(z, z)), 6) AS cosine, round(least(1.0, list_sum(list_transform(v, lambda x, i: abs(x - z[i]))) / len(v)), 6) AS mean_abs,
 round(list_sum(list_transform(p, lambda x: -x * ln(x))) / ln(len(p)), 6) AS entropy, round((list_sum(list_transform(p, lambda x, i: x * log2(2 * x / (x + q[i])))) + list_sum(list_transform(q, lambda x, i: x * log2(2 * x / (x + p[i]))))) / 2, 6) AS js FROM p""",
    "fn_strings": "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, upper(p_type) AS upper, p_brand || '/' || p_partkey AS joined, regexp_matches(p_brand, '^[A-Za-z]+#[0-9]+$') AS formed, length(trim(p_name))::int AS chars FROM part",
    "fn_cast_json_hash": """SELECT event_id, CASE WHEN props->>'$.k' ~ '[0-9]+' THEN (props->>'$.k')::int END AS value, sha256('{"id":' || event_id || ',"k":"' || (props->>'$.k') || '"}') AS digest FROM events""",
    "fn_arrays": f"""WITH {LAYOUTS}, l AS (SELECT sequence_number, cells, [cells[1], cells[7], cells[13], cells[9], cells[5]] AS line FROM boards)
SELECT sequence_number, array_to_string(line, ',') AS line, coalesce(nullif(list_position(list_transform(line, lambda c: c = line[1] OR c = 11), false), 0), 6)::int - 1 AS prefix,
 coalesce(array_to_string(list_filter(list_transform(cells, lambda c, i: CASE WHEN c = 11 THEN i - 1 END), lambda x: x IS NOT NULL), ','), '') AS jokers, array_to_string(list_filter(list_transform(cells, lambda c, i: CASE WHEN list_position(cells, c) = i THEN c END), lambda x: x IS NOT NULL), ',') AS distinct, true AS valid FROM l""",
    "fn_dates": "SELECT DISTINCT id, floor(epoch(processed_at - created_at))::bigint AS seconds, CASE WHEN floor(epoch(processed_at - created_at)) > 0 THEN round(60.0 / floor(epoch(processed_at - created_at)), 6) END AS per_minute FROM source_images WHERE processed_at IS NOT NULL AND created_at IS NOT NULL",
    "fn_hamming": "WITH f AS (SELECT DISTINCT lower(crop_fingerprint) AS f FROM symbol_crop_samples WHERE crop_fingerprint IS NOT NULL) SELECT f, (" + " + ".join(f"bit_count(xor(('0x' || substr(f, {1 + 8 * i}, 8))::bigint, ('0x' || substr('{'0123456789abcdef' * 2}', {1 + 8 * i}, 8))::bigint))" for i in range(4)) + ") / 128.0::double AS distance FROM f",
    "fn_cyclic": f"WITH {LAYOUTS} SELECT sequence_number, (sequence_number + 6) % (SELECT count(*) FROM orders) + 1 AS seventh, sequence_number * 1000 AS checked FROM boards",
    "fn_wilson": "WITH x AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS k, count(*) AS n FROM events GROUP BY 1), y AS (SELECT user_id, k / n AS p, n FROM x) SELECT user_id, round(greatest(0, (p + 1.96*1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96*1.96 / (4.0 * n * n))) / (1 + 1.96*1.96 / n)), 6) AS wilson FROM y",
    "fn_map": f"WITH {LAYOUTS}, c AS (SELECT sequence_number, unnest(cells) AS s FROM boards), g AS (SELECT sequence_number, s, count(*) AS n FROM c GROUP BY 1, 2) SELECT sequence_number, count(*)::int AS symbols, max(n)::int AS most FROM g GROUP BY 1",
}
