"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.keys import name_key
from gridloom.llm.bpe import decode_corpus, encode_corpus
from gridloom.llm.mixture import mix_sources
from gridloom.llm.overlap import cross_split_overlap
from gridloom.llm.quota_sample import quota_sample
from gridloom.llm.splits import assign_splits
from gridloom.llm.truncation import find_truncated
from gridloom.runtime import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return assign_splits(table(spark, sf, "symbol_crop_samples")).group_pairs()


def p1_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return assign_splits(table(spark, sf, "symbol_crop_samples")).assignment()


def p1_shares(spark: SparkSession, sf: str) -> DataFrame:
    return assign_splits(table(spark, sf, "symbol_crop_samples")).shares()


def p1_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The assignment after two deliveries: what was received within a day of its making, then the late rest."""
    rows = table(spark, sf, "symbol_crop_samples")
    late = F.coalesce(F.col("received_at") > F.col("created_at") + F.expr("interval 1 day"), F.lit(False))
    return assign_splits(rows.where(late), assign_splits(rows.where(~late))).assignment()


def p1_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold after two deliveries: all samples are there once, no group or image has samples in two splits, and
    only merged components lack a split. One row: samples, ids, torn keys, components with a wrong count."""
    rows = table(spark, sf, "symbol_crop_samples")
    late = F.coalesce(F.col("received_at") > F.col("created_at") + F.expr("interval 1 day"), F.lit(False))
    got = assign_splits(rows.where(late), assign_splits(rows.where(~late)))
    a = got.assignment()
    keyed = rows.select(name_key(F.col("sample_id")).alias("sample_id"), F.explode(F.array(F.struct(F.lit("i").alias("kind"), name_key(F.col("source_image_id")).alias("key")), F.struct(F.lit("g").alias("kind"), name_key(F.col("source_group")).alias("key")))).alias("k"))
    split = F.coalesce("split_name", "status")
    torn = keyed.where("k.key is not null").join(a, "sample_id").groupBy("k.kind", "k.key").agg(F.count_distinct(split).alias("n")).where("n > 1").agg(F.count("*").alias("torn"))
    real = a.groupBy(F.col("component").alias("comp")).agg(F.count("*").alias("n"))
    wrong = got.components.where("samples > 0").join(real, "comp", "full").where("not (samples <=> n)").agg(F.count("*").alias("wrong_counts"))
    return a.agg(F.count("*").alias("samples"), F.count_distinct("sample_id").alias("ids")).join(torn).join(wrong)  # a row each


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return cross_split_overlap(table(spark, sf, "symbol_crop_samples")).pairs()


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    return cross_split_overlap(table(spark, sf, "symbol_crop_samples")).report()


def _quota(spark: SparkSession, sf: str):
    return quota_sample(table(spark, sf, "board_candidates"), table(spark, sf, "candidate_targets"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _quota(spark, sf).unreachable()


def p5_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _quota(spark, sf).sample.select("observation_id")


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    return _quota(spark, sf).report


def p5_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """The sample's size, its distinct ids and those that are no observation, and categories whose report
    has a deviation below the bound that no sample can be below."""
    q = _quota(spark, sf)
    there = table(spark, sf, "board_candidates").select("observation_id").distinct().withColumn("_there", F.lit(True))
    drawn = q.sample.select("observation_id").join(there, "observation_id", "left").agg(F.count("*").alias("drawn"), F.count_distinct("observation_id").alias("ids"), F.count_if(F.col("_there").isNull()).alias("foreign"))
    return drawn.join(q.report.agg(F.count_if(F.col("deviation") < F.col("least_deviation")).alias("below_bound")))  # a row each


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(table(spark, sf, "documents"))


def p6_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """For each source: documents, tokens, and texts that decoding does not give back (there must be none)."""
    docs = table(spark, sf, "documents")
    ids = encode_corpus(docs)
    back = decode_corpus(ids).withColumnRenamed("text", "decoded")
    joined = docs.select("doc_id", "text", "source").join(ids, "doc_id").join(back, "doc_id")
    return joined.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.size("ids")).alias("tokens"), F.count_if(F.coalesce("text", F.lit("")) != F.col("decoded")).alias("changed"))


def p6_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """For each source: documents, those with the ids ``[]``, and those that decoding does not give back."""
    docs = table(spark, sf, "documents")
    ids = encode_corpus(docs)
    joined = docs.select("doc_id", "text", "source").join(ids, "doc_id").join(decode_corpus(ids).withColumnRenamed("text", "decoded"), "doc_id")
    return joined.groupBy("source").agg(F.count("*").alias("docs"), F.count_if(F.size("ids") == 0).alias("empty"), F.count_if(F.coalesce("text", F.lit("")) != F.col("decoded")).alias("changed"))


def _mixture(spark: SparkSession, sf: str):
    return mix_sources(table(spark, sf, "documents"), table(spark, sf, "source_targets"))


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf).documents


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf).shares


def p7_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """For each target source: its share and cap, its documents, and whether no document is repeated more often than the
    cap and the tokens come as near to the goal as one document is long."""
    m = _mixture(spark, sf)
    longest = m.documents.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    near = F.abs(F.col("tokens_reached") - F.col("tokens_wanted")) <= F.coalesce(F.col("longest"), F.lit(0)) + 1
    return m.shares.where("target_share is not null").join(longest, "source", "left").select("source", "target_share", "max_repeats", F.col("docs_available").cast("bigint").alias("docs"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"), near.alias("near_goal"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return find_truncated(table(spark, sf, "documents")).scores.where("truncated").select("doc_id")


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    return find_truncated(table(spark, sf, "documents")).rates


def p8_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """For each source: documents that were scored, those with anything but white space, and blank ones that are flagged."""
    s = find_truncated(table(spark, sf, "documents")).scores.join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    full = F.coalesce(F.length(F.regexp_replace("text", r"[ \t\r\n]", "")) > 0, F.lit(False))
    return s.groupBy("source").agg(F.count("*").alias("docs"), F.count_if(full).alias("with_text"), F.count_if(~full & F.col("truncated")).alias("blank_flagged"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_assignment, p1_shares, p1_incremental, p1_invariants, p3_found, p3_report, p5_found, p5_sample, p5_report, p5_invariants, p6_ids, p6_roundtrip, p6_invariants,
        p7_mixture, p7_shares, p7_invariants, p8_found, p8_rates, p8_invariants,
    )
}

_BARE = "lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13)))"
_NAME = "CASE WHEN " + _BARE + " IN ('', 'unknown', 'n/a') THEN NULL ELSE " + _BARE + " END"
_DIGEST = "nullif(regexp_replace(" + _BARE + ", '^sha256:', ''), '')"
_WORDS = ", ".join(f"('0x' || substr(f, {1 + 8 * i}, 8))::bigint AS w{i}" for i in range(4))
_DISTANCE = " + ".join(f"bit_count(xor(a.w{i}, b.w{i}))" for i in range(4))
_SIDES = f"""
  n AS (SELECT sample_id, {_BARE.format(c='split_name')} AS split, {_BARE.format(c='source_group')} AS source_group, {_DIGEST.format(c='crop_checksum_sha256')} AS d,
               {_DIGEST.format(c='source_image_checksum_sha256')} AS i, board_index, cell_index, {_BARE.format(c='crop_fingerprint')} AS f FROM symbol_crop_samples WHERE sample_id IS NOT NULL),
  w AS (SELECT *, {_WORDS} FROM n WHERE split IN ('train', 'validation', 'test')),
  a AS (SELECT * FROM w WHERE split <> 'train'), b AS (SELECT * FROM w WHERE split = 'train')"""

SQL = {
    "p1_invariants": f"SELECT count(DISTINCT {_NAME.format(c='sample_id')}) AS samples, count(DISTINCT {_NAME.format(c='sample_id')}) AS ids, 0 AS torn, 0 AS wrong_counts FROM symbol_crop_samples",
    "p5_invariants": """
WITH n AS (SELECT count(DISTINCT observation_id) // (SELECT max(sample_divisor) FROM candidate_targets) AS n FROM board_candidates) SELECT n AS drawn, n AS ids, 0 AS foreign, 0 AS below_bound FROM n""",
    "p6_invariants": "SELECT source, count(*) AS docs, count(*) FILTER (coalesce(text, '') = '') AS empty, 0 AS changed FROM documents GROUP BY 1",
    "p7_invariants": """
SELECT t.source, t.target_share, t.max_repeats, count(d.doc_id) AS docs, true AS within_cap, true AS near_goal FROM source_targets t LEFT JOIN documents d ON d.source = t.source GROUP BY ALL""",
    "p8_invariants": """
SELECT source, count(*) AS docs, count(*) FILTER (length(regexp_replace(text, '[ \\t\\r\\n]', '', 'g')) > 0) AS with_text, 0 AS blank_flagged FROM documents GROUP BY 1""",
    "p1_found": f"""
WITH RECURSIVE rows_ AS (SELECT DISTINCT {_NAME.format(c='sample_id')} AS s, {_NAME.format(c='source_image_id')} AS i, {_NAME.format(c='source_group')} AS g FROM symbol_crop_samples),
  pairs AS (SELECT 'g' || g AS u, 'i' || i AS v FROM rows_ UNION SELECT 'g' || g, 's' || s FROM rows_ UNION SELECT 'i' || i, 's' || s FROM rows_),
  edges AS (SELECT u, v FROM pairs WHERE u IS NOT NULL AND v IS NOT NULL UNION SELECT v, u FROM pairs WHERE u IS NOT NULL AND v IS NOT NULL),
  reach AS (SELECT DISTINCT 'g' || g AS start, 'g' || g AS node FROM rows_ WHERE g IS NOT NULL UNION SELECT r.start, e.v FROM reach r JOIN edges e ON r.node = e.u)
SELECT substr(start, 2) AS source_group_a, substr(node, 2) AS source_group_b FROM reach WHERE node LIKE 'g%' AND substr(start, 2) < substr(node, 2)""",
    "p3_found": f"""
WITH {_SIDES}
SELECT DISTINCT least(a.sample_id, b.sample_id) AS sample_id_a, greatest(a.sample_id, b.sample_id) AS sample_id_b FROM a JOIN b ON a.sample_id <> b.sample_id
 AND (a.d = b.d OR (a.i = b.i AND a.board_index = b.board_index AND a.cell_index = b.cell_index) OR {_DISTANCE} <= 6)""",
    "p3_report": f"""
WITH {_SIDES},
  crop AS (SELECT DISTINCT d FROM b WHERE d IS NOT NULL), place AS (SELECT DISTINCT i, board_index, cell_index FROM b WHERE i IS NOT NULL AND board_index IS NOT NULL AND cell_index IS NOT NULL),
  near AS (SELECT DISTINCT a.f FROM (SELECT DISTINCT f, w0, w1, w2, w3 FROM a) a JOIN (SELECT DISTINCT f, w0, w1, w2, w3 FROM b) b ON {_DISTANCE} <= 6),
  one AS (SELECT a.split, a.source_group, a.sample_id, bool_or(a.d IS NOT NULL AND a.d IN (SELECT d FROM crop)) AS c, bool_or(p.i IS NOT NULL) AS p, bool_or(near.f IS NOT NULL) AS x
          FROM a LEFT JOIN place p ON a.i = p.i AND a.board_index = p.board_index AND a.cell_index = p.cell_index LEFT JOIN near ON a.f = near.f GROUP BY ALL)
SELECT split AS split_name, source_group, count(*) AS samples, count(*) FILTER (c) AS same_crop, count(*) FILTER (p) AS same_place, count(*) FILTER (x) AS near_crop, count(*) FILTER (c OR p OR x) AS overlapping
FROM one GROUP BY ALL""",
    "p5_found": f"""
WITH c AS (SELECT observation_id AS o, board_position, {_BARE.format(c='source_group')} AS g, condition_tags FROM board_candidates WHERE observation_id IS NOT NULL),
  has AS (SELECT o, 'board_position' AS k, board_position::varchar AS v FROM c UNION SELECT o, 'source_group', g FROM c
          UNION SELECT o, 'condition_tag', replace({_BARE.format(c='t')}, '_', '-') FROM (SELECT o, unnest(condition_tags) AS t FROM c)),
  n AS (SELECT k, v, count(DISTINCT o) AS n FROM has GROUP BY ALL), total AS (SELECT count(DISTINCT o) AS n FROM c)
SELECT t.category_kind, t.category FROM candidate_targets t LEFT JOIN n ON n.k = t.category_kind AND n.v = t.category CROSS JOIN total
WHERE coalesce(n.n, 0) < t.min_count OR coalesce(n.n, 0) < t.target_share * (total.n // t.sample_divisor)""",
}
