"""Queries that run the operators on broken rows and tiny files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.keys import path_key
from gridloom.operators.bad_rows import load_layout_lines, load_report_lines
from gridloom.operators.compaction import compact_files
from gridloom.runtime import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return load_layout_lines(table(spark, sf, "layout_import_lines")).bad.unionByName(load_report_lines(table(spark, sf, "import_report_lines")).bad)


def p2_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """The valid layout lines as typed rows, the cells as a string that every engine prints alike."""
    return load_layout_lines(table(spark, sf, "layout_import_lines")).valid.withColumn("cells", F.concat_ws(",", F.transform("cells", lambda c: c.cast("string"))))


def p2_reports(spark: SparkSession, sf: str) -> DataFrame:
    return load_report_lines(table(spark, sf, "import_report_lines")).valid.withColumn("line_numbers", F.when(F.col("line_numbers").isNotNull(), F.concat_ws(",", F.transform("line_numbers", lambda c: c.cast("string")))))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return compact_files(table(spark, sf, "crop_files")).copies()


def p4_packs(spark: SparkSession, sf: str) -> DataFrame:
    """What the packs hold, each read back and compared with the index: records, their bytes, records that are wrong,
    and bytes of packs that are no record's (there must be none of either)."""
    c = compact_files(table(spark, sf, "crop_files"))
    read = c.validate().agg(F.sum("records").alias("records"), F.sum("wrong").alias("wrong"))
    return read.join(c.packs().agg(F.sum("record_bytes").alias("record_bytes")))  # a row each


def p4_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Places that samples or observations name and no stored file has, with the number of rows naming them."""
    named = table(spark, sf, "symbol_crop_samples").select("crop_relative_path").unionByName(table(spark, sf, "cell_observations").select("crop_relative_path"))
    named = named.where("crop_relative_path is not null").groupBy(path_key(F.col("crop_relative_path")).alias("path")).agg(F.count("*").alias("named"))
    return named.join(table(spark, sf, "crop_files").select(path_key(F.col("crop_relative_path")).alias("path")), "path", "left_anti")


QUERIES = {f.__name__: f for f in (p2_found, p2_layouts, p2_reports, p4_found, p4_packs, p4_missing)}

_PLACE = """list_reduce(list_prepend(['/'], list_transform(list_filter(string_split(replace({c}, chr(92), '/'), '/'), lambda s: s NOT IN ('', '.')), lambda s: [s])),
  lambda x, y: CASE WHEN y[1] = '..' THEN x[1:greatest(len(x) - 1, 1)] ELSE list_concat(x, y) END)"""
_PLACE = "array_to_string((" + _PLACE + ")[2:], '/')"

SQL = {
    "p4_found": f"""
WITH f AS (SELECT file_id, {_PLACE.format(c='crop_relative_path')} AS p, payload FROM crop_files)
SELECT DISTINCT a.file_id AS file_id_a, b.file_id AS file_id_b FROM f a JOIN f b ON a.p = b.p AND a.payload = b.payload AND a.file_id < b.file_id""",
    "p4_packs": f"""
WITH f AS (SELECT DISTINCT {_PLACE.format(c='crop_relative_path')} AS p, payload FROM crop_files WHERE crop_relative_path IS NOT NULL)
SELECT count(*) AS records, 0 AS wrong, sum(octet_length(payload))::bigint AS record_bytes FROM f""",
    "p4_missing": f"""
WITH n AS (SELECT crop_relative_path AS c FROM symbol_crop_samples UNION ALL SELECT crop_relative_path FROM cell_observations),
  m AS (SELECT {_PLACE.format(c='c')} AS path, count(*) AS named FROM n WHERE c IS NOT NULL GROUP BY ALL)
SELECT path, named FROM m WHERE path NOT IN (SELECT {_PLACE.format(c='crop_relative_path')} FROM crop_files WHERE crop_relative_path IS NOT NULL)""",
}
