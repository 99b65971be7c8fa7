"""Versioned tables: written whole, counted, and made visible by a manifest that is written last."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.relational import insert_missing, upsert
from gridloom.runtime import put_in_place, qualified


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _file(spark, path)
    out = fs.create(p, False)  # never over an existing one
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return None
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def publish(df: DataFrame, folder: str, version: int, expected: int | None = None, partition_by: list[str] | None = None, sort_by: list[str] | None = None, bloom: str | None = None) -> dict:
    """Write ``df`` as ``folder/version=N`` and, when its rows are as many as ``expected``, its manifest. A version
    without a manifest does not exist for readers; an existing one is an error."""
    spark, path = df.sparkSession, f"{folder}/version={version}"
    if sort_by:
        df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{bloom}", "true")
    w.parquet(path)
    rows = spark.read.parquet(path).count()
    if expected is not None and rows != expected:
        raise ValueError(f"{rows} rows were written, {expected} expected; version {version} stays unpublished")
    manifest = {"version": version, "rows": rows, "schema": json.loads(df.schema.json())}
    write_text(spark, f"{folder}/manifest-{version}.json", json.dumps(manifest, sort_keys=True))
    return manifest


def open_version(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """A published version, with the schema of its manifest; an error where there is none."""
    from pyspark.sql.types import StructType

    text = read_text(spark, f"{folder}/manifest-{version}.json")
    if text is None:
        raise ValueError(f"version {version} was not published")
    return spark.read.schema(StructType.fromJson(json.loads(text)["schema"])).parquet(f"{folder}/version={version}")


def upsert_version(spark: SparkSession, folder: str, version: int, rows: DataFrame, keys: list[str]) -> dict:
    """Version ``version + 1``: the rows of ``version``, those of equal keys replaced, others added."""
    return publish(upsert(open_version(spark, folder, version), rows, keys), folder, version + 1)


def insert_version(spark: SparkSession, folder: str, version: int, rows: DataFrame, keys: list[str]) -> dict:
    """Version ``version + 1``: the rows of ``version`` and those whose keys it lacks."""
    return publish(insert_missing(open_version(spark, folder, version), rows, keys), folder, version + 1)


def export_once(df: DataFrame, folder: str, state: str) -> bool:
    """Write ``df`` as the export of the source state ``state`` (a digest), unless there is one: (whether it was written).
    The manifest comes last, so an export that was broken off does not count and is written again."""
    spark = df.sparkSession
    if read_text(spark, f"{folder}/export-{state}.json") is not None:
        return False
    df.write.mode("overwrite").parquet(f"{folder}/state={state}")
    rows = spark.read.parquet(f"{folder}/state={state}").count()
    write_text(spark, f"{folder}/export-{state}.json", json.dumps({"rows": rows, "state": state, "schema": json.loads(df.schema.json())}, sort_keys=True))
    return True


def open_export(spark: SparkSession, folder: str, state: str) -> DataFrame:
    """The export of a source state; an error where there is none."""
    from pyspark.sql.types import StructType

    text = read_text(spark, f"{folder}/export-{state}.json")
    if text is None:
        raise ValueError(f"there is no export of {state}")
    return spark.read.schema(StructType.fromJson(json.loads(text)["schema"])).parquet(f"{folder}/state={state}")


def write_audit(evaluated: DataFrame, path: str) -> None:
    """One JSON line a layout, with all matches, in files by range of the number."""
    line = F.to_json(F.struct("sequence_number", "payout", "matches"))
    evaluated.repartitionByRange("sequence_number").sortWithinPartitions("sequence_number").select(line.alias("value")).write.text(path)


AUDIT = "sequence_number bigint, payout bigint, matches array<struct<payline:string,symbol:int,length:int,payout:bigint,wild:int>>"


def verify_audit(spark: SparkSession, path: str, payouts: DataFrame) -> DataFrame:
    """One row: audited layouts, lines that are no JSON, sums of matches that differ from the total of the line, and
    numbers whose total differs from ``payouts`` or that only one side has."""
    a = spark.read.text(path).select(F.from_json("value", AUDIT).alias("a")).select("a.*")
    total = F.aggregate(F.coalesce("matches", F.array().cast("array<struct<payline:string,symbol:int,length:int,payout:bigint,wild:int>>")), F.lit(0).cast("bigint"), lambda s, m: s + m["payout"])
    j = a.select("sequence_number", F.col("payout").alias("audited"), total.alias("total")).join(payouts.select("sequence_number", "payout"), "sequence_number", "full")
    return j.agg(F.count("audited").alias("audited"), F.count_if(F.col("sequence_number").isNull()).alias("broken"), F.count_if(F.col("total") != F.col("audited")).alias("wrong_sums"), F.count_if(~F.col("audited").eqNullSafe(F.col("payout"))).alias("different"))


def write_line_files(lines: DataFrame, folder: str, file_col: str, order_col: str, line_col: str, extension: str) -> None:
    """``folder/<file>.<extension>`` for every value of ``file_col``, its lines in order, each with a newline. A file is
    written under another name and renamed when it is complete."""
    import pyarrow as pa

    root = qualified(lines.sparkSession, folder)

    def run(batches):
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(root)
        where.create_dir(base, recursive=True)
        name, out = None, None

        def done() -> None:
            if out is not None:
                out.close()
                put_in_place(where, f"{base}/.{name}.part", f"{base}/{name}.{extension}")

        for batch in batches:
            for file, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file != name:
                    done()
                    name, out = file, where.open_output_stream(f"{base}/.{file}.part")
                out.write((line or b"") + b"\n")
        done()
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32())], names=["done"])

    src = lines.select(F.col(file_col).cast("string").alias("f"), F.col(line_col).alias("l"), F.col(order_col).alias("o")).where("f is not null")
    src.repartition("f").sortWithinPartitions("f", "o").select("f", "l").mapInArrow(run, "done int").write.format("noop").mode("overwrite").save()
