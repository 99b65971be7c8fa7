"""The second stage of an import: staged rows, checked against a game by a cursor that keeps its place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.integrity import normalize_rows

STAGED = "job_id string, line_number bigint, cells array<int>, error_code string"


def validation_stream(spark: SparkSession, staged: str, target: str, checkpoint: str, cells_needed: int, allowed: list[int], width: int, files: int = 1):
    """Start a query that checks the rows of ``staged`` (Parquet of ``STAGED``), ``files`` files at a time, into
    ``target/rows``, and writes what each batch did for every job into ``target/progress``. A batch that is run again
    overwrites its own folders, so every row is counted once."""

    def step(rows: DataFrame, batch: int) -> None:
        out = normalize_rows(rows, cells_needed, allowed, width)
        out.write.mode("overwrite").parquet(f"{target}/rows/batch={batch}")
        done = spark.read.parquet(f"{target}/rows/batch={batch}").groupBy("job_id")
        done = done.agg(F.count("*").alias("processed"), F.count_if(F.col("error_code").isNull()).alias("succeeded"), F.count_if(F.col("error_code").isNotNull()).alias("failed"), F.max("line_number").alias("line_number"))
        done.write.mode("overwrite").parquet(f"{target}/progress/batch={batch}")

    stream = spark.readStream.schema(STAGED).option("maxFilesPerTrigger", files).parquet(staged)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()


def validation_progress(spark: SparkSession, staged: str, target: str) -> DataFrame:
    """``(job_id, total, processed, succeeded, failed, line_number, complete)`` of every staged job.

    Impossible progress is an error: more processed than staged, other than succeeded and failed together, or a place
    beyond the last staged line; this is how staging that changed under the cursor shows.
    """
    total = spark.read.schema(STAGED).parquet(staged).groupBy("job_id").agg(F.count("*").alias("total"), F.max("line_number").alias("last"))
    done = spark.read.parquet(f"{target}/progress").groupBy("job_id").agg(*[F.sum(x).alias(x) for x in ("processed", "succeeded", "failed")], F.max("line_number").alias("line_number"))
    j = total.join(done, "job_id", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    wrong = (zero("processed") > zero("total")) | (zero("processed") != zero("succeeded") + zero("failed")) | (zero("line_number") > zero("last"))
    complete = F.when(wrong, F.raise_error(F.lit("the staging changed during validation")).cast("boolean")).otherwise(zero("processed") == zero("total"))
    return j.select("job_id", zero("total").alias("total"), *[zero(x).alias(x) for x in ("processed", "succeeded", "failed", "line_number")], complete.alias("complete"))
