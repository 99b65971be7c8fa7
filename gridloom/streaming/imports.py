"""Importing growing line files in micro-batches, exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.bad_rows import load_layout_lines
from gridloom.runtime import cut, exists
from gridloom.sources.lines import judged_line, numbered, register, stream_lines

PROGRESS = "path string, lines bigint, bytes bigint, digest decimal(38,0), batch int"


def _digest() -> Column:
    """A sum over lines that tells any change: 60 bits of the SHA-256 of a line with its place."""
    text = F.concat(F.col("byte_offset_end").cast("string").cast("binary"), F.lit(b"|"), F.coalesce("raw_line", F.lit(b"")))
    return F.sum(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")


def check_unchanged(spark: SparkSession, target: str, path: str, max_line_bytes: int) -> None:
    """Raise where a file is another one, as far as it was imported: its lines are read again by all tasks, and their
    digests are compared with those that the batches left."""
    if not exists(spark, f"{target}/_progress"):
        return
    register(spark)
    known = spark.read.schema(PROGRESS).parquet(f"{target}/_progress").groupBy("path").agg(F.sum("digest").alias("digest"), F.max("bytes").alias("bytes"))
    lines = spark.read.format("physical_lines").option("max_line_bytes", max_line_bytes).load(path).join(known.select("path", "bytes"), "path").where("byte_offset_end <= bytes")
    now = lines.groupBy("path").agg(_digest().alias("now"))
    if not known.join(now, "path", "left").where("not (digest <=> now)").isEmpty():
        raise ValueError("a file was changed before the checkpoint; import it again from its beginning")


def import_stream(spark: SparkSession, path: str, file_format: str | None, job_id: str | None, target: str, checkpoint: str, batch_bytes: int = 256 << 20, max_line_bytes: int = 1 << 20):
    """Start a query that stages the lines of ``path`` as (job_id, line_number, sequence_number, cells, error_code).
    ``path`` may be a folder of files; where ``job_id`` is None, a file's job is its name without the
    extension, and where ``file_format`` is None, its format is the extension.

    A micro-batch overwrites the folder of its own id, so that one which is run again after a failure leaves its
    rows once. How far a batch came in every file, in lines and bytes, and the digest of what it read, are written beside
    the rows; the next batches number their lines from there. Before a stream goes on, the files are compared with these
    digests. Lines are read, numbered and judged by the tasks; the driver sees sizes of files.
    """
    check_unchanged(spark, target, path, max_line_bytes)
    job = F.regexp_extract("path", r"([^/]+)\.[a-z]+$", 1) if job_id is None else F.lit(job_id)
    kind = F.regexp_extract("path", r"\.([a-z]+)$", 1) if file_format is None else F.lit(file_format)

    def stage(lines: DataFrame, batch: int) -> None:
        lines = cut(lines, "import-lines")
        counts = lines.groupBy("path", "range_start").agg(F.max("line_in_range").alias("n"))
        base = None
        if exists(spark, f"{target}/_progress"):
            base = spark.read.schema(PROGRESS).parquet(f"{target}/_progress").where(F.col("batch") < batch).groupBy("path").agg(F.sum("lines").alias("lines"))
        here = numbered(lines, counts, base)
        got = load_layout_lines(here.select(job.alias("job_id"), "line_number", kind.alias("file_format"), judged_line().alias("raw_line")))
        rows = got.valid.withColumn("error_code", F.lit(None).cast("string")).unionByName(got.bad.select("job_id", "line_number", F.col("code").alias("error_code")), allowMissingColumns=True)
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch}")
        done = lines.groupBy("path").agg(F.count("*").alias("lines"), F.max("byte_offset_end").alias("bytes"), _digest().alias("digest"))
        done.write.mode("overwrite").parquet(f"{target}/_progress/batch={batch}")

    stands = {}
    if exists(spark, f"{target}/_progress"):  # a row a file, as many as are listed for every batch
        stands = {r["path"]: r["bytes"] for r in spark.read.schema(PROGRESS).parquet(f"{target}/_progress").groupBy("path").agg(F.max("bytes").alias("bytes")).collect()}
    stream = stream_lines(spark, path, batch_bytes, max_line_bytes=max_line_bytes, stands=stands)
    return stream.writeStream.foreachBatch(stage).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
