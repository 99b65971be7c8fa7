"""Reports on whether a numbered data set is whole: gaps, duplicates, foreign values, wrong signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.signature import encode_signature
from gridloom.operators.ordering import _block, block_size, previous_value
from gridloom.runtime import cut

SAMPLE = 100


def normalize_rows(rows: DataFrame, cells_needed: int, allowed: list[int], width: int) -> DataFrame:
    """Imported rows checked against a game: an ``error_code`` of the parser stays; a wrong number of cells is
    ``import_cell_count_mismatch``; a foreign code ``import_symbol_not_in_rules``, with the first such code in
    ``foreign``; others get a ``signature``. A row with an error keeps its number and cells."""
    c = F.col("cells")
    foreign = F.get(F.filter(c, lambda x: ~F.coalesce(x.isin(*allowed), F.lit(False))), F.lit(0))
    code = F.when(F.col("error_code").isNotNull(), F.col("error_code")).when(F.coalesce(F.size(c), F.lit(0)) != cells_needed, "import_cell_count_mismatch").when(foreign.isNotNull() | F.exists(c, lambda x: x.isNull()), "import_symbol_not_in_rules")
    out = rows.withColumn("error_code", code).withColumn("foreign", F.when(F.col("error_code") == "import_symbol_not_in_rules", foreign))
    return out.withColumn("signature", F.when(F.col("error_code").isNull(), encode_signature(c, width)))


def _text(numbers: Column) -> Column:
    return F.concat_ws(",", F.transform(F.array_sort(numbers), lambda x: x.cast("string")))


def missing_sample(numbers: DataFrame, expected: int, most: int = SAMPLE) -> DataFrame:
    """``(sequence_number)``: the first ``most`` of 1..``expected`` that the distinct bigints ``sequence_number`` lack.

    Numbers are counted in blocks. A block that is not full lacks at least one, so the first ``most`` such blocks hold
    the sample, and only these are listed."""
    size = block_size(expected)
    block = _block(F.col("sequence_number") - 1, size)
    here = numbers.where(F.col("sequence_number").between(1, expected)).select("sequence_number", block.alias("_block"))
    every = numbers.sparkSession.range(-(-expected // size)).select(F.col("id").alias("_block"))
    due = F.least(F.lit(size), F.lit(expected) - F.col("_block") * size)
    short = every.join(here.groupBy("_block").agg(F.count("*").alias("n")), "_block", "left").where(F.coalesce("n", F.lit(0)) < due)
    short = short.orderBy("_block").limit(most).select("_block")
    first = F.col("_block") * size + 1
    listed = short.select("_block", F.explode(F.sequence(first, F.least(first + size - 1, F.lit(expected).cast("bigint")))).alias("sequence_number"))
    return listed.join(here, ["_block", "sequence_number"], "left_anti").select("sequence_number").orderBy("sequence_number").limit(most)


def dataset_report(layouts: DataFrame, expected: int, declared: int, cells_needed: int, allowed: list[int], width: int) -> DataFrame:
    """``(check_code, status, issue_count, sample)``: eight checks of (sequence_number, cells, signature).

    ``sample`` holds the first 100 numbers concerned. Repeated signatures are a warning, all else blocks. Missing
    numbers are counted against ``expected``, so a missing tail shows. The boards are read once and grouped by number;
    a second grouping, by signature, finds the repeated ones.
    """
    n, c = F.col("sequence_number"), F.col("cells")
    wrong_size = F.coalesce(F.size(c), F.lit(0)) != cells_needed
    foreign = F.exists(c, lambda x: ~F.coalesce(x.isin(*allowed), F.lit(False)))
    unlike = ~F.coalesce(encode_signature(c, width) == F.col("signature"), F.lit(False))
    flags = layouts.select(n.cast("bigint").alias("sequence_number"), wrong_size.alias("cell_count"), foreign.alias("foreign_symbol"), unlike.alias("signature"))
    own = ["cell_count", "foreign_symbol", "signature"]
    by = cut(flags.groupBy("sequence_number").agg(F.count("*").alias("k"), *[F.count_if(F.col(x)).alias(x) for x in own]), "dataset-numbers")
    outside = F.coalesce(~n.between(1, expected), F.lit(False))
    counts = by.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("count"), (F.lit(expected) - F.count_if(n.between(1, expected))).alias("missing"), F.count_if(outside).alias("out_of_range"),
        F.count_if(F.col("k") > 1).alias("duplicate_sequence"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in own],
    ).withColumn("count", F.abs(F.col("count") - declared))
    names = ["count", "missing", "out_of_range", "duplicate_sequence", *own]
    counts = counts.select(F.explode(F.array(*[F.struct(F.lit(x).alias("check_code"), F.col(x).cast("bigint").alias("issue_count")) for x in names])).alias("x")).select("x.*")
    # A number stands in the sample once for every row with the fault, and never more often than the sample is long.
    times = {"out_of_range": outside.cast("int"), "duplicate_sequence": (F.col("k") > 1).cast("int"), **{x: F.least(F.col(x), F.lit(SAMPLE)).cast("int") for x in own}}
    faults = by.select("sequence_number", F.explode(F.flatten(F.array(*[F.array_repeat(F.lit(x), t) for x, t in times.items()]))).alias("check_code"))
    few = faults.withColumn("_k", F.row_number().over(Window.partitionBy("check_code").orderBy("sequence_number"))).where(F.col("_k") <= SAMPLE).select("check_code", "sequence_number")
    few = few.unionByName(missing_sample(by.select("sequence_number"), expected).withColumn("check_code", F.lit("missing")))
    sample = few.groupBy("check_code").agg(_text(F.collect_list("sequence_number")).alias("sample"))
    twice = layouts.where("signature is not null").groupBy("signature").agg(F.count("*").alias("k")).where("k > 1").agg(F.count("*").alias("issue_count"))
    out = counts.join(sample, "check_code", "left").unionByName(twice.select(F.lit("duplicate_signature").alias("check_code"), "issue_count", F.lit(None).cast("string").alias("sample")))
    status = F.when(F.col("issue_count") == 0, "ok").when(F.col("check_code") == "duplicate_signature", "warning").otherwise("blocked")
    return out.select("check_code", "issue_count", F.coalesce("sample", F.lit("")).alias("sample"), status.alias("status"))


def import_report(rows: DataFrame) -> DataFrame:
    """One row over (sequence_number, signature, error_code): valid and invalid rows, missing numbers below the
    largest one (a missing tail cannot be seen), groups and excess rows of repeated numbers and signatures."""
    ok = rows.where("error_code is null")
    base = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("error_code").isNull()).alias("valid"), F.count_if(F.col("error_code").isNotNull()).alias("invalid"),
                    F.max(F.when(F.col("error_code").isNull(), F.col("sequence_number"))).alias("highest"), F.count_distinct(F.when(F.col("error_code").isNull(), F.col("sequence_number"))).alias("numbers"))
    base = base.withColumn("missing", F.coalesce(F.col("highest") - F.col("numbers"), F.lit(0)))
    for key, name in (("sequence_number", "sequence"), ("signature", "signature")):
        g = ok.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("k")).where("k > 1")
        base = base.join(g.agg(F.count("*").alias(f"{name}_groups"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias(f"{name}_excess")))
    return base


def continuity_issues(numbers: DataFrame, column: str = "sequence_number") -> DataFrame:
    """``(kind, value, n)``: repeated numbers with their count, and gaps between the smallest and the largest (value
    the first missing number, n how many); one row ``empty`` where there is no number."""
    n = numbers.where(F.col(column).isNotNull()).select(F.col(column).cast("bigint").alias("v"))
    twice = n.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("kind"), F.col("v").alias("value"), "n")
    gaps = previous_value(n.distinct(), "v", "p").where("p < v - 1").select(F.lit("gap").alias("kind"), (F.col("p") + 1).alias("value"), (F.col("v") - F.col("p") - 1).alias("n"))
    none = n.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("empty").alias("kind"), F.lit(None).cast("bigint").alias("value"), "n")
    return twice.unionByName(gaps).unionByName(none)


def completeness(numbers: DataFrame, expected: int, column: str = "sequence_number") -> DataFrame:
    """One row: accepted numbers, distinct in 1..expected, missing, repeated and out of range, and the first 100 missing
    ones."""
    c = F.col(column).cast("bigint")
    inside = c.between(1, expected)
    a = numbers.agg(F.count(c).alias("accepted"), F.count_distinct(F.when(inside, c)).alias("unique_in_range"), F.count_if(~inside).alias("out_of_range"))
    d = numbers.where(c.isNotNull()).groupBy(column).count().where("count > 1").agg(F.count("*").alias("duplicates"))
    few = missing_sample(numbers.where(inside).select(c.alias("sequence_number")).distinct(), expected).agg(_text(F.collect_list("sequence_number")).alias("first_missing"))
    return a.join(d).join(few).withColumn("missing", F.lit(expected) - F.col("unique_in_range"))  # a row each
