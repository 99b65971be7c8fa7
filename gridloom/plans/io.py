"""Queries of sources, sinks and stateful operators. Files go to the shared folder and are read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions.keys import digest_key, path_key
from gridloom.functions.signature import encode_signature
from gridloom.operators import relational as R
from gridloom.operators.bad_rows import load_layout_lines
from gridloom.operators.boards import evaluate_payouts
from gridloom.plans.common import GAME, LAYOUTS, PAYOUTS, layouts, payouts
from gridloom.plans.repair import _PLACE
from gridloom.plans.windows import BOARDS, boards
from gridloom.runtime import cut, new_path, qualified, table
from gridloom.sources import sinks
from gridloom.sources.files import attest_files, discover_images, publish_curated, write_files
from gridloom.sources.generators import affine_layouts, mock_layouts
from gridloom.sources.lines import judged_line, prefix_chains, read_lines
from gridloom.sources.snapshots import read_snapshot, validate_snapshot, write_snapshot
from gridloom.streaming.checkpoints import group_with_checkpoints, late_merge
from gridloom.streaming.grouping import OUT, group_observations, group_stream
from gridloom.streaming.imports import import_stream
from gridloom.streaming.validation import validation_progress, validation_stream


def _files(s, d, kind, folder=None):
    """The import files of the table as real files, one a job, and their lines read back by the line source."""
    lines = table(s, d, "layout_import_lines").where(F.col("file_format") == kind)
    lines = R.latest_by(lines.select("job_id", "line_number", "raw_line", "received_at"), ["job_id", "line_number"], F.col("received_at"), F.col("raw_line"))
    folder = folder or qualified(s, new_path(s, f"files-{kind}"))
    sinks.write_line_files(lines, folder, "job_id", "line_number", "raw_line", kind)
    return folder


def _parsed(s, d, kind):
    got = read_lines(s, _files(s, d, kind), split_bytes=1 << 16)
    job = F.regexp_extract("path", r"([^/]+)\.[a-z]+$", 1)
    loaded = load_layout_lines(got.select(job.alias("job_id"), "line_number", F.lit(kind).alias("file_format"), judged_line().alias("raw_line")))
    ok = loaded.valid.select("job_id", "line_number", "sequence_number", F.concat_ws(",", F.transform("cells", lambda c: c.cast("string"))).alias("cells"), F.lit(None).cast("string").alias("error_code"))
    return ok.unionByName(loaded.bad.select("job_id", "line_number", F.col("code").alias("error_code")), allowMissingColumns=True)


def _attest(s, d):
    """The import files by their relative paths, with their size and SHA-256, and a few paths that are refused."""
    folder = _files(s, d, "jsonl")
    jobs = table(s, d, "layout_import_lines").where("file_format = 'jsonl' and job_id is not null").select(F.concat("job_id", F.lit(".jsonl")).alias("path")).distinct()
    wrong = s.createDataFrame([("../out.csv",), ("/etc/x.csv",), ("a.txt",), ("none.csv",), ("",)], "path string")
    return attest_files(jobs.unionByName(wrong), folder, 1 << 30)


def _discover(s, d):
    """The images as files of their own, found again: contents with their size and files, and what is no picture."""
    h = lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    note = F.hex(F.encode(F.coalesce(digest_key(F.col("checksum_sha256")), F.lit("")), "UTF-8"))
    jpeg = F.concat(F.lit("ffd8ffc0000b08"), h(F.col("height"), 4), h(F.col("width"), 4), F.lit("01011100fffe"), h(F.length(note) / 2 + 2, 4), note, F.lit("ffd9"))
    content = F.when(F.col("error_code").isNull() & (F.col("width") > 0) & (F.col("height") > 0), jpeg).otherwise(F.lit("626164"))
    i = table(s, d, "source_images").where("relative_path is not null").select(path_key(F.col("relative_path")).alias("path"), content.alias("c"))
    i = i.groupBy("path").agg(F.max("c").alias("c"))
    more = i.where("path like '%7.jpg'").select(F.regexp_replace("path", "jpg$", "PNG").alias("path"), "c").unionByName(i.where("path like '%3.jpg'").select(F.regexp_replace("path", "jpg$", "txt").alias("path"), "c"))
    folder = new_path(s, "images")
    write_files(i.unionByName(more).select("path", F.unhex("c").alias("content")), folder)
    images, issues, ignored = discover_images(s, folder)
    one = images.select(F.lit("image").alias("kind"), F.col("sha256").alias("key"), F.get("files", F.lit(0)).alias("path"), F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")).alias("note"), F.size("files").cast("bigint").alias("n"))
    two = issues.select(F.lit("issue").alias("kind"), F.col("code").alias("key"), "path", F.lit("").alias("note"), F.lit(1).cast("bigint").alias("n"))
    return one.unionByName(two).unionByName(ignored.select(F.lit("ignored").alias("kind"), F.lit("").alias("key"), F.lit("").alias("path"), F.lit("").alias("note"), "n"))


def _published(s, d):
    folder = new_path(s, "dataset")
    sinks.publish(layouts(s, d).select("sequence_number", "signature"), folder, 1, table(s, d, "orders").count(), sort_by=["signature"], bloom="signature")
    return folder


def _snapshot(s, d):
    """A snapshot in ranges of the number, written, opened by its manifest and checked."""
    folder = new_path(s, "snapshot")
    full = layouts(s, d).select("sequence_number", "signature").join(payouts(s, d).select("sequence_number", "payout"), "sequence_number")
    sinks.publish(full, folder, 1, table(s, d, "orders").count(), sort_by=["sequence_number"])
    return sinks.open_version(s, folder, 1)


def _snapshot_checks(s, d):
    p = _snapshot(s, d)
    good = p.agg(F.count("*").alias("rows"), F.count_distinct("sequence_number").alias("numbers"), F.min("sequence_number").alias("lowest"), F.max("sequence_number").alias("highest"), F.count_if(F.col("payout") < 0).alias("negative"), F.count_if(~F.col("signature").rlike(r"^(0[1-9]|1[01]){15}\z")).alias("undecodable"), F.sum("payout").alias("total"))
    return good.withColumn("valid", (F.col("rows") == F.col("numbers")) & (F.col("lowest") == 1) & (F.col("highest") == F.col("rows")) & (F.col("negative") == 0) & (F.col("undecodable") == 0))


def _device_snapshot(s, d):
    path = new_path(s, "device") + "/snapshot.sqlite"
    full = layouts(s, d).select("sequence_number", "signature").join(payouts(s, d).select("sequence_number", "payout"), "sequence_number")
    write_snapshot(full, path, GAME)
    return path


def _upserted(s, d):
    folder = _published(s, d)
    change = layouts(s, d).where("sequence_number % 10 = 0").select((F.col("sequence_number") + 5).alias("sequence_number"), F.lit("changed").alias("signature"))
    sinks.upsert_version(s, folder, 1, change, ["sequence_number"])
    return sinks.open_version(s, folder, 2)


def _ignored(s, d):
    folder = _published(s, d)
    more = layouts(s, d).where("sequence_number % 10 = 0").select((F.col("sequence_number") + 5).alias("sequence_number"), F.lit("new").alias("signature"))
    sinks.insert_version(s, folder, 1, more, ["sequence_number"])
    return sinks.open_version(s, folder, 2).where("signature = 'new'")


def _delete_after(s, d):
    """Staged rows beyond a checkpoint are written again by the batch that was interrupted: a folder a batch."""
    folder = new_path(s, "staging")
    rows = payouts(s, d).select("sequence_number", "payout", F.floor((F.col("sequence_number") - 1) / 5000).alias("batch"))
    rows.write.partitionBy("batch").parquet(folder)
    again = rows.where("batch >= 1").withColumn("payout", F.col("payout") + 1)
    again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)
    return s.read.parquet(folder).groupBy("batch").agg(F.count("*").alias("n"), F.sum("payout").alias("total")).withColumn("batch", F.col("batch").cast("bigint"))


def _audit(s, d):
    path = new_path(s, "audit")
    sinks.write_audit(evaluate_payouts(layouts(s, d), GAME), path)
    return path


def _cohort(s, d):
    """The sure boards, frozen: a published version whose manifest has their number."""
    folder = new_path(s, "cohort")
    sure = boards(s, d).where("sequence_number is not null and board_confidence >= 0.9").select("id", "sequence_number")
    sinks.publish(sure, folder, 1, sort_by=["sequence_number", "id"])
    return sinks.open_version(s, folder, 1)


def _runs(s, d):
    """Events of a user as observations: the fingerprint is that of the type, with some bits of the value."""
    e = table(s, d, "events")
    kind = F.md5("event_type")
    noise = F.lpad(F.hex(F.pmod(F.floor("value"), F.lit(4))), 2, "0")
    return e.select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("order"), F.concat(F.substring(kind, 1, 30), noise).alias("fingerprint"), (F.col("value") / 500).alias("quality"), F.when(F.col("event_type") == "signup", 0.5).otherwise(0.9).alias("geometry"))


def _late(s, d):
    """Groups (boards by the first two cells) of which every third is resolved: an open one is closed by the first
    resolved one of the same range after it."""
    g = layouts(s, d).select("sequence_number", F.substring("signature", 1, 4).alias("range"))
    w = Window.partitionBy("range").orderBy(F.desc("sequence_number")).rowsBetween(Window.unboundedPreceding, -1)
    done = F.when(F.col("sequence_number") % 3 == 0, F.col("sequence_number"))
    return g.withColumn("closed_by", F.min(done).over(w)).where("sequence_number % 3 <> 0 and closed_by is not null").select("sequence_number", "closed_by")


def _finalize(s, d):
    """Per page: the three best boards, how many numbers they name, and the page's mode of the position."""
    b = R.top_k(boards(s, d), ["source_image_id"], 3, F.desc("board_confidence"), F.asc("position_index"), F.asc("id"))
    return b.groupBy("source_image_id").agg(F.count("*").alias("candidates"), F.count_distinct("sequence_number").alias("numbers"), F.min_by("id", "rank").alias("best")).withColumn("conflict", F.col("numbers") > 1)


def _payout_version(s, d):
    """Payouts of one version triple replaced by dynamic partition overwrite; the other versions stay."""
    folder = new_path(s, "payout-versions")
    p = payouts(s, d).select("sequence_number", "payout")
    for v in (1, 2):
        p.withColumn("rules_version", F.lit(v)).write.mode("append").partitionBy("rules_version").parquet(folder)
    p.withColumn("payout", F.col("payout") * 2).withColumn("rules_version", F.lit(2)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("rules_version").parquet(folder)
    return s.read.parquet(folder).groupBy("rules_version").agg(F.count("*").alias("n"), F.sum("payout").alias("total"))


def _affine(s, d):
    g = affine_layouts(s, table(s, d, "orders").count())
    return g.select("sequence_number", encode_signature(F.col("cells"), 2).alias("signature"))


def _raw(s, d):
    lines = table(s, d, "layout_import_lines")
    return R.latest_by(lines.select("job_id", "line_number", "raw_line", "received_at"), ["job_id", "line_number"], F.col("received_at"), F.col("raw_line"))


def _decode(s, d):
    """Lines of every job: all, those that are no UTF-8, and those that begin with a byte order mark."""
    bom = F.substring("raw_line", 1, 3) == F.lit(b"\xef\xbb\xbf")
    return _raw(s, d).groupBy("job_id").agg(F.count("*").alias("n"), F.count_if(~F.is_valid_utf8(F.col("raw_line").cast("string"))).alias("no_utf8"), F.count_if(bom).alias("with_bom"))


def _dispatch(s, d):
    """Valid and refused lines by the format that the line names."""
    got = load_layout_lines(table(s, d, "layout_import_lines"))
    kinds = table(s, d, "layout_import_lines").select("job_id", "line_number", "file_format").distinct()
    both = got.valid.select("job_id", "line_number", F.lit(1).alias("ok")).unionByName(got.bad.select("job_id", "line_number", F.lit(0).alias("ok")))
    return both.join(kinds, ["job_id", "line_number"]).groupBy("file_format").agg(F.sum("ok").alias("valid"), F.sum(1 - F.col("ok")).alias("refused"))


def _import(s, d):
    """Every job of both formats imported as one stream of micro-batches, of each file a megabyte, and what is staged then."""
    target, folder = new_path(s, "staged"), _files(s, d, "csv")
    _files(s, d, "jsonl", folder)
    q = import_stream(s, folder, None, None, target, new_path(s, "stream-checkpoint"), batch_bytes=1 << 20)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return s.read.parquet(target).select("job_id", "line_number", "sequence_number", "error_code")


def _compared(whole, other, runs):
    """For every run its observations and the groups that only one of two groupings has."""
    keys = ["run", "group_order", "first_order", "last_order", "source_count", "reference_order"]
    j = whole.select(*keys, F.lit(1).alias("a")).join(other.select(*keys, F.lit(1).alias("b")), keys, "full").groupBy("run").agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("different"))
    return runs.groupBy("run").agg(F.count("*").alias("observations")).join(j, "run", "left").select("run", "observations", F.coalesce("different", F.lit(0)).alias("different"))


def _resume(s, d):
    """Grouping that is broken off after 50 observations of every run and then goes on from its stored states, against
    one pass."""
    runs, folder = _runs(s, d), new_path(s, "grouping-states")
    group_with_checkpoints(runs, folder, stop_after=50).write.format("noop").mode("overwrite").save()
    return _compared(group_observations(runs), cut(group_with_checkpoints(runs, folder), "resumed"), runs)


def _group_stream(s, d):
    """Grouping as a stream of two deliveries, against one pass: the stream has all groups but those still open."""
    runs, folder, out = _runs(s, d), new_path(s, "observations"), new_path(s, "stream-groups")
    half = runs.agg(F.percentile_approx("order", 0.5)).first()[0] or 0
    for part in (runs.where(F.col("order") <= half), runs.where(F.col("order") > half)):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = s.readStream.schema(runs.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = group_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(s, "group-checkpoint")).trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    closed = s.read.schema(OUT).parquet(out)
    whole = group_observations(runs)
    n = closed.groupBy("run").agg(F.count("*").alias("n"))
    # What may be open at the end: the group itself, and one held back.
    settled = whole.join(n, "run", "left").where(F.col("group_order") < F.coalesce("n", F.lit(0))).drop("n")
    left = whole.groupBy("run").agg(F.count("*").alias("m")).join(n, "run", "left").where("m - coalesce(n, 0) not in (1, 2)").count()
    if left:
        raise RuntimeError(f"{left} runs have other than one or two open groups")
    return _compared(settled, closed, runs)


def _validation(s, d):
    """Staged boards of five jobs, some of them short or with a foreign symbol, checked by a cursor in batches."""
    n = F.col("sequence_number")
    cells_ = F.when(n % 83 == 0, F.slice("cells", 1, 14)).when(n % 79 == 0, F.concat(F.slice("cells", 1, 14), F.array(F.lit(12)))).otherwise(F.col("cells"))
    staged, target = new_path(s, "staged-boards"), new_path(s, "validated")
    rows = layouts(s, d).select(F.concat(F.lit("job-"), (n % 5).cast("string")).alias("job_id"), n.alias("line_number"), cells_.alias("cells"), F.lit(None).cast("string").alias("error_code"))
    rows.repartitionByRange(4, "line_number").write.parquet(staged)
    q = validation_stream(s, staged, target, new_path(s, "validation-checkpoint"), 15, list(range(1, 12)), 2)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return validation_progress(s, staged, target)


def _curated(s, d):
    """One page for every range of numbers, published under a name of its content, and the manifest of it."""
    ranges = boards(s, d).where("sequence_number is not null").groupBy(F.col("source_image_id").alias("id")).agg(F.min("sequence_number").alias("range_start"), F.max("sequence_number").alias("range_end"))
    one = ranges.groupBy("range_start", "range_end").agg(F.min("id").alias("id")).withColumn("content", F.encode(F.concat(F.lit("page:"), "id"), "UTF-8"))
    folder = publish_curated(one.select("range_start", "range_end", "content", F.sha2("content", 256).alias("sha256")), new_path(s, "curated"))
    return s.read.parquet(f"{folder}/manifest")


def _late_hash(s, d):
    """Groups of events of a user with a range by their number; those of a good best observation are resolved."""
    g = group_observations(_runs(s, d)).join(_runs(s, d).select("run", F.col("order").alias("reference_order"), "fingerprint"), ["run", "reference_order"])
    n = F.col("group_order") % 7
    return late_merge(g.select("run", "group_order", n.alias("range_start"), (n + 3).alias("range_end"), "fingerprint", (F.col("reference_quality") > 0.5).alias("resolved")))


QUERIES = {
    "src_decode_utf8": _decode,
    "src_format_dispatch": _dispatch,
    "src_prefix_chain": lambda s, d: prefix_chains(_raw(s, d), "job_id", "line_number", "raw_line"),
    "snk_upsert_payouts": lambda s, d: _payout_version(s, d),
    "stm_microbatch_import": _import,
    "stm_checkpoint_resume": _resume,
    "src_csv_layouts": lambda s, d: _parsed(s, d, "csv"),
    "src_jsonl_layouts": lambda s, d: _parsed(s, d, "jsonl"),
    "src_line_stream": lambda s, d: read_lines(s, _files(s, d, "csv"), split_bytes=1 << 16).groupBy(F.regexp_extract("path", r"([^/]+)\.[a-z]+$", 1).alias("job_id")).agg(F.count("*").alias("n"), F.max("line_number").alias("last_line"), F.max("byte_offset_end").alias("bytes")),
    "src_file_attest": _attest,
    "snk_curated_output": _curated,
    "stm_validation_cursor": _validation,
    "stm_group_stream": _group_stream,
    "stm_late_merge_hash": _late_hash,
    "src_table_scan_keyset": lambda s, d: table(s, d, "orders").where("o_orderkey > 500").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(1000),
    "src_image_files": _discover,
    "src_snapshot_open": lambda s, d: _snapshot(s, d),
    "src_generator_mock": lambda s, d: mock_layouts(s, 42).select("sequence_number", encode_signature(F.col("cells"), 2).alias("signature")),
    "src_generator_affine": _affine,
    "snk_upsert_rows": _upserted,
    "snk_insert_ignore": _ignored,
    "snk_insert_select": lambda s, d: sinks.open_version(s, _published(s, d), 1),
    "snk_delete_after": _delete_after,
    "snk_snapshot": _snapshot_checks,
    "snk_snapshot_sqlite": lambda s, d: read_snapshot(s, _device_snapshot(s, d)),
    "dom_snapshot_validate": lambda s, d: validate_snapshot(s, _device_snapshot(s, d)),
    "snk_audit_jsonl": lambda s, d: s.read.text(_audit(s, d)).select(F.get_json_object("value", "$.sequence_number").cast("bigint").alias("sequence_number"), F.get_json_object("value", "$.payout").cast("bigint").alias("payout")),
    "snk_audit_verify": lambda s, d: sinks.verify_audit(s, _audit(s, d), payouts(s, d)),
    "snk_cohort_export": _cohort,
    "stm_session_group": lambda s, d: group_observations(_runs(s, d)),
    "stm_late_merge": _late,
    "stm_finalize_group": _finalize,
}

_DIGEST = "nullif(regexp_replace(lower(trim(checksum_sha256, ' ' || chr(9) || chr(10) || chr(13))), '^sha256:', ''), '')"

SQL = {
    "src_decode_utf8": "WITH l AS (SELECT job_id, line_number, arg_max(raw_line, (received_at, raw_line)) AS r FROM layout_import_lines GROUP BY 1, 2) SELECT job_id, count(*) AS n, count(*) FILTER (try(decode(r)) IS NULL) AS no_utf8, count(*) FILTER (hex(r) LIKE 'EFBBBF%') AS with_bom FROM l GROUP BY 1",
    "src_prefix_chain": "WITH l AS (SELECT job_id, line_number, arg_max(raw_line, (received_at, raw_line)) AS r FROM layout_import_lines GROUP BY 1, 2) SELECT job_id, count(*) AS lines, list_reduce(list_prepend('', list(sha256(r) ORDER BY line_number)), lambda a, x: sha256(a || x)) AS chain FROM l GROUP BY 1",
    "snk_upsert_payouts": f"WITH {PAYOUTS} SELECT v AS rules_version, count(*) AS n, sum(payout * v)::bigint AS total FROM payouts, (VALUES (1), (2)) t(v) GROUP BY 1",
    "src_line_stream": "WITH l AS (SELECT job_id, line_number, arg_max(raw_line, (received_at, raw_line)) AS r FROM layout_import_lines WHERE file_format = 'csv' GROUP BY 1, 2) SELECT job_id, count(*) AS n, count(*) AS last_line, sum(octet_length(r) + 1)::bigint AS bytes FROM l GROUP BY 1",
    "src_table_scan_keyset": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500 ORDER BY 1 LIMIT 1000",
    "src_image_files": f"""WITH x AS (SELECT {_PLACE.format(c='relative_path')} AS path, CASE WHEN error_code IS NULL AND width > 0 AND height > 0 THEN
  'ffd8ffc0000b08' || format('{{:04x}}', height) || format('{{:04x}}', width) || '01011100fffe' || format('{{:04x}}', length(d) + 2) || hex(encode(d)) || 'ffd9' ELSE '626164' END AS c, width, height
  FROM (SELECT *, coalesce({_DIGEST}, '') AS d FROM source_images WHERE relative_path IS NOT NULL)),
f AS (SELECT path, max(c) AS c, arg_max(width, c) AS w, arg_max(height, c) AS h FROM x GROUP BY 1), b AS (SELECT *, sha256(unhex(c)) AS sha FROM f),
i AS (SELECT sha, first(path ORDER BY lower(path), path) AS path, any_value(w || 'x' || h) AS note, count(*) AS n FROM b WHERE c <> '626164' GROUP BY 1)
SELECT 'image' AS kind, sha AS key, path, note, n FROM i UNION ALL SELECT 'issue', 'IMAGE_SOURCE_UNREADABLE', path, '', 1 FROM b WHERE c = '626164'
UNION ALL SELECT 'issue', 'IMAGE_SOURCE_FORMAT_UNSUPPORTED', regexp_replace(path, 'jpg$', 'PNG'), '', 1 FROM f WHERE path LIKE '%7.jpg' UNION ALL SELECT 'ignored', '', '', '', count(*) FROM f WHERE path LIKE '%3.jpg'""",
    "src_file_attest": """WITH l AS (SELECT job_id, line_number, arg_max(raw_line, (received_at, raw_line)) AS r FROM layout_import_lines WHERE file_format = 'jsonl' AND job_id IS NOT NULL GROUP BY 1, 2),
f AS (SELECT job_id || '.jsonl' AS path, unhex(string_agg(hex(r) || '0A', '' ORDER BY line_number)) AS c FROM l GROUP BY 1)
SELECT path, 'jsonl' AS file_format, octet_length(c) AS size_bytes, sha256(c) AS sha256, NULL AS code FROM f
UNION ALL SELECT * FROM (VALUES ('../out.csv', NULL, NULL, NULL, 'IMPORT_SOURCE_PATH_INVALID'), ('/etc/x.csv', NULL, NULL, NULL, 'IMPORT_SOURCE_PATH_INVALID'), ('', NULL, NULL, NULL, 'IMPORT_SOURCE_PATH_INVALID'),
 ('a.txt', NULL, NULL, NULL, 'IMPORT_SOURCE_FORMAT_UNSUPPORTED'), ('none.csv', 'csv', NULL, NULL, 'IMPORT_SOURCE_NOT_FOUND'))""",
    "stm_checkpoint_resume": "SELECT user_id::varchar AS run, count(*) AS observations, 0 AS different FROM events GROUP BY 1",
    "stm_group_stream": "SELECT user_id::varchar AS run, count(*) AS observations, 0 AS different FROM events GROUP BY 1",
    "stm_validation_cursor": f"""WITH {LAYOUTS} SELECT 'job-' || sequence_number % 5 AS job_id, count(*) AS total, count(*) AS processed, count(*) FILTER (sequence_number % 83 <> 0 AND sequence_number % 79 <> 0) AS succeeded,
 count(*) FILTER (sequence_number % 83 = 0 OR sequence_number % 79 = 0) AS failed, max(sequence_number) AS line_number, true AS complete FROM boards GROUP BY 1""",
    "snk_curated_output": f"""WITH {BOARDS}, r AS (SELECT source_image_id AS id, min(sequence_number) AS a, max(sequence_number) AS b FROM rb WHERE sequence_number IS NOT NULL GROUP BY 1), o AS (SELECT a, b, min(id) AS id FROM r GROUP BY 1, 2),
s AS (SELECT *, sha256('page:' || id) AS h FROM o) SELECT a AS range_start, b AS range_end, 'seq_' || lpad(a::varchar, greatest(length(a::varchar), 6)::int, '0') || '-' || lpad(b::varchar, greatest(length(b::varchar), 6)::int, '0') || '__' || substr(h, 1, 12) || '.jpg' AS name,
 h AS sha256, 5 + octet_length(encode(id)) AS size_bytes FROM s""",
    "src_snapshot_open": f"WITH {PAYOUTS} SELECT b.sequence_number, signature, payout FROM boards b JOIN payouts p ON b.sequence_number = p.sequence_number",
    "src_generator_affine": "WITH g AS (SELECT i AS sequence_number, (((i - 1)::hugeint * 1234567891011 + 987654321) % 4177248169415651) AS code FROM range(1, (SELECT count(*) + 1 FROM orders)) r(i)) SELECT sequence_number, array_to_string(list_transform(range(0, 15), lambda k: lpad(((code // power(11::hugeint, 14 - k)::hugeint) % 11 + 1)::varchar, 2, '0')), '') AS signature FROM g",
    "snk_upsert_rows": f"WITH {LAYOUTS}, c AS (SELECT sequence_number + 5 AS sequence_number, 'changed' AS signature FROM boards WHERE sequence_number % 10 = 0) SELECT sequence_number, signature FROM boards WHERE sequence_number NOT IN (SELECT sequence_number FROM c) UNION ALL SELECT * FROM c",
    "snk_insert_ignore": f"WITH {LAYOUTS} SELECT sequence_number + 5 AS sequence_number, 'new' AS signature FROM boards WHERE sequence_number % 10 = 0 AND sequence_number + 5 NOT IN (SELECT sequence_number FROM boards)",
    "snk_insert_select": f"WITH {LAYOUTS} SELECT sequence_number, signature FROM boards",
    "snk_delete_after": f"WITH {PAYOUTS} SELECT (sequence_number - 1) // 5000 AS batch, count(*) AS n, sum(payout + CASE WHEN sequence_number > 5000 THEN 1 ELSE 0 END)::bigint AS total FROM payouts GROUP BY 1",
    "snk_snapshot": f"WITH {PAYOUTS} SELECT count(*) AS rows, count(*) AS numbers, min(sequence_number) AS lowest, max(sequence_number) AS highest, 0 AS negative, 0 AS undecodable, sum(payout)::bigint AS total, true AS valid FROM payouts",
    "snk_snapshot_sqlite": f"WITH {PAYOUTS} SELECT b.sequence_number, signature, payout FROM boards b JOIN payouts p ON b.sequence_number = p.sequence_number",
    "dom_snapshot_validate": "SELECT count(*) AS layouts, count(*) AS declared, 1 AS first, count(*) AS last, true AS contiguous, 0 AS negative, 0 AS undecodable, 0 AS unknown_symbols, true AS checksum_equal, true AS valid FROM orders",
    "snk_audit_jsonl": f"WITH {PAYOUTS} SELECT sequence_number, payout FROM payouts",
    "snk_audit_verify": f"WITH {PAYOUTS} SELECT count(*) AS audited, 0 AS broken, 0 AS wrong_sums, 0 AS different FROM payouts",
    "snk_cohort_export": f"WITH {BOARDS} SELECT id, sequence_number FROM rb WHERE sequence_number IS NOT NULL AND board_confidence >= 0.9",
    "stm_late_merge": f"WITH {LAYOUTS}, g AS (SELECT sequence_number, substr(signature, 1, 4) AS range FROM boards) SELECT * FROM (SELECT sequence_number, min(CASE WHEN sequence_number % 3 = 0 THEN sequence_number END) OVER (PARTITION BY range ORDER BY sequence_number ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS closed_by FROM g) WHERE sequence_number % 3 <> 0 AND closed_by IS NOT NULL",
    "stm_finalize_group": f"WITH {BOARDS}, k AS (SELECT *, row_number() OVER (PARTITION BY source_image_id ORDER BY board_confidence DESC NULLS LAST, position_index, id) AS rank FROM rb) SELECT source_image_id, count(*) AS candidates, count(DISTINCT sequence_number) AS numbers, arg_min(id, rank) AS best, count(DISTINCT sequence_number) > 1 AS conflict FROM k WHERE rank <= 3 GROUP BY 1",
}
