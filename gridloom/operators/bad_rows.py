"""Loading lines strictly, and saying of every other line why it was not loaded.

A line is known by its offset, (table, job, line number). The strict load takes the lines that conform and types
them; the raw offsets minus the loaded ones (an anti-join) are the remainder, and only the remainder is diagnosed.

The load has two steps. Nearly all lines have the plain form the exporters write, and expressions inside the JVM
recognise and type them. What is unusual goes through the exact contract in Arrow batches: it may still conform
(other key order, white space, escapes, quoted numbers).
"""

from __future__ import annotations

import csv
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import cut, pick

# The header, keys, limits and error codes of the line contract.
CSV_HEADER = ["schema_version", "sequence_number", "cells"]
JSON_KEYS = {"schemaVersion", "sequenceNumber", "cells"}
SCHEMA_VERSION, MAX_SEQUENCE, MAX_CODE = 1, 2**63 - 1, 32_767
ERROR_CODES = (
    "import_format_unsupported", "import_encoding_invalid", "import_encoding_bom_forbidden", "import_header_invalid", "import_record_invalid",
    "import_schema_version_unsupported", "import_sequence_number_invalid", "import_cells_invalid", "import_cell_count_mismatch", "import_symbol_not_in_rules",
)
FORMAT, ENCODING, BOM, HEADER, RECORD, VERSION, SEQUENCE, CELLS = ERROR_CODES[:8]
GROUP, COUNT = "duplicate_sequence_group", "error_code_count"


class Refused(Exception):
    """A line breaks the contract; the argument is the code."""


# --- layout lines -----------------------------------------------------------------------------------------------


def _text(raw: bytes) -> str:
    if raw[:3] == b"\xef\xbb\xbf":
        raise Refused(BOM)
    try:
        return raw.decode("utf-8").rstrip("\r\n")
    except UnicodeDecodeError:
        raise Refused(ENCODING) from None


def _csv_fields(text: str, code: str) -> list[str]:
    try:
        records = list(csv.reader([text], strict=True))
    except csv.Error:
        raise Refused(code) from None
    if len(records) != 1 or not text.strip():
        raise Refused(code)
    return records[0]


def _digits(value: str, code: str) -> int:
    if not (value.isascii() and value.isdecimal()):
        raise Refused(code)
    significant = value.lstrip("0")
    if len(significant) > 19:
        raise Refused(code)
    return int(significant or "0")


def _unique(pairs):
    keys = [k for k, _ in pairs]
    if len(set(keys)) < len(keys):
        raise Refused(RECORD)
    return dict(pairs)


def _json(text: str, code: str):
    try:
        return json.loads(text, object_pairs_hook=_unique if code == RECORD else None)
    except (ValueError, RecursionError):  # no JSON, or numbers and nesting beyond any valid line
        raise Refused(code) from None


def _checked(version, sequence, cells) -> tuple[int, list[int]]:
    if type(version) is not int or version != SCHEMA_VERSION:
        raise Refused(VERSION)
    if type(sequence) is not int or not 1 <= sequence <= MAX_SEQUENCE:
        raise Refused(SEQUENCE)
    return sequence, _cells(cells)


def _cells(cells) -> list[int]:
    if type(cells) is not list or not cells or not all(type(c) is int and 1 <= c <= MAX_CODE for c in cells):
        raise Refused(CELLS)
    return cells


def layout_line(file_format: str | None, line_number: int | None, raw: bytes | None) -> tuple[int | None, list[int] | None]:
    """(sequence_number, cells) of one line, (None, None) of a valid header; raises :class:`Refused`."""
    raw = raw or b""
    if file_format == "csv":
        if line_number == 1:
            if _csv_fields(_text(raw), HEADER) != CSV_HEADER:
                raise Refused(HEADER)
            return None, None
        fields = _csv_fields(_text(raw), RECORD)
        if len(fields) != 3:
            raise Refused(RECORD)
        if _digits(fields[0], VERSION) != SCHEMA_VERSION:
            raise Refused(VERSION)
        sequence = _digits(fields[1], SEQUENCE)
        if not 1 <= sequence <= MAX_SEQUENCE:
            raise Refused(SEQUENCE)
        return sequence, _cells(_json(fields[2], CELLS))
    if file_format == "jsonl":
        value = _json(_text(raw), RECORD)
        if type(value) is not dict or set(value) != JSON_KEYS:
            raise Refused(RECORD)
        return _checked(value["schemaVersion"], value["sequenceNumber"], value["cells"])
    raise Refused(FORMAT)


# --- report lines -----------------------------------------------------------------------------------------------


def strict_fields(line: str) -> list[str]:
    """Fields of a strict CSV line: a field that begins with a quote ends with one, doubled quotes inside stand for
    one, and only a comma or the end may follow. Nothing is trimmed. Raises :class:`Refused` ("quoting")."""
    fields, at = [], 0
    while True:
        if line[at : at + 1] == '"':
            value, at = [], at + 1
            while True:
                end = line.find('"', at)
                if end < 0:
                    raise Refused("quoting")
                value.append(line[at:end])
                if line[end + 1 : end + 2] != '"':
                    break
                value.append('"')
                at = end + 2
            fields.append("".join(value))
            at = end + 1
            if at == len(line):
                return fields
            if line[at] != ",":
                raise Refused("quoting")
            at += 1
        else:
            end = line.find(",", at)
            fields.append(line[at:] if end < 0 else line[at:end])
            if end < 0:
                return fields
            at = end + 1


def _at_least(value: str, least: int) -> int:
    if not (value.isascii() and value.isdigit()):
        raise Refused("value")
    value = value.lstrip("0") or "0"
    if len(value) < 20 and int(value) < least:
        raise Refused("value")
    return int(value) if len(value) <= 4000 else 10**4000


def report_line(kind: str | None, line: str | None) -> tuple:
    """(sequence_number, occurrence_count, line_numbers, truncated, code, count); raises :class:`Refused`."""
    fields = strict_fields(line or "")
    if len(fields) != {GROUP: 4, COUNT: 2}.get(kind, -1):
        raise Refused("column_count")
    if kind == COUNT:
        if fields[0] not in ERROR_CODES:
            raise Refused("value")
        return None, None, None, None, fields[0], _at_least(fields[1], 0)
    sequence, times = _at_least(fields[0], 1), _at_least(fields[1], 2)
    try:
        numbers = json.loads(fields[2])
    except (ValueError, RecursionError):
        raise Refused("value") from None
    if type(numbers) is not list or not numbers or not all(type(n) is int and n >= 1 for n in numbers) or any(a >= b for a, b in zip(numbers, numbers[1:], strict=False)):
        raise Refused("value")
    if fields[3] not in ("true", "false"):
        raise Refused("value")
    return sequence, times, numbers, fields[3] == "true", None, None


# --- the operator -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Loaded:
    """``valid``: typed rows with their offsets. ``bad``: (raw_table, job_id, line_number, code), each offset once."""

    valid: DataFrame
    bad: DataFrame


def _once(lines: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """One row an offset. Of a redelivered line whose content differs, the one that arrived last counts (then the
    largest content), as an upsert by offset would leave it."""
    order = F.struct(F.col("received_at"), *[F.col(c) for c in content]) if "received_at" in lines.columns else F.struct(*[F.col(c) for c in content])
    return lines.groupBy(*keys).agg(F.max_by(F.struct(*content), order).alias("_c")).select(*keys, *[F.col(f"_c.{c}").alias(c) for c in content])


def load_layout_lines(lines: DataFrame, table: str = "layout_import_lines") -> Loaded:
    """Strict load of ``(job_id, line_number, file_format, raw_line binary)``.

    ``valid``: (job_id, line_number, sequence_number, cells); headers are no rows. Lines of nothing but white space
    are neither valid nor bad. Defined results: a null raw_line is a blank line; a null or foreign file_format is
    ``import_format_unsupported``; a null job_id or line_number is an offset like any other; redelivered lines count
    once; extra columns are ignored; an empty table gives two empty tables.
    """
    lines = pick(lines, "job_id", "line_number", "file_format", "raw_line", optional=("received_at",))
    raw = F.coalesce("raw_line", F.lit(b""))
    text = F.decode(F.col("raw_line"), "ISO-8859-1")  # a byte is a character: no line fails here
    lines = lines.select("job_id", "line_number", "file_format", raw.alias("raw_line"), *[c for c in ["received_at"] if c in lines.columns])
    lines = cut(_once(lines.where(~text.rlike(r"^[ \t\n\r\x0b\x0c\x1c-\x1f]*\z")), ["job_id", "line_number"], ["file_format", "raw_line"]), "lines")

    # One regular expression a line: what matches becomes its two parts behind a mark, all else stays as it is. Nothing is
    # filtered before the table is written, as a filter would work all of this out once more.
    line, mark = F.decode(F.col("raw_line"), "ISO-8859-1"), "\x01"
    csv_form = r'^1,([1-9][0-9]{0,17}),"\[([1-9][0-9]{0,4}(?:,[1-9][0-9]{0,4})*)\]"[\r\n]*\z'
    json_form = r'^\{"schemaVersion":1,"sequenceNumber":([1-9][0-9]{0,17}),"cells":\[([1-9][0-9]{0,4}(?:,[1-9][0-9]{0,4})*)\]\}[\r\n]*\z'
    header = (F.col("file_format") == "csv") & (F.col("line_number") == 1)
    parts = lambda form: F.regexp_replace(line, form, mark + "$1;$2")
    first = lines.select("job_id", "line_number", F.when(header, F.lit(None)).when(F.col("file_format") == "csv", parts(csv_form)).when(F.col("file_format") == "jsonl", parts(json_form)).alias("_x"))
    hit = F.startswith("_x", F.lit(mark))
    number = F.when(hit, F.substring_index(F.substring("_x", 2, 19), ";", 1).try_cast("bigint"))
    cells = F.when(hit, F.split(F.substring_index("_x", ";", -1), ",").try_cast("array<int>"))
    first = first.select("job_id", "line_number", number.alias("_s"), cells.alias("cells"))
    good = F.array_max("cells") <= MAX_CODE
    first = cut(first.select("job_id", "line_number", F.when(good, F.col("_s")).alias("sequence_number"), F.when(good, F.col("cells")).alias("cells")), "lines-loaded")
    first = first.where("sequence_number is not null")

    here = [F.col("r.job_id").eqNullSafe(F.col("l.job_id")), F.col("r.line_number").eqNullSafe(F.col("l.line_number"))]
    rest = lines.alias("r").join(first.select("job_id", "line_number").alias("l"), here, "left_anti")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences, cells, codes = [], [], []
            for number, kind, line in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                try:
                    s, c = layout_line(kind, number, line)
                    got = (s, c, None)
                except Refused as e:
                    got = (None, None, e.args[0])
                for to, x in zip((sequences, cells, codes), got, strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sequences, pa.int64()), pa.array(cells, pa.list_(pa.int32())), pa.array(codes, pa.string())], names=["job_id", "line_number", "sequence_number", "cells", "code"])

    schema = "job_id string, line_number bigint, sequence_number bigint, cells array<int>, code string"
    judged = cut(rest.select("job_id", F.col("line_number").cast("bigint"), "file_format", "raw_line").mapInArrow(exact, schema), "lines-remainder")
    valid = first.unionByName(judged.where("code is null and sequence_number is not null").drop("code"))
    bad = judged.where("code is not null").select(F.lit(table).alias("raw_table"), "job_id", "line_number", "code")
    return Loaded(valid, bad)


def load_report_lines(lines: DataFrame, table: str = "import_report_lines") -> Loaded:
    """Strict load of ``(job_id, line_number, record_kind, raw_line string)``.

    ``valid``: (job_id, line_number, record_kind, sequence_number, occurrence_count, line_numbers, truncated, code,
    count), the columns of the other kind null; numbers beyond a bigint are valid and typed as null. Reasons are
    ``quoting``, ``column_count`` and ``value``, the first that holds. Defined results: a null or blank line has too
    few columns; an unknown record kind fits no number of columns; otherwise as for layout lines.
    """
    lines = pick(lines, "job_id", "line_number", "record_kind", "raw_line", optional=("received_at",))
    src = lines.select("job_id", "line_number", "record_kind", F.coalesce("raw_line", F.lit("")).alias("raw_line"), *[c for c in ["received_at"] if c in lines.columns])
    src = cut(_once(src, ["job_id", "line_number"], ["record_kind", "raw_line"]), "report-lines")
    group_form = r'^([1-9][0-9]{0,17}),([1-9][0-9]{0,17}),"\[([1-9][0-9]{0,17}(?:,[1-9][0-9]{0,17})*)\]",(true|false)\z'
    count_form = r"^([a-z_]+),(0|[1-9][0-9]{0,17})\z"
    g = lambda n: F.regexp_extract("raw_line", group_form, n)
    one = src.where((F.col("record_kind") == GROUP) & (g(1) != "")).select(
        "job_id", "line_number", "record_kind", g(1).cast("bigint").alias("sequence_number"), g(2).cast("bigint").alias("occurrence_count"),
        F.from_json(F.concat(F.lit("["), g(3), F.lit("]")), "array<bigint>").alias("line_numbers"), (g(4) == "true").alias("truncated"),
        F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("count"))
    one = one.where((F.col("occurrence_count") >= 2) & F.forall(F.sequence(F.lit(1), F.size("line_numbers")), lambda i: (i == 1) | (F.get("line_numbers", i - 1) > F.get("line_numbers", i - 2))))
    c = lambda n: F.regexp_extract("raw_line", count_form, n)
    two = src.where((F.col("record_kind") == COUNT) & c(1).isin(*ERROR_CODES)).select("job_id", "line_number", "record_kind", c(1).alias("code"), c(2).cast("bigint").alias("count"))
    first = cut(one.unionByName(two, allowMissingColumns=True), "report-loaded")
    here = [F.col("r.job_id").eqNullSafe(F.col("l.job_id")), F.col("r.line_number").eqNullSafe(F.col("l.line_number"))]
    rest = src.alias("r").join(first.select("job_id", "line_number").alias("l"), here, "left_anti")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits = lambda x: x if x is None or type(x) is not int or x < 2**63 else None
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for kind, line in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                try:
                    row = [*report_line(kind, line), None]
                    row[2] = None if row[2] is None or any(fits(x) is None for x in row[2]) else row[2]
                except Refused as e:
                    row = [None] * 6 + [e.args[0]]
                for to, x in zip(out, row, strict=True):
                    to.append(fits(x))
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.string(), pa.int64(), pa.string()]
            names = ["sequence_number", "occurrence_count", "line_numbers", "truncated", "code", "count", "reason"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(x, t) for x, t in zip(out, types, strict=True)]], names=["job_id", "line_number", "record_kind", *names])

    schema = "job_id string, line_number bigint, record_kind string, sequence_number bigint, occurrence_count bigint, line_numbers array<bigint>, truncated boolean, code string, count bigint, reason string"
    judged = cut(rest.select("job_id", F.col("line_number").cast("bigint"), "record_kind", "raw_line").mapInArrow(exact, schema), "report-remainder")
    valid = first.unionByName(judged.where("reason is null").drop("reason"))
    bad = judged.where("reason is not null").select(F.lit(table).alias("raw_table"), "job_id", "line_number", F.col("reason").alias("code"))
    return Loaded(valid, bad)
