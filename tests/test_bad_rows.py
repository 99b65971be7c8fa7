import csv
import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gridloom.operators.bad_rows import Refused, layout_line, load_layout_lines, load_report_lines, report_line, strict_fields
from tests.conftest import rows

LINES = [
    (1, "csv", b"schema_version,sequence_number,cells\r", None), (2, "csv", b'1,5,"[1,2,3]"', (5, [1, 2, 3])), (3, "csv", b'"1","007","[ 1 , 2 ]"\r', (7, [1, 2])), (4, "csv", b"   ", "blank"), (5, "csv", b"\t\r", "blank"),
    (6, "csv", b'2,5,"[1]"', "import_schema_version_unsupported"), (7, "csv", b'1,0,"[1]"', "import_sequence_number_invalid"), (8, "csv", b'1,9223372036854775808,"[1]"', "import_sequence_number_invalid"),
    (9, "csv", b'1,9223372036854775807,"[32767]"', (2**63 - 1, [32767])), (10, "csv", b'1,5,"[32768]"', "import_cells_invalid"), (11, "csv", b'1,5,"[]"', "import_cells_invalid"), (12, "csv", b"1,5,[1,2]", "import_record_invalid"),
    (13, "csv", b'1,5,"[1,2]', "import_record_invalid"), (14, "csv", b"\xef\xbb\xbf1,5,[1]", "import_encoding_bom_forbidden"), (15, "csv", b'1,5,"[1]\xff"', "import_encoding_invalid"), (16, "csv", "1,٥,[1]".encode(), "import_sequence_number_invalid"),
    (17, "csv", b"1,5,[true]", "import_cells_invalid"), (18, "csv", b"1,5,[1.0]", "import_cells_invalid"), (19, "csv", b"1,5,7", "import_cells_invalid"), (20, "csv", b"1,5,[1]", (5, [1])), (21, "csv", b"1,5,[[1]]", "import_cells_invalid"),
    (1, "jsonl", b'{"schemaVersion":1,"sequenceNumber":5,"cells":[1,2]}', (5, [1, 2])), (2, "jsonl", b' {"cells":[1],"sequenceNumber":9,"schemaVersion":1} \r', (9, [1])), (3, "jsonl", b'{"schemaVersion":1,"sequenceNumber":5,"cells":[1],"cells":[1]}', "import_record_invalid"),
    (4, "jsonl", b'{"schemaVersion":true,"sequenceNumber":5,"cells":[1]}', "import_schema_version_unsupported"), (5, "jsonl", b'{"schemaVersion":1,"sequenceNumber":5.0,"cells":[1]}', "import_sequence_number_invalid"), (6, "jsonl", b"[1]", "import_record_invalid"),
    (7, "jsonl", b'{"schemaVersion":1,"sequenceNumber":5,"cells":[1],"x":1}', "import_record_invalid"), (8, "jsonl", b"{" * 5000, "import_record_invalid"), (9, "jsonl", b'{"schemaVersion":1,"sequenceNumber":' + b"1" * 6000 + b',"cells":[1]}', "import_record_invalid"),
    (10, "jsonl", b'{"schemaVersion":1,"sequenceNumber":5,"c\\u0065lls":[1]}', (5, [1])), (11, "xml", b"<a/>", "import_format_unsupported"), (12, None, b"x", "import_format_unsupported"), (13, "jsonl", None, "blank"),
]


def test_layout_lines(spark):
    data = [(f"job-{f}", n, f, raw, "x") for n, f, raw, _ in LINES]
    data += data[:8]  # redelivered
    df = spark.createDataFrame(data, "job_id string, line_number bigint, file_format string, raw_line binary, CODE string")
    got = load_layout_lines(df)
    valid = {(r["job_id"], r["line_number"]): (r["sequence_number"], r["cells"]) for r in got.valid.collect()}
    bad = {(r["job_id"], r["line_number"]): r["code"] for r in got.bad.collect()}
    assert valid == {(f"job-{f}", n): w for n, f, _, w in LINES if isinstance(w, tuple)}
    assert bad == {(f"job-{f}", n): w for n, f, _, w in LINES if isinstance(w, str) and w != "blank"}
    assert got.bad.count() == len(bad) and got.valid.count() == len(valid)
    empty = load_layout_lines(df.limit(0))
    assert empty.valid.count() == 0 and empty.bad.count() == 0


def test_layout_lines_with_null_offsets_and_bad_header(spark):
    df = spark.createDataFrame([(None, None, "csv", b"1,5,[1]"), ("j", 1, "csv", b"schema_version;cells"), ("j", 2, "csv", b'1,5,"[1,2]"')], "job_id string, line_number bigint, file_format string, raw_line binary")
    got = load_layout_lines(df)
    assert rows(got.bad.select("job_id", "line_number", "code")) == [("j", 1, "import_header_invalid")]
    assert rows(got.valid.select("job_id", "line_number", "sequence_number")) == [("j", 2, 5), (None, None, 5)]


def test_last_delivery_counts(spark):
    df = spark.createDataFrame([("j", 2, "csv", b"bad", 1), ("j", 2, "csv", b"1,5,[1]", 2)], "job_id string, line_number bigint, file_format string, raw_line binary, received_at int")
    assert load_layout_lines(df).bad.count() == 0


REPORT = [
    ("duplicate_sequence_group", '5,2,"[1,2]",true', None), ("duplicate_sequence_group", '05,2,"[1, 2]",false', None), ("duplicate_sequence_group", "5,2,[1],false", None), ("duplicate_sequence_group", '5,2,"[2,1]",true', "value"),
    ("duplicate_sequence_group", '5,1,"[1]",true', "value"), ("duplicate_sequence_group", '5,2,"[1]" ,true', "quoting"), ("duplicate_sequence_group", '5,2,"[1],true', "quoting"), ("duplicate_sequence_group", "5,2,[1,2],true", "column_count"),
    ("duplicate_sequence_group", '5,2,"[1]",True', "value"), ("duplicate_sequence_group", '5,2,"[]",true', "value"), ("duplicate_sequence_group", ' 5,2,"[1]",true', "value"), ("duplicate_sequence_group", '5,2,"[1]",true\r', "value"),
    ("duplicate_sequence_group", '99999999999999999999999,2,"[1]",true', None), ("duplicate_sequence_group", '5,2,"[1.0]",true', "value"), ("duplicate_sequence_group", '5,2,"[true]",true', "value"),
    ("error_code_count", "import_cells_invalid,3", None), ("error_code_count", '"import_cells_invalid","0"', None), ("error_code_count", "cells,3", "value"), ("error_code_count", "import_cells_invalid,-1", "value"),
    ("error_code_count", "import_cells_invalid", "column_count"), ("error_code_count", "", "column_count"), ("error_code_count", None, "column_count"), ("other", "a,b", "column_count"), (None, '"', "quoting"),
]


def test_report_lines(spark):
    df = spark.createDataFrame([("j", i, k, line) for i, (k, line, _) in enumerate(REPORT)] * 2, "job_id string, line_number bigint, record_kind string, raw_line string")
    got = load_report_lines(df)
    assert {r["line_number"]: r["code"] for r in got.bad.collect()} == {i: c for i, (_, _, c) in enumerate(REPORT) if c}
    valid = {r["line_number"]: r for r in got.valid.collect()}
    assert set(valid) == {i for i, (_, _, c) in enumerate(REPORT) if not c}
    assert valid[0]["line_numbers"] == [1, 2] and valid[0]["truncated"] is True and valid[1]["sequence_number"] == 5 and valid[12]["sequence_number"] is None
    assert load_report_lines(df.limit(0)).bad.count() == 0


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.text(alphabet='ab," []1', max_size=6), min_size=1, max_size=4))
def test_strict_fields_reads_what_csv_writes(fields):
    line = ",".join('"' + f.replace('"', '""') + '"' for f in fields)
    assert strict_fields(line) == fields == next(csv.reader([line], strict=True))


@settings(max_examples=200, deadline=None)
@given(st.integers(-3, 2**64), st.lists(st.integers(-1, 40000), max_size=3))
def test_json_lines(sequence, cells):
    raw = json.dumps({"cells": cells, "sequenceNumber": sequence, "schemaVersion": 1}).encode()
    ok = 1 <= sequence < 2**63 and cells and all(1 <= c <= 32767 for c in cells)
    try:
        assert layout_line("jsonl", 1, raw) == (sequence, cells) and ok
    except Refused:
        assert not ok


def test_report_line_long_number():
    assert report_line("error_code_count", "import_cells_invalid," + "9" * 10_000)[5] > 0
