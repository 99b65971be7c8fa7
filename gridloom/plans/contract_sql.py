"""The line contracts, and the grouping of a run, as SQL for the comparison with another engine."""

from __future__ import annotations

from gridloom.operators.bad_rows import ERROR_CODES

_BLANKS = r"[ \t\n\r]*"
_FIELD = r'("(?:[^"]|"")*"|[^,"\r\n][^,\r\n]*|)'
_REPORT_FIELD = r'("(?:[^"]|"")*"|[^,"][^,]*|)'
_CELLS = rf"{_BLANKS}\[{_BLANKS}[1-9][0-9]{{0,4}}(?:{_BLANKS},{_BLANKS}[1-9][0-9]{{0,4}})*{_BLANKS}\]{_BLANKS}"
_NUMBERS = rf"{_BLANKS}\[{_BLANKS}[1-9][0-9]*(?:{_BLANKS},{_BLANKS}[1-9][0-9]*)*{_BLANKS}\]{_BLANKS}"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _bare(field: str) -> str:
    return f"CASE WHEN starts_with({field}, '\"') THEN replace({field}[2:-2], '\"\"', '\"') ELSE {field} END"


def _row(field: str, n: int) -> str:
    return ",".join([field] * n)


def _digits(c: str) -> str:
    return f"list_transform(regexp_extract_all({c}, '[0-9]+'), lambda v: try_cast(v AS int))"


_THREE, _JSON_CELLS = _row(_FIELD, 3), "(j->'$.cells')::varchar"
_IN_RANGE = "BETWEEN 1 AND 9223372036854775807"


def judged(source: str = "layout_import_lines") -> str:
    """CTEs up to ``judged(job_id, line_number, f, code, s, cells, header)`` of all lines of ``source`` but blank ones."""
    return f"""lines_ AS (SELECT job_id, line_number, arg_max({{'f': file_format, 'r': raw_line}}, (received_at, file_format, raw_line)) AS c FROM {source}
  WHERE NOT regexp_full_match(hex(coalesce(raw_line, ''::blob)), '(20|09|0A|0D|0B|0C|1C|1D|1E|1F)*') GROUP BY 1, 2),
texts AS (SELECT job_id, line_number, c.f AS f, starts_with(hex(c.r), 'EFBBBF') AS bom, rtrim(try(decode(c.r)), chr(13) || chr(10)) AS t FROM lines_),
fields AS (SELECT *, f = 'csv' AND regexp_full_match(t, {_text(_THREE)}) AS three, regexp_extract(t, {_text('^' + _THREE + '$')}, ['a', 'b', 'c']) AS x,
  f = 'jsonl' AND coalesce(try(json_valid(t)), false) AND NOT regexp_matches(t, ',{_BLANKS}[\\]}}]') AS json FROM texts),
parts AS (SELECT job_id, line_number, f, bom, t, three, {_bare('x.a')} AS a, {_bare('x.b')} AS b, {_bare('x.c')} AS c, CASE WHEN json AND json_type(t) = 'OBJECT' THEN t::json END AS j FROM fields),
judged AS (SELECT job_id, line_number, f, CASE
  WHEN f IS NULL OR f NOT IN ('csv', 'jsonl') THEN 'import_format_unsupported' WHEN bom THEN 'import_encoding_bom_forbidden' WHEN t IS NULL THEN 'import_encoding_invalid'
  WHEN f = 'csv' AND line_number = 1 THEN CASE WHEN three AND [a, b, c] = ['schema_version', 'sequence_number', 'cells'] THEN NULL ELSE 'import_header_invalid' END
  WHEN f = 'csv' THEN CASE WHEN NOT three THEN 'import_record_invalid' WHEN NOT regexp_full_match(a, '0*1') THEN 'import_schema_version_unsupported'
    WHEN NOT (regexp_full_match(b, '[0-9]+') AND length(ltrim(b, '0')) <= 19 AND coalesce(try_cast(b AS hugeint), 0) {_IN_RANGE}) THEN 'import_sequence_number_invalid'
    WHEN NOT regexp_full_match(c, {_text(_CELLS)}) OR list_max({_digits('c')}) > 32767 THEN 'import_cells_invalid' END
  WHEN j IS NULL OR list_sort(json_keys(j)) <> ['cells', 'schemaVersion', 'sequenceNumber'] THEN 'import_record_invalid'
  WHEN json_type(j, '$.schemaVersion') <> 'UBIGINT' OR j->>'$.schemaVersion' <> '1' THEN 'import_schema_version_unsupported'
  WHEN json_type(j, '$.sequenceNumber') <> 'UBIGINT' OR NOT (j->>'$.sequenceNumber')::hugeint {_IN_RANGE} THEN 'import_sequence_number_invalid'
  WHEN json_type(j, '$.cells') <> 'ARRAY' OR NOT regexp_full_match({_JSON_CELLS}, {_text(_CELLS)}) OR list_max({_digits(_JSON_CELLS)}) > 32767 THEN 'import_cells_invalid' END AS code,
  CASE WHEN f = 'csv' THEN try_cast(b AS bigint) ELSE try_cast(j->>'$.sequenceNumber' AS bigint) END AS s, {_digits(f"CASE WHEN f = 'csv' THEN c ELSE {_JSON_CELLS} END")} AS cells,
  f = 'csv' AND line_number = 1 AS header FROM parts)"""


def files(kind: str) -> str:
    """A CTE ``src`` with the lines of the import files of a kind as they stand in the files, numbered from 1."""
    return f"""last_ AS (SELECT job_id, line_number, arg_max(raw_line, (received_at, raw_line)) AS raw_line FROM layout_import_lines WHERE file_format = '{kind}' AND job_id IS NOT NULL GROUP BY 1, 2),
src AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY line_number) AS line_number, '{kind}' AS file_format, raw_line, 0 AS received_at FROM last_)"""


REPORTED = f"""report_lines AS (SELECT job_id, line_number, arg_max({{'k': record_kind, 'r': coalesce(raw_line, '')}}, (received_at, record_kind, coalesce(raw_line, ''))) AS c FROM import_report_lines GROUP BY 1, 2),
report_fields AS (SELECT job_id, line_number, c.k AS k, regexp_full_match(c.r, {_text('(?s)' + _REPORT_FIELD + '(?:,' + _REPORT_FIELD + ')*')}) AS quoted,
  regexp_full_match(c.r, {_text('(?s)' + _row(_REPORT_FIELD, 4))}) AS four, regexp_extract(c.r, {_text('(?s)^' + _row(_REPORT_FIELD, 4) + '$')}, ['a', 'b', 'c', 'd']) AS x,
  regexp_full_match(c.r, {_text('(?s)' + _row(_REPORT_FIELD, 2))}) AS two, regexp_extract(c.r, {_text('(?s)^' + _row(_REPORT_FIELD, 2) + '$')}, ['a', 'b']) AS y FROM report_lines),
report_parts AS (SELECT job_id, line_number, k, quoted, four, two, {_bare('x.a')} AS a, {_bare('x.b')} AS b, {_bare('x.c')} AS c, {_bare('x.d')} AS d, {_bare('y.a')} AS e, {_bare('y.b')} AS n FROM report_fields),
report_numbers AS (SELECT *, CASE WHEN regexp_full_match(c, {_text(_NUMBERS)}) THEN list_transform(regexp_extract_all(c, '[0-9]+'), lambda v: v::hugeint) END AS numbers FROM report_parts),
reported AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting'
  WHEN k = 'duplicate_sequence_group' AND four THEN CASE WHEN regexp_full_match(a, '[0-9]+') AND a::hugeint >= 1 AND regexp_full_match(b, '[0-9]+') AND b::hugeint >= 2 AND numbers IS NOT NULL
    AND len(list_filter(range(2, len(numbers) + 1), lambda i: numbers[i] <= numbers[i - 1])) = 0 AND d IN ('true', 'false') THEN NULL ELSE 'value' END
  WHEN k = 'error_code_count' AND two THEN CASE WHEN e IN ({', '.join(map(_text, ERROR_CODES))}) AND regexp_full_match(n, '[0-9]+') THEN NULL ELSE 'value' END ELSE 'column_count' END AS code FROM report_numbers)"""

_FOUND = "SELECT job_id, line_number, {s}, {cells} AS cells, code AS error_code FROM judged WHERE NOT coalesce(header AND code IS NULL, false)"
_STAGED = _FOUND.format(s="CASE WHEN code IS NULL THEN s END AS sequence_number", cells="CASE WHEN code IS NULL THEN array_to_string(cells, ',') END")

# Staged rows checked against a game of eleven symbols and boards of fifteen cells.
NORMALIZED = f"""{judged()},
staged AS (SELECT job_id, line_number, code, CASE WHEN code IS NULL THEN s END AS sequence_number, CASE WHEN code IS NULL THEN cells END AS cells FROM judged WHERE NOT coalesce(header AND code IS NULL, false)),
checked AS (SELECT *, CASE WHEN code IS NOT NULL THEN code WHEN len(cells) <> 15 THEN 'import_cell_count_mismatch' WHEN list_max(cells) > 11 THEN 'import_symbol_not_in_rules' END AS error_code FROM staged),
normalized AS (SELECT job_id, line_number, sequence_number, error_code, CASE WHEN error_code = 'import_symbol_not_in_rules' THEN list_filter(cells, lambda v: v > 11)[1] END AS foreign_,
  CASE WHEN error_code IS NULL THEN array_to_string(list_transform(cells, lambda v: lpad(v::varchar, 2, '0')), '') END AS signature FROM checked)"""



def _share(a: str, b: str) -> str:
    """The share of bits in which two fingerprints of four words differ."""
    return "((" + " + ".join(f"bit_count(xor({a}[{i}], {b}[{i}]))" for i in range(1, 5)) + ") / 128.0)"


# One step of the recursion is one observation of every run: the open group, the one held back, and the closed groups.
GROUPS = f"""WITH RECURSIVE e AS (SELECT user_id::varchar AS run, event_id AS o, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, value / 500 AS q, CASE WHEN event_type = 'signup' THEN 0.5 ELSE 0.9 END AS g,
  list_transform(range(0, 4), lambda i: ('0x' || substr(substr(md5(event_type), 1, 30) || '0' || floor(value)::bigint % 4, (1 + 8 * i)::int, 8))::bigint) AS w FROM events),
s AS (SELECT run, k, 0 AS num, o AS f, o AS l, 1 AS n, o AS bo, w AS bw, q AS bq, g AS bg, NULL::STRUCT(o BIGINT, w BIGINT[], q DOUBLE, g DOUBLE) AS h,
  []::STRUCT(num INTEGER, f BIGINT, l BIGINT, n INTEGER, bo BIGINT, bq DOUBLE)[] AS done FROM e WHERE k = 1
 UNION ALL SELECT run, k, CASE WHEN h IS NULL THEN num WHEN near THEN num + 1 ELSE num + 2 END, CASE WHEN h IS NULL THEN f WHEN near THEN h.o ELSE xo END, CASE WHEN hold THEN l ELSE xo END, CASE WHEN hold THEN n WHEN h IS NULL THEN n + 1 WHEN near THEN 2 ELSE 1 END,
  CASE WHEN hold THEN bo WHEN h IS NULL THEN CASE WHEN xq > bq THEN xo ELSE bo END WHEN near AND xq <= h.q THEN h.o ELSE xo END, CASE WHEN hold THEN bw WHEN h IS NULL THEN CASE WHEN xq > bq THEN xw ELSE bw END WHEN near AND xq <= h.q THEN h.w ELSE xw END,
  CASE WHEN hold THEN bq WHEN h IS NULL THEN CASE WHEN xq > bq THEN xq ELSE bq END WHEN near AND xq <= h.q THEN h.q ELSE xq END, CASE WHEN hold THEN bg WHEN h IS NULL THEN CASE WHEN xq > bq THEN xg ELSE bg END WHEN near AND xq <= h.q THEN h.g ELSE xg END,
  CASE WHEN hold THEN {{'o': xo, 'w': xw, 'q': xq, 'g': xg}} END,
  CASE WHEN h IS NULL THEN done WHEN near THEN list_append(done, {{'num': num, 'f': f, 'l': l, 'n': n, 'bo': bo, 'bq': bq}})
   ELSE list_concat(done, [{{'num': num, 'f': f, 'l': l, 'n': n, 'bo': bo, 'bq': bq}}, {{'num': num + 1, 'f': h.o, 'l': h.o, 'n': 1, 'bo': h.o, 'bq': h.q}}]) END
 FROM (SELECT s.run, e.k, num, f, l, n, bo, bw, bq, bg, h, done, e.o AS xo, e.w AS xw, e.q AS xq, e.g AS xg, coalesce({_share('h.w', 'e.w')} <= 0.16, false) AS near, h IS NULL AND least(bg, e.g) >= 0.64 AND {_share('bw', 'e.w')} >= 0.22 AS hold FROM s JOIN e ON e.run = s.run AND e.k = s.k + 1)),
last_ AS (SELECT run, unnest(list_concat(done, [{{'num': num, 'f': f, 'l': l, 'n': n, 'bo': bo, 'bq': bq}}], CASE WHEN h IS NULL THEN [] ELSE [{{'num': num + 1, 'f': h.o, 'l': h.o, 'n': 1, 'bo': h.o, 'bq': h.q}}] END)) AS r FROM (SELECT * FROM s QUALIFY k = max(k) OVER (PARTITION BY run)))
SELECT run, r.num AS group_order, r.f AS first_order, r.l AS last_order, r.n::bigint AS source_count, r.bo AS reference_order, r.bq AS reference_quality FROM last_"""

SQL = {
    "stm_session_group": GROUPS,
    "p2_found": f"""WITH {judged()}, {REPORTED} SELECT 'layout_import_lines' AS raw_table, job_id, line_number, code FROM judged WHERE code IS NOT NULL
UNION ALL SELECT 'import_report_lines', job_id, line_number, code FROM reported WHERE code IS NOT NULL""",
    "p2_layouts": f"WITH {judged()} SELECT job_id, line_number, s AS sequence_number, array_to_string(cells, ',') AS cells FROM judged WHERE code IS NULL AND NOT coalesce(header, false)",
    "p2_reports": f"""WITH {REPORTED} SELECT job_id, line_number, k AS record_kind, CASE WHEN four AND k <> 'error_code_count' THEN try_cast(a AS bigint) END AS sequence_number, CASE WHEN four AND k <> 'error_code_count' THEN try_cast(b AS bigint) END AS occurrence_count,
 CASE WHEN k = 'duplicate_sequence_group' THEN array_to_string(numbers, ',') END AS line_numbers, CASE WHEN k = 'duplicate_sequence_group' THEN d = 'true' END AS truncated, CASE WHEN k = 'error_code_count' THEN e END AS code, CASE WHEN k = 'error_code_count' THEN try_cast(n AS bigint) END AS count
FROM reported WHERE code IS NULL""",
    "src_format_dispatch": f"WITH {judged()} SELECT f AS file_format, count(*) FILTER (code IS NULL) AS valid, count(*) FILTER (code IS NOT NULL) AS refused FROM judged WHERE NOT coalesce(header AND code IS NULL, false) GROUP BY 1",
    "src_csv_layouts": f"WITH {files('csv')}, {judged('src')} {_STAGED}",
    "src_jsonl_layouts": f"WITH {files('jsonl')}, {judged('src')} {_STAGED}",
    "stm_microbatch_import": f"SELECT job_id, line_number, sequence_number, error_code FROM (WITH {files('csv')}, {judged('src')} {_STAGED}) UNION ALL SELECT job_id, line_number, sequence_number, error_code FROM (WITH {files('jsonl')}, {judged('src')} {_STAGED})",
    "prj_normalize_row": f'WITH {NORMALIZED} SELECT job_id, line_number, sequence_number, error_code, foreign_ AS "foreign", signature FROM normalized',
    "dom_import_error_counts": f"WITH {NORMALIZED} SELECT error_code, count(*) AS n FROM normalized WHERE error_code IS NOT NULL GROUP BY 1",
    "dom_import_integrity": f"""WITH {NORMALIZED}, ok AS (SELECT * FROM normalized WHERE error_code IS NULL), q AS (SELECT count(*) AS n FROM ok GROUP BY sequence_number HAVING count(*) > 1), g AS (SELECT count(*) AS n FROM ok GROUP BY signature HAVING count(*) > 1)
SELECT count(*) AS rows, count(*) FILTER (error_code IS NULL) AS valid, count(*) FILTER (error_code IS NOT NULL) AS invalid, max(sequence_number) FILTER (error_code IS NULL) AS highest, count(DISTINCT sequence_number) FILTER (error_code IS NULL) AS numbers,
 coalesce(max(sequence_number) FILTER (error_code IS NULL) - count(DISTINCT sequence_number) FILTER (error_code IS NULL), 0) AS missing, (SELECT count(*) FROM q) AS sequence_groups, (SELECT coalesce(sum(n - 1), 0)::bigint FROM q) AS sequence_excess,
 (SELECT count(*) FROM g) AS signature_groups, (SELECT coalesce(sum(n - 1), 0)::bigint FROM g) AS signature_excess FROM normalized""",
}
