"""Pieces of DuckDB SQL shared by the checks."""

#: White space and line ends as the text functions see them.
BLANK = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_END = r"(\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}])"


def trim_all(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), '{BLANK}+'), lambda w: w <> '')"


def text_lines(x: str) -> str:
    return f"string_split_regex(regexp_replace({x}, '{LINE_END}$', ''), '{LINE_END}')"


PAGE_TEXT = """
page_text AS (
    SELECT DISTINCT source, page_number, coalesce(array_to_string(list_filter(blocks, lambda b: b IS NOT NULL), chr(10)), '') AS text
    FROM extracted_pages)
"""

RUNS = """
runs AS (
    SELECT * FROM (SELECT *, TRY_CAST(log_ts AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS ts,
                          row_number() OVER (PARTITION BY run_id ORDER BY received_at) AS first_line FROM rag_timings)
    WHERE first_line = 1)
"""

CHUNKS = """
starts AS (
    SELECT doc_id, text, unnest(generate_series(0, greatest(0, CAST(ceil((length(text) - 400) / 320.0) AS INTEGER)))) AS child_no
    FROM documents WHERE length(text) > 0),
chunks AS (
    SELECT doc_id, child_no, doc_id || ':' || child_no AS chunk_id, child_no * 320 AS start, substring(text, child_no * 320 + 1, 400) AS child FROM starts)
"""
