"""Functions for SQL: scalar ones, and row-producing ones for texts, as table functions.

They are declared in SQL, so that a query with them is one plan: ``SELECT d.id, g.* FROM d, LATERAL grep_hits(d.text) g``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .operators import grep


def _quoted(pattern: str) -> str:
    """A pattern as a raw SQL literal."""
    if "'" in pattern:
        raise ValueError("a pattern for SQL has no quote")
    return f"r'{pattern}'"


def _hit(form: str) -> str:
    """A branch of a CASE over the forms of a hit."""
    p = _quoted(form)
    part = lambda k: f"regexp_extract(line, {p}, {k})"
    number = f"CAST({part(2)} AS INT)"
    made = f"named_struct('file', {part(1)}, 'line', {number}, 'col', CAST(nullif({part(3)}, '') AS INT), 'text', {part(4)})"
    return f"WHEN line RLIKE {p} AND {number} > 0 THEN {made}"


def declarations() -> dict[str, str]:
    """Name -> the rest of its declaration."""
    rows = "posexplode(split(regexp_replace(t, r'\\r\\n?', '\\n'), '\\n', -1))"
    hit = "CASE " + " ".join(map(_hit, grep.FORMS)) + " END"
    return {
        "estimate_tokens": "(t STRING) RETURNS BIGINT RETURN CAST(ceil(octet_length(encode(t, 'UTF-16BE')) / 8) AS BIGINT)",
        "content_hash": "(t STRING) RETURNS STRING RETURN concat('sha256:', sha2(t, 256))",
        "text_lines": f"(t STRING) RETURNS TABLE (line_no INT, line STRING) RETURN SELECT pos, col FROM {rows}",
        "grep_hits": "(t STRING) RETURNS TABLE (line_no INT, file STRING, line INT, col INT, text STRING) "
        f"RETURN SELECT pos, h.file, h.line, h.col, h.text FROM (SELECT pos, {hit} AS h FROM (SELECT pos, col AS line FROM {rows})) WHERE h IS NOT NULL",
    }


def register(spark: SparkSession) -> list[str]:
    """Declares the functions for this session; their names."""
    for name, rest in declarations().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{rest}")
    return list(declarations())
