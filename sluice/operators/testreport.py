"""Test reports: runner and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNT = r"(?i)(\d+)\s+(passed|pass|failed|fail|errors|error|skipped|skip|ignored|xfailed|xpassed|deselected|total)\b"


def runner(text: Column) -> Column:
    has = lambda p: text.rlike(p)
    return (
        F.when(has(r"(?i)test result:\s*(?:ok|FAILED)\.") | has(r"(?m)^test\s+.+\.\.\.\s+(?:ok|FAILED)$"), "cargo")
        .when(has(r"(?m)^---\s+(?:PASS|FAIL|SKIP):") | has(r"(?m)^=== RUN\s+") | has(r"(?m)^(?:ok|FAIL)\s+\S+\s+\d+(?:\.\d+)?s\b"), "go")
        .when(has("(?i)short test summary info") | (has(r"(?m)^=+") & has(r"\b(?:PASSED|FAILED|ERROR)\b") & has("(?i)pytest|test session starts")), "pytest")
        .when(has(r"(?i)\bvitest\b") | has(r"(?m)^\s*Test Files\s+") | has(r"(?m)^\s*Duration\s+\d"), "vitest")
        .when(has("(?i)Test Suites:") | has(r"(?m)^\s*(?:PASS|FAIL)\s+") | has(r"(?i)\bTests:\s+"), "jest")
        .otherwise("unknown")
    )


def line_summary(line: Column) -> Column:
    """STRUCT(total, passed, failed, skipped) of one line; null where it says nothing."""
    pairs = F.arrays_zip(
        F.transform(F.regexp_extract_all(line, F.lit(COUNT), F.lit(1)), lambda x: x.try_cast("int")).alias("n"),
        F.transform(F.regexp_extract_all(line, F.lit(COUNT), F.lit(2)), F.lower).alias("what"),
    )
    none = F.lit(None).cast("int")
    start = F.struct(none.alias("total"), none.alias("passed"), none.alias("failed"), none.alias("skipped"))

    def step(a, p):
        w, n = p["what"], p["n"]
        return F.struct(
            F.when(w == "total", n).otherwise(a["total"]).alias("total"),
            F.when(w.startswith("pass"), n).otherwise(a["passed"]).alias("passed"),
            F.when(w.startswith("fail"), n).when(w.startswith("error"), F.coalesce(a["failed"], F.lit(0)) + n).otherwise(a["failed"]).alias("failed"),
            F.when(w.startswith("skip") | w.isin("ignored", "xfailed", "xpassed", "deselected"), F.coalesce(a["skipped"], F.lit(0)) + n).otherwise(a["skipped"]).alias("skipped"),
        )

    s = F.aggregate(pairs, start, step)
    running = F.regexp_extract(line, r"(?i)\brunning\s+(\d+)\s+tests?\b", 1).try_cast("int")
    paren = F.when(line.rlike("(?i)tests?"), F.regexp_extract(line, r"\((\d+)\)\s*$", 1).try_cast("int"))
    total = F.coalesce(running, s["total"], paren)
    return F.struct(total.alias("total"), s["passed"].alias("passed"), s["failed"].alias("failed"), s["skipped"].alias("skipped"))


def summaries(ls: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document: a later line's count overrides an earlier one's, field by field; what is missing is derived."""
    x = ls.select(doc, "line_no", line_summary(F.col("line")).alias("s"))
    last = lambda f: F.max_by(f"s.{f}", F.when(F.col(f"s.{f}").isNotNull(), F.col("line_no"))).alias(f)
    g = x.groupBy(doc).agg(*[last(f) for f in ("total", "passed", "failed", "skipped")])
    zero = lambda c: F.coalesce(c, F.lit(0))
    known = F.col("passed").isNotNull() | F.col("failed").isNotNull() | F.col("skipped").isNotNull()
    total = F.coalesce("total", F.when(known, zero(F.col("passed")) + zero(F.col("failed")) + zero(F.col("skipped"))))
    passed = F.coalesce("passed", F.greatest(F.lit(0), F.col("total") - zero(F.col("failed")) - zero(F.col("skipped"))))
    return g.select(doc, total.alias("total"), passed.alias("passed"), "failed", "skipped")
