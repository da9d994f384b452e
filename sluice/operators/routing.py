"""Which condenser takes a tool's output, whether it pays, and the on/off countdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tools and their condensers.
TOOLS = {"bash": "bash", "read": "read", "skill": "read", "grep": "grep", "glob": "ls", "webfetch": "web", "websearch_web_search_exa": "search"}
SECOND = {"exec": "bash", "process": "bash", "read": "read", "browser": "web", "web_fetch": "web", "web_search": "search"}
MIN_GAIN = 200
# What a command has if it runs tests, and the runner; the first that fits.
RUNNERS = (("pytest", "pytest"), ("jest", "jest"), ("vitest", "vitest"), ("go test", "go"), ("cargo test", "cargo"))


def runner_hint(command: Column) -> Column:
    """The test runner that a command names; null: none."""
    return F.coalesce(*[F.when(F.contains(command, F.lit(part)), runner) for part, runner in RUNNERS])


def for_command(command: Column) -> Column:
    t = F.trim(command)
    base = F.regexp_extract(F.lower(F.split(t, r"\s+")[0]), r"([^/]*)$", 1)
    sub = F.lower(F.regexp_extract(t, r"^git\s+(\S+)", 1))
    return (
        F.when(base.rlike("^(grep|egrep|fgrep|rg|ag|ack)$"), "grep")
        .when(base.rlike("^(ls|find|tree|exa|eza|lsd)$"), "ls")
        .when((base == "git") & (sub.isin("diff", "show") | ((sub == "log") & t.rlike(r"\s-p\b"))), "diff")
        .otherwise("bash")
    )


def for_tool(tool: Column, tools: dict[str, str] = TOOLS) -> Column:
    """Null: the output passes as it is."""
    m = F.create_map(*[F.lit(x) for kv in tools.items() for x in kv])
    return F.try_element_at(m, F.lower(tool))


def pays(before: Column, after: Column, least: int = MIN_GAIN) -> Column:
    return F.length(before) - F.length(after) >= least


def countdown(events: DataFrame, key: str, order: str, kind: str = "kind", n: str = "n") -> DataFrame:
    """Events (kind: on, off, call).  off with n: the next n calls stay raw; without a positive n, all until on."""
    w = Window.partitionBy(key).orderBy(order)
    ctl = F.col(kind).isin("on", "off")
    last = F.last(F.when(ctl, F.struct(F.col(kind).alias("k"), F.col(n).alias("n"))), ignorenulls=True).over(w)
    spans = events.withColumn("ctl", last).withColumn("span", F.sum(ctl.cast("int")).over(w))
    nth = F.count_if(~ctl).over(Window.partitionBy(key, "span").orderBy(order))
    raw = (F.col("ctl.k") == "off") & (F.coalesce(F.col("ctl.n"), F.lit(0)) <= 0) | (F.col("ctl.k") == "off") & (nth <= F.col("ctl.n"))
    return spans.withColumn("raw", F.coalesce(raw, F.lit(False)) & ~ctl).drop("ctl", "span")
