"""The agent hook as one call: tool events in, what the agent reads out.

An event is (session, seq, tool, args, output).  Control tools switch the hook
off for a number of calls; other events are routed by tool or command to a
condenser; its result replaces the output if it is enough shorter, with a
marker that says by how much.  Replies of search tools are merged with the
engines' results where there are some.

Each route reads the events it condenses only, and rows meet their results
again by (session, seq) within the route: nothing is joined across sessions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import plans
from ..functions import text as T
from ..operators import routing, search

#: Control tools: off with args.calls, and on.
ON, OFF = "condense_on", "condense_off"


def _columns(route: str, text: Column, query: Column) -> Column:
    if route == "search":
        return plans.search(text, query)["output"]
    return {"bash": plans.bash, "read": plans.read, "web": plans.web, "api": plans.api}[route](text)["output"]


def condensed(rows: DataFrame, route: str) -> DataFrame:
    """(event_key, text, query, ..) -> the same rows with ``short``."""
    if route in ("grep", "ls", "diff"):
        short = getattr(plans, route)(rows, "event_key", "text").select(F.col("event_key").alias("event_key2"), F.col("output").alias("short"))
        return rows.join(short, F.col("event_key") == F.col("event_key2")).drop("event_key2")
    return rows.withColumn("short", _columns(route, F.col("text"), F.col("query")))


def marker(percent: Column, label: str, off: str) -> Column:
    return F.concat(F.lit(f"\n[{label}: "), percent.cast("string"), F.lit(f"% smaller | {off}() for raw]"))


def gain_percent(before: Column, after: Column) -> Column:
    return T.half_up((F.length(before) - F.length(after)) / F.length(before) * 100).cast("int")


def outputs(events: DataFrame, results: DataFrame | None = None, profile: str = "first", least: int = routing.MIN_GAIN, calls: int = 10, label: str = "condensed", on: str = ON, off: str = OFF) -> DataFrame:
    """(session, seq, tool, route, output, changed): events (session, seq, tool, args map<string,string>, output).

    results: (query, results, engines, failed, millis), a row a query, what the engines found; results null: they failed.
    profile: ``first`` routes shell commands by what they run, ``second`` has its own tools and no marker on merged replies.
    """
    if profile not in ("first", "second"):
        raise ValueError(f"profile: {profile}")
    tool = F.col("tool")
    kind = F.when(tool == on, "on").when(tool == off, "off").otherwise("call")
    n = F.coalesce(F.try_element_at("args", F.lit("calls")).try_cast("int"), F.lit(calls))
    state = routing.countdown(events.withColumns({"kind": kind, "n": n}), "session", "seq")
    route = F.when(tool == "bash", routing.for_command(F.coalesce(F.try_element_at("args", F.lit("command")), F.lit("")))).otherwise(routing.for_tool(tool)) if profile == "first" else routing.for_tool(tool, routing.SECOND)
    searching = tool.startswith("websearch_") if profile == "first" else tool == "web_search"
    done = F.col("output").contains(f"[{label}")  # an output that has been condensed passes
    idle = (F.col("kind") != "call") | F.col("raw") | F.col("output").isNull() | (F.col("output") == "") | ((tool == "webfetch") & done)
    rows = state.select(
        "session", "seq", "tool", F.struct("session", "seq").alias("event_key"), F.col("output").alias("text"),
        F.coalesce(F.try_element_at("args", F.lit("query")), F.lit("")).alias("asked"),
        F.when(~idle, route).alias("route"), (searching & ~idle).alias("searching"),
    )
    name = "exa" if profile == "first" else "llm"
    rows = rows.withColumn("reply", F.when(F.col("searching"), search.parse_reply(F.col("text"), name)))
    rows = rows.withColumn("query", F.coalesce(F.nullif("asked", F.lit("")), F.col("reply.query"), F.lit(""))).drop("asked")
    merged = None
    if results is not None:
        merged = _merged(rows.filter("searching and query != ''"), results, name)
        if profile == "first":
            merged = merged.withColumn("output", F.concat("output", F.lit(f"\n[{label} search merge | {off}() for raw]")))
        rows = rows.join(merged.select(F.col("event_key").alias("event_key2")), F.col("event_key") == F.col("event_key2"), "left_anti")
    routes = ["bash", "read", "web", "search"] + (["grep", "ls", "diff"] if profile == "first" else [])
    cols = ["session", "seq", "tool", "route"]
    plain = rows.filter("route is null").select(*cols, F.col("text").alias("output"), F.lit(False).alias("changed"))
    parts = [plain] + ([merged.select(*cols, "output", F.lit(True).alias("changed"))] if merged is not None else [])
    for r in routes:
        short = condensed(rows.filter(F.col("route") == r), r)
        pays = F.coalesce(routing.pays(F.col("text"), F.col("short"), least), F.lit(False))
        told = F.concat("short", marker(gain_percent(F.col("text"), F.col("short")), label, off))
        parts.append(short.select(*cols, F.when(pays, told).otherwise(F.col("text")).alias("output"), pays.alias("changed")))
    return reduce(DataFrame.unionByName, parts)


def _merged(rows: DataFrame, results: DataFrame, name: str) -> DataFrame:
    """The rows whose reply can be merged: those with results, or with a reply of their own where the engines failed."""
    none = F.from_json(F.lit("[]"), search.RESULTS)
    found = results.select(F.col("query").alias("q"), F.col("results").alias("found"), "engines", "failed", "millis")
    both = rows.join(found, F.col("query") == F.col("q"))
    mine = F.transform(F.coalesce("reply.results", F.array()), lambda r: F.struct(r["title"].alias("title"), r["url"].alias("url"), r["snippet"].alias("snippet"), F.array(F.lit(name)).alias("sources"), F.lit(0.0).alias("score")))
    both = both.withColumns({"mine": mine, "theirs": F.coalesce("found", none)})
    out = both.withColumn("list", search.merged_lists(F.col("mine"), F.col("theirs")))
    failed = F.col("found").isNull()
    out = out.filter(~failed | (F.size("mine") > 0))
    engines = F.when(~failed, F.col("engines"))
    return out.withColumn("output", search.merged_text(F.col("list"), F.size("mine"), engines, F.coalesce("failed", F.array().cast("array<string>")), F.coalesce("millis", F.lit(0)), name))
