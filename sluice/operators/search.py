"""Search hits of several engines: aggregation, merging, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U

# Engine weights (the own fact store first).
WEIGHTS = {"facts": 1.5, "baidu": 1.0, "bing": 1.1, "duckduckgo": 1.0, "sogou": 0.9}
HIT = ("query", "engine", "engine_ord", "position", "title", "url", "snippet")


def aggregate(hits: DataFrame, limit: int | None = 10) -> DataFrame:
    """Hits of a query with one normalised url become one result.

    Score: the sum of weight / position, half as much again with several
    engines.  Longest title and snippet, first url, engines as first seen.
    """
    weight = F.lit(1.0)
    for engine, w in WEIGHTS.items():
        weight = F.when(F.lower("engine") == engine, w).otherwise(weight)
    ord_ = F.struct("engine_ord", "position")
    scored = hits.withColumns({
        "key": U.normalize_url(F.col("url")),
        "part": F.when(F.col("position") > 0, weight / F.col("position")).otherwise(0.0),
        "ord": ord_,
    })
    longest = lambda c: F.min_by(c, F.struct(-F.length(c), "engine_ord", "position"))
    grouped = scored.groupBy("query", "key").agg(
        longest("title").alias("title"),
        F.min_by("url", "ord").alias("url"),
        longest("snippet").alias("snippet"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("engine_ord", "position", "engine"))), lambda x: x["engine"])).alias("sources"),
        F.sum("part").alias("sum"),
        F.min("ord").alias("first"),
    )
    out = grouped.withColumn("score", T.round3(F.col("sum") * F.when(F.size("sources") > 1, 1.5).otherwise(1.0)))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "first"))
    out = out.withColumn("rank", rank)
    if limit is not None:
        out = out.filter(F.col("rank") <= limit)
    return out.select("query", "rank", "title", "url", "snippet", "sources", "score")


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer by normalised url.  left: (query, ord, title, url, snippet); right: aggregated results.

    The left's title and url, the longer snippet, the sources of both; of equal
    urls on the left the last wins in the first's place.
    """
    key = U.normalize_url(F.col("url"))
    l = left.withColumn("key", key).groupBy("query", "key").agg(  # noqa: E741
        F.min("ord").alias("lord"), *[F.max_by(c, "ord").alias(f"l_{c}") for c in ("title", "url", "snippet")]
    )
    r = right.withColumn("key", key).select("query", "key", F.col("rank").alias("rord"), *[F.col(c).alias(f"r_{c}") for c in ("title", "url", "snippet", "sources")])
    both = l.join(r, ["query", "key"], "full_outer")
    longer = F.length(F.coalesce("r_snippet", F.lit(""))) > F.length(F.coalesce("l_snippet", F.lit("")))
    out = both.select(
        "query",
        F.coalesce("l_title", "r_title").alias("title"),
        F.coalesce("l_url", "r_url").alias("url"),
        F.when(longer, F.col("r_snippet")).otherwise(F.coalesce("l_snippet", "r_snippet")).alias("snippet"),
        F.concat(F.when(F.col("lord").isNotNull(), F.array(F.lit("llm"))).otherwise(F.array().cast("array<string>")), F.coalesce("r_sources", F.array().cast("array<string>"))).alias("sources"),
        F.struct(F.col("lord").isNull().alias("n"), "lord", "rord").alias("o"),
    )
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("o"))).drop("o")


def engines_of(results: DataFrame) -> DataFrame:
    """Per query: results and distinct engines."""
    return results.groupBy("query").agg(F.count("*").alias("n_results"), F.size(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("n_engines"))


def render(results: DataFrame) -> DataFrame:
    """One text a query: a header and a numbered list."""
    item = F.concat(
        F.col("rank").cast("string"), F.lit(". **"), "title", F.lit("** ("), U.extract_domain(F.col("url")), F.lit(")\n   "), "snippet",
        F.lit("\n   Sources: "), F.array_join("sources", ", "),
    )
    per = results.groupBy("query").agg(
        F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))).alias("items"), F.flatten(F.collect_list("sources")).alias("all")
    )
    k = F.size(F.array_distinct("all"))
    head = F.concat(F.lit('Search: "'), "query", F.lit('" — '), F.size("items").cast("string"), F.lit(" results from "), k.cast("string"), F.lit(" "), T.pluralize("engine", k))
    return per.select("query", F.concat_ws("\n", head, F.array_join(F.transform("items", lambda x: x["item"]), "\n")).alias("output"))


RESULTS = "array<struct<title: string, url: string, snippet: string, sources: array<string>, score: double>>"


def rendered(results: Column, query: Column, limit: int = 10) -> Column:
    """The lines of an array of results (an in-row form of render): a header, an empty line, a numbered list."""
    none = F.array().cast("array<string>")
    some = lambda c: F.coalesce(c, F.lit("")) != ""

    def made(own: Column) -> Column:
        engines = F.size(F.array_distinct(F.flatten(F.transform(own, lambda r: F.coalesce(r["sources"], none)))))
        n = F.size(own)
        head = F.concat(F.lit('Search: "'), F.coalesce(query, F.lit("")), F.lit('" — '), n.cast("string"), F.lit(" results from "), engines.cast("string"), F.lit(" "), T.pluralize("engine", engines))

        def item(r: Column, i: Column) -> Column:
            title = F.coalesce(F.nullif(r["title"], F.lit("")), F.lit("(untitled)"))
            domain = U.extract_domain(F.coalesce(r["url"], F.lit("")))
            first = F.concat((i + 1).cast("string"), F.lit(". **"), title, F.lit("** ("), domain, F.lit(")"))
            told = F.when(some(r["snippet"]), F.array(F.concat(F.lit("   "), r["snippet"]))).otherwise(none)
            by = F.array_join(F.coalesce(r["sources"], none), ", ")
            return F.concat(F.array(first), told, F.when(by != "", F.array(F.concat(F.lit("   Sources: "), by))).otherwise(none))

        return F.concat(F.array(head, F.lit("")), F.flatten(F.transform(own, item)))

    return T.bound(F.slice(F.coalesce(results, F.from_json(F.lit("[]"), RESULTS)), 1, limit), made)


def parse_results(content: Column) -> Column:
    """The results of a JSON array; empty for any other text."""
    listed = T.trim(F.coalesce(content, F.lit(""))).startswith("[")
    return F.when(listed, F.from_json(content, RESULTS))


REPLY = "struct<query: string, autopromptString: string, results: array<struct<title: string, url: string, snippet: string, text: string, description: string, content: string>>>"


def parse_reply(content: Column, first: str = "llm") -> Column:
    """STRUCT(query, results) of a search tool's JSON reply; null if it isn't JSON.  Results without a url go.

    first: ``exa`` replies tell their query as autopromptString and their snippet as text, ``llm`` ones as query and
    description or content.
    """
    if first not in ("llm", "exa"):
        raise ValueError(f"reply: {first}")
    filled = lambda c: F.nullif(c, F.lit(""))
    also = ["text"] if first == "exa" else ["description", "content"]

    def told(v: Column) -> Column:
        good = F.filter(F.coalesce(v["results"], F.array()), lambda r: filled(r["url"]).isNotNull())
        one = lambda r: F.struct(
            F.coalesce(r["title"], F.lit("")).alias("title"), r["url"].alias("url"),
            F.coalesce(filled(r["snippet"]), *[filled(r[c]) for c in also], F.lit("")).alias("snippet"),
        )
        query = F.coalesce(v["autopromptString" if first == "exa" else "query"], F.lit(""))
        return F.when(v.isNotNull(), F.struct(query.alias("query"), F.transform(good, one).alias("results")))

    # text that isn't an object has no reply; what from_json can't read has no field at all
    ok = T.trim(content).startswith("{") & F.try_parse_json(content).isNotNull()
    return F.when(ok, T.bound(F.from_json(content, REPLY), told))


def merged_lists(mine: Column, theirs: Column) -> Column:
    """The results of a tool's reply and of the engines, each an array, as one: by normalised url, mine first.

    Of equal urls in a list the first place and the last value stay; a result in both keeps my title and url, the longer
    snippet and the sources of both.  Replies are short: each is merged in its row, by position in the list of keys.
    """
    def last(own: Column) -> Column:
        """One result for each key, in the order of the keys' first places."""
        keys = F.transform(own, lambda r: U.normalize_url(r["url"]))
        both = F.struct(own.alias("rs"), keys.alias("keys"))
        pick = lambda v: F.transform(
            F.array_distinct(v["keys"]),
            lambda k: F.struct(k.alias("key"), F.get(v["rs"], F.size(v["rs"]) - F.array_position(F.reverse(v["keys"]), k).cast("int")).alias("r")),
        )
        return T.bound(both, pick)

    def first(own: Column) -> Column:
        keys = F.transform(own, lambda r: U.normalize_url(r["url"]))
        pick = lambda v: F.transform(F.array_distinct(v["keys"]), lambda k: F.struct(k.alias("key"), F.get(v["rs"], F.array_position(v["keys"], k).cast("int") - 1).alias("r")))
        return T.bound(F.struct(own.alias("rs"), keys.alias("keys")), pick)

    def joined(v: Column) -> Column:
        other = lambda x: F.get(F.filter(v["b"], lambda y: y["key"] == x["key"]), F.lit(0))["r"]

        def one(x: Column) -> Column:
            return T.bound(F.struct(x["r"].alias("r"), other(x).alias("o")), lambda w: F.struct(
                w["r"]["title"].alias("title"), w["r"]["url"].alias("url"),
                F.when(F.length(F.coalesce(w["o"]["snippet"], F.lit(""))) > F.length(F.coalesce(w["r"]["snippet"], F.lit(""))), w["o"]["snippet"]).otherwise(w["r"]["snippet"]).alias("snippet"),
                F.concat(w["r"]["sources"], F.coalesce(w["o"]["sources"], F.array().cast("array<string>"))).alias("sources"), w["r"]["score"].alias("score"),
            ))

        known = F.transform(v["a"], lambda x: x["key"])
        fresh = F.transform(F.filter(v["b"], lambda y: ~F.array_contains(known, y["key"])), lambda y: F.struct(*[y["r"][c].alias(c) for c in ("title", "url", "snippet", "sources", "score")]))
        return F.concat(F.transform(v["a"], one), fresh)

    return T.bound(F.struct(T.bound(mine, last).alias("a"), T.bound(theirs, first).alias("b")), joined)


def merged_text(results: Column, ours: Column, engines: Column, failed: Column, millis: Column, name: str = "llm", label: str = "condensed search merge") -> Column:
    """Merged results as text: a list, and a trailer with how many came from the tool, the engines and the time.

    engines null: the engines' search failed; then the trailer says so.
    """
    def item(r: Column, i: Column) -> Column:
        told = F.coalesce(r["snippet"], F.lit(""))
        head = F.concat(F.lit("## "), (i + 1).cast("string"), F.lit(". "), F.coalesce(F.nullif(r["title"], F.lit("")), F.lit("(No title)")))
        lines = F.array(head, F.concat(F.lit("URL: "), r["url"]), F.concat(F.lit("Sources: "), F.array_join(r["sources"], ", ")), F.lit(""))
        return F.concat(lines, F.when(told != "", F.array(told, F.lit(""))).otherwise(F.array().cast("array<string>")))

    def made(own: Column) -> Column:
        head = F.array(F.concat(F.lit("# Search Results ("), F.size(own).cast("string"), F.lit(" total)")), F.lit(""))
        trailer = F.array(F.lit("---"), F.lit(f"[{label}]"), F.concat(F.lit(f"- {name} results: "), ours.cast("string")))
        by = F.coalesce(F.nullif(F.array_join(engines, ", "), F.lit("")), F.lit("none"))
        bad = F.when(F.size(failed) > 0, F.array(F.concat(F.lit("- Failed engines: "), F.array_join(failed, ", ")))).otherwise(F.array().cast("array<string>"))
        good = F.concat(F.array(F.concat(F.lit("- Engines: "), by)), bad, F.array(F.concat(F.lit("- Merge time: "), millis.cast("string"), F.lit("ms"))))
        return F.array_join(F.concat(head, F.flatten(F.transform(own, item)), trailer, F.when(engines.isNull(), F.array(F.lit("- Engines: fallback (search failed)"))).otherwise(good)), "\n")

    return T.bound(results, made)


# The engines of each region, the own fact store first.
REGIONS = {"china": ("facts", "baidu", "bing", "sogou"), "global": ("facts", "duckduckgo", "bing")}


def region(locale: Column, zone: Column, resolves: Column, reaches: Column) -> Column:
    """The region by votes of captured signals (each true: looks like china; resolves, reaches: the probed host answered).

    Locale and zone have a voice each, a name that doesn't resolve two; the probe is asked only where the vote isn't
    china's yet, and has two.
    """
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    china = yes(locale) + yes(zone) + 2 * (1 - yes(resolves))
    other = (1 - yes(locale)) + (1 - yes(zone)) + yes(resolves)
    asked = other >= china
    china2 = china + F.when(asked, 2 * (1 - yes(reaches))).otherwise(0)
    other2 = other + F.when(asked, 2 * yes(reaches)).otherwise(0)
    return F.when(china2 > other2, "china").otherwise("global")


def parse_facts(payloads: DataFrame) -> DataFrame:
    """(query, engine, body) of the fact store's {ok, results} -> hits; anything else has none."""
    v = F.from_json("body", "ok boolean, results array<struct<title: string, url: string, snippet: string>>")
    return payloads.select("query", "engine", v.alias("v")).filter("v.ok").select("query", "engine", F.posexplode("v.results").alias("p", "e")).select(
        "query", "engine", (F.col("p") + 1).alias("position"), "e.title", "e.url", "e.snippet"
    )


def parse_entries(payloads: DataFrame, cap: int = 10) -> DataFrame:
    """(query, engine, body) with {results: [{title, url, description}]} -> hits; entries without title or url are skipped."""
    return _hits_of(payloads, F.from_json("body", "results array<struct<title: string, url: string, description: string>>")["results"], "description", cap)


def _hits_of(payloads: DataFrame, entries: Column, snippet: str, cap: int) -> DataFrame:
    good = F.slice(F.filter(entries, lambda e: (F.coalesce(e["title"], F.lit("")) != "") & (F.coalesce(e["url"], F.lit("")) != "")), 1, cap)
    return payloads.select("query", "engine", F.posexplode(good).alias("p", "e")).select(
        "query", "engine", (F.col("p") + 1).alias("position"), "e.title", "e.url", F.coalesce(F.nullif(f"e.{snippet}", F.lit("")), "e.title").alias("snippet")
    )


def parse_feed(payloads: DataFrame, cap: int = 10) -> DataFrame:
    """(query, engine, body) with feed.entry[] -> hits; entries without title or url are skipped."""
    entries = F.from_json("body", "feed struct<entry: array<struct<title: string, url: string, abs: string>>>")["feed"]["entry"]
    return _hits_of(payloads, entries, "abs", cap)
