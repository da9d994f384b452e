"""Condensers: a text column in, STRUCT(output, original_size, compressed_size, ratio, format) out."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import language
from ..functions import text as T
from ..operators import diff as diffs
from ..operators import grep as greps
from ..operators import jsonprune, listing, lines, source, testfailures, truncate, webpage
from ..operators import search as searches


def limit(value) -> int | None:
    """A limit as it counts: what isn't a finite positive number is no limit, a fraction is cut."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value <= 0:
        return None
    return max(1, math.floor(value))


def _limits(max_lines, max_tokens, scored: bool = False) -> tuple[int | None, int | None, bool, bool]:
    """(lines, tokens, whether there is a footer, whether there is a score line): what is left to the text itself."""
    max_lines, max_tokens = limit(max_lines), limit(max_tokens)
    foot = (max_lines is None or max_lines > 1) and (max_tokens is None or max_tokens > 25)
    scored = scored and foot and (max_lines is None or max_lines > 2) and (max_tokens is None or max_tokens > 47)
    less = lambda limit, own: None if limit is None else max(1, limit - own)
    return less(max_lines, foot + scored), less(max_tokens, 25 * foot + 22 * scored), foot, scored


def _told(before: Column, fitted: Column, fmt: str, foot: bool, score: Column | None = None, by_lines: bool = False, shown: Callable[[Column], Column] = lambda ls: ls) -> Column:
    """The result of fitted lines (STRUCT(lines, exceeded)) with a footer; its percentage is of characters, or of lines."""
    def told(v: Column) -> Column:
        n, m, out = v["n"], F.size(v["f"]["lines"]), v["out"]
        percent = T.saved_percent(n, m) if by_lines else T.saved_percent(v["chars"], F.length(out))
        whole = F.concat_ws("\n", out, score, T.footer(n, m, percent)) if score is not None else F.concat(out, F.lit("\n"), T.footer(n, m, percent))
        return F.struct(
            (whole if foot else out).alias("output"), n.alias("original_size"), m.alias("compressed_size"), T.ratio(n, m).alias("ratio"),
            F.lit(fmt).alias("format"), v["f"]["exceeded"].alias("budget_exceeded"),
        )

    joined = lambda f: F.struct(f.alias("f"), F.array_join(shown(f["lines"]), "\n").alias("out"))
    sizes = lambda b: F.struct(F.size(b).alias("n"), F.length(F.array_join(b, "\n")).alias("chars"))
    both = F.struct(T.bound(fitted, joined).alias("a"), T.bound(before, sizes).alias("b"))
    flat = lambda x: F.struct(x["a"]["f"].alias("f"), x["a"]["out"].alias("out"), x["b"]["n"].alias("n"), x["b"]["chars"].alias("chars"))
    return T.bound(T.bound(both, flat), told)


def _result(before: Column, after: Column, fmt: str, max_lines, max_tokens, kind: str, **how) -> Column:
    """The lines fitted to the limits, with a footer that counts against them; none where they leave no room for it."""
    max_lines, max_tokens, foot, _ = _limits(max_lines, max_tokens)
    return _told(before, truncate.fit(after, max_lines, max_tokens, kind), fmt, foot, **how)


def bash(content: Column, max_lines: int | None = None, max_tokens: int | None = None) -> Column:
    before = T.lines(content)
    after = lines.quiet(T.collapse_blanks(T.lines(T.strip_ansi(content))))
    return _result(before, after, "bash", max_lines, max_tokens, "bash")


def read(
    content: Column, max_lines: int | None = None, numbers: bool = False, name: Column | None = None,
    comments: bool = True, imports: bool = True, blanks: bool = True, mode: str = "full", max_tokens: int | None = None,
) -> Column:
    """Source text.  name: the file's name; by its language comments, imports and (mode ``skeleton``) bodies fold."""
    if mode not in ("full", "skeleton"):
        raise ValueError(f"mode: {mode}")
    lang = F.lit("unknown") if name is None else language.detect_language(F.coalesce(name, F.lit("")))
    ls = T.lines(content)
    bare = lambda own: F.when(T.has_line_numbers(own), F.transform(own, T.strip_line_number)).otherwise(own)
    ls = F.when(lang.isin("yaml", "json", "toml"), ls).otherwise(T.bound(ls, bare))
    after = T.collapse_blanks(ls) if blanks else ls
    if name is not None:
        after = source.fold_source(after, lang, comments, imports, mode == "skeleton")
    shown = T.number_lines if numbers else lambda ls: ls  # numbers go to the lines that stay, and count against no limit
    return _result(T.lines(content), after, "read", max_lines, max_tokens, "read", shown=shown)


def report(content: Column, max_lines: int | None = None, kind: Column | None = None, max_tokens: int | None = None) -> Column:
    """A test run's output: the counts, and what is told of each failure."""
    whole = F.coalesce(content, F.lit(""))
    after = testfailures.render(testfailures.parse_report(whole, kind), whole)
    return _result(T.lines(whole), after, "test", max_lines, max_tokens, "test")


def _condensed(docs: DataFrame, rendered: DataFrame, doc: str, content: str, kind: str, limits: tuple, empty: str) -> DataFrame:
    """Documents with their rendered lines; those without any row get the line ``empty``."""
    both = docs.select(doc, F.coalesce(content, F.lit("")).alias("text")).join(rendered, doc, "left")
    after = T.collapse_blanks(F.coalesce("lines", F.split(F.lit(empty), "\n")))
    return both.select(doc, _result(T.lines(F.col("text")), after, kind, *limits, kind).alias("r")).select(doc, "r.*")


def grep(docs: DataFrame, doc: str, content: str, max_lines: int | None = None, max_tokens: int | None = None, **options) -> DataFrame:
    """Search output of either form -> one row a document.  Options: max_files, distance, files_only."""
    ls = lines.explode_lines(docs, doc, content)
    head = T.trim(F.regexp_extract(F.col(content), r"^([^\r\n]*)", 1))
    agent = docs.filter(head.rlike(r"(?i)^Found \d+ match\(?e?s?\)?( in \d+ file\(?s?\)?)?$")).select(doc)
    plain = ls.join(agent, doc, "left_anti").select(doc, "line_no", greps.parse_hit(F.col("line")).alias("h")).filter("h is not null").select(doc, "line_no", "h.*")
    hits = plain.unionByName(greps.agent_hits(ls.join(agent, doc, "left_semi"), doc))
    return _condensed(docs, greps.render(hits, doc, docs=docs, **options), doc, content, "grep", (max_lines, max_tokens), "")


def ls(docs: DataFrame, doc: str, content: str, max_lines: int | None = None, max_tokens: int | None = None, **options) -> DataFrame:
    """Listings of any form -> one row a document.  Options: depth, by_type."""
    rows = lines.explode_lines(docs, doc, content)
    drawn = rows.groupBy(doc).agg(F.bool_or(F.col("line").rlike(listing.TREE)).alias("tree")).filter("tree").select(doc)
    found = listing.entries(rows.join(drawn, doc, "left_anti"), doc).unionByName(listing.tree_entries(rows.join(drawn, doc, "left_semi"), doc))
    empty = "project/ (0 files, 0 dirs)\n\nNo files" if options.get("by_type") else "project/ (0 files, 0 dirs)\n(empty)\n\nTypes: none"
    return _condensed(docs, listing.render(found, doc, roots=listing.root_names(rows, doc), **options), doc, content, "ls", (max_lines, max_tokens), empty)


def diff(docs: DataFrame, doc: str, content: str, max_lines: int | None = None, max_tokens: int | None = None, level: str = "compact") -> DataFrame:
    """Unified diffs -> one row a document, with its totals: those that a ``N files changed`` line of the text tells, else counted ones."""
    if level not in ("summary", "compact", "full"):
        raise ValueError(f"level: {level}")
    max_lines, max_tokens, foot, _ = _limits(max_lines, max_tokens)
    rows = lines.explode_lines(docs, doc, content)
    text = F.coalesce(F.col(content), F.lit(""))
    told = docs.select(doc, text.alias("text"), diffs.told_stats(T.newlines(text)).alias("told"))
    empty = F.array(F.lit("0 files changed, +0 -0"))
    if level == "summary":
        body = diffs.summary(rows, doc, told.select(doc, "told"))
        fitted = truncate.fit(F.coalesce("lines", empty), max_lines, max_tokens, "summary")
    else:
        body = diffs.chunks(rows, doc, level)
        none = F.array(F.struct(empty.alias("priority"), F.array().cast("array<string>").alias("rest")))
        fitted = truncate.fit_chunks(F.coalesce("chunks", none), max_lines, max_tokens)
    counted = diffs.stats(rows, doc)
    both = told.join(body, doc, "left").join(counted, doc, "left")
    total = lambda c: F.coalesce(F.col(f"told.{c}"), F.col(c), F.lit(0).cast("long")).alias(c)
    out = both.select(doc, _told(T.lines(F.col("text")), fitted, "diff", foot).alias("r"), *[total(c) for c in ("n_files", "additions", "deletions")], F.col("told").isNotNull().alias("told"))
    return out.select(doc, "r.*", "n_files", "additions", "deletions", "told")


def web(html: Column, max_lines: int | None = None, markdown: bool = True, max_tokens: int | None = None, mode: str = "auto", score: bool = False, footer: bool = True) -> Column:
    """A page.  mode: ``page`` (its text), ``dense`` (the densest element's), ``snapshot`` (the DOM's), ``code`` (code
    blocks), ``auto``: the page's, or the densest element's for a large page or one whose text is empty, or else the
    bare text without tags.  ``source`` of the result says which.  score: a line of the densest element's figures."""
    max_lines, max_tokens, foot, scored = _limits(max_lines, max_tokens, score)
    if not footer:
        foot = scored = False

    def told(p: Column) -> Column:
        ls = T.lines(T.rtrim_lines(p["text"]))
        whole = _told(T.lines(F.coalesce(p["html"], F.lit(""))), truncate.fit(T.bound(ls, _inner), max_lines, max_tokens, "web"), "markdown" if markdown else "text", foot, score=p["score_line"] if scored else None)
        return F.struct(whole.alias("r"), p["source"].alias("source"))

    read = webpage.read_as(html, markdown, mode, scored)
    page = F.struct(html.alias("html"), *[read[c].alias(c) for c in ("text", "source", "score_line")])
    return T.bound(T.bound(page, told), lambda v: F.struct(*[v["r"][c].alias(c) for c in RESULT], v["source"].alias("source")))


def _inner(ls: Column) -> Column:
    """Without the empty lines at both ends; one stays if there is nothing else."""
    at = F.filter(F.transform(ls, lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull())
    cut = lambda v: F.slice(v["ls"], v["first"] + 1, v["last"] - v["first"] + 1)
    ends = T.bound(F.struct(ls.alias("ls"), at.alias("at")), lambda v: F.struct(v["ls"].alias("ls"), F.array_min(v["at"]).alias("first"), F.array_max(v["at"]).alias("last")))
    return T.bound(ends, lambda v: F.when(v["first"].isNull(), F.slice(v["ls"], 1, 1)).otherwise(cut(v)))


#: The fields of a result.
RESULT = ("output", "original_size", "compressed_size", "ratio", "format", "budget_exceeded")


def api(content: Column, max_lines: int | None = None, max_tokens: int | None = None, **options) -> Column:
    """A JSON payload: pruned, then fitted like text (its one line can only be kept or replaced by a marker).

    What isn't an object or array passes as it is, without a footer; its sizes are characters.
    """
    max_lines, max_tokens, foot, _ = _limits(max_lines, max_tokens)
    counts = ("fields_removed", "arrays_truncated", "depth_limited", "nulls_removed")

    def told(r: Column) -> Column:
        whole = _told(T.lines(F.coalesce(r["content"], F.lit(""))), truncate.fit(T.lines(r["p"]["output"]), max_lines, max_tokens, "api"), "api", foot, by_lines=True)
        n, m = F.length(F.coalesce(r["content"], F.lit(""))), F.length(F.coalesce(r["p"]["output"], F.lit("")))
        plain = F.struct(r["p"]["output"].alias("output"), n.alias("original_size"), m.alias("compressed_size"), F.when(r["p"]["valid"], T.ratio(n, m)).otherwise(F.lit(1.0)).alias("ratio"), F.lit("api").alias("format"), F.lit(False).alias("budget_exceeded"))
        error = F.when(~r["p"]["valid"], "Invalid JSON input").alias("error")
        out = lambda v: F.struct(*[v["o"][c].alias(c) for c in RESULT], *[v["p"][c].alias(c) for c in counts], v["e"].alias("error"))
        return T.bound(F.struct(F.when(r["p"]["nested"], whole).otherwise(plain).alias("o"), r["p"].alias("p"), error.alias("e")), out)

    return T.bound(F.struct(content.alias("content"), jsonprune.prune_json(content, **options).alias("p")), told)


def search(content: Column, query: Column | str = "", max_results: int = 10, max_lines: int | None = None, max_tokens: int | None = None) -> Column:
    """A JSON array of results as a numbered list."""
    asked = F.lit(query) if isinstance(query, str) else query
    after = searches.rendered(searches.parse_results(content), asked, limit(max_results) or 10)
    return _result(T.lines(F.coalesce(content, F.lit(""))), after, "search", max_lines, max_tokens, "search", by_lines=True)
