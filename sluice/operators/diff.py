"""Unified diffs as rows: files and hunks by carried-forward headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import truncate


def numbered(ls: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Lines with their file_no and hunk_no (null before the first)."""
    w = Window.partitionBy(doc).orderBy("line_no")
    c = F.col("line")
    files = ls.withColumn("file_no", F.nullif(F.count_if(c.startswith("diff --git ")).over(w), F.lit(0)))
    wf = Window.partitionBy(doc, "file_no").orderBy("line_no")
    hunk = F.nullif(F.count_if(c.startswith("@@ ")).over(wf), F.lit(0))
    return files.withColumn("hunk_no", hunk).filter("file_no is not null")


def _added(inside: Column) -> Column:
    return inside & F.col("line").startswith("+") & ~F.col("line").startswith("+++")


def _removed(inside: Column) -> Column:
    return inside & F.col("line").startswith("-") & ~F.col("line").startswith("---")


def hunks(ls: DataFrame, doc: str = "doc_id") -> DataFrame:
    n = numbered(ls, doc).filter("hunk_no is not null")
    yes = F.lit(True)
    return n.groupBy(doc, "file_no", "hunk_no").agg(
        F.min_by("line", "line_no").alias("header"), F.count_if(_added(yes)).alias("additions"), F.count_if(_removed(yes)).alias("deletions")
    )


def files(ls: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row a file: operation (A before D; R by rename lines, or a similarity and other paths), paths, counts."""
    n, c, inside = numbered(ls, doc), F.col("line"), F.col("hunk_no").isNotNull()
    first = lambda cond, value: F.min_by(F.when(cond, value), F.when(cond, F.col("line_no")))
    head = first(c.startswith("diff --git "), c)
    rename = lambda way: first(c.startswith(f"rename {way} "), F.substr(c, F.lit(len(way) + 9)))
    g = n.groupBy(doc, "file_no").agg(
        head.alias("head"), rename("from").alias("rf"), rename("to").alias("rt"),
        F.max(F.regexp_extract(c, r"^similarity index (\d+)%", 1).try_cast("int")).alias("similarity"),
        F.bool_or(c.startswith("new file mode")).alias("new"), F.bool_or(c.startswith("deleted file mode")).alias("gone"),
        F.bool_or(c.startswith("Binary files ") | c.startswith("GIT binary patch")).alias("binary"),
        F.count_if(_added(inside)).alias("additions"), F.count_if(_removed(inside)).alias("deletions"),
    )
    path = lambda k: T.git_path(F.regexp_extract("head", r'^diff --git ("?a/.*?"?) ("?b/.*"?)$', k))
    old, new = F.coalesce(T.git_path(F.col("rf")), path(1)), F.coalesce(T.git_path(F.col("rt")), path(2))
    renamed = F.col("rf").isNotNull() | F.col("rt").isNotNull() | (F.col("similarity").isNotNull() & (old != new))
    op = F.when(renamed, "R").when(F.col("new"), "A").when(F.col("gone"), "D").otherwise("M")
    return g.select(doc, "file_no", op.alias("op"), old.alias("old_path"), new.alias("new_path"), "similarity", "additions", "deletions", "binary")


def stats(ls: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document: files, additions, deletions."""
    return files(ls, doc).groupBy(doc).agg(F.count("*").alias("n_files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))


def summary_line() -> Column:
    """A line for a row of files(): operation, path or move, and the counts that say something."""
    some = lambda sign, c: F.when(F.col(c) > 0, F.concat(F.lit(sign), F.col(c).cast("string")))
    plus = F.when(F.col("op") != "D", some("+", "additions"))
    minus = F.when(F.col("op") != "A", some("-", "deletions"))
    parts = F.concat_ws(" ", plus, minus)
    delta = F.when(parts != "", F.concat(F.lit(" ("), parts, F.lit(")"))).otherwise("")
    alike = F.when(F.col("similarity").isNotNull(), F.format_string(" (similarity %d%%)", "similarity")).otherwise("")
    path = F.when(F.col("op") == "D", F.col("old_path")).otherwise(F.col("new_path"))
    plain = F.concat("op", F.lit(" "), path, delta, F.when(F.col("binary"), " (binary)").otherwise(""))
    return F.when(F.col("op") == "R", F.concat(F.lit("R "), "old_path", F.lit(" → "), "new_path", alike)).otherwise(plain)


def told_stats(content: Column) -> Column:
    """STRUCT(n_files, additions, deletions) of the first ``N files changed`` line of a text; null without one."""
    gap = r"[^\S\n]+"
    line = rf"(?i)(\d+){gap}files?{gap}changed(?:,{gap}(\d+){gap}insertions?\(\+\))?(?:,{gap}(\d+){gap}deletions?\(-\))?"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(content, line, k), F.lit("")).cast("long"), F.lit(0).cast("long"))
    return F.when(content.rlike(line), F.struct(part(1).alias("n_files"), part(2).alias("additions"), part(3).alias("deletions")))


def summary(ls: DataFrame, doc: str = "doc_id", told: DataFrame | None = None) -> DataFrame:
    """(doc, lines): the totals, then a line a file.  told: (doc, told) with what told_stats read from the text, which goes before."""
    each = files(ls, doc).select(doc, "file_no", summary_line().alias("line"), "additions", "deletions")
    per = each.groupBy(doc).agg(
        F.count("*").alias("n_files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"),
        F.transform(F.array_sort(F.collect_list(F.struct("file_no", "line"))), lambda x: x["line"]).alias("files"),
    )
    if told is not None:
        per = told.join(per, doc, "left")
    pick = lambda c: F.coalesce(F.col(f"told.{c}") if told is not None else F.lit(None), F.col(c), F.lit(0).cast("long"))
    first = F.format_string("%d files changed, +%d -%d", pick("n_files"), pick("additions"), pick("deletions"))
    none = F.array().cast("array<string>")
    return per.select(doc, F.concat(F.array(first), F.coalesce("files", none)).alias("lines"))


def chunks(ls: DataFrame, doc: str = "doc_id", level: str = "compact") -> DataFrame:
    """(doc, chunks): for each file its lines that come first (head and first hunk) and the rest.

    ``compact``: a summary line and the changed lines; ``full``: the file's own lines.
    """
    if level not in ("compact", "full"):
        raise ValueError(f"level: {level}")
    n = numbered(ls, doc)
    row = lambda at, line, part=0: F.struct(at.alias("at"), F.lit(part).alias("part"), line.alias("line"))
    place = F.col("line_no").cast("long")
    if level == "full":
        w = Window.partitionBy(doc, "file_no")
        raw = n.withColumns({"hunks": F.max("hunk_no").over(w), "nth": F.row_number().over(w.orderBy("line_no"))})
        first = F.when(F.col("hunks").isNull(), F.col("nth") <= 6).otherwise(F.coalesce("hunk_no", F.lit(1)) <= 1)
        rows = raw.select(doc, "file_no", first.alias("first"), row(place, F.col("line")).alias("r"))
    else:
        each = files(ls, doc).select(doc, "file_no", summary_line().alias("line"), "binary")
        low = F.lit(-(1 << 62)).cast("long")
        heads = each.select(doc, "file_no", F.lit(True).alias("first"), row(low, F.col("line")).alias("r"))
        inside = n.filter("hunk_no is not null").join(each.filter("binary").select(doc, "file_no"), [doc, "file_no"], "left_anti")
        change = F.col("line").rlike(r"^[-+\\]")
        shown = inside.filter(change | F.col("line").startswith("@@ "))
        shown = shown.select(doc, "file_no", (F.col("hunk_no") == 1).alias("first"), row(place, F.col("line")).alias("r"))
        per = inside.groupBy(doc, "file_no", "hunk_no").agg(F.max("line_no").cast("long").alias("line_no"), F.count_if(change).alias("n"))
        idle = per.filter("n = 0").select(doc, "file_no", (F.col("hunk_no") == 1).alias("first"), row(F.col("line_no"), F.lit("  ... context omitted ..."), 1).alias("r"))
        bare = each.join(inside.select(doc, "file_no").distinct(), [doc, "file_no"], "left_anti")
        note = F.when(F.col("binary"), "Binary file changed").otherwise("No textual hunks")
        notes = bare.select(doc, "file_no", F.lit(True).alias("first"), row(low + 1, note).alias("r"))
        rows = heads.unionByName(shown).unionByName(idle).unionByName(notes)
    part = lambda yes: F.transform(F.array_sort(F.collect_list(F.when(F.col("first") == yes, F.col("r")))), lambda x: x["line"])
    per_file = rows.groupBy(doc, "file_no").agg(part(True).alias("priority"), part(False).alias("rest"))
    ordered = F.array_sort(F.collect_list(F.struct("file_no", "priority", "rest")))
    return per_file.groupBy(doc).agg(F.transform(ordered, lambda x: F.struct(x["priority"].alias("priority"), x["rest"].alias("rest"))).alias("chunks"))


def render(ls: DataFrame, doc: str = "doc_id", level: str = "compact") -> DataFrame:
    """(doc, lines): a summary (and, unless ``summary``, each file's hunks: changed lines only if ``compact``)."""
    if level == "summary":
        return summary(ls, doc)
    return chunks(ls, doc, level).select(doc, truncate.flat(F.col("chunks")).alias("lines"))
