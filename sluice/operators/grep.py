"""Search hits in files: parsing, grouping by file, blocks of neighbouring hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# file:line:col:text, file:line:text, file:line-text, file-line-text, tried in this order
FORMS = (r"^(.+):(\d+):(\d+):(.*)$", r"^(.+):(\d+):()(.*)$", r"^(.+):(\d+)-()(.*)$", r"^(.+)-(\d+)-()(.*)$")


def parse_hit(line: Column) -> Column:
    """STRUCT(file, line, col, text); null where no form fits."""
    out = F.lit(None)
    for form in reversed(FORMS):
        part = lambda k, form=form: F.regexp_extract(line, form, k)
        hit = F.struct(part(1).alias("file"), part(2).cast("int").alias("line"), F.nullif(part(3), F.lit("")).cast("int").alias("col"), part(4).alias("text"))
        out = F.when(line.rlike(form) & (part(2).cast("int") > 0), hit).otherwise(out)
    return out


def group_by_file(hits: DataFrame, doc: str = "doc_id", max_files: int = 20) -> DataFrame:
    """Per document and file: hits, rank by count and name, whether shown; and totals of what is hidden."""
    per = hits.groupBy(doc, "file").agg(F.count("*").alias("n_hits"))
    rank = F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("n_hits"), "file"))
    ranked = per.withColumn("rank", rank).withColumn("shown", F.col("rank") <= max_files)
    every = Window.partitionBy(doc)
    return ranked.withColumns(
        {
            "hidden_files": F.sum((~F.col("shown")).cast("long")).over(every),
            "hidden_hits": F.sum(F.when(~F.col("shown"), F.col("n_hits")).otherwise(0)).over(every),
        }
    )


def blocks(hits: DataFrame, doc: str = "doc_id", distance: int = 3) -> DataFrame:
    """Hits of a file whose lines are at most ``distance`` apart make a block."""
    order = Window.partitionBy(doc, "file").orderBy("line", F.coalesce("col", F.lit(0)))
    new = F.coalesce(F.col("line") - F.lag("line").over(order) > distance, F.lit(True))
    numbered = hits.withColumn("new", new.cast("int")).withColumn("block", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(doc, "file", "block").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count("*").alias("n_hits"))


def common_prefix(hits: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The longest common path prefix, cut back to a separator; empty with fewer than two files."""
    ends = hits.groupBy(doc).agg(F.min("file").alias("a"), F.max("file").alias("b"))
    same = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("a"), F.length("b")))), lambda i: F.substr(F.col("a"), F.lit(1), i) == F.substr(F.col("b"), F.lit(1), i))
    lcp = F.substr(F.col("a"), F.lit(1), F.coalesce(F.array_max(same), F.lit(0)))
    cut = F.regexp_extract(lcp, r"^(.*[/\\])", 1)
    return ends.select(doc, F.when(F.col("a") == F.col("b"), "").otherwise(cut).alias("prefix"))


def agent_hits(ls: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Hits of the grouped form: a path on its own line, below it indented ``N: text`` or ``Line N: text``."""
    c, t = F.col("line"), T.trim(F.col("line"))
    path = ~c.rlike(r"^[ \t]") & t.rlike(r"[/\\\\]|^[A-Za-z]:") & ~t.rlike(r"^\d+:")
    w = Window.partitionBy(doc).orderBy("line_no")
    file = F.last(F.when(path, F.regexp_replace(t, ":$", "")), ignorenulls=True).over(w)
    hit = r"^\s+(?:Line )?(\d+):\s*(.*)$"
    n = F.regexp_extract(c, hit, 1).try_cast("int")
    found = ls.withColumns({"file": file, "n": n}).filter("file is not null and n > 0")
    return found.select(doc, "line_no", "file", F.col("n").alias("line"), F.lit(None).cast("int").alias("col"), F.regexp_extract(c, hit, 2).alias("text"))


def _count(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), T.pluralize(word, n))


def render(hits: DataFrame, doc: str = "doc_id", max_files: int = 20, distance: int = 3, files_only: bool = False, docs: DataFrame | None = None) -> DataFrame:
    """(doc, lines): totals, then each file's blocks; files beyond ``max_files`` are only counted.

    Hits are rows until each line is text.  docs: ids that get a line even without hits.
    """
    ranked = group_by_file(hits, doc, max_files)
    row = lambda a, b, c, d, text: F.struct(a.alias("rank"), b.alias("block"), c.alias("nth"), F.lit(d).alias("sub"), text.alias("line"))
    zero, last = F.lit(0).cast("long"), F.lit(max_files + 1)
    totals = ranked.groupBy(doc).agg(F.sum("n_hits").alias("n"), F.count("*").alias("k"), F.max("hidden_files").alias("hf"), F.max("hidden_hits").alias("hh"))
    if docs is not None:
        totals = docs.select(doc).join(totals, doc, "left").fillna(0, ["n", "k", "hf", "hh"])
    head = totals.select(doc, row(F.lit(0), zero, zero, 0, F.concat(_count(F.col("n"), "match"), F.lit(" in "), _count(F.col("k"), "file"))).alias("r"))
    more = F.concat(F.lit("... and "), F.col("hf").cast("string"), F.lit(" more "), T.pluralize("file", F.col("hf")), F.lit(" ("), _count(F.col("hh"), "match"), F.lit(")"))
    gap = [row(last, zero, zero, 0, F.lit(""))] if max_files > 0 else []
    rest = totals.filter("hf > 0").select(doc, F.explode(F.array(*gap, row(last, zero, zero, 1, more))).alias("r"))

    shown = ranked.filter("shown").join(common_prefix(hits, doc), doc)
    cut = F.substr(F.col("file"), F.length("prefix") + 1)
    name = F.concat(F.when(cut == "", F.col("file")).otherwise(cut), F.lit(" ("), _count(F.col("n_hits"), "match"), F.lit(")" if files_only else "):"))
    titles = shown.select(doc, F.explode(F.array(row(F.col("rank"), zero, zero, 0, F.lit("")), row(F.col("rank"), zero, zero, 1, name))).alias("r"))
    out = head.unionByName(rest).unionByName(titles)
    if not files_only:
        order = Window.partitionBy(doc, "file").orderBy("line", F.coalesce("col", F.lit(0)), "line_no")
        new = F.coalesce(F.col("line") - F.lag("line").over(order) > distance, F.lit(True)).cast("int")
        own = hits.join(ranked.filter("shown").select(doc, "file", "rank"), [doc, "file"]).withColumn("new", new)
        own = own.withColumn("block", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        block = Window.partitionBy(doc, "file", "block")
        own = own.withColumns({
            "nth": F.row_number().over(block.orderBy("line", F.coalesce("col", F.lit(0)), "line_no")).cast("long"),
            "n": F.count("*").over(block), "a": F.min("line").over(block), "b": F.max("line").over(block),
        })
        n, nth = F.col("n"), F.col("nth")
        place = F.concat(F.lit(":"), F.concat_ws(":", F.col("line").cast("string"), F.col("col").cast("string")), F.when(F.col("text") != "", F.concat(F.lit(" "), "text")).otherwise(""))
        spread = F.concat(F.col("a").cast("string"), F.when(F.col("a") != F.col("b"), F.concat(F.lit("-"), F.col("b").cast("string"))).otherwise(""))
        title = F.when((nth == 1) & (n > 1), F.concat(F.lit("  :"), spread, F.lit(" ("), _count(n, "match"), F.lit(")")))
        line = F.when(n == 1, F.concat(F.lit("  "), place)).when((n <= 4) | (nth <= 2) | (nth == n), F.concat(F.lit("    "), place))
        note = F.when((n > 4) & (nth == 2), F.concat(F.lit("    ... ("), (n - 3).cast("string"), F.lit(" more nearby "), T.pluralize("match", n - 3), F.lit(")")))
        at = [row(F.col("rank"), F.col("block"), nth, k, x) for k, x in enumerate((title, line, note))]
        out = out.unionByName(own.select(doc, F.explode(F.array(*at)).alias("r")).filter("r.line is not null"))
    return out.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["line"]).alias("lines"))
