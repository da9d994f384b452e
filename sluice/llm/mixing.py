"""Mixing sources to target weights: hierarchical budgets and seeded token prefixes.

The corpus is a tree: domain, language, source.  A budget of tokens flows down
from the root; at each node the children share it by their weights, a child
never gets more than its subtree can give (its tokens times MAX_EPOCHS), and
what it can't take goes to its siblings by weight before the node passes any
shortage up.  With children in the order of capacity / weight, the level at
which the budget is used up is the largest of (budget - capacities before) /
(weights from here on); running sums go over bins of that ratio first and then
within each bin, so a node with millions of children is worked on by many tasks.

A leaf with budget b and a tokens gives floor(b / a) whole epochs and, of the
next epoch, the documents of the longest prefix with at most b mod a tokens,
in that epoch's order: by a hash of (seed, epoch, id).  The order is cut into
many buckets by the hash's first bits, so a leaf with a third of all documents
is summed up and cut by many tasks.

Tokens are words.  Defined results: null domain, language or source are values
like others (``und``, ``none``).  Weights not named take the default; weight 0
excludes a subtree.  A text without words costs nothing and goes with the
prefix it falls in, but an epoch that gets no token gives none; a leaf without
any word gives nothing.  No row is given more than MAX_EPOCHS times.  Rows that
share their id are ordered by their text's hash; those of equal id, text,
language and source are copies of one row: which of them is given is arbitrary,
how many are is not.  Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, LOW, SPACE_RE, SPACES, written

#: Rows that a bucket of a leaf with all documents would hold; from that the number of buckets.
BUCKET_ROWS = 2_000
#: Leaves with at least this share of the rows are joined by broadcast: at most 1 / HOT of them.
HOT = 1 / 1024


@dataclass(frozen=True)
class Mix:
    """Production parameters: weights by level, the default of a level under the name ``*``."""

    domain: dict = field(default_factory=lambda: {"web": 0.5, "books": 0.3, "forums": 0.2, "*": 0.05})
    lang: dict = field(default_factory=lambda: {"en": 0.6, "fr": 0.15, "de": 0.15, "es": 0.1, "*": 0.05})
    source: dict = field(default_factory=lambda: {"*": 1.0})
    share: float = 0.8  # of all tokens
    max_epochs: int = 2
    seed: int = 42


def domain_of(source: Column) -> Column:
    """The default mapping of sources to domains, for tables whose sources are numbered: a parameter of the operator.

    Sources are numbered: 0 to 7 are web crawls, 8 to 13 books, higher ones forums."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,6})$", 1)
    return F.when(n == "", "other").when(n.cast("int") < 8, "web").when(n.cast("int") < 14, "books").otherwise("forums")


def _weight(level: dict, col: Column) -> Column:
    out = F.lit(float(level.get("*", 0.0)))
    for name, w in sorted(level.items()):
        if name != "*":
            out = F.when(col == name, F.lit(float(w))).otherwise(out)
    return out


#: Bins of capacity / weight an octave, in which running sums are taken first.
BINS = 64


def _sum(col: str, window, start: int, end: int) -> Column:
    return F.coalesce(F.sum(col).over(window.rowsBetween(start, end)), F.lit(0.0))


def _fill(nodes: DataFrame, parent: list[str], key: str, parents: int) -> DataFrame:
    """nodes (parent.., key, w, cap, budget of the parent) -> their own budget, ``got``.  parents: at most so many; no
    parent columns: the nodes are the root's children."""
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    ratio = F.col("cap") / F.col("w")
    nodes = nodes.withColumn("bin", F.floor(F.log2(ratio) * BINS).cast("int"))
    # a row for each bin that a parent's children fall in: doubles have some 2,000 octaves
    over = Window.partitionBy(*parent).orderBy("bin")
    bins = nodes.groupBy(*parent, "bin").agg(F.sum("cap").alias("c"), F.sum("w").alias("v"))
    bins = bins.select(*parent, "bin", _sum("c", over, first, -1).alias("before"), _sum("v", over, 1, last).alias("after"))
    inside = Window.partitionBy(*parent, "bin").orderBy(ratio, key)
    level = (F.col("budget") - F.col("before") - _sum("cap", inside, first, -1)) / (_sum("w", inside, 0, last) + F.col("after"))
    levels = nodes.join(bins, [*parent, "bin"]).withColumn("l", level).groupBy(*parent).agg(F.max("l").alias("level"))
    got = F.greatest(F.lit(0.0), F.least("cap", F.col("w") * F.col("level")))
    nodes = nodes.drop("bin")
    if parent:
        nodes = _with(nodes, levels, parent, parents)
    else:  # the root's children: one number
        nodes = nodes.withColumn("level", F.lit(levels.first()["level"]).cast("double"))
    return nodes.withColumn("got", got).drop("level")


def _with(rows: DataFrame, nodes: DataFrame, keys: list[str], n: int) -> DataFrame:
    """rows with the columns of their node; nodes, n at most, are broadcast if they are few, else joined by shuffle."""
    return rows.join(F.broadcast(nodes) if n <= BROADCAST_IDS else nodes, keys)


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, a, got) of leaves (domain, lang, source, a tokens)."""
    weighed = leaves.withColumns(
        {
            "w3": _weight(mix.source, F.col("source")),
            "w2": _weight(mix.lang, F.col("lang")),
            "w1": _weight(mix.domain, F.col("domain")),
            "cap3": (F.col("a") * mix.max_epochs).cast("double"),
        }
    ).filter("w1 > 0 and w2 > 0 and w3 > 0 and a > 0")
    told = leaves.agg(F.sum("a").alias("a"), F.count_distinct("domain", "lang").alias("n")).first()
    n, budget = told["n"], float(math.floor((told["a"] or 0) * mix.share))
    langs = weighed.groupBy("domain", "lang").agg(F.sum("cap3").alias("cap"), F.first("w2").alias("w"), F.first("w1").alias("w1"))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"), F.first("w1").alias("w"))
    top = _fill(domains.withColumn("budget", F.lit(budget)), [], "domain", 1)
    mid = _fill(_with(langs.drop("w1"), top.select("domain", F.col("got").alias("budget")), ["domain"], n), ["domain"], "lang", n)
    low = weighed.select("domain", "lang", "source", "a", F.col("w3").alias("w"), F.col("cap3").alias("cap"))
    low = _with(low, written(low.sparkSession, mid.select("domain", "lang", F.col("got").alias("budget")), "budgets"), ["domain", "lang"], n)
    low = _fill(low, ["domain", "lang"], "source", n)
    return low.select("domain", "lang", "source", "a", "got")


def tokens_of(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACE_RE))).cast("long")


def _chosen(spark: SparkSession, docs: DataFrame, mix: Mix, id_col: str, text_col: str, lang_col: str, source_col: str, domain: Callable) -> DataFrame:
    """Per row: id, mark (of its text, language and source), domain, lang, source, tokens, copies."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(text_col), F.col(lang_col), F.col(source_col)).alias("mark"),
        domain(F.col(source_col)).alias("domain"),
        F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"),
        F.coalesce(F.col(source_col), F.lit("none")).alias("source"),
        tokens_of(F.col(text_col)).alias("tokens"),
    )
    rows = written(spark, rows, "tokens")
    leaf = ["domain", "lang", "source"]
    leaves = written(spark, rows.groupBy(*leaf).agg(F.sum("tokens").alias("a"), F.count("*").alias("rows")), "leaves")
    total = leaves.agg(F.sum("rows").alias("n")).first()["n"] or 0
    b = F.floor("got").cast("long")
    plan = budgets(leaves, mix).select(*leaf, F.floor(b / F.col("a")).cast("int").alias("whole"), (b % F.col("a")).alias("left"))
    plan = leaves.select(*leaf, "rows").join(plan, leaf, "left")
    plan = written(spark, plan.select(*leaf, "rows", F.struct("whole", "left").alias("p")), "plan")
    if plan.count() <= BROADCAST_IDS:
        placed = rows.join(F.broadcast(plan.drop("rows")), leaf)
    else:
        hot = F.col("rows") >= F.lit(total * HOT)
        first = rows.join(F.broadcast(plan.filter(hot).drop("rows")), leaf, "left")
        placed = first.filter("p is not null").unionByName(first.filter("p is null").drop("p").join(plan.filter(~hot).drop("rows"), leaf))
    placed = placed.select("*", "p.*").drop("p")
    placed = placed.withColumn("h", F.xxhash64(F.lit(mix.seed), "whole", "id"))
    bits = max(4, min(20, (total // BUCKET_ROWS).bit_length()))
    placed = placed.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    placed = written(spark, placed, "placed")
    sums = placed.groupBy(*leaf, "bucket").agg(F.sum("tokens").alias("t"))
    upto = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("t").over(upto), F.lit(0))).drop("t")
    inside = Window.partitionBy(*leaf, "bucket").orderBy("h", "id", "mark")
    end = F.col("before") + F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chosen = placed.join(sums, [*leaf, "bucket"]).withColumn("end", end)
    more = (F.col("left") > 0) & (F.col("end") <= F.col("left")) & (F.col("whole") < mix.max_epochs)
    copies = F.coalesce(F.least(F.col("whole"), F.lit(mix.max_epochs)) + more.cast("int"), F.lit(0))
    return chosen.select("id", "mark", *leaf, "tokens", copies.alias("copies"))


def mix_sources(spark: SparkSession, docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain: Callable[[Column], Column] = domain_of) -> DataFrame:
    """Per row: id, domain, lang, source, tokens, copies (how many epochs give it; 0: none).  domain: source -> domain."""
    chosen = _chosen(spark, docs, mix, id_col, text_col, lang_col, source_col, domain)
    return chosen.select(F.col("id").alias(id_col), "domain", "lang", "source", "tokens", "copies")


def mixed_documents(spark: SparkSession, docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain: Callable[[Column], Column] = domain_of) -> DataFrame:
    """The rows of docs, each as often as epochs give it.

    Of rows with equal id, text, language and source one stands for all: it is given as often as they are together.
    """
    chosen = written(spark, _chosen(spark, docs, mix, id_col, text_col, lang_col, source_col, domain), "copies")
    low = F.coalesce(F.col("id").cast("long"), F.lit(LOW)).alias("sluice_id")
    ids = chosen.groupBy(low).agg(F.count("*").alias("n"), F.sum("copies").alias("sluice_copies"))
    ids = written(spark, ids, "chosen")
    docs = docs.withColumn("sluice_id", F.coalesce(F.col(id_col).cast("long"), F.lit(LOW)))
    cols = [c for c in docs.columns if c != "sluice_id"]
    side = lambda t, n: F.broadcast(t) if n <= BROADCAST_IDS else t.hint("shuffle_hash")
    once = ids.filter("n = 1 and sluice_copies > 0").drop("n")
    out = docs.join(side(once, once.count()), "sluice_id")
    again = ids.filter("n > 1 and sluice_copies > 0").select("sluice_id")
    if (n := again.count()) > 0:
        # Rows that share their id are told apart by their marks.  A mark's rows are dropped to one, so none is a hot key.
        marks = chosen.select(low, F.col("mark").alias("sluice_mark"), "copies").join(side(again, n), "sluice_id")
        marks = marks.groupBy("sluice_id", "sluice_mark").agg(F.sum("copies").alias("sluice_copies")).filter("sluice_copies > 0")
        some = docs.join(side(again, n), "sluice_id").withColumn("sluice_mark", F.xxhash64(F.col(text_col), F.col(lang_col), F.col(source_col)))
        some = some.dropDuplicates(["sluice_id", "sluice_mark"]).join(marks, ["sluice_id", "sluice_mark"]).drop("sluice_mark")
        out = out.unionByName(some)
    return out.withColumn("sluice_nth", F.explode(F.sequence(F.lit(1), F.col("sluice_copies").cast("int")))).select(*cols)
