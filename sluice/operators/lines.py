"""Ordered operators over the lines of documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T


def explode_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no from 0, line)."""
    return docs.select(id_col, F.posexplode(T.lines(F.col(text_col))).alias("line_no", "line"))


def filter_noise(ls: DataFrame, id_col: str) -> DataFrame:
    """Noise lines go; a run of three or more leaves a hint in its place (gaps and islands)."""
    doc = Window.partitionBy(id_col).orderBy("line_no")
    flagged = ls.withColumn("noise", T.is_noise(F.col("line")))
    turned = flagged.withColumn("turn", (F.col("noise") != F.lag("noise", 1, False).over(doc)).cast("int"))
    island = turned.withColumn("island", F.sum("turn").over(doc))
    run = Window.partitionBy(id_col, "island")
    sized = island.withColumns({"n": F.count("*").over(run), "first": F.min("line_no").over(run)})
    hint = F.concat(F.lit("  ... ("), F.col("n").cast("string"), F.lit(" progress/noise lines filtered)"))
    kept = sized.filter(~F.col("noise") | ((F.col("n") >= 3) & (F.col("line_no") == F.col("first"))))
    return kept.select(id_col, "line_no", F.when(F.col("noise"), hint).otherwise(F.col("line")).alias("line"))


def line_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document: lines, blank, error, warning, noise lines and tokens.

    Lines are counted in their row: each is trimmed and tested once, and no
    line is shuffled.  A row of equal id is a document of its own; of a null
    text every count is null.
    """
    tokens = lambda x: F.ceil((T.units(x) + 1) / 4).cast("long")
    told = lambda x: F.struct(T.findings(x).alias("f"), T.is_blank(x).alias("blank"), tokens(x).alias("t"))
    per = docs.select(id_col, F.transform(T.lines(F.col(text_col)), told).alias("l"))
    count = lambda test: F.size(F.filter("l", test)).cast("long")
    return per.select(
        id_col, F.size("l").cast("long").alias("n_lines"), count(lambda v: v["blank"]).alias("n_blank"), count(lambda v: v["f"]["error"]).alias("n_error"),
        count(lambda v: v["f"]["warning"]).alias("n_warning"), count(lambda v: v["f"]["noise"]).alias("n_noise"),
        F.aggregate("l", F.lit(0).cast("long"), lambda a, v: a + v["t"]).alias("n_tokens"),
    )


def similar(a: str, b: str) -> bool:
    if not a or not b:
        return False
    if a == b:
        return True
    short, long = sorted((len(a), len(b)))
    if short / long < 0.7 or short > 500:
        return False
    return sum(x == y for x, y in zip(a, b)) / long > 0.8


def _hint(n: int, what: str) -> str:
    return f"  ... ({n} {what})"


def without_noise(ls: list, norms: list, noise: list) -> tuple[list, list]:
    """Noise goes; runs of three or more leave a hint in their place.  (lines, normalised lines)"""
    out, told, run = [], [], 0
    for x, norm, bad in zip([*ls, None], [*norms, None], [*noise, False]):
        if bad:
            run += 1
            continue
        if run >= 3:
            out.append(_hint(run, "progress/noise lines filtered"))
            told.append(f"... ({'N' if run < 10**6 else 'H'} progress/noise lines filtered)")
        run = 0
        out.append(x)
        told.append(norm)
    return out[:-1], told[:-1]


def without_repeats(ls: list, norms: list) -> list:
    """Runs of three or more lines similar to the run's first; each is anchored there, so this is a scan in order."""
    out, i = [], 0
    while i < len(ls):
        j = i + 1
        while j < len(ls) and similar(norms[i], norms[j]):
            j += 1
        out += [ls[i], _hint(j - i - 2, "similar lines omitted"), ls[j - 1]] if j - i >= 3 else ls[i:j]
        i = j
    return out


@F.pandas_udf(ArrayType(StringType()))
def _collapsed(lines: pd.Series, norms: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else without_repeats(list(a), list(b)) for a, b in zip(lines, norms)])


@F.pandas_udf(ArrayType(StringType()))
def _quiet(lines: pd.Series, norms: pd.Series, noise: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else without_repeats(*without_noise(list(a), list(b), list(c))) for a, b, c in zip(lines, norms, noise)])


def collapse_repeats(ls: Column) -> Column:
    return _collapsed(ls, F.transform(ls, T.normalize_line))


def quiet(ls: Column) -> Column:
    """Noise goes, then repeats: one pass over a document's lines, tested and normalised before by built-in functions."""
    return _quiet(ls, F.transform(ls, T.normalize_line), F.transform(ls, T.is_noise))


def first_of_equal(ls: DataFrame, id_col: str) -> DataFrame:
    """Lines of a document that are equal but for case and outer space: the first stays."""
    t = F.lower(T.trim(F.col("line")))
    w = Window.partitionBy(id_col, t).orderBy("line_no")
    return ls.filter(t != "").withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")
