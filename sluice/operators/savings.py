"""What condensing saves, by groups, and texts that are equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def rollup(rows: DataFrame, before: Column, after: Column, *keys: str) -> DataFrame:
    """For each prefix of keys (null: all): texts, characters before and after, and the percentage saved."""
    sized = rows.select(*keys, F.length(before).cast("long").alias("b"), F.length(after).cast("long").alias("a"))
    out = sized.rollup(*keys).agg(F.count("*").alias("n_docs"), F.sum("b").alias("chars_before"), F.sum("a").alias("chars_after"))
    return out.withColumn("saved_percent", T.saved_percent(F.col("chars_before"), F.col("chars_after")))


def first_of_copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Equal texts by their hash: the smallest id and how many there are.  Null texts are equal to each other."""
    return docs.groupBy(F.sha2(text_col, 256).alias("h")).agg(F.min(id_col).alias(id_col), F.count("*").alias("n_copies"))
