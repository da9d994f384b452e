"""Sharding by sampled splitters (law: bytes).

Records are in the order of (hash of the text, id).  A sample of keys, drawn
with weights by size, gives quantile boundaries; they cut the order into many
fine ranges.  The exact bytes of every range are counted, and a range much
fuller than the mean is subdivided by further samples from it, so the copies of
one text, which lie together, are dealt over as many ranges as their bytes
need.  Ranges are ordered inside by one task each; running totals of the ranges
give each record its exact place in the whole order, and the shard is the
eighth of all bytes in which the middle of the record lies: shards differ by at
most about one record's size.

Defined results.  Null text: 1 byte (none plus 1), text hash 0 as of empty
text.  Null ids come first among equal texts.  Repeated rows get slots of their
own.  Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Fine ranges: one for ROWS_A_RANGE rows, within these bounds.
RANGES, ROWS_A_RANGE, MOST_RANGES = 32, 4_000, 65_536
#: Sampled keys a range.
SAMPLES = 8
#: A range is overfull beyond so many times the mean; so often are ranges subdivided.  What is overfull still (one
#: record may be) takes one task longer, the shards stay exact: they are cut from running totals.
OVERFULL, SPLITS = 3.0, 3
LOW = -(1 << 63)


def _sample(keys: DataFrame, n: int, seed: int) -> list[tuple[int, int]]:
    """n keys drawn without replacement with weights by size: the least of -ln(u) / size."""
    u = (F.pmod(F.xxhash64("crc", "id", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    rows = keys.select("crc", "id", (-F.log(u) / F.col("size")).alias("r")).orderBy("r").limit(n).collect()
    return sorted((r["crc"], r["id"]) for r in rows)


def _quantiles(keys: list, parts: int) -> list:
    """parts - 1 splitters at equal steps of the sorted sample, each once."""
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def _ranged(keys: DataFrame, splitters: list) -> DataFrame:
    """Each key's range: how many splitters are not above it."""
    crc = np.array([s[0] for s in splitters], np.int64)
    ids = np.array([s[1] for s in splitters], np.int64)

    @F.pandas_udf("int")
    def place(c: pd.Series, i: pd.Series) -> pd.Series:
        c, i = c.to_numpy(), i.to_numpy()
        lo, hi = np.searchsorted(crc, c, "left"), np.searchsorted(crc, c, "right")
        out = hi.copy()
        for at in np.unique(lo[lo < hi]):
            same = (lo == at) & (lo < hi)
            out[same] = at + np.searchsorted(ids[at : hi[same][0]], i[same], "right")
        return pd.Series(out.astype(np.int32))

    return keys.withColumn("range", place("crc", "id"))


def splitters_of(keys: DataFrame, rows: int) -> list:
    ranges = max(RANGES, min(MOST_RANGES, -(-rows // ROWS_A_RANGE)))
    splitters = _quantiles(_sample(keys, ranges * SAMPLES, 0), ranges)
    for again in range(1, SPLITS + 1):
        ranged = _ranged(keys, splitters)
        got = ranged.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("c")).collect()  # a row a range
        bytes_of = {r["range"]: r["b"] for r in got}
        mean = sum(bytes_of.values()) / ranges
        rows_of = {r["range"]: r["c"] for r in got}
        over = [r for r, b in bytes_of.items() if b > OVERFULL * mean and rows_of[r] > 1]
        if not over:
            break
        some = keys.sparkSession.createDataFrame([(r,) for r in over], "range int")  # fewer than 1 / OVERFULL of the ranges
        inside = ranged.join(F.broadcast(some), "range", "left_semi")
        share = sum(bytes_of[r] for r in over) / mean
        more = _quantiles(_sample(inside, min(ranges, int(2 * share) + 1) * SAMPLES, again), int(2 * share) + 1)
        if not set(more) - set(splitters):
            break
        splitters = sorted({*splitters, *more})
    return splitters


def shard(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null)."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LOW)).alias("id"),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("crc"),
    )
    keys = written(spark, keys, "keys")
    n = keys.count()
    ranged = written(spark, _ranged(keys, splitters_of(keys, n)), "ranged")
    # Bytes and rows before each range: a row a range on the driver, MOST_RANGES and the subdivisions at most.
    per = sorted((r["range"], r["b"], r["c"]) for r in ranged.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("c")).collect())
    total, before, rows = sum(b for _, b, _ in per), [], 0
    seen = 0
    for r, b, c in per:
        before.append((r, seen, rows))
        seen, rows = seen + b, rows + c
    starts = F.broadcast(spark.createDataFrame(before, "range int, bytes_before long, rows_before long"))
    order = Window.partitionBy("range").orderBy("crc", "id")
    placed = (
        ranged.withColumns({
            "upto": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "nth": F.row_number().over(order),
        })
        .join(starts, "range")
        .withColumn("middle2", 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size"))
        .select(
            "id", "size", "crc",
            F.least(F.lit(shards - 1), F.floor(F.col("middle2") * shards / F.lit(2 * max(1, total)))).cast("int").alias("shard"),
            (F.col("rows_before") + F.col("nth") - 1).alias("place"),
        )
    )
    placed = written(spark, placed, "placed")
    first = F.broadcast(placed.groupBy("shard").agg(F.min("place").alias("first")))
    return placed.join(first, "shard").select(
        F.nullif("id", F.lit(LOW)).alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
