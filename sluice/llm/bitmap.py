"""Semi-joins by a bitmap of bounded size that lets every wanted row pass.

The wanted values set bits of a bitmap whose size follows their number and
ends at 2**MOST_BITS bits (32 MB).  Rows whose value's bit is not set are not
wanted; others may be, so what passes is a superset of the semi-join's result.
More values than such a bitmap can tell apart are joined by shuffle instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = 32768  # bits of one aggregate's bitmap
#: The greatest bitmap, and the bits it has for each value at least.
MOST_BITS, BITS_A_VALUE = 28, 4


def _place(col: str, bits: int):
    return F.pmod(F.xxhash64(col), F.lit(bits))


def bitmap(spark: SparkSession, wanted: DataFrame, col: str, n: int):
    """(bits, broadcast of the bitmap) of the n values of col."""
    bits = 1 << min(MOST_BITS, max(16, (16 * n).bit_length()))
    at = (_place(col, bits) + 1).alias("at")
    parts = (
        wanted.select(at)
        .groupBy(F.bitmap_bucket_number("at").alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map"))
        .collect()
    )
    whole = np.zeros(bits // 8, np.uint8)
    for r in parts:
        begin = (r["part"] - 1) * PART // 8
        whole[begin : begin + PART // 8] = np.frombuffer(bytes(r["map"]), np.uint8)
    return bits, spark.sparkContext.broadcast(whole)


def sift(df: DataFrame, col: str, made) -> DataFrame:
    """The rows of df whose value of col may be wanted."""
    bits, sent = made

    def passing(batches):
        whole = sent.value
        for b in batches:
            at = b["sift_at"].to_numpy()
            ok = (whole[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            out = b.filter(pa.array(ok.astype(bool)))
            if out.num_rows:
                yield out.drop_columns(["sift_at"])

    return df.withColumn("sift_at", _place(col, bits)).mapInArrow(passing, df.schema)


def passing(spark: SparkSession, df: DataFrame, wanted: DataFrame, col: str) -> DataFrame:
    """The rows of df whose value of col is among the wanted (distinct) ones, and perhaps others."""
    n = wanted.count()
    if n * BITS_A_VALUE > 1 << MOST_BITS:
        return df.join(wanted.select(col), col, "left_semi")
    return sift(df, col, bitmap(spark, wanted, col, n))
