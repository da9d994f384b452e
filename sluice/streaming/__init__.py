"""Structured Streaming: deduplication, rate limits, the countdown as keyed state, a batch sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dedupe(events: DataFrame, ts: str = "fetch_ts", key: str = "content_hash", keep: str = "30 days") -> DataFrame:
    return events.withWatermark(ts, keep).dropDuplicatesWithinWatermark([key])


def over_limit(events: DataFrame, ts: str, key: str, limit: int, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Windows in which a key has more than ``limit`` events."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count("*").alias("n_events"))
    return counted.filter(F.col("n_events") > limit).select(F.col("window.start").alias("start"), key, "n_events")


def _countdown(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One session's events of a micro-batch, in the order of seq; what isn't later than the last one seen is ignored."""
    left, last = state.get if state.exists else (0, None)  # calls that stay raw (-1: all until on), and the last seq
    x = pd.concat(list(batches)).sort_values("seq", kind="stable")
    if last is not None:
        x = x[x["seq"] > last]
    raw = []
    for kind, n in zip(x["kind"], x["n"]):
        if kind == "on":
            left = 0
        elif kind == "off":
            left = int(n) if n > 0 else -1
        raw.append(kind == "call" and left != 0)
        if kind == "call" and left > 0:
            left -= 1
    if len(x):
        state.update((left, int(x["seq"].iloc[-1])))
    yield pd.DataFrame({"session": key[0], "seq": x["seq"].to_numpy(), "raw": pd.Series(raw, dtype=bool)})


def countdown(events: DataFrame) -> DataFrame:
    """Streamed events (session, seq, kind, n) -> (session, seq, raw); events that come after later ones of their session are ignored."""
    return events.groupBy("session").applyInPandasWithState(
        _countdown, "session string, seq long, raw boolean", "left int, last long", "append", GroupStateTimeout.NoTimeout
    )


def batch_sink(events: DataFrame, path: str, checkpoint: str, every: str = "5 minutes", ts: str = "fetch_ts"):
    """Parquet by day and type; the checkpoint keeps what isn't written yet."""

    def put(batch: DataFrame, _: int) -> None:
        day = F.to_date(ts)
        batch.withColumns({"year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day)}).write.mode("append").partitionBy("year", "month", "day", "type").parquet(path)

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(processingTime=every)
