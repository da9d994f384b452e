import datetime as dt

from sluice import streaming
from sluice.operators import routing


def _stream(spark, df, path):
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _all(stream, name, spark, tmp):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert q.exception() is None
    return spark.table(name).collect()


def test_countdown_stream_equals_batch(spark, tmp_path):
    kinds = ["call", "off", "call", "call", "call", "on", "call", "off", "call", "call"]
    rows = [(f"s{s}", i, k, 2 if i < 5 else s) for s in range(3) for i, k in enumerate(kinds)]
    df = spark.createDataFrame(rows, "session string, seq long, kind string, n int")
    got = _all(streaming.countdown(_stream(spark, df, f"{tmp_path}/e")), "countdown", spark, tmp_path)
    want = routing.countdown(df, "session", "seq").select("session", "seq", "raw").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_late_events_are_ignored(spark, tmp_path):
    schema = "session string, seq long, kind string, n int"
    path = f"{tmp_path}/late"
    spark.createDataFrame([("s", 5, "off", 2), ("s", 6, "call", 0)], schema).coalesce(1).write.parquet(path)
    sink = lambda: streaming.countdown(spark.readStream.schema(schema).parquet(path)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/own").trigger(availableNow=True).start()
    sink().awaitTermination(60)
    spark.createDataFrame([("s", 4, "on", 0), ("s", 6, "call", 0), ("s", 7, "call", 0), ("s", 8, "call", 0)], schema).coalesce(1).write.mode("append").parquet(path)
    sink().awaitTermination(60)
    assert sorted((r.seq, r.raw) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(5, False), (6, True), (7, True), (8, False)]
    state = type("State", (), {"exists": True, "get": (2, 6), "update": lambda self, v: setattr(self, "get", v)})()
    import pandas as pd

    batch = pd.DataFrame({"seq": [8, 4, 6, 7], "kind": ["call", "on", "call", "call"], "n": [0, 0, 0, 0]})
    got = next(streaming._countdown(("s",), iter([batch]), state))
    assert list(zip(got["seq"], got["raw"])) == [(7, True), (8, True)] and state.get == (0, 8)
    assert len(next(streaming._countdown(("s",), iter([batch]), state))) == 0


def test_dedupe_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, "a"), (t + dt.timedelta(days=1), "a"), (t, "b")], "fetch_ts timestamp, content_hash string")
    got = _all(streaming.dedupe(_stream(spark, df, f"{tmp_path}/d")), "deduped", spark, tmp_path)
    assert sorted(r["content_hash"] for r in got) == ["a", "b"]
