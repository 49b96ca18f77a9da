"""Streams with a time to live and timers, against the same rules over stored rows."""

import time

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F
from tickforge.operators import books, profiles, signals, windows
from tickforge.sources import ticks
from tickforge.streaming import state

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each state partition costs a Python worker and a store; the results don't depend on their number."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def in_triggers(spark, tmp_path, parts, make, mode="append", wait=0.0, timers=False):
    """What a stream makes of parts, one trigger each; rows in each are out of order. With `wait`, seconds between triggers."""
    src, out, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = parts[0].schema
    for k, part in enumerate(parts):
        if k and wait:
            time.sleep(wait)
        part.orderBy(F.rand(k)).coalesce(1).write.mode("append").parquet(src)
        rows = make(spark.readStream.schema(schema).parquet(src))
        write = lambda batch, epoch: batch.withColumn("batch", F.lit(epoch)).write.mode("append").parquet(out)
        # a time to live asks for batch after batch, with or without rows, so that availableNow would never end; timers need batches without rows
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(timers).lower())
        q = rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).start()
        assert q.awaitTermination(120), "the stream doesn't end"
    return spark.read.parquet(out)


def thirds(df, order):
    n = df.count()
    numbered = df.withColumn("_third", F.ntile(3).over(Window.orderBy(order))).cache()
    assert n
    return [numbered.where(F.col("_third") == k).drop("_third") for k in (1, 2, 3)]


def rows_of(df, *columns):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def test_interest_equals_batch(spark, tmp_path):
    oi = ticks.open_interest(spark, SF).select("venue", "instrument", "seq", "ts_ingest_ms", "open_interest")
    names = ["venue", "instrument", "seq", "open_interest", "delta", "delta_pct", "cadence_ms", "confidence"]
    got = in_triggers(spark, tmp_path, thirds(oi, "ts_ingest_ms"), state.stream_interest)
    assert rows_of(got, *names) == rows_of(windows.interest_changes(oi), *names)


@pytest.mark.parametrize("name", ["thinning", "imbalance", "sweeps"])
def test_evidence_equals_batch(spark, tmp_path, name):
    inputs = signals.book_inputs(ticks.book_snapshots(spark, SF))
    rule, batch, names = {
        "thinning": (state.Thinning(z=-1.0, drop=0.1), signals.thinning(inputs, -1.0, 0.1), ["mean", "z", "drop_share"]),
        "imbalance": (state.Imbalance(limit=0.1, length=3), signals.persistent_imbalance(inputs, 0.1, 3), ["sign", "consecutive", "seq_start"]),
        "sweeps": (state.Sweeps(levels=2, share=0.2), signals.sweeps(inputs, 2, 0.2), ["side", "levels_lost", "depth_drop"]),
    }[name]
    names = ["venue", "instrument", "seq", "ts_ingest_ms", *names, "severity", "confidence"]
    got = in_triggers(spark, tmp_path, thirds(inputs, "ts_ingest_ms"), lambda s: state.stream_evidence(s, rule))
    want = rows_of(batch, *names)
    assert want and rows_of(got, *names) == want


def test_session_profile_equals_batch(spark, tmp_path):
    candles = windows.candles(ticks.trades(spark, SF, number=False), "1h").select("venue", "instrument", "window_start", "high", "low", "close", "volume")
    names = ["venue", "instrument", "session_start", "price_low", "total_volume", "candles"]
    got = in_triggers(spark, tmp_path, thirds(candles, "window_start"), lambda s: state.stream_session_profile(s, 5.0, "America/New_York", 570), "update")
    newest = got.groupBy(*names[:4]).agg(F.max_by(F.struct("total_volume", "candles"), "batch").alias("r")).select(*names[:4], "r.*")
    assert rows_of(newest, *names) == rows_of(profiles.session_profile(candles, 5.0, "America/New_York", 570), *names)


def test_idle_state_goes(spark, tmp_path):
    """A key that comes back after the time to live begins anew; one that comes in time doesn't. The store holds no row of the idle one."""
    schema = "venue string, instrument string, seq long, ts_ingest_ms long, open_interest double"
    parts = [
        spark.createDataFrame([("V", "idle", 1, 1000, 10.0), ("V", "busy", 1, 1000, 10.0)], schema),
        spark.createDataFrame([("V", "busy", 2, 2000, 12.0)], schema),
        spark.createDataFrame([("V", "idle", 2, 3000, 15.0), ("V", "busy", 3, 3000, 15.0)], schema),
    ]
    got = in_triggers(spark, tmp_path, parts, lambda s: state.stream_interest(s, ttl=100), wait=1.0)
    assert {(r.instrument, r.seq): r.delta for r in got.collect()} == {("idle", 1): 0.0, ("busy", 1): 0.0, ("busy", 2): 0.0, ("idle", 2): 0.0, ("busy", 3): 0.0}
    again = in_triggers(spark, tmp_path / "long", parts, lambda s: state.stream_interest(s, ttl=3_600_000))
    assert {(r.instrument, r.seq): r.delta for r in again.collect()} == {("idle", 1): 0.0, ("busy", 1): 0.0, ("busy", 2): 2.0, ("idle", 2): 5.0, ("busy", 3): 3.0}


def as_of(spark, snapshots, every):
    """From stored books: at every multiple of `every` up to the last row of any, the last book before it, carried on where none came."""
    last = books.throttled(snapshots, every).withColumn("at", F.col("interval_start") + every)
    top = snapshots.agg(F.max("ts_ingest_ms")).first()[0]
    top -= top % every
    first = last.groupBy("venue", "instrument").agg(F.min("at").alias("a"))
    grid = first.select("venue", "instrument", F.explode(F.sequence("a", F.lit(top), F.lit(every))).alias("snapshot_at"))
    known = grid.join(last, ["venue", "instrument"]).where("at <= snapshot_at")
    return known.groupBy("venue", "instrument", "snapshot_at").agg(F.max_by(F.struct("ts_ingest_ms", "seq", F.to_json("bids").alias("bids"), F.to_json("asks").alias("asks")), "at").alias("r")).select("venue", "instrument", "snapshot_at", "r.*")


def test_book_snapshots_equal_batch(spark, tmp_path):
    """Three triggers; intervals without a row repeat the book before; the watermark closes intervals up to the last row of all."""
    b = ticks.book_snapshots(spark, SF).select("venue", "instrument", "ts_ingest_ms", "seq", "bids", "asks").where("ts_ingest_ms < 1704067200000 + 1200000")
    every = 60_000
    got = in_triggers(spark, tmp_path, thirds(b, "ts_ingest_ms"), lambda s: state.stream_book_snapshots(s, every, idle=1000), timers=True)
    names = ["venue", "instrument", "snapshot_at", "ts_ingest_ms", "seq", "bids", "asks"]
    want = as_of(spark, b, every)
    assert want.where("ts_ingest_ms < snapshot_at - 60000").count()
    assert rows_of(got, *names) == rows_of(want, *names)


def test_cell_snapshots_equal_batch(spark, tmp_path):
    """Traded volume by price bucket of the open quarter of an hour, every minute."""
    t = ticks.dense(spark, SF, number=False).select("venue", "instrument", "ts_ingest_ms", "price", "size").where("ts_ingest_ms < 1704067200000 + 2400000")
    every, window = 60_000, 900_000
    cell = lambda: profiles.bucket(F.col("price"), F.lit(5.0))
    got = in_triggers(spark, tmp_path, thirds(t, "ts_ingest_ms"), lambda s: state.stream_cell_snapshots(s, cell, "size", every, window, idle=1000), timers=True)
    top = t.agg(F.max("ts_ingest_ms")).first()[0]
    rows = t.withColumns({"cell": cell().cast("string"), "window_start": F.col("ts_ingest_ms") - F.col("ts_ingest_ms") % window, "ends": F.col("ts_ingest_ms") - F.col("ts_ingest_ms") % every + every})
    ends = rows.select("venue", "instrument", "window_start", F.explode(F.sequence("ends", F.col("window_start") + window, F.lit(every))).alias("snapshot_at"), "cell", "size").where(F.col("snapshot_at") <= top - top % every)
    want = ends.groupBy("venue", "instrument", "snapshot_at", "window_start", "cell").agg((F.sum(F.rint(F.col("size") * 1e8).cast("long")) / 1e8).alias("volume"))
    names = ["venue", "instrument", "snapshot_at", "window_start", "cell", "volume"]
    assert want.count() and rows_of(got, *names) == rows_of(want, *names)


def test_idle_books_are_forgotten(spark, tmp_path):
    level = "array<struct<price: double, size: double>>"
    schema = f"venue string, instrument string, ts_ingest_ms long, seq long, bids {level}, asks {level}"
    one = lambda name, at, seq: ("V", name, at, seq, [(10.0, 1.0)], [(11.0, 1.0)])
    parts = [spark.createDataFrame([one("a", 500, 1), one("b", 600, 1)], schema), spark.createDataFrame([one("b", 9500, 2)], schema), spark.createDataFrame([one("a", 12_500, 2), one("b", 15_100, 3)], schema)]
    got = in_triggers(spark, tmp_path, parts, lambda s: state.stream_book_snapshots(s, 1000, idle=3), timers=True)
    at = {name: sorted((r.snapshot_at, r.seq) for r in got.where(F.col("instrument") == name).collect()) for name in "ab"}
    assert at["a"] == [(1000, 1), (2000, 1), (3000, 1), (4000, 1), (13_000, 2), (14_000, 2), (15_000, 2)]
    assert at["b"] == [(1000, 1), (2000, 1), (3000, 1), (4000, 1), (10_000, 2), (11_000, 2), (12_000, 2), (13_000, 2)]
