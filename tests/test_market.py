"""Operators on small frames with results worked out by hand, and every market query against its SQL."""

import glob
import os

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import Window
from pyspark.sql import functions as F
from tickforge.functions import columns as C
from tickforge.operators import book_state, books, indicators, profiles, quality, reports, signals, windows
from tickforge.plans import check_oracles, checks, feed_oracles, feeds, message_oracles, messages, oracles, view_oracles, views  # noqa: F401
from tickforge.plans.queries import REGISTRY
from tickforge.sources import dialects, readers, ticks
from tickforge.streaming import jobs

SQL = oracles.SQL | view_oracles.SQL | feed_oracles.SQL | check_oracles.SQL | message_oracles.SQL
SF = "/root/testdata/sf0.001"
TRADE = "venue string, instrument string, price double, size double, side string, seq long, ts_ingest_ms long, ts_exchange_ms long, trade_id string, event_id long"


def trades(spark, rows):
    return spark.createDataFrame([("V", "I", float(p), float(q), s, k, t, t, str(k), k) for k, (p, q, s, t) in enumerate(rows, 1)], TRADE)


def test_candle_and_roll_up(spark):
    t = trades(spark, [(10, 1, "buy", 0), (12, 2, "sell", 10_000), (9, 1, "buy", 50_000), (11, 3, "buy", 61_000), (-1, 3, "buy", 62_000)])
    c = windows.candles(t, "1m").orderBy("window_start").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume, r.buy_volume, r.trade_count, r.is_closed) for r in c] == [(10, 12, 9, 9, 4, 2, 3, True), (11, 11, 11, 11, 3, 3, 1, False)]
    direct = windows.candles(t, "5m").drop("timeframe").select("open", "high", "low", "close", "volume", "trade_count").collect()
    assert windows.roll_up(windows.candles(t, "1m"), "5m").select("open", "high", "low", "close", "volume", "trade_count").collect() == direct


def test_order_of_input_does_not_matter(spark):
    t = trades(spark, [(10 + k % 7, 1 + k % 3, "buy" if k % 2 else "sell", k * 700) for k in range(60)])
    a = windows.tape(t, "5s").orderBy("window_start").collect()
    assert a == windows.tape(t.orderBy(F.rand(3)), "5s").orderBy("window_start").collect()


def test_names_and_fixed_point(spark):
    r = spark.createDataFrame([(" btc-usd_t.", "BID", 0.123456785)], "s string, side string, x double").select(C.instrument_name(F.col("s")).alias("a"), C.side_name(F.col("side")).alias("b"), C.fixed(F.col("x")).alias("c"), C.base_quote(C.instrument_name(F.col("s"))).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == ("BTCUSDT", "buy", 12345678, "BTC-USDT")  # half to even


def test_bin_size(spark):
    d = spark.createDataFrame([(100.0,), (45000.0,), (0.5,)], "price double")
    out = [r.bin for r in profiles.bin_size(d, 1.0, 0.01).collect()]
    assert out[0] == 1.0 and out[1] == 250.0 and out[2] == 0.01


def test_value_area_grows_outward(spark):
    rows = [("p", float(k), float(k + 1), v) for k, v in enumerate([1.0, 2.0, 10.0, 3.0, 1.0])]
    p = spark.createDataFrame(rows, "id string, price_low double, price_high double, total_volume double")
    r = profiles.value_area_outward(p, ["id"]).first()
    assert (r.poc, r.va_low, r.va_high) == (2.0, 2.0, 4.0)


def test_sequence_audit_and_gaps(spark):
    t = trades(spark, [(1, 1, "buy", k * 10) for k in range(4)]).withColumn("seq", F.when(F.col("event_id") == 3, 1).otherwise(F.col("seq")))
    assert [r.verdict for r in quality.sequence_audit(t).orderBy("event_id").collect()] == ["accept", "accept", "stale_event", "accept"]
    w = spark.createDataFrame([("V", "I", 0), ("V", "I", 3000)], "venue string, instrument string, window_start long")
    assert [tuple(r)[2:] for r in quality.window_gaps(w, 1000).collect()] == [(1000, 3000, 2)]


def test_book_and_cooldown(spark):
    d = spark.createDataFrame([("V", "I", 1, True, "bid", 10.0, 5.0), ("V", "I", 2, False, "bid", 10.0, 0.0), ("V", "I", 2, False, "bid", 9.0, 1.0)], "venue string, instrument string, seq long, is_snapshot boolean, side string, price double, size double")
    assert [(r.price, r.size) for r in books.book_as_of(d, 2).collect()] == [(9.0, 1.0)]
    c = spark.createDataFrame([("V", "I", t) for t in (0, 3000, 6000, 9000)], "venue string, instrument string, ts_ingest_ms long")
    assert sorted(r.ts_ingest_ms for r in signals.cooled(c, ["venue", "instrument"]).collect()) == [0, 6000]


CANDLE = "venue string, instrument string, window_start long, high double, low double, close double, volume double"


def candles_of(spark, closes, volumes=None, spread=0.0):
    return spark.createDataFrame([("V", "I", k, c + spread, c - spread, c, float(v)) for k, (c, v) in enumerate(zip(closes, volumes or [1] * len(closes)))], CANDLE)


def test_regimes_by_hand(spark):
    """Figures worked out from the rules: slope and net move over 20 closes, true range over 14, move and volume over 20."""
    rising = signals.trend(candles_of(spark, [100.0 + k for k in range(20)])).first()
    assert rising.kind == "trending" and rising.strength == 1.0 and abs(rising.move - 0.19) < 1e-12  # slope 1 / 109.5 and net move .19: both over twice the least
    slow = signals.trend(candles_of(spark, [100 + 0.2 * k for k in range(20)])).first()
    assert slow.kind == "trending" and abs(slow.strength - (0.5 * 0.2 / 101.9 / 0.003 + 0.5)) < 1e-9  # slope .00196 of .003, move .038 over .012
    flat = signals.trend(candles_of(spark, [100.0] * 20)).first()
    assert (flat.kind, flat.strength) == ("ranging", 1.0) and signals.trend(candles_of(spark, [100.0] * 19)).collect() == []
    wide = signals.volatility(candles_of(spark, [100.0] * 15, spread=1.0)).first()
    assert wide.kind == "high_volatility" and abs(wide.strength - (0.005 / 0.015 + 0.5)) < 1e-9  # range 2 of 100
    calm = signals.volatility(candles_of(spark, [100.0] * 15, spread=0.1)).first()
    assert calm.kind == "low_volatility" and abs(calm.strength - 1.0) < 1e-9  # range .2 of 100: .5 + .5
    assert signals.volatility(candles_of(spark, [100.0] * 15, spread=0.4)).collect() == [] and signals.volatility(candles_of(spark, [100.0] * 14, spread=1.0)).collect() == []
    out = signals.breakout(candles_of(spark, [100.0] * 20 + [101.0], [10] * 20 + [27])).first()
    assert abs(out.strength - (0.5 * 0.01 / 0.015 + 0.5 * 2.7 / 3.6)) < 1e-9 and signals.breakout(candles_of(spark, [100.0] * 20 + [101.0], [10] * 20 + [17])).collect() == []


def test_strongest_regime_wins(spark):
    """A breakout of strength .708 on the 21st close against low volatility and a range: the strongest is in force, and first of breakout, trend, volatility on ties."""
    got = signals.arbitrated(candles_of(spark, [100.0] * 20 + [101.0], [10] * 20 + [27], 0.01)).orderBy("window_start").collect()
    # low volatility of range .02 has .5 + .95, at most 1; the range of equal closes is 1 too, and goes first
    assert [(r.kind, r.strength, r.transition) for r in got if r.window_start >= 18] == [("low_volatility", 1.0, False), ("ranging", 1.0, True), ("low_volatility", got[-1].strength, True)]
    assert got[-1].strength > 0.708
    last = signals.latest_regimes(signals.arbitrated(candles_of(spark, [100.0] * 20 + [101.0], [10] * 20 + [27], 0.01))).first()
    assert (last.kind, last.since, last.transitions) == ("low_volatility", 20, 2)


BOOK = "venue string, instrument string, seq long, ts_ingest_ms long, bid double, ask double, spread_bps double, imbalance double, bid_depth double, ask_depth double, bid_levels long, ask_levels long, depth double"


def inputs_of(spark, rows):
    """Rows of (bid, ask, imbalance, bid depth, ask depth, bid levels, ask levels)."""
    return spark.createDataFrame([("V", "I", k, k * 1000, b, a, (a - b) / ((a + b) / 2) * 1e4 if a > b else 0.0, i, bd, ad, bl, al, bd + ad) for k, (b, a, i, bd, ad, bl, al) in enumerate(rows, 1)], BOOK)


def test_severity_of_each_rule(spark):
    book = lambda spread=0.01, i=0.0, bd=10.0, ad=10.0, bl=20, al=20: (100.0, 100.0 + spread, i, bd, ad, bl, al)
    # 20 equal spreads, then one of 20 bps: z of one outlier among n is sqrt(n - 1)
    assert [(r.seq, r.severity, r.confidence) for r in signals.spread_explosion(inputs_of(spark, [book()] * 20 + [book(0.2)])).collect()] == [(21, "high", 0.85)]
    assert [r.severity for r in signals.spread_explosion(inputs_of(spark, [book()] * 26 + [book(0.2)])).collect()] == ["critical"]
    assert [r.severity for r in signals.spread_explosion(inputs_of(spark, [book()] * 10 + [book(0.2)])).collect()] == ["medium"]
    crossed = [book()] * 10 + [(100.0, 99.0, 0.0, 10.0, 10.0, 20, 20)] * 30 + [book(0.2)]
    assert [r.n for r in signals.spread_explosion(inputs_of(spark, crossed)).collect()] == [11]  # crossed books aren't in the ring
    thin = lambda bd: [(r.severity, r.confidence) for r in signals.thinning(inputs_of(spark, [book()] * 30 + [book(bd=bd, ad=bd)])).collect()]
    assert thin(2.0) == [("critical", 0.95)] and thin(4.5) == [("high", 0.85)] and thin(6.0) == [("medium", 0.70)] and thin(8.0) == []
    streak = signals.persistent_imbalance(inputs_of(spark, [book(i=0.5)] * 31 + [book()] + [book(i=-0.5)] * 10)).orderBy("seq").collect()
    assert [(r.seq, r.seq_start, r.severity) for r in streak if r.seq in (10, 20, 30, 42)] == [(10, 1, "medium"), (20, 1, "high"), (30, 1, "critical"), (42, 33, "medium")] and len(streak) == 23
    swept = lambda *now: [(r.side, r.levels_lost, r.severity) for r in signals.sweeps(inputs_of(spark, [book(), book(**dict(zip(("bd", "ad", "bl", "al"), now)))])).collect()]
    assert swept(5.0, 10.0, 15, 20) == [("bid", 5, "medium")] and swept(5.0, 10.0, 12, 20) == [("bid", 8, "high")] and swept(2.0, 10.0, 15, 20) == [("bid", 5, "critical")]
    assert swept(5.0, 5.0, 15, 13) == [("ask", 7, "medium")] and swept(7.0, 10.0, 10, 20) == []  # the ask side lost more levels; too little depth


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 120), st.integers(1, 9), st.integers(9, 20), st.integers(0, 99))
def test_rolling_in_blocks_equals_one_window(spark, n, rows, block, seed):
    """Numbers with gaps, blocks that numbers and rows don't fill alike."""
    rng = np.random.default_rng(seed)
    d = spark.createDataFrame([(int(k), int(s), float(rng.integers(0, 9))) for k in (0, 1) for s in sorted(rng.choice(400, n, replace=False))], "k long, seq long, x double")
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(-(rows - 1), 0)
    want = d.withColumns({"n": F.count("*").over(w), "m": F.sum("x").over(w)})
    got = windows.rolling(d, ["k"], "seq", rows, block, n=F.count("*"), m=F.sum("x"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_absorption_by_hand(spark):
    """Trades of size 1 at one price: ten fill the ring, then volume from the tenth on must reach twice the ring's."""
    t = trades(spark, [(100, 1, "buy", k * 1000) for k in range(200)])
    got = signals.absorption(t).orderBy("seq").collect()
    # counted from trade 10 (the reference is that of trade 9): 128 at trade 137, against 64 in the ring; before, 2 n > n - 9
    assert [(r.seq, r.seq_start, r.volume, r.volume_ratio, r.severity) for r in got] == [(137, 9, 128.0, 2.0, "medium")]
    moved = trades(spark, [(100 if k < 100 else 101, 1, "buy", k * 1000) for k in range(250)])
    assert [(r.seq, r.seq_start) for r in signals.absorption(moved).collect()] == [(229, 101)]  # the move starts anew at trade 101


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("V", "S", str(k), 10.0 + k, 1.0, "buy", 1704067200000 + k * 20_000, 1704067200000 + k * 20_000) for k in range(12)]
    spark.createDataFrame(rows, readers.TRADE).coalesce(1).write.json(src)
    q = jobs.stream_candles(jobs.without_repeats(readers.trade_stream(spark, src))).writeStream.format("memory").queryName("candles").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("candles").orderBy("window_start").collect()
    assert [(r.open, r.close, r.trade_count) for r in got][:3] == [(10, 12, 3), (13, 15, 3), (16, 18, 3)]


def test_sink_keeps_first_write(spark, tmp_path):
    """The first row of a key in the order of t stays, within a batch and over batches; a batch that comes again changes nothing."""
    path, write = str(tmp_path / "out"), jobs.first_write_wins(str(tmp_path / "out"), ["k"], "t")
    second = spark.createDataFrame([(1, 0, "b"), (2, 9, "d"), (2, 3, "c"), (2, 5, "e")], "k long, t long, v string")
    write(spark.createDataFrame([(1, 7, "a")], "k long, t long, v string"), 0)
    for _ in range(2):
        write(second, 1)
        assert sorted(map(tuple, spark.read.parquet(path).drop("batch").collect())) == [(1, 7, "a"), (2, 3, "c")]
    write(second, 2)
    assert spark.read.parquet(path).count() == 2


def test_sink_keeps_last_write(spark, tmp_path):
    path = str(tmp_path / "out")
    write = jobs.last_write_wins(path, ["k"], "t")
    write(spark.createDataFrame([(1, 5, "a"), (2, 1, "x")], "k long, t long, v string"), 0)
    write(spark.createDataFrame([(1, 7, "b"), (1, 6, "c")], "k long, t long, v string"), 1)
    assert sorted(map(tuple, jobs.current(spark.read.parquet(path), ["k"], "t").collect())) == [(1, 7, "b"), (2, 1, "x")]


def test_csv_dialect(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,price,qty,q,f,time,is_buyer_maker\n1,10.5,2,x,y,1000,true\n2,11,1,x,y,2000,False\n")
    got = readers.trade_csv(spark, str(tmp_path / "a.csv")).orderBy("trade_id").collect()
    assert [(r.trade_id, r.price, r.side) for r in got] == [("1", 10.5, "sell"), ("2", 11.0, "buy")]


def test_csv_of_the_other_dialect(spark, tmp_path):
    (tmp_path / "b.csv").write_text("timestamp,symbol,side,size,price\n1704067200.1234,BTCUSDT,Buy,0.5,42000.5\n1704067201,BTCUSDT,SELL,2,41999\n")
    got = readers.trade_csv(spark, str(tmp_path / "b.csv"), "b").orderBy("ts_exchange_ms").collect()
    assert [(r.price, r.size, r.side, r.ts_exchange_ms) for r in got] == [(42000.5, 0.5, "buy", 1704067200123), (41999.0, 2.0, "sell", 1704067201000)]


def test_replay_order(spark):
    """Time, then venue, instrument and type without regard to case, number and key."""
    rows = [(2, "b", "X", "t", 1, "k1"), (1, "B", "x", "t", 2, "k2"), (1, "a", "Y", "T", 9, "k3"), (1, "b", "X", "S", 5, "k4"), (1, "b", "x", "t", 2, "k1")]
    d = spark.createDataFrame(rows, "ts_ingest long, venue string, instrument string, type string, seq long, idempotency_key string")
    assert [(r.ts_ingest, r.seq, r.idempotency_key) for r in readers.in_replay_order(d.repartition(3)).collect()] == [(1, 9, "k3"), (1, 5, "k4"), (1, 2, "k1"), (1, 2, "k2"), (2, 1, "k1")]


def test_metrics_and_fragments(spark):
    d = spark.createDataFrame([({"b": 2.0, "a": float("nan"), "c": float("inf"), "d": 1.0, "z": None}, ["  one ", "", "x" * 200, "two", "three", "four"])], "m map<string,double>, t array<string>")
    r = d.select(C.metric_list(F.col("m")).alias("m"), C.metric_list(F.col("m"), 1).alias("first"), C.fragments(F.col("t")).alias("t")).first()
    assert [tuple(x) for x in r.m] == [("b", 2.0), ("d", 1.0)] and [tuple(x) for x in r["first"]] == [("b", 2.0)]
    assert r.t == ["one", "x" * 120, "two", "three"]


def test_times_of_venues(spark):
    d = spark.createDataFrame([("1704067200", 7), ("1704067200123", 7), ("2024-01-01T00:00:00.5Z", 7), ("  ", 7), ("soon", 7), ("1704067200.25", 7)], "t string, r long")
    assert [x.m for x in d.select(C.parse_ms(F.col("t"), F.col("r")).alias("m")).collect()] == [1704067200000, 1704067200123, 1704067200500, 7, 7, 1704067200250]


def test_nearest_rank_and_gaps(spark):
    d = spark.createDataFrame([("a", k) for k in range(1, 11)] + [("b", 5)], "k string, ms long")
    assert sorted(tuple(r) for r in reports.percentiles(d, ["k"], "ms", [50, 95]).collect()) == [("a", 6, 10), ("b", 5, 5)]  # places 5 and 9 of ten, from 0
    w = spark.createDataFrame([("V", "I", 2000), ("V", "I", 3000), ("V", "I", 6000)], "venue string, instrument string, window_start long")
    assert sorted(tuple(r)[2:] for r in reports.coverage_gaps(w, 1000, 0, 8000).collect()) == [(0, 1000, 2), (4000, 5000, 2), (7000, 8000, 2)]


def test_venue_messages(spark):
    raw = spark.createDataFrame(
        [
            ("binance", '{"e":"aggTrade","E":5,"s":"BTCUSDT","a":7,"p":"10.5","q":"2","T":0,"m":true}', 9),
            ("BINANCE", '{"e":"aggTrade","E":5,"s":"BTCUSDT","a":8,"p":"-1","q":"2","T":5,"m":true}', 9),
            ("BINANCE", '{"e":"depthUpdate","E":5,"s":"BTCUSDT","U":1,"u":2,"pu":0,"b":[["11","2"],["x","1"]],"a":[["10","1"]]}', 9),
            ("BINANCE", '{"e":"markPriceUpdate","E":5,"s":"BTCUSDT","p":"10","i":"11","r":"0.001"}', 9),
            ("BINANCE", '{"e":"forceOrder","E":5,"o":{"s":"BTCUSDT","S":"SELL","p":"10","q":"1","T":6}}', 9),
            ("BYBIT", '{"topic":"orderbook.50.BTCUSDT","type":"snapshot","ts":3,"data":{"s":"BTCUSDT","b":[["9","1"]],"a":[["10","1"]],"u":4,"seq":5}}', 9),
            ("BYBIT", '{"topic":"publicTrade.BTCUSDT","data":[{"T":1,"s":"BTCUSDT","S":"Buy","p":"1","v":"2","i":"x"},{"T":0,"s":"BTCUSDT","S":"Sell","p":"1","v":"2","i":"y"}]}', 9),
            ("COINBASE", '{"type":"l2update","product_id":"BTC-USD","time":"2024-01-01T00:00:00Z","changes":[["buy","5","1"],["sell","6","0"]]}', 9),
            ("KRAKEN", '{"channel":"book","type":"update","data":[{"symbol":"XBT/USD","bids":[{"price":"5","qty":"1"}],"asks":[],"sequence":3,"timestamp":""}]}', 9),
            ("KRAKENF", '{"feed":"ticker","product_id":"PI_XBTUSD","last":"5","mark_price":"","time":"1704067200000"}', 9),
            ("KRAKEN", '{"method":"subscribe","success":true}', 9), ("KRAKENF", "not json", 9), ("BYBIT", None, None),
        ],
        "venue string, message string, received_ms long",
    )
    assert sorted((r.venue, r.trade_id, r.price, r.side, r.ts_exchange_ms) for r in dialects.trades(raw).collect()) == [("BINANCE", "7", 10.5, "sell", 5), ("BYBIT", "x", 1.0, "buy", 1), ("BYBIT", "y", 1.0, "sell", 9)]
    flat = lambda levels: [tuple(x) for x in levels]
    assert sorted((r.venue, flat(r.bids), flat(r.asks), r.final_id, r.is_snapshot) for r in dialects.books(raw).collect()) == [
        ("BINANCE", [(10.0, 1.0)], [(11.0, 2.0)], 2, False), ("BYBIT", [(9.0, 1.0)], [(10.0, 1.0)], 4, True), ("COINBASE", [(5.0, 1.0)], [(6.0, 0.0)], None, False), ("KRAKEN", [(5.0, 1.0)], [], 3, False),
    ]
    assert sorted((r.venue, r.instrument, r.mark_price, r.funding_rate) for r in dialects.mark_prices(raw).collect()) == [("BINANCE", "BTCUSDT", 10.0, 0.001), ("KRAKENF", "BTCUSD", 5.0, None)]
    assert [(r.side, r.price, r.ts_exchange_ms) for r in dialects.liquidations(raw).collect()] == [("sell", 10.0, 6)]


def test_book_rules():
    b = book_state.Book()
    assert b.apply(1, True, [("bid", 9.0, 1.0), ("bid", 8.0, 1.0), ("ask", 10.0, 1.0)]) == "ok"
    assert b.apply(1, False, [("bid", 7.0, 1.0)]) == "out_of_order" and 7.0 not in b.bids
    assert b.apply(2, False, [("bid", 8.0, 0.0), ("bid", 6.0, 1.0)], most=1) == "ok" and list(b.bids) == [9.0]
    assert b.apply(3, False, [("bid", 10.0, 1.0)]) == "needs_resync" and not b.bids and not b.asks
    assert b.apply(1, True, [("ask", 3.0, 1.0)]) == "ok" and b.row(("V", "I"), 1, "ok")[6] == -1.0


DELTA = "venue string, instrument string, seq long, is_snapshot boolean, side string, price double, size double"


def test_streamed_books_equal_stored_ones(spark, tmp_path):
    rows = [("V", "I", k // 2 + 1, k // 2 % 10 == 0, "bid" if k % 2 else "ask", float((90 if k % 2 else 100) + k * 7 % 9), float(k % 5)) for k in range(60)]
    src = str(tmp_path / "in")
    spark.createDataFrame([(*r, r[2]) for r in rows], DELTA + ", arrival long").coalesce(1).write.json(src)
    stream = spark.readStream.schema(DELTA + ", arrival long").json(src)
    q = book_state.stream_books(stream).writeStream.format("memory").queryName("books").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("books").collect()))
    assert len(got) == 30 and got == sorted(map(tuple, book_state.book_states(spark.createDataFrame(rows, DELTA)).collect()))


def test_books_do_not_depend_on_batches(spark):
    rows = [("V", "IJ"[k % 2], k // 8 + 1, k // 8 == 20, "bid", float(k % 17), float(k % 3)) for k in range(400)]
    d = spark.createDataFrame(rows, DELTA)
    want = sorted(map(tuple, book_state.book_states(d).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        assert sorted(map(tuple, book_state.book_states(d).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert book_state.book_states(d.limit(0)).count() == 0


def test_strict_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("V", "S", str(k), p, 1.0, "buy", t, 10_000 + k) for k, (p, t) in enumerate([(5.0, 1000), (6.0, 1500), (7.0, 2100), (9.0, 1900), (8.0, 2200), (1.0, 3000)])]
    spark.createDataFrame(rows[::-1], readers.TRADE).repartition(4).write.json(src)  # several files, none in order of arrival
    stream = spark.readStream.schema(readers.TRADE).json(src)
    q = jobs.stream_strict_candles(stream, 1000).writeStream.format("memory").queryName("strict").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r)[2:] for r in spark.table("strict").orderBy("window_start").collect()] == [(1000, 5.0, 6.0, 5.0, 6.0, 2.0, 2, 0), (2000, 7.0, 8.0, 7.0, 8.0, 2.0, 2, 1)]


def streamed(spark, tmp_path, rows, make):
    """What a stream over rows makes in two triggers, the first with half of them; rows in each are out of order."""
    src, out, half = str(tmp_path / "in"), str(tmp_path / "out"), len(rows) // 2
    for k, part in enumerate((rows[:half], rows[half:])):
        spark.createDataFrame(part[::-1], readers.TRADE).repartition(3).write.mode("append").json(f"{src}/{k}")
        q = make(spark.readStream.schema(readers.TRADE).json(f"{src}/*")).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        q.awaitTermination(120)
    return spark.read.parquet(out).collect()


def test_streamed_delta_equals_batch(spark, tmp_path):
    rows = [("V", "S", f"{k:03}", 10.0, 0.1 * (k % 7 + 1), "buy" if k % 3 else "sell", 5_000 + k * 400, 5_000 + k * 400) for k in range(40)]
    got = {r.window_start: (r.delta, r.cvd) for r in streamed(spark, tmp_path, rows, lambda t: jobs.stream_cvd(t, 1000))}
    sums, total, want = {}, 0, {}
    for *_, q, side, at, _ in rows:
        sums[at - at % 1000] = sums.get(at - at % 1000, 0) + round(q * 1e8) * (1 if side == "buy" else -1)
    for start in sorted(sums)[:-1]:  # the last window is still open
        total += sums[start]
        want[start] = (sums[start] / 1e8, total / 1e8)
    assert got == want


def test_streamed_cross_venue_equals_batch(spark, tmp_path):
    rows = [(f"V{k % 3}", "S", f"{k:03}", float((k * 7) % 11 + 1), 1.0, "buy", k, k) for k in range(30)]
    got = {r.trade_id: tuple(r)[2:] for r in streamed(spark, tmp_path, rows, jobs.stream_cross_venue)}
    last, want = {}, {}
    for venue, _, id, price, *_ in rows:
        last[venue] = price
        if len(last) > 1:
            low, high = min(last.values()), max(last.values())
            want[id] = (len(last), low, min(v for v in last if last[v] == low), high, min(v for v in last if last[v] == high))
    assert got == want


def test_streamed_evidence_equals_batch(spark, tmp_path):
    inputs = signals.book_inputs(ticks.book_snapshots(spark, SF)).where("venue = 'BINANCE'")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    middle = inputs.agg(F.expr("percentile_approx(ts_ingest_ms, 0.5)")).first()[0]
    for k, part in enumerate((inputs.where(F.col("ts_ingest_ms") <= middle), inputs.where(F.col("ts_ingest_ms") > middle))):
        part.repartition(3).write.parquet(f"{src}/{k}")
        q = jobs.stream_spread_explosions(spark.readStream.schema(inputs.schema).parquet(f"{src}/*"), least=5, bps=1.0).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        q.awaitTermination(120)
    want = signals.cooled(signals.spread_explosion(inputs, least=5, bps=1.0).select("venue", "instrument", "seq", "ts_ingest_ms", "severity"), ["venue", "instrument"], order=("ts_ingest_ms", "seq"))
    got = sorted((r.instrument, r.seq, r.severity) for r in spark.read.parquet(out).collect())
    assert got == sorted((r.instrument, r.seq, r.severity) for r in want.collect()) and len(got) > 3


def test_late_rows_and_fan_out(spark, tmp_path):
    on, late = str(tmp_path / "on"), str(tmp_path / "late")
    write = jobs.late_apart(on, late, "t", 10)
    write(spark.createDataFrame([(1, 100), (2, 50)], "k long, t long"), 0)  # nothing came before
    for _ in range(2):
        write(spark.createDataFrame([(3, 95), (4, 80), (5, 120)], "k long, t long"), 1)
    assert sorted(r.k for r in spark.read.parquet(on).collect()) == [1, 2, 3, 5]
    assert [(r.k, r.late_ms) for r in spark.read.parquet(late).collect()] == [(4, 20)]
    jobs.fan_out(str(tmp_path / "out"), {"all": lambda d: d, "sum": lambda d: d.groupBy().sum("t")})(spark.createDataFrame([(1, 2), (3, 4)], "k long, t long"), 0)
    assert spark.read.parquet(str(tmp_path / "out/all")).count() == 2 and spark.read.parquet(str(tmp_path / "out/sum")).first()[0] == 6


def test_names_subjects_and_levels(spark):
    d = spark.createDataFrame([("BTCUSDT:SPOT", "trade/BINANCE/BTCUSDT/raw"), ("BTC USDT", "signal/V/S/1m/spread"), ("", "a/b/c"), ("a.b/c-d_e", "a//c/d")], "name string, subject string")
    r = d.select(C.without_market(F.col("name")).alias("a"), C.is_identifier(C.without_market(F.col("name"))).alias("b"), C.subject_parts(F.col("subject")).alias("p")).collect()
    assert [(x.a, x.b) for x in r] == [("BTCUSDT", True), ("BTC USDT", False), ("", False), ("a.b/c-d_e", True)]
    assert r[0].p.symbol == "BTCUSDT" and r[0].p.signal is None and r[1].p.signal == "spread" and r[2].p is None and r[3].p is None
    x = spark.createDataFrame([(1.0, 2.0), (float("nan"), 1.0), (1.0, float("inf")), (-1.0, 1.0), (0.0, 1.0), (1.0, -1.0), (1.0, 0.0)], "p double, q double")
    assert [v[0] for v in x.select(reports.level_reason(F.col("p"), F.col("q"))).collect()] == [None, "nan", "inf", "neg_price", "zero_price", "neg_qty", None]
    assert spark.range(1).select(C.floored(F.lit(1.27), 1)).first()[0] == 1.2


def test_session_start_over_daylight_saving(spark):
    """Chicago opens at 8:30: in winter at 14:30 UTC, in summer at 13:30; the clock changed on 10 March and 3 November 2024."""
    from datetime import datetime, timezone

    ms = lambda *t: int(datetime(*t, tzinfo=timezone.utc).timestamp() * 1000)
    cases = [((2024, 3, 8, 15), (2024, 3, 8, 14, 30)), ((2024, 3, 11, 13, 45), (2024, 3, 11, 13, 30)), ((2024, 3, 11, 13, 0), (2024, 3, 10, 13, 30)), ((2024, 11, 1, 14), (2024, 11, 1, 13, 30)), ((2024, 11, 4, 14), (2024, 11, 3, 14, 30)), ((2024, 11, 4, 15), (2024, 11, 4, 14, 30))]
    d = spark.createDataFrame([(ms(*a), ms(*b)) for a, b in cases], "t long, want long")
    assert [r.got for r in d.select(profiles.session_start(F.col("t"), "America/Chicago", 510).alias("got"), "want").collect()] == [ms(*b) for _, b in cases]


def test_indicators_by_hand(spark):
    rows = [("V", "I", k * 3_600_000, 10.0 + k, 12.0 + k, 9.0 + k, 11.0 + k, 1.0) for k in range(30)]
    c = spark.createDataFrame(rows, "venue string, instrument string, window_start long, open double, high double, low double, close double, volume double")
    assert {r.rsi for r in indicators.strength(c).collect()} == {100.0}
    ha = indicators.heikin_ashi(c).orderBy("window_start").collect()
    assert ha[0].ha_open == 10.5 and ha[1].ha_open == (10.5 + ha[0].ha_close) / 2


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("set max_temp_directory_size = '100MB'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(shown(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = REGISTRY[name](spark, SF), duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["ev_spread_regime", "ev_tape_absorption"])
def test_short_stretches_change_nothing(spark, monkeypatch, name):
    """Series of hundreds of rows in stretches of seven: what the stretches before came to is carried on."""
    whole = sorted(map(tuple, REGISTRY[name](spark, "/root/testdata/sf0.01").collect()))
    monkeypatch.setattr(signals, "STRETCH", 7)
    assert whole and whole == sorted(map(tuple, REGISTRY[name](spark, "/root/testdata/sf0.01").collect()))


def test_size_class_across_blocks(spark):
    """20,000 trades of one series: blocks of 8192 rows hand their last rows on."""
    t = spark.range(1, 20_001).select(F.lit("V").alias("venue"), F.lit("I").alias("instrument"), F.col("id").alias("seq"), (F.col("id") * 7919 % 1000 + 1.0).alias("size"))
    size = np.arange(1, 20_001) * 7919 % 1000 + 1.0
    got = {r.seq: r.mean_size for r in profiles.relative_size(t).collect()}
    assert len(got) == 20_000 and all(abs(got[k] - size[max(0, k - 18) : k].mean()) < 1e-9 for k in (1, 17, 18, 19, 8191, 8192, 8193, 8200, 8209, 16384, 16390, 20_000))


def test_size_class_on_the_boundary(spark):
    """Series of 18 trades whose last is just half or three times their mean: never small, always large, however sums are rounded."""
    rng, rows = np.random.default_rng(5), []
    for k in range(200):
        cents = rng.integers(1, 500, 17)
        part, of = (35, "half") if k % 2 else (5, "thrice")  # 2 * 18 * x = sum + x, 18 * x = 3 * (sum + x)
        cents[0] += -cents.sum() % part
        rows += [(of, str(k), n, c / 100.0) for n, c in enumerate([*map(int, cents), int(cents.sum()) // part], 1)]
    t = spark.createDataFrame(rows, "venue string, instrument string, seq long, size double")
    got = profiles.relative_size(t).where("seq = 18").groupBy("venue", "size_class").count().collect()
    assert sorted(map(tuple, got)) == [("half", "medium", 100), ("thrice", "large", 100)]
    nothing = spark.createDataFrame([("V", "I", n, 0.0) for n in (1, 2)], "venue string, instrument string, seq long, size double")
    assert [r.size_class for r in profiles.relative_size(nothing).collect()] == ["medium"] * 2


def test_every_query_has_sql():
    assert set(REGISTRY) - {"bounded_windows"} == set(SQL)  # what is closed by force depends on all rows before; worked cases are in test_feeds


def test_latest_prices_without_lambdas(spark):
    """The condition on the spread holds all that the spread is made of, many times over: it must be plain comparisons, no sorts of arrays by lambdas."""
    plan = REGISTRY["spread_signal"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "array_sort" not in plan
