"""The market queries: (spark, sf_dir) -> DataFrame, over ticks that come from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.functions.columns import content_key, decayed, event_category, fixed, flags, instrument_name, share, side_name, subject, unfixed, venue_name, window_start
from tickforge.operators import book_state, books, indicators, profiles, quality, signals, windows
from tickforge.sources import dialects, readers, ticks

K = ["venue", "instrument"]
VENUES = ["BINANCE", "BYBIT", "COINBASE", "KRAKEN"]
BOUNDARY, DAY = 1705708800000, 86_400_000
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many decimals, half to even, as the SQL oracles round."""
    unit = 10.0**digits
    return df.select(*((F.rint(F.col(c) * unit) / unit).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query
def trades_flat(s, d):
    t = ticks.trades(s, d)
    return t.select(F.concat_ws(":", "venue", "instrument").alias("partition_key"), venue_name(F.col("venue")).alias("venue"), instrument_name(F.col("instrument")).alias("instrument"), "trade_id", "price", "size", side_name(F.col("side")).alias("side"), "ts_exchange_ms", "ts_ingest_ms", "seq")


def _candles(tf):
    def run(s, d):
        return rounded(windows.candles(ticks.trades(s, d, number=False), tf).drop("seq_first", "seq_last"))

    run.__name__ = f"candles_{tf}"
    return query(run)


for _tf in ("1m", "5m", "15m", "1h"):
    _candles(_tf)


@query
def volume_stats_5m(s, d):
    return rounded(windows.volume_stats(ticks.trades(s, d, number=False)))


@query
def market_summary(s, d):
    t = ticks.trades(s, d, number=False)
    t = t.join(F.broadcast(t.agg(F.max("ts_exchange_ms").alias("as_of"))))
    t = t.where(F.col("ts_exchange_ms") > F.col("as_of") - DAY).withColumns({"q": fixed(F.col("size")), "pq": F.col("price") * F.col("size")})
    buy = F.sum(F.when(F.col("side") == "buy", F.col("q")).otherwise(0))
    out = t.groupBy(*K).agg(F.count("*").alias("trade_count"), unfixed(F.sum("q")).alias("volume"), unfixed(buy).alias("buy_volume"), (100.0 * buy / F.sum("q")).alias("buy_pct"), F.min("price").alias("low"), F.max("price").alias("high"), F.try_divide(F.sum("pq"), F.sum("size")).alias("vwap"), F.max("ts_exchange_ms").alias("latest_ms"))
    return rounded(out, 4)


@query
def v_candles(s, d):
    c = windows.candles(ticks.trades(s, d, number=False), "1h")
    return rounded(c.select(*K, "window_start", "open", "high", "low", "close", "volume", "trade_count", (F.col("close") - F.col("open")).alias("change"), F.try_divide((F.col("close") - F.col("open")) * 100, F.col("open")).alias("change_pct")), 4)


@query
def v_volume_stats(s, d):
    v = windows.volume_stats(ticks.trades(s, d, number=False), "1h")
    pct = lambda x: F.try_divide(x * 100, F.col("total_volume"))
    return rounded(v.select(*K, "window_start", "total_volume", pct(F.col("buy_volume")).alias("buy_pct"), pct(F.col("sell_volume")).alias("sell_pct"), pct(F.col("buy_volume") - F.col("sell_volume")).alias("delta_pct"), "vwap"), 4)


@query
def v_cvd(s, d):
    v = windows.volume_stats(ticks.trades(s, d, number=False)).withColumn("delta", F.col("buy_volume") - F.col("sell_volume"))
    return rounded(windows.running_delta(v).select(*K, "window_start", "delta", "cvd"))


@query
def v_ingestion_latency(s, d):
    return ticks.trades(s, d, number=False).where("ts_ingest_ms >= ts_exchange_ms").select(*K, "trade_id", (F.col("ts_ingest_ms") - F.col("ts_exchange_ms")).alias("latency_ms"))


def _recent(s, d, ms):
    t = ticks.trades(s, d, number=False)
    return t.join(F.broadcast(t.agg(F.max("ts_exchange_ms").alias("as_of")))).where(F.col("ts_exchange_ms") > F.col("as_of") - ms)


@query
def kpi_trades(s, d):
    return _recent(s, d, DAY).groupBy("venue").agg(F.count("*").alias("trades"))


@query
def kpi_volume(s, d):
    return rounded(_recent(s, d, DAY).groupBy("instrument").agg(unfixed(F.sum(fixed(F.col("size")))).alias("volume")))


@query
def kpi_active_instruments(s, d):
    return _recent(s, d, 3_600_000).agg(F.countDistinct(F.concat_ws(":", *K)).alias("active"))


@query
def kpi_buy_sell_ratio(s, d):
    q = lambda side: F.sum(F.when(F.col("side") == side, fixed(F.col("size"))).otherwise(0))
    return rounded(_recent(s, d, DAY).groupBy("venue").agg(F.try_divide(q("buy"), q("sell")).alias("ratio")))


@query
def kpi_latency_p50(s, d):
    return rounded(v_ingestion_latency(s, d).agg(F.percentile("latency_ms", 0.5).alias("p50")))


@query
def volume_by_exchange(s, d):
    return rounded(ticks.trades(s, d, number=False).groupBy("venue").agg(unfixed(F.sum(fixed(F.col("size")))).alias("volume"), F.count("*").alias("trades")))


@query
def top_instruments(s, d):
    """The feature is a top 25 (here of venue and instrument)."""
    t = ticks.trades(s, d, number=False).withColumn("q", fixed(F.col("size")))
    out = t.groupBy(*K).agg(F.count("*").alias("trades"), unfixed(F.sum("q")).alias("volume"), (100.0 * F.sum(F.when(F.col("side") == "buy", F.col("q")).otherwise(0)) / F.sum("q")).alias("buy_pct"), (F.sum(fixed(F.col("price") * F.col("size"))) / F.sum("q")).alias("vwap"))
    return rounded(out.orderBy(F.desc("trades"), *K).limit(25), 4)


@query
def hourly_volume(s, d):
    return rounded(windows.candles(ticks.trades(s, d, number=False), "1h").groupBy("window_start").agg(unfixed(F.sum(fixed(F.col("volume")))).alias("volume"), F.sum("trade_count").alias("trades")))


@query
def latency_percentiles(s, d):
    out = v_ingestion_latency(s, d).groupBy("venue").agg(F.avg("latency_ms").alias("avg_ms"), F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p"))
    return rounded(out.select("venue", "avg_ms", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99")))


@query
def data_freshness(s, d):
    t = ticks.trades(s, d, number=False)
    t = t.join(F.broadcast(t.agg(F.max("ts_ingest_ms").alias("as_of"))))
    out = t.groupBy(*K).agg(F.max("ts_ingest_ms").alias("last_ms"), (F.max("as_of") - F.max("ts_ingest_ms")).alias("lag_ms"), F.count_if(F.col("ts_ingest_ms") > F.col("as_of") - DAY).alias("last_day"))
    return out.withColumn("status", F.when(F.col("lag_ms") < 30_000, "flowing").when(F.col("lag_ms") < 3_600_000, "partial").when(F.col("last_day") > 0, "stale").otherwise("inactive"))


@query
def op_candles_all_tf(s, d):
    return rounded(windows.cascade(windows.candles(ticks.trades(s, d, number=False), "1h"), ["1h", "4h", "1d"]))


@query
def rollup_1h_from_1m(s, d):
    return rounded(windows.roll_up(windows.candles(ticks.trades(s, d), "1m"), "1h"))


@query
def stats_1h(s, d):
    return rounded(windows.stats(ticks.mark_prices(s, d), ticks.liquidations(s, d), "1h").drop("funding_avg", "quality_flags", "funding_last", "liq_sell_volume", "seq_first", "seq_last"))


@query
def funding_avg_1h(s, d):
    return rounded(windows.stats(ticks.mark_prices(s, d), ticks.liquidations(s, d), "1h").where("funding_count > 0").select(*K, "window_start", "funding_count", "funding_avg"), 9)


@query
def quality_flags(s, d):
    out = windows.stats(ticks.mark_prices(s, d), ticks.liquidations(s, d), "4h")
    return out.select(*K, "window_start", F.col("quality_flags").cast("long").alias("quality_flags"))


@query
def tape_5s(s, d):
    return rounded(windows.tape(ticks.dense(s, d, number=False), "5s", 3).drop("seq_last"))


@query
def burst_windows(s, d):
    return windows.tape(ticks.dense(s, d, number=False), "1s", 1).where("is_burst").select(*K, "window_start", "trade_count")


@query
def delta_volume_5s(s, d):
    return rounded(windows.delta_volume(windows.tape(ticks.dense(s, d, number=False), "5s")))


@query
def cvd_5s(s, d):
    return rounded(windows.running_delta(windows.delta_volume(windows.tape(ticks.dense(s, d, number=False), "5s"))).select(*K, "window_start", "cvd"))


@query
def bar_stats_5s(s, d):
    return rounded(windows.bar_stats(windows.tape(ticks.dense(s, d, number=False), "5s")))


@query
def oi_delta(s, d):
    return rounded(windows.interest_changes(ticks.open_interest(s, d)).select(*K, "seq", "open_interest", "delta", "delta_pct"))


@query
def oi_cadence(s, d):
    return windows.interest_changes(ticks.open_interest(s, d)).select(*K, "seq", "cadence_ms", "confidence")


def _dirty(s, d):
    t = ticks.trades(s, d)
    t = t.withColumns({"price": F.when(F.col("event_id") % 101 == 0, 0.0).otherwise(F.col("price")), "side": F.when(F.col("event_id") % 103 == 0, "hold").otherwise(F.col("side")), "seq": F.when(F.col("event_id") % 53 == 0, F.col("seq") - 3).otherwise(F.col("seq"))})
    return t.withColumn("copy", F.lit(0)).unionByName(t.where("event_id % 20 = 0").withColumn("copy", F.lit(1)))


@query
def seq_audit(s, d):
    a = quality.sequence_audit(_dirty(s, d).where("copy = 0"))
    return a.groupBy(*K, "verdict").agg(F.count("*").alias("rows"))


@query
def dedup_trades(s, d):
    return quality.first_of_each(_dirty(s, d), [*K, "trade_id"], ["copy"]).groupBy(*K).agg(F.count("*").alias("rows"), F.sum("seq").alias("seq_sum"))


@query
def candle_gaps(s, d):
    return quality.window_gaps(windows.candles(ticks.trades(s, d, number=False), "1h"), 3_600_000)


@query
def invalid_ticks(s, d):
    return quality.validated(_dirty(s, d))[1].groupBy(*K, "reason").agg(F.count("*").alias("rows"))


@query
def rule_violations(s, d):
    t = _dirty(s, d).where("copy = 0")
    p = t.select("trade_id", F.to_json(F.struct("side", F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.col("venue")).alias("venue"), F.when(F.col("event_id") % 11 != 0, F.col("trade_id")).alias("id"))).alias("payload"))
    out = quality.rule_violations(p, [("required", "id", None), ("not_empty", "venue", None), ("equals", "side", "buy")])
    return out.select("trade_id", "status", F.array_join("violations", ",").alias("violations"))


def _hot_cold(s, d):
    c = windows.candles(ticks.trades(s, d, number=False), "1h").select(*K, "window_start", "open", "close", "volume")
    hot = c.where(F.col("window_start") >= BOUNDARY - DAY).withColumn("volume", F.when(F.col("window_start") < BOUNDARY + DAY, F.col("volume") + 1).otherwise(F.col("volume")))
    return hot, c.where(F.col("window_start") < BOUNDARY + DAY)


@query
def drift_report(s, d):
    hot, cold = _hot_cold(s, d)
    return quality.drift(hot.select(*K, "window_start", (F.col("volume") * 100).cast("long").alias("v")), cold.select(*K, "window_start", (F.col("volume") * 100).cast("long").alias("v")), [*K, "window_start"], ["v"])


@query
def consistency_report(s, d):
    return quality.consistency(*_hot_cold(s, d))


@query
def federated_candles(s, d):
    hot, cold = _hot_cold(s, d)
    return rounded(quality.latest_tier(hot, cold, [*K, "window_start"]).drop("tier"))


@query
def first_last_candle(s, d):
    c = windows.candles(ticks.trades(s, d, number=False), "1h")
    return rounded(c.groupBy(*K).agg(F.min("window_start").alias("first_start"), F.min_by("open", "window_start").alias("first_open"), F.max("window_start").alias("last_start"), F.max_by("close", "window_start").alias("last_close")))


@query
def range_tail(s, d):
    """The newest 1000 windows of a range: the reader's default limit."""
    c = windows.candles(ticks.trades(s, d, number=False), "1h").select(*K, "window_start", "close")
    return rounded(readers.read_range(c, BOUNDARY - 5 * DAY, BOUNDARY + 5 * DAY, 1000, "last"))


@query
def retention_filter(s, d):
    c = windows.candles(ticks.trades(s, d, number=False), "1h").select(*K, "window_start", "volume")
    return rounded(c.join(F.broadcast(c.agg(F.max("window_start").alias("now")))).where(F.col("window_start") >= F.col("now") - 14 * DAY).drop("now"))


def _profile(s, d):
    return profiles.volume_profile(ticks.trades(s, d))


@query
def profile_upsert_merge(s, d):
    p = _profile(s, d).select(*K, "window_start", "price_low", *(fixed(F.col(c)).alias(c) for c in ("buy_volume", "sell_volume")), "seq_min", "seq_max")
    changes = p.withColumn("op", F.xxhash64("seq_min")).unionByName(p.where("seq_min % 3 = 0").withColumn("op", F.xxhash64("seq_min")))
    out = quality.merged_upsert(p, changes, [*K, "window_start", "price_low"], "op", ["buy_volume", "sell_volume"])
    return rounded(out.withColumns({c: unfixed(F.col(c)) for c in ("buy_volume", "sell_volume")}))


@query
def vpvr_1h(s, d):
    return rounded(_profile(s, d))


@query
def vpvr_poc(s, d):
    return rounded(profiles.point_of_control(_profile(s, d), [*K, "window_start"]))


def _day_profile(s, d):
    t = ticks.trades(s, d, number=False).withColumns({"price_low": profiles.bucket(F.col("price"), F.lit(5.0)), "window_start": window_start(F.col("ts_ingest_ms"), DAY), "q": fixed(F.col("size"))})
    on = lambda x: unfixed(F.sum(F.when(F.col("side") == x, F.col("q")).otherwise(0)))
    return t.groupBy(*K, "window_start", "price_low", (F.col("price_low") + 5.0).alias("price_high")).agg(on("buy").alias("buy_volume"), on("sell").alias("sell_volume"), unfixed(F.sum("q")).alias("total_volume"))


@query
def vpvr_compressed(s, d):
    return rounded(profiles.compressed(_day_profile(s, d), [*K, "window_start"], 0.5).select(*K, "window_start", "price_low", "total_volume"))


@query
def heatmap_1h(s, d):
    return rounded(profiles.heatmap(ticks.book_snapshots(s, d), ticks.dense(s, d), "1m", 2.0))


@query
def session_vp(s, d):
    return rounded(profiles.session_profile(windows.candles(ticks.trades(s, d, number=False), "1h"), 5.0, "America/Chicago", 510))


@query
def session_value_area(s, d):
    p = profiles.session_profile(windows.candles(ticks.trades(s, d, number=False), "1h"), 5.0)
    return rounded(profiles.value_area_outward(p, [*K, "session_start"]))


@query
def tpo_profile(s, d):
    c = windows.candles(ticks.trades(s, d, number=False), "30m")
    return rounded(profiles.time_price(c, 1.0))


@query
def footprint_1h(s, d):
    return rounded(profiles.footprint(ticks.trades(s, d, number=False), "1h", 5.0))


@query
def dom_fills(s, d):
    return rounded(profiles.fills(ticks.trades(s, d, number=False), 10.0))


@query
def cross_venue_snapshot(s, d):
    return rounded(books.latest_prices(ticks.trades(s, d, number=False), VENUES, unique=True), 4)


@query
def spread_signal(s, d):
    return rounded(books.latest_prices(ticks.trades(s, d, number=False), VENUES, unique=True).where("venues >= 3 and spread_bps >= 2000").select("instrument", "trade_id", "venues", "spread_abs", "spread_bps"), 4)


@query
def cross_venue_book(s, d):
    return rounded(books.cross_venue(ticks.book_snapshots(s, d), 60_000))


@query
def fused_depth(s, d):
    return rounded(books.fused_depth(ticks.book_snapshots(s, d)))


@query
def fused_vp_value_area(s, d):
    p = profiles.fused(_day_profile(s, d), ["instrument", "window_start"])
    return rounded(profiles.value_area_by_rank(p, ["instrument", "window_start"]))


@query
def book_as_of(s, d):
    """The books as they stood at BOUNDARY."""
    return rounded(books.book_as_of(ticks.book_deltas(s, d), ts_ms=BOUNDARY))


@query
def grouped_book(s, d):
    return rounded(books.grouped(books.book_as_of(ticks.book_deltas(s, d)), 5.0))


def _hours(s, d):
    return windows.candles(ticks.trades(s, d, number=False), "1h")


@query
def regime_trend(s, d):
    return rounded(signals.trend(_hours(s, d)).select(*K, "window_start", "slope", "move", "kind", "strength"))


@query
def regime_volatility(s, d):
    return rounded(signals.volatility(_hours(s, d)).select(*K, "window_start", "atr", "kind", "strength"))


@query
def regime_breakout(s, d):
    return rounded(signals.breakout(_hours(s, d)).select(*K, "window_start", "move", "volume", "volume_ratio", "strength"))


@query
def regime_arbitrated(s, d):
    return rounded(signals.arbitrated(_hours(s, d)))


@query
def regime_latest(s, d):
    return rounded(signals.latest_regimes(signals.arbitrated(_hours(s, d))))


@query
def regime_history(s, d):
    """The newest ten regimes of each stream: the feature is that bound."""
    return rounded(quality.newest(signals.arbitrated(_hours(s, d)).select(*K, "window_start", "kind", "strength"), K, "window_start", 10))


def _inputs(s, d):
    return signals.book_inputs(ticks.book_snapshots(s, d))


@query
def ev_spread_explosion(s, d):
    return rounded(signals.spread_explosion(_inputs(s, d)).select(*K, "seq", "spread_bps", "z", "severity", "confidence"), 4)


@query
def ev_thinning(s, d):
    return rounded(signals.thinning(_inputs(s, d)).select(*K, "seq", "depth", "drop_share", "severity", "confidence"), 4)


@query
def ev_imbalance_streak(s, d):
    return signals.imbalance_streaks(_inputs(s, d))


@query
def ev_sweep(s, d):
    return rounded(signals.sweeps(_inputs(s, d)).select(*K, "seq", "side", "bid_depth", "ask_depth", "levels_lost", "severity", "confidence"), 4)


@query
def ev_persistent_imbalance(s, d):
    return rounded(signals.persistent_imbalance(_inputs(s, d)).select(*K, "seq", "seq_start", "sign", "consecutive", "severity", "confidence"), 4)


@query
def ev_absorption(s, d):
    """Over calm prices: 100, 0.02 more a day, and a 20,000th of the trade's own distance from 100."""
    t = ticks.trades(s, d)
    calm = 100 + (F.col("ts_ingest_ms") - ticks.T0) / DAY * 0.02 + (F.col("price") - 100) / 20_000
    return rounded(signals.absorption(t.withColumn("price", calm)), 4)


@query
def ev_cooled(s, d):
    """Spread explosions at least 5 s apart."""
    e = signals.spread_explosion(_inputs(s, d)).select(*K, "seq", "ts_ingest_ms", "severity", "confidence")
    return signals.cooled(e, K, order=("ts_ingest_ms", "seq"))


@query
def latest_evidence(s, d):
    """The newest sweep of each stream after a cooldown of 5 s."""
    c = signals.cooled(signals.sweeps(_inputs(s, d)).select(*K, "seq", "ts_ingest_ms", "side"), K, order=("ts_ingest_ms", "seq"))
    return c.groupBy(*K).agg(F.count("*").alias("kept"), F.max("seq").alias("last_seq"), F.max_by("side", "seq").alias("last_side"))


@query
def confidence_decay(s, d):
    e = signals.spread_explosion(_inputs(s, d)).select(*K, "seq", "ts_ingest_ms", "confidence")
    e = e.withColumn("now", F.max("ts_ingest_ms").over(Window.partitionBy(*K)))
    return rounded(e.select(*K, "seq", decayed(F.col("confidence"), F.col("now") - F.col("ts_ingest_ms"), 600_000).alias("confidence")), 4)


@query
def symbol_exposure(s, d):
    p = ticks.positions(s, d)
    return rounded(p.groupBy("account", "symbol").agg(F.sum(F.when(F.col("side") == "long", F.col("quantity")).otherwise(-F.col("quantity"))).alias("net_qty"), F.sum(F.rint(F.col("notional") * 100).cast("long")).alias("gross_cents"), F.countDistinct("venue").alias("venues")))


@query
def exposure_divergence(s, d):
    p = ticks.positions(s, d)
    on = lambda x: F.count_if(F.col("side") == x)
    return p.groupBy("account", "symbol", "venue").agg(on("long").alias("longs"), on("short").alias("shorts")).groupBy("account", "symbol").agg(F.count_if(F.col("longs") > F.col("shorts")).alias("long_venues"), F.count_if(F.col("longs") < F.col("shorts")).alias("short_venues")).where("long_venues > 0 and short_venues > 0")


@query
def slo_burn(s, d):
    """Burn of a 1 % error budget over sliding hours: two windows that both burn fast make a breach."""
    e = ticks.events(s, d).withColumn("hour", window_start(F.col("ts_ingest_ms"), 3_600_000))
    g = e.groupBy("venue", "hour").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"))
    w = Window.partitionBy("venue").orderBy("hour").rangeBetween(-5 * 3_600_000, 0)
    g = g.withColumns({"burn_1h": share(F.col("errors").cast("double"), F.col("total") * 0.01), "burn_6h": share(F.sum("errors").over(w).cast("double"), F.sum("total").over(w) * 0.01)})
    return rounded(g.withColumn("breach", (F.col("burn_1h") > 14.4) & (F.col("burn_6h") > 6)))


@query
def coverage_matrix(s, d):
    n = ticks.events(s, d).groupBy(*K, "event_type").agg(F.count("*").alias("n"))
    return n.groupBy(*K).pivot("event_type", ["view", "error", "signup", "click", "purchase"]).agg(F.first("n")).select(*K, *(F.coalesce(F.col(c), F.lit(0)).alias(f"n_{c}") for c in ("view", "error", "signup")))


@query
def subscription_match(s, d):
    """Events against filters whose empty fields match anything: a theta join with a small list."""
    f = s.createDataFrame([(1, "BINANCE", "", ""), (2, "", "BTCUSDT", "error"), (3, "KRAKEN", "ETHUSDT", ""), (4, "", "", "signup")], "filter_id long, fv string, fi string, fe string")
    e = ticks.events(s, d)
    hit = ((F.col("fv") == "") | (F.col("fv") == F.col("venue"))) & ((F.col("fi") == "") | (F.col("fi") == F.col("instrument"))) & ((F.col("fe") == "") | (F.col("fe") == F.col("event_type")))
    return e.join(F.broadcast(f), hit).groupBy("filter_id", *K).agg(F.count("*").alias("events"), F.max("ts_ingest_ms").alias("latest_ms"))


@query
def subjects(s, d):
    return ticks.trades(s, d, number=False).groupBy(subject(F.lit("trade"), F.col("venue"), F.col("instrument"), F.lit("raw")).alias("subject")).agg(F.count("*").alias("rows"), F.max(flags(F.col("price") > 400, F.col("size") > 4)).cast("long").alias("max_flags"))


@query
def envelopes(s, d):
    """Envelopes of the trades, decoded again; those of an unknown version are left for quarantine."""
    t = ticks.trades(s, d, number=False)
    e = t.select(F.lit("marketdata.trade").alias("type"), F.when(F.col("event_id") % 211 == 0, 2).otherwise(1).alias("version"), *K, F.col("ts_exchange_ms").alias("ts_exchange"), F.col("ts_ingest_ms").alias("ts_ingest"), "seq", F.col("trade_id").alias("idempotency_key"), F.to_json(F.struct("price", "size", "side", "trade_id", F.col("ts_exchange_ms").alias("timestamp"))).alias("payload"))
    good, bad = readers.split_envelopes(e)
    g = good.groupBy(*K).agg(F.count("*").alias("good"), F.sum(fixed(F.col("price"))).alias("price_fp"))
    b = bad.groupBy(*K).agg(F.count("*").alias("quarantined"))
    return g.join(b, K, "left").withColumn("quarantined", F.coalesce("quarantined", F.lit(0)))


@query
def candles_big_1d(s, d):
    """Daily candles of the largest table, for the benchmark."""
    return rounded(windows.candles(ticks.trades_big(s, d), "1d").drop("seq_first", "seq_last"))


@query
def fused_heatmap(s, d):
    return rounded(profiles.fused_heatmap(profiles.heatmap(ticks.book_snapshots(s, d), ticks.dense(s, d), "1m", 2.0)))


@query
def trade_size_class(s, d):
    return profiles.relative_size(ticks.trades(s, d)).groupBy(*K, "size_class").agg(F.count("*").alias("trades"), F.max("seq").alias("last_seq"))


def _raw(s, d):
    """The trades as messages of six venues, in each venue's own form."""
    t = ticks.trades(s, d, number=False).withColumns({"at": F.col("event_id") % 6, "p": F.col("price").cast("string"), "q": F.col("size").cast("string")})
    maps = lambda **x: F.struct(*(v.alias(k) for k, v in x.items()))
    col, lit = F.col, F.lit
    coin = F.regexp_replace("instrument", "USDT$", "")
    iso = F.date_format(F.timestamp_millis("ts_exchange_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    forms = [
        ("BINANCE", maps(e=lit("aggTrade"), E=col("ts_ingest_ms"), s=col("instrument"), a=col("event_id"), p=col("p"), q=col("q"), T=col("ts_exchange_ms"), m=col("side") == "sell")),
        ("BYBIT", maps(topic=F.concat(lit("publicTrade."), "instrument"), data=F.array(maps(T=col("ts_exchange_ms"), s=col("instrument"), S=F.initcap("side"), p=col("p"), v=col("q"), i=col("trade_id"))))),
        ("COINBASE", maps(type=lit("match"), trade_id=col("event_id"), product_id=F.concat(coin, lit("-USD")), price=col("p"), size=col("q"), side=col("side"), time=iso)),
        ("HYPERLIQUID", maps(channel=lit("trades"), data=F.array(maps(coin=coin, side=F.when(col("side") == "buy", "B").otherwise("A"), px=col("p"), sz=col("q"), time=col("ts_exchange_ms"), hash=lit("0x0"), tid=col("event_id"))))),
        ("KRAKEN", maps(channel=lit("trade"), data=F.array(maps(symbol=F.concat(F.replace(coin, lit("BTC"), lit("XBT")), lit("/USD")), trades=F.array(maps(price=col("p"), qty=col("q"), side=col("side"), timestamp=iso, trade_id=col("event_id"))))))),
        ("KRAKENF", maps(feed=lit("trade"), product_id=F.concat(lit("PI_"), F.replace(coin, lit("BTC"), lit("XBT")), lit("USD")), price=col("p"), qty=col("q"), side=col("side"), time=col("ts_exchange_ms"), uid=col("trade_id"))),
    ]
    venue, message = lit(None), lit(None)
    for k, (name, form) in enumerate(forms):
        venue, message = F.when(col("at") == k, name).otherwise(venue), F.when(col("at") == k, F.to_json(form)).otherwise(message)
    return t.select(venue.alias("venue"), message.alias("message"), col("ts_ingest_ms").alias("received_ms"))


@query
def venue_trades(s, d):
    return dialects.trades(_raw(s, d))


@query
def book_states(s, d):
    return rounded(book_state.book_states(ticks.book_deltas(s, d), checksums=False).drop("checksum"), 4)


@query
def heatmap_coarse(s, d):
    """Heatmap cells under small limits, so that widening and the cut show."""
    cells = profiles.heatmap(ticks.book_snapshots(s, d), ticks.dense(s, d), "5m", 2.0)
    return rounded(profiles.coarsened(cells, 2.0, [*K, "window_start"], buckets=24, most=60))


@query
def display_groups(s, d):
    return rounded(profiles.group_sizes(ticks.trades(s, d, number=False)).groupBy("venue", "group_size").agg(F.count("*").alias("trades"), F.max("price").alias("max_price")))


@query
def ev_spread_regime(s, d):
    return rounded(signals.spread_regimes(_inputs(s, d)).select(*K, "seq", "spread_bps", "before", "regime", "severity", "confidence"), 4)


@query
def ev_tape_absorption(s, d):
    return rounded(signals.tape_absorption(_inputs(s, d), windows.tape(ticks.dense(s, d), "5s")).select(*K, "seq", "window_start", "total_volume", "spread_bps", "volume_ratio", "severity"), 4)


@query
def ind_moving(s, d):
    return rounded(indicators.moving(_hours(s, d)).select(*K, "window_start", "sma", "upper", "lower", "vwap"), 4)


@query
def ind_rsi(s, d):
    return rounded(indicators.strength(_hours(s, d)).select(*K, "window_start", "rsi"), 4)


@query
def ind_macd(s, d):
    return rounded(indicators.macd(_hours(s, d)).select(*K, "window_start", "macd", "signal", "histogram"), 4)


@query
def ind_heikin_ashi(s, d):
    return rounded(indicators.heikin_ashi(_hours(s, d)).select(*K, "window_start", "ha_open", "ha_high", "ha_low", "ha_close"), 4)


@query
def event_categories(s, d):
    names = {"view": "marketdata.bookdelta", "click": "insights.heatmap_snapshot", "error": "aggregation.candle.close", "purchase": "ops.telemetry.v1"}
    kind = F.lit("marketdata.trade")
    for event, name in names.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    e = ticks.events(s, d).withColumn("kind", kind)
    return e.groupBy(event_category(F.col("kind")).alias("category"), "venue").agg(F.count("*").alias("events"))


@query
def envelope_audit(s, d):
    """Envelopes of the trades, some of them broken, by the reason of their quarantine."""
    at = lambda n: F.col("event_id") % n == 0
    t = ticks.trades(s, d)
    e = t.select(F.when(at(101), "marketdata.quote").otherwise("marketdata.trade").alias("type"), F.when(at(103), 2).otherwise(1).alias("version"), F.when(at(107), " ").otherwise(F.col("venue")).alias("venue"), "instrument", F.when(at(109), 0).otherwise(F.col("ts_ingest_ms")).alias("ts_ingest"), "seq", F.when(~at(113), F.col("trade_id")).alias("idempotency_key"), F.when(at(127), "{broken").otherwise('{"a":"1"}').alias("payload"))
    return quality.quarantined(e, {"marketdata.trade": 1}).groupBy("instrument", "reason", "error").agg(F.count("*").alias("rows"), F.min("seq").alias("first_seq"))


@query
def candle_audit(s, d):
    c = windows.candles(ticks.trades(s, d, number=False), "1h").withColumn("hour", F.expr("window_start div 3600000"))
    c = c.withColumns({"high": F.when(F.col("hour") % 7 == 0, F.col("low") - 1).otherwise(F.col("high")), "volume": F.when(F.col("hour") % 11 == 0, F.col("volume") + 1).otherwise(F.col("volume"))})
    return quality.broken_rules(c, quality.CANDLE_RULES).groupBy(*K, "rule").agg(F.count("*").alias("candles"))


@query
def tape_audit(s, d):
    t = windows.tape(ticks.dense(s, d), "5s").withColumn("buy_count", F.when(F.expr("(window_start div 5000) % 5 = 0"), F.col("buy_count") + 1).otherwise(F.col("buy_count")))
    return quality.broken_rules(t, quality.TAPE_RULES).groupBy(*K, "rule").agg(F.count("*").alias("windows"))


@query
def run_digest(s, d):
    return quality.run_expectations(ticks.trades(s, d), "venue", "instrument", "seq", "trade_id", "ts_ingest_ms")


@query
def latest_versions(s, d):
    c = windows.candles(ticks.trades(s, d, number=False), "1h").select(*K, "window_start", "close").withColumn("version", F.lit(1))
    second = c.where("window_start % 10800000 = 0").withColumns({"close": F.col("close") + 1, "version": F.lit(2)})
    return rounded(quality.latest_versions(c.unionByName(second), [*K, "window_start"], "version").select(*K, "window_start", "close", F.col("version").cast("long").alias("version")))


@query
def strict_order(s, d):
    """How many trades are late by exchange time, when ids tell the order of arrival."""
    t = quality.lateness(ticks.trades(s, d, number=False), 60_000, "ts_exchange_ms", ["event_id"], K)
    return t.groupBy(*K).agg(F.count("*").alias("trades"), F.count_if("is_late").alias("late"))


@query
def catch_up(s, d):
    return quality.caught_up(ticks.trades(s, d, number=False), 3_600_000, ["event_id"], K).groupBy(*K).agg(F.count("*").alias("trades"), F.max("trade_id").alias("last_id"))


@query
def content_keys(s, d):
    """Liquidations told apart by source id or, where that is missing, by content."""
    l = ticks.liquidations(s, d).withColumn("id", F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(""))
    key = content_key(F.col("id"), F.col("side"), F.col("ts_ingest_ms"))
    return l.unionByName(l).select(*K, key.alias("dedup_key"), "seq").groupBy(*K, "dedup_key").agg(F.min("seq").alias("seq"), F.count("*").alias("copies"))


@query
def backfill_assembled(s, d):
    return readers.assembled(ticks.trades(s, d, number=False).drop("seq", "ts_ingest_ms")).select(*K, "seq", "trade_id", "ts_ingest_ms", "idempotency_key")


@query
def event_range_newest(s, d):
    """The newest five events of each subject up to a bound: the feature is that cut."""
    t = ticks.trades(s, d).withColumn("subject", subject(F.lit("trade"), F.col("venue"), F.col("instrument"), F.lit("raw")))
    return readers.read_events(t, 0, BOUNDARY, 5, "last").select("subject", "seq", "trade_id", "ts_ingest_ms")


@query
def precise_trades(s, d):
    t = ticks.trades(s, d, number=False).withColumns({"price": F.col("price") / 7, "size": F.col("size") / 7})
    return readers.precise(t).select(*K, "trade_id", "price", "size")


@query
def vpvr_changes(s, d):
    return rounded(profiles.profile_changes(ticks.trades(s, d), 5.0, DAY))


@query
def bar_counter(s, d):
    return rounded(profiles.rolling_counter(_hours(s, d)), 4)


@query
def thinned_candles(s, d):
    """Every third candle of a series, and all at midnight."""
    return rounded(quality.thinned(_hours(s, d), K, "window_start", 3, F.col("window_start") % DAY == 0).select(*K, "window_start", "close"))


@query
def reject_reasons(s, d):
    """The ten most frequent reasons of rejection by venue: the feature is that cut."""
    return quality.validated(_dirty(s, d))[1].groupBy("venue", "reason").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "venue", "reason").limit(10)


@query
def capped_books(s, d):
    c = books.capped(books.book_as_of(ticks.book_deltas(s, d)), 3)
    side = lambda x: F.array_join(F.transform(x, lambda v: v["price"].cast("long").cast("string")), ",")
    return rounded(c.select(*K, side("bids").alias("bids"), side("asks").alias("asks"), "bid_levels", "ask_levels", "spread_bps"), 4)


@query
def throttled_books(s, d):
    return books.throttled(ticks.book_snapshots(s, d), 10_000).select(*K, "interval_start", "seq", "ts_ingest_ms")


@query
def newest_evidence(s, d):
    """The newest three sweeps of each stream: the feature is that cut."""
    return quality.newest(signals.sweeps(_inputs(s, d)).select(*K, "seq", "side"), K, "seq", 3)
