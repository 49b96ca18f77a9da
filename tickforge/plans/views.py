"""More market queries: operational views, recent windows, tiers, coverage and health reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickforge.functions.columns import base_quote, floored, is_identifier, subject, subject_parts, unfixed, fixed, without_market
from tickforge.operators import books, profiles, quality, reports, signals, windows
from tickforge.plans.queries import BOUNDARY, DAY, K, _day_profile, _hot_cold, query, rounded, v_cvd, v_ingestion_latency, v_volume_stats
from tickforge.sources import readers, ticks

HOUR = 3_600_000


def _tape(s, d):
    return windows.tape(ticks.dense(s, d, number=False), "1m", 12).drop("seq_last")


def _stats(s, d, timeframe):
    return windows.stats(ticks.mark_prices(s, d), ticks.liquidations(s, d), timeframe)


@query
def agg_candles(s, d):
    c = windows.candles(ticks.trades(s, d, number=False), "1h")
    return rounded(c.select(*K, "window_start", "close", "buy_volume", "sell_volume", F.try_divide(F.col("buy_volume") * 100, F.col("volume")).alias("buy_pct"), (F.col("close") - F.col("open")).alias("price_change")), 4)


@query
def agg_stats(s, d):
    return rounded(_stats(s, d, "1h").select(*K, "window_start", "liq_buy_volume", "liq_sell_volume", "liq_volume", "liq_count", "mark_close", "mark_high", "mark_low", "funding_avg", "funding_last", "seq_first", "seq_last"), 9)


@query
def agg_open_interest(s, d):
    return rounded(windows.interest_windows(ticks.open_interest(s, d), "5m"), 4)


@query
def agg_cvd(s, d):
    return rounded(windows.running_delta(windows.delta_volume(_tape(s, d))).select(*K, "window_start", "delta", "cvd"))


@query
def agg_tape(s, d):
    t = _tape(s, d)
    return rounded(t.select(*K, "window_start", "trade_count", "buy_count", "sell_count", "total_volume", "max_size", "rate", "imbalance", "is_burst", "vwap", (F.col("last_price") - F.col("vwap")).alias("last_less_vwap")), 4)


@query
def agg_delta_volume(s, d):
    v = windows.delta_volume(_tape(s, d))
    return rounded(v.withColumn("buy_pct", F.try_divide(F.col("buy_volume") * 100, F.col("buy_volume") + F.col("sell_volume"))), 4)


@query
def recent_volume_stats(s, d):
    v = windows.volume_stats(ticks.trades(s, d, number=False))
    delta = F.try_divide((F.col("buy_volume") - F.col("sell_volume")) * 100, F.col("total_volume"))
    return rounded(reports.recent(v, 6 * HOUR).select(*K, "window_start", "buy_volume", "sell_volume", delta.alias("delta_pct")), 4)


@query
def recent_closes(s, d):
    c = windows.candles(ticks.trades(s, d, number=False), "1h").select(*K, "window_start", "close", "high", "low", "volume", "trade_count")
    return rounded(reports.recent(c, 7 * DAY), 4)


@query
def recent_liquidations(s, d):
    return rounded(reports.recent(_stats(s, d, "5m"), 6 * HOUR).select(*K, "window_start", "liq_buy_volume", "liq_sell_volume"), 4)


@query
def recent_open_interest(s, d):
    return rounded(reports.recent(windows.interest_windows(ticks.open_interest(s, d), "5m"), DAY), 4)


@query
def recent_cvd(s, d):
    return rounded(reports.recent(v_cvd(s, d), DAY))


@query
def recent_funding(s, d):
    f = _stats(s, d, "1h").where("funding_last is not null").select(*K, "window_start", "funding_last", "funding_avg")
    return rounded(reports.recent(f, 7 * DAY), 9)


@query
def recent_tape(s, d):
    t = _tape(s, d).select(*K, "window_start", "rate", "imbalance", "is_burst", "vwap", "last_price")
    return rounded(reports.recent(t, HOUR // 2), 4)


@query
def latency_nearest_rank(s, d):
    return reports.percentiles(v_ingestion_latency(s, d), ["venue"], "latency_ms", [50, 95, 99])


@query
def coverage_gaps(s, d):
    """Missing hours of the month, before the first and after the last candle too."""
    return reports.coverage_gaps(windows.candles(ticks.trades(s, d, number=False), "1h"), HOUR, ticks.T0, ticks.T0 + 30 * DAY)


@query
def level_reasons(s, d):
    """Levels of the changes, some of them broken, by the reason."""
    e = lambda n: F.pmod(F.col("seq"), F.lit(n)) == 0
    l = ticks.book_deltas(s, d).withColumns({
        "price": F.when(e(101), float("nan")).when(e(103), float("inf")).when(e(107), -F.col("price")).when(e(109), 0.0).otherwise(F.col("price")),
        "size": F.when(e(113), -1.0).otherwise(F.col("size")),
    })
    return l.withColumn("reason", reports.level_reason(F.col("price"), F.col("size"))).where("reason is not null").groupBy(*K, "reason").agg(F.count("*").alias("levels"))


@query
def stream_health(s, d):
    """Messages of which some are lost, some late and, for one venue, some repeated."""
    t = ticks.trades(s, d).select(*K, "event_id", "ts_ingest_ms", "seq").where("event_id % 41 <> 0")
    t = t.withColumn("seq", F.when((F.col("venue") == "KRAKEN") & (F.col("event_id") % 43 == 0), F.col("seq") - 2).otherwise(F.col("seq")))
    return reports.stream_health(t, ["ts_ingest_ms", "event_id"])


@query
def federated_range(s, d):
    """The first 500 windows over both tiers from before the boundary to after it: the feature is that limit."""
    hot, cold = _hot_cold(s, d)
    return rounded(reports.federated(hot, cold, [*K, "window_start"], BOUNDARY - DAY, BOUNDARY + DAY, BOUNDARY, 500))


@query
def tier_times(s, d):
    hot, cold = _hot_cold(s, d)
    return reports.tier_times(hot, cold)


@query
def dimension_totals(s, d):
    """Trades by the attributes of two dimension tables, which the facts give."""
    t = ticks.trades(s, d, number=False)
    exchanges = t.groupBy("venue").agg(F.min("ts_exchange_ms").alias("first_seen_ms"))
    symbols = t.select("instrument").distinct().withColumn("quote", F.substring_index(base_quote(F.col("instrument")), "-", -1))
    joined = t.join(F.broadcast(exchanges), "venue").join(F.broadcast(symbols), "instrument")
    return rounded(joined.groupBy("venue", "quote", "first_seen_ms").agg(F.count("*").alias("trades"), unfixed(F.sum(fixed(F.col("size")))).alias("volume")))


@query
def catalog(s, d):
    base = windows.candles(ticks.trades(s, d, number=False), "1h")
    tape = _tape(s, d).withColumn("timeframe", F.lit("1m"))
    return reports.catalog(("candle", windows.cascade(base, ["1h", "4h", "1d"])), ("tape", tape))


@query
def burn_rates(s, d):
    return rounded(reports.burn_rates(ticks.events(s, d), "venue", "ts_ingest_ms", F.col("event_type") == "error", 0.99), 4)


@query
def fused_profile(s, d):
    return rounded(reports.fused_profile(_day_profile(s, d), ["instrument", "window_start"]))


@query
def fusion_meta(s, d):
    b = books.latest_books(ticks.book_snapshots(s, d)).withColumns({"bid": F.expr("bids[0].price"), "ask": F.expr("asks[0].price")})
    b = b.withColumn("spread_bps", (F.col("ask") - F.col("bid")) / ((F.col("ask") + F.col("bid")) / 2) * 10_000)
    return rounded(reports.fusion_meta(b, 5_000), 4)


@query
def tpo_summary(s, d):
    return rounded(profiles.time_price_summary(windows.candles(ticks.trades(s, d, number=False), "30m"), 10.0))


@query
def heatmap_bins(s, d):
    """Bucket widths of the heatmap by timeframe: how many trades have each."""
    t, out = ticks.trades(s, d, number=False), None
    for tf in ("5s", "1m", "1h"):
        one = profiles.bin_size(t, profiles.heatmap_factor(tf) * 100, 0.01).groupBy("venue", "bin").agg(F.count("*").alias("trades")).withColumn("timeframe", F.lit(tf))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query
def subject_routes(s, d):
    """Subjects made and taken apart again, of names with a market type; what isn't an identifier has none."""
    t = ticks.trades(s, d, number=False)
    name = F.when(F.col("event_id") % 89 == 0, "BTC USDT").otherwise(F.concat("instrument", F.lit(":SPOT")))
    parts = subject_parts(subject(F.lit("trade"), F.col("venue"), without_market(name), F.lit("raw")))
    ok = t.withColumn("p", F.when(is_identifier(without_market(name)), parts))
    return rounded(ok.groupBy("p.venue", "p.symbol", "p.timeframe").agg(F.count("*").alias("trades"), F.max(floored(F.col("price"), 1)).alias("max_price")))


@query
def freshness_by_channel(s, d):
    """By venue and channel: the last event and how far behind the newest it is."""
    e = ticks.events(s, d)
    g = e.groupBy("venue", "event_type").agg(F.max("ts_ingest_ms").alias("last_ms"), F.count("*").alias("events"))
    newest = g.agg(F.max("last_ms").alias("now"))
    g = g.join(F.broadcast(newest), F.lit(True)).withColumn("lag_ms", F.col("now") - F.col("last_ms")).drop("now")
    return g.withColumn("flowing", F.col("lag_ms") < 30_000)


@query
def row_checksums(s, d):
    """Rows whose stored digest isn't that of their content; every 97th was changed after it was taken."""
    t = ticks.trades(s, d).select(*K, "seq", "trade_id", "side")
    digest = F.sha2(F.concat_ws("|", "venue", "instrument", F.col("seq").cast("string"), "trade_id", "side"), 256)
    stored = t.withColumn("sha256", digest).withColumn("side", F.when(F.col("trade_id").cast("long") % 97 == 0, "none").otherwise(F.col("side")))
    return stored.where(F.col("sha256") != digest).groupBy(*K).agg(F.count("*").alias("changed"), F.min("seq").alias("first_seq"))


def _range(name, make, columns):
    """The first 1000 windows of one series within a range, both ends included: the reader's default limit."""

    def run(s, d):
        one = make(s, d).where("venue = 'BINANCE' and instrument = 'BTCUSDT'").select(*K, "window_start", *columns)
        return rounded(readers.read_range(one, ticks.T0 + 600_000, ticks.T0 + 20 * DAY), 4)

    run.__name__ = f"range_{name}"
    return query(run)


_range("stats", lambda s, d: _stats(s, d, "1h"), ["liq_volume", "mark_close", "funding_count"])
_range("tape", _tape, ["trade_count", "vwap"])
_range("open_interest", lambda s, d: windows.interest_windows(ticks.open_interest(s, d), "5m"), ["open_interest", "delta"])
_range("delta_volume", lambda s, d: windows.delta_volume(_tape(s, d)), ["delta"])
_range("cvd", lambda s, d: windows.running_delta(windows.delta_volume(_tape(s, d))), ["cvd"])
_range("bar_stats", lambda s, d: windows.bar_stats(_tape(s, d)), ["avg_size", "range"])
