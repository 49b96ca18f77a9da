"""Queries over feeds: routed envelopes, keys, repeats, owners, subscriptions, digests, sessions and bounded windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickforge.functions import keys
from tickforge.functions.columns import BURST, fixed
from tickforge.operators import audit, matching, open_windows, profiles, windows
from tickforge.plans.queries import BOUNDARY, K, query, rounded
from tickforge.sources import router, ticks

#: Of each kind of event the type of envelope that carries it.
KINDS = {"click": "trade", "purchase": "bookdelta", "view": "markprice", "error": "liquidation", "signup": "openinterest"}


def _envelopes(s, d):
    """One table of envelopes of five types, some of an unknown type or version, some broken, some without a field."""
    t = ticks.trades(s, d, number=False).drop("seq").join(ticks.events(s, d).select("event_id", "event_type"), "event_id")
    level = lambda sign: F.array(*(F.struct((F.col("price") + sign * k).alias("price"), (F.col("size") * k).alias("size")) for k in (1, 2)))
    body = {
        "trade": ["price", "size", "side", "trade_id"],
        "bookdelta": [level(-1).alias("bids"), level(1).alias("asks"), (F.col("event_id") % 50 == 0).alias("is_snapshot"), F.col("event_id").alias("first_id"), F.col("event_id").alias("final_id")],
        "markprice": [F.col("price").alias("mark_price"), F.col("price").alias("index_price"), (((F.col("event_id") * 13) % 201 - 100) / 1e6).alias("funding_rate")],
        "liquidation": ["price", "size", "side"],
        "openinterest": [F.when(F.col("event_id") % 193 != 0, 1000.0 + (F.col("price") - 100.0) * 10).alias("open_interest")],
    }
    payload, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for event, name in KINDS.items():
        payload = F.when(F.col("event_type") == event, F.to_json(F.struct(*body[name]))).otherwise(payload)
        kind = F.when(F.col("event_type") == event, F.lit(router.PREFIX + name)).otherwise(kind)
    every = lambda n: F.col("event_id") % n == 0
    return t.select(
        F.when(every(199), "marketdata.other").otherwise(kind).alias("type"), F.when(every(211), 2).otherwise(1).alias("version"), F.lower("venue").alias("venue"), "instrument", F.col("event_id").alias("seq"),
        F.col("ts_ingest_ms").alias("ts_ingest"), F.col("ts_exchange_ms").alias("ts_exchange"), F.col("trade_id").alias("idempotency_key"), F.when(every(197), "{broken").otherwise(payload).alias("payload"),
    )


@query
def routed_trades(s, d):
    return rounded(router.route(_envelopes(s, d))["trade"].select(*K, "seq", "ts_ingest_ms", "ts_exchange_ms", "price", "size", "side", "trade_id"))


@query
def routed_books(s, d):
    """Every level of every routed book change."""
    b = router.route(_envelopes(s, d))["bookdelta"]
    side = lambda c: b.select(*K, "seq", "is_snapshot", F.lit(c[:3]).alias("side"), F.explode(c).alias("x")).select(*K, "seq", "is_snapshot", "side", "x.price", "x.size")
    return rounded(side("bids").unionByName(side("asks")))


@query
def routed_marks(s, d):
    return rounded(router.route(_envelopes(s, d))["markprice"].select(*K, "seq", "mark_price", "index_price", "funding_rate"), 9)


@query
def routed_liquidations(s, d):
    return rounded(router.route(_envelopes(s, d))["liquidation"].select(*K, "seq", "price", "size", "side"))


@query
def routed_interest(s, d):
    return rounded(router.route(_envelopes(s, d))["openinterest"].select(*K, "seq", "open_interest"))


@query
def routed_quarantine(s, d):
    return router.route(_envelopes(s, d))["quarantine"].select("type", F.col("version").cast("long").alias("version"), "venue", "instrument", "seq", "reason")


@query
def stream_keys(s, d):
    """Keys of events that bring none, and of the rows of hourly candles."""
    t = ticks.trades(s, d, number=False)
    own = t.select(*K, F.col("event_id").alias("at"), keys.stream_key(F.col("venue"), F.col("instrument"), F.lit("marketdata.trade"), F.col("event_id")).alias("key"))
    c = windows.candles(t, "1h")
    return own.unionByName(c.select(*K, F.col("window_start").alias("at"), keys.window_key(F.col("venue"), F.col("instrument"), F.lit("1h"), F.col("window_start")).alias("key")))


@query
def repeats_within(s, d):
    """Repeats among the last 64 accepted keys of a series; some keys come back after more than that and are accepted again."""
    t = ticks.trades(s, d, number=False).withColumn("key", ((F.col("event_id") * 7919 + F.expr("event_id div 90") * 13) % 150).cast("string"))
    t = audit.first_within(t, K, F.expr(f"ts_ingest_ms div {ticks.SLICE_MS}"), ["ts_ingest_ms", "event_id"], F.col("key"), size=64, block=4096)
    return t.select(*K, "event_id", "key", "is_repeat")


@query
def ownership_audit(s, d):
    """Trades of streams that a second owner takes over in the middle of the month, with snapshots, a resync under way and numbers gone back."""
    t = ticks.trades(s, d)
    taken = t.where(F.col("ts_ingest_ms") < BOUNDARY).groupBy(*K).agg(F.max("seq").alias("top"))
    t = t.join(F.broadcast(taken), K, "left").withColumn("b", F.col("ts_ingest_ms") >= BOUNDARY)
    t = t.withColumns({
        "seq": F.when(F.col("event_id") % 53 == 0, F.col("seq") - 3).when(F.col("event_id") % 47 == 0, F.col("seq") - 1).when(F.col("event_id") % 499 == 0, -1).otherwise(F.col("seq")), "owner": F.when(F.col("b"), "b").otherwise("a"),
        "is_snapshot": F.col("event_id") % 50 == 0, "handoff_seq": F.when(F.col("b"), F.col("top") + 4), "pending_seq": F.when(F.col("b"), F.col("top") + 8),
    })
    return audit.ownership_audit(t).groupBy(*K, "action", "reason").agg(F.count("*").alias("rows"), F.min("event_id").alias("first_event"))


@query
def ordered_digests(s, d):
    return audit.run_digest_in_order(ticks.trades(s, d, number=False), K, F.expr(f"ts_ingest_ms div {ticks.SLICE_MS}"), ["ts_ingest_ms", "event_id"], "trade_id", "side", "ts_ingest_ms")


def _channels(s, d):
    """Events as a feed: channel by type, aggregation for half of them, depth for books."""
    e = ticks.events(s, d).withColumnRenamed("instrument", "symbol").withColumn("seq", F.col("event_id"))
    return e.select("venue", "symbol", F.col("event_type").alias("channel"), F.when(F.col("event_id") % 2 == 0, "1m").otherwise("").alias("aggregation"), F.when(F.col("event_type") == "purchase", 20).otherwise(0).alias("depth"), "seq", "ts_ingest_ms")


@query
def subscription_counts(s, d):
    """A filter for each order, with fields left open by its numbers: how many events fit, and the latest. Events are counted by field values first."""
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (F.expr(n) % len(v) + 1).cast("int"))
    o = s.read.parquet(f"{d}/orders.parquet")
    f = o.select(
        F.col("o_orderkey").alias("filter_id"), pick("o_orderkey", "BINANCE", "BYBIT", "", "COINBASE", "KRAKEN").alias("venue"), pick("o_custkey", "BTCUSDT", "ETHUSDT", "SOLUSDT", "").alias("symbol"),
        pick("o_orderkey div 5", "view", "error", "", "click", "purchase", "none").alias("channel"), pick("o_orderkey div 7", "", "1m", "5m").alias("aggregation"), pick("o_orderkey div 11", 0, 20, 0, 0).alias("depth"),
    )
    e = _channels(s, d).groupBy(*matching.FIELDS).agg(F.count("*").alias("n"), F.max("ts_ingest_ms").alias("latest"))
    return matching.matched(e, f, ["filter_id"]).groupBy("filter_id").agg(F.sum("n").alias("events"), F.max("latest").alias("latest_ms"))


@query
def subscription_feed(s, d):
    """A subscription for each nation, made on another day each: the snapshot of every stream, then how many events came after it."""
    n = s.read.parquet(f"{d}/nation.parquet")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (F.expr(n) % len(v) + 1).cast("int"))
    subs = n.select(
        F.col("n_nationkey").alias("id"), (F.lit(ticks.T0) + (F.col("n_nationkey") - 1) * 86_400_000).cast("long").alias("since"), pick("n_nationkey", "BINANCE", "", "KRAKEN").alias("venue"),
        pick("n_nationkey", "", "ETHUSDT").alias("symbol"), pick("n_nationkey", "view", "", "error", "click").alias("channel"), F.lit("").alias("aggregation"), F.lit(0).alias("depth"),
    )
    events = _channels(s, d).withColumn("seq", F.when(F.col("seq") % 37 == 0, F.col("seq") - 500).otherwise(F.col("seq")))
    out = matching.feed(events, subs, ["venue", "symbol", "channel"])
    return out.groupBy("id", "venue", "symbol", "channel", "kind").agg(F.count("*").alias("events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query
def session_bounds(s, d):
    """Of each hour the exchange's day session, the day session by UTC and a custom one of five hours."""
    hours = windows.candles(ticks.trades(s, d, number=False), "1h").select(*K, (F.col("window_start") + 1_234_567).alias("ts"))
    kinds = {"exchange": (23_400_000, "America/New_York", 570), "utc": (28_800_000, "UTC", 480), "custom": (18_000_000, None, 0)}
    out = None
    for name, (length, zone, opens) in kinds.items():
        part = hours.select(*K, "ts", F.lit(name).alias("anchor"), profiles.session_bounds(F.col("ts"), length, zone, opens).alias("b")).select(*K, "ts", "anchor", "b.*")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("anchor", "session_start", "session_end", "is_closed").agg(F.count("*").alias("hours"), F.min("ts").alias("first_ts"))


@query
def bounded_windows(s, d):
    """Minute candles with room for three open windows in the one shard that there is, so that most are closed by force."""
    return rounded(open_windows.bounded_windows(ticks.dense(s, d, number=False), 60_000, most=3, shards=1))


@query
def rolled_from_seconds(s, d):
    """The chain of candles from closed ones of a second: 5 s from them, and each longer one from the one before."""
    base = windows.candles(ticks.dense(s, d, number=False).withColumn("seq", F.col("event_id")), "1s")
    out, chain = None, base.where("is_closed")
    for tf in ("5s", "1m", "5m", "15m"):
        chain = windows.roll_up(chain, tf)
        part = chain.select(*K, "timeframe", "window_start", "open", "high", "low", "close", "volume", "trade_count", "is_closed")
        out = part if out is None else out.unionByName(part)
        chain = chain.where("is_closed")
    return rounded(out)


@query
def bursts(s, d):
    """Windows of three lengths and whether they have more trades than the length's own limit; trades fall into the first second of ten minutes."""
    t = ticks.dense(s, d, number=False).withColumns({"seq": F.col("event_id"), "ts_ingest_ms": F.col("ts_ingest_ms") - F.col("ts_ingest_ms") % 600_000 + F.col("ts_ingest_ms") % 1000})
    out = None
    for tf, limit in BURST.items():
        part = windows.tape(t, tf, limit).select(*K, F.lit(tf).alias("timeframe"), "window_start", "trade_count", fixed(F.col("total_volume")).alias("volume_fp"), "is_burst")
        out = part if out is None else out.unionByName(part)
    return out
