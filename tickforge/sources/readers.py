"""Readers of trade streams, envelopes and trade files, and range scans of stored windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.functions.columns import instrument_name, side_name, venue_name
from tickforge.operators import windows

TRADE = "venue string, symbol string, trade_id string, price double, quantity double, side string, ts_exchange_ms long, ts_ingest_ms long"
ENVELOPE = "type string, version int, venue string, instrument string, ts_exchange long, ts_ingest long, seq long, idempotency_key string, content_type string, meta map<string,string>, payload string"
TRADE_PAYLOAD = "price double, size double, side string, trade_id string, timestamp long"


def trade_stream(spark: SparkSession, path: str, delay: str = "5 seconds") -> DataFrame:
    """Trades from JSON files as they arrive, with event time and watermark; what doesn't parse becomes null."""
    raw = spark.readStream.schema(TRADE).json(path)
    return raw.withColumn("event_time", F.timestamp_millis("ts_exchange_ms")).withWatermark("event_time", delay)


def split_envelopes(envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flat trades of supported envelopes, and the rest for quarantine with the reason and a digest of the payload."""
    known = (F.col("type") == "marketdata.trade") & (F.col("version") == 1)
    p = F.from_json("payload", TRADE_PAYLOAD)
    good = envelopes.where(known).withColumn("p", p)
    flat = good.select(venue_name(F.col("venue")).alias("venue"), instrument_name(F.col("instrument")).alias("instrument"), "seq", "p.price", "p.size", side_name(F.col("p.side")).alias("side"), "p.trade_id", F.coalesce(F.expr("nullif(ts_exchange, 0)"), F.col("p.timestamp")).alias("ts_exchange_ms"), F.col("ts_ingest").alias("ts_ingest_ms"))
    bad = envelopes.where(~F.coalesce(known, F.lit(False))).select("type", "version", "venue", "instrument", "seq", "idempotency_key", F.lit("unsupported").alias("reason"), F.sha2("payload", 256).alias("payload_sha256"))
    return flat.where("not (coalesce(trade_id, '') = '' and coalesce(price, 0) = 0)"), bad


def trade_csv(spark: SparkSession, path: str, dialect: str = "a") -> DataFrame:
    """Historical trades. a: id, price, qty, _, _, time ms, is_buyer_maker; b: seconds, symbol, side, size, price."""
    if dialect == "a":
        rows = spark.read.schema("id string, price double, size double, x string, y string, time long, maker string").csv(path)
        return rows.where("price is not null").select(F.col("id").alias("trade_id"), "price", "size", F.when(F.lower(F.trim("maker")) == "true", "sell").otherwise("buy").alias("side"), F.col("time").alias("ts_exchange_ms"))
    rows = spark.read.schema("seconds double, symbol string, side string, size double, price double").csv(path)
    return rows.where("seconds is not null").select("price", "size", side_name(F.col("side")).alias("side"), (F.col("seconds") * 1000).cast("long").alias("ts_exchange_ms"))


def read_range(windows: DataFrame, start: int, end: int, limit: int = 1000, keep: str = "first") -> DataFrame:
    """Windows within [start, end], both included, in order; the first or the last `limit`. Bounds reach the scan."""
    rows = windows.where(F.col("window_start").between(start, end))
    key = F.col("window_start") if keep == "first" else F.desc("window_start")
    return rows.orderBy(key, "venue", "instrument").limit(limit)


def assembled(trades: DataFrame) -> DataFrame:
    """Historical trades as a stream: dense seq from 1 in order of time and id, ingest time as exchange time, key from the trade id."""
    rows = windows.numbered(trades, ["venue", "instrument"], F.expr("ts_exchange_ms div 3600000"), ["ts_exchange_ms", "trade_id"])
    return rows.withColumns({"seq": F.col("seq").cast("long"), "ts_ingest_ms": F.col("ts_exchange_ms"), "idempotency_key": F.concat_ws(":", "venue", "instrument", "trade_id")})


def read_events(events: DataFrame, start: int = 0, end: int = 0, limit: int = 1000, keep: str = "first") -> DataFrame:
    """Of each subject the first or last `limit` events within [start, end]; 0 leaves a bound open."""
    rows = events.where(F.col("ts_ingest_ms") >= start) if start else events
    rows = rows.where(F.col("ts_ingest_ms") <= end) if end else rows
    order = ["ts_ingest_ms", "seq"] if keep == "first" else [F.desc("ts_ingest_ms"), F.desc("seq")]
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("subject").orderBy(*order))).where(F.col("_k") <= limit).drop("_k")


def in_replay_order(envelopes: DataFrame) -> DataFrame:
    """Envelopes in the total order of a replay."""
    return envelopes.orderBy("ts_ingest", F.lower("venue"), F.upper("instrument"), F.lower("type"), "seq", "idempotency_key")


# Decimals of price and size by instrument; eight otherwise.
PRECISION = {"BTCUSDT": (2, 6), "ETHUSDT": (2, 6), "SOLUSDT": (3, 4)}


def precise(trades: DataFrame) -> DataFrame:
    """Price and size rounded to the instrument's decimals, half away from zero."""
    price, size = F.round("price", 8), F.round("size", 8)
    for name, (p, q) in PRECISION.items():
        price, size = F.when(F.col("instrument") == name, F.round("price", p)).otherwise(price), F.when(F.col("instrument") == name, F.round("size", q)).otherwise(size)
    return trades.withColumns({"price": price, "size": size})
