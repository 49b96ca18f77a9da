"""Ticks derived from the given tables, as FIXTURES.md defines them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.operators import windows

T0 = 1704067200000


def _pick(names: list[str], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))


def events(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.where(F.col("event_type").isin(*kinds)) if kinds else e
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select("event_id", "event_type", "value", ms.alias("ts_ingest_ms"), (ms - (F.col("event_id") * 31) % 250).alias("ts_exchange_ms"), _pick(["BINANCE", "BYBIT", "COINBASE", "KRAKEN"], F.col("user_id") % 4).alias("venue"), _pick(["BTCUSDT", "ETHUSDT", "SOLUSDT"], F.col("event_id") % 3).alias("instrument"), F.lit("SPOT").alias("market_type"))


#: Length of the stretches of time that numbers are given out in.
SLICE_MS = 3_600_000


def numbered(df: DataFrame) -> DataFrame:
    """seq: 1, 2, .. in each series by time and event_id."""
    return windows.numbered(df, ["venue", "instrument"], F.expr(f"ts_ingest_ms div {SLICE_MS}"), ["ts_ingest_ms", "event_id"])


_size = lambda: ((F.col("event_id") * 37) % 500 + 1) / 100.0
_side = lambda: F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell")


def trades(spark: SparkSession, sf_dir: str, number: bool = True) -> DataFrame:
    """Without numbers seq is time and event_id together, which order a series as well and cost no shuffle."""
    e = events(spark, sf_dir).withColumns({"price": F.lit(100.0) + F.col("value"), "size": _size(), "side": _side(), "trade_id": F.col("event_id").cast("string")})
    e = numbered(e) if number else e.withColumn("seq", F.struct("ts_ingest_ms", "event_id"))
    return e.drop("event_type", "value")


def dense(spark: SparkSession, sf_dir: str, number: bool = True) -> DataFrame:
    """The trades of 30 days within one hour."""
    return trades(spark, sf_dir, number).withColumn("ts_ingest_ms", F.expr(f"{T0} + (ts_ingest_ms - {T0}) div 720"))


def mark_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir, "view")
    return numbered(e.withColumns({"mark_price": F.lit(100.0) + F.col("value"), "funding_rate": ((F.col("event_id") * 13) % 201 - 100) / 1e6}))


def liquidations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(events(spark, sf_dir, "error").withColumns({"price": F.lit(100.0) + F.col("value"), "size": _size(), "side": _side()}))


def open_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(events(spark, sf_dir, "signup").withColumn("open_interest", F.lit(1000.0) + F.col("value") * 10))


def book_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each dense trade, bids and asks as arrays of (price, size), best first."""
    d = dense(spark, sf_dir)
    d = d.withColumns({"n": F.expr("5 + (event_id div 3) % 8"), "tick": F.when(F.col("event_id") % 97 == 0, 5.0).otherwise(0.5), "much": F.when(F.expr("(event_id div 200) % 2") == 0, 4.0).otherwise(1.0)})

    def level(sign: int, times: Column):
        return lambda k: F.struct((F.col("price") + sign * k * F.col("tick")).alias("price"), ((((F.col("event_id") * 17 + k * 29) % 100) + 1) / 10.0 * times).alias("size"))

    ks = F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))
    return d.select("venue", "instrument", "market_type", "event_id", "seq", "ts_ingest_ms", F.transform(ks, level(-1, F.col("much"))).alias("bids"), F.transform(ks, level(1, F.lit(1.0))).alias("asks"))


def book_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level changes in long form: side, price, size (0 deletes), is_snapshot; a message changes a price once."""
    t = trades(spark, sf_dir).withColumn("is_snapshot", F.col("event_id") % 50 == 0).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(4))))
    gone = ~F.col("is_snapshot") & ((F.col("event_id") + F.col("k")) % 7 == 0)
    size = F.when(gone, 0.0).otherwise((((F.col("event_id") * 17 + F.col("k") * 29) % 100) + 1) / 10.0)
    bid, ask = 100 + (F.col("event_id") * 7 + F.col("k") * 3) % 40, 141 + (F.col("event_id") * 11 + F.col("k") * 5) % 40
    t = t.withColumn("level", F.explode(F.array(F.struct(F.lit("bid").alias("side"), bid.cast("double").alias("price")), F.struct(F.lit("ask").alias("side"), ask.cast("double").alias("price")))))
    flat = t.select("venue", "instrument", "seq", "ts_ingest_ms", "is_snapshot", "level.side", "level.price", size.alias("size"))
    return flat.groupBy("venue", "instrument", "seq", "ts_ingest_ms", "is_snapshot", "side", "price").agg(F.max("size").alias("size"))


def trades_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ts = F.unix_millis(F.col("l_shipdate").cast("timestamp")) + (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 86400000
    t = l.select(_pick(["BINANCE", "BYBIT", "COINBASE", "KRAKEN"], F.col("l_suppkey") % 4).alias("venue"), _pick(["BTCUSDT", "ETHUSDT", "SOLUSDT"], F.col("l_partkey") % 3).alias("instrument"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"), F.when(F.col("l_linenumber") % 2 == 0, "buy").otherwise("sell").alias("side"), ts.alias("ts_ingest_ms"), "l_orderkey", "l_linenumber", "l_partkey")
    return t.withColumn("seq", F.struct("ts_ingest_ms", "l_orderkey", "l_linenumber", "l_partkey"))


def positions(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(*keep, (F.col("o_custkey") % 10).alias("account"), _pick(["BINANCE", "BYBIT", "COINBASE", "KRAKEN"], F.col("o_orderkey") % 4).alias("venue"), _pick(["BTCUSDT", "ETHUSDT", "SOLUSDT"], F.col("o_custkey") % 3).alias("symbol"), F.when(F.col("o_orderkey") % 2 == 0, "long").otherwise("short").alias("side"), (1.0 + F.col("o_orderkey") % 7).alias("quantity"), F.col("o_totalprice").alias("notional"))
