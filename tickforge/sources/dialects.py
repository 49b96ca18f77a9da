"""Raw venue messages to canonical trades, books, mark prices and liquidations.

Input: venue, message (JSON text) and received_ms, from a batch or a stream. A message is parsed once, and the input is read once for all
venues: each venue has an expression that makes an array of entries from a message. What isn't of the asked kind (control messages, other
channels, text that doesn't parse) gives none. Every entry of a message counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.functions.columns import instrument_name, parse_ms, side_name

_RECEIVED = "received_ms"


def _read(raw: DataFrame, entries: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """A row for each entry. Messages are maps, as field names may differ in case alone; nested values stay JSON text."""
    known = raw.withColumn("venue", F.upper(F.trim("venue"))).where(F.col("venue").isin(*entries))
    # explode() of a single element: a filter on the parsed message would otherwise parse it a second time
    m = known.select("venue", _RECEIVED, F.explode(F.array(F.from_json("message", "map<string,string>"))).alias("m")).where(F.col("m").isNotNull())
    all_entries = None
    for venue, make in entries.items():
        mine = F.col("venue") == venue
        all_entries = F.when(mine, make(F.col("m"))) if all_entries is None else all_entries.when(mine, make(F.col("m")))
    return m.select("venue", F.explode(all_entries).alias("x")).select("venue", "x.*")


def _if(condition: Column, entries: Column) -> Column:
    return F.when(condition, entries)


def _maps(text: Column) -> Column:
    return F.from_json(text, "array<map<string,string>>")


def _inner(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def _number(x: Column) -> Column:
    return x.try_cast("double")


def _long(x: Column) -> Column:
    return x.try_cast("long")


def _text(*columns: Column) -> Column:
    """The first of these that isn't blank."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in columns))


def _or_received(*columns: Column) -> Column:
    """The first of these times in ms that is positive, else the receive time."""
    return F.coalesce(*(F.when(_long(c) > 0, _long(c)) for c in columns), F.col(_RECEIVED))


def _time(*columns: Column) -> Column:
    return parse_ms(F.coalesce(_text(*columns), F.lit("")), F.col(_RECEIVED))


def _bitcoin(symbol: Column) -> Column:
    return F.replace(F.upper(F.trim(symbol)), F.lit("XBT"), F.lit("BTC"))


def _future(symbol: Column) -> Column:
    return _bitcoin(F.regexp_replace(F.upper(F.trim(symbol)), "^P[IF]_|^FI_", ""))


def _dollars(coin: Column) -> Column:
    return F.concat(F.trim(coin), F.lit("USD"))


def trades(raw: DataFrame) -> DataFrame:
    """venue, instrument, trade_id, price, size, side, ts_exchange_ms; those without a positive price and size, a side or an id are dropped."""

    def row(symbol: Column, id: Column, price: Column, size: Column, side: Column, ms: Column) -> Column:
        return F.struct(instrument_name(symbol).alias("instrument"), id.alias("trade_id"), _number(price).alias("price"), _number(size).alias("size"), side.alias("side"), ms.alias("ts_exchange_ms"))

    def binance(m: Column) -> Column:
        return _if(m["e"] == "aggTrade", F.array(row(m["s"], m["a"], m["p"], m["q"], F.when(m["m"] == "true", "sell").otherwise("buy"), _or_received(m["T"], m["E"]))))

    def bybit(m: Column) -> Column:
        return _if(m["topic"].startswith("publicTrade."), F.transform(_maps(m["data"]), lambda x: row(x["s"], x["i"], x["p"], x["v"], side_name(x["S"]), _or_received(x["T"]))))

    def coinbase(m: Column) -> Column:
        return _if(m["type"].isin("match", "last_match"), F.array(row(m["product_id"], m["trade_id"], m["price"], m["size"], side_name(m["side"]), _time(m["time"]))))

    def hyperliquid(m: Column) -> Column:
        own = lambda x: F.coalesce(F.when(~F.trim(x["hash"]).rlike("^(0x)?0*$"), F.trim(x["hash"])), F.when(_long(x["tid"]) != 0, x["tid"]))
        return _if(m["channel"] == "trades", F.transform(_maps(m["data"]), lambda x: row(_dollars(x["coin"]), own(x), x["px"], x["sz"], side_name(x["side"]), _or_received(x["time"]))))

    def kraken(m: Column) -> Column:
        def entry(symbol: Column, x: Column) -> Column:
            ms = _time(x["timestamp"], x["time_in"])
            return row(_bitcoin(symbol), F.coalesce(_text(x["trade_id"], x["id"]), ms.cast("string")), x["price"], _text(x["qty"], x["size"]), side_name(x["side"]), ms)

        return _if(m["channel"] == "trade", F.flatten(F.transform(_maps(m["data"]), lambda d: F.transform(_maps(d["trades"]), lambda x: entry(d["symbol"], x)))))

    def futures(m: Column) -> Column:
        def entry(x: Column) -> Column:
            ms = _time(x["time"], x["timestamp"])
            return row(_future(m["product_id"]), F.coalesce(_text(x["uid"], x["trade_id"]), ms.cast("string")), x["price"], _text(x["qty"], x["size"]), side_name(x["side"]), ms)

        several = _maps(m["trades"])
        return _if(m["feed"].isin("trade", "trade_snapshot"), F.transform(F.when(F.size(several) > 0, several).otherwise(F.array(m)), entry))

    out = _read(raw, {"BINANCE": binance, "BYBIT": bybit, "COINBASE": coinbase, "HYPERLIQUID": hyperliquid, "KRAKEN": kraken, "KRAKENF": futures})
    good = "price > 0 and size > 0 and side is not null and coalesce(trade_id, '') <> '' and not isnan(price) and not isnan(size) and price < double('infinity') and size < double('infinity')"
    return out.where(good)


def _valid(levels: Column) -> Column:
    """Levels whose price and size parse; no array is an empty one."""
    return F.coalesce(F.filter(levels, lambda x: (x["price"] > 0) & (x["size"] >= 0)), F.array().cast("array<struct<price: double, size: double>>"))


def _tuples(levels: Column) -> Column:
    """Levels that are arrays of price and size."""
    return _valid(F.transform(levels, lambda x: F.struct(_number(F.get(x, F.lit(0))).alias("price"), _number(F.get(x, F.lit(1))).alias("size"))))


def _pairs(text: Column) -> Column:
    return _tuples(F.from_json(text, "array<array<string>>"))


def _named(text: Column, price: str, *sizes: str) -> Column:
    """Levels that are maps with these names for price and size."""
    return _valid(F.transform(_maps(text), lambda x: F.struct(_number(x[price]).alias("price"), _number(F.coalesce(*(x[s] for s in sizes))).alias("size"))))


def unswapped(books: DataFrame) -> DataFrame:
    """Sides exchanged where the best bid isn't below the best ask and exchanging them mends it."""
    best = lambda c, f: f(F.transform(c, lambda x: x["price"]))
    crossed = best(F.col("bids"), F.array_max) >= best(F.col("asks"), F.array_min)
    mends = best(F.col("asks"), F.array_max) < best(F.col("bids"), F.array_min)
    b = books.withColumn("_swap", F.coalesce(crossed & mends, F.lit(False)))
    return b.withColumns({"bids": F.when(F.col("_swap"), F.col("asks")).otherwise(F.col("bids")), "asks": F.when(F.col("_swap"), F.col("bids")).otherwise(F.col("asks"))}).drop("_swap")


def books(raw: DataFrame) -> DataFrame:
    """venue, instrument, bids and asks (arrays of price and size), first_id, final_id, prev_final, is_snapshot, ts_exchange_ms; sides that came exchanged are mended."""
    none = F.lit(None).cast("string")

    def row(symbol: Column, bids: Column, asks: Column, first: Column, final: Column, before: Column, snapshot: Column, ms: Column) -> Column:
        return F.struct(instrument_name(symbol).alias("instrument"), bids.alias("bids"), asks.alias("asks"), _long(first).alias("first_id"), _long(final).alias("final_id"), _long(before).alias("prev_final"), F.coalesce(snapshot, F.lit(False)).alias("is_snapshot"), ms.alias("ts_exchange_ms"))

    def binance(m: Column) -> Column:
        return _if(m["e"] == "depthUpdate", F.array(row(m["s"], _pairs(m["b"]), _pairs(m["a"]), m["U"], m["u"], m["pu"], F.lit(False), _or_received(m["E"]))))

    def bybit(m: Column) -> Column:
        d = _inner(m["data"])
        return _if(m["topic"].startswith("orderbook."), F.array(row(d["s"], _pairs(d["b"]), _pairs(d["a"]), d["u"], d["u"], d["pu"], m["type"] == "snapshot", _or_received(d["cts"], m["ts"]))))

    def coinbase(m: Column) -> Column:
        changes, snap = F.from_json(m["changes"], "array<array<string>>"), m["type"] == "snapshot"
        of = lambda *names: _tuples(F.transform(F.filter(changes, lambda x: F.lower(F.get(x, F.lit(0))).isin(*names)), lambda x: F.slice(x, 2, 2)))
        bids, asks = F.when(snap, _pairs(m["bids"])).otherwise(of("buy", "bid")), F.when(snap, _pairs(m["asks"])).otherwise(of("sell", "ask", "offer"))
        return _if(m["type"].isin("snapshot", "l2update"), F.array(row(m["product_id"], bids, asks, m["sequence"], m["sequence"], none, snap, _time(m["time"]))))

    def hyperliquid(m: Column) -> Column:
        d = _inner(m["data"])
        side = lambda k: _named(F.get(F.from_json(d["levels"], "array<string>"), F.lit(k)), "px", "sz")
        return _if(m["channel"] == "l2Book", F.array(row(_dollars(d["coin"]), side(0), side(1), none, d["time"], none, F.lit(True), _or_received(d["time"]))))

    def kraken(m: Column) -> Column:
        side = lambda text: _named(text, "price", "qty", "size")
        return _if(m["channel"] == "book", F.transform(_maps(m["data"]), lambda d: row(_bitcoin(d["symbol"]), side(d["bids"]), side(d["asks"]), d["sequence"], d["sequence"], none, m["type"] == "snapshot", _time(d["timestamp"]))))

    def futures(m: Column) -> Column:
        return _if(m["feed"].isin("book", "book_snapshot"), F.array(row(_future(m["product_id"]), _pairs(m["bids"]), _pairs(m["asks"]), m["seq"], m["seq"], none, m["feed"] == "book_snapshot", _time(m["time"], m["timestamp"]))))

    return unswapped(_read(raw, {"BINANCE": binance, "BYBIT": bybit, "COINBASE": coinbase, "HYPERLIQUID": hyperliquid, "KRAKEN": kraken, "KRAKENF": futures}))


def mark_prices(raw: DataFrame) -> DataFrame:
    """venue, instrument, mark_price, index_price, funding_rate, ts_exchange_ms; without a mark price the last price stands for it. Only positive ones count."""
    none = F.lit(None).cast("string")

    def row(symbol: Column, mark: Column, index: Column, funding: Column, ms: Column) -> Column:
        return F.struct(instrument_name(symbol).alias("instrument"), _number(mark).alias("mark_price"), _number(index).alias("index_price"), _number(funding).alias("funding_rate"), ms.alias("ts_exchange_ms"))

    def bybit(m: Column) -> Column:
        d = _inner(m["data"])
        return _if(m["topic"].startswith("tickers."), F.array(row(d["symbol"], d["markPrice"], d["indexPrice"], d["fundingRate"], _or_received(m["ts"]))))

    def ticker(x: Column, symbol: Column, ms: Column) -> Column:
        return row(symbol, _text(x["mark_price"], x["last"]), x["index_price"], x["funding_rate"], ms)

    entries = {
        "BINANCE": lambda m: _if(m["e"] == "markPriceUpdate", F.array(row(m["s"], m["p"], m["i"], m["r"], _or_received(m["E"])))),
        "BYBIT": bybit,
        "COINBASE": lambda m: _if(m["type"] == "ticker", F.array(row(m["product_id"], m["price"], none, none, _time(m["time"])))),
        "KRAKEN": lambda m: _if(m["channel"] == "ticker", F.transform(_maps(m["data"]), lambda d: ticker(d, _bitcoin(d["symbol"]), _time(d["timestamp"])))),
        "KRAKENF": lambda m: _if(m["feed"] == "ticker", F.array(ticker(m, _future(m["product_id"]), _time(m["time"], m["timestamp"])))),
    }
    return _read(raw, entries).where("mark_price > 0 and not isnan(mark_price) and mark_price < double('infinity')")


def liquidations(raw: DataFrame) -> DataFrame:
    """venue, instrument, side, price, size, ts_exchange_ms of forced orders with a side and a positive price and size."""

    def row(x: Column, size: str) -> Column:
        return F.struct(instrument_name(x["s"]).alias("instrument"), side_name(x["S"]).alias("side"), _number(x["p"]).alias("price"), _number(x[size]).alias("size"), _or_received(x["T"]).alias("ts_exchange_ms"))

    entries = {
        "BINANCE": lambda m: _if(m["e"] == "forceOrder", F.array(row(_inner(m["o"]), "q"))),
        "BYBIT": lambda m: _if(m["topic"].rlike("^(liquidation|allLiquidation)[.]"), F.transform(_maps(m["data"]), lambda x: row(x, "v"))),
    }
    return _read(raw, entries).where("price > 0 and size > 0 and side is not null and price < double('infinity') and size < double('infinity')")
