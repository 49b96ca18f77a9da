"""Queries over venue messages other than trades, over evidence fields and over the oldest events of a subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.functions.columns import fragments, metric_list, subject
from tickforge.plans.queries import BOUNDARY, K, query, rounded
from tickforge.sources import dialects, readers, ticks


def _json(**fields: Column) -> Column:
    return F.struct(*(c.alias(k) for k, c in fields.items()))


def _messages(t: DataFrame, forms: list[tuple[str, Column]], at: Column) -> DataFrame:
    """Each row as a message of the venue that `at` gives, a number from 0."""
    venue, message = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (name, form) in enumerate(forms):
        venue, message = F.when(at == k, name).otherwise(venue), F.when(at == k, F.to_json(form)).otherwise(message)
    return t.select(venue.alias("venue"), message.alias("message"), F.col("ts_ingest_ms").alias("received_ms"))


def _trades(s, d) -> DataFrame:
    """The trades with what the venues' forms are made of."""
    coin = F.regexp_replace("instrument", "USDT$", "")
    xbt = F.replace(coin, F.lit("BTC"), F.lit("XBT"))
    iso = F.date_format(F.timestamp_millis("ts_exchange_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    names = {"coin": coin, "dollars": F.concat(coin, F.lit("-USD")), "slashed": F.concat(xbt, F.lit("/USD")), "future": F.concat(F.lit("PI_"), xbt, F.lit("USD")), "iso": iso}
    return ticks.trades(s, d, number=False).withColumns(names)


@query
def venue_books(s, d):
    """Every level of book messages of six venues; those of every 31st message have come with their sides exchanged."""
    col, lit = F.col, F.lit
    t = _trades(s, d)
    price = lambda sign, k: (col("price") + sign * k).cast("string")
    size = lambda k: F.when((lit(k) == 2) & (col("event_id") % 7 == 0), 0.0).otherwise(col("size") * k).cast("string")
    pairs = lambda sign: F.array(*(F.array(price(sign, k), size(k)) for k in (1, 2)))
    swapped = col("event_id") % 31 == 0
    t = t.withColumns({"b": F.when(swapped, pairs(1)).otherwise(pairs(-1)), "a": F.when(swapped, pairs(-1)).otherwise(pairs(1)), "snap": col("event_id") % 5 == 0})
    named = lambda c, p, q: F.transform(c, lambda x: _json(**{p: x[0], q: x[1]}))
    changes = F.concat(F.transform("b", lambda x: F.array(lit("buy"), x[0], x[1])), F.transform("a", lambda x: F.array(lit("sell"), x[0], x[1])))
    kind = F.when(col("snap"), "snapshot")
    forms = [
        ("BINANCE", _json(e=lit("depthUpdate"), E=col("ts_exchange_ms"), s=col("instrument"), U=col("event_id") - 3, u=col("event_id"), pu=col("event_id") - 4, b=col("b"), a=col("a"))),
        ("BYBIT", _json(topic=F.concat(lit("orderbook.50."), "instrument"), type=kind.otherwise("delta"), ts=col("ts_exchange_ms"), data=_json(s=col("instrument"), b=col("b"), a=col("a"), u=col("event_id")))),
        ("COINBASE", _json(type=kind.otherwise("l2update"), product_id=col("dollars"), sequence=col("event_id"), time=col("iso"), bids=F.when(col("snap"), col("b")), asks=F.when(col("snap"), col("a")), changes=F.when(~col("snap"), changes))),
        ("HYPERLIQUID", _json(channel=lit("l2Book"), data=_json(coin=col("coin"), time=col("ts_exchange_ms"), levels=F.array(named("b", "px", "sz"), named("a", "px", "sz"))))),
        ("KRAKEN", _json(channel=lit("book"), type=kind.otherwise("update"), data=F.array(_json(symbol=col("slashed"), bids=named("b", "price", "qty"), asks=named("a", "price", "qty"), sequence=col("event_id"), timestamp=col("iso"))))),
        ("KRAKENF", _json(feed=F.when(col("snap"), "book_snapshot").otherwise("book"), product_id=col("future"), seq=col("event_id"), time=col("ts_exchange_ms"), bids=col("b"), asks=col("a"))),
    ]
    b = dialects.books(_messages(t, forms, col("event_id") % 6))
    side = lambda c: F.transform(c, lambda x: F.struct(F.lit(c[:3]).alias("side"), x["price"].alias("price"), x["size"].alias("size")))
    levels = F.concat(side("bids"), side("asks"))
    return rounded(b.select(*K, "first_id", "final_id", "prev_final", "is_snapshot", "ts_exchange_ms", F.explode(levels).alias("x")).select(*K, "first_id", "final_id", "prev_final", "is_snapshot", "ts_exchange_ms", "x.*"))


@query
def venue_marks(s, d):
    """Mark prices of five venues; some messages bring the last price alone, and every 101st a price that isn't one."""
    col, lit, none = F.col, F.lit, F.lit(None).cast("string")
    mark = F.when(col("event_id") % 101 == 0, "NaN").when(col("event_id") % 103 == 0, "-1").otherwise(col("price").cast("string"))
    funding = (((col("event_id") * 13) % 201 - 100) / 1e6).cast("string")
    t = _trades(s, d).withColumns({"m": mark, "i": (col("price") + 0.5).cast("string"), "r": funding, "short": F.expr("(event_id div 5) % 2 = 0")})
    of = lambda **x: _json(mark_price=F.when(~col("short"), col("m")), last=F.when(col("short"), col("m")), index_price=col("i"), funding_rate=col("r"), **x)
    forms = [
        ("BINANCE", _json(e=lit("markPriceUpdate"), E=col("ts_exchange_ms"), s=col("instrument"), p=col("m"), i=col("i"), r=col("r"))),
        ("BYBIT", _json(topic=F.concat(lit("tickers."), "instrument"), ts=F.when(~col("short"), col("ts_exchange_ms")), data=_json(symbol=col("instrument"), markPrice=col("m"), indexPrice=col("i"), fundingRate=col("r")))),
        ("COINBASE", _json(type=lit("ticker"), product_id=col("dollars"), price=col("m"), time=col("iso"))),
        ("KRAKEN", _json(channel=lit("ticker"), data=F.array(of(symbol=col("slashed"), timestamp=F.when(~col("short"), col("iso")).otherwise(none))))),
        ("KRAKENF", of(feed=lit("ticker"), product_id=col("future"), time=col("ts_exchange_ms").cast("string"))),
    ]
    return rounded(dialects.mark_prices(_messages(t, forms, col("event_id") % 5)), 9)


@query
def venue_liquidations(s, d):
    """Forced orders of two venues, one of which sends several in a message, here the second without a side in every third."""
    col, lit = F.col, F.lit
    p, q = col("price").cast("string"), col("size").cast("string")
    shouted = F.upper("side")
    again = F.when(col("event_id") % 3 == 0, "").otherwise(F.when(col("side") == "buy", "Sell").otherwise("Buy"))
    entry = lambda side, size: _json(T=col("ts_exchange_ms"), s=col("instrument"), S=side, v=size, p=p)
    forms = [
        ("BINANCE", _json(e=lit("forceOrder"), o=_json(s=col("instrument"), S=shouted, p=p, q=F.when(col("event_id") % 107 == 0, "0").otherwise(q), T=col("ts_exchange_ms")))),
        ("BYBIT", _json(topic=F.concat(lit("allLiquidation."), "instrument"), data=F.array(entry(F.initcap("side"), q), entry(again, (col("size") * 2).cast("string"))))),
    ]
    return rounded(dialects.liquidations(_messages(_trades(s, d), forms, F.expr("(event_id div 2) % 2"))))


@query
def event_range_oldest(s, d):
    """The oldest five events of each subject from a bound on: the feature is that cut."""
    t = ticks.trades(s, d).withColumn("subject", subject(F.lit("trade"), F.col("venue"), F.col("instrument"), F.lit("raw")))
    return readers.read_events(t, BOUNDARY, 0, 5, "first").select("subject", "seq", "trade_id", "ts_ingest_ms")


@query
def evidence_metrics(s, d):
    """Metrics of each trade as evidence holds them: the finite ones by name, eight at most."""
    t = ticks.trades(s, d, number=False)
    bad = F.when(F.col("event_id") % 3 == 0, float("nan")).when(F.col("event_id") % 3 == 1, float("inf"))
    values = {"size": F.col("size"), "price": F.col("price"), "bad": bad, **{f"m{k}": F.when(F.col("event_id") % (k + 2) != 0, F.col("size") * k) for k in range(8)}}
    m = t.select("event_id", F.posexplode(metric_list(F.create_map(*(x for name, c in values.items() for x in (F.lit(name), c))))).alias("at", "x"))
    return rounded(m.select("event_id", F.col("at").cast("long").alias("at"), F.col("x.key").alias("name"), F.col("x.value").alias("value")))


@query
def evidence_fragments(s, d):
    """Words of explanation of each trade: trimmed, blank ones left out, four at most of 120 characters at most."""
    t = ticks.trades(s, d, number=False)
    texts = F.array(F.concat(F.lit("  "), "side", F.lit(" ")), F.when(F.col("event_id") % 2 == 0, "   ").otherwise("odd"), F.repeat("instrument", F.lit(20)), F.lit(""), F.concat(F.lit("at "), "venue"), F.col("trade_id"))
    return t.select("event_id", F.posexplode(fragments(texts)).alias("at", "fragment")).select("event_id", F.col("at").cast("long").alias("at"), "fragment")
