"""Order books and cross-venue views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.columns import fixed, spread_bps_or_zero, unfixed

KEYS = ["venue", "instrument"]


def book_as_of(deltas: DataFrame, seq: int | None = None, ts_ms: int | None = None) -> DataFrame:
    """Levels after all messages, or those up to seq or ts_ms: a snapshot resets the book, size 0 deletes, of a level the last message counts."""
    d = deltas if seq is None else deltas.where(F.col("seq") <= seq)
    d = d if ts_ms is None else d.where(F.col("ts_ingest_ms") <= ts_ms)
    last = d.where("is_snapshot").groupBy(*KEYS).agg(F.max("seq").alias("from_seq"))
    d = d.join(last, KEYS, "left").where("from_seq is null or seq >= from_seq")
    out = d.groupBy(*KEYS, "side", "price").agg(F.max_by("size", "seq").alias("size"), F.max("seq").alias("last_seq"))
    return out.where("size > 0")


def grouped(levels: DataFrame, step: float, most: int = 50) -> DataFrame:
    """Levels in price groups with counts and the running depth from the best group outward."""
    g = levels.withColumn("group_price", F.floor(F.col("price") / step) * step).groupBy(*KEYS, "side", "group_price").agg(unfixed(F.sum(fixed(F.col("size")))).alias("size"), F.count("*").alias("levels"))
    order = Window.partitionBy(*KEYS, "side").orderBy(F.when(F.col("side") == "bid", -F.col("group_price")).otherwise(F.col("group_price")))
    g = g.withColumns({"rank": F.row_number().over(order).cast("long"), "cumulative": unfixed(F.sum(fixed(F.col("size"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))})
    return g.where(F.col("rank") <= most)


def latest_prices(trades: DataFrame, venues: list[str], slice_ms: int = 3_600_000, unique: bool = False) -> DataFrame:
    """For each trade the latest trade of every venue in its instrument; kept where the trade is its venue's newest and two venues are known.

    Adds lowest and highest price with their venues (lowest name on ties), spread, middle and spread in basis points. Of equal numbers the
    other fields tell which trade is newer; where numbers are unique within a venue and instrument (unique), they are left out.
    Time is cut into slices: each slice's last trade of a venue is carried on to the slices after it, over a small table, and every slice is
    then ordered on its own. A trade is its venue's newest if it is the greatest up to itself, and wasn't there before.
    """
    key = ["instrument", "market_type", "_slice"]
    of = lambda v, c: F.max(F.when(F.col("venue") == v, F.col(c)))
    own = F.struct("seq", "price") if unique else F.struct("seq", "ts_ingest_ms", "ts_exchange_ms", "trade_id", "side", "price", "size")
    out = trades.select("instrument", "market_type", "venue", "trade_id", "ts_ingest_ms", "event_id", own.alias("own"), F.expr(f"ts_ingest_ms div {slice_ms}").alias("_slice"))
    earlier = Window.partitionBy("instrument", "market_type").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    lasts = out.groupBy(*key).agg(*(of(v, "own").alias(f"_last_{v}") for v in venues))
    carried = lasts.select(*key, *(F.max(f"_last_{v}").over(earlier).alias(f"_from_{v}") for v in venues))
    order = Window.partitionBy(*key).orderBy("ts_ingest_ms", "event_id")
    now, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    of_own = lambda name: F.coalesce(*(F.when(F.col("venue") == v, F.col(f"{name}_{v}")) for v in venues))
    added = {f"_{v}": of(v, "own").over(now) for v in venues} | ({} if unique else {"older": F.max("own").over(before.partitionBy(*key, "venue"))})
    out = out.withColumns(added).join(carried, key)
    newest = F.col("own") == F.greatest(of_own("_from"), of_own(""))
    if not unique:
        newest = F.greatest("older", of_own("_from")).isNull() | (F.col("own") > F.greatest("older", of_own("_from")))
    out = out.where(F.coalesce(newest, F.lit(False))).withColumns({f"_{v}": F.greatest(F.col(f"_from_{v}"), F.col(f"_{v}")) for v in venues})
    # by plain comparisons, as conditions on what comes out are evaluated with all that it is made of, many times over
    known = {v: F.when(F.col(f"_{v}").isNotNull(), F.struct(F.col(f"_{v}.price").alias("price"), F.lit(v).alias("venue"))) for v in sorted(venues)}
    low, top = F.least(*known.values()), F.greatest(*known.values())["price"]
    high = F.coalesce(*(F.when(x["price"] == top, x["venue"]) for x in known.values()))
    count = sum((F.col(f"_{v}").isNotNull().cast("long") for v in venues), F.lit(0).cast("long"))
    out = out.withColumns({"venues": count, "min_price": low["price"], "min_venue": low["venue"], "max_price": top, "max_venue": high}).where("venues >= 2")
    out = out.withColumns({"spread_abs": F.round(F.col("max_price") - F.col("min_price"), 8), "mid": F.round((F.col("max_price") + F.col("min_price")) / 2, 8)})
    bps = F.when(F.col("mid") > 0, (F.col("max_price") - F.col("min_price")) / F.col("mid") * 10_000).otherwise(0.0)
    return out.withColumn("spread_bps", F.rint(bps * 10_000) / 10_000).select("instrument", "trade_id", "venue", "ts_ingest_ms", "venues", "min_price", "min_venue", "max_price", "max_venue", "spread_abs", "mid", "spread_bps")


def latest_books(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy(*KEYS).agg(F.max_by(F.struct("ts_ingest_ms", "seq", "bids", "asks"), F.struct("ts_ingest_ms", "seq")).alias("b")).select(*KEYS, "b.*")


def cross_venue(snapshots: DataFrame, stale_ms: int = 30_000) -> DataFrame:
    """Best bid and ask over the venues' latest books that aren't stale, global spread and divergence of venue spreads."""
    b = latest_books(snapshots).withColumns({"bid": F.expr("bids[0].price"), "ask": F.expr("asks[0].price")})
    now = F.max("ts_ingest_ms").over(Window.partitionBy("instrument"))
    b = b.withColumn("now", now).where((F.col("now") - F.col("ts_ingest_ms") <= stale_ms) & (F.col("bid") > 0) & (F.col("ask") > 0))
    b = b.withColumn("bps", spread_bps_or_zero(F.col("bid"), F.col("ask")))
    out = b.groupBy("instrument").agg(F.count("*").alias("venues"), F.max("bid").alias("best_bid"), F.min("ask").alias("best_ask"), F.min_by("venue", F.struct(-F.col("bid"), F.col("venue"))).alias("bid_venue"), F.min_by("venue", F.struct("ask", "venue")).alias("ask_venue"), (F.max("bps") - F.min("bps")).alias("divergence_bps"))
    return out.withColumn("spread_bps", spread_bps_or_zero(F.col("best_bid"), F.col("best_ask")))


def fused_depth(snapshots: DataFrame, stale_ms: int = 600_000, most: int = 50) -> DataFrame:
    """Levels of all fresh venues summed by price, at most `most` a side, best first, with the venues at each."""
    b = latest_books(snapshots).withColumn("now", F.max("ts_ingest_ms").over(Window.partitionBy("instrument"))).where(F.col("now") - F.col("ts_ingest_ms") <= stale_ms)
    side = lambda c, s: b.select("instrument", "venue", F.lit(s).alias("side"), F.explode(c).alias("x"))
    u = side("bids", "bid").unionByName(side("asks", "ask")).select("instrument", "venue", "side", fixed(F.col("x.price")).alias("p"), fixed(F.col("x.size")).alias("q"))
    g = u.groupBy("instrument", "side", "p").agg(F.sum("q").alias("q"), F.array_join(F.array_sort(F.collect_set("venue")), ",").alias("venues"))
    rank = F.row_number().over(Window.partitionBy("instrument", "side").orderBy(F.when(F.col("side") == "bid", -F.col("p")).otherwise(F.col("p"))))
    return g.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).select("instrument", "side", "rank", unfixed(F.col("p")).alias("price"), unfixed(F.col("q")).alias("size"), "venues")


def capped(levels: DataFrame, most: int = 50) -> DataFrame:
    """A row for each book: its best `most` prices a side, the counts of all its levels, and the spread (-1 when one-sided)."""
    rank = F.row_number().over(Window.partitionBy(*KEYS, "side").orderBy(F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))))
    r = levels.withColumn("k", rank)
    on = lambda s: F.transform(F.array_sort(F.collect_list(F.when((F.col("side") == s) & (F.col("k") <= most), F.struct("k", "price", "size")))), lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size")))
    g = r.groupBy(*KEYS).agg(on("bid").alias("bids"), on("ask").alias("asks"), F.count_if(F.col("side") == "bid").alias("bid_levels"), F.count_if(F.col("side") == "ask").alias("ask_levels"))
    bid, ask = F.get("bids", F.lit(0))["price"], F.get("asks", F.lit(0))["price"]
    return g.withColumn("spread_bps", F.coalesce((ask - bid) / ((ask + bid) / 2) * 10_000, F.lit(-1.0)))


def capped_with_checksum(levels: DataFrame, most: int = 50) -> DataFrame:
    """capped, with a checksum of the whole book: CRC-32 of its levels as text (price:size in units of 1e-8), best first, bids before asks.

    A side's levels meet in one row, as its best ones do in capped; the levels of a book, not its messages, bound that row.
    """
    text = F.concat_ws(":", fixed(F.col("price")).cast("string"), fixed(F.col("size")).cast("string"))
    best = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    of = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct(best.alias("k"), text.alias("t"))))), lambda x: x["t"]), "|")
    sums = levels.groupBy(*KEYS).agg(F.concat(of("bid"), F.lit("#"), of("ask")).alias("_t")).select(*KEYS, F.crc32(F.col("_t").cast("binary")).alias("checksum"))
    return capped(levels, most).join(sums, KEYS)


def throttled(snapshots: DataFrame, ms: int) -> DataFrame:
    """The last snapshot of each book in every interval of ms."""
    last = snapshots.groupBy(*KEYS, (F.col("ts_ingest_ms") - F.pmod("ts_ingest_ms", F.lit(ms))).alias("interval_start")).agg(F.max_by(F.struct(*(c for c in snapshots.columns if c not in KEYS)), F.struct("ts_ingest_ms", "seq")).alias("s"))
    return last.select(*KEYS, "interval_start", "s.*")
