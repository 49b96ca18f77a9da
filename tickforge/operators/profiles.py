"""Price-bucket profiles: volume at price, heatmap, sessions, time-price opportunity, footprint, depth of market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.columns import TIMEFRAMES, fixed, imbalance, size_class, unfixed, window_start
from tickforge.operators.windows import rolling

KEYS = ["venue", "instrument"]


def bin_size(df: DataFrame, percent: float, tick: float, price: str = "price", out: str = "bin") -> DataFrame:
    """Adds the tick-aligned bucket width: the largest of 1, .5, .25, .2, .1, .05 of a power of ten up to price * percent / 100 that the tick divides.

    In steps, as one expression would be too long to compile.
    """
    df = df.withColumn("_n", F.col(price) * percent / 100)
    df = df.withColumn("_e", F.greatest(F.lit(-8.0), F.ceil(F.log10(F.col("_n")) - 1e-12).cast("double")))
    df = df.withColumn("_f", F.when(F.pow(F.lit(10.0), F.col("_e")) < F.col("_n"), F.pow(F.lit(10.0), F.col("_e") + 1)).otherwise(F.pow(F.lit(10.0), F.col("_e"))))
    steps = F.transform(F.array(*map(F.lit, (1.0, 0.5, 0.25, 0.2, 0.1, 0.05))), lambda s: s * F.col("_f"))
    fits = F.filter(steps, lambda c: (c <= F.col("_n")) & (F.abs(c / tick - F.round(c / tick)) < 1e-9))
    df = df.withColumn("_ok", fits)
    width = F.when(F.lit(tick) >= F.col("_n"), F.lit(tick)).otherwise(F.round(F.greatest(F.coalesce(F.get("_ok", F.lit(0)), F.col("_f") * 0.05), F.lit(1e-8)), 8))
    return df.withColumn(out, width).drop("_n", "_e", "_f", "_ok")


# The share of the price that a heatmap bucket takes, by timeframe; 2.5 per cent of a hundredth otherwise.
HEATMAP_FACTORS = {"1s": 0.001, "5s": 0.001, "10s": 0.001, "1m": 0.005, "5m": 0.005}


def heatmap_factor(timeframe: str) -> float:
    return HEATMAP_FACTORS.get(timeframe, 0.025)


def bucket(price: Column, step: Column) -> Column:
    return F.floor(price / step) * step


def volume_profile(trades: DataFrame, timeframe: str = "1h", percent: float = 1.0, tick: float = 0.01) -> DataFrame:
    """Volumes at price of each window: buckets (price_low, price_high) with buy, sell and total volume and sequence bounds."""
    t = bin_size(trades, percent, tick).withColumns({"window_start": window_start(F.col("ts_ingest_ms"), TIMEFRAMES[timeframe]), "q": fixed(F.col("size"))})
    low = F.round(bucket(F.col("price"), F.col("bin")), 8)
    t = t.withColumns({"price_low": low, "price_high": F.round(low + F.col("bin"), 8)})
    on = lambda s: unfixed(F.sum(F.when(F.col("side") == s, F.col("q")).otherwise(0)))
    return t.groupBy(*KEYS, "window_start", "price_low", "price_high").agg(on("buy").alias("buy_volume"), on("sell").alias("sell_volume"), unfixed(F.sum("q")).alias("total_volume"), F.min("seq").alias("seq_min"), F.max("seq").alias("seq_max"))


def point_of_control(profile: DataFrame, keys: list[str]) -> DataFrame:
    """The bucket with most volume (lowest price on ties), bounds and total of each profile."""
    return profile.groupBy(*keys).agg(F.max_by("price_low", F.struct("total_volume", -F.col("price_low"))).alias("poc"), F.min("price_low").alias("low"), F.max("price_high").alias("high"), unfixed(F.sum(fixed(F.col("total_volume")))).alias("volume"), F.count("*").alias("buckets"))


def compressed(profile: DataFrame, keys: list[str], ratio: float) -> DataFrame:
    """The share `ratio` of each profile's buckets, those with most volume."""
    by = Window.partitionBy(*keys)
    out = profile.withColumns({"k": F.row_number().over(by.orderBy(F.desc("total_volume"), "price_low")), "n": F.count("*").over(by)})
    return out.where(F.col("k") <= F.ceil(F.col("n") * ratio)).drop("k", "n")


def value_area_by_rank(profile: DataFrame, keys: list[str], share: float = 0.7) -> DataFrame:
    """Bounds of the largest buckets that reach the share of volume; equal volumes go by lower price."""
    by = Window.partitionBy(*keys)
    v = fixed(F.col("total_volume"))
    run = F.sum(v).over(by.orderBy(F.desc("total_volume"), "price_low").rowsBetween(Window.unboundedPreceding, -1))
    out = profile.withColumns({"before": F.coalesce(run, F.lit(0)), "all": F.sum(v).over(by)}).where(F.col("before") < F.col("all") * share)
    return out.groupBy(*keys).agg(F.min("price_low").alias("va_low"), F.max("price_high").alias("va_high"), F.count("*").alias("va_buckets"))


def value_area_outward(profile: DataFrame, keys: list[str], share: float = 0.7, most: int = 400) -> DataFrame:
    """Value area grown outward from the point of control, the lower side first on ties, over at most `most` lowest buckets."""
    by = Window.partitionBy(*keys).orderBy("price_low")
    kept = profile.withColumn("k", F.row_number().over(by)).where(F.col("k") <= most)
    rows = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("price_low", "price_high", fixed(F.col("total_volume")).alias("v")))).alias("b"))
    rows = rows.withColumns({"all": F.expr("aggregate(b, 0L, (a, x) -> a + x.v)"), "top": F.expr("aggregate(b, -1L, (a, x) -> greatest(a, x.v))")})
    rows = rows.withColumn("poc", F.expr("cast(array_position(transform(b, x -> x.v), top) - 1 as int)"))
    grown = F.expr(f"""aggregate(sequence(1, size(b)), named_struct('lo', poc, 'hi', poc, 'v', b[poc].v), (s, i) ->
      case when s.v >= all * {share} or (s.lo = 0 and s.hi = size(b) - 1) then s
           when s.hi = size(b) - 1 or (s.lo > 0 and get(b, s.lo - 1).v >= get(b, s.hi + 1).v) then named_struct('lo', s.lo - 1, 'hi', s.hi, 'v', s.v + get(b, s.lo - 1).v)
           else named_struct('lo', s.lo, 'hi', s.hi + 1, 'v', s.v + get(b, s.hi + 1).v) end)""")
    rows = rows.withColumn("s", grown)
    return rows.select(*keys, F.expr("b[poc].price_low").alias("poc"), F.expr("b[s.lo].price_low").alias("va_low"), F.expr("b[s.hi].price_high").alias("va_high"), unfixed(F.col("s.v")).alias("va_volume"))


def fused(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Profiles of venues merged by bucket."""
    total = lambda x: unfixed(F.sum(fixed(F.col(x)))).alias(x)
    return profile.groupBy(*keys, "price_low", "price_high").agg(total("buy_volume"), total("sell_volume"), total("total_volume"), F.countDistinct("venue").alias("venues"))


def heatmap(books: DataFrame, trades: DataFrame, timeframe: str, step: float, levels: int = 8) -> DataFrame:
    """Liquidity of the best levels and traded volume by price bucket and size class of each window."""
    ms = TIMEFRAMES[timeframe]
    side = lambda s: F.transform(F.slice(s, 1, levels), lambda x: F.struct(F.lit(s[:3]).alias("kind"), x["price"].alias("price"), x["size"].alias("size")))
    u = books.select(*KEYS, "ts_ingest_ms", "seq", F.explode(F.concat(side("bids"), side("asks"))).alias("x")).select(*KEYS, "ts_ingest_ms", "seq", "x.*")
    u = u.unionByName(trades.select(*KEYS, "ts_ingest_ms", "seq", F.lit("trade").alias("kind"), "price", "size"))
    u = u.withColumns({"window_start": window_start(F.col("ts_ingest_ms"), ms), "price_low": bucket(F.col("price"), F.lit(step)), "size_class": size_class(F.col("size")), "q": fixed(F.col("size"))})
    on = lambda s: unfixed(F.sum(F.when(F.col("kind") == s, F.col("q")).otherwise(0)))
    return u.groupBy(*KEYS, "window_start", "price_low", "size_class").agg(on("bid").alias("bid_liquidity"), on("ask").alias("ask_liquidity"), on("trade").alias("trade_volume"), F.count("*").alias("samples"), F.min("seq").alias("seq_min"), F.max("seq").alias("seq_max"))


def session_start(ts_ms: Column, zone: str = "UTC", open_minutes: int = 0) -> Column:
    """Start, in epoch ms, of the daily session that a time belongs to; before today's open it is yesterday's. Daylight saving counts."""
    local = F.from_utc_timestamp(F.timestamp_millis(ts_ms), zone)
    shifted = F.date_trunc("day", local - F.expr(f"interval {open_minutes} minutes"))
    return F.unix_millis(F.to_utc_timestamp(shifted + F.expr(f"interval {open_minutes} minutes"), zone))


def session_bounds(ts_ms: Column, duration_ms: int, zone: str | None = "UTC", open_minutes: int = 0) -> Column:
    """session_start, session_end (epoch ms) and is_closed of the session that a time belongs to.

    With a zone the session opens at that local time of day and lasts duration_ms: a time before today's open belongs to yesterday's session,
    one after today's close still to today's, which is then closed. A custom anchor (zone None) cuts all time from the epoch on into sessions
    of duration_ms, of which none is ever closed. Null and times not above 0 have no session.
    """
    start = ts_ms - F.pmod(ts_ms, F.lit(duration_ms)) if zone is None else session_start(ts_ms, zone, open_minutes)
    bounds = F.struct(start.alias("session_start"), (start + duration_ms).alias("session_end"), (ts_ms >= start + duration_ms).alias("is_closed"))
    return F.when(ts_ms > 0, bounds)


def session_profile(candles: DataFrame, step: float, zone: str = "UTC", open_minutes: int = 0) -> DataFrame:
    """Candle volume by bucket of (high + low + 2 close) / 4 of each session."""
    typical = (F.col("high") + F.col("low") + 2 * F.col("close")) / 4
    c = candles.withColumns({"session_start": session_start(F.col("window_start"), zone, open_minutes), "price_low": bucket(typical, F.lit(step))})
    return c.groupBy(*KEYS, "session_start", "price_low").agg(unfixed(F.sum(fixed(F.col("volume")))).alias("total_volume"), F.count("*").alias("candles")).withColumn("price_high", F.col("price_low") + step)


def time_price(candles: DataFrame, step: float, period_ms: int = 1_800_000) -> DataFrame:
    """Letters of the periods whose range touches each price level of a session; a flat candle marks nothing."""
    start = session_start(F.col("window_start"))
    c = candles.where("high > low").withColumn("session_start", start)
    letter = F.char(65 + F.least(F.lit(23), F.floor((F.col("window_start") - F.col("session_start")) / period_ms)))
    levels = F.sequence(F.floor(F.col("low") / step), F.ceil(F.col("high") / step) - 1)
    rows = c.select(*KEYS, "session_start", letter.alias("letter"), F.explode(levels).alias("level"))
    return rows.groupBy(*KEYS, "session_start", (F.col("level") * F.lit(step)).alias("price_low")).agg(F.array_join(F.array_sort(F.collect_set("letter")), "").alias("letters"), F.countDistinct("letter").alias("n_letters"))


def time_price_summary(candles: DataFrame, step: float, period_ms: int = 1_800_000) -> DataFrame:
    """Of each session: the level with most letters (the lowest on ties), the value area around it, the initial balance (range of the first two periods) and the range."""
    start = session_start(F.col("window_start"))
    c = candles.withColumns({"session_start": start, "period": F.floor((F.col("window_start") - start) / period_ms)})
    early = F.col("period") <= 1
    bounds = c.groupBy(*KEYS, "session_start").agg(F.max(F.when(early, F.col("high"))).alias("ib_high"), F.min(F.when(early, F.col("low"))).alias("ib_low"), F.max("high").alias("range_high"), F.min("low").alias("range_low"))
    levels = time_price(candles, step, period_ms).select(*KEYS, "session_start", "price_low", (F.col("price_low") + step).alias("price_high"), F.col("n_letters").cast("double").alias("total_volume"))
    return value_area_outward(levels, [*KEYS, "session_start"], most=1 << 30).drop("va_volume").join(bounds, [*KEYS, "session_start"])


def footprint(trades: DataFrame, timeframe: str, step: float) -> DataFrame:
    t = trades.withColumns({"window_start": window_start(F.col("ts_ingest_ms"), TIMEFRAMES[timeframe]), "price_low": bucket(F.col("price"), F.lit(step)), "q": fixed(F.col("size"))})
    on = lambda s: unfixed(F.sum(F.when(F.col("side") == s, F.col("q")).otherwise(0)))
    return t.groupBy(*KEYS, "window_start", "price_low").agg(on("buy").alias("buy_volume"), on("sell").alias("sell_volume"), F.count("*").alias("trade_count"))


def fills(trades: DataFrame, step: float) -> DataFrame:
    """Volumes by price group with average prices and imbalance."""
    t = trades.withColumns({"price_low": bucket(F.col("price"), F.lit(step)), "q": fixed(F.col("size")), "pq": fixed(F.col("price") * F.col("size")), "p": fixed(F.col("price"))})
    on = lambda s: unfixed(F.sum(F.when(F.col("side") == s, F.col("q")).otherwise(0)))
    out = t.groupBy(*KEYS, "price_low").agg(on("buy").alias("buy_volume"), on("sell").alias("sell_volume"), (F.sum("pq") / F.sum("q")).alias("vwap"), (unfixed(F.sum("p")) / F.count("*")).alias("twap"))
    return out.withColumn("imbalance", imbalance(F.col("buy_volume"), F.col("sell_volume")))


def fused_heatmap(cells: DataFrame) -> DataFrame:
    """Heatmap cells of all venues merged."""
    total = lambda x: unfixed(F.sum(fixed(F.col(x)))).alias(x)
    return cells.groupBy("instrument", "window_start", "price_low", "size_class").agg(total("bid_liquidity"), total("ask_liquidity"), total("trade_volume"), F.sum("samples").alias("samples"), F.countDistinct("venue").alias("venues"))


def fused_cells(cells: DataFrame, most: int = 1000) -> DataFrame:
    """Heatmap cells of all venues merged by price range and size class, with each venue's volume and share; the first `most` cells of a window.

    Cells are in order of low, high and size class. A cell's volume is its bid and ask liquidity and traded volume.
    """
    cells = cells.withColumns({"size_class": F.upper(F.trim("size_class")), "_v": fixed(F.col("bid_liquidity")) + fixed(F.col("ask_liquidity")) + fixed(F.col("trade_volume"))})
    key = ["instrument", "window_start", "price_low", "price_high", "size_class"]
    total = lambda x: F.sum(fixed(F.col(x))).alias(x)
    of_venue = cells.groupBy(*key, "venue").agg(total("bid_liquidity"), total("ask_liquidity"), total("trade_volume"), F.sum("samples").alias("samples"), F.sum("_v").alias("_v"))
    out = of_venue.groupBy(*key).agg(*(unfixed(F.sum(c)).alias(c) for c in ("bid_liquidity", "ask_liquidity", "trade_volume")), F.sum("samples").alias("samples"), F.sum("_v").alias("_t"), F.array_sort(F.collect_list(F.struct("venue", "_v"))).alias("_mix"))
    mix = F.transform("_mix", lambda m: F.struct(m["venue"].alias("venue"), unfixed(m["_v"]).alias("volume"), F.coalesce(F.try_divide(m["_v"].cast("double"), F.col("_t").cast("double")), F.lit(0.0)).alias("weight")))
    rank = F.row_number().over(Window.partitionBy("instrument", "window_start").orderBy("price_low", "price_high", "size_class"))
    return out.withColumns({"venue_mix": mix, "_rank": rank}).where(F.col("_rank") <= most).drop("_mix", "_t", "_rank")


def fills_against_largest(trades: DataFrame, step: float) -> DataFrame:
    """fills with each group's volume against the largest of its series, and the series' own average price and imbalance.

    The largest and the sums are taken over the groups, of which there are few, and joined back.
    """
    g = fills(trades, step).withColumn("volume", F.col("buy_volume") + F.col("sell_volume"))
    whole = g.groupBy(*KEYS).agg(F.max("volume").alias("max_volume"), unfixed(F.sum(fixed(F.col("buy_volume")))).alias("_b"), unfixed(F.sum(fixed(F.col("sell_volume")))).alias("_s"))
    out = g.join(whole, KEYS).withColumns({"share_of_max": F.coalesce(F.try_divide(F.col("volume"), F.col("max_volume")), F.lit(0.0)), "series_imbalance": imbalance(F.col("_b"), F.col("_s"))})
    return out.drop("_b", "_s")


def relative_size(trades: DataFrame, rows: int = 18) -> DataFrame:
    """Class of each trade by its size against the mean of the last `rows` trades of its series: dust below 1/20 of it, small below 1/2, large from
    3 times and whale from 10 times the mean.

    Sizes are compared as whole numbers of 1e-8 (size x count against the sum), as many are just half or three times the mean, where a
    rounded quotient depends on the order in which the sum was taken. Where the sum isn't above 0 all are medium.
    """
    q = fixed(F.col("size"))
    t = rolling(trades, KEYS, "seq", rows, mean_size=F.avg("size"), _sum=F.sum(q.cast("decimal(19,0)")), _count=F.count(q))
    of, to = q.cast("decimal(19,0)") * F.col("_count").cast("decimal(10,0)"), F.col("_sum")
    t = t.withColumn("size_class", F.when(~F.coalesce(to > 0, F.lit(False)), "medium").when(of * 20 < to, "dust").when(of * 2 < to, "small").when(of >= to * 10, "whale").when(of >= to * 3, "large").otherwise("medium"))
    return t.drop("_sum", "_count")


def coarsened(cells: DataFrame, step: float, keys: list[str], buckets: int = 512, most: int = 2048, widest: int = 64) -> DataFrame:
    """Heatmap cells of each window regrouped: the bucket width doubles until at most `buckets` are left (or it is `widest` times as wide).

    Of more than `most` cells those of greatest intensity stay, then by price and size class. Adds `times`, the factor taken.
    """
    factors = [1 << k for k in range(widest.bit_length())]
    narrow = cells.select(*keys, F.floor(F.col("price_low") / F.lit(step)).alias("b")).distinct()
    before = F.lag("b").over(Window.partitionBy(*keys).orderBy("b"))
    # in order, a wider bucket begins where the number divided by its factor changes
    begins = lambda m: F.count_if(F.col("before").isNull() | (F.floor(F.col("b") / m) != F.floor(F.col("before") / m))).alias(f"n{m}")
    counts = narrow.withColumn("before", before).groupBy(*keys).agg(*map(begins, factors))
    chosen = F.lit(widest)
    for m in reversed(factors):
        chosen = F.when(F.col(f"n{m}") <= buckets, m).otherwise(chosen)
    c = cells.join(counts.select(*keys, chosen.alias("times")), keys)
    width = F.lit(step) * F.col("times")
    volumes = ["bid_liquidity", "ask_liquidity", "trade_volume"]
    c = c.withColumn("price_low", F.floor(F.col("price_low") / width) * width)
    c = c.groupBy(*keys, "times", "price_low", "size_class").agg(*(unfixed(F.sum(fixed(F.col(v)))).alias(v) for v in volumes), F.sum("samples").alias("samples"), F.min("seq_min").alias("seq_min"), F.max("seq_max").alias("seq_max"))
    heat = sum((fixed(F.col(v)) for v in volumes), F.lit(0))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(heat.desc(), "price_low", "size_class"))
    return c.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank").withColumn("times", F.col("times").cast("long"))


# Price ranges and the group size in each, by venue. A range ends where the next begins.
_BY_TENS = [(0.0, 0.000001), (0.001, 0.00001), (0.01, 0.0001), (0.1, 0.001), (1.0, 0.01), (10.0, 0.1), (100.0, 1.0), (1000.0, 10.0), (10000.0, 10.0), (100000.0, 100.0)]
GROUP_SIZES = {"BINANCE": _BY_TENS, "BYBIT": _BY_TENS, "COINBASE": [(0.0, 0.0001), (1.0, 0.01), (100.0, 0.01), (10000.0, 1.0)]}


def group_sizes(df: DataFrame, sizes: dict[str, list[tuple[float, float]]] = GROUP_SIZES) -> DataFrame:
    """Adds group_size: by a range join with the venue's table, which is a few rows, else the power of ten next below price / 10000."""
    ends = [(v, low, next_low, step) for v, rows in sizes.items() for (low, step), (next_low, _) in zip(rows, [*rows[1:], (float("inf"), 0.0)])]
    specs = df.sparkSession.createDataFrame(ends, "_venue string, _low double, _high double, _step double")
    hit = (F.upper(F.trim("venue")) == F.col("_venue")) & (F.col("price") >= F.col("_low")) & (F.col("price") < F.col("_high"))
    auto = F.when(F.col("price") > 0, F.pow(F.lit(10.0), F.floor(F.log10(F.col("price") * 0.0001)))).otherwise(1.0)
    return df.join(F.broadcast(specs), hit, "left").withColumn("group_size", F.coalesce("_step", auto)).drop("_venue", "_low", "_high", "_step")


def profile_changes(trades: DataFrame, step: float, ms: int) -> DataFrame:
    """The bucket that each trade changed, as it stood after the trade: running volumes within window and bucket."""
    t = trades.withColumns({"window_start": window_start(F.col("ts_ingest_ms"), ms), "price_low": bucket(F.col("price"), F.lit(step)), "q": fixed(F.col("size"))})
    w = Window.partitionBy(*KEYS, "window_start", "price_low").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    on = lambda s: unfixed(F.sum(F.when(F.col("side") == s, F.col("q")).otherwise(0)).over(w))
    return t.select(*KEYS, "window_start", "price_low", "seq", on("buy").alias("buy_volume"), on("sell").alias("sell_volume"), unfixed(F.sum("q").over(w)).alias("total_volume"))


def rolling_counter(candles: DataFrame, bars: int = 20) -> DataFrame:
    """Volume, trades and the buyers' share of the last `bars` candles."""
    w = Window.partitionBy(*KEYS).orderBy("window_start").rowsBetween(-(bars - 1), 0)
    total = lambda c: F.sum(fixed(F.col(c))).over(w)
    return candles.select(*KEYS, "window_start", unfixed(total("volume")).alias("volume"), F.sum("trade_count").over(w).alias("trades"), F.try_divide(total("buy_volume") * 100.0, total("volume")).alias("buy_pct"))
