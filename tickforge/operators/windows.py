"""Tumbling windows over ticks: candles, roll-ups, tape, stats, open interest, running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.columns import FUNDING_SCALE, TIMEFRAMES, fixed, flags, imbalance, unfixed, window_start

KEYS = ["venue", "instrument"]


def numbered(df: DataFrame, keys: list[str], stretch: Column, order: list[str], out: str = "seq") -> DataFrame:
    """Adds 1, 2, .. in each series (keys) by `order`; stretch must not fall along it.

    Rows are counted within stretches, and the stretches before are added, so that no task has to order a whole series.
    """
    key = [*keys, "_stretch"]
    df = df.withColumn("_stretch", stretch)
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = df.groupBy(*key).agg(F.count("*").alias("_n")).select(*key, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_within", within).join(before, key).withColumn(out, F.col("_before") + F.col("_within")).drop("_stretch", "_before", "_within")


def rolling(df: DataFrame, keys: list[str], order: str, rows: int, block: int = 8192, **columns: Column) -> DataFrame:
    """Adds aggregates over the last `rows` rows of each series, by `order`, a number that grows along it.

    Series are cut into blocks of so many rows, each with the last rows of the block before it, so that a long series is many tasks' work.
    """
    df = numbered(df, keys, F.col(order).cast("long") - F.pmod(F.col(order), F.lit(block)), [order], "_i")
    own = F.col("_i") - F.pmod("_i", F.lit(block))
    in_both = F.pmod("_i", F.lit(block)) > block - rows
    copies = df.withColumn("_block", F.explode(F.when(in_both, F.array(own, own + block)).otherwise(F.array(own))))
    w = Window.partitionBy(*keys, "_block").orderBy("_i").rowsBetween(-(rows - 1), 0)
    return copies.withColumns({name: c.over(w) for name, c in columns.items()}).where(F.col("_block") == own).drop("_i", "_block")


#: How two parts of a running aggregate become one; nulls stand for no rows.
_JOINED = {F.max: F.greatest, F.min: F.least, F.sum: lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}


def running_before(df: DataFrame, keys: list[str], stretch: Column, order: list[str], **values: tuple) -> DataFrame:
    """Adds, for each name: (F.max, F.min or F.sum, column), the aggregate over the rows before each row of its series (null where there is none).

    stretch must not fall along `order`. Each stretch is ordered on its own, and what the stretches before it come to is carried on by a
    table with one row a stretch, so that no task orders a whole series.
    """
    key = [*keys, "_stretch"]
    df = df.withColumn("_stretch", stretch)
    far = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    near = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = df.groupBy(*key).agg(*(f(c).alias(f"_{name}") for name, (f, c) in values.items()))
    carried = whole.select(*key, *(f(f"_{name}").over(far).alias(f"_{name}") for name, (f, _) in values.items()))
    out = df.withColumns({name: f(c).over(near) for name, (f, c) in values.items()}).join(carried, key)
    return out.withColumns({name: _JOINED[f](F.col(name), F.col(f"_{name}")) for name, (f, _) in values.items()}).drop("_stretch", *(f"_{name}" for name in values))


def _closed(df: DataFrame, keys: list[str]) -> DataFrame:
    """is_closed: a later window of the same series has begun."""
    last = F.max("window_start").over(Window.partitionBy(*keys))
    return df.withColumn("is_closed", F.col("window_start") < last)


def candles(trades: DataFrame, timeframe: str, time_col: str = "ts_ingest_ms", keys: list[str] = KEYS) -> DataFrame:
    """OHLC by sequence, volumes in fixed point, counts and sequence bounds of each window; trades that aren't positive don't count."""
    ms = TIMEFRAMES[timeframe]
    t = trades.where("price > 0 and size > 0 and side in ('buy', 'sell')")
    t = t.withColumns({"window_start": window_start(F.col(time_col), ms), "p": fixed(F.col("price")), "q": fixed(F.col("size"))})
    buy = F.sum(F.when(F.col("side") == "buy", F.col("q")).otherwise(0))
    agg = t.groupBy(*keys, "window_start").agg(F.min_by("p", "seq").alias("o"), F.max("p").alias("h"), F.min("p").alias("l"), F.max_by("p", "seq").alias("c"), F.sum("q").alias("v"), buy.alias("b"), F.count("*").alias("trade_count"), F.min("seq").alias("seq_first"), F.max("seq").alias("seq_last"))
    out = agg.select(*keys, F.lit(timeframe).alias("timeframe"), "window_start", (F.col("window_start") + ms).alias("window_end"), *(unfixed(F.col(x)).alias(y) for x, y in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"), ("b", "buy_volume"))), unfixed(F.col("v") - F.col("b")).alias("sell_volume"), "trade_count", "seq_first", "seq_last")
    return _closed(out, keys)


def roll_up(candles: DataFrame, timeframe: str, keys: list[str] = KEYS) -> DataFrame:
    """Candles of a longer timeframe from shorter ones; sums stay in fixed point."""
    ms = TIMEFRAMES[timeframe]
    c = candles.withColumn("w", window_start(F.col("window_start"), ms))
    total = lambda x: unfixed(F.sum(fixed(F.col(x)))).alias(x)
    out = c.groupBy(*keys, F.col("w").alias("window_start")).agg(F.min_by("open", c["window_start"]).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", c["window_start"]).alias("close"), total("volume"), total("buy_volume"), total("sell_volume"), F.sum("trade_count").alias("trade_count"), F.min("seq_first").alias("seq_first"), F.max("seq_last").alias("seq_last"))
    return _closed(out.withColumn("timeframe", F.lit(timeframe)).withColumn("window_end", F.col("window_start") + ms), keys)


def cascade(base: DataFrame, timeframes: list[str], keys: list[str] = KEYS) -> DataFrame:
    """All timeframes from closed base candles, which are multiplied by the number of timeframes; the trades never are."""
    lengths = F.explode(F.array(*(F.struct(F.lit(x).alias("timeframe"), F.lit(TIMEFRAMES[x]).cast("long").alias("ms")) for x in timeframes)))
    c = base.where("is_closed").drop("timeframe").withColumn("tf", lengths).withColumn("w", F.col("window_start") - F.pmod("window_start", F.col("tf.ms")))
    total = lambda x: unfixed(F.sum(fixed(F.col(x)))).alias(x)
    return c.groupBy(*keys, F.col("tf.timeframe").alias("timeframe"), F.col("w").alias("window_start")).agg(F.min_by("open", c["window_start"]).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", c["window_start"]).alias("close"), total("volume"), F.sum("trade_count").alias("trade_count"))


def volume_stats(trades: DataFrame, timeframe: str = "5m", time_col: str = "ts_exchange_ms") -> DataFrame:
    """Volumes by side, count and volume-weighted price of each window."""
    t = trades.withColumns({"window_start": window_start(F.col(time_col), TIMEFRAMES[timeframe]), "q": fixed(F.col("size")), "pq": F.col("price") * F.col("size")})
    side = lambda s: unfixed(F.sum(F.when(F.col("side") == s, F.col("q")).otherwise(0)))
    return t.groupBy(*KEYS, "window_start").agg(unfixed(F.sum("q")).alias("total_volume"), side("buy").alias("buy_volume"), side("sell").alias("sell_volume"), F.count("*").alias("trade_count"), F.try_divide(F.sum("pq"), F.sum("size")).alias("vwap"))


def tape(trades: DataFrame, timeframe: str = "5s", burst: int | None = None) -> DataFrame:
    """Counts, volumes and notionals by side, prices, rate, imbalance and burst flag of each window."""
    ms = TIMEFRAMES[timeframe]
    t = trades.withColumns({"window_start": window_start(F.col("ts_ingest_ms"), ms), "q": fixed(F.col("size")), "pq": fixed(F.col("price") * F.col("size"))})
    on = lambda s, x: F.sum(F.when(F.col("side") == s, x).otherwise(0))
    out = t.groupBy(*KEYS, "window_start").agg(F.count("*").alias("trade_count"), on("buy", 1).alias("buy_count"), on("sell", 1).alias("sell_count"), unfixed(on("buy", F.col("q"))).alias("buy_volume"), unfixed(on("sell", F.col("q"))).alias("sell_volume"), unfixed(F.sum("q")).alias("total_volume"), unfixed(F.sum("pq")).alias("notional"), F.max("price").alias("max_price"), F.min("price").alias("min_price"), F.max_by("price", F.struct("seq", "price")).alias("last_price"), F.max("size").alias("max_size"), F.max("seq").alias("seq_last"))
    out = out.withColumns({"vwap": F.try_divide(F.col("notional"), F.col("total_volume")), "rate": F.col("trade_count") * 1000.0 / ms, "imbalance": imbalance(F.col("buy_volume"), F.col("sell_volume"))})
    return out.withColumn("is_burst", F.col("trade_count") > F.lit(burst)) if burst is not None else out


def delta_volume(tape: DataFrame) -> DataFrame:
    return tape.select(*KEYS, "window_start", "buy_volume", "sell_volume", (F.col("buy_volume") - F.col("sell_volume")).alias("delta"), "trade_count")


def running_delta(deltas: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Cumulative delta, added up in fixed point."""
    w = Window.partitionBy(*keys).orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumn("cvd", unfixed(F.sum(fixed(F.col("delta"))).over(w)))


def bar_stats(tape: DataFrame) -> DataFrame:
    return tape.select(*KEYS, "window_start", "trade_count", "total_volume", F.try_divide(F.col("total_volume"), F.col("trade_count").cast("double")).alias("avg_size"), "vwap", "max_size", (F.col("max_price") - F.col("min_price")).alias("range"))


def stats(marks: DataFrame, liquidations: DataFrame, timeframe: str) -> DataFrame:
    """Liquidations, mark price OHLC and funding of each window; nulls where there was no sample. Funding counts where it isn't zero."""
    ms = TIMEFRAMES[timeframe]
    m = marks.select(*KEYS, "ts_ingest_ms", "seq", fixed(F.col("mark_price")).alias("m"), F.when(F.col("funding_rate") != 0, fixed(F.col("funding_rate"), FUNDING_SCALE)).alias("f"))
    q = liquidations.select(*KEYS, "ts_ingest_ms", fixed(F.col("size")).alias("q"), "side")
    u = m.unionByName(q, allowMissingColumns=True).withColumn("window_start", window_start(F.col("ts_ingest_ms"), ms))
    out = u.groupBy(*KEYS, "window_start").agg(unfixed(F.sum("q")).alias("liq_volume"), unfixed(F.sum(F.when(F.col("side") == "buy", F.col("q")))).alias("liq_buy_volume"), unfixed(F.sum(F.when(F.col("side") == "sell", F.col("q")))).alias("liq_sell_volume"), F.min("seq").alias("seq_first"), F.max("seq").alias("seq_last"), unfixed(F.max_by("f", F.when(F.col("f").isNotNull(), F.col("seq"))), FUNDING_SCALE).alias("funding_last"), F.count("q").alias("liq_count"), unfixed(F.min_by("m", "seq")).alias("mark_open"), unfixed(F.max("m")).alias("mark_high"), unfixed(F.min("m")).alias("mark_low"), unfixed(F.max_by("m", "seq")).alias("mark_close"), F.count("m").alias("mark_count"), F.sum("f").alias("fs"), F.count("f").alias("funding_count"))
    out = out.withColumn("funding_avg", F.expr(f"case when funding_count > 0 then (fs div funding_count) / {FUNDING_SCALE}.0D end")).drop("fs")
    return out.withColumn("quality_flags", flags(F.col("mark_count") == 0, F.col("funding_count") == 0, F.col("liq_count") == 0))


def interest_windows(oi: DataFrame, timeframe: str) -> DataFrame:
    """The last open interest of each window, and its change against the window before."""
    ms = TIMEFRAMES[timeframe]
    g = oi.groupBy(*KEYS, window_start(F.col("ts_ingest_ms"), ms).alias("window_start")).agg(F.max_by("open_interest", "seq").alias("open_interest"))
    before = F.lag("open_interest").over(Window.partitionBy(*KEYS).orderBy("window_start"))
    delta = F.coalesce(F.col("open_interest") - before, F.lit(0.0))
    return g.withColumns({"delta": delta, "delta_pct": F.when(before > 0, delta / before).otherwise(0.0)})


def interest_changes(oi: DataFrame) -> DataFrame:
    """Change against the previous value, absolute and as a share; median gap of the last 10 arrivals and what it says."""
    w = Window.partitionBy(*KEYS).orderBy("seq")
    before = F.lag("open_interest").over(w)
    out = oi.withColumns({"delta": F.coalesce(F.col("open_interest") - before, F.lit(0.0)), "delta_pct": F.when(before > 0, (F.col("open_interest") - before) / before).otherwise(0.0)})
    out = out.withColumn("arrivals", F.collect_list("ts_ingest_ms").over(w.rowsBetween(-9, 0)))
    gaps = F.expr("array_sort(filter(transform(sequence(1, size(arrivals) - 1), i -> arrivals[i] - arrivals[i - 1]), g -> g > 0))")
    out = out.withColumn("gaps", F.when(F.size("arrivals") > 1, gaps).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("cadence_ms", F.expr("case when size(gaps) > 0 then (gaps[(size(gaps) - 1) div 2] + gaps[size(gaps) div 2]) div 2 else 0 end"))
    level = F.when(F.size("gaps") == 0, "low").when(F.col("cadence_ms") < 5000, "high").when(F.col("cadence_ms") < 30000, "medium").otherwise("low")
    return out.withColumn("confidence", level).drop("arrivals", "gaps")
