"""Reports over series and tiers: coverage, health, catalog, burn rates, percentiles, fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.columns import fixed, unfixed
from tickforge.operators.windows import running_before

KEYS = ["venue", "instrument"]


def recent(windows: DataFrame, ms: int, as_of: int | None = None) -> DataFrame:
    """Windows that start less than ms before as_of, or at most ms before the newest one there is."""
    start = F.col("window_start")
    if as_of is not None:
        return windows.where(start >= as_of - ms)
    newest = windows.agg(F.max(start).alias("_now"))
    return windows.join(F.broadcast(newest), start >= F.col("_now") - ms).drop("_now")


def percentiles(df: DataFrame, keys: list[str], value: str, percents: list[int]) -> DataFrame:
    """Nearest-rank percentiles, the value at place n * p / 100 (whole part, from 0) in order, as p50 and so on.

    Equal values are counted before they are shuffled, and places found in the table of distinct values.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"_upto": F.sum("_n").over(order), "_all": F.sum("_n").over(Window.partitionBy(*keys))})
    at = lambda p: F.min(F.when(F.col("_upto") > F.least(F.floor(F.col("_all") * p / 100), F.col("_all") - 1), F.col(value))).alias(f"p{p}")
    return placed.groupBy(*keys).agg(*map(at, percents))


def coverage_gaps(windows: DataFrame, ms: int, start: int, end: int) -> DataFrame:
    """Runs of missing windows of each series between the window at start and that at end, both included: first and last missing, and how many."""
    w = windows.where(F.col("window_start").between(start, end)).select(*KEYS, "window_start").distinct()
    series = windows.select(*KEYS).distinct()
    ends = F.explode(F.array(F.lit(start - ms), F.lit(end + ms))).alias("window_start")
    every = w.unionByName(series.select(*KEYS, ends))
    nxt = F.lead("window_start").over(Window.partitionBy(*KEYS).orderBy("window_start"))
    out = every.withColumn("next", nxt).where(F.col("next") > F.col("window_start") + ms)
    return out.select(*KEYS, (F.col("window_start") + ms).alias("gap_start"), (F.col("next") - ms).alias("gap_end"), F.expr(f"(next - window_start) div {ms} - 1").alias("missing"))


def level_reason(price: Column, size: Column) -> Column:
    """Why a level of a book is invalid; null if it isn't."""
    return (
        F.when(F.isnan(price) | F.isnan(size) | price.isNull() | size.isNull(), "nan").when((F.abs(price) == float("inf")) | (F.abs(size) == float("inf")), "inf")
        .when(price < 0, "neg_price").when(price == 0, "zero_price").when(size < 0, "neg_qty")
    )


def stream_health(messages: DataFrame, arrival: list[str], stretch: int = 3_600_000) -> DataFrame:
    """Of each series in order of arrival: gaps (a number more than one above the greatest before), their missing numbers, late and repeated numbers, and the state.

    The first column of arrival is a number; series are cut where it passes multiples of `stretch`.
    """
    m = running_before(messages, KEYS, F.expr(f"{arrival[0]} div {stretch}"), arrival, _top=(F.max, F.col("seq")))
    gap = F.col("seq") > F.col("_top") + 1
    out = m.groupBy(*KEYS).agg(
        F.max("seq").alias("last_seq"), F.count_if(gap).alias("gaps"), F.coalesce(F.sum(F.when(gap, F.col("seq") - F.col("_top") - 1)), F.lit(0)).alias("missing"),
        F.count_if(F.col("seq") < F.col("_top")).alias("out_of_order"), F.count_if(F.col("seq") == F.col("_top")).alias("duplicates"),
    )
    return out.withColumn("state", F.when((F.col("out_of_order") > 0) | (F.col("duplicates") > 0), "NEEDS_ATTENTION").otherwise("HEALTHY"))


def coverage_status(series: DataFrame, counts: DataFrame, kept: list[str], wanted: list[str]) -> DataFrame:
    """Of each wanted artifact how many series have it (available), have none of it (empty) or can't (unavailable: it isn't kept), and the status.

    counts: venue, instrument, artifact, n. Series are multiplied by the few artifacts, nothing else.
    """
    rows = series.select(*KEYS).distinct().withColumn("artifact", F.explode(F.array(*map(F.lit, wanted)))).join(counts.select(*KEYS, "artifact", "n"), [*KEYS, "artifact"], "left")
    there = F.col("artifact").isin(*kept) if kept else F.lit(False)
    has = F.coalesce(F.col("n"), F.lit(0)) > 0
    g = rows.groupBy("artifact").agg(F.count("*").alias("total"), F.count_if(there & has).alias("available"), F.count_if(there & ~has).alias("empty"), F.count_if(~there).alias("unavailable"))
    status = F.when(F.col("unavailable") == F.col("total"), "unavailable").when(F.col("empty") == F.col("total"), "empty").when((F.col("available") > 0) & (F.col("empty") > 0), "partial").when(F.col("unavailable") > 0, "partial").otherwise("available")
    return g.withColumn("status", status)


def position_state(positions: DataFrame, now_ms: Column, stale_ms: int) -> DataFrame:
    """Of each account and symbol the positions (venue, side, last_fill_ms), how many are stale, and whether it is long on one venue and short on another.

    A position without a fill is never stale.
    """
    stale = (F.col("last_fill_ms") > 0) & (now_ms - F.col("last_fill_ms") > stale_ms)
    return positions.groupBy("account", "symbol").agg(F.count("*").alias("positions"), F.count_if(F.coalesce(stale, F.lit(False))).alias("stale"), (F.max(F.when(F.col("side") == "long", 1).otherwise(0)) * F.max(F.when(F.col("side") == "short", 1).otherwise(0)) == 1).alias("diverges"))


def federated(hot: DataFrame, cold: DataFrame, key: list[str], start: int, end: int, boundary: int, limit: int) -> DataFrame:
    """The first `limit` windows within [start, end] over two tiers. Only the cold tier is read up to the boundary, only the hot one from it on; hot wins where both have a window."""
    tiers = [d.withColumn("_tier", F.lit(k)) for k, (d, needed) in enumerate(((hot, end > boundary), (cold, start < boundary))) if needed]
    rows = None
    for d in tiers:
        d = d.where(F.col("window_start").between(start, end))
        rows = d if rows is None else rows.unionByName(d)
    rest = [c for c in hot.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), "_tier").alias("r")).select(*key, "r.*")
    return best.orderBy("window_start", *KEYS).limit(limit)


def tier_times(*tiers: DataFrame) -> DataFrame:
    """The window starts that any tier has; no other column is read."""
    out = None
    for t in tiers:
        one = t.select(*KEYS, "window_start")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def catalog(*artifacts: tuple[str, DataFrame]) -> DataFrame:
    """artifact, series and timeframe with first and last window and their number; artifacts have a timeframe column."""
    out = None
    for name, df in artifacts:
        one = df.groupBy(*KEYS, "timeframe").agg(F.min("window_start").alias("first_start"), F.max("window_start").alias("last_start"), F.count("*").alias("windows")).withColumn("artifact", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


# Windows in minutes, the burn that is too fast over the first two, and too much over the last two.
BURN_MINUTES, FAST, SLOW = (5, 60, 30, 360), 14.4, 6.0


def burn_rates(df: DataFrame, key: str, time_col: str, bad: Column, objective: float) -> DataFrame:
    """Every five minutes: share of the error budget burnt over 5 minutes, 1 hour, 30 minutes and 6 hours, and what that breaches.

    Five-minute counts come first, so the sliding windows go over a small table.
    """
    step = 300_000
    t = F.col(time_col)
    g = df.groupBy(key, (t - F.pmod(t, F.lit(step))).alias("at")).agg(F.count("*").alias("total"), F.count_if(bad).alias("errors"))
    for minutes in BURN_MINUTES:
        w = Window.partitionBy(key).orderBy("at").rangeBetween(-(minutes * 60_000 - step), 0)
        g = g.withColumn(f"burn_{minutes}m", F.sum("errors").over(w) / F.sum("total").over(w) / F.lit(1 - objective))
    five, hour, half, six = (F.col(f"burn_{m}m") for m in BURN_MINUTES)
    return g.withColumn("breach", F.when((five > FAST) & (hour > FAST), "fast").when((half > SLOW) & (six > SLOW), "slow").otherwise("none"))


def fused_profile(profile: DataFrame, keys: list[str], most: int = 400) -> DataFrame:
    """Venues' profiles merged by bucket (the `most` lowest, as the feature has it) with each venue's share: keys, bounds, volumes, mix as VENUE:percent, and is_poc, the lowest of the fullest buckets."""
    by_venue = profile.groupBy(*keys, "price_low", "price_high", "venue").agg(F.sum(fixed(F.col("buy_volume"))).alias("b"), F.sum(fixed(F.col("sell_volume"))).alias("s"))
    total = F.col("b") + F.col("s")
    g = by_venue.groupBy(*keys, "price_low", "price_high").agg(F.sum("b").alias("b"), F.sum("s").alias("s"), F.array_sort(F.collect_list(F.struct("venue", total.alias("v")))).alias("mix"))
    share = lambda x: F.concat(x["venue"], F.lit(":"), F.round(x["v"] * 100 / (F.col("b") + F.col("s")), 2).cast("decimal(9,2)").cast("string"))
    g = g.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("price_low"))).where(F.col("k") <= most)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy((F.col("b") + F.col("s")).desc(), "price_low"))
    return g.select(*keys, "price_low", "price_high", unfixed(F.col("b")).alias("buy_volume"), unfixed(F.col("s")).alias("sell_volume"), unfixed(F.col("b") + F.col("s")).alias("total_volume"), F.array_join(F.transform("mix", share), ",").alias("mix"), (first == 1).alias("is_poc"))


def fusion_meta(books: DataFrame, stale_ms: int, divergent_bps: float = 50.0) -> DataFrame:
    """How a fusion of venues' latest books (instrument, venue, ts_ingest_ms, bid, ask, spread_bps) stands: fresh and stale sources, ages, weight of a fresh one, confidence, divergence and tags."""
    now = F.max("ts_ingest_ms").over(Window.partitionBy("instrument"))
    b = books.withColumn("age", now - F.col("ts_ingest_ms")).withColumn("fresh", F.col("age") <= stale_ms)
    n, fresh = F.count("*"), F.count_if("fresh")
    g = b.groupBy("instrument").agg(n.alias("sources"), fresh.alias("fresh"), F.max("age").alias("oldest_ms"), F.min("age").alias("newest_ms"), F.max(F.when(F.col("fresh"), F.col("spread_bps"))).alias("hi"), F.min(F.when(F.col("fresh"), F.col("spread_bps"))).alias("lo"))
    confidence = F.col("fresh") / F.col("sources") * F.when(F.col("fresh") == 1, 0.7).otherwise(1.0)
    g = g.withColumns({"weight_pct": F.when(F.col("fresh") > 0, 100.0 / F.col("fresh")).otherwise(0.0), "confidence": confidence, "divergence_bps": F.coalesce(F.col("hi") - F.col("lo"), F.lit(0.0))})
    c, stale = F.col("confidence"), F.col("sources") - F.col("fresh")
    tags = [(c < 0.5, "degraded"), (c >= 0.9, "high_confidence"), ((stale > 0) & (F.col("fresh") > 0), "partial_sources"), (F.col("fresh") == 1, "single_source"), (F.col("divergence_bps") > divergent_bps, "venue_divergent")]
    return g.withColumn("tags", F.concat_ws(",", *(F.when(t, name) for t, name in tags))).drop("hi", "lo")
