"""Pattern detection over books and tape, and market regimes over candles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.columns import fixed, imbalance, spread_bps_or_zero, unfixed
from tickforge.operators.windows import rolling, running_before

KEYS = ["venue", "instrument"]

# The steps of each rule's measure from which evidence is critical and high.
SPREAD_Z, DEPTH_DROP, STREAK, VOLUME_RATIO, LEVELS_LOST, SIDE_DROP = (5.0, 3.5), (0.70, 0.50), (30, 20), (8.0, 4.0), (12, 8), (0.75, 0.60)


def rated(df: DataFrame, *measures: tuple[Column, tuple[float, float]]) -> DataFrame:
    """df with severity and confidence: critical (.95) or high (.85) where any measure reaches its step, else medium (.70)."""

    def reached(k: int) -> Column:
        out = F.lit(False)
        for x, steps in measures:
            out = out | (x >= steps[k])
        return out

    critical, high = reached(0), reached(1)
    return df.withColumns({"severity": F.when(critical, "critical").when(high, "high").otherwise("medium"), "confidence": F.when(critical, 0.95).when(high, 0.85).otherwise(0.70)})


def book_inputs(snapshots: DataFrame) -> DataFrame:
    """Best prices, spread, depths, level counts and imbalance of each snapshot."""
    depth = lambda c: f"aggregate({c}, 0D, (a, x) -> a + x.size)"
    out = snapshots.select(*KEYS, "seq", "ts_ingest_ms", F.expr("bids[0].price").alias("bid"), F.expr("asks[0].price").alias("ask"), F.expr(depth("bids")).alias("bid_depth"), F.expr(depth("asks")).alias("ask_depth"), F.size("bids").cast("long").alias("bid_levels"), F.size("asks").cast("long").alias("ask_levels"))
    return out.withColumns({"spread_bps": spread_bps_or_zero(F.col("bid"), F.col("ask")), "imbalance": imbalance(F.col("bid_depth"), F.col("ask_depth")), "depth": F.col("bid_depth") + F.col("ask_depth")})


def _rolling(df: DataFrame, column: str, rows: int = 64) -> DataFrame:
    df = rolling(df, KEYS, "seq", rows, n=F.count("*"), mean=F.avg(column), sd=F.stddev_pop(column))
    return df.withColumn("z", F.when(F.col("sd") > 1e-9, (F.col(column) - F.col("mean")) / F.col("sd")).otherwise(0.0))


def spread_explosion(inputs: DataFrame, z: float = 2.5, bps: float = 10.0, least: int = 10) -> DataFrame:
    """Books whose spread is an outlier among the last 64. Books without two prices, or with the ask not above the bid, aren't looked at."""
    open_books = inputs.where((F.col("bid") > 0) & (F.col("ask") > F.col("bid")))
    out = _rolling(open_books, "spread_bps").where((F.col("n") >= least) & (F.col("z") > z) & (F.col("spread_bps") > bps))
    return rated(out, (F.col("z"), SPREAD_Z))


def thinning(inputs: DataFrame, z: float = -2.0, drop: float = 0.3, least: int = 10) -> DataFrame:
    out = _rolling(inputs, "depth").where((F.col("mean") > 0) & (F.col("n") >= least) & (F.col("z") <= z) & (F.col("depth") <= F.col("mean") * (1 - drop)))
    return rated(out.withColumn("drop_share", 1 - F.col("depth") / F.col("mean")), (F.col("drop_share"), DEPTH_DROP))


#: Numbers of a series that are looked at together by rules on the row before; series are cut there.
STRETCH = 8192


def _with_row_before(inputs: DataFrame, *columns: str) -> DataFrame:
    """inputs with `_b`, the number and columns of the row before in its series; null for the first. No task orders a whole series."""
    return running_before(inputs, KEYS, F.expr(f"seq div {STRETCH}"), ["seq"], _b=(F.max, F.struct("seq", *columns)))


def _streaks(inputs: DataFrame, limit: float) -> DataFrame:
    """inputs beyond the limit with their sign and the number of the row that their run of one sign in unbroken order begins with (island)."""
    sign = F.when(F.col("imbalance") >= limit, 1).when(F.col("imbalance") <= -limit, -1).otherwise(0)
    r = _with_row_before(inputs.withColumn("sign", sign), "sign")
    begins = F.when(F.col("_b").isNull() | (F.col("_b.sign") != F.col("sign")), F.col("seq"))
    r = running_before(r.withColumn("_begins", begins).drop("_b"), KEYS, F.expr(f"seq div {STRETCH}"), ["seq"], _run=(F.max, F.col("_begins")))
    return r.withColumn("island", F.coalesce("_begins", "_run")).drop("_begins", "_run").where("sign <> 0")


def imbalance_streaks(inputs: DataFrame, limit: float = 0.3, length: int = 10) -> DataFrame:
    """Runs of one sign with at least `length` snapshots in a row beyond the limit."""
    out = _streaks(inputs, limit).groupBy(*KEYS, "island", "sign").agg(F.count("*").alias("length"), F.min("seq").alias("seq_start"), F.max("seq").alias("seq_end"))
    return out.where(F.col("length") >= length).drop("island").withColumn("sign", F.col("sign").cast("long"))


def persistent_imbalance(inputs: DataFrame, limit: float = 0.3, length: int = 10) -> DataFrame:
    """Each snapshot from the length-th of a run on, with how many the run has had."""
    w = Window.partitionBy(*KEYS, "island").orderBy("seq")
    out = _streaks(inputs, limit).withColumns({"consecutive": F.row_number().over(w).cast("long"), "seq_start": F.min("seq").over(w)}).where(F.col("consecutive") >= length)
    return rated(out.withColumn("sign", F.col("sign").cast("long")), (F.col("consecutive"), STREAK))


def sweeps(inputs: DataFrame, levels: int = 5, share: float = 0.4) -> DataFrame:
    """Snapshots where a side lost many levels and much depth since the one before; the bid side if it lost no fewer levels than the ask side."""
    r = _with_row_before(inputs, "bid_depth", "ask_depth", "bid_levels", "ask_levels")
    for s in ("bid", "ask"):
        before = F.col(f"_b.{s}_depth")
        drop = F.when((before > 0) & (F.col(f"{s}_depth") < before), (before - F.col(f"{s}_depth")) / before).otherwise(0.0)
        r = r.withColumns({f"{s}_lost": F.col(f"_b.{s}_levels") - F.col(f"{s}_levels"), f"{s}_drop": drop})
    hit = lambda s: (F.col(f"{s}_lost") >= levels) & (F.col(f"{s}_drop") >= share)
    r = r.withColumn("side", F.when(hit("bid") & (F.col("bid_lost") >= F.col("ask_lost")), "bid").when(hit("ask"), "ask")).where("side is not null").drop("_b")
    of_side = lambda c: F.when(F.col("side") == "bid", F.col(f"bid_{c}")).otherwise(F.col(f"ask_{c}"))
    r = r.withColumns({"levels_lost": of_side("lost"), "depth_drop": of_side("drop")})
    return rated(r, (F.col("levels_lost"), LEVELS_LOST), (F.col("depth_drop"), SIDE_DROP))


def evidence(inputs: DataFrame) -> DataFrame:
    """What all rules on books find: kind, venue, instrument, seq, ts_ingest_ms, severity, confidence."""
    rules = {"spread_explosion": spread_explosion, "thinning": thinning, "imbalance": persistent_imbalance, "sweep": sweeps}
    out = None
    for kind, rule in rules.items():
        found = rule(inputs).select(F.lit(kind).alias("kind"), *KEYS, "seq", "ts_ingest_ms", "severity", "confidence")
        out = found if out is None else out.unionByName(found)
    return out


def cooled(candidates: DataFrame, keys: list[str], ms: int = 5000, order: tuple[str, ...] = ("ts_ingest_ms",)) -> DataFrame:
    """Candidates at least ms after the last one of their stream that was kept.

    A task reads its streams in order, a batch at a time, and carries one time on.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, 0
        for batch in batches:
            kept = []
            for key, ts in zip(zip(*(batch.column(k).to_pylist() for k in keys)), batch.column("ts_ingest_ms").to_pylist()):
                good = key != at or ts - last >= ms
                at = key
                if good:
                    last = ts
                kept.append(good)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return candidates.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(keep, candidates.schema)


def absorption(trades: DataFrame, ratio: float = 2.0, move: float = 0.001, least: int = 10, ms: int = 5000) -> DataFrame:
    """Trades by which volume piled up to `ratio` times that of the last 64 while the price stayed near a reference.

    The reference follows the price until `least` trades are known, and moves on when the price leaves it (volume then starts anew) and after
    each finding; findings are ms apart. What follows depends on what was found, so a task reads its series in order, a batch at a time, and
    carries a few numbers on. Volumes are whole numbers of 1e-8.
    """
    t = trades.where("price > 0 and size > 0").select(*KEYS, "seq", "ts_ingest_ms", "price", fixed(F.col("size")).alias("q"))
    t = rolling(t, KEYS, "seq", 64, ring=F.sum("q"), n=F.count("*"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, ref, total, start, last = None, 0.0, 0, 0, None
        for batch in batches:
            out = []
            for venue, instrument, seq, ts, price, q, ring, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (venue, instrument) != series:
                    series, ref, total, start, last = (venue, instrument), price, 0, seq, None
                if n < least:
                    ref, start = price, seq
                    continue
                total += q
                if abs(price - ref) / ref > move:
                    ref, total, start = price, 0, seq
                elif total >= ratio * ring and (last is None or ts - last >= ms):
                    out.append((*series, seq, start, ref, total, total / ring))
                    ref, total, start, last = price, 0, seq, ts
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 7, kinds)], names=names)

    names = [*KEYS, "seq", "seq_start", "ref_price", "q", "volume_ratio"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64()]
    dealt = t.repartition(*KEYS).sortWithinPartitions(*KEYS, "seq")
    found = dealt.mapInArrow(fold, "venue string, instrument string, seq long, seq_start long, ref_price double, q long, volume_ratio double")
    return rated(found.withColumn("volume", unfixed(F.col("q"))).drop("q"), (F.col("volume_ratio"), VOLUME_RATIO))


def _order() -> Window:
    return Window.partitionBy(*KEYS).orderBy("window_start")


def _unit(x: Column) -> Column:
    """x within [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def trend(candles: DataFrame, rows: int = 20, slope: float = 0.0015, move: float = 0.006) -> DataFrame:
    """Trending or ranging, by the least-squares slope and net move of the last closes, with strength.

    A trend is the stronger the closer slope and move come to twice their least, a range the flatter and narrower it is.
    """
    c = candles.withColumn("x", F.row_number().over(_order()).cast("double"))
    w = _order().rowsBetween(-(rows - 1), 0)
    mean = F.avg("close").over(w)
    c = c.withColumns({"n": F.count(F.when(F.col("close") > 0, 1)).over(w), "slope": F.regr_slope("close", "x").over(w) / mean, "first": F.first("close").over(w), "range": (F.max("close").over(w) - F.min("close").over(w)) / mean})
    c = c.where(F.col("n") == rows).withColumn("move", (F.col("close") - F.col("first")) / F.col("first"))
    steep, far = F.abs("slope"), F.abs("move")
    c = c.withColumn("kind", F.when((steep >= slope) & (far >= move), "trending").otherwise("ranging"))
    strong = 0.5 * _unit(steep / (2 * slope)) + 0.5 * _unit(far / (2 * move))
    calm = 0.5 * (1 - _unit(steep / (2 * slope))) + 0.5 * (1 - _unit(F.col("range") / (4 * move)))
    return c.withColumn("strength", F.when(F.col("kind") == "trending", strong).otherwise(calm))


def volatility(candles: DataFrame, rows: int = 14, high: float = 0.015, low: float = 0.004) -> DataFrame:
    """High or low volatility by the mean true range of the last `rows` candles that have one before them; a candle between has none."""
    before = F.lag("close").over(_order())
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    c = candles.withColumn("tr", F.when(before.isNotNull(), true_range))
    w = _order().rowsBetween(-(rows - 1), 0)
    c = c.withColumns({"n": F.count("tr").over(w), "atr": F.avg("tr").over(w)}).where(F.col("n") == rows).withColumn("atr_share", F.col("atr") / F.col("close"))
    x = F.col("atr_share")
    c = c.withColumn("kind", F.when(x >= high, "high_volatility").when(x <= low, "low_volatility")).where("kind is not null")
    return c.withColumn("strength", F.when(F.col("kind") == "high_volatility", _unit((x - high) / high + 0.5)).otherwise(_unit((low - x) / low + 0.5)))


def breakout(candles: DataFrame, rows: int = 20, move: float = 0.0075, ratio: float = 1.8) -> DataFrame:
    """Candles that move far from the close before on much more volume than the mean of the `rows` before."""
    w = _order().rowsBetween(-rows, -1)
    before = F.lag("close").over(_order())
    c = candles.withColumns({"n": F.count("*").over(w), "mean_volume": F.avg("volume").over(w), "move": (F.col("close") - before) / before})
    c = c.where((F.col("n") == rows) & (F.col("mean_volume") > 0)).withColumn("volume_ratio", F.col("volume") / F.col("mean_volume"))
    c = c.where((F.abs("move") >= move) & (F.col("volume_ratio") >= ratio))
    return c.withColumn("strength", 0.5 * _unit(F.abs("move") / (2 * move)) + 0.5 * _unit(F.col("volume_ratio") / (2 * ratio)))


def arbitrated(candles: DataFrame) -> DataFrame:
    """The regime in force at each candle, the one of the greatest strength times confidence, and whether it changed.

    Windows are full here, so every confidence is 1. On ties breakout goes before trend, and trend before volatility.
    """
    k = [*KEYS, "window_start"]
    found = None
    for place, one in ((3, breakout(candles).withColumn("kind", F.lit("breakout"))), (2, trend(candles)), (1, volatility(candles))):
        rows = one.select(*k, F.struct(F.col("strength").alias("strength"), F.lit(place).alias("place"), F.col("kind").alias("kind")).alias("s"))
        found = rows if found is None else found.unionByName(rows)
    best = found.groupBy(*k).agg(F.max("s").alias("s")).select(*k, "s.kind", "s.strength", F.lit(1.0).alias("confidence"))
    last = F.lag("kind").over(_order())
    return best.withColumn("transition", last.isNotNull() & (last != F.col("kind")))


def latest_regimes(regimes: DataFrame) -> DataFrame:
    """The regime that each stream is in, since when, and how many it has been through."""
    order = Window.partitionBy(*KEYS).orderBy("window_start")
    runs = regimes.withColumn("run", F.sum(F.col("transition").cast("long")).over(order))
    spans = runs.groupBy(*KEYS, "run").agg(F.min("window_start").alias("since"), F.max_by(F.struct("kind", "strength"), "window_start").alias("now"))
    return spans.groupBy(*KEYS).agg(F.max_by("since", "run").alias("since"), F.max_by("now", "run").alias("now"), F.max("run").alias("transitions")).select(*KEYS, "now.kind", "now.strength", "since", "transitions")


def spread_regimes(inputs: DataFrame, z: float = 2.5, bps: float = 10.0, least: int = 10) -> DataFrame:
    """Snapshots where the spread, as an outlier, entered another regime: TIGHT < 5 <= NORMAL <= 20 < WIDE <= 50 < BLOWN.

    The first snapshot with `least` samples (at most 63, as the last 64 are counted) is compared with the stream's first, as regimes aren't
    followed before. No task orders a whole series.
    """
    x = F.col("spread_bps")
    r = _rolling(inputs.where("spread_bps > 0"), "spread_bps").withColumn("regime", F.when(x < 5, "TIGHT").when(x <= 20, "NORMAL").when(x <= 50, "WIDE").otherwise("BLOWN"))
    at = F.struct("seq", "regime")
    r = running_before(r, KEYS, F.expr(f"seq div {STRETCH}"), ["seq"], _first=(F.min, at), _last=(F.max, at))
    r = r.withColumn("before", F.when(F.col("n") == least, F.col("_first.regime")).otherwise(F.col("_last.regime"))).drop("_first", "_last")
    out = r.where((F.col("n") >= least) & (F.col("z") >= z) & (x > bps) & (F.col("before") != F.col("regime")))
    of_regime = lambda blown, wide, other: F.when(F.col("regime") == "BLOWN", blown).when(F.col("regime") == "WIDE", wide).otherwise(other)
    return out.withColumns({"severity": of_regime("critical", "high", "low"), "confidence": of_regime(0.95, 0.85, 0.6)})


def tape_absorption(inputs: DataFrame, tape: DataFrame, ratio: float = 2.0, bps: float = 50.0, least: int = 10) -> DataFrame:
    """Tape windows with much volume while the spread last seen was tight. A window stands at the sequence of its last trade, after the book of that number."""
    t = tape.where("total_volume > 0").select(*KEYS, F.col("seq_last").alias("seq"), "window_start", "total_volume")
    t = rolling(t, KEYS, "seq", 64, n=F.count("*"), mean=F.avg("total_volume"))
    b = inputs.where("spread_bps > 0").select(*KEYS, "seq", "spread_bps")
    u = b.withColumn("is_tape", F.lit(False)).unionByName(t.withColumn("is_tape", F.lit(True)), allowMissingColumns=True)
    seen = F.when(~F.col("is_tape"), F.struct("seq", "spread_bps"))
    u = running_before(u, KEYS, F.expr(f"seq div {STRETCH}"), ["seq", "is_tape"], _seen=(F.max, seen)).where("is_tape")
    u = u.withColumns({"spread_bps": F.col("_seen.spread_bps"), "volume_ratio": F.col("total_volume") / F.col("mean")}).drop("_seen")
    out = u.where( (F.col("n") >= least) & (F.col("spread_bps") <= bps) & (F.col("volume_ratio") >= ratio)).drop("is_tape", "n", "mean")
    return rated(out, (F.col("volume_ratio"), VOLUME_RATIO))
