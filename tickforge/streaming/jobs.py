"""Streaming builders: the batch operators' windows over watermarked streams, and keyed sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions.columns import SCALE, fixed, unfixed
from tickforge.operators.signals import SPREAD_Z
from tickforge.streaming.tables import written


def stream_candles(trades: DataFrame, length: str = "1 minute") -> DataFrame:
    """Candles of event-time windows (append mode): first and last price by exchange time."""
    t = trades.withColumns({"p": fixed(F.col("price")), "q": fixed(F.col("quantity"))})
    g = t.groupBy("venue", "symbol", F.window("event_time", length).alias("w"))
    out = g.agg(F.min_by("p", F.struct("ts_exchange_ms", "trade_id")).alias("o"), F.max("p").alias("h"), F.min("p").alias("l"), F.max_by("p", F.struct("ts_exchange_ms", "trade_id")).alias("c"), F.sum("q").alias("v"), F.count("*").alias("trade_count"))
    return out.select("venue", "symbol", F.unix_millis("w.start").alias("window_start"), *(unfixed(F.col(a)).alias(b) for a, b in zip("ohlcv", ("open", "high", "low", "close", "volume"))), "trade_count")


def without_repeats(stream: DataFrame, key: str = "trade_id") -> DataFrame:
    """Rows whose key hasn't come within the watermark."""
    return stream.dropDuplicatesWithinWatermark(["venue", "symbol", key])


def _earlier(spark: SparkSession, path: str, epoch: int) -> DataFrame | None:
    """The rows of batches before this one in a table of batch=N folders; None where there are none. tables has sinks that read less."""
    if not any(k < epoch for k in written(spark, path)):
        return None
    return spark.read.parquet(path).where(F.col("batch") < epoch)


def first_write_wins(path: str, key: list[str], order: str):
    """A foreachBatch sink: of each key the first row, by `order` within a batch and by batch over all, is kept.

    A batch's folder is overwritten whole and compared with earlier batches alone, so a batch that is repeated after a failure does no harm.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        rest = [c for c in batch.columns if c not in key]
        fresh = batch.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*key, "r.*").select(*batch.columns)
        old = _earlier(batch.sparkSession, path, epoch)
        if old is not None:
            fresh = fresh.join(old.select(*key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return write


def late_apart(path: str, late_path: str, time_col: str, ms: int):
    """A foreachBatch sink with a side table: rows more than ms behind the latest time of earlier batches go to late_path, with how late they are."""

    def write(batch: DataFrame, epoch: int) -> None:
        old = _earlier(batch.sparkSession, path, epoch)
        top = old.agg(F.max(time_col)).first()[0] if old is not None else None
        late = F.lit(False) if top is None else F.col(time_col) < top - ms
        batch.where(~late).write.mode("overwrite").parquet(f"{path}/batch={epoch}")
        batch.where(late).withColumn("late_ms", F.lit(top).cast("long") - F.col(time_col)).write.mode("overwrite").parquet(f"{late_path}/batch={epoch}")

    return write


def fan_out(path: str, artifacts: dict[str, Callable[[DataFrame], DataFrame]]):
    """A foreachBatch sink that makes several artifacts of one input, which is read once: each goes to a folder of its own."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            for name, make in artifacts.items():
                make(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={epoch}")
        finally:
            batch.unpersist()

    return write


def last_write_wins(path: str, key: list[str], order: str):
    """A foreachBatch sink: each batch becomes a version of its own under `path`; current() reads the newest row of each key.

    Nothing is rewritten in place, so a lost executor or a repeated batch does no harm: a batch's folder is overwritten whole.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.groupBy(*key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*").write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return write


def current(table: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row of each key over all batches."""
    return table.groupBy(*key).agg(F.max_by(F.struct(*table.columns), F.struct(F.col(order), F.col("batch"))).alias("r")).select("r.*").drop("batch")


_OPEN = "window_start long, open double, high double, low double, close double, volume long, trade_count long, late long"
_CLOSED = "venue string, symbol string, window_start long, open double, high double, low double, close double, volume double, trade_count long, late long"


def _in_order(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """What a trigger brings for one key, in order: rows reach an operator in any. The source's maxFilesPerTrigger or maxBytesPerTrigger bounds it."""
    return pd.concat(list(frames)).sort_values(order, kind="stable")


def stream_strict_candles(trades: DataFrame, ms: int, order: tuple[str, ...] = ("ts_ingest_ms", "trade_id")) -> DataFrame:
    """Candles with one open window a series: a trade of a newer window closes it and what is older is late, however little.

    Trades come in the `order` of arrival within a trigger. Volumes add up in fixed point. `late` counts the late trades since the window
    before was closed. The last window stays open as state.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, out = list(state.get) if state.exists else None, []
        rows = _in_order(frames, list(order))
        sizes = np.rint(rows["quantity"].to_numpy() * SCALE).astype(np.int64).tolist()
        for at, price, size in zip(rows["ts_exchange_ms"].tolist(), rows["price"].tolist(), sizes):
            start = at - at % ms
            if now is None or start > now[0]:
                if now is not None:
                    out.append((*key, *now[:5], now[5] / SCALE, *now[6:]))
                now = [start, price, price, price, price, size, 1, 0]
            elif start < now[0]:
                now[7] += 1
            else:
                now[2], now[3], now[4] = max(now[2], price), min(now[3], price), price
                now[5], now[6] = now[5] + size, now[6] + 1
        if now is not None:
            state.update(tuple(now))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _CLOSED.split(", ")])

    return trades.groupBy("venue", "symbol").applyInPandasWithState(run, _CLOSED, _OPEN, "append", "NoTimeout")


def stream_cvd(trades: DataFrame, ms: int, order: tuple[str, ...] = ("ts_ingest_ms", "trade_id")) -> DataFrame:
    """The running delta (bought less sold) of each series as each window of ms closes, by the first trade of a later one; sums in fixed point."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        start, delta, total = state.get if state.exists else (-1, 0, 0)
        rows, out = _in_order(frames, list(order)), []
        signed = np.rint(rows["quantity"].to_numpy() * SCALE).astype(np.int64) * np.where(rows["side"] == "buy", 1, np.where(rows["side"] == "sell", -1, 0))
        for at, size in zip(rows["ts_exchange_ms"].tolist(), signed.tolist()):
            if at - at % ms > start:
                if start >= 0:
                    total += delta
                    out.append((*key, start, delta / SCALE, total / SCALE))
                start, delta = at - at % ms, 0
            delta += size
        state.update((start, delta, total))
        yield pd.DataFrame(out, columns=["venue", "symbol", "window_start", "delta", "cvd"])

    return trades.groupBy("venue", "symbol").applyInPandasWithState(run, "venue string, symbol string, window_start long, delta double, cvd double", "window_start long, delta long, total long", "append", "NoTimeout")


def stream_cross_venue(trades: DataFrame, order: tuple[str, ...] = ("ts_ingest_ms", "trade_id")) -> DataFrame:
    """For each trade, once two venues are known, the lowest and highest of the venues' last prices in its symbol; the state is a price a venue."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        prices, out = (dict(zip(*state.get)) if state.exists else {}), []
        rows = _in_order(frames, list(order))
        for venue, trade_id, price in zip(rows["venue"].tolist(), rows["trade_id"].tolist(), rows["price"].tolist()):
            prices[venue] = price
            if len(prices) >= 2:
                low, high = min((p, v) for v, p in prices.items()), min((-p, v) for v, p in prices.items())
                out.append((*key, trade_id, len(prices), low[0], low[1], -high[0], high[1]))
        state.update((list(prices), list(prices.values())))
        yield pd.DataFrame(out, columns=["symbol", "trade_id", "venues", "min_price", "min_venue", "max_price", "max_venue"])

    return trades.groupBy("symbol").applyInPandasWithState(run, "symbol string, trade_id string, venues long, min_price double, min_venue string, max_price double, max_venue string", "venues array<string>, prices array<double>", "append", "NoTimeout")


_EVIDENCE = "venue string, instrument string, seq long, ts_ingest_ms long, spread_bps double, z double, severity string, confidence double"


def stream_spread_explosions(inputs: DataFrame, z: float = 2.5, bps: float = 10.0, least: int = 10, ms: int = 5000, rows: int = 64) -> DataFrame:
    """signals.spread_explosion and its cooldown over a stream of book inputs: the state of a series is its last `rows` spreads and when it last told."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ring, told = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        d, out = _in_order(frames, ["ts_ingest_ms", "seq"]), []
        d = d[(d["bid"] > 0) & (d["ask"] > d["bid"])]
        for seq, ts, spread in zip(d["seq"].tolist(), d["ts_ingest_ms"].tolist(), d["spread_bps"].tolist()):
            ring = [*ring[-(rows - 1) :], spread]
            deviation = float(np.std(ring))
            score = (spread - float(np.mean(ring))) / deviation if deviation > 1e-9 else 0.0
            if len(ring) >= least and score > z and spread > bps and (told is None or ts - told >= ms):
                told = ts
                step = sum(score >= x for x in SPREAD_Z)
                out.append((*key, seq, ts, spread, score, ("medium", "high", "critical")[step], (0.70, 0.85, 0.95)[step]))
        state.update((ring, told))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _EVIDENCE.split(", ")])

    return inputs.groupBy("venue", "instrument").applyInPandasWithState(run, _EVIDENCE, "ring array<double>, told long", "append", "NoTimeout")
