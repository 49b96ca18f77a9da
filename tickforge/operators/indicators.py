"""Textbook indicators over candles, as window functions with bounded frames.

Averages with infinite memory look back eight times their length, where what is left out weighs less than 1e-6.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.columns import window_start

KEYS = ["venue", "instrument"]
DAY = 86_400_000


def _rows(n: int) -> Window:
    return Window.partitionBy(*KEYS).orderBy("window_start").rowsBetween(-(n - 1), 0)


def ema(x: Column, length: int) -> Column:
    """Exponential moving average with factor 2 / (length + 1), its weights normalised."""
    stay = 1 - 2 / (length + 1)
    start = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w"))
    s = F.aggregate(F.collect_list(x).over(_rows(8 * length)), start, lambda a, y: F.struct((a["v"] * stay + y).alias("v"), (a["w"] * stay + 1).alias("w")))
    return s["v"] / s["w"]


def moving(candles: DataFrame, length: int = 20, width: float = 2.0) -> DataFrame:
    """Simple mean of closes, bands of `width` standard deviations, and the day's volume-weighted typical price so far."""
    w = _rows(length)
    day = Window.partitionBy(*KEYS, "day").orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    c = candles.withColumns({"day": window_start(F.col("window_start"), DAY), "n": F.count("*").over(w), "sma": F.avg("close").over(w), "sd": F.stddev_pop("close").over(w)})
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    c = c.withColumns({"upper": F.col("sma") + width * F.col("sd"), "lower": F.col("sma") - width * F.col("sd"), "vwap": F.try_divide(F.sum(typical * F.col("volume")).over(day), F.sum("volume").over(day))})
    return c.where(F.col("n") == length).drop("day", "n", "sd")


def strength(candles: DataFrame, length: int = 14) -> DataFrame:
    """rsi: 100 times the share of rises in the moves of the last closes; 50 where there was no move."""
    c = candles.withColumn("move", F.col("close") - F.lag("close").over(Window.partitionBy(*KEYS).orderBy("window_start")))
    w = _rows(length)
    c = c.withColumns({"n": F.count("move").over(w), "up": F.sum(F.greatest("move", F.lit(0.0))).over(w), "all": F.sum(F.abs("move")).over(w)})
    return c.where(F.col("n") == length).withColumn("rsi", F.coalesce(F.try_divide(F.col("up") * 100, F.col("all")), F.lit(50.0))).drop("move", "n", "up", "all")


def macd(candles: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """macd (fast less slow average), its own average as signal, and their difference."""
    c = candles.withColumn("macd", ema(F.col("close"), fast) - ema(F.col("close"), slow))
    c = c.withColumn("signal", ema(F.col("macd"), signal))
    return c.withColumn("histogram", F.col("macd") - F.col("signal"))


def heikin_ashi(candles: DataFrame) -> DataFrame:
    """Averaged candles. The open halves what lies back with each bar, so 60 bars give it to the last digit of a double."""
    before = Window.partitionBy(*KEYS).orderBy("window_start").rowsBetween(-60, -1)
    c = candles.withColumn("ha_close", (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4)
    own = (F.col("open") + F.col("close")) / 2
    c = c.withColumn("ha_open", F.aggregate(F.collect_list("ha_close").over(before), F.coalesce(F.first(own).over(before), own), lambda a, x: (a + x) / 2))
    return c.withColumns({"ha_high": F.greatest("high", "ha_open", "ha_close"), "ha_low": F.least("low", "ha_open", "ha_close")})
