"""Column functions: names, sides, fixed point, windows, features and ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE, FUNDING_SCALE = 100_000_000, 1_000_000_000
# Timeframes in milliseconds, burst limits, quotes.
TIMEFRAMES = {"250ms": 250, "1s": 1000, "5s": 5000, "1m": 60_000, "5m": 300_000, "15m": 900_000, "30m": 1_800_000, "1h": 3_600_000, "4h": 14_400_000, "1d": 86_400_000}
#: Trades of a window above which it is a burst.
BURST = {"250ms": 25, "1s": 80, "5s": 300}
#: Order matters: the first suffix that fits names the quote.
QUOTES = ("USDT", "USDC", "BUSD", "USD", "EUR", "BTC", "ETH")


def venue_name(x: Column) -> Column:
    return F.upper(F.trim(x))


def instrument_name(x: Column) -> Column:
    return F.translate(F.upper(F.trim(x)), "/-_.", "")


def lower_name(x: Column) -> Column:
    """Event types and timeframes."""
    return F.lower(F.trim(x))


def without_market(instrument: Column) -> Column:
    """The instrument without a market type after a colon."""
    return F.substring_index(instrument, ":", 1)


def is_identifier(x: Column) -> Column:
    """Letters, digits and - _ . / alone, and not blank."""
    return F.coalesce(x.rlike(r"^[\p{L}\p{Nd}._/-]+$"), F.lit(False))


def floored(x: Column, digits: int) -> Column:
    return F.floor(x * 10.0**digits) / 10.0**digits


def subject_parts(text: Column) -> Column:
    """type, venue, symbol and timeframe of a subject, and the fifth part of a signal's; null where there are fewer than four or more than five, or a blank one."""
    parts = F.split(F.trim(text), "/")
    whole = F.size(parts).isin(4, 5) & ~F.exists(parts, lambda p: F.trim(p) == "")
    return F.when(whole, F.struct(*(F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(("kind", "venue", "symbol", "timeframe", "signal")))))


def side_name(x: Column) -> Column:
    """buy or sell from the venues' spellings; null for anything else."""
    s = F.lower(F.trim(x))
    return F.when(s.isin("buy", "bid", "b"), "buy").when(s.isin("sell", "ask", "a", "s"), "sell")


def base_quote(symbol: Column) -> Column:
    """BASE-QUOTE by the first quote that ends the symbol; the symbol itself if none does."""
    out = symbol
    for q in reversed(QUOTES):
        out = F.when(symbol.endswith(q) & (F.length(symbol) > len(q)), F.concat(F.regexp_extract(symbol, f"^(.+){q}$", 1), F.lit(f"-{q}"))).otherwise(out)
    return out


def fixed(x: Column, scale: int = SCALE) -> Column:
    """Whole number of 1/scale, half to even; null for what isn't finite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.rint(x * float(scale)).cast("long"))


def unfixed(x: Column, scale: int = SCALE) -> Column:
    return x / float(scale)


def window_start(ts: Column, ms: int) -> Column:
    return ts - F.pmod(ts, F.lit(ms))


def parse_ms(text: Column, received: Column) -> Column:
    """Milliseconds from RFC 3339 or a number of seconds or milliseconds; the receive time if empty."""
    number = text.try_cast("double")
    by_size = F.when(number >= 1e12, number.cast("long")).when(number >= 1e9, (number * 1000).cast("long")).when(number.isNotNull(), number.cast("long"))
    return F.when(F.trim(text) == "", received).otherwise(F.coalesce(by_size, F.unix_millis(F.try_to_timestamp(text)), received))


def share(part: Column, whole: Column) -> Column:
    """part / whole, or 0 where whole is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def spread_bps_or_minus_one(bid: Column, ask: Column) -> Column:
    return F.when((bid > 0) & (ask > 0), (ask - bid) / ((ask + bid) / 2) * 10_000).otherwise(-1.0)


def spread_bps_or_zero(bid: Column, ask: Column) -> Column:
    return F.when((bid > 0) & (ask > 0) & (ask >= bid), (ask - bid) / ((ask + bid) / 2) * 10_000).otherwise(0.0)


def imbalance(buy: Column, sell: Column) -> Column:
    return share(buy - sell, buy + sell)


def decayed(base: Column, age_ms: Column, half_life_ms: float) -> Column:
    """Confidence that halves every half_life_ms, within [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * F.pow(F.lit(0.5), age_ms / half_life_ms)))


def ladder(x: Column, steps: list[tuple[float, str]], least: str) -> Column:
    """The name of the highest step that x reaches; steps from high to low."""
    out = None
    for limit, name in steps:
        out = F.when(x >= limit, name) if out is None else out.when(x >= limit, name)
    return out.otherwise(least)


def size_class(x: Column) -> Column:
    return F.when(x < 0.25, "XS").when(x < 1, "S").when(x < 5, "M").when(x < 20, "L").otherwise("XL")


def flags(*conditions: Column) -> Column:
    """Bit k is set where condition k holds."""
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions)), F.lit(0))


def subject(kind: Column, venue: Column, symbol: Column, timeframe: Column) -> Column:
    return F.concat_ws("/", kind, venue, symbol, timeframe)


def event_category(kind: Column) -> Column:
    """close_final, telemetry, snapshot, delta or unknown, by the name of an event type; the first that fits."""
    k = F.lower(F.trim(kind))
    return F.when(k.rlike(r"\.close|\.final|_close$|_final$|window_close"), "close_final").when(k.contains("telemetry"), "telemetry").when(k.rlike(r"\.snapshot|_snapshot$"), "snapshot").when(k.rlike(r"\.delta|_delta$|bookdelta$"), "delta").otherwise("unknown")


def event_type_of(subject: Column) -> Column:
    """The event type of a subject: what stands before the first slash, up to the first part that is a version (v1, v2, ..)."""
    head = F.substring_index(F.lower(F.trim(subject)), "/", 1)
    return F.regexp_replace(head, r"(^|\.)v[0-9]+(\..*)?$", "")


def subject_category(subject: Column) -> Column:
    """event_category of the event type of a subject."""
    return event_category(event_type_of(subject))


def content_key(id: Column, *content: Column) -> Column:
    """The source's id, or a digest of the content where it gave none."""
    return F.coalesce(F.when(F.trim(id) != "", F.trim(id)), F.sha2(F.concat_ws("|", *(c.cast("string") for c in content)), 256))


def metric_list(metrics: Column, most: int = 8) -> Column:
    """The finite values of a map as (key, value), sorted by key, at most `most`."""
    finite = lambda x: x["value"].isNotNull() & ~F.isnan(x["value"]) & (F.abs(x["value"]) < float("inf"))
    return F.slice(F.array_sort(F.filter(F.map_entries(metrics), finite)), 1, most)


def fragments(texts: Column, most: int = 4, length: int = 120) -> Column:
    """Trimmed texts that aren't blank, at most `most` of at most `length` characters."""
    return F.slice(F.filter(F.transform(texts, lambda x: F.substring(F.trim(x), 1, length)), lambda x: x != ""), 1, most)
