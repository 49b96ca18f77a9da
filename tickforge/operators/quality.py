"""Data quality: validation, de-duplication, sequence audit, gaps, drift and consistency of result sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.operators.windows import numbered, running_before

KEYS = ["venue", "instrument"]


def trade_reason() -> Column:
    """Why a trade is invalid; null if it isn't."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return (
        F.when(bad("price") | bad("size"), "non_finite").when(F.col("price") <= 0, "non_positive_price").when(F.col("size") <= 0, "non_positive_size")
        .when(~F.coalesce(F.col("side").isin("buy", "sell"), F.lit(False)), "bad_side").when(F.coalesce(F.trim("trade_id"), F.lit("")) == "", "empty_id").when(F.coalesce(F.col("ts_ingest_ms"), F.lit(0)) <= 0, "bad_time")
    )


def validated(trades: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid trades, and invalid ones with their reason."""
    t = trades.withColumn("reason", trade_reason())
    return t.where("reason is null").drop("reason"), t.where("reason is not null")


def first_of_each(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. Rows are combined before the shuffle, so a key with very many rows is no burden."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*").select(*df.columns)


#: Length, in ms of arrival, of the stretches that audits by order of arrival are cut into.
STRETCH_MS = 3_600_000


def sequence_audit(df: DataFrame, window: int = 2048) -> DataFrame:
    """verdict of each row against the highest sequence before it in arrival order."""
    out = running_before(df, KEYS, F.expr(f"ts_ingest_ms div {STRETCH_MS}"), ["ts_ingest_ms", "event_id"], top=(F.max, F.struct("seq", "ts_ingest_ms")))
    out = out.withColumns({"top_seq": F.col("top.seq"), "top_ts": F.col("top.ts_ingest_ms")}).drop("top")
    verdict = F.when(F.col("seq") < 0, "seq_invalid").when(F.col("top_seq").isNull() | (F.col("seq") > F.col("top_seq")), "accept").when(F.col("seq") == F.col("top_seq"), "replay_duplicate").when((F.col("ts_ingest_ms") < F.col("top_ts")) | (F.col("top_seq") - F.col("seq") <= window), "stale_event").otherwise("seq_non_monotonic")
    return out.withColumn("verdict", verdict)


def window_gaps(windows: DataFrame, ms: int) -> DataFrame:
    """Runs of missing windows between those present: gap_start, gap_end, missing."""
    w = windows.select(*KEYS, "window_start").distinct()
    nxt = F.lead("window_start").over(Window.partitionBy(*KEYS).orderBy("window_start"))
    out = w.withColumn("next", nxt).where(F.col("next") > F.col("window_start") + ms)
    return out.select(*KEYS, (F.col("window_start") + ms).alias("gap_start"), F.col("next").alias("gap_end"), F.expr(f"(next - window_start) div {ms} - 1").alias("missing"))


def rule_violations(payloads: DataFrame, rules: list[tuple[str, str, str | None]]) -> DataFrame:
    """Of JSON payloads (id, payload): violated rules (kind required, not_empty or equals; field; value) and the status."""
    found = []
    for kind, field, value in rules:
        got = F.get_json_object("payload", f"$.{field}")
        broken = got.isNull() if kind == "required" else F.coalesce(F.trim(got), F.lit("")) == "" if kind == "not_empty" else ~got.eqNullSafe(F.lit(value))
        found.append(F.when(broken, F.lit(f"{kind}:{field}")))
    out = payloads.withColumn("violations", F.array_compact(F.array(*found)))
    return out.withColumn("status", F.when(F.size("violations") == 0, "passed").otherwise("failed"))


def drift(left: DataFrame, right: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Fields that differ between two result sets, and rows that only one has."""
    a, b = left.select(*key, F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias("a")), right.select(*key, F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias("b"))
    j = a.join(b, key, "full_outer")
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").alias("expected"), F.col(f"b.{f}").alias("actual")) for f in fields))
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "dropped").otherwise("mismatch")
    out = j.withColumn("kind", state).withColumn("f", F.explode(pairs))
    return out.where("kind = 'mismatch' and not (f.expected <=> f.actual) or kind <> 'mismatch' and f.field = '%s'" % fields[0]).select(*key, "kind", F.when(F.col("kind") == "mismatch", F.col("f.field")).alias("field"), F.when(F.col("kind") == "mismatch", F.col("f.expected")).alias("expected"), F.when(F.col("kind") == "mismatch", F.col("f.actual")).alias("actual"))


def consistency(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Per series: rows of either tier, rows in both, missing either way, and bounds."""
    h, c = hot.select(*KEYS, "window_start", F.lit(True).alias("h")), cold.select(*KEYS, "window_start", F.lit(True).alias("c"))
    j = h.join(c, [*KEYS, "window_start"], "full_outer")
    return j.groupBy(*KEYS).agg(F.count("h").alias("hot_count"), F.count("c").alias("cold_count"), F.count_if(F.col("h") & F.col("c")).alias("overlap"), F.count_if(F.col("h").isNull()).alias("missing_hot"), F.count_if(F.col("c").isNull()).alias("missing_cold"), F.min("window_start").alias("first_ts"), F.max("window_start").alias("last_ts"))


def latest_tier(hot: DataFrame, cold: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both tiers by key; the hot one where both have it."""
    both = hot.withColumn("tier", F.lit(0)).unionByName(cold.withColumn("tier", F.lit(1)))
    return first_of_each(both, key, ["tier"])


def merged_upsert(current: DataFrame, changes: DataFrame, key: list[str], op: str, sums: list[str]) -> DataFrame:
    """Additive upsert: each operation counts once per key, sums add, sequence bounds widen."""
    once = changes.dropDuplicates([*key, op]).drop(op)
    both = current.unionByName(once.select(*current.columns))
    return both.groupBy(*key).agg(*(F.sum(x).alias(x) for x in sums), F.min("seq_min").alias("seq_min"), F.max("seq_max").alias("seq_max"))


def envelope_reason() -> Column:
    """The first field of an envelope that is invalid; null if none is."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    checks = [(blank("type"), "type"), (F.coalesce(F.col("version") < 1, F.lit(True)), "version"), (blank("venue"), "venue"), (blank("instrument"), "instrument"), (F.coalesce(F.col("ts_ingest") <= 0, F.lit(True)), "ts_ingest"), (F.coalesce(F.col("seq") < 0, F.lit(True)), "seq"), (blank("idempotency_key"), "idempotency_key"), (blank("payload"), "payload")]
    return F.coalesce(*(F.when(c, name) for c, name in checks))


def quarantined(envelopes: DataFrame, known: dict[str, int], most: int = 512) -> DataFrame:
    """Rows that can never succeed, with reason, error (at most `most` characters), source columns and the payload's digest. known: type and its version."""
    version = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))[F.col("type")]
    field = envelope_reason()
    reason = F.when(field.isNotNull(), "validation_failed").when(version.isNull(), "unknown_event_type").when(version != F.col("version"), "unknown_event_version").when(F.from_json("payload", "map<string,string>").isNull(), "decode_failed")
    error = F.substring(F.concat_ws(" ", F.coalesce(field, F.lit("")), "type", F.col("version").cast("string")), 1, most)
    return envelopes.withColumns({"reason": reason, "error": error, "payload_sha256": F.sha2("payload", 256)}).where("reason is not null").drop("payload")


# Conditions that stored candles keep; a candle that breaks one is reported under its name.
CANDLE_RULES = {
    "high": "high >= greatest(open, close, low)",
    "low": "low <= least(open, close, high)",
    "positive": "open > 0 and high > 0 and low > 0 and close > 0",
    "volume": "abs(volume - buy_volume - sell_volume) < 1e-6",
    "sequence": "seq_first <= seq_last",
    "window": "window_end > window_start",
}
TAPE_RULES = {"counts": "trade_count = buy_count + sell_count", "volume": "abs(total_volume - buy_volume - sell_volume) < 1e-6", "prices": "min_price <= last_price and last_price <= max_price"}


def broken_rules(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """A row for each rule that a row breaks, as `rule`; a rule that is null counts as broken."""
    hit = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(text), F.lit(False)), name) for name, text in rules.items())))
    return df.withColumn("rule", F.explode(hit))


def run_expectations(df: DataFrame, *columns: str) -> DataFrame:
    """Rows and a sum of digests that doesn't depend on their order, to hold two runs against each other."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in columns))), 1, 8), 16, 10).cast("long")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(digest), F.lit(0)).alias("digest"))


def latest_versions(df: DataFrame, key: list[str], version: str) -> DataFrame:
    """Of each key the row of the highest version."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), version).alias("_r")).select("_r.*")


def lateness(df: DataFrame, ms: int, time_col: str, arrival: list[str], keys: list[str], stretch: int = 8192) -> DataFrame:
    """Adds window_start and is_late: a row of a later window came before. One window is open per series; a newer one closes it.

    The first column of arrival is a number; series are cut where it passes multiples of `stretch`.
    """
    start = F.col(time_col) - F.pmod(F.col(time_col), F.lit(ms))
    out = running_before(df.withColumn("window_start", start), keys, F.expr(f"{arrival[0]} div {stretch}"), arrival, _top=(F.max, F.col("window_start")))
    return out.withColumn("is_late", F.coalesce(F.col("_top") > F.col("window_start"), F.lit(False))).drop("_top")


def caught_up(df: DataFrame, skew_ms: int, arrival: list[str], keys: list[str], time_col: str = "ts_ingest_ms", stretch: int = 8192) -> DataFrame:
    """Rows that don't lag the latest time seen before them by more than skew_ms. Cut into stretches as lateness is."""
    out = running_before(df, keys, F.expr(f"{arrival[0]} div {stretch}"), arrival, _top=(F.max, F.col(time_col)))
    return out.where(F.col("_top").isNull() | (F.col("_top") - F.col(time_col) <= skew_ms)).drop("_top")


def newest(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The n newest rows of each key. Spark keeps n rows a key in each task before the shuffle (WindowGroupLimit), so no task gets a whole key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("_k") <= n).drop("_k")


def thinned(df: DataFrame, keys: list[str], order: str, every: int, always: Column, stretch: int = 86_400_000) -> DataFrame:
    """Every so manieth row of each key by `order`, a number, and those that `always` holds for. Rows are counted within stretches of the order, and the stretches before are added."""
    return numbered(df, keys, F.expr(f"{order} div {stretch}"), [order], "_k").where((F.col("_k") % every == 0) | always).drop("_k")
