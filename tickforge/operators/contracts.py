"""What messages and results have to keep to: books and ticks, stored artifacts, declared rules, classes of errors, drift between two versions of payloads."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.operators.reports import level_reason
from tickforge.workers import prepare


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _side_reason(side: str, descending: bool, whole: bool) -> Column:
    """The first fault of a side's levels: a level's own, a size of 0 where the side is whole, or an order that isn't best first."""
    levels = F.col(side)
    faults = F.filter(F.transform(levels, lambda x: level_reason(x["price"], x["size"])), lambda r: r.isNotNull())
    empty = F.exists(levels, lambda x: x["size"] == 0) if whole else F.lit(False)
    prices = F.transform(levels, lambda x: x["price"])
    ordered = F.array_sort(prices) if not descending else F.reverse(F.array_sort(prices))
    return F.when(F.size(faults) > 0, F.concat(F.lit(f"{side}_"), F.get(faults, F.lit(0)))).when(F.coalesce(empty, F.lit(False)), f"{side}_zero_qty").when(prices != ordered, f"{side}_order")


def snapshot_reason() -> Column:
    """Why a book snapshot (ts_ingest_ms, bids, asks) is invalid; null if it isn't."""
    return F.when(F.coalesce(F.col("ts_ingest_ms"), F.lit(0)) <= 0, "bad_time").otherwise(F.coalesce(_side_reason("bids", True, True), _side_reason("asks", False, True)))


def delta_reason() -> Column:
    """Why a book change is invalid: as a snapshot, save that sizes may be 0, and that its ids are above 0 and in order unless it is a snapshot."""
    ids = F.when(F.col("is_snapshot"), None).when((F.coalesce(F.col("first_id"), F.lit(0)) <= 0) | (F.coalesce(F.col("final_id"), F.lit(0)) <= 0), "update_ids").when(F.col("final_id") < F.col("first_id"), "update_order")
    return F.when(F.coalesce(F.col("ts_ingest_ms"), F.lit(0)) <= 0, "bad_time").otherwise(F.coalesce(_side_reason("bids", True, False), _side_reason("asks", False, False), ids))


def tick_reason(kind: str) -> Column:
    """Why a mark price, liquidation or open interest is invalid; null if it isn't."""
    late = F.when(F.coalesce(F.col("ts_ingest_ms"), F.lit(0)) <= 0, "bad_time")
    if kind == "mark_price":
        rate = F.col("funding_rate")
        return F.coalesce(F.when(~_finite(F.col("mark_price")), "non_finite").when(F.col("mark_price") <= 0, "non_positive_price").when(rate.isNotNull() & ~_finite(rate), "non_finite_rate"), late)
    if kind == "liquidation":
        bad = F.when(~_finite(F.col("price")) | ~_finite(F.col("size")), "non_finite").when(F.col("price") <= 0, "non_positive_price").when(F.col("size") <= 0, "non_positive_size")
        return F.coalesce(bad, F.when(~F.coalesce(F.col("side").isin("buy", "sell"), F.lit(False)), "bad_side"), late)
    return F.coalesce(F.when(~_finite(F.col("open_interest")), "non_finite").when(F.col("open_interest") < 0, "negative"), late)


# Conditions that stored artifacts keep, for quality.broken_rules.
STATS_RULES = {
    "volumes": "coalesce(liq_volume, 0) >= 0 and coalesce(liq_buy_volume, 0) >= 0 and coalesce(liq_sell_volume, 0) >= 0",
    "total": "abs(coalesce(liq_volume, 0) - coalesce(liq_buy_volume, 0) - coalesce(liq_sell_volume, 0)) < 1e-6",
    "sequence": "seq_first is null or seq_first <= seq_last",
    "mark_positive": "mark_count = 0 or least(mark_open, mark_high, mark_low, mark_close) > 0",
    "mark_range": "mark_count = 0 or mark_high >= greatest(mark_open, mark_close, mark_low) and mark_low <= least(mark_open, mark_close)",
}
PROFILE_RULES = {
    "prices": "price_high > price_low and not isnan(price_low) and abs(price_high) < double('infinity')",
    "volumes": "buy_volume >= 0 and sell_volume >= 0 and total_volume >= 0",
    "total": "abs(total_volume - buy_volume - sell_volume) < 1e-6",
    "sequence": "seq_min > 0 and seq_max >= seq_min",
    "unique": "copies = 1",
}
HEATMAP_RULES = {
    "prices": "price_high >= price_low and not isnan(price_low) and abs(price_high) < double('infinity')",
    "size_class": "trim(size_class) <> ''",
    "volumes": "bid_liquidity >= 0 and ask_liquidity >= 0 and trade_volume >= 0",
    "sequence": "seq_min > 0 and seq_max >= seq_min",
    "samples": "samples > 0",
    "unique": "copies = 1",
}


def with_copies(cells: DataFrame, key: list[str]) -> DataFrame:
    """Adds copies: how many rows have the key. Keys are counted before the shuffle, and a cell with very many copies is joined, not gathered."""
    return cells.join(cells.groupBy(*key).agg(F.count("*").alias("copies")), key)


#: Codes of errors that can never succeed, and those that may later.
POISON = ("validation_failed", "invalid_argument", "not_found", "conflict", "out_of_order", "duplicate", "integrity_violation")
POISON_REASONS = ("unknown_event_type", "unknown_event_version", "decode_failed", "validation_failed")


def ingest_decision(code: Column, reason: Column, retryable: Column, decode: Column) -> Column:
    """disposition (ack, term, nak), reason_code and quarantine of a message by the error it met.

    No code: ack. A reason that names a poison, or a code that can never succeed: term, and quarantine. What may be tried again, is
    unavailable, an internal error that isn't one of decoding (decode), or any other code: nak, without quarantine.
    """
    made = lambda d, r, q: F.struct(F.lit(d).alias("disposition"), (r if isinstance(r, Column) else F.lit(r)).alias("reason_code"), F.lit(q).alias("quarantine"))
    named = F.lower(F.trim(F.coalesce(reason, F.lit(""))))
    again = F.coalesce(retryable, F.lit(False)) | (code == "unavailable") | ((code == "internal") & ~F.coalesce(decode, F.lit(False)))
    return F.when(F.coalesce(code, F.lit("")) == "", made("ack", "ok", False)).when(named.isin(*POISON_REASONS), made("term", named, True)).when(again, made("nak", "transient_failure", False)).when(code.isin(*POISON), made("term", "validation_failed", True)).otherwise(made("nak", "transient_failure", False))


def newest_configs(configs: DataFrame) -> DataFrame:
    """Of each binding the active configuration of the highest version: binding, config_version, rules (kind, field, expected)."""
    return configs.where("active").groupBy("binding").agg(F.max_by(F.struct("version", "rules"), "version").alias("_c")).select("binding", F.col("_c.version").alias("config_version"), F.col("_c.rules").alias("rules"))


def rule_results(messages: DataFrame, configs: DataFrame) -> DataFrame:
    """status (passed, failed, error) and violations (rule, field, reason) of each message (binding, payload), by its binding's newest configuration.

    error: no configuration (runtime.active_config), or a payload that isn't a JSON object (payload). A field that is there but null is there
    for `required`, empty for `not_empty`. The configurations are joined by binding; whether they are broadcast is Spark's to say by their size.
    """
    m = messages.join(newest_configs(configs), "binding", "left").withColumn("_p", F.from_json("payload", "map<string,string>"))
    whole = F.trim("payload").startswith("{") & F.col("_p").isNotNull() & F.try_parse_json("payload").isNotNull()
    violation = lambda rule, field, reason: F.struct(rule.alias("rule"), field.alias("field"), reason.alias("reason"))

    def check(r: Column) -> Column:
        there, got = F.map_contains_key("_p", r["field"]), F.col("_p")[r["field"]]
        bare = F.trim(F.coalesce(got, F.lit("")))
        reason = (
            F.when((r["kind"] == "required") & ~there, "missing_required_field").when((r["kind"] == "not_empty") & (~there | bare.isin("", "[]", "{}")), "field_must_not_be_empty")
            .when((r["kind"] == "equals") & (~there | ~got.eqNullSafe(r["expected"])), "field_must_equal_expected_value")
        )
        return F.when(reason.isNotNull(), violation(F.concat_ws(":", r["kind"], r["field"]), r["field"], reason))

    text = F.lit
    one = lambda rule, reason: F.array(violation(text(rule), text(""), text(reason)))
    found = F.filter(F.transform("rules", check), lambda v: v.isNotNull())
    out = F.when(F.col("rules").isNull(), one("runtime.active_config", "active_config_not_found")).when(~F.coalesce(whole, F.lit(False)), one("payload", "payload_decode_failed")).otherwise(found)
    status = F.when(F.col("rules").isNull() | ~F.coalesce(whole, F.lit(False)), "error").when(F.size(out) > 0, "failed").otherwise("passed")
    return m.withColumns({"violations": out, "status": status}).drop("_p", "rules")


def _object(text: str | None) -> dict:
    """A payload's object; none for what isn't one."""
    try:
        out = json.loads(text)
    except (TypeError, ValueError):
        return {}
    return out if isinstance(out, dict) else {}


def _differences(golden, actual, path: str) -> Iterator[tuple[str, str, str | None, str | None]]:
    """kind, path (a.b[0].c), expected and actual as JSON. Objects are compared by fields and lists by places, whatever else by value; a field or place that one lacks is told once."""
    if isinstance(golden, dict) and isinstance(actual, dict):
        pairs = [(f"{path}.{k}" if path else k, k in golden, k in actual, golden.get(k), actual.get(k)) for k in sorted({*golden, *actual})]
    elif isinstance(golden, list) and isinstance(actual, list):
        n, m = len(golden), len(actual)
        pairs = [(f"{path}[{k}]", k < n, k < m, golden[k] if k < n else None, actual[k] if k < m else None) for k in range(max(n, m))]
    else:
        if golden != actual or isinstance(golden, bool) != isinstance(actual, bool):
            yield "mismatch", path, json.dumps(golden, sort_keys=True), json.dumps(actual, sort_keys=True)
        return
    for at, before, after, x, y in pairs:
        if before and after:
            yield from _differences(x, y, at)
        elif after:
            yield "new", at, None, json.dumps(y, sort_keys=True)
        else:
            yield "dropped", at, json.dumps(x, sort_keys=True), None


def payload_drift(golden: DataFrame, actual: DataFrame, key: list[str], payload: str = "payload") -> DataFrame:
    """Fields of JSON payloads that differ between two versions of the same messages: key, kind (mismatch, new, dropped), path, expected, actual, compatible.

    compatible tells of the whole message: nothing differs but new fields. Messages that only one version has aren't compared (quality.drift
    tells them). A payload that isn't a JSON object counts as an empty one. Both versions meet in one join by key.
    """
    prepare(golden.sparkSession)
    both = golden.select(*key, F.col(payload).alias("_golden")).join(actual.select(*key, F.col(payload).alias("_actual")), key)
    kinds = dict(both.dtypes)
    names = ["kind", "path", "expected", "actual"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, additive = [], [], []
            for k, (x, y) in enumerate(zip(batch.column("_golden").to_pylist(), batch.column("_actual").to_pylist())):
                some = list(_differences(_object(x), _object(y), "")) if x != y else []
                at += [k] * len(some)
                found += some
                additive += [all(d[0] == "new" for d in some)] * len(some)
            whole = batch.select(key).take(pa.array(at, pa.int64()))
            cols = zip(*found) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([*whole.columns, *(pa.array(c, pa.string()) for c in cols), pa.array(additive, pa.bool_())], names=[*key, *names, "compatible"])

    return both.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in key) + ", kind string, path string, expected string, actual string, compatible boolean")
