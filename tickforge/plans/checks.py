"""Queries that hold ticks, artifacts, messages and results against what they have to keep to."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickforge.functions.columns import event_type_of, subject_category
from tickforge.operators import books, contracts, profiles, quality, reports, signals, windows
from tickforge.plans.queries import BOUNDARY, K, query, rounded
from tickforge.sources import ticks

DAY = 86_400_000


def _every(n):
    return F.col("event_id") % n == 0


@query
def subject_categories(s, d):
    """Subjects with versions, stream and instrument, and what kind of event each names."""
    tail = F.element_at(F.array(*map(F.lit, [".delta.v2.x", "_snapshot", ".v1.close", ".window_close", ".telemetry.v3", ".v10", ".bookdelta"])), (F.col("event_id") % 7 + 1).cast("int"))
    e = ticks.events(s, d).withColumn("subject", F.concat(F.lit(" MD."), "event_type", tail, F.lit("/"), "venue", F.lit("/"), "instrument", F.lit(".v1.close")))
    return e.groupBy(event_type_of(F.col("subject")).alias("event_type"), subject_category(F.col("subject")).alias("category")).agg(F.count("*").alias("events"))


@query
def fused_cells(s, d):
    """Heatmap cells of all venues, the first 40 of each window, with what each venue adds."""
    h = profiles.heatmap(ticks.book_snapshots(s, d), ticks.dense(s, d), "1m", 2.0).withColumn("price_high", F.col("price_low") + 2.0)
    out = profiles.fused_cells(h, 40).withColumn("m", F.explode("venue_mix"))
    return rounded(out.select("instrument", "window_start", "price_low", "price_high", "size_class", "bid_liquidity", "ask_liquidity", "trade_volume", "samples", "m.venue", "m.volume", "m.weight"), 5)


@query
def invalid_books(s, d):
    """Books of which some have no time, a negative price, a level without size or levels out of order, as snapshots and as changes."""
    b = ticks.book_snapshots(s, d).withColumn("ts_ingest_ms", F.when(_every(107), 0).otherwise(F.col("ts_ingest_ms")))
    first = lambda side, price, size: F.concat(F.array(F.struct(price.alias("price"), size.alias("size"))), F.slice(side, 2, 1000))
    price, size = F.col("bids")[0]["price"], F.col("asks")[0]["size"]
    b = b.withColumns({
        "bids": F.when(_every(113), first("bids", -price, F.col("bids")[0]["size"])).when(_every(101), F.reverse("bids")).otherwise(F.col("bids")),
        "asks": F.when(_every(103), first("asks", F.col("asks")[0]["price"], size * 0)).otherwise(F.col("asks")),
    })
    c = b.withColumns({"is_snapshot": _every(2), "first_id": F.when(_every(127), 0).otherwise(F.col("event_id")), "final_id": F.col("event_id") - F.when(_every(109), 1).otherwise(0)})
    rows = b.select(*K, F.lit("snapshot").alias("kind"), contracts.snapshot_reason().alias("reason")).unionByName(c.select(*K, F.lit("delta").alias("kind"), contracts.delta_reason().alias("reason")))
    return rows.where("reason is not null").groupBy(*K, "kind", "reason").agg(F.count("*").alias("rows"))


@query
def invalid_marks(s, d):
    """Mark prices, liquidations and open interest with faults, by reason."""
    m = ticks.mark_prices(s, d).withColumns({"mark_price": F.when(_every(11), F.lit(float("nan"))).when(_every(13), F.lit(0.0)).otherwise(F.col("mark_price")), "funding_rate": F.when(_every(17), F.lit(float("inf"))).otherwise(F.col("funding_rate"))})
    l = ticks.liquidations(s, d).withColumns({"size": F.when(_every(11), F.lit(0.0)).otherwise(F.col("size")), "side": F.when(_every(13), F.lit(None)).otherwise(F.col("side")), "ts_ingest_ms": F.when(_every(17), 0).otherwise(F.col("ts_ingest_ms"))})
    o = ticks.open_interest(s, d).withColumn("open_interest", F.when(_every(11), F.lit(-1.0)).when(_every(13), F.lit(None)).otherwise(F.col("open_interest")))
    out = None
    for kind, rows in (("mark_price", m), ("liquidation", l), ("open_interest", o)):
        part = rows.select(*K, F.lit(kind).alias("kind"), contracts.tick_reason(kind).alias("reason"))
        out = part if out is None else out.unionByName(part)
    return out.where("reason is not null").groupBy(*K, "kind", "reason").agg(F.count("*").alias("rows"))


@query
def artifact_audit(s, d):
    """Stored statistics, profiles and heatmaps of which some are changed or doubled: what rules they break."""
    st = windows.stats(ticks.mark_prices(s, d), ticks.liquidations(s, d), "1h")
    st = st.withColumns({"liq_volume": F.when(F.expr("(window_start div 3600000) % 7 = 0"), F.col("liq_volume") + 1).otherwise(F.col("liq_volume")), "mark_low": F.when(F.expr("(window_start div 3600000) % 11 = 0"), F.col("mark_high") + 1).otherwise(F.col("mark_low"))})
    vp = profiles.volume_profile(ticks.trades(s, d))
    vp = vp.withColumn("total_volume", F.when(F.expr("(window_start div 3600000) % 7 = 0"), F.col("total_volume") + 1).otherwise(F.col("total_volume")))
    vp = vp.unionByName(vp.where("(window_start div 3600000) % 11 = 0"))
    hm = profiles.heatmap(ticks.book_snapshots(s, d), ticks.dense(s, d), "1m", 2.0).withColumn("price_high", F.col("price_low") + 2.0)
    hm = hm.withColumns({"samples": F.when(F.col("price_low") % 34 == 0, 0).otherwise(F.col("samples")), "seq_max": F.when(F.col("price_low") % 38 == 0, F.col("seq_min") - 1).otherwise(F.col("seq_max"))})
    key = [*K, "window_start", "price_low", "price_high"]
    parts = [("stats", st, contracts.STATS_RULES), ("profile", contracts.with_copies(vp, key), contracts.PROFILE_RULES), ("heatmap", contracts.with_copies(hm, [*key, "size_class"]), contracts.HEATMAP_RULES)]
    out = None
    for name, rows, rules in parts:
        part = quality.broken_rules(rows, rules).groupBy(*K, "rule").agg(F.count("*").alias("rows")).withColumn("artifact", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query
def ingest_decisions(s, d):
    """What becomes of messages by the error they met."""
    codes = ["", "validation_failed", "duplicate", "unavailable", "internal", "timeout", "conflict", "out_of_order", "internal"]
    e = ticks.events(s, d).withColumns({"code": F.element_at(F.array(*map(F.lit, codes)), (F.col("event_id") % 9 + 1).cast("int")), "why": F.when(_every(14), " Decode_Failed ").when(_every(15), "unknown_event_type").otherwise(""), "retry": _every(8), "decode": _every(4)})
    e = e.select(*K, "code", contracts.ingest_decision(F.col("code"), F.col("why"), F.col("retry"), F.col("decode")).alias("x"))
    return e.groupBy("code", "x.disposition", "x.reason_code", "x.quarantine").agg(F.count("*").alias("messages"))


@query
def rule_results(s, d):
    """Trades as messages of bindings, held against each binding's newest rules: passed, failed or in error, and what they break."""
    rules = "array<struct<kind: string, field: string, expected: string>>"
    need = lambda *f: [("required", x, None) for x in f]
    configs = s.createDataFrame(
        [("BINANCE", 1, True, need("nothing")), ("BINANCE", 2, True, [*need("price", "note"), ("not_empty", "note", None)]), ("BINANCE", 3, False, need("nothing")), ("BYBIT", 1, True, [("equals", "side", "buy")]), ("COINBASE", 1, False, need("price")), ("KRAKEN", 1, True, [])],
        f"binding string, version long, active boolean, rules {rules}",
    )
    t = ticks.trades(s, d, number=False)
    note = F.when(_every(3), " ").when(_every(5), "seen")
    payload = F.when(_every(31), "{broken").when(_every(37), "[1]").otherwise(F.to_json(F.struct("price", "side", note.alias("note"))))
    r = contracts.rule_results(t.select(F.col("venue").alias("binding"), "instrument", payload.alias("payload")), configs)
    return r.withColumn("v", F.explode_outer("violations")).groupBy("binding", "config_version", "status", "v.rule", "v.reason").agg(F.count("*").alias("messages"))


@query
def payload_drift(s, d):
    """Two versions of the trades' payloads: fields that changed, came and went, and whether the message still is compatible."""
    t = ticks.trades(s, d, number=False).select("event_id", "price", "side", "venue")

    def version(new: bool):
        price = F.when(_every(7), F.col("price") + 1).otherwise(F.col("price")) if new else F.col("price")
        side = F.when(~_every(11), F.col("side")) if new else F.col("side")
        tags = F.when(_every(17), F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))) if new else F.array(F.lit("a"), F.lit("b"))
        more = F.when(_every(13), "more") if new else F.lit(None).cast("string")
        return t.select("event_id", F.to_json(F.struct(price.alias("price"), side.alias("side"), F.struct("venue", tags.alias("tags")).alias("meta"), more.alias("extra"))).alias("payload"))

    return contracts.payload_drift(version(False), version(True), ["event_id"]).select("event_id", "kind", "path", "compatible")


@query
def fills_against_largest(s, d):
    return rounded(profiles.fills_against_largest(ticks.trades(s, d, number=False), 10.0).select(*K, "price_low", "volume", "max_volume", "share_of_max", "series_imbalance"))


@query
def coverage_status(s, d):
    """Artifacts of the last three hours by series; one isn't kept at all."""
    e = ticks.events(s, d)
    last = e.agg(F.max("ts_ingest_ms").alias("top"))
    kinds = F.when(F.col("event_type") == "signup", "interest").when(F.col("event_type") == "error", "liquidations").when(F.col("event_type") == "view", "marks")
    recent = e.join(F.broadcast(last), F.col("ts_ingest_ms") > F.col("top") - 3 * 3_600_000)
    counts = recent.select(*K, F.explode(F.array(F.lit("trades"), kinds)).alias("artifact")).where("artifact is not null").groupBy(*K, "artifact").agg(F.count("*").alias("n"))
    return reports.coverage_status(e, counts, ["trades", "interest", "liquidations", "marks", "empties"], ["trades", "interest", "liquidations", "marks", "empties", "footprints"])


@query
def position_state(s, d):
    """Positions that had no fill for 60 days before the newest order, and accounts that are long here and short there."""
    p = ticks.positions(s, d, "o_orderdate").withColumn("at", F.unix_millis(F.col("o_orderdate").cast("timestamp")))
    p = p.groupBy("account", "venue", "symbol", "side").agg(F.max("at").alias("last_fill_ms"))
    now = p.agg(F.max("last_fill_ms").alias("now"))
    return reports.position_state(p.join(F.broadcast(now), F.col("last_fill_ms") <= F.col("now")), F.col("now"), 60 * DAY)


@query
def capped_checksums(s, d):
    return rounded(books.capped_with_checksum(books.book_as_of(ticks.book_deltas(s, d), ts_ms=BOUNDARY), 5).select(*K, "bid_levels", "ask_levels", "spread_bps", "checksum"))


@query
def evidence_by_kind(s, d):
    """The newest three findings of every rule on books in each series: the feature is that cut."""
    e = signals.evidence(signals.book_inputs(ticks.book_snapshots(s, d)))
    return quality.newest(e, ["kind", *K], "seq", 3).select("kind", *K, "seq", "severity", "confidence")


@query
def latest_by_subject(s, d):
    """The newest finding of each series, of whatever rule; of several at one book the one with the greatest name."""
    e = signals.evidence(signals.book_inputs(ticks.book_snapshots(s, d)))
    return e.groupBy(*K).agg(F.count("*").alias("findings"), F.max_by(F.struct("kind", "seq", "severity"), F.struct("seq", "kind")).alias("r")).select(*K, "findings", "r.*")


@query
def sampled_violations(s, d):
    """Of each verdict on sequence numbers how many rows have it, and the first 64 events of it: the feature is that cut."""
    a = quality.sequence_audit(ticks.trades(s, d).withColumn("seq", F.when(_every(53), F.col("seq") - 3).otherwise(F.col("seq"))))
    a = a.where("verdict <> 'accept'").select("verdict", "event_id")
    n = a.groupBy("verdict").agg(F.count("*").alias("rows"))
    w = F.row_number().over(Window.partitionBy("verdict").orderBy("event_id"))
    return a.distinct().withColumn("nth", w).where("nth <= 64").join(n, "verdict").select("verdict", "rows", "event_id")
