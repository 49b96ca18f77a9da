"""Rules for books, ticks, artifacts, messages and payloads on cases worked by hand."""

import json
import math

from pyspark.sql import functions as F
from tickforge.functions.columns import event_type_of, subject_category
from tickforge.operators import books, contracts, profiles, quality, reports

LEVELS = "array<struct<price: double, size: double>>"


def test_subject_categories(spark):
    rows = [
        ("md.trade.v1.x/BINANCE", "md.trade", "unknown"), (" MD.Book_Delta/v1.close", "md.book_delta", "delta"), ("a.snapshot.v2/x.close", "a.snapshot", "snapshot"), ("v1.close", "", "unknown"), ("a.close.final", "a.close.final", "close_final"),
        ("a.v1x.close/y", "a.v1x.close", "close_final"), ("a.close.v12", "a.close", "close_final"), ("telemetry", "telemetry", "telemetry"), ("", "", "unknown"), (None, None, "unknown"),
    ]
    got = spark.createDataFrame(rows, "s string, kind string, category string").select("kind", "category", event_type_of(F.col("s")).alias("k"), subject_category(F.col("s")).alias("c"))
    assert all((r.k, r.c) == (r.kind, r.category) for r in got.collect())


def test_books_that_are_invalid(spark):
    good, bad = [(3.0, 1.0), (2.0, 1.0)], math.nan
    cases = [
        (1, good, [(4.0, 1.0), (5.0, 1.0)], True, 0, 0, None, None), (0, good, [], True, 1, 1, "bad_time", "bad_time"), (None, good, [], True, 1, 1, "bad_time", "bad_time"), (1, good[::-1], [], True, 1, 1, "bids_order", "bids_order"),
        (1, good, [(4.0, 0.0)], False, 1, 1, "asks_zero_qty", None), (1, [(bad, 1.0)], [], True, 1, 1, "bids_nan", "bids_nan"), (1, [], [(5.0, 1.0), (4.0, 1.0)], True, 1, 1, "asks_order", "asks_order"), (1, [(-1.0, 1.0)], [], True, 1, 1, "bids_neg_price", "bids_neg_price"),
        (1, [], [(1.0, -1.0)], True, 1, 1, "asks_neg_qty", "asks_neg_qty"), (1, [], [], False, 0, 1, None, "update_ids"), (1, [], [], False, 2, 1, None, "update_order"), (1, [], [], False, None, 1, None, "update_ids"), (1, [(1.0, 1.0), (1.0, 2.0)], [], True, 0, 0, None, None),
    ]
    df = spark.createDataFrame(cases, f"ts_ingest_ms long, bids {LEVELS}, asks {LEVELS}, is_snapshot boolean, first_id long, final_id long, s string, d string")
    for r in df.withColumns({"gs": contracts.snapshot_reason(), "gd": contracts.delta_reason()}).collect():
        assert (r.gs, r.gd) == (r.s, r.d), r


def test_ingest_decisions(spark):
    cases = [
        (None, None, None, None, "ack", "ok", False), ("", "decode_failed", True, True, "ack", "ok", False), ("internal", " Unknown_Event_Type", True, False, "term", "unknown_event_type", True), ("conflict", "", False, False, "term", "validation_failed", True),
        ("conflict", "", True, False, "nak", "transient_failure", False), ("internal", "", False, True, "nak", "transient_failure", False), ("unavailable", None, None, None, "nak", "transient_failure", False), ("duplicate", None, None, None, "term", "validation_failed", True), ("anything", None, None, None, "nak", "transient_failure", False),
    ]
    df = spark.createDataFrame(cases, "code string, why string, retry boolean, decode boolean, a string, b string, c boolean")
    for r in df.select("a", "b", "c", contracts.ingest_decision(F.col("code"), F.col("why"), F.col("retry"), F.col("decode")).alias("x")).collect():
        assert tuple(r.x) == (r.a, r.b, r.c)


def test_rules_of_the_newest_configuration(spark):
    configs = spark.createDataFrame(
        [("b", 1, True, [("required", "old", None)]), ("b", 2, True, [("required", "a", None), ("not_empty", "a", None), ("equals", "k", "7")]), ("b", 3, False, []), ("off", 1, False, [])],
        "binding string, version long, active boolean, rules array<struct<kind: string, field: string, expected: string>>",
    )
    cases = [
        ("b", '{"a": "x", "k": 7}', "passed", []), ("b", '{"a": null, "k": "7"}', "failed", ["not_empty:a"]), ("b", '{"k": 8}', "failed", ["required:a", "not_empty:a", "equals:k"]), ("b", '{"a": [], "k": null}', "failed", ["not_empty:a", "equals:k"]),
        ("b", '{"a": {}, "k": 7}', "failed", ["not_empty:a"]), ("b", '{"a": 0, "k": "7"}', "passed", []), ("b", "[1]", "error", ["payload"]), ("b", "{no", "error", ["payload"]), ("b", None, "error", ["payload"]), ("off", "{}", "error", ["runtime.active_config"]), (None, "{}", "error", ["runtime.active_config"]),
    ]
    df = spark.createDataFrame(cases, "binding string, payload string, want string, broken array<string>")
    for r in contracts.rule_results(df, configs).collect():
        assert (r.status, [v.rule for v in r.violations]) == (r.want, r.broken), r
    assert contracts.rule_results(df.where("false"), configs).count() == 0


def test_payload_drift(spark):
    versions = [
        ({"a": 1, "b": {"c": [1, 2], "d": "x"}}, {"a": 1, "b": {"c": [1, 2], "d": "x"}}), ({"a": 1}, {"a": 2}), ({"a": 1, "b": 2}, {"a": 1}), ({"a": 1}, {"a": 1, "b": 3}), ({"a": [1, 2, 3]}, {"a": [1, 5]}), ({"a": {"b": {"c": 1}}}, {"a": {"b": {"c": "1"}}}),
        ({"a": None}, {"a": 0}), ({"a": True}, {"a": True, "n": {"m": 1}}), ({"a": {"b": 1}}, {"a": [1]}), ({"a": True}, {"a": 1}), ({"a": 1}, {"a": 1.0}), ({"a": {}}, {"a": {"b": 1}}),
    ]
    schema = "id long, payload string"
    golden = spark.createDataFrame([(k, json.dumps(a)) for k, (a, _) in enumerate(versions)] + [(90, "{}"), (91, "{no"), (92, '{"a": 1}')], schema)
    actual = spark.createDataFrame([(k, json.dumps(b)) for k, (_, b) in enumerate(versions)] + [(91, '{"a": 1}'), (93, "{}")], schema)
    got = contracts.payload_drift(golden, actual, ["id"]).collect()
    want = {
        (1, "mismatch", "a"), (2, "dropped", "b"), (3, "new", "b"), (4, "mismatch", "a[1]"), (4, "dropped", "a[2]"), (5, "mismatch", "a.b.c"), (6, "mismatch", "a"), (7, "new", "n"), (8, "mismatch", "a"), (9, "mismatch", "a"), (11, "new", "a.b"), (91, "new", "a"),
    }
    assert {(r.id, r.kind, r.path) for r in got} == want
    assert {r.id for r in got if r.compatible} == {3, 7, 11, 91}
    assert {(r.expected, r.actual) for r in got if r.id in (5, 7)} == {("1", '"1"'), (None, '{"m": 1}')}


def test_artifact_rules(spark):
    cell = lambda **x: tuple((dict(venue="V", instrument="I", window_start=1, price_low=1.0, price_high=2.0, buy_volume=1.0, sell_volume=2.0, total_volume=3.0, seq_min=1, seq_max=2) | x).values())
    rows = [cell(), cell(price_low=2.0), cell(price_low=3.0, total_volume=9.0), cell(price_low=0.5, seq_min=0), cell(price_low=0.6, buy_volume=-1.0, total_volume=1.0), cell(price_low=0.7), cell(price_low=0.7)]
    df = spark.createDataFrame(rows, "venue string, instrument string, window_start long, price_low double, price_high double, buy_volume double, sell_volume double, total_volume double, seq_min long, seq_max long")
    got = quality.broken_rules(contracts.with_copies(df, ["venue", "instrument", "window_start", "price_low"]), contracts.PROFILE_RULES)
    assert sorted((r.price_low, r.rule) for r in got.collect()) == [(0.5, "sequence"), (0.6, "volumes"), (0.7, "unique"), (0.7, "unique"), (2.0, "prices"), (3.0, "prices"), (3.0, "total")]


def test_fused_cells_and_their_cut(spark):
    cells = [("A", "I", 0, 1.0, 2.0, " xs", 1.0, 2.0, 1.0, 3), ("B", "I", 0, 1.0, 2.0, "XS", 3.0, 0.0, 0.0, 1), ("A", "I", 0, 1.0, 2.0, "L", 0.0, 0.0, 0.0, 1), ("A", "I", 0, 0.5, 2.0, "L", 1.0, 0.0, 0.0, 1), ("A", "I", 0, 7.0, 8.0, "L", 1.0, 0.0, 0.0, 1)]
    df = spark.createDataFrame(cells, "venue string, instrument string, window_start long, price_low double, price_high double, size_class string, bid_liquidity double, ask_liquidity double, trade_volume double, samples long")
    got = {(r.price_low, r.size_class): (r.bid_liquidity, r.samples, [tuple(m) for m in r.venue_mix]) for r in profiles.fused_cells(df, 3).collect()}
    assert got == {(0.5, "L"): (1.0, 1, [("A", 1.0, 1.0)]), (1.0, "L"): (0.0, 1, [("A", 0.0, 0.0)]), (1.0, "XS"): (4.0, 4, [("A", 4.0, 4 / 7), ("B", 3.0, 3 / 7)])}


def test_coverage_and_positions(spark):
    series = spark.createDataFrame([("V", "I"), ("V", "J"), ("V", "J")], "venue string, instrument string")
    counts = spark.createDataFrame([("V", "I", "full", 1), ("V", "J", "full", 2), ("V", "I", "part", 1), ("V", "J", "part", 0)], "venue string, instrument string, artifact string, n long")
    got = {r.artifact: (r.total, r.available, r.empty, r.unavailable, r.status) for r in reports.coverage_status(series, counts, ["full", "part", "none"], ["full", "part", "none", "gone"]).collect()}
    assert got == {"full": (2, 2, 0, 0, "available"), "part": (2, 1, 1, 0, "partial"), "none": (2, 0, 2, 0, "empty"), "gone": (2, 0, 0, 2, "unavailable")}
    p = spark.createDataFrame([(1, "X", "A", "long", 100), (1, "X", "B", "short", 900), (2, "X", "A", "long", None), (2, "X", "B", "long", 0), (3, "X", "A", "short", 899)], "account long, symbol string, venue string, side string, last_fill_ms long")
    got = {r.account: (r.positions, r.stale, r.diverges) for r in reports.position_state(p, F.lit(1000), 100).collect()}
    assert got == {1: (2, 1, True), 2: (2, 0, False), 3: (1, 1, False)}


def test_checksum_sees_every_level(spark):
    """The checksum is of the whole book, though only its best level is shown."""
    schema = "venue string, instrument string, side string, price double, size double"
    book = [("V", "I", "bid", 10.0, 1.0), ("V", "I", "bid", 9.0, 2.0), ("V", "I", "ask", 11.0, 1.5)]
    first = books.capped_with_checksum(spark.createDataFrame(book, schema), 1).first()
    import zlib

    assert first.checksum == zlib.crc32(b"1000000000:100000000|900000000:200000000#1100000000:150000000") and len(first.bids) == 1 and first.bid_levels == 2
    other = books.capped_with_checksum(spark.createDataFrame([*book[:1], ("V", "I", "bid", 9.0, 2.5), book[2]], schema), 1).first()
    assert other.bids == first.bids and other.checksum != first.checksum
