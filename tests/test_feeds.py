"""Keys, routing, repeats, owners, digests, sessions, subscriptions, bounded windows and partitioned sinks, on cases worked by hand and by brute force."""

import glob
import os
import random
import subprocess
import sys
from collections import deque
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest

from pyspark.sql import functions as F
from tickforge.functions import keys
from tickforge.operators import audit, matching, open_windows, profiles, quality, windows
from tickforge.sources import router
from tickforge.streaming import jobs, tables

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def fnv(data):
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return f"{h:x}"


def test_fnv_vectors(spark):
    """The published values of 64-bit FNV-1a."""
    rows = spark.createDataFrame([("", "cbf29ce484222325"), ("a", "af63dc4c8601ec8c"), ("foobar", "85944171f73967e8")], "x string, want string")
    assert all(r.got == r.want for r in rows.withColumn("got", keys.fnv1a(keys.text_bytes(F.col("x")))).collect())


def test_fnv_fields(spark):
    """Fields are told apart, numbers are eight bytes, nulls are empty, bytes are those of UTF-8, leading zeros go."""
    rng = random.Random(1)
    values = [("BINANCE", "BTC-USDT", 1), ("a|b", "", 0), ("a", "b", -1), ("é中🙂", None, 2**63 - 1), (None, "x\x00y", None)] + [("".join(rng.choice("abé") for _ in range(rng.randrange(9))), str(k), rng.randrange(-(2**63), 2**63)) for k in range(300)]
    rows = spark.createDataFrame(values, "a string, b string, n long").withColumn("got", keys.fnv1a(keys.text_bytes(F.col("a")), keys.text_bytes(F.col("b")), keys.long_bytes(F.col("n"))))
    for r in rows.collect():
        assert r.got == fnv(b"\0".join([(r.a or "").encode(), (r.b or "").encode(), (r.n or 0).to_bytes(8, "big", signed=True)]))
    two = spark.range(1).select(keys.window_key(F.lit("ab"), F.lit("c")).alias("x"), keys.window_key(F.lit("a"), F.lit("bc")).alias("y"), keys.window_key(F.lit("a|b")).alias("z"), keys.window_key(F.lit("a"), F.lit("b")).alias("w")).first()
    assert len(set(two)) == 4


def series(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("size,block", [(3, 20), (8, 12)])
def test_repeats_equal_a_ring_kept_in_order(spark, size, block):
    rng = random.Random(size)
    rows = [("V", name, k, k // 3, rng.choice("abcdefghij") if rng.random() < 0.95 else None) for name, n in (("I", 60), ("J", 23), ("K", 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "venue string, instrument string, event_id long, ts long, key string").repartition(3)
    got = audit.first_within(df, ["venue", "instrument"], F.expr("ts div 4"), ["ts", "event_id"], F.col("key"), size, block)
    want = []
    for name in "IJK":
        ring = deque(maxlen=size)
        for r in rows:
            if r[1] == name:
                want.append((name, r[2], r[4] in ring))
                if r[4] not in ring:
                    ring.append(r[4])
    assert sorted((r.instrument, r.event_id, r.is_repeat) for r in got.collect()) == sorted(want)
    assert got.columns == [*df.columns, "is_repeat"]


def test_repeats_of_no_rows(spark):
    df = spark.createDataFrame([], "venue string, instrument string, event_id long, ts long, key string")
    assert audit.first_within(df, ["venue", "instrument"], F.expr("ts div 4"), ["ts", "event_id"], F.col("key")).collect() == []


def test_running_aggregates_equal_one_window(spark):
    from pyspark.sql import Window

    rng = random.Random(4)
    df = spark.createDataFrame([("V", rng.choice("IJ"), k, rng.randrange(9), rng.choice([None, 1, 5, 9])) for k in range(300)], "venue string, instrument string, k long, x long, y long")
    w = Window.partitionBy("venue", "instrument").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("k", F.max(F.struct("x", "k")).over(w).alias("a"), F.min("y").over(w).alias("b"), F.coalesce(F.sum("y").over(w), F.lit(0)).alias("c"))
    got = windows.running_before(df, ["venue", "instrument"], F.expr("k div 7"), ["k"], a=(F.max, F.struct("x", "k")), b=(F.min, F.col("y")), c=(F.sum, F.col("y")))
    assert sorted(map(str, got.select("k", "a", "b", "c").collect())) == sorted(map(str, want.collect()))


def test_audits_have_no_window_over_a_whole_series(spark):
    """Every window is within a stretch, or over the small table of stretches."""
    df = spark.createDataFrame([("V", "I", 1, 5, 5, 1.0)], "venue string, instrument string, event_id long, seq long, ts_ingest_ms long, price double")
    for out in (quality.sequence_audit(df), quality.lateness(df, 1000, "ts_ingest_ms", ["event_id"], ["venue", "instrument"]), quality.caught_up(df, 5, ["event_id"], ["venue", "instrument"])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line:
                assert "_stretch" in line


def test_owner_changes(spark):
    """A stream at number 10 of owner a that b takes over with a handoff at 12 and a resync under way up to 14."""
    own = "owner string, seq long, is_snapshot boolean, handoff_seq long, pending_seq long, ts_ingest_ms long"
    rows = [
        ("a", 10, False, None, None, 100, "accept", "accept"), ("a", 10, False, None, None, 101, "drop", "replay_duplicate"), ("a", 0, False, None, None, 102, "drop", "seq_invalid"),
        ("a", 8, False, None, None, 103, "drop", "stale_event"), ("b", 12, False, 12, None, 104, "convert_to_resync", "owner_change"), ("b", 9, False, None, None, 105, "convert_to_resync", "owner_change"),
        ("b", 13, False, 12, 14, 106, "drop", "resync_overlap"), ("b", 15, False, 12, 14, 107, "accept", "accept"), ("b", 11, True, 12, 14, 108, "convert_to_resync", "resync_overlap"),
        ("b", 9000, False, 12, 14, 109, "accept", "accept"), ("b", 20, False, 12, 14, 110, "drop", "seq_non_monotonic"), (None, 21, False, None, None, 111, "drop", "seq_non_monotonic"), ("b", 7000, False, None, None, 50, "accept", "accept"),
    ]
    df = spark.createDataFrame([("V", "I" if r[5] != 50 else "J", k, *r[:6]) for k, r in enumerate(rows)], "venue string, instrument string, event_id long, " + own)
    got = {r.event_id: (r.action, r.reason) for r in audit.ownership_audit(df, stretch=4).collect()}
    assert got == {k: r[6:] for k, r in enumerate(rows)}


def test_digest_depends_on_order_alone(spark):
    rows = [("V", "I", k, f"x{k % 5}", None if k % 3 else k) for k in range(200)]
    df = spark.createDataFrame(rows, "venue string, instrument string, k long, a string, b long")
    digest = lambda d, n: audit.run_digest_in_order(d, ["venue", "instrument"], F.expr(f"k div {n}"), ["k"], "a", "b").first().digest
    first = digest(df, 10)
    assert first == digest(df.repartition(7), 1000) == digest(df.orderBy(F.desc("k")), 1)
    swapped = df.withColumn("k", F.when(F.col("k") == 3, 4).when(F.col("k") == 4, 3).otherwise(F.col("k")))
    assert digest(swapped, 10) != first
    moved = lambda a, b: digest(spark.createDataFrame([("V", "I", 0, a, b)], "venue string, instrument string, k long, a string, b string"), 1)
    assert len({moved("x|", "y"), moved("x", "|y"), moved("", None), moved(None, "")}) == 4


def ms(*at, zone="UTC"):
    return int(datetime(*at, tzinfo=ZoneInfo(zone)).timestamp() * 1000)


@pytest.mark.parametrize(
    "at,start,closed",
    [
        ((2024, 1, 10, 10, 0), (2024, 1, 10, 9, 30), False), ((2024, 1, 10, 9, 29), (2024, 1, 9, 9, 30), True), ((2024, 1, 10, 16, 0), (2024, 1, 10, 9, 30), True), ((2024, 1, 10, 9, 30), (2024, 1, 10, 9, 30), False),
        ((2024, 3, 10, 10, 0), (2024, 3, 10, 9, 30), False), ((2024, 3, 10, 1, 0), (2024, 3, 9, 9, 30), True), ((2024, 3, 11, 9, 0), (2024, 3, 10, 9, 30), True),
        ((2024, 11, 3, 12, 0), (2024, 11, 3, 9, 30), False), ((2024, 11, 3, 3, 0), (2024, 11, 2, 9, 30), True), ((2024, 11, 4, 9, 0), (2024, 11, 3, 9, 30), True),
    ],
)
def test_session_of_an_exchange(spark, at, start, closed):
    """In, before and after the session of New York, and on both days when its clocks change."""
    zone = "America/New_York"
    got = spark.range(1).select(profiles.session_bounds(F.lit(ms(*at, zone=zone)), 23_400_000, zone, 570).alias("b")).select("b.*").first()
    assert tuple(got) == (ms(*start, zone=zone), ms(*start, zone=zone) + 23_400_000, closed)


def test_custom_sessions_and_no_time(spark):
    rows = spark.createDataFrame([(7,), (18_000_000,), (0,), (-5,), (None,)], "ts long")
    got = rows.select(profiles.session_bounds(F.col("ts"), 18_000_000, None).alias("b")).collect()
    assert [r.b and tuple(r.b) for r in got] == [(0, 18_000_000, False), (18_000_000, 36_000_000, False), None, None, None]


def test_many_filters_equal_a_theta_join(spark):
    rng = random.Random(8)
    blank = lambda *v: rng.choice(["", None, *v, *v])
    filters = [(k, blank("A", "B"), blank("X", "Y"), blank("t", "b"), blank("1m"), rng.choice([0, None, 5, 20])) for k in range(400)]
    events = [(rng.choice(["A", "B", None]), rng.choice("XYZ"), rng.choice(["t", "b", ""]), rng.choice(["1m", ""]), rng.choice([0, 5, 20]), k) for k in range(120)]
    names = "venue string, symbol string, channel string, aggregation string, depth long"
    out = matching.matched(spark.createDataFrame(events, names + ", seq long"), spark.createDataFrame(filters, "id long, " + names), ["id"])
    fits = lambda f, e: all(not x or x == y for x, y in zip(f, e))
    assert sorted((r.id, r.seq) for r in out.select("id", "seq").collect()) == sorted((f[0], e[5]) for f in filters for e in events if fits(f[1:], e[:5]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    nobody = matching.matched(spark.createDataFrame(events, names + ", seq long"), spark.createDataFrame([], "id long, " + names), ["id"])
    assert nobody.collect() == []


def test_snapshot_then_deltas(spark):
    e = spark.createDataFrame([("A", "X", "t", "", 0, s, t) for s, t in ((1, 10), (3, 20), (2, 25), (5, 30), (4, 40), (3, 50))] + [("B", "X", "t", "", 0, 1, 99)], "venue string, symbol string, channel string, aggregation string, depth long, seq long, ts_ingest_ms long")
    subs = spark.createDataFrame([(1, 25, "", "X", "", "", 0), (2, 5, "A", "", "", "", 0)], "id long, since long, venue string, symbol string, channel string, aggregation string, depth long")
    got = {(r.id, r.venue, r.kind, r.seq, r.ts_ingest_ms) for r in matching.feed(e, subs, ["venue", "symbol", "channel"]).collect()}
    assert got == {(1, "A", "snapshot", 3, 20), (1, "A", "delta", 5, 30), (1, "A", "delta", 4, 40), (1, "B", "delta", 1, 99)} | {(2, "A", "delta", s, t) for s, t in ((1, 10), (3, 20), (2, 25), (5, 30), (4, 40), (3, 50))}


def test_router(spark):
    """Each type goes its way; unknown, newer, broken and incomplete ones to quarantine; nothing is lost or doubled."""
    body = {"trade": '{"price": 1.5, "size": 2, "side": "BID", "trade_id": "t"}', "markprice": '{"mark_price": 7}', "openinterest": '{"open_interest": 3.25}', "liquidation": '{"price": 1, "size": 1, "side": "ask"}', "bookdelta": '{"bids": [{"price": 1, "size": 2}], "asks": [], "is_snapshot": true}'}
    rows = [(f" marketdata.{k.upper()} ", 1, p) for k, p in body.items()]
    rows += [("marketdata.trade", 2, body["trade"]), ("marketdata.trade", None, body["trade"]), ("other.trade", 1, "{}"), (None, 1, "{}"), ("marketdata.trade", 1, "{no"), ("marketdata.trade", 1, None), ("marketdata.trade", 1, '{"price": "x", "size": 1}'), ("marketdata.markprice", 1, "[]"), ("marketdata.bookdelta", 1, '{"bids": 3, "asks": []}')]
    e = spark.createDataFrame([(t, v, " binance ", "btc-usdt", k, 100, 0, None, p) for k, (t, v, p) in enumerate(rows)], "type string, version int, venue string, instrument string, seq long, ts_ingest long, ts_exchange long, idempotency_key string, payload string")
    out = router.route(e)
    assert {k: v.count() for k, v in out.items()} == {"trade": 1, "bookdelta": 1, "markprice": 1, "liquidation": 1, "openinterest": 1, "quarantine": 9}
    t = out["trade"].first()
    assert (t.venue, t.instrument, t.price, t.size, t.side, t.trade_id) == ("BINANCE", "BTCUSDT", 1.5, 2.0, "buy", "t")
    assert [tuple(x) for x in out["bookdelta"].first().bids] == [(1.0, 2.0)] and out["liquidation"].first().side == "sell"
    reasons = [r.reason for r in out["quarantine"].orderBy("seq").collect()]
    assert reasons == ["unknown_event_version"] * 2 + ["unknown_event_type"] * 2 + ["decode_failed"] * 2 + ["field_missing"] * 3


def test_router_over_a_stream(spark, tmp_path):
    """One stream of all types, written to a table each in one pass."""
    e = spark.createDataFrame([("marketdata.trade" if k % 2 else "marketdata.markprice", 1, "V", "I", k, k, k, "", '{"price": 1, "size": 1}' if k % 2 else '{"mark_price": 2}') for k in range(20)], "type string, version int, venue string, instrument string, seq long, ts_ingest long, ts_exchange long, idempotency_key string, payload string")
    e.write.parquet(str(tmp_path / "in"))
    stream = router.parsed(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    sink = jobs.fan_out(str(tmp_path / "out"), {k: (lambda rows, k=k: router.routed(rows)[k]) for k in ("trade", "markprice", "quarantine")})
    assert tables.started(stream, sink, str(tmp_path / "cp"), None).awaitTermination(120)
    assert {k: spark.read.parquet(f"{tmp_path}/out/{k}").count() for k in ("trade", "markprice", "quarantine")} == {"trade": 10, "markprice": 10, "quarantine": 0}


TRADE = "venue string, instrument string, price double, size double, ts_exchange_ms long, ts_ingest_ms long, event_id long"


def test_forced_close_of_the_oldest_window(spark):
    """Room for two: a third series closes the window that began first, of two that began together the one of the lesser name."""
    rows = [("V", "B", 1.0, 1.0, 1000), ("V", "A", 2.0, 1.0, 1500), ("V", "B", 3.0, 1.0, 1700), ("V", "C", 4.0, 1.0, 5000), ("V", "A", 5.0, 1.0, 5200), ("V", "C", 6.0, 1.0, 4000), ("V", "C", 7.0, 1.0, 6100)]
    df = spark.createDataFrame([(*r, 10 * k, k) for k, r in enumerate(rows)], TRADE)
    got = [(r.instrument, r.window_start, r.open, r.close, r.volume, r.late, r.closed_by) for r in open_windows.bounded_windows(df, 1000, most=2, shards=1).collect()]
    assert got == [("A", 1000, 2.0, 2.0, 1.0, 0, "force"), ("B", 1000, 1.0, 3.0, 2.0, 0, "force"), ("C", 5000, 4.0, 4.0, 1.0, 1, "later trade"), ("A", 5000, 5.0, 5.0, 1.0, 0, "end"), ("C", 6000, 7.0, 7.0, 1.0, 0, "end")]
    roomy = open_windows.bounded_windows(df, 1000, most=96, shards=4).where("closed_by = 'force'")
    assert roomy.count() == 0


def test_bounded_windows_in_blocks(spark):
    """Blocks of 16 of 600 trades give what one machine gives that takes all in order, and no task reads them all; a window open to the end as well."""
    rng = random.Random(4)
    rows = [("V", rng.choice("ABCDEFGH"), float(rng.randrange(1, 99)), 1.0, 300 * k - rng.randrange(1500) + 2000, 10 * k if k else None, k) for k in range(600)]
    for far in (False, True):
        some = [*rows, ("V", "Z", 5.0, 1.0, 10**9, 95, 1000), *(("V", "Z", 6.0, 1.0, 10 * t, t, 2000 + t) for t in range(101, 6000, 90))] if far else rows
        table, want = open_windows.OpenWindows(1000, 3), []
        for r in sorted(some, key=lambda r: (r[5] or -1, r[6])):
            want += table.add(r[:2], r[4], r[2], 100_000_000)
        want += table.rest()
        got = open_windows.bounded_windows(spark.createDataFrame(some, TRADE), 1000, most=3, shards=1, slice_ms=500, block=16, rounds=3)
        assert sorted(map(tuple, got.collect())) == sorted(want)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert ("MapInArrow" in plan) == far and "FlatMapCoGroupsInArrow" in plan


def test_bounded_windows_as_a_stream(spark, tmp_path):
    """Three triggers close the same windows as one pass over all rows."""
    from tickforge.streaming import state

    state.use_state_store(spark)
    rng = random.Random(3)
    rows = [("V", rng.choice("ABCDEFGH"), float(k % 7 + 1), 1.0, 500 * k - rng.randrange(1500) + 2000, 10 * k, k) for k in range(150)]
    src = str(tmp_path / "in")
    os.makedirs(src)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stream = spark.readStream.schema(TRADE).parquet(src)
    out = open_windows.stream_bounded_windows(stream, 1000, most=3, shards=2)
    for part in (rows[:40], rows[40:90], rows[90:]):
        rng.shuffle(part := list(part))
        spark.createDataFrame(part, TRADE).coalesce(1).write.mode("append").parquet(src)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = open_windows.bounded_windows(spark.createDataFrame(rows, TRADE), 1000, most=3, shards=2).where("closed_by <> 'end'")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))
    assert want.where("closed_by = 'force'").count()


DAY = 86_400_000


def stamps(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/month=*/batch=*/*.parquet")}


def test_first_write_wins_by_month(spark, tmp_path):
    """A batch reads and rewrites its own months only; repeated, it leaves everything as it was."""
    path, schema = str(tmp_path / "t"), "k string, window_start long, v long, seq long"
    write = tables.first_write_wins(path, ["k", "window_start"], "seq", "window_start", rows_per_file=2)
    january, february = ms(2024, 1, 5), ms(2024, 2, 5)
    one = spark.createDataFrame([("a", january, 1, 2), ("a", january, 0, 1), ("b", february, 1, 1), ("n", None, 1, 1)] + [(f"c{k}", january, 1, 1) for k in range(4)], schema)
    two = spark.createDataFrame([("b", february, 9, 9), ("d", february, 2, 1)], schema)
    write(one, 0)
    write(two, 1)
    rows = lambda: {(r.k, r.month): r.v for r in spark.read.parquet(path).collect()}
    want = {("a", "2024-01"): 0, ("b", "2024-02"): 1, ("d", "2024-02"): 2, ("n", "none"): 1} | {(f"c{k}", "2024-01"): 1 for k in range(4)}
    assert rows() == want
    assert len(glob.glob(f"{path}/month=2024-01/batch=0/*.parquet")) >= 3  # two rows a file
    before = stamps(path)
    write(two, 1)
    changed = {f for f, t in stamps(path).items() if before.get(f) != t}
    assert rows() == want and changed and all("batch=1" in f for f in changed)
    plan = tables._stored(spark, path, ["2024-02"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2024-02" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_late_rows_by_month(spark, tmp_path):
    path, late, schema = str(tmp_path / "t"), str(tmp_path / "late"), "k string, ts long"
    write = tables.late_apart(path, late, "ts", 1000)
    t = ms(2024, 1, 31, 23, 59)
    batches = [[("a", t), ("b", t - 50_000)], [("c", t - 500), ("d", t - 2000), ("e", t + DAY)], [("f", t), ("g", None), ("h", t + DAY - 999)]]
    for k, rows in enumerate(batches):
        write(spark.createDataFrame(rows, schema), k)
    write(spark.createDataFrame(batches[2], schema), 2)
    assert {r.k for r in spark.read.parquet(path).collect()} == {"a", "b", "c", "e", "g", "h"}
    assert {(r.k, r.late_ms) for r in spark.read.parquet(late).collect()} == {("d", 2000), ("f", DAY)}
    assert sorted(os.listdir(f"{path}/_latest")) == ["batch=1", "batch=2"]


def test_expiry_drops_months(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, timeframe string, window_start long, seq long"
    now = ms(2024, 5, 15)
    rows = [(f"{m}{tf}", tf, ms(2024, m, 10), 1) for m in (1, 2, 3, 5) for tf in ("1s", "1h")]
    tables.first_write_wins(path, ["k"], "seq", "window_start")(spark.createDataFrame(rows, schema), 0)
    shown = tables.unexpired(spark.read.parquet(path), now)
    assert {r.k for r in shown.collect()} == {"31h", "51h", "51s"}
    assert "PartitionFilters: [isnotnull(month" in shown._jdf.queryExecution().executedPlan().toString()
    assert tables.months(spark, path) == ["2024-01", "2024-02", "2024-03", "2024-05"]
    assert tables.expire(spark, path, now) == ["2024-01"]  # 90 days back is the 15th of February, so that month stays
    assert tables.months(spark, path) == ["2024-02", "2024-03", "2024-05"] and tables.expire(spark, str(tmp_path / "none"), now) == []
    assert {r.k for r in tables.unexpired(spark.read.parquet(path), now).collect()} == {"31h", "51h", "51s"}


def test_workers_find_the_package_from_elsewhere(tmp_path):
    """Books are kept in Python workers; the session may have been started in any folder, and without PYTHONPATH."""
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
from tickforge.operators import book_state, open_windows
d = s.createDataFrame([('V', 'I', 1, 1, True, 'bid', 10.0, 1.0)], 'venue string, instrument string, seq long, ts_ingest_ms long, is_snapshot boolean, side string, price double, size double')
assert book_state.book_states(d).first().best_bid == 10.0
t = s.createDataFrame([('V', 'I', 1.0, 1.0, 1000, 1, 1)], {TRADE!r})
assert open_windows.bounded_windows(t, 1000).first().open == 1.0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]
