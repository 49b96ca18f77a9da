"""Streams that keep state with a time to live, and snapshots of state on timers of event time.

All of them need the RocksDB state store (use_state_store). Rows of one key and trigger reach a processor in any order and are put in order
there, so the source's maxFilesPerTrigger or maxBytesPerTrigger bounds what a task holds.

A time to live makes Spark run batches without rows for as long as the stream lives. To end such a stream with availableNow, set
spark.sql.streaming.noDataMicroBatches.enabled to false. Timers of event time need those batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tickforge.functions.columns import SCALE, fixed
from tickforge.operators.profiles import bucket, session_start
from tickforge.operators.signals import DEPTH_DROP, LEVELS_LOST, SIDE_DROP, STREAK
from tickforge.workers import prepare

KEYS = ["venue", "instrument"]
#: How long, in milliseconds, the state of a key that gets no rows is kept.
KEPT_MS = 3_600_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Let streams that start in this session keep their state in RocksDB, which states with variables and a time to live need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    prepare(spark)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _ordered(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(order, kind="stable")


def _rated(*measures: tuple[float, tuple[float, float]]) -> tuple[str, float]:
    """signals.rated for one row."""
    for k, rating in enumerate((("critical", 0.95), ("high", 0.85))):
        if any(x >= steps[k] for x, steps in measures):
            return rating
    return "medium", 0.70


class Keyed(StatefulProcessor):
    """A processor whose variables are all dropped together when their key has had no rows for `ttl` milliseconds of processing time.

    Subclasses say the schema of their one row of state, how a key begins, and what a row of input does: fold(key, state, row) returns the
    new state and the rows to give out.
    """

    state = ""
    order = ["seq"]
    columns: list[str] = []
    out = ""

    def __init__(self, ttl: int = KEPT_MS):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", self.state, self.ttl)

    def begin(self) -> tuple:
        raise NotImplementedError

    def fold(self, key: tuple, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, out = self.value.get() if self.value.exists() else self.begin(), []
        frame = _ordered(rows, self.order)
        for row in zip(*(frame[c].tolist() for c in self.columns)):
            state, found = self.fold(key, state, row)
            out += found
        self.value.update(tuple(state))
        yield pd.DataFrame(out, columns=_names(self.out))

    def close(self) -> None:
        pass


class Interest(StatefulProcessor):
    """windows.interest_changes: the last value of a series is one variable, the times of its last ten arrivals a list.

    A row whose number isn't above the last one's is left out.
    """

    out = "venue string, instrument string, seq long, open_interest double, delta double, delta_pct double, cadence_ms long, confidence string"

    def __init__(self, ttl: int = KEPT_MS):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, open_interest double", self.ttl)
        self.arrivals = handle.getListState("arrivals", "ts long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq, before = self.last.get() if self.last.exists() else (None, None)
        times, out = [t for (t,) in self.arrivals.get()], []
        frame = _ordered(rows, ["seq"])
        for n, ts, value in zip(frame["seq"].tolist(), frame["ts_ingest_ms"].tolist(), frame["open_interest"].tolist()):
            if seq is not None and n <= seq:
                continue
            delta = value - before if seq is not None else 0.0
            share = delta / before if seq is not None and before > 0 else 0.0
            times = [*times[-9:], ts]
            gaps = sorted(b - a for a, b in zip(times, times[1:]) if b > a)
            cadence = (gaps[(len(gaps) - 1) // 2] + gaps[len(gaps) // 2]) // 2 if gaps else 0
            level = "low" if not gaps or cadence >= 30000 else "high" if cadence < 5000 else "medium"
            out.append((*key, n, value, delta, share, cadence, level))
            seq, before = n, value
        if out:
            self.last.update((seq, before))
            self.arrivals.put([(t,) for t in times])
        yield pd.DataFrame(out, columns=_names(self.out))

    def close(self) -> None:
        pass


class SessionProfile(StatefulProcessor):
    """profiles.session_profile: a map from session and price bucket to volume and candles; each trigger gives out the buckets it changed."""

    out = "venue string, instrument string, session_start long, price_low double, total_volume double, candles long"

    def __init__(self, ttl: int = KEPT_MS):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getMapState("cells", "session_start long, price_low double", "volume long, candles long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found: dict[tuple, list[int]] = {}
        for frame in rows:
            for cell, q in zip(zip(frame["session_start"].tolist(), frame["price_low"].tolist()), frame["q"].tolist()):
                held = found.setdefault(cell, [0, 0])
                held[0], held[1] = held[0] + q, held[1] + 1
        out = []
        for cell, (volume, n) in found.items():
            if self.cells.containsKey(cell):
                more = self.cells.getValue(cell)
                volume, n = volume + more[0], n + more[1]
            self.cells.updateValue(cell, (volume, n))
            out.append((*key, *cell, volume / SCALE, n))
        yield pd.DataFrame(out, columns=_names(self.out))

    def close(self) -> None:
        pass


class Thinning(Keyed):
    """signals.thinning: the depths of the last rows of a series."""

    state = "depths array<double>"
    columns = ["seq", "ts_ingest_ms", "depth"]
    out = "venue string, instrument string, seq long, ts_ingest_ms long, depth double, mean double, z double, drop_share double, severity string, confidence double"

    def __init__(self, ttl: int = KEPT_MS, z: float = -2.0, drop: float = 0.3, least: int = 10, rows: int = 64):
        super().__init__(ttl)
        self.z, self.drop, self.least, self.rows = z, drop, least, rows

    def begin(self) -> tuple:
        return ([],)

    def fold(self, key, state, row):
        seq, ts, depth = row
        depths = [*list(state[0])[-(self.rows - 1) :], depth]
        mean, deviation = float(np.mean(depths)), float(np.std(depths))
        z = (depth - mean) / deviation if deviation > 1e-9 else 0.0
        if not (mean > 0 and len(depths) >= self.least and z <= self.z and depth <= mean * (1 - self.drop)):
            return (depths,), []
        share = 1 - depth / mean
        return (depths,), [(*key, seq, ts, depth, mean, z, share, *_rated((share, DEPTH_DROP)))]


class Imbalance(Keyed):
    """signals.persistent_imbalance: the sign, the length and the first row of the run that a series is in."""

    state = "sign long, length long, seq_start long"
    columns = ["seq", "ts_ingest_ms", "imbalance"]
    out = "venue string, instrument string, seq long, ts_ingest_ms long, sign long, consecutive long, seq_start long, severity string, confidence double"

    def __init__(self, ttl: int = KEPT_MS, limit: float = 0.3, length: int = 10):
        super().__init__(ttl)
        self.limit, self.length = limit, length

    def begin(self) -> tuple:
        return 0, 0, 0

    def fold(self, key, state, row):
        (seq, ts, value), (sign, length, start) = row, state
        now = 1 if value >= self.limit else -1 if value <= -self.limit else 0
        state = (now, length + 1, start) if now == sign and now else (now, int(now != 0), seq)
        if not now or state[1] < self.length:
            return state, []
        return state, [(*key, seq, ts, *state, *_rated((state[1], STREAK)))]


class Sweeps(Keyed):
    """signals.sweeps: levels and depths of the row before."""

    state = "bid_levels long, ask_levels long, bid_depth double, ask_depth double"
    columns = ["seq", "ts_ingest_ms", "bid_levels", "ask_levels", "bid_depth", "ask_depth"]
    out = "venue string, instrument string, seq long, ts_ingest_ms long, side string, levels_lost long, depth_drop double, severity string, confidence double"

    def __init__(self, ttl: int = KEPT_MS, levels: int = 5, share: float = 0.4):
        super().__init__(ttl)
        self.levels, self.share = levels, share

    def begin(self) -> tuple:
        return 0, 0, -1.0, -1.0

    def fold(self, key, state, row):
        seq, ts, *now = row
        if state[2] < 0:
            return tuple(now), []
        lost = [state[k] - now[k] for k in (0, 1)]
        drop = [(state[k] - now[k]) / state[k] if state[k] > 0 and now[k] < state[k] else 0.0 for k in (2, 3)]
        hit = [n >= self.levels and d >= self.share for n, d in zip(lost, drop)]
        side = 0 if hit[0] and lost[0] >= lost[1] else 1 if hit[1] else None
        if side is None:
            return tuple(now), []
        return tuple(now), [(*key, seq, ts, ("bid", "ask")[side], lost[side], drop[side], *_rated((lost[side], LEVELS_LOST), (drop[side], SIDE_DROP)))]


def _stream(rows: DataFrame, processor: StatefulProcessor, mode: str = "append") -> DataFrame:
    use_state_store(rows.sparkSession)
    return rows.groupBy(*KEYS).transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.out, outputMode=mode, timeMode="ProcessingTime")


def stream_interest(oi: DataFrame, ttl: int = KEPT_MS) -> DataFrame:
    """Change of open interest against the value before, and the cadence of arrivals, of each new row."""
    return _stream(oi.select(*KEYS, "seq", "ts_ingest_ms", "open_interest"), Interest(ttl))


def stream_session_profile(candles: DataFrame, step: float, zone: str = "UTC", open_minutes: int = 0, ttl: int = KEPT_MS) -> DataFrame:
    """Volume by session and price bucket; a trigger gives out the new totals of the buckets it changed (update mode)."""
    typical = (F.col("high") + F.col("low") + 2 * F.col("close")) / 4
    cells = candles.select(*KEYS, session_start(F.col("window_start"), zone, open_minutes).alias("session_start"), bucket(typical, F.lit(step)).alias("price_low"), fixed(F.col("volume")).alias("q"))
    return _stream(cells, SessionProfile(ttl), "update")


def stream_evidence(inputs: DataFrame, rule: Keyed) -> DataFrame:
    """Evidence of one rule (Thinning, Imbalance, Sweeps) over a stream of book inputs."""
    return _stream(inputs.select(*KEYS, *dict.fromkeys([*rule.order, *rule.columns])), rule)


class Snapshots(StatefulProcessor):
    """What is known of each key at every multiple of `every` milliseconds of event time, also when no row came since the one before.

    Rows wait in a map by interval until the watermark has passed its end; a timer stands at the end of the first interval that isn't given
    out. A key without rows for `idle` intervals is forgotten. add(held, row) folds a row into what an interval has, merge(a, b) what two triggers
    brought for one interval, and join(known, held, at) an interval into what is known before; all work on tuples of `kept`. Rows later than
    the watermark never get here, so a row's interval is never one that has been given out.
    """

    def __init__(self, out: str, kept: str, columns: list[str], every: int, idle: int):
        self.out, self.kept, self.columns, self.every, self.idle = out, kept, columns, every, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "interval long", self.kept)
        self.known = handle.getValueState("known", self.kept)
        self.next = handle.getValueState("next", "at long, quiet long")

    def add(self, held: tuple | None, row: tuple) -> tuple:
        raise NotImplementedError

    def join(self, known: tuple | None, held: tuple, at: int) -> tuple:
        return held

    def rows(self, key: tuple, known: tuple, at: int) -> list[tuple]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame, found = pd.concat(list(rows)), {}
        for row in zip(*(frame[c].tolist() for c in self.columns)):
            interval = row[0] - row[0] % self.every
            found[interval] = self.add(found.get(interval), row)
        at = self.next.get()[0] if self.next.exists() else None
        for interval, held in found.items():
            if self.waiting.containsKey((interval,)):
                held = self.merge(self.waiting.getValue((interval,)), held)
            self.waiting.updateValue((interval,), held)
            if at is None or interval + self.every < at:
                at = interval + self.every
        if at is not None and (not self.next.exists() or self.next.get()[0] > at):
            if self.next.exists():
                self.handle.deleteTimer(self.next.get()[0])
            self.next.update((at, 0))
            self.handle.registerTimer(at)
        yield pd.DataFrame([], columns=_names(self.out))

    def merge(self, a: tuple, b: tuple) -> tuple:
        """Of one interval what two triggers brought."""
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, quiet = self.next.get()
        known, out = self.known.get() if self.known.exists() else None, []
        until = timerValues.getCurrentWatermarkInMs()
        while at <= until and quiet < self.idle:
            interval = (at - self.every,)
            if self.waiting.containsKey(interval):
                known, quiet = self.join(known, self.waiting.getValue(interval), at), 0
                self.waiting.removeKey(interval)
            else:
                quiet += 1
            if known is not None:
                out += self.rows(key, known, at)
            at += self.every
        later = [i for (i,) in self.waiting.keys()]
        if quiet >= self.idle and not later:
            self.known.clear()
            self.next.clear()
        else:
            if quiet >= self.idle:
                at, quiet, known = min(later) + self.every, 0, None
                self.known.clear()
            if known is not None:
                self.known.update(tuple(known))
            self.next.update((at, quiet))
            self.handle.registerTimer(at)
        yield pd.DataFrame(out, columns=_names(self.out))

    def close(self) -> None:
        pass


class BookSnapshots(Snapshots):
    """The last book of an interval, by time and number; it stays known through intervals without one."""

    def __init__(self, every: int, idle: int):
        kept = "ts long, seq long, bids string, asks string"
        super().__init__("venue string, instrument string, snapshot_at long, ts_ingest_ms long, seq long, bids string, asks string", kept, ["ts_ingest_ms", "seq", "bids", "asks"], every, idle)

    def add(self, held, row):
        return row if held is None or row[:2] > tuple(held[:2]) else held

    def merge(self, a, b):
        return self.add(tuple(a), tuple(b))

    def rows(self, key, known, at):
        return [(*key, at, *known)]


class CellSnapshots(Snapshots):
    """The sums of a window's cells (of a heatmap or a profile) as they stand at the end of each interval; a new window begins with none."""

    def __init__(self, every: int, idle: int, window: int):
        self.window = window
        super().__init__("venue string, instrument string, snapshot_at long, window_start long, cell string, volume double", "window long, cells array<string>, sums array<long>", ["ts_ingest_ms", "cell", "q"], every, idle)

    def _sum(self, window: int, *parts: tuple[list, list]) -> tuple:
        sums: dict[str, int] = {}
        for cells, values in parts:
            for c, v in zip(cells, values):
                sums[c] = sums.get(c, 0) + v
        return window, list(sums), list(sums.values())

    def handleInputRows(self, key, rows, timerValues):
        """A trigger's rows are summed by interval and cell at once, so that add sees each pair only once."""
        frame = pd.concat(list(rows))
        frame["ts_ingest_ms"] -= frame["ts_ingest_ms"] % self.every
        yield from super().handleInputRows(key, iter([frame.groupby(["ts_ingest_ms", "cell"], as_index=False)["q"].sum()]), timerValues)

    def add(self, held, row):
        ts, cell, q = row
        if held is None:
            return ts - ts % self.window, [cell], [q]
        held[1].append(cell)
        held[2].append(q)
        return held

    def merge(self, a, b):
        return self._sum(a[0], a[1:], b[1:])

    def join(self, known, held, at):
        return held if known is None or known[0] != held[0] else self._sum(held[0], known[1:], held[1:])

    def rows(self, key, known, at):
        window, cells, sums = known
        if at > window + self.window:  # the window is over and no row came in a new one
            return []
        return [(*key, at, window, c, v / SCALE) for c, v in sorted(zip(cells, sums))]


def _on_timers(rows: DataFrame, processor: Snapshots) -> DataFrame:
    use_state_store(rows.sparkSession)
    return rows.groupBy(*KEYS).transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.out, outputMode="append", timeMode="EventTime")


def _timed(rows: DataFrame, delay: str) -> DataFrame:
    return rows.withColumn("event_time", F.timestamp_millis("ts_ingest_ms")).withWatermark("event_time", delay)


def stream_book_snapshots(books: DataFrame, every: int, delay: str = "0 seconds", idle: int = 60) -> DataFrame:
    """Each book as of every multiple of `every` ms: snapshot_at, the time and number of the book then, its levels as JSON.

    A book without rows for `idle` intervals is forgotten; `delay` is how late a row may be.
    """
    rows = _timed(books, delay).select(*KEYS, "event_time", "ts_ingest_ms", "seq", F.to_json("bids").alias("bids"), F.to_json("asks").alias("asks"))
    return _on_timers(rows, BookSnapshots(every, idle))


def stream_cell_snapshots(rows: DataFrame, cell: Callable[[], F.Column], size: str, every: int, window: int, delay: str = "0 seconds", idle: int = 60) -> DataFrame:
    """The sums of `size` by cell (a bucket of a heatmap or profile, as text) of the open window of `window` ms, as of every multiple of `every` ms."""
    timed = _timed(rows, delay).select(*KEYS, "event_time", "ts_ingest_ms", cell().cast("string").alias("cell"), fixed(F.col(size)).alias("q"))
    return _on_timers(timed, CellSnapshots(every, idle, window))
