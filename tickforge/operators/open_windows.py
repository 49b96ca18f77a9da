"""Candles with one open window a series and a bounded number of series at once: where there are too many, the oldest window is closed by force."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tickforge.functions.columns import SCALE, fixed
from tickforge.operators.windows import numbered
from tickforge.workers import cut, prepare

KEYS = ["venue", "instrument"]
#: Series that one shard keeps a window open for.
MOST_OPEN = 96
OUT = "venue string, instrument string, window_start long, open double, high double, low double, close double, volume double, trade_count long, late long, closed_by string"
_NAMES = [x.split()[0] for x in OUT.split(", ")]
_SCHEMA = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[x.split()[1]]) for x in OUT.split(", ")])
_WINDOW = "venue string, instrument string, window_start long, open double, high double, low double, close double, volume long, trade_count long, late long"


class OpenWindows:
    """The open windows of a shard: by series [start, open, high, low, close, volume, trades, late], and a heap of (start, series) to find the oldest.

    A heap entry whose start isn't its series' any more is passed over.
    """

    def __init__(self, ms: int, most: int = MOST_OPEN):
        self.ms, self.most = ms, most
        self.held: dict[tuple, list] = {}
        self.heap: list[tuple] = []

    def _begin(self, series: tuple, start: int, price: float, size: int) -> None:
        self.held[series] = [start, price, price, price, price, size, 1, 0]
        heappush(self.heap, (start, series))

    def _end(self, series: tuple, by: str) -> tuple:
        w = self.held.pop(series)
        return (*series, *w[:5], w[5] / SCALE, *w[6:], by)

    def add(self, series: tuple, ts: int, price: float, size: int) -> list[tuple]:
        """Fold a trade in; the windows that it closes. A trade of a window before its series' open one is late, and counted."""
        start, w = ts - ts % self.ms, self.held.get(series)
        if w is None:
            out = []
            if len(self.held) >= self.most:
                while True:
                    old, name = heappop(self.heap)
                    if name in self.held and self.held[name][0] == old:
                        break
                out.append(self._end(name, "force"))
            self._begin(series, start, price, size)
            return out
        if start < w[0]:
            w[7] += 1
            return []
        if start > w[0]:
            out = [self._end(series, "later trade")]
            self._begin(series, start, price, size)
            return out
        w[2], w[3], w[4] = max(w[2], price), min(w[3], price), price
        w[5], w[6] = w[5] + size, w[6] + 1
        return []

    def rest(self) -> list[tuple]:
        return [self._end(s, "end") for s in sorted(self.held)]


def _valid(trades: DataFrame) -> DataFrame:
    return trades.where("price > 0 and size > 0").withColumn("q", fixed(F.col("size")))


def bounded_windows(trades: DataFrame, ms: int, most: int = MOST_OPEN, shards: int = 16, arrival: tuple[str, ...] = ("ts_ingest_ms", "event_id"), time_col: str = "ts_exchange_ms", slice_ms: int = 10_000, block: int = 65_536, rounds: int = 8) -> DataFrame:
    """Candles in order of arrival, with what closed each: a later trade of its series, force, or the end of the input.

    Series are dealt out to `shards` by a hash of their names, and each shard keeps at most `most` windows open. A trade of a series without
    an open window, where there is no room, first closes the window that began first (of equal ones that of the least name).

    A shard is cut into blocks of rows, which are many tasks' work. A block first begins with the windows that the block before it leaves open
    if that one began with none; blocks are gone through again while what they were given isn't what the block before leaves, so the result is
    that of one pass in order. A round settles at least one more block of each shard, and as a rule all of them. Where a window stays open for
    blocks on end, shards that `rounds` rounds don't settle are read in order, by a task each. Rows are numbered by slices of slice_ms of the
    first arrival column, in milliseconds.
    """
    prepare(trades.sparkSession)
    own = ["_shard", "_block"]
    rows = _valid(trades).withColumn("_shard", F.pmod(F.xxhash64(*KEYS), F.lit(shards)))
    rows = numbered(rows, ["_shard"], F.coalesce(F.expr(f"{arrival[0]} div {slice_ms}"), F.lit(-(2**63))), list(arrival), "_n").withColumn("_block", F.expr(f"(_n - 1) div {block}"))
    rows = cut(rows.select(*own, "_n", *KEYS, F.col(time_col).alias("_ts"), "price", "q"))
    ends = rows.groupBy("_shard").agg(F.max("_block").alias("_block"))
    begun = f"_shard {dict(rows.dtypes)['_shard']}, _block long, open array<struct<{', '.join(x.replace(' ', ': ') for x in _WINDOW.split(', '))}>>"
    held = pa.list_(pa.struct([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[x.split()[1]]) for x in _WINDOW.split(", ")]))

    def run(left: pa.Table, right: pa.Table) -> tuple[OpenWindows, list[tuple]]:
        table, out, left = OpenWindows(ms, most), [], left.sort_by("_n")
        for w in (right.column("open")[0].as_py() or []) if right.num_rows else []:
            venue, instrument, *rest = w.values()
            table.held[venue, instrument] = rest
            heappush(table.heap, (rest[0], (venue, instrument)))
        for venue, instrument, ts, price, q in zip(*(left.column(c).to_pylist() for c in [*KEYS, "_ts", "price", "q"])):
            out += table.add((venue, instrument), ts, price, q)
        return table, out

    def leaves(left: pa.Table, right: pa.Table) -> pa.Table:
        table, _ = run(left, right)
        names = [f.name for f in held.value_type]
        state = [dict(zip(names, (*series, *w))) for series, w in sorted(table.held.items())]
        return left.slice(0, 1).select(own).append_column("open", pa.array([state][: left.num_rows], held))

    def closes(left: pa.Table, right: pa.Table) -> pa.Table:
        table, out = run(left, right)
        if left.num_rows and left.column("_last")[0].as_py():
            out += table.rest()
        return pa.Table.from_batches([_batch(out)])

    def gone_through(some: DataFrame, given: DataFrame) -> DataFrame:
        return cut(some.groupBy(*own).cogroup(given.groupBy(*own)).applyInArrow(leaves, begun))

    given = trades.sparkSession.createDataFrame([], begun)
    after, unsettled = gone_through(rows, given), None
    for k in range(rounds + 1):
        wanted = after.withColumn("_block", F.col("_block") + 1).join(ends.withColumnRenamed("_block", "_end"), "_shard").where("_block <= _end").drop("_end")
        changed = cut(wanted.join(given.withColumnRenamed("open", "had"), own, "left").where("not (open <=> had)").select(*own, "open"))
        if not changed.take(1):
            break
        if k == rounds:
            unsettled = changed.select("_shard").distinct()
            break
        again = gone_through(rows.join(changed.select(*own), own, "left_semi"), changed)
        given = cut(given.join(changed.select(*own), own, "left_anti").unionByName(changed))
        after = cut(after.join(again.select(*own), own, "left_anti").unionByName(again))
    settled = rows if unsettled is None else rows.join(unsettled, "_shard", "left_anti")
    if unsettled is not None:
        given = given.join(unsettled, "_shard", "left_anti")
    last = settled.join(F.broadcast(ends.withColumnRenamed("_block", "_end")), "_shard").withColumn("_last", F.col("_block") == F.col("_end")).drop("_end")
    out = last.groupBy(*own).cogroup(given.groupBy(*own)).applyInArrow(closes, OUT)
    return out if unsettled is None else out.unionByName(_in_order(rows.join(unsettled, "_shard", "left_semi"), ms, most, shards))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(_SCHEMA), _SCHEMA)], schema=_SCHEMA)


def _in_order(rows: DataFrame, ms: int, most: int, shards: int) -> DataFrame:
    """Shards from end to end, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, table = None, OpenWindows(ms, most)
        for batch in batches:
            out = []
            for shard, venue, instrument, ts, price, q in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != at:
                    out += table.rest()
                    at, table = shard, OpenWindows(ms, most)
                out += table.add((venue, instrument), ts, price, q)
            yield _batch(out)
        yield _batch(table.rest())

    dealt = rows.repartition(shards, "_shard").sortWithinPartitions("_shard", "_n")
    return dealt.select("_shard", *KEYS, "_ts", "price", "q").mapInArrow(run, OUT)


class _Shard(StatefulProcessor):
    """The same as state of a stream: the open windows of a shard are a map by series."""

    def __init__(self, ms: int, most: int, arrival: list[str]):
        self.ms, self.most, self.arrival = ms, most, arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "venue string, instrument string", ", ".join(_WINDOW.split(", ")[2:]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table, out = OpenWindows(self.ms, self.most), []
        for series, w in self.open.iterator():
            table.held[tuple(series)] = list(w)
            heappush(table.heap, (w[0], tuple(series)))
        before = set(table.held)
        frame = pd.concat(list(rows)).sort_values(self.arrival, kind="stable")
        for venue, instrument, ts, price, q in zip(*(frame[c].tolist() for c in [*KEYS, "ts", "price", "q"])):
            out += table.add((venue, instrument), ts, price, q)
        for series in before - set(table.held):
            self.open.removeKey(series)
        for series, w in table.held.items():
            self.open.updateValue(series, tuple(w))
        yield pd.DataFrame(out, columns=_NAMES).astype({"window_start": np.int64, "trade_count": np.int64, "late": np.int64})

    def close(self) -> None:
        pass


def stream_bounded_windows(trades: DataFrame, ms: int, most: int = MOST_OPEN, shards: int = 16, arrival: tuple[str, ...] = ("ts_ingest_ms", "event_id"), time_col: str = "ts_exchange_ms") -> DataFrame:
    """bounded_windows over a stream: windows come out as they are closed, and open ones stay. Needs state.use_state_store."""
    rows = _valid(trades).select(F.pmod(F.xxhash64(*KEYS), F.lit(shards)).alias("shard"), *KEYS, F.col(time_col).alias("ts"), "price", "q", *arrival)
    return rows.groupBy("shard").transformWithStateInPandas(statefulProcessor=_Shard(ms, most, list(arrival)), outputStructType=OUT, outputMode="append", timeMode="None")
