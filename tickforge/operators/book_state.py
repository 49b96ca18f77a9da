"""Books kept message by message: what a stream holds as state, and the same over stored changes."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.workers import prepare

KEYS = ["venue", "instrument"]
#: Levels a side may have; those furthest from the middle go.
MOST = 1000
OUT = "venue string, instrument string, seq long, status string, best_bid double, best_ask double, spread_bps double, bid_levels long, ask_levels long, checksum long"
_COLUMNS = [x.split()[0] for x in OUT.split(", ")]
_ARROW = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[x.split()[1]]) for x in OUT.split(", ")])


class Book:
    """Levels by price for each side, their prices in order, and the last sequence number."""

    def __init__(self, last_seq: int = 0, bids: dict[float, float] | None = None, asks: dict[float, float] | None = None):
        self.last_seq, self.bids, self.asks = last_seq, bids or {}, asks or {}
        self.bid_prices, self.ask_prices = sorted(self.bids), sorted(self.asks)

    def clear(self) -> None:
        for held in (self.bids, self.asks, self.bid_prices, self.ask_prices):
            held.clear()

    def apply(self, seq: int, is_snapshot: bool, levels: Iterable[tuple[str, float, float]], most: int = MOST) -> str:
        """ok; out_of_order (nothing changes); or needs_resync: best bid and ask had met, and the book starts anew."""
        if seq <= self.last_seq and not is_snapshot:
            return "out_of_order"
        if is_snapshot:
            self.clear()
        for side, price, size in levels:
            book, prices = (self.bids, self.bid_prices) if side == "bid" else (self.asks, self.ask_prices)
            if size > 0:
                if price not in book:
                    insort(prices, price)
                book[price] = size
            elif book.pop(price, None) is not None:
                del prices[bisect_left(prices, price)]
        while len(self.bid_prices) > most:
            del self.bids[self.bid_prices.pop(0)]
        while len(self.ask_prices) > most:
            del self.asks[self.ask_prices.pop()]
        self.last_seq = seq
        if self.bids and self.asks and self.bid_prices[-1] >= self.ask_prices[0]:
            self.clear()
            return "needs_resync"
        return "ok"

    def checksum(self) -> int:
        """CRC-32 of prices and sizes, best first, bids before asks."""
        packed = lambda book, prices: np.array([(p, book[p]) for p in prices], "<f8").tobytes()
        return zlib.crc32(packed(self.asks, self.ask_prices), zlib.crc32(b"\xff", zlib.crc32(packed(self.bids, reversed(self.bid_prices)))))

    def row(self, key: tuple, seq: int, status: str, checksums: bool = True) -> tuple:
        bid, ask = self.bid_prices[-1] if self.bid_prices else None, self.ask_prices[0] if self.ask_prices else None
        bps = (ask - bid) / ((ask + bid) / 2) * 10_000 if bid and ask else -1.0
        return (*key, seq, status, bid, ask, bps, len(self.bids), len(self.asks), self.checksum() if checksums else None)


def fold(book: Book, key: tuple, rows: pd.DataFrame) -> list[tuple]:
    """Apply the messages of rows, which come in order, each as one or more rows of equal seq."""
    out = []
    ends = np.flatnonzero(np.diff(rows["seq"].to_numpy(), append=-1))
    seqs, snaps = rows["seq"].tolist(), rows["is_snapshot"].tolist()
    levels = list(zip(rows["side"].tolist(), rows["price"].tolist(), rows["size"].tolist()))
    at = 0
    for end in ends.tolist():
        out.append(book.row(key, seqs[at], book.apply(seqs[at], snaps[at], levels[at : end + 1])))
        at = end + 1
    return out


#: Messages of a stretch in which snapshots are counted on their own.
SLICE = 4096


def book_states(deltas: DataFrame, checksums: bool = True) -> DataFrame:
    """The book after every message. As a snapshot starts the book anew, the stretches between snapshots are dealt out apart.

    A row holds a message. Its stretch's number is the snapshots in earlier slices of messages and in its own up to it, so that no task orders
    a whole series. A task reads its rows in order and keeps one book, so memory holds a batch and a book, however long a stretch is.
    """
    prepare(deltas.sparkSession)
    levels = F.array_sort(F.collect_list(F.struct("side", "price", "size")))
    messages = deltas.groupBy(*KEYS, "seq").agg(F.max("is_snapshot").alias("snap"), levels.alias("x")).withColumn("slice", F.expr(f"seq div {SLICE}"))
    earlier = Window.partitionBy(*KEYS).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = deltas.groupBy(*KEYS, F.expr(f"seq div {SLICE}").alias("slice")).agg(F.count_distinct(F.when(F.col("is_snapshot"), F.col("seq"))).alias("n"))
    before = slices.select(*KEYS, "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = F.count_if("snap").over(Window.partitionBy(*KEYS, "slice").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = messages.withColumn("within", within).join(before, [*KEYS, "slice"])
    rows = rows.select(*KEYS, (F.col("before") + F.col("within")).alias("epoch"), "seq", "snap", "x.side", "x.price", "x.size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, book = None, Book()
        for batch in batches:
            out = []
            for venue, instrument, epoch, seq, snap, sides, prices, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                if (venue, instrument, epoch) != at:
                    at, book = (venue, instrument, epoch), Book()
                out.append(book.row((venue, instrument), seq, book.apply(seq, snap, zip(sides, prices, sizes)), checksums))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(_ARROW), _ARROW)], schema=_ARROW)

    return rows.repartition(*KEYS, "epoch").sortWithinPartitions(*KEYS, "epoch", "seq").mapInArrow(run, OUT)


_STATE = "last_seq long, bid_prices array<double>, bid_sizes array<double>, ask_prices array<double>, ask_sizes array<double>"


def stream_books(deltas: DataFrame) -> DataFrame:
    """The same over a stream of changes: the state of each book is its levels and last sequence number.

    Within a micro-batch messages are applied in the order of `arrival` (a column that grows with arrival). As rows reach the operator in any
    order, a task holds what one trigger brings for one book: bound the source (maxFilesPerTrigger, maxBytesPerTrigger).
    """

    prepare(deltas.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        book = Book()
        if state.exists:
            last, bp, bs, ap, asz = state.get
            book = Book(last, dict(zip(bp, bs)), dict(zip(ap, asz)))
        rows = pd.concat(list(frames)).sort_values(["arrival", "seq"], kind="stable")
        out = fold(book, key, rows)
        state.update((book.last_seq, list(book.bids), list(book.bids.values()), list(book.asks), list(book.asks.values())))
        yield pd.DataFrame(out, columns=_COLUMNS)

    return deltas.groupBy(*KEYS).applyInPandasWithState(run, OUT, _STATE, "append", "NoTimeout")
