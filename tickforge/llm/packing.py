"""Packing token pieces of documents into sequences of fixed length: best fit, then swaps between underfull bins."""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm.common import cut, prepare

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CAPACITY = 2048
#: Pieces that one task packs together, on average.
GROUP = 8192
#: The most rounds of swaps over a group's underfull bins.
ROUNDS = 6
#: Items of a bin, largest first, that a swap of two looks at.
PAIRED = 8
END = np.array([0], "<u4").tobytes()
#: Fixed value: the vocabulary's one special token and its id; in a text it is that id, as the tokenizers library has it.
SPECIAL = {"<|endoftext|>": 50256}


class Encoder:
    """Token ids, as little-endian bytes. The rank file holds the vocabulary of byte_bpe_50k.json, and gives its ids."""

    def __init__(self, path: str = RANKS):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.inner = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)

    def encode(self, text: str) -> bytes:
        return np.array(self.inner.encode(text, allowed_special="all"), "<u4").tobytes()


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str = RANKS, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece: a text's ids, then id 0, cut at multiples of capacity from the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            names, texts, out = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), []
            for name, text in zip(names, texts):
                raw = encode(text or "") + END
                n = len(raw) // 4
                for k, end in enumerate(range(n % capacity or capacity, n + 1, capacity)):
                    start = max(0, end - capacity)
                    out.append((name, k, start, end - start, zlib.crc32(memoryview(raw)[4 * start : 4 * end])))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin with room."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        at = bisect_left(free, (n, -1))
        if at == len(free):
            room, b = capacity, len(bins)
            bins.append([])
        else:
            room, b = free.pop(at)
        bins[b].append(i)
        if room > n:
            insort(free, (room - n, b))
    return bins


class _Stock:
    """The items of the bins that may still give: a bit for each size present, and the bins that hold it."""

    def __init__(self) -> None:
        self.bits, self.holders = 0, {}

    def add(self, size: int, bin: int) -> None:
        held = self.holders.setdefault(size, {})
        held[bin] = held.get(bin, 0) + 1
        self.bits |= 1 << size

    def drop(self, size: int, bin: int) -> None:
        held = self.holders[size]
        held[bin] -= 1
        if not held[bin]:
            del held[bin]
            if not held:
                self.bits ^= 1 << size

    def largest(self, most: int) -> int:
        """The largest size present up to most, or 0."""
        return max(0, (self.bits & ((2 << most) - 1)).bit_length() - 1) if most > 0 else 0

    def bin_of(self, size: int) -> int:
        return next(reversed(self.holders[size]))


def improve(bins: list[list[int]], lengths: list[int], capacity: int, rounds: int = ROUNDS) -> list[list[int]]:
    """Moves and one-for-one, two-for-one and one-for-two swaps that fill the fuller bin of two; bins that run empty go.

    A fuller bin takes d more tokens from one that is not fuller, so the sum of squared fills grows with every step.
    """
    full = [b for b in bins if sum(lengths[i] for i in b) == capacity]
    bins = [b for b in bins if sum(lengths[i] for i in b) < capacity]
    for _ in range(rounds):
        fill = [sum(lengths[i] for i in b) for b in bins]
        stock, changed = _Stock(), False
        for b, items in enumerate(bins):
            for i in items:
                stock.add(lengths[i], b)
        for b in sorted(range(len(bins)), key=lambda b: (-fill[b], b)):
            items = bins[b]
            for i in items:
                stock.drop(lengths[i], b)
            while items and fill[b] < capacity:
                room = capacity - fill[b]
                best: tuple[int, tuple[int, ...], int] = (0, (), 0)  # gain, what b gives, what it takes
                few = sorted(items, key=lambda i: -lengths[i])[:PAIRED]
                for out in [(), *((i,) for i in few), *combinations(few, 2)]:
                    given = sum(lengths[i] for i in out)
                    taken = stock.largest(min(capacity, given + room))
                    if taken - given > best[0]:
                        best = (taken - given, out, taken)
                    if best[0] == room:
                        break
                two = ()
                for i in few[:3] if best[0] < room else ():  # two of another bin for one of this
                    taken = stock.largest(lengths[i] + room - 1)
                    if not taken:
                        continue
                    held = bins[stock.bin_of(taken)]
                    first = next(k for k in held if lengths[k] == taken)
                    second = max((k for k in held if k != first and lengths[k] <= lengths[i] + room - taken), key=lambda k: lengths[k], default=None)
                    if second is not None and taken + lengths[second] - lengths[i] > best[0]:
                        best, two = (taken + lengths[second] - lengths[i], (i,), taken), (second,)
                if best[0] <= 0:
                    break
                _, out, taken = best
                a = stock.bin_of(taken)
                if fill[a] > fill[b] or a == b:
                    break
                got = [next(k for k in bins[a] if lengths[k] == taken and k not in two), *two]
                for k in got:
                    bins[a].remove(k)
                    stock.drop(lengths[k], a)
                    items.append(k)
                for i in out:
                    items.remove(i)
                    bins[a].append(i)
                    stock.add(lengths[i], a)
                gain = sum(lengths[k] for k in got) - sum(lengths[i] for i in out)
                fill[b] += gain
                fill[a] -= gain
                changed = True
        full += [b for b, n in zip(bins, fill) if n == capacity]
        left = [b for b, n in zip(bins, fill) if 0 < n < capacity]
        emptied, bins = len(bins) - len(left), left
        if not changed or not emptied:
            break
    return full + bins


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indices with at most capacity each."""
    whole = [[i] for i, n in enumerate(lengths) if n == capacity]
    part = [i for i, n in enumerate(lengths) if n < capacity]
    short = [lengths[i] for i in part]
    return whole + [[part[i] for i in b] for b in improve(best_fit(short, capacity), short, capacity)]


def pack(docs: DataFrame, path: str = RANKS, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """A row for each piece of each row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null or empty text is one piece of the single id 0. Repeated rows, and rows without a doc_id, are packed each on
    its own. Pieces are dealt at random into groups of about `group`, however many documents there are, and a task
    packs one group; a group leaves about one bin less than half full. sequence_id has the group's number above bit 32.
    """
    prepare(docs.sparkSession)
    cutup = cut(pieces(docs, path, capacity))
    groups = max(1, -(-cutup.count() // group))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = rows.column("length").to_pylist()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        base = (rows.column("g")[0].as_py() if len(lengths) else 0) << 32
        for s, b in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in b:
                sequence[i], offset[i] = base + s, at
                at += lengths[i]
        return rows.drop_columns(["g"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    dealt = cutup.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(run, _PIECES + ", sequence_id long, offset long")
