"""Maximal periodic runs of words: overlapping tiles for each octave of periods, solved apart by Z-functions, stitched by document and period.

Periods from Q to 2Q - 1 (Q a power of two) form an octave. Its tiles begin at multiples of 2Q and are 6Q words long. A run of period q in
the octave has at least 4q words, so a tile begins within its first 2Q words and one ends within its last 2Q. A forward Z-function from a
tile's first word and a backward one from its last give the stretches of period q there; neighbouring tiles share 4Q > q words, so
stretches of one run overlap by q words or more and stretches of different runs never do.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.llm.common import cut, partitions, prepare, texts_of, word_hashes

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 6, 4
#: Words that a row of neighbouring tiles holds (one tile may be longer).
ROW_WORDS = 16384
_NONE = hashlib.sha256(b"").hexdigest()
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def order_of_words(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a document chosen by the checksum of its id: which original word stands at each place; None: the words stand as they are."""
    h = 0 if doc_id is None else zlib.crc32(b"%d" % doc_id)
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _holds(h: np.ndarray, at: int, q: int) -> bool:
    """Whether word `at` and the one q later are equal and lie in a stretch of period q that is long enough to be a run."""
    reach, need = (TIMES - 1) * q + LEAST, max(LEAST, TIMES * q) - q
    lo, hi = max(0, at - reach), min(len(h) - q, at + reach + 1)
    other = np.flatnonzero(h[lo:hi] != h[lo + q : hi + q]) + lo
    k = int(np.searchsorted(other, at))
    end = int(other[k]) if k < len(other) else hi
    return end - (int(other[k - 1]) if k else lo - 1) - 1 >= need


def tile_ends(h: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each octave Q of a document's word hashes: where tiles begin, and where tiles end, that may have a stretch of such a period.

    Windows of Q words are hashed by doubling. A stretch of 2q words from a tile's first word has equal windows there and q words on.
    """
    n, size, w = len(h), 1, h
    while TIMES * size <= n and n >= LEAST:
        step = 2 * size
        full = len(w) // step
        rows = w[: full * step].reshape(full, step)
        same = rows[:, size:] == rows[:, :1]
        if same.any():
            r, c = np.nonzero(same)
            found = np.stack([r * step, c + size])
        else:
            found = np.empty((2, 0), np.int64)
        rest = w[full * step :]
        if len(rest) > size:
            c = np.flatnonzero(rest[size:] == rest[0]) + size
            found = np.concatenate([found, np.stack([np.full(len(c), full * step), c])], 1)
        back = np.empty((2, 0), np.int64)
        count = n // step - 1
        if count > 0:
            same = w[1 : 1 + count * step].reshape(count, step)[:, size:] == w[3 * size :: step][:count, None]
            if same.any():
                r, c = np.nonzero(same)
                back = np.stack([(r + 2) * step, step - 1 - c])
        # at most as much work as reading the document a few times; beyond that nearly all of them hold
        if found.shape[1] and found.shape[1] * size < 4 * n:
            found = found[:, [_holds(h, int(c), int(q)) for c, q in found.T]]
        if back.shape[1] and back.shape[1] * size < 4 * n:
            back = back[:, [_holds(h, int(d - q) - 1, int(q)) for d, q in back.T]]
        if found.shape[1] or back.shape[1]:
            yield size, np.unique(found[0]), np.unique(back[0])
        if len(w) <= size:
            break
        w = (w[:-size] ^ (w[:-size] >> np.uint64(29))) * _MULTIPLY + w[size:]
        w ^= w >> np.uint64(32)
        size = step


def tile_rows(h: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
    """Rows of neighbouring tiles: octave, first word, begins, ends (from that word), word hashes."""
    n = len(h)
    for size, begins, ends in tile_ends(h):
        tiles = sorted([(c, min(n, c + 6 * size), 0, c) for c in begins.tolist()] + [(max(0, d - 6 * size), d, 1, d) for d in ends.tolist()])
        k = 0
        while k < len(tiles):
            first, last, marks = tiles[k][0], tiles[k][1], ([], [])
            while k < len(tiles) and tiles[k][0] <= last and (tiles[k][1] <= last or tiles[k][1] - first <= max(ROW_WORDS, 6 * size)):
                last = max(last, tiles[k][1])
                marks[tiles[k][2]].append(tiles[k][3] - first)
                k += 1
            yield size, first, np.array(marks[0], "<i4").tobytes(), np.array(marks[1], "<i4").tobytes(), h[first:last].astype("<u8").tobytes()


def z_values(x: list[int], upto: int) -> list[int]:
    """How many words from i on agree with those from 0 on, for i from 1 below upto (z[0] is 0)."""
    n, upto = len(x), min(upto, len(x))
    z, left, right = [0] * max(upto, 1), 0, 0
    for i in range(1, upto):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if k:
            left, right = i, i + k
    return z


@lru_cache(1 << 16)
def _shorter(q: int) -> tuple[int, ...]:
    """q divided by each of its primes."""
    out, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return (*out, q // rest) if rest > 1 else tuple(out)


def stretches(x: list[int], size: int) -> Iterator[tuple[int, int]]:
    """Each smallest period q of the octave, and the length, of stretches of at least 2q words that begin with x[0]."""
    z = z_values(x, 2 * size)
    for q in range(size, len(z)):
        if z[q] >= q and all(d + z[d] < q + z[q] for d in _shorter(q)):
            yield q, q + z[q]


def solve(size: int, first: int, begins: bytes, ends: bytes, words: bytes) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) of the stretches in a row of tiles, those of one run that overlap by a period or more as one."""
    x = np.frombuffer(words, "<u8").tolist()
    found: dict[int, list[tuple[int, int]]] = {}
    for c in np.frombuffer(begins, "<i4").tolist():
        for q, n in stretches(x[c : c + 6 * size], size):
            found.setdefault(q, []).append((c, c + n))
    for d in np.frombuffer(ends, "<i4").tolist():
        for q, n in stretches(x[max(0, d - 6 * size) : d][::-1], size):
            found.setdefault(q, []).append((d - n, d))
    for q, parts in found.items():
        parts.sort()
        start, end = parts[0]
        for a, b in parts[1:]:
            if a > end - q:
                yield q, first + start, first + end
                start, end = a, b
            end = max(end, b)
        yield q, first + start, first + end


_CUT = "id long, doc_id long, text binary, collapsed string, octave int, first long, begins binary, ends binary, words binary"
_CUT_TYPES = pa.schema([("id", pa.int64()), ("doc_id", pa.int64()), ("text", pa.large_binary()), ("collapsed", pa.string()), ("octave", pa.int32()), ("first", pa.int64()), ("begins", pa.binary()), ("ends", pa.binary()), ("words", pa.large_binary())])
_RUNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (with its text only if a tile may hold a run), and one for each row of tiles."""
    for batch in batches:
        ids, names, texts = batch.column("id").to_pylist(), batch.column("doc_id").to_pylist(), texts_of(batch)
        out, held = [], 0
        for k, h in enumerate(word_hashes(texts)):
            at = order_of_words(names[k], len(h))
            tiles = 0
            for row in tile_rows(h if at is None else h[at]):
                out.append((ids[k], None, None, None, *row))
                tiles, held = tiles + 1, held + len(row[-1])
                if held > 8 << 20:
                    yield _batch(out, _CUT_TYPES)
                    out, held = [], 0
            if tiles:
                out.append((ids[k], names[k], texts[k], None, *[None] * 5))
                held += len(texts[k])
            else:
                words = texts[k].split()
                out.append((ids[k], names[k], None, hashlib.sha256(b" ".join(words if at is None else [words[i] for i in at.tolist()])).hexdigest(), *[None] * 5))
        yield _batch(out, _CUT_TYPES)


_PARTS = pa.schema([("id", pa.int64()), ("period", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, *rows = (batch.column(c).to_pylist() for c in ("id", "octave", "first", "begins", "ends", "words"))
        yield _batch([(i, *part) for i, *row in zip(ids, *rows) for part in solve(*row)], _PARTS)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in _RUNS.split(", ")])
    for batch in batches:
        out = []
        for name, text, runs in zip(batch.column("doc_id").to_pylist(), texts_of(batch), batch.column("runs").to_pylist()):
            words, runs = text.split(), runs or []
            at = order_of_words(name, len(words))
            edges, best, said = np.zeros(len(words) + 1, np.int64), None, hashlib.sha256()
            for r in runs:
                s, n, q = r["start"], r["length"], r["period"]
                said.update(b"%d,%d,%d\n" % (s, n, q))
                edges[s + q] += 1
                edges[s + n] -= 1
                if best is None or n * best[2] > best[1] * q:  # runs come by start, then period, so the first of equals stays
                    best = (s, n, q)
            kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
            kept = (kept if at is None else at[kept]).tolist()
            out.append((name, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], said.hexdigest(), hashlib.sha256(b" ".join([words[i] for i in kept])).hexdigest()))
        yield _batch(out, schema)


def _stitched(parts: DataFrame) -> DataFrame:
    """Stretches of one document and period that overlap by a period or more as one, if long enough."""
    earlier = Window.partitionBy("id", "period").orderBy("start", "end")
    before = F.max("end").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("start") > before - F.col("period")), 1).otherwise(0)
    grouped = parts.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
    runs = grouped.groupBy("id", "period", "run").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"))
    return runs.where(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_runs, start, length, period and exponent_milli of the greatest run, runs_sha256, collapsed_sha256.

    A run is a longest stretch of words of one smallest period q, of max(6, 4q) words or more. Words are compared by 64-bit hashes.
    Documents that checksums of their ids choose are read with their words repeated (order_of_words); a null doc_id is never chosen.
    Null or empty text has no words: no run, and the digest of the empty string twice. Repeated rows give a row each. Other columns aren't read.

    The tiles of all octaves are made where a document is read; those that can't hold a run go at once, by hashed windows. The others, in
    rows of neighbours, are dealt out among all tasks, so that one long document doesn't stay in one, and so are their stretches by document
    and period. Only documents with such tiles are shuffled with their text. A document's runs, fewer than its words, meet in one row.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    made = cut(rows.mapInArrow(_explode, _CUT))
    tiles = made.where("octave is not null").select("id", "octave", "first", "begins", "ends", "words").repartition(partitions(docs), "id", "octave", "first")
    runs = _stitched(tiles.mapInArrow(_solve, "id long, period long, start long, end long"))
    runs = runs.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    texts = made.where("octave is null and text is not null").select("id", "doc_id", "text")
    found = texts.join(runs, "id", "left").select("doc_id", "text", "runs").mapInArrow(_report, _RUNS)
    none = F.lit(None).cast("long")
    plain = made.where("octave is null and text is null").select("doc_id", F.lit(0).cast("long").alias("n_runs"), none.alias("start"), none.alias("length"), none.alias("period"), none.alias("exponent_milli"), F.lit(_NONE).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))
    return plain.unionByName(found)
