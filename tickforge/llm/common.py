"""Helpers shared by the text operators."""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and set the session's checkpoint folder (spark.checkpoint.dir) where none is set.

    Without either, a session on one machine gets a temporary folder; executors elsewhere couldn't read it, so there it is an error.
    """
    sc = spark.sparkContext
    paths = sc.environment.get("PYTHONPATH", "")
    if REPO not in paths.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, paths) if x)
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tickforge-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder, so that later jobs neither repeat its work nor depend on one executor."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sampled(docs: DataFrame, rows: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """About `rows` rows of docs (all, if there are no more), picked by a hash of id and length wherever they lie."""
    n = docs.count()
    if n <= rows:
        return docs
    place = F.pmod(F.xxhash64(id, F.length(text)), F.lit(1 << 40))
    return docs.where(place < F.lit(int((1 << 40) * rows / n)))


#: Keys of at least a so-manieth of all rows are matched by broadcast (there are at most as many of them).
HOT_SHARE, HOT_LEAST = 4096, 1000


def with_owner(rows: DataFrame, table: DataFrame, key: str, weight: str, unmatched: Column | None = None) -> DataFrame:
    """rows with the columns of table, which has one row for each key and the number of rows that have it (weight); null where there is none.

    The rows of a very frequent key would meet in one task, so those keys are broadcast, and the shuffle spreads rows that are done with, or
    that are known to match nothing (unmatched, or a null key). table is read three times.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    names = [c for c in table.columns if c != key]
    many = table.where(F.col(weight) >= max(HOT_LEAST, total // HOT_SHARE)).select(F.col(key), *(F.col(c).alias(f"__hot_{c}") for c in names))
    rows = rows.join(F.broadcast(many), key, "left")
    done = F.col(f"__hot_{weight}").isNotNull()
    alone = done | F.col(key).isNull() if unmatched is None else done | F.col(key).isNull() | unmatched
    rows = rows.withColumn("__salt", F.when(alone, F.monotonically_increasing_id() + 1).otherwise(0))
    found = rows.join(table.withColumn("__salt", F.lit(0).cast("long")), [key, "__salt"], "left")
    for c in names:
        found = found.withColumn(c, F.when(done, F.col(f"__hot_{c}")).otherwise(F.col(c)))
    return found.drop("__salt", *(f"__hot_{c}" for c in names))


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sha256(text) -> "F.Column":
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of each text; null becomes empty."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` words, in order; the run's length is part of it."""
    n = len(words) - size + 1
    if n <= 0 or size <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h = (h ^ (h >> _SHIFT)) * _MULTIPLY + words[j : j + n]
    h = (h ^ (h >> _SHIFT)) * _MULTIPLY
    return h ^ (h >> np.uint64(32))


SPACE = b" \t\n\v\f\r"
#: Bytes hashed at once; a longer text is cut between words.
_SLICE = 2 << 20


def _byte_values(fold: bool) -> np.ndarray:
    """A 64-bit value for each byte, by the splitmix steps; 0 for white space, and A-Z as a-z if folded."""
    x = np.arange(1, 257, dtype=np.uint64) * _MULTIPLY
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    if fold:
        x[65:91] = x[97:123]
    x[list(SPACE)] = 0
    return x


_VALUES = {fold: _byte_values(fold) for fold in (False, True)}
_IS_SPACE = np.isin(np.arange(256), list(SPACE))
_BASE = 0xD6E8FEB86659FD93
_POWERS: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))
    return _POWERS


def _slice_hashes(buf: bytes, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a text that ends in white space."""
    at = np.frombuffer(buf, np.uint8)
    edges = np.flatnonzero(np.diff(_IS_SPACE[at].view(np.int8), prepend=np.int8(1)))
    starts, ends = edges[0::2], edges[1::2]
    power, inverse = _powers(len(at))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values[at] * power[: len(at)])])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h = (h ^ (h >> _SHIFT)) * _MULTIPLY
    return h ^ (h >> np.uint64(32)), starts


def word_hashes(texts: list[bytes], fold: bool = False) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its words, runs of bytes that aren't ASCII white space; fold: A-Z count as a-z.

    A word's hash is a polynomial over its bytes, taken for all words at once from running sums.
    """
    values, out, k = _VALUES[fold], [], 0
    while k < len(texts):
        if len(texts[k]) > _SLICE:
            parts, rest = [], memoryview(texts[k])
            while len(rest):
                cut_at = len(rest)
                if cut_at > _SLICE:
                    part = bytes(rest[:_SLICE])
                    cut_at = max(part.rfind(bytes([c])) for c in SPACE) + 1
                    if not cut_at:  # one word longer than a slice
                        found = np.flatnonzero(_IS_SPACE[np.frombuffer(rest, np.uint8)])
                        cut_at = int(found[0]) + 1 if len(found) else len(rest)
                parts.append(_slice_hashes(bytes(rest[:cut_at]) + b"\n", values)[0])
                rest = rest[cut_at:]
            out.append(np.concatenate(parts))
            k += 1
            continue
        first, size = k, 0
        while k < len(texts) and size + len(texts[k]) <= _SLICE:
            size += len(texts[k]) + 1
            k += 1
        hashes, starts = _slice_hashes(b"\n".join(texts[first:k]) + b"\n", values)
        ends = np.cumsum([len(x) + 1 for x in texts[first:k]])
        out += np.split(hashes, np.searchsorted(starts, ends)[:-1])
    return out
