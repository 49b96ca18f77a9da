"""Idempotency keys: 64-bit FNV-1a over fields, in Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The offset basis of 64-bit FNV-1a, as halves of 32 bits, and the low part of its prime, which is 2^40 + 435.
BASIS_HIGH, BASIS_LOW, PRIME_LOW = 0xCBF29CE4, 0x84222325, 435
_MASK = 0xFFFFFFFF


def text_bytes(x: Column) -> Column:
    """The UTF-8 bytes of a string, as numbers; none for null or an empty one."""
    latin = F.decode(F.encode(F.coalesce(x, F.lit("")), "UTF-8"), "ISO-8859-1")  # a character a byte
    return F.when(latin == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(latin, ""), lambda c: F.ascii(c).cast("bigint")))


def long_bytes(x: Column) -> Column:
    """The eight bytes of a long, most significant first; of 0 for null."""
    x = F.coalesce(x.cast("bigint"), F.lit(0).cast("bigint"))
    return F.array(*(F.shiftright(x, k).bitwiseAND(255) for k in range(56, -1, -8)))


def fnv1a(*fields: Column) -> Column:
    """The digest, in lower-case hex without leading zeros, of fields (arrays of bytes) with a zero byte between each two.

    A product modulo 2^64 is taken in halves: times the prime is times 435 and a shift by 40 bits, so nothing overflows.
    """
    parts = [fields[0]]
    for f in fields[1:]:
        parts += [F.array(F.lit(0).cast("bigint")), f]

    def step(held: Column, byte: Column) -> Column:
        low = held["low"].bitwiseXOR(byte)
        product = low * PRIME_LOW
        high = held["high"] * PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(_MASK).alias("high"), product.bitwiseAND(_MASK).alias("low"))

    begin = F.struct(F.lit(BASIS_HIGH).cast("bigint").alias("high"), F.lit(BASIS_LOW).cast("bigint").alias("low"))
    whole = F.aggregate(F.concat(*parts), begin, step, lambda h: F.concat(F.hex(h["high"]), F.lpad(F.hex(h["low"]), 8, "0")))
    return F.lower(F.regexp_replace(whole, "^0+(?=.)", ""))


def stream_key(venue: Column, instrument: Column, kind: Column, seq: Column) -> Column:
    """The key of an event that brings none: its stream, type and number."""
    return fnv1a(text_bytes(venue), text_bytes(instrument), text_bytes(kind), long_bytes(seq))


def window_key(*fields: Column) -> Column:
    """The key of a stored row: its fields as text."""
    return fnv1a(*(text_bytes(f.cast("string")) for f in fields))
