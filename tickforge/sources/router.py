"""One table of envelopes of all types, split into typed ticks and a quarantine; payloads are parsed once, as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.functions.columns import instrument_name, side_name, venue_name

LEVELS = "array<struct<price: double, size: double>>"
#: Of each type the version that is read, and the fields of its payload: name, path, kind.
TYPES: dict[str, tuple[int, list[tuple[str, str, str]]]] = {
    "trade": (1, [("price", "$.price", "double"), ("size", "$.size", "double"), ("side", "$.side", "string"), ("trade_id", "$.trade_id", "string")]),
    "bookdelta": (1, [("bids", "$.bids", LEVELS), ("asks", "$.asks", LEVELS), ("is_snapshot", "$.is_snapshot", "boolean"), ("first_id", "$.first_id", "bigint"), ("final_id", "$.final_id", "bigint")]),
    "markprice": (1, [("mark_price", "$.mark_price", "double"), ("index_price", "$.index_price", "double"), ("funding_rate", "$.funding_rate", "double")]),
    "liquidation": (1, [("price", "$.price", "double"), ("size", "$.size", "double"), ("side", "$.side", "string")]),
    "openinterest": (1, [("open_interest", "$.open_interest", "double")]),
}
#: A payload without these isn't one of its type.
NEEDED = {"trade": ["price", "size"], "bookdelta": ["bids", "asks"], "markprice": ["mark_price"], "liquidation": ["price", "size"], "openinterest": ["open_interest"]}
PREFIX = "marketdata."


def parsed(envelopes: DataFrame) -> DataFrame:
    """Envelopes with kind (the type without its prefix, if known), the payload as a VARIANT, and why it goes to quarantine, null if it doesn't."""
    name = F.lower(F.trim("type"))
    kind = F.when(name.startswith(PREFIX), F.substring(name, len(PREFIX) + 1, 100))
    kind = F.when(kind.isin(*TYPES), kind)
    out = envelopes.withColumns({"kind": kind, "v": F.try_parse_json("payload")})
    version = F.create_map(*(F.lit(x) for k, (v, _) in TYPES.items() for x in (k, v)))[F.col("kind")]
    lacks = F.lit(False)
    for k, names in NEEDED.items():
        kinds = {n: (path, t) for n, path, t in TYPES[k][1]}
        missing = F.lit(False)
        for n in names:
            missing = missing | F.try_variant_get("v", *kinds[n]).isNull()
        lacks = lacks | ((F.col("kind") == k) & missing)
    reason = F.when(F.col("kind").isNull(), "unknown_event_type").when(~F.coalesce(F.col("version") == version, F.lit(False)), "unknown_event_version").when(F.col("v").isNull(), "decode_failed").when(lacks, "field_missing")
    return out.withColumn("reason", reason)


def _typed(rows: DataFrame, kind: str) -> DataFrame:
    def field(name: str, path: str, type: str) -> Column:
        got = F.try_variant_get("v", path, type)
        return (side_name(got) if name == "side" else got).alias(name)

    head = [venue_name(F.col("venue")).alias("venue"), instrument_name(F.col("instrument")).alias("instrument"), "seq", F.col("ts_ingest").alias("ts_ingest_ms"), F.coalesce(F.expr("nullif(ts_exchange, 0)"), F.try_variant_get("v", "$.timestamp", "bigint")).alias("ts_exchange_ms"), "idempotency_key"]
    return rows.where((F.col("kind") == kind) & F.col("reason").isNull()).select(*head, *(field(*f) for f in TYPES[kind][1]))


def route(envelopes: DataFrame) -> dict[str, DataFrame]:
    """A table for each type, and `quarantine` for unknown types and versions, payloads that aren't JSON and payloads that lack a field.

    Works on stored tables and streams alike. Outputs that are written together should come from one parsed table: jobs.fan_out keeps it
    for a batch, and `parsed` may be written and passed to `routed`.
    """
    return routed(parsed(envelopes))


def routed(rows: DataFrame) -> dict[str, DataFrame]:
    """route, for envelopes that are parsed already."""
    names = ["type", "version", "venue", "instrument", "seq", "idempotency_key", "reason"]
    return {k: _typed(rows, k) for k in TYPES} | {"quarantine": rows.where("reason is not null").select(*names, F.sha2("payload", 256).alias("payload_sha256"))}
