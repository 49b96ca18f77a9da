"""Subscriptions: events against filters of which some fields are left open, snapshots and what comes after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a filter; an empty text, a depth of 0 or null leaves a field open.
FIELDS = ["venue", "symbol", "channel", "aggregation", "depth"]


def _text(name: str) -> Column:
    """A field as text; empty where it is open."""
    if name == "depth":
        return F.when(F.col(name) > 0, F.col(name).cast("string")).otherwise("")
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def matched(events: DataFrame, filters: DataFrame, keep: list[str]) -> DataFrame:
    """Events with the columns `keep` of each filter that they fit: every field that a filter sets is equal.

    A filter is looked up by its mask (which fields it sets) and their values. An event is asked for once under each mask that occurs, of which
    there are 32 at most, so the join is one of equal keys however many filters there are; no pair that doesn't fit is ever looked at. An
    event's open field fits only filters that leave it open too.
    """
    mask = sum((F.when(_text(f) != "", 1 << k).otherwise(0) for k, f in enumerate(FIELDS)), F.lit(0))
    asked = filters.select(*(F.col(c).alias(f"_f_{c}") for c in keep), mask.alias("_mask"), *(_text(f).alias(f"_k{k}") for k, f in enumerate(FIELDS)))
    masks = sorted(r[0] for r in asked.select("_mask").distinct().collect())
    if not masks:
        masks = [0]
    keys = {f"_k{k}": F.when(F.col("_mask").bitwiseAND(1 << k) != 0, _text(f)).otherwise("") for k, f in enumerate(FIELDS)}
    copies = events.withColumn("_mask", F.explode(F.array(*map(F.lit, masks)))).withColumns(keys)
    names = ["_mask", *keys]
    out = copies.join(asked, names).drop(*names)
    return out.withColumnsRenamed({f"_f_{c}": c for c in keep})


def feed(events: DataFrame, subscriptions: DataFrame, stream: list[str], time_col: str = "ts_ingest_ms") -> DataFrame:
    """What each subscription (id, since, filter fields) is sent: of each stream it fits the newest event up to `since` (kind snapshot), then
    the events after `since` with numbers above the snapshot's (kind delta). Without an event up to `since` all later ones are deltas."""
    hits = matched(events, subscriptions, ["id", "since"])
    key = ["id", *stream]
    rest = [c for c in hits.columns if c not in key]
    old = F.col(time_col) <= F.col("since")
    snapshots = hits.where(old).groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("seq", time_col)).alias("_r"))
    known = snapshots.select(*key, F.col("_r.seq").alias("_last"))
    deltas = hits.where(~old).join(known, key, "left").where(F.col("_last").isNull() | (F.col("seq") > F.col("_last"))).drop("_last")
    return snapshots.select(*key, "_r.*").withColumn("kind", F.lit("snapshot")).unionByName(deltas.withColumn("kind", F.lit("delta")))
