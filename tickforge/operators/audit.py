"""Audits in order of arrival that no task has to make for a whole series: repeats within a bounded memory, changes of owner, digests of runs."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.operators.windows import numbered, running_before
from tickforge.workers import cut, prepare

KEYS = ["venue", "instrument"]
#: Accepted keys that a stream remembers: ticks of any kind; mark prices and liquidations.
TICK_KEYS, CONTENT_KEYS = 1024, 4096


class Ring:
    """The last `size` accepted keys; one that has been pushed out is accepted again. A repeat changes nothing."""

    def __init__(self, size: int, held: list[int] | None = None):
        self.size, self.order = size, deque(held or [])
        self.held = set(self.order)

    def accepts(self, key: int) -> bool:
        if key in self.held:
            return False
        if len(self.order) >= self.size:
            self.held.discard(self.order.popleft())
        self.order.append(key)
        self.held.add(key)
        return True


def first_within(df: DataFrame, keys: list[str], stretch: Column, order: list[str], key: Column, size: int = TICK_KEYS, block: int = 65_536) -> DataFrame:
    """Adds is_repeat: the key is among the last `size` keys that its series accepted. Exact, and no series is one task's work.

    A series is cut into blocks of rows. Each block first begins with what the block before it remembers if that one began with nothing;
    blocks are gone through again while what they were given isn't what the block before ends with, so the last round changes nothing. A
    round settles at least one more block of each series, and as a rule all of them, as a memory is refilled within a block. Keys are
    compared by 64-bit hashes, null ones as one key. stretch must not fall along `order` (see windows.numbered).
    """
    prepare(df.sparkSession)
    own = [*keys, "_block"]
    rows = numbered(df, keys, stretch, order, "_n").withColumns({"_block": F.expr(f"(_n - 1) div {block}"), "_h": F.xxhash64(key)})
    rows = cut(rows)
    slim = rows.select(*own, "_n", "_h")
    kinds = dict(slim.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in own)

    def ring_of(left: pa.Table, right: pa.Table) -> Ring:
        return Ring(size, right.column("ring")[0].as_py() if right.num_rows else None)

    def ends(left: pa.Table, right: pa.Table) -> pa.Table:
        ring = ring_of(left, right)
        if not left.num_rows:
            return left.select(own).append_column("ring", pa.array([], pa.list_(pa.int64())))
        for h in left.sort_by("_n").column("_h").to_pylist():
            ring.accepts(h)
        return left.slice(0, 1).select(own).append_column("ring", pa.array([list(ring.order)], pa.list_(pa.int64())))

    def marks(left: pa.Table, right: pa.Table) -> pa.Table:
        ring, left = ring_of(left, right), left.sort_by("_n")
        return left.select([*own, "_n"]).append_column("is_repeat", pa.array([not ring.accepts(h) for h in left.column("_h").to_pylist()], pa.bool_()))

    def passed(after: DataFrame) -> DataFrame:
        """What each block is given by the one before."""
        return after.withColumn("_block", F.col("_block") + 1)

    def gone_through(some: DataFrame, given: DataFrame) -> DataFrame:
        return cut(some.groupBy(*own).cogroup(given.groupBy(*own)).applyInArrow(ends, f"{schema}, ring array<bigint>"))

    none = slim.select(*own).where("false").withColumn("ring", F.array().cast("array<bigint>"))
    after = gone_through(slim, none)
    given = none
    while True:
        wanted = passed(after)
        blocks = slim.select(*own).distinct()
        had = given.withColumnRenamed("ring", "had")
        changed = cut(wanted.join(blocks, own, "left_semi").join(had, own, "left").where("not (ring <=> had)").select(*own, "ring"))
        if not changed.take(1):
            break
        again = gone_through(slim.join(changed.select(*own), own, "left_semi"), changed)
        given = cut(given.join(changed.select(*own), own, "left_anti").unionByName(changed))
        after = cut(after.join(again.select(*own), own, "left_anti").unionByName(again))
    found = slim.groupBy(*own).cogroup(given.groupBy(*own)).applyInArrow(marks, f"{schema}, _n bigint, is_repeat boolean")
    return rows.join(found, [*own, "_n"]).drop("_block", "_n", "_h")


def ownership_audit(df: DataFrame, window: int = 2048, stretch: int = 3_600_000) -> DataFrame:
    """action and reason of each row of a stream that may change hands: accept, drop or convert_to_resync.

    Rows have seq, ts_ingest_ms, event_id, owner, is_snapshot, handoff_seq (on rows of a new owner: the number up to which the old one went)
    and pending_seq (a resync that is under way up to that number), nulls and 0 standing for none. A row is held against the last accepted
    one before it. Rows at or below their handoff or, if they aren't snapshots, their pending number never move it on.
    """
    set_ = lambda c: F.coalesce(F.col(c), F.lit(0))
    pending = (set_("pending_seq") > 0) & ~F.col("is_snapshot") & (F.col("seq") <= set_("pending_seq"))
    handed = (set_("handoff_seq") > 0) & (F.col("seq") <= set_("handoff_seq"))
    moves = (F.col("seq") > 0) & ~pending & ~handed
    top = F.when(moves, F.struct("seq", "ts_ingest_ms", F.coalesce("owner", F.lit("")).alias("owner")))
    out = running_before(df, KEYS, F.expr(f"ts_ingest_ms div {stretch}"), ["ts_ingest_ms", "event_id"], _last=(F.max, top))
    last, owner = F.coalesce(F.col("_last.seq"), F.lit(0)), F.coalesce("owner", F.lit(""))
    changed = (owner != "") & (F.coalesce(F.col("_last.owner"), F.lit("")) != "") & (owner != F.col("_last.owner"))
    behind = (F.col("_last.ts_ingest_ms") > 0) & (F.col("ts_ingest_ms") > 0) & (F.col("ts_ingest_ms") < F.col("_last.ts_ingest_ms"))
    reason = (
        F.when(F.coalesce(F.col("seq"), F.lit(0)) <= 0, "seq_invalid").when(pending, "resync_overlap").when((last > 0) & (F.col("seq") == last), "replay_duplicate")
        .when(changed & (F.col("seq") <= F.greatest(set_("handoff_seq"), last)), "owner_change").when(F.col("is_snapshot") & handed, "resync_overlap")
        .when((last <= 0) | (F.col("seq") > last), "accept").when(behind | (last - F.col("seq") <= window), "stale_event").otherwise("seq_non_monotonic")
    )
    out = out.withColumn("reason", reason)
    resync = (F.col("reason") == "owner_change") | ((F.col("reason") == "resync_overlap") & ~pending)
    return out.withColumn("action", F.when(F.col("reason") == "accept", "accept").when(resync, "convert_to_resync").otherwise("drop")).drop("_last")


def run_digest_in_order(df: DataFrame, keys: list[str], stretch: Column, order: list[str], *columns: str) -> DataFrame:
    """Rows and a digest of 128 bits of each series that depends on the order of its rows, not on how they are dealt out.

    Each row is digested with its place in the series (windows.numbered), and the digests are added word by word, so two rows that change
    places change the sum. Fields are written with their lengths, so that no two rows read alike; null differs from an empty text.
    """
    field = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    rows = numbered(df, keys, stretch, order, "_n")
    rows = rows.withColumn("_d", F.md5(F.concat_ws("|", F.col("_n").cast("string"), *map(field, columns)).cast("binary")))
    word = lambda k: F.sum(F.conv(F.substring("_d", 8 * k + 1, 8), 16, 10).cast("bigint")) % (1 << 32)
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.lower(F.concat(*(F.lpad(F.hex(word(k)), 8, "0") for k in range(4)))).alias("digest"))
