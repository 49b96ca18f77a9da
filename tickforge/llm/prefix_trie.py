"""Trie of conversation prefixes: padded matrices of turn ids, sorted; a node starts where a column or one before it changes.

Conversations are cut into bands of DEPTH turns, so a matrix has few columns however long a conversation is, and a band's row begins with
a hash of the turns before it. Rows are dealt out by range, so a node's rows are neighbours, and only the nodes of a shard's first and last
row may go on in another shard. Those are recombined: at most two for each column of each shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.llm.common import cut, partitions, prepare

#: Turns in a band, rows in a shard (on average), and bands that one window sums.
DEPTH, SHARD, BLOCK = 32, 20_000, 4096
#: Bytes of conversation ids in one row of a node that goes on in other shards.
IDS = 1 << 20
_PAD = np.iinfo(np.int64).min
_EMPTY = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"


def head_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its twenty: the checksum of its decimal id modulo 4."""
    return F.crc32(conv.cast("string").cast("binary")) % 4


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv, place, x, y, words of every turn of the rebuilt conversations, and conv, size of every conversation.

    Turns are numbered by range partitions (a number within the partition, and those before), so a conversation may have any share of all rows.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.xxhash64(F.lit(1), role, text).alias("x"), F.xxhash64(F.lit(2), text, role).alias("y"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = [F.col("turn").asc_nulls_first(), F.col("x"), F.col("y")]
    dealt = cut(slim.repartitionByRange(partitions(turns), "conv", *order).withColumn("part", F.spark_partition_id()))
    parts = cut(dealt.groupBy("conv", "part").agg(F.count("*").alias("n")))
    sizes = parts.groupBy("conv").agg(F.sum("n").alias("n"))
    first = F.col("conv") - F.col("conv") % 20
    convs = sizes.select("conv", "n", first.alias("first"), head_turns(F.col("conv")).alias("taken")).join(sizes.select(F.col("conv").alias("first"), F.col("n").alias("there")), "first", "left")
    convs = convs.withColumn("got", F.least("taken", F.coalesce("there", F.lit(0))))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("conv", "part", before.alias("before")).join(convs.select("conv", "taken", "got"), "conv")
    within = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)) - 1
    numbered = dealt.select("conv", "part", within.alias("nth"), "x", "y", "words").join(offsets, ["conv", "part"]).withColumn("place", F.col("nth") + F.col("before"))
    numbered = cut(numbered.select("conv", "place", "x", "y", "words", "taken", "got"))
    own = numbered.where("place >= taken").select("conv", (F.col("place") - F.col("taken") + F.col("got")).alias("place"), "x", "y", "words")
    heads = numbered.where("place < 3").select(F.col("conv").alias("first"), "place", "x", "y", "words")
    given = convs.where("got > 0").select("conv", "first", "got").join(heads, "first").where("place < got").select("conv", "place", "x", "y", "words")
    return own.unionByName(given), convs.select("conv", (F.col("got") + F.greatest(F.col("n") - F.col("taken"), F.lit(0))).alias("size"))


def _running(rows: DataFrame, values: dict[str, tuple], ahead: bool, block: int) -> DataFrame:
    """conv, band and, for each name: (aggregate, column), its sum over the bands before (or ahead of) each; in blocks of bands, then over blocks."""
    rows = rows.withColumn("block", F.floor(F.col("band") / block))
    side = (lambda c: F.col(c).desc()) if ahead else F.col
    earlier = lambda *by, at: Window.partitionBy(*by).orderBy(side(at)).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "block").agg(*(f(c).alias(name) for name, (f, c) in values.items()))
    blocks = blocks.select("conv", "block", *(F.coalesce(f(name).over(earlier("conv", at="block")), F.lit(0)).alias(f"{name}_far") for name, (f, _) in values.items()))
    near = rows.select("conv", "band", "block", *(F.coalesce(f(c).over(earlier("conv", "block", at="band")), F.lit(0)).alias(name) for name, (f, c) in values.items()))
    add = {F.bit_xor: lambda a, b: a.bitwiseXOR(b), F.sum: lambda a, b: a + b}
    return near.join(blocks, ["conv", "block"]).select("conv", "band", *(add[f](F.col(name), F.col(f"{name}_far")).alias(name) for name, (f, _) in values.items()))


def banded(turns: DataFrame, deep: int, most: int, block: int) -> DataFrame:
    """shard, band, before_x, before_y, ids (two a turn), conv, words, ends: rows in order of range, numbered by shard; ends: the conversation ends here."""
    all_turns, convs = rebuilt(turns)
    band = F.floor(F.col("place") / deep)
    at = (F.col("place") % deep).alias("at")
    rows = all_turns.select("conv", band.alias("band"), at, "x", "y", "words", F.xxhash64("x", "y", "place").alias("hx"), F.xxhash64("y", "place", "x").alias("hy"))
    rows = rows.groupBy("conv", "band").agg(F.sort_array(F.collect_list(F.struct("at", "x", "y", "words"))).alias("list"), F.bit_xor("hx").alias("hx"), F.bit_xor("hy").alias("hy"))
    rows = rows.select("conv", "band", F.flatten(F.transform("list", lambda t: F.array(t.x, t.y))).alias("ids"), F.col("list.words").alias("words"), "hx", "hy")
    none = F.array().cast("array<bigint>")
    zero = F.lit(0).cast("long")
    rows = rows.unionByName(convs.where("size = 0").select("conv", zero.alias("band"), none.alias("ids"), none.alias("words"), zero.alias("hx"), zero.alias("hy")))
    last = convs.select("conv", F.greatest(F.floor((F.col("size") - 1) / deep), zero).alias("band"), F.lit(True).alias("ends"))
    rows = cut(rows.join(last, ["conv", "band"], "left").withColumn("ends", F.coalesce("ends", F.lit(False))))
    prefix = _running(rows.where("band > 0 or not ends").select("conv", "band", "hx", "hy"), {"before_x": (F.bit_xor, "hx"), "before_y": (F.bit_xor, "hy")}, False, block)
    rows = rows.drop("hx", "hy").join(prefix, ["conv", "band"], "left").withColumns({c: F.coalesce(c, zero) for c in ("before_x", "before_y")})
    key = ["band", "before_x", "before_y", "ids", "conv"]
    shards = max(1, -(-rows.count() // most))
    return cut(rows.repartitionByRange(shards, *key).select(F.spark_partition_id().alias("shard"), *key, "words", "ends"))


class Matrix:
    """A shard's rows in order, and the nodes of each depth as stretches of rows."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        n = rows.num_rows
        column = lambda c: rows.column(c).to_numpy()
        conv, band, x, y, ends = column("conv"), column("band"), column("before_x"), column("before_y"), column("ends").astype(bool)
        lengths, values = self._lists(rows, "words")
        ids = self._lists(rows, "ids")[1]
        m = int(lengths.max(initial=0))
        row = np.repeat(np.arange(n), lengths)
        at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        words, cells = np.zeros((n, m), np.int64), np.full((n, 2 * m), _PAD)
        words[row, at] = values
        cells[row, 2 * at], cells[row, 2 * at + 1] = ids[0::2], ids[1::2]
        order = np.lexsort([conv, lengths, *cells.T[::-1], y, x, band])
        self.order, self.n, self.m = order, n, m
        self.conv, self.band, self.x, self.y, self.ends = conv[order], band[order], x[order], y[order], ends[order]
        self.lengths, self.words, self.cells = lengths[order], words[order], cells[order]
        change = np.ones((n, m + 1), bool)
        if n > 1:
            change[1:, 0] = (np.diff(self.band) != 0) | (self.x[1:] != self.x[:-1]) | (self.y[1:] != self.y[:-1])
            new = self.cells[1:] != self.cells[:-1]
            change[1:, 1:] = new[:, 0::2] | new[:, 1::2]
        self.starts_at = np.logical_or.accumulate(change, axis=1)

    @staticmethod
    def _lists(rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        parts = rows.column(name).chunks
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([p.value_lengths().to_numpy(zero_copy_only=False) for p in parts]).astype(np.int64), np.concatenate([p.flatten().to_numpy(zero_copy_only=False) for p in parts]).astype(np.int64)

    def key(self, row: int, depth: int) -> bytes:
        """What tells the node of this row and depth from all others."""
        return hashlib.md5(np.array([self.band[row], self.x[row], self.y[row], depth]).tobytes() + self.cells[row, : 2 * depth].tobytes()).digest()

    def groups(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and stops of stretches that agree down to this depth, and which of them are nodes."""
        starts = np.flatnonzero(self.starts_at[:, depth])
        node = self.lengths[starts] >= depth
        return starts, np.append(starts[1:], self.n), node & (self.band[starts] == 0) if depth == 0 else node

    def ending(self, depth: int) -> np.ndarray:
        return (self.lengths == depth) & self.ends

    def counted(self, info: dict[bytes, tuple[int, int, int]] | None) -> Iterator[tuple]:
        """For each depth: starts, stops, node, members, smallest member, members that end there, border; those of border nodes from info, if given."""
        for depth in range(self.m + 1):
            starts, stops, node = self.groups(depth)
            size, least = stops - starts, np.minimum.reduceat(self.conv, starts)
            over = np.add.reduceat(self.ending(depth).astype(np.int64), starts)
            border = node & ((starts == 0) | (stops == self.n))
            for k in np.flatnonzero(border) if info is not None else ():
                size[k], least[k], over[k] = info[self.key(starts[k], depth)]
            yield starts, stops, node, size, least, over, border

    def values(self, info: dict[bytes, tuple[int, int, int]]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """The counts of each depth; then for each row: smallest member by depth, tokens saved by depth that the row stands for, whether it stands for a leaf."""
        counts = list(self.counted(info))
        stands, saved = np.zeros((self.n, self.m + 1), np.int64), np.zeros((self.n, self.m + 1), np.int64)
        leaf = np.zeros(self.n, np.int64)
        for depth, (starts, stops, node, size, least, over, _) in enumerate(counts):
            each = lambda v: np.repeat(v, stops - starts)  # noqa: E731, B023
            stands[:, depth] = each(least)
            first = each(node) & (self.conv == stands[:, depth])
            if depth:
                saved[:, depth] = np.where(first, (each(size) - 1) * self.words[:, depth - 1], 0)
            leaf += first & self.ending(depth) & (each(over) == each(size))
        return counts, stands, saved, leaf


def _table(columns: dict[str, tuple]) -> pa.Table:
    return pa.table([pa.array(v, t) for v, t in columns.values()], names=list(columns))


_LONG = pa.int64()
_BORDER = "shard int, key binary, n long, least long, over long"
_BANDS = "conv long, band long, saved long, leaf long, first long, last long"
_NODES = "shard int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, border boolean, part int, ids binary"


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts within a shard of the nodes of its first and last row."""
    held = list(batches)
    rows = pa.Table.from_batches(held) if held else None
    if rows is None or not rows.num_rows:
        return
    m, out = Matrix(rows), []
    for depth, (starts, _, _, size, least, over, border) in enumerate(m.counted(None)):
        out += [(m.key(starts[k], depth), size[k], least[k], over[k]) for k in np.flatnonzero(border)]
    shard = rows.column("shard")[0].as_py()
    cols = list(zip(*out)) or [()] * 4
    yield from _table({"shard": ([shard] * len(out), pa.int32()), "key": (cols[0], pa.binary()), "n": (cols[1], _LONG), "least": (cols[2], _LONG), "over": (cols[3], _LONG)}).to_batches()


def _info(info: pa.Table) -> dict[bytes, tuple[int, int, int]]:
    return {k: v for k, *v in zip(*(info.column(c).to_pylist() for c in ("key", "n", "least", "over")))}


def _of_bands(rows: pa.Table, info: pa.Table) -> pa.Table:
    """What other bands of the same conversation need: sums of saved tokens, whether it stands for a leaf, the smallest members at either end."""
    m = Matrix(rows)
    _, stands, saved, leaf = m.values(_info(info))
    some = np.flatnonzero((m.band > 0) | ~m.ends)
    first = stands[some, 1] if m.m else np.zeros(len(some), np.int64)
    return _table({"conv": (m.conv[some], _LONG), "band": (m.band[some], _LONG), "saved": (saved[some].sum(1), _LONG), "leaf": (leaf[some], _LONG), "first": (first, _LONG), "last": (stands[some, m.lengths[some]], _LONG)})


def _nodes(rows: pa.Table, info: pa.Table, deep: int, most: int) -> pa.Table:
    """The nodes of a shard; of border nodes the sums within it, and the ids that end there."""
    m = Matrix(rows)
    counts, stands, saved, leaf = m.values(_info(info))
    column = lambda c: rows.column(c).to_numpy()[m.order]
    after, leaf_after, child, parent = column("after"), column("leaf_after"), column("child"), column("parent")
    below = np.cumsum(saved[:, ::-1], axis=1)[:, ::-1] + after[:, None]
    leaf = np.where(m.ends, leaf, leaf_after)
    out: list[tuple] = []
    for depth, (starts, stops, node, size, least, over, border) in enumerate(counts):
        if depth < m.m:
            child_here = (m.lengths > depth) & (stands[:, depth + 1] == m.conv)
        else:
            child_here = np.zeros(m.n, bool)
        children = child_here + np.where((m.lengths == depth) & ~m.ends, child == m.conv, False)
        sums = [np.add.reduceat(v.astype(np.int64), starts) for v in (children, leaf, below[:, depth])]
        if depth == 0:
            above = [None] * len(starts)
        elif depth == 1:
            above = np.where(m.band[starts] == 0, stands[starts, 0], parent[starts]).tolist()
        else:
            above = stands[starts, depth - 1].tolist()
        over_at = np.flatnonzero(m.ending(depth))
        edges = np.searchsorted(over_at, np.append(starts, m.n))
        names = m.conv[over_at].tolist()
        for k in np.flatnonzero(node).tolist():
            ids = ",".join(map(str, names[edges[k] : edges[k + 1]])).encode()
            row = (int(least[k]), int(m.band[starts[k]]) * deep + depth, above[k], int(size[k]), *(int(v[k]) for v in sums))
            if not border[k]:
                out.append((*row, hashlib.sha256(ids).hexdigest(), False, 0, None))
                continue
            out.append((*row, None, True, 0, ids[:most] or None))
            out += [(*row[:4], 0, 0, 0, None, True, 1 + p, ids[b : b + most]) for p, b in enumerate(range(most, len(ids), most))]
    cols = list(zip(*out)) or [()] * 11
    types = (_LONG,) * 7 + (pa.string(), pa.bool_(), pa.int32(), pa.binary())
    names_ = [f.split()[0] for f in _NODES.split(", ")]
    return _table({"shard": ([rows.column("shard")[0].as_py()] * len(out), pa.int32())} | {c: (v, t) for c, v, t in zip(names_[1:], cols, types)})


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's ids, which come in order, in parts."""
    schema = pa.schema([("conv_id", _LONG), ("depth", _LONG), ("ends_sha256", pa.string())])
    at, said = None, hashlib.sha256()
    for batch in batches:
        done = []
        for *key, ids, part in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids", "part"))):
            if key != at:
                if at is not None:
                    done.append((*at, said.hexdigest()))
                at, said = key, hashlib.sha256()
            elif not part:  # the next shard's first
                said.update(b",")
            said.update(ids)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*at, said.hexdigest()), schema)], schema=schema)


def prefix_trie(turns: DataFrame, deep: int = DEPTH, shard: int = SHARD, block: int = BLOCK, ids: int = IDS) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, all of rebuilt conversations.

    Turns go by turn, null first; of equal turns the order is by a hash of role and text. Repeated turns count each. Null role or text is
    empty. Rows without a conv_id belong to no conversation. Without conversations there is no node, not even a root. A negative id's first
    of twenty is the one nearer to 0. Other columns aren't read. Turns are compared, and prefixes of whole bands told apart, by 128-bit hashes.

    deep, shard, block and ids set how the work is cut up (DEPTH, SHARD, BLOCK, IDS), not what comes out. A task holds one shard. The ids that end in one node go through one digest, in order and in parts; nothing else gathers a node's members.
    """
    prepare(turns.sparkSession)
    rows = banded(turns, deep, shard, block)
    borders = cut(rows.mapInArrow(_borders, _BORDER))
    whole = borders.groupBy("key").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("over").alias("over"))
    info = cut(borders.select("shard", "key").join(whole, "key"))
    bands = cut(rows.groupBy("shard").cogroup(info.groupBy("shard")).applyInArrow(_of_bands, _BANDS))
    later = _running(bands, {"after": (F.sum, "saved"), "leaf_after": (F.sum, "leaf")}, True, block)
    next_first = bands.select("conv", (F.col("band") - 1).alias("band"), F.col("first").alias("child"))
    last_before = bands.select("conv", (F.col("band") + 1).alias("band"), F.col("last").alias("parent"))
    full = rows
    for more in (later, next_first, last_before):
        full = full.join(more, ["conv", "band"], "left")
    zero = F.lit(0).cast("long")
    # where no next band is, any other id than the conversation's own
    full = full.withColumns({"after": F.coalesce("after", zero), "leaf_after": F.coalesce("leaf_after", zero), "child": F.coalesce("child", F.col("conv").bitwiseXOR(F.lit(1))), "parent": F.coalesce("parent", zero)})
    found = cut(full.groupBy("shard").cogroup(info.groupBy("shard")).applyInArrow(lambda left, right: _nodes(left, right, deep, ids), _NODES))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    border = found.where("border")
    sums = border.groupBy("conv_id", "depth").agg(F.first("parent_conv_id", True).alias("parent_conv_id"), F.first("n_convs").alias("n_convs"), *(F.sum(c).alias(c) for c in names[4:7]))
    parts = border.where("ids is not null").select("conv_id", "depth", "shard", "part", "ids").repartition(partitions(turns), "conv_id", "depth").sortWithinPartitions("conv_id", "depth", "shard", "part")
    digests = parts.select("conv_id", "depth", "ids", "part").mapInArrow(_joined_ids, "conv_id long, depth long, ends_sha256 string")
    sums = sums.join(digests, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    return found.where("not border").select(*names).unionByName(sums.select(*names))
