"""Exact duplicates by compressed radix tries over whole texts, dealt out by length and content hash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.llm.common import cut, partitions, prepare, sha256, texts_of, with_owner

#: Bytes of edges that a trie holds before it spills subtrees.
TRIE_BYTES = 32 << 20


class Owner:
    """What a terminal node keeps: the identifier that stays, the number of rows, and how many of them have that identifier."""

    __slots__ = ("id", "rows", "same")

    def __init__(self, id: int | None, rows: int, same: int):
        self.id, self.rows, self.same = id, rows, same


class PatriciaTrie:
    """A radix trie over byte strings: a node is [edge bytes, children by first byte, Owner or None]."""

    def __init__(self, largest: bool):
        self.largest, self.root, self.bytes = largest, [b"", {}, None], 0

    def _merge(self, node: list, id: int | None, rows: int, same: int) -> None:
        own = node[2]
        if own is None:
            node[2] = Owner(id, rows, same)
            return
        own.rows += rows
        if id == own.id:
            own.same += same
        elif id is not None and (own.id is None or (id > own.id if self.largest else id < own.id)):
            own.id, own.same = id, same

    def insert(self, key: bytes, id: int | None, rows: int = 1, same: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, Owner(id, rows, same)]
                self.bytes += len(key) - at
                return
            edge = child[0]
            if key.startswith(edge, at):
                node, at = child, at + len(edge)
                continue
            lo, hi = 1, min(len(edge), len(key) - at)  # the first lo bytes agree
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if key.startswith(edge[:mid], at) else (lo, mid - 1)
            node[1][key[at]] = middle = [edge[:lo], {edge[lo]: child}, None]
            child[0] = edge[lo:]
            node, at = middle, at + lo
        self._merge(node, id, rows, same)

    def terminals(self, node: list | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, Owner]]:
        todo = [(node or self.root, prefix)]
        while todo:
            (edge, children, own), before = todo.pop()
            key = before + edge
            if own is not None:
                yield key, own
            todo += [(x, key) for x in children.values()]

    def spill(self) -> Iterator[tuple[bytes, Owner]]:
        """Give up the root's subtrees one by one until half the bytes are left."""
        goal = self.bytes // 2
        for first in list(self.root[1]):
            if self.bytes <= goal:
                return
            gone = self.root[1].pop(first)
            todo = [gone]
            while todo:
                x = todo.pop()
                self.bytes -= len(x[0])
                todo += x[1].values()
            yield from self.terminals(gone)


_PARTIAL = pa.schema([("len", pa.int64()), ("hash", pa.int64()), ("text", pa.large_binary()), ("id", pa.int64()), ("rows", pa.int64()), ("same", pa.int64())])
_OWNERS = "text_sha256 string, keep_id long, group_size long, keepers long"


def _partial(found: list[tuple[bytes, Owner]]) -> pa.RecordBatch:
    hashes = [xxhash.xxh64_intdigest(k) - (1 << 63) for k, _ in found]
    return pa.RecordBatch.from_arrays(
        [pa.array([len(k) for k, _ in found], pa.int64()), pa.array(hashes, pa.int64()), pa.array([k for k, _ in found], pa.large_binary()), pa.array([o.id for _, o in found], pa.int64()), pa.array([o.rows for _, o in found], pa.int64()), pa.array([o.same for _, o in found], pa.int64())],
        schema=_PARTIAL,
    )


def _in_parts(found: Iterator[tuple[bytes, Owner]], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    part, size = [], 0
    for k, o in found:
        part.append((k, o))
        size += len(k)
        if size > most:
            yield _partial(part)
            part, size = [], 0
    if part:
        yield _partial(part)


def exact_owners(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """One row for each distinct text: text_sha256, keep_id (largest or smallest id of its rows), group_size, keepers (rows that have keep_id).

    Each input partition folds its rows into a trie first (spilling subtrees past TRIE_BYTES), so that a text
    reaches the shuffle about once a partition however often it occurs. Length and content hash then deal the
    strings out to partitions, each of which has one trie again. Its strings come in order of length and hash, so that what is
    in the trie when a new pair begins is complete, and subtrees may be spilled there.
    Null text counts as empty. A null id never stays while another of its text has one; if none has, keep_id is null.
    """
    prepare(docs.sparkSession)
    largest = keep == "largest"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(largest)
        for batch in batches:
            for key, i in zip(texts_of(batch), batch.column("id").to_pylist()):
                trie.insert(key, i)
                if trie.bytes > TRIE_BYTES:
                    yield from _in_parts(trie.spill())
        yield from _in_parts(trie.terminals())

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, at = PatriciaTrie(largest), None

        def owners(found: Iterator[tuple[bytes, Owner]]) -> pa.RecordBatch:
            cols = list(zip(*((hashlib.sha256(k).hexdigest(), o.id, o.rows, o.same) for k, o in found))) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["text_sha256", "keep_id", "group_size", "keepers"])

        for batch in batches:
            n, h, i, r, m = (batch.column(c).to_pylist() for c in ("len", "hash", "id", "rows", "same"))
            for k, key in enumerate(texts_of(batch)):
                if (n[k], h[k]) != at:
                    at = (n[k], h[k])
                    if trie.bytes > TRIE_BYTES:
                        yield owners(trie.spill())
                trie.insert(key, i[k], r[k], m[k])
        yield owners(trie.terminals())

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    sent = rows.mapInArrow(local, "len long, hash long, text binary, id long, rows long, same long")
    dealt = sent.repartition(partitions(docs), "len", "hash").sortWithinPartitions("len", "hash")
    return dealt.mapInArrow(final, _OWNERS)


def _first_of_repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with `__tickforge_first`: true for one of the rows with equal keys. First within each partition, then among partitions, so that no task holds all."""
    rows = rows.withColumn("__tickforge_part", F.spark_partition_id())
    within = F.row_number().over(Window.partitionBy(*keys, "__tickforge_part").orderBy(F.lit(0)))
    among = F.row_number().over(Window.partitionBy(*keys, "__tickforge_nth").orderBy("__tickforge_part"))
    first = (among == 1) & (F.col("__tickforge_nth") == 1)
    return rows.withColumn("__tickforge_nth", within).withColumn("__tickforge_first", first).drop("__tickforge_part", "__tickforge_nth")


def mark_duplicates(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256. Of wholly repeated rows (same doc_id and text) one is kept.

    Copies of a text with very many meet their owner by broadcast, the others by shuffle.
    """
    own = cut(exact_owners(docs, keep=keep))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sha256(F.col("text")).alias("text_sha256"))
    rows = with_owner(rows, own, "text_sha256", "group_size")
    keeper = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    single = rows.where((F.col("keepers") == 1) | ~keeper).withColumn("__tickforge_first", keeper)
    several = _first_of_repeated(rows.where((F.col("keepers") > 1) & keeper), ["text_sha256"])
    return single.unionByName(several).select("doc_id", "keep_id", "group_size", F.col("__tickforge_first").alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows that stay, with all their columns; one of wholly repeated rows. Columns whose names begin with __tickforge_ are this function's own: docs with one are an error."""
    if taken := [c for c in docs.columns if c.lower().startswith("__tickforge_")]:
        raise ValueError(f"columns with reserved names: {taken}")
    own = exact_owners(docs, keep=keep).select(F.col("text_sha256").alias("__tickforge_sha"), F.col("keep_id").alias("__tickforge_keep"), F.col("keepers").alias("__tickforge_keepers"))
    rows = docs.withColumn("__tickforge_sha", sha256(F.col("text")))
    joined = rows.join(own, (rows["__tickforge_sha"] == own["__tickforge_sha"]) & rows["doc_id"].eqNullSafe(own["__tickforge_keep"])).drop(own["__tickforge_sha"])
    single = joined.where("__tickforge_keepers = 1").select(*docs.columns)
    several = _first_of_repeated(joined.where("__tickforge_keepers > 1"), ["__tickforge_sha"]).where("__tickforge_first")
    return single.unionByName(several.select(*docs.columns))
