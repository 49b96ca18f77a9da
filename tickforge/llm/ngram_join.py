"""Self-join of documents on the Jaccard similarity of their word n-gram sets, by prefix trees.

Plan
1. Every set is an ordered array of 63-bit n-gram hashes; n-grams that very many documents have (a list of bounded
   length) carry the top bit and so come last. Two sets that link share an n-gram among the first
   n - ceil(0.8 n) + 1 of each (the prefix filter).
2. Equal sets become one representative. The holders of a prefix n-gram, in order of size, fall into runs whose
   neighbours differ by less than the threshold (the length filter); a holder alone in its run is dropped, the
   others go to the group of the run's least holder. A pair that links thus meets in some group, and copies that
   share a hundred n-grams meet about once. N-grams that very many documents have go by classes of size instead, of
   which each document joins two, and whose least holders are combined before they are shuffled.
3. Each set has a profile: how many of its n-grams fall to each of some n / 8 slots, a byte each. Two profiles bound the
   intersection from above, which splits groups that have just a passage in common before whole sets are shipped.
4. A task stores the whole sets of what may link in a trie and walks it with each set, sharing partial overlaps along
   common paths and pruning subtrees whose remaining lengths can't reach the threshold. Sets that are already
   connected aren't compared.
5. Groups over BLOCK sets or BLOCK_BYTES are dealt out in blocks, each with the group's least document; what is not
   connected then is compared block against block, save blocks that lie in one component.
6. The links span the components, which alternating star steps reduce to their least document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.llm.common import cut, partitions, prepare, texts_of, window_hashes, with_owner, word_hashes
from tickforge.llm.components import connected

NGRAM, PERCENT = 5, 80
#: Sets of a group that one task holds at once, and their bytes (save that a single set may have more).
BLOCK, BLOCK_BYTES = 400, 64 << 20
#: From so many holders on, an n-gram's holders aren't ordered in one task; at most so many n-grams are treated so.
HOT, HOT_GRAMS = 50_000, 4096
#: Up to so many documents a bitmap tells whose whole sets are wanted, at 16 bits each; beyond, a join does.
WANTED = 1 << 22
#: The most n-grams that are put last for being frequent, 8 bytes each; any number gives the same result.
FREQUENT = 1 << 19
_LAST, _LOW = np.uint64(1 << 63), np.uint64((1 << 63) - 1)


def gram_lists(texts: list[bytes], size: int = NGRAM) -> Iterator[np.ndarray]:
    """The n-gram hashes of each text; a shorter text is one n-gram, one without words none."""
    for ids in word_hashes(texts, fold=True):
        yield window_hashes(ids, min(size, len(ids))) & _LOW


def ordered(grams: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Sorted, with frequent n-grams marked and last."""
    if len(frequent) and len(grams):
        at = np.searchsorted(frequent, grams)
        at[at == len(frequent)] = 0
        marked = frequent[at] == grams
        if marked.any():
            return np.concatenate([grams[~marked], grams[marked] | _LAST])
    return grams


def least_overlap(n: int, m: int, percent: int = PERCENT) -> int:
    """The least intersection with which sets of n and m elements link."""
    return -(-percent * (n + m) // (100 + percent))


def frequent_grams(docs: DataFrame, size: int = NGRAM, most: int = FREQUENT, at_least: int = 8, hot: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that occur most, at most `most` of them, counted over all documents where they repeat within a run of texts; and those
    of them, at most HOT_GRAMS, that occur `hot` times or more.

    A text that a task has had before in the run doesn't count again: copies would fill the list with their own n-grams.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, set()

        def counted() -> pa.RecordBatch:
            grams, times = np.unique(np.concatenate(held), return_counts=True)
            many = times >= 3
            return pa.RecordBatch.from_arrays([pa.array(grams[many].view(np.int64)), pa.array(times[many])], names=["g", "n"])

        for batch in batches:
            own = {xxhash.xxh3_64_intdigest(x): x for x in texts_of(batch)}
            texts = [x for h, x in own.items() if h not in seen]
            seen |= own.keys()
            for grams in gram_lists(texts, size):
                held.append(grams)
                n += len(grams)
                if n > 4_000_000:
                    yield counted()
                    held, n, seen = [], 0, set()
        if held:
            yield counted()

    seen = docs.select("text").mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least)
    top = seen.orderBy(F.desc("n"), "g").limit(most).select("g", "n").toPandas()
    grams, times = top["g"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    return np.sort(grams), np.sort(grams[:HOT_GRAMS][times[:HOT_GRAMS] >= (HOT if hot is None else hot)])


def slots(n: int) -> int:
    """How many slots the profile of a set of size n has: a power of two with about 8 n-grams in each."""
    return min(1 << 16, max(32, 1 << ((n + 7) // 8 - 1).bit_length())) if n else 32


def profile(grams: np.ndarray) -> bytes:
    """The number of n-grams in each slot, which is their hash modulo slots(n); 255 stands for 255 or more."""
    n = slots(len(grams))
    return np.minimum(np.bincount((grams & np.uint64(n - 1)).astype(np.int64), minlength=n), 255).astype(np.uint8).tobytes()


def prefixes(docs: DataFrame, frequent, size: int, percent: int) -> DataFrame:
    """doc_id, n, digest of the set, its prefix n-grams and its profile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, digests, heads, profiles = [], [], [], []
            for grams in gram_lists(texts_of(batch), size):
                grams = ordered(np.unique(grams), frequent.value)
                ns.append(len(grams))
                digests.append(xxhash.xxh3_128_digest(grams.tobytes()))
                heads.append(grams[: len(grams) - (percent * len(grams) + 99) // 100 + 1].tobytes())
                profiles.append(profile(grams))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(heads, pa.binary()), pa.array(profiles, pa.binary())], names=["doc_id", "n", "digest", "grams", "profile"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, digest binary, grams binary, profile binary")


def exploded(heads: DataFrame, hot, only_hot: bool = False) -> DataFrame:
    """doc_id, n and g, a row for each n-gram of the packed arrays in heads (doc_id, n, grams): the hot ones or all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column("grams").to_pylist()
            times = [len(x) // 8 for x in raws]
            ids, ns = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), times) for c in ("doc_id", "n"))
            grams = np.frombuffer(b"".join(raws), np.int64)
            if len(hot.value):
                kept = np.isin(grams.view(np.uint64) & _LOW, hot.value) == only_hot
                ids, ns, grams = ids[kept], ns[kept], grams[kept]
            for i in range(0, len(ids), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 18)]) for x in (ids, ns, grams)], names=["doc_id", "n", "g"])

    return heads.select("doc_id", "n", "grams").mapInArrow(run, "doc_id long, n long, g long")


def led_by_runs(postings: DataFrame, percent: int) -> DataFrame:
    """leader, doc_id and n: the holders of an n-gram, in runs of sizes whose neighbours may link, with the run's least holder."""
    by_size = Window.partitionBy("g").orderBy("n", "doc_id")
    far = lambda a, b: ~F.coalesce(a * 100 >= b * percent, F.lit(False))
    near = postings.withColumns({"below": far(F.lag("n").over(by_size), F.col("n")), "above": far(F.col("n"), F.lead("n").over(by_size))}).where("not (below and above)")
    runs = near.withColumn("run", F.sum(F.col("below").cast("int")).over(by_size))
    led = runs.withColumn("leader", F.min("doc_id").over(Window.partitionBy("g", "run"))).where("doc_id <> leader")
    return led.select("leader", "doc_id", "n")


def led_by_classes(postings: DataFrame, percent: int) -> DataFrame:
    """The same for hot n-grams, by classes of size. Sizes that may link are at most a class apart, and each document joins its own and the next.

    The leaders, one for each n-gram and class (at most HOT_GRAMS times some 140), are broadcast.
    """
    of_size = F.floor(F.log("n") / F.lit(math.log(100 / percent * 1.01)))
    classes = postings.withColumn("class", F.explode(F.array(of_size, of_size + 1)))
    leaders = classes.groupBy("g", "class").agg(F.min("doc_id").alias("leader"))
    return classes.join(F.broadcast(leaders), ["g", "class"]).where("doc_id <> leader").select("leader", "doc_id", "n")


def bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """A filter over ids: bit pmod(id, bits) is set for each; what passes may still be absent."""
    bit = F.pmod("doc_id", F.lit(bits))
    words = ids.select(F.shiftright(bit, 5).alias("w"), F.expr("shiftleft(1L, cast(pmod(doc_id, 32) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(bits // 32, np.uint32)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).astype(np.uint32)
    return out


def sets_of(docs: DataFrame, ids: DataFrame, frequent, size: int) -> DataFrame:
    """doc_id and whole ordered set of the documents whose doc_id is in ids, and of some others.

    Few ids (up to WANTED) are known from a bitmap of 16 bits each, 8 MB at most, and the texts stay where they are; many are joined.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n, wanted = ids.count(), None
    if n <= WANTED:
        wanted = docs.sparkSession.sparkContext.broadcast(bitmap(ids, max(1 << 10, 1 << (16 * n).bit_length())))
    else:
        rows = rows.join(ids, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                bits = wanted.value
                slot = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64) % (32 * len(bits))
                batch = batch.filter(pa.array((bits[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1))
            grams = [ordered(np.unique(x), frequent.value) for x in gram_lists(texts_of(batch), size)]
            ns, raws = [len(x) for x in grams], [x.tobytes() for x in grams]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ns, pa.int64()), pa.array(raws, pa.binary())], names=["doc_id", "n", "grams"])

    return rows.mapInArrow(run, "doc_id long, n long, grams binary")


class _Node:
    """A compressed path of n-grams. lo and hi bound the sizes of the sets below; (id, size) of those that end here."""

    __slots__ = ("run", "children", "ends", "lo", "hi")

    def __init__(self, run: np.ndarray, lo: int, hi: int):
        self.run, self.children, self.ends, self.lo, self.hi = run, {}, [], lo, hi


class PrefixTree:
    """A trie of ordered n-gram sets, whole or just their first part, that finds those a set may link with.

    Of whole sets it finds exactly the links; of first parts all pairs that may link, from what they have in common
    up to the smaller of the two last n-grams and what is left of either set beyond it.
    """

    def __init__(self, percent: int = PERCENT):
        self.percent, self.root = percent, _Node(np.empty(0, np.uint64), 1 << 62, 0)

    def insert(self, id: int, grams: np.ndarray, n: int) -> None:
        at, node = 0, self.root
        while True:
            node.lo, node.hi = min(node.lo, n), max(node.hi, n)
            if at == len(grams):
                node.ends.append((id, n))
                return
            child = node.children.get(grams[at])
            if child is None:
                node.children[grams[at]] = child = _Node(grams[at:], n, n)
                child.ends.append((id, n))
                return
            run, rest = child.run, grams[at:]
            m = min(len(run), len(rest))
            differ = np.flatnonzero(run[:m] != rest[:m])
            same = int(differ[0]) if len(differ) else m
            if same < len(run):
                middle = _Node(run[:same], child.lo, child.hi)
                child.run = run[same:]
                middle.children[child.run[0]] = child
                node.children[run[0]] = child = middle
            node, at = child, at + same

    def partners(self, grams: np.ndarray, n: int, skip) -> Iterator[int]:
        """Ids of stored sets that (may) link with this one of size n; skip(id) says that it needn't be told."""
        last, shown = grams[-1], len(grams)
        least = -(-self.percent * n // 100)
        todo = [(self.root, 0, 0, 0)]  # node; on the path before it: n-grams in common, those up to last; place in grams reached
        while todo:
            node, common, below, reached = todo.pop()
            if node.lo * self.percent > 100 * n or node.hi < least:
                continue
            if common + min(n - reached, node.hi - below) < least_overlap(n, max(node.lo, least), self.percent):
                continue
            if not node.children and all(skip(x) for x, _ in node.ends):
                continue
            run = node.run
            if len(run):
                place = np.searchsorted(grams, run)
                inside = place < shown
                common += int(np.count_nonzero(grams[place[inside]] == run[inside]))
                reached = int(np.searchsorted(grams, run[-1], "right"))
                below += len(run) if run[-1] <= last else int(np.searchsorted(run, last, "right"))
            for x, m in node.ends:
                if common + min(n - reached, m - below) >= least_overlap(n, m, self.percent) and not skip(x):
                    yield x
            todo += [(x, common, below, reached) for x in node.children.values()]


class _Union:
    """Which ids are connected; known: components found before."""

    def __init__(self, known: dict[int, int]):
        self.known, self.up = known, {}

    def top(self, x: int) -> int:
        x, up = self.known.get(x, x), self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.top(x), self.top(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def links(self, ids) -> list[tuple[int, int]]:
        """(document or component, the least of what is connected)."""
        return [(x, self.top(x)) for x in {self.known.get(x, x) for x in ids} if self.top(x) != x]


def _linked(sets: list[tuple[int, np.ndarray, int]], known: dict[int, int], percent: int) -> list[tuple[int, int]]:
    """(document, least document) for what the sets' links connect."""
    union, tree = _Union(known), PrefixTree(percent)
    for id, grams, n in sorted(sets, key=lambda x: (x[2], x[0])):
        for other in tree.partners(grams, n, lambda x: union.top(x) == union.top(id)):
            union.join(other, id)
        tree.insert(id, grams, n)
    return union.links(id for id, _, _ in sets)


def _alike(sets: list[tuple[int, bytes, int]], known: dict[int, int], percent: int) -> list[tuple[int, int]]:
    """(document, least document) for what may link by sizes and profiles: an intersection has at most the sum of the slots' lesser counts.

    Sizes that may link have as many slots or half as many, so each level of slots has a table of its own profiles and of those twice as long, folded.
    """
    sets = sorted(sets, key=lambda x: (x[2], x[0]))
    union, ns = _Union(known), np.array([n for _, _, n in sets])
    counts = [np.frombuffer(raw, np.uint8) for _, raw, _ in sets]
    full = np.array([c.max() == 255 for c in counts])
    wide = np.array([len(c) for c in counts])
    tables = {}
    for w in np.unique(wide):
        first, last = int(np.searchsorted(wide, w)), int(np.searchsorted(wide, 2 * w, "right"))
        tables[w] = first, np.stack([c if len(c) == w else c[:w].astype(np.uint16) + c[w:] for c in counts[first:last]]).astype(np.uint16)
    for k in range(1, len(sets)):
        n, w = ns[k], wide[k]
        for level, end in ((w, k), (w // 2, int(np.searchsorted(wide, w)))):
            begin = int(np.searchsorted(ns[:k], -(-percent * n // 100)))
            if level not in tables:
                continue
            first, table = tables[level]
            begin = max(begin, first)
            if begin >= end:
                continue
            most = np.minimum(table[begin - first : end - first], table[k - first]).sum(axis=1, dtype=np.int64)
            others = ns[begin:end]
            may = (most * 100 >= percent * (n + others - most)) | full[begin:end] | full[k]
            for j in np.flatnonzero(may):
                union.join(sets[begin + j][0], sets[k][0])
    return union.links(id for id, _, _ in sets)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows with equal first columns, of sorted batches."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _within_groups(members: DataFrame, sets: DataFrame, keys: list[str], column: str, find) -> DataFrame:
    """Links (a, b), b the least of what is connected, that `find` sees within each group (keys) of members (keys, doc_id, comp); sets: doc_id, n and the column it looks at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a.clear(), b.clear()
            return out

        for rows in _groups(batches, len(keys)):
            rows = {(x[-4], x[-1]): x[-4:] for x in rows}.values()
            known = {id: comp for id, comp, _, _ in rows}
            for x, y in find([(id, raw, n) for id, _, n, raw in rows], known):
                a.append(x), b.append(y)
            if len(a) > 10_000:
                yield batch_of()
        yield batch_of()

    rows = members.join(sets, "doc_id").select(*keys, "doc_id", "comp", "n", column)
    return rows.repartition(partitions(members), *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _profiles(members: DataFrame, every: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """What may link by profiles."""
    return _within_groups(members, every.select("doc_id", "n", "profile"), keys, "profile", lambda rows, known: _alike(rows, known, percent))


def _tries(members: DataFrame, sets: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """The links of whole sets."""
    return _within_groups(members, sets, keys, "grams", lambda rows, known: _linked([(id, np.frombuffer(raw, np.uint64), n) for id, raw, n in rows], known, percent))


def _with_components(every: DataFrame, reps: DataFrame, links: DataFrame) -> DataFrame:
    """every with the column `least`, the least document that its set links with, by the representatives of equal sets (digest, rep, times)."""
    comps = connected(links)
    of_set = cut(reps.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "times", F.coalesce("component", "rep").alias("least")))
    return with_owner(every, of_set, "digest", "times", unmatched=F.col("n") == 0)


def similar(docs: DataFrame, size: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every row of docs.

    Null or empty text, or one without words: n_shingles 0 and a component of its own. A null doc_id takes no part:
    its component is null. Rows that repeat a doc_id count as one document with several sets. Columns but doc_id and
    text are not looked at. An empty table gives none. percent is 50 to 100.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100: profiles of sizes that may link have as many slots or half as many")
    prepare(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    listed, hottest = frequent_grams(docs, size)
    frequent, hot = context.broadcast(listed), context.broadcast(hottest)
    every = cut(prefixes(docs, frequent, size, percent))
    real = every.where("n > 0 and doc_id is not null")
    reps = real.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("times"))
    kept = real.join(reps.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"])
    led = led_by_runs(exploded(kept, hot), percent)
    if len(hottest):
        led = led.unionByName(led_by_classes(exploded(kept, hot, only_hot=True), percent))
    pairs = cut(led.distinct())
    blocks_of = F.ceil(F.greatest((F.count("*") + 1) / F.lit(BLOCK), F.sum("n") * 8 / F.lit(BLOCK_BYTES)))
    sizes = cut(pairs.groupBy("leader").agg(blocks_of.alias("blocks"), F.count("*").alias("members")))
    dealt = with_owner(pairs.drop("n"), sizes, "leader", "members").drop("members").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    led = sizes.select("leader", F.col("leader").alias("doc_id"), "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    blocks = cut(dealt.unionByName(led))
    own = F.col("doc_id").alias("comp")
    likely = cut(_profiles(blocks.where("blocks = 1").select("leader", "doc_id", own), every, ["leader"], percent).distinct())
    # what profiles connect is regrouped by its least document; such a group may be large too, as it comes from many n-grams, so it is dealt out alike
    regrouped = likely.select(F.col("b").alias("leader"), F.col("a").alias("doc_id")).where("leader <> doc_id").distinct()
    counted = cut(regrouped.join(real.groupBy("doc_id").agg(F.sum("n").alias("n")), "doc_id"))
    again = counted.groupBy("leader").agg(blocks_of.alias("blocks"), F.count("*").alias("members"))
    again = cut(with_owner(counted.drop("n"), cut(again), "leader", "members").drop("members").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))))
    led = again.groupBy("leader").agg(F.max("blocks").alias("blocks")).select("leader", F.col("leader").alias("doc_id"), "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    kind = lambda k: F.lit(k).alias("kind")
    regrouped = again.unionByName(led).select(kind(1), "leader", "block", "blocks", "doc_id")
    large = blocks.where("blocks > 1").select(kind(0), "leader", "block", "blocks", "doc_id").unionByName(regrouped.where("blocks > 1"))
    each = ["kind", "leader", "block"]
    refined = regrouped.where("blocks = 1").unionByName(large).select(*each, "doc_id").distinct()
    sets = sets_of(docs, refined.select("doc_id").distinct(), frequent, size)
    links = cut(_tries(refined.select(*each, "doc_id", own), sets, each, percent).distinct())
    if not large.isEmpty():
        comps = connected(links)
        seen = large.where("doc_id <> leader").join(comps.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")
        pairwise = seen.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("other <> block")
        both = ["kind", "leader", "i", "j"]
        pairwise = pairwise.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        mixed = pairwise.groupBy(*both).agg(F.min("comp").alias("c"), F.max("comp").alias("d")).where("c < d").select(*both)
        rest = cut(pairwise.join(mixed, both).select(*both, "doc_id", "comp"))
        # whole sets go only where the profiles of two components that aren't connected yet say that they may link
        near = cut(_profiles(rest, every, both, percent).distinct())
        near = near.select(F.col("a").alias("comp")).unionByName(near.select(F.col("b").alias("comp"))).distinct()
        links = links.unionByName(_tries(rest.join(near, "comp", "left_semi").select(*both, "doc_id", "comp"), sets, both, percent))
    found = _with_components(every.select("doc_id", "n", "digest"), reps, links)
    least = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.least("doc_id", "least"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), least.alias("component_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the least of its component, and those without a doc_id; all columns."""
    found = similar(docs)
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
