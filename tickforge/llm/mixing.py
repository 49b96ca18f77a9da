"""Mixing sources to target weights, in DataFrame operations only.

Weights are token shares to the power alpha, normalised. Alpha is bisected in [0, 1], several values at a time, to the largest whose
entropy reaches the target, and then raised, where that repeats some source more than the limit, to the least value that doesn't.
The mixture takes each source in permuted blocks, epoch after epoch, until its budget of tokens is met.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.llm.common import cut, prepare, with_owner

#: Share of the greatest entropy (that of equal weights) the mixture is to have.
ENTROPY = 0.98
#: The most often that any source may be seen, when the source least repeated is seen once.
REPEATS = 2.0
#: Tokens of a permuted block, about.
BLOCK_TOKENS = 1 << 20
#: Exponents tried in one pass over the sources, and passes: 17 ** 6 steps, some 4e-8 wide.
_TRIES, _ROUNDS = 16, 6
#: Stretches of a source's permuted blocks, as a power of two: running sums go over stretches, then within one.
STRETCH_BITS = 12
#: Up to so many sources their plan, some 100 bytes each, is broadcast; beyond, that of the most frequent is, and the rest is joined by shuffle.
SMALL = 20_000


def n_tokens(text: Column) -> Column:
    """Runs of characters that aren't ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _narrowed(live: DataFrame, all_tokens: float, aim: float) -> float:
    """The largest exponent in [0, 1] at which the entropy of the weights still reaches aim.

    Entropy falls as the exponent grows, so each round tries _TRIES exponents between the ends, as many sums in one pass over the sources, and
    keeps the stretch where the aim is crossed. Only sums come to the driver, whatever the number of sources.
    """
    low, high = 0.0, 1.0
    p = F.col("tokens") / F.lit(all_tokens)
    for _ in range(_ROUNDS):
        tried = [low + (high - low) * k / (_TRIES + 1) for k in range(1, _TRIES + 2)]
        sums = [(F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p) * a)) for a in tried]
        found = live.agg(*(c.alias(f"c{i}") for i, c in enumerate(x for pair in sums for x in pair))).first()
        entropies = [math.log(found[2 * k]) - found[2 * k + 1] / found[2 * k] for k in range(len(tried))]
        good = [a for a, e in zip(tried, entropies) if e >= aim]
        low, high = max(good, default=low), min((a for a, e in zip(tried, entropies) if e < aim), default=high)
        if low >= high:
            break
    return low


def weights(totals: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> DataFrame:
    """source, tokens, alpha, weight and budget from source and tokens; sources without tokens get none.

    The exponent is the largest that reaches the entropy or, if greater, the least at which no source is seen more than `repeats` times for
    once of another: the ratio of uses is (greatest share / least share) ** (1 - alpha). The whole budget is the least at which no source
    falls short of one epoch.
    """
    live = cut(totals.where("tokens > 0"))
    n, every, least, most = live.agg(F.count("*"), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not n:
        none = F.lit(None).cast("double")
        return live.select("source", "tokens", none.alias("alpha"), none.alias("weight"), F.lit(None).cast("long").alias("budget"))
    by_entropy = _narrowed(live, float(every), math.log(n) * entropy)
    by_repeats = 1 - math.log(repeats) / math.log(most / least) if most > least * repeats else 0.0
    alpha = round(max(by_entropy, by_repeats), 6)
    share = F.col("tokens") / F.lit(float(every))
    power = F.pow(share, F.lit(alpha))
    norm, fullest = live.agg(F.sum(power), F.max(F.col("tokens") / power)).first()
    weight = power / F.lit(norm)
    return live.select("source", "tokens", F.lit(alpha).alias("alpha"), weight.alias("weight"), F.round(weight * F.lit(fullest * norm)).cast("long").alias("budget"))


def mix(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mixture: a row for each use of a document, with columns doc_id, source, epoch, tokens, start, weight, alpha.

    start is the token at which the use begins in its source's stream; uses go on while start is below the source's budget,
    so a source realises its budget to within a document. Blocks are permuted by hash in every epoch, and documents
    within them; running sums are taken over blocks first and then within a block, so no task holds a source.
    A null source is a source of its own; rows without tokens come once, at the place of the next one. Repeated
    rows count each. Rows of one doc_id are dealt into blocks by their texts, and rows without a doc_id by their place
    in the input too, so that they don't meet in one block. An empty table gives none.
    """
    prepare(docs.sparkSession)
    salt = F.xxhash64("text", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    rows = docs.select("doc_id", "source", n_tokens(F.col("text")).alias("tokens"), salt.alias("salt"))
    return mix_tokens(rows, entropy, repeats, block_tokens)


def mix_tokens(rows: DataFrame, entropy: float, repeats: float, block_tokens: int) -> DataFrame:
    """The mixture of rows with doc_id, source, tokens and salt, which tells rows of one doc_id apart."""
    rows = cut(rows.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))))
    totals = cut(rows.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("key_rows")))
    plan = weights(totals.select(F.col("key").alias("source"), "tokens"), entropy, repeats)
    plan = plan.select(F.col("source").alias("key"), F.col("tokens").alias("key_tokens"), "alpha", "weight", "budget")
    epochs = F.ceil(F.col("budget") / F.col("key_tokens")).cast("long")
    plan = plan.withColumn("blocks", F.ceil(F.col("key_tokens") / F.lit(block_tokens)).cast("long")).withColumn("epochs", epochs)
    plan = cut(plan.join(totals.select("key", "key_rows"), "key"))
    few = plan.count() <= SMALL
    uses = (rows.join(F.broadcast(plan), "key", "left") if few else with_owner(rows, plan, "key", "key_rows")).withColumn("block", F.pmod(F.xxhash64("doc_id", "salt"), F.coalesce("blocks", F.lit(1))))
    sums = uses.where("epochs is not null").groupBy("key", "block", "epochs").agg(F.sum("tokens").alias("in_block"))
    sums = sums.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    place = F.xxhash64("key", "epoch", "block")
    sums = sums.withColumns({"place": place, "stretch": F.shiftright(place, 64 - STRETCH_BITS)})
    outer = Window.partitionBy("key", "epoch").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = sums.groupBy("key", "epoch", "stretch").agg(F.sum("in_block").alias("in_stretch"))
    stretches = stretches.select("key", "epoch", "stretch", F.coalesce(F.sum("in_stretch").over(outer), F.lit(0)).alias("ahead"))
    inner = Window.partitionBy("key", "epoch", "stretch").orderBy("place", "block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("in_order", F.coalesce(F.sum("in_block").over(inner), F.lit(0))).join(stretches, ["key", "epoch", "stretch"])
    sums = sums.select("key", "block", "epoch", (F.col("ahead") + F.col("in_order")).alias("before"))
    within = uses.where("epochs is not null").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    running = F.sum("tokens").over(Window.partitionBy("key", "block", "epoch").orderBy(F.xxhash64("doc_id", "salt", "epoch"), "doc_id", "salt").rowsBetween(Window.unboundedPreceding, -1))
    within = within.withColumn("inside", F.coalesce(running, F.lit(0)))
    placed = within.join(sums, ["key", "block", "epoch"])
    start = F.col("epoch") * F.col("key_tokens") + F.col("before") + F.col("inside")
    out = placed.withColumn("start", start).where("start < budget or epoch = 0")  # the first epoch is whole, rows without tokens at its end included
    cols = ["doc_id", "source", "epoch", "tokens", "start", "weight", "alpha"]
    empty = uses.where("epochs is null").select("doc_id", "source", F.lit(0).cast("long").alias("epoch"), "tokens", F.lit(0).cast("long").alias("start"), F.lit(0.0).alias("weight"), F.lit(None).cast("double").alias("alpha"))
    return out.select(*cols).unionByName(empty)


def mixed_documents(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> DataFrame:
    """docs with each row as often as the mixture uses it, all columns as they were; wholly repeated rows go together."""
    prepare(docs.sparkSession)
    tag = F.xxhash64("doc_id", "source", "text")
    rows = docs.select(tag.alias("__tickforge_tag"), "source", n_tokens(F.col("text")).alias("tokens"))
    units = rows.groupBy("__tickforge_tag", "source").agg(F.sum("tokens").alias("tokens"))
    uses = mix_tokens(units.withColumnRenamed("__tickforge_tag", "doc_id").withColumn("salt", F.lit(0).cast("long")), entropy, repeats, BLOCK_TOKENS)
    times = uses.groupBy(F.col("doc_id").alias("__tickforge_tag")).agg(F.count("*").alias("__tickforge_times"))
    counted = docs.withColumn("__tickforge_tag", tag).join(times, "__tickforge_tag")
    return counted.withColumn("__tickforge_n", F.explode(F.sequence(F.lit(1).cast("long"), "__tickforge_times"))).select(*docs.columns)
