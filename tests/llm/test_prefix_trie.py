"""The trie of conversation prefixes against a plain dictionary of prefixes, and against its SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from tickforge.llm import prefix_trie
from tickforge.llm.common import load
from tickforge.llm.queries import OP11_SQL

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, of in members.items():
        tokens = (len(of) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += tokens
    out = []
    for node, of in members.items():
        ends = ",".join(map(str, sorted(c for c in of if len(whole[c]) == len(node))))
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def nodes(turns, *cut):
    return sorted(map(tuple, prefix_trie.prefix_trie(turns, *cut).collect()))


def made(rng, convs, most, words):
    rows = []
    for c in convs:
        for turn in range(rng.randrange(1, most)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), " ".join(rng.choice("ab") for _ in range(rng.randrange(words)))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("depth,shard,block,ids", [(32, 20_000, 4096, 1 << 20), (2, 7, 2, 3), (1, 3, 1, 5), (3, 1, 4096, 4)])
def test_nodes_equal_a_dictionary_of_prefixes(spark, depth, shard, block, ids):
    """Bands of one to three turns and shards of a few rows: nodes over many shards, conversations over many bands."""
    rng = random.Random(depth)
    rows = made(rng, rng.sample(range(200), 60), 9, 3)
    rows += [(c, t, "user", "same") for c in (401, 402, 403, 421, 440) for t in range(14)] + [(500, t, "user", "same") for t in range(13)]
    assert nodes(spark.createDataFrame(rows, SCHEMA).repartition(3), depth, shard, block, ids) == brute(rows)


def test_a_conversation_with_a_third_of_all_rows(spark):
    rng = random.Random(9)
    rows = made(rng, range(60), 9, 4) + [(77, t, "user", f"a{t}") for t in range(700)] + [(78, t, "user", f"a{t}") for t in range(650)]
    assert nodes(spark.createDataFrame(rows, SCHEMA), 32, 20, 3) == brute(rows)


def test_the_given_conversations_and_the_sql(spark):
    turns = load(spark, SF, "conversations")
    got = nodes(turns)
    assert got == brute([(r.conv_id, r.turn, r.role, r.text) for r in turns.collect()])
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    assert got == sorted(db.sql(OP11_SQL).fetchall())


def test_odd_input(spark):
    """Nulls everywhere, negative ids, repeated turns, conversations without a turn left, a text of 1 MB, clashing columns; no rows at all."""
    long = "x " * 500_000
    rows = [
        (1, None, "user", "first"), (1, 0, None, "second"), (1, 0, None, "second"), (2, 1, "user", None), (2, 2, None, None), (None, 1, "user", "nobody"), (3, 5, "user", long), (20, 1, "", ""),
        (21, 0, "user", "a"), (23, 0, "user", "b"), (24, 0, "user", "c"), (25, 0, "user", "d"), (40, 0, "user", "e"), (41, 0, "user", "f"), (41, 1, "user", " \t\n"), (-20, 0, "user", "g"),
    ]
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as conv", "2 as place", "3 as shard", "4 as band", "5 as x", "6 as ids")
    assert nodes(clash) == brute(rows)
    empty = prefix_trie.prefix_trie(clash.where("false"))
    assert empty.count() == 0 and empty.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
