"""The encoder against the tokenizers library, on words, code points, random bytes and the given documents."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickforge.llm import bpe
from tickforge.llm.common import load

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def theirs():
    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def ours():
    return bpe.encoder(bpe.VOCABULARY)


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


def test_every_token_is_its_own_encoding(ours):
    """So that a token may stand alone at a prefix's start."""
    a = ours.vocabulary.automaton
    assert sum(w >= 0 for w in a.word) == 50_256
    assert all(a.length[s] == len(ours.vocabulary.bytes[w]) for s, w in enumerate(a.word) if w >= 0)


def test_automaton_finds_all_tokens_that_end_at_a_place():
    rng = random.Random(5)
    words = {bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 6))) for _ in range(20)} | {b"a", b"b"}
    names = {w: k for k, w in enumerate(sorted(words))}
    auto = bpe.SuffixAutomaton(names.items())
    text = bytes(rng.choice(b"ab") for _ in range(400))
    state = held = 0
    for end, c in enumerate(text, 1):
        while c not in auto.next[state]:
            state = auto.link[state]
            held = auto.length[state]
        state, held = auto.next[state][c], held + 1
        k, found = auto.nearest[state if auto.length[state] <= held else auto.link[state]], []
        while k > 0:
            found.append(auto.word[k])
            k = auto.nearest[auto.link[k]]
        assert found == [names[text[b:end]] for b in range(max(0, end - 5), end) if text[b:end] in names]


def test_code_points_in_context(theirs, ours):
    """Every code point between letters, digits, spaces and signs is cut as the library cuts it."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 4096):
        texts = ["".join(f"a{c}1{c} {c}{c}.{c}\n" for c in points[j : j + 64]) for j in range(k, min(k + 4096, len(points)), 64)]
        for text, got in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)):
            if ids(ours, text) != got.ids:
                wrong = [f"{ord(c):x}" for c in text if ids(ours, f"a{c}1{c} {c}{c}.{c}\n") != theirs.encode(f"a{c}1{c} {c}{c}.{c}\n", add_special_tokens=False).ids]
                raise AssertionError(sorted(set(wrong)))


def test_random_texts(theirs, ours):
    rng = random.Random(2)
    letters = ["etaoin", "abcdefghijklmnopqrstuvwxyz", "aA", "éüßñ中文字", " \n\t 'sdtm", "0123456789", "-=_*#", "नमस्ते", "🙂👩‍👩‍👧"]
    for _ in range(6000):
        text = "".join(rng.choice(rng.choice(letters)) for _ in range(rng.randrange(0, 40)))
        want = theirs.encode(text, add_special_tokens=False).ids
        assert ids(ours, text) == want, text
        assert ours.decode(ours.encode(text)) == theirs.decode(want, skip_special_tokens=False) == text


def test_joined_tokens(theirs, ours):
    """Tokens put side by side merge across their borders as in the library."""
    rng = random.Random(3)
    words = [w.decode() for w in ours.vocabulary.bytes if w.isalpha() and w.isascii()]
    for _ in range(6000):
        text = "".join(rng.choice(words) for _ in range(rng.randrange(2, 6)))
        assert ids(ours, text) == theirs.encode(text, add_special_tokens=False).ids, text


def test_long_pieces(theirs, ours):
    rng = random.Random(4)
    for text in ("a" * 5001, "ab" * 3000, "".join(rng.choice("etaoinsh") for _ in range(20_000)), " " * 3000, "\n" * 999 + "x", "=" * 4097, "0" * 1000):
        assert ids(ours, text) == theirs.encode(text, add_special_tokens=False).ids


def test_special_tokens_and_broken_ids(theirs, ours):
    for text in ("<|endoftext|>", "a<|endoftext|>b", " <|endoftext|><|endoftext|> ", "<|endoftext|", "<|<|endoftext|>|>", "x <|endoftext|>\n\n"):
        want = theirs.encode(text, add_special_tokens=False).ids
        assert ids(ours, text) == want
        assert ours.decode(ours.encode(text)) == theirs.decode(want, skip_special_tokens=False)
    rng = random.Random(6)
    for _ in range(2000):  # any ids, so bytes that aren't UTF-8
        some = [rng.randrange(256 if rng.random() < 0.7 else 50_257) for _ in range(rng.randrange(12))]
        assert ours.decode(np.array(some, "<u4").tobytes()) == theirs.decode(some, skip_special_tokens=False)


def digest(theirs, doc_id, text):
    got = theirs.encode(text or "", add_special_tokens=False).ids
    return (doc_id, len(got), hashlib.sha256(np.array(got, "<u4").tobytes()).hexdigest(), hashlib.sha256(theirs.decode(got, skip_special_tokens=False).encode()).hexdigest())


def test_the_given_documents(spark, theirs):
    docs = load(spark, SF, "documents")
    want = [digest(theirs, r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, bpe.encode_and_decode(docs).collect())) == sorted(want)


def test_encode_and_decode_give_back_the_texts(spark):
    docs = load(spark, SF, "documents")
    back = bpe.decode(bpe.encode(docs))
    assert back.join(docs.select("doc_id", F.col("text").alias("was")), "doc_id").where("text = was").count() == docs.count()


def test_odd_input(spark, theirs, odd, nothing, monkeypatch):
    """Nulls, empties, repeated rows, very long texts, clashing columns, a memory of few pieces; no rows at all."""
    clash = odd.selectExpr("*", "1 as ids", "'x' as n_tokens", "2 as ids_sha256")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = sorted((digest(theirs, r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()), key=key)
    assert sorted(map(tuple, bpe.encode_and_decode(clash).collect()), key=key) == want
    assert bpe.encode_and_decode(nothing).count() == bpe.encode(nothing).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect() == [(1, None), (2, "")]
    monkeypatch.setattr(bpe, "REMEMBERED", 7)
    few = bpe.Encoder()
    text = " ".join(f"word{k} and more{k % 5}" for k in range(200))
    assert ids(few, text) == theirs.encode(text, add_special_tokens=False).ids
    assert len(few) <= 7 and len(few.pairs) <= 7
