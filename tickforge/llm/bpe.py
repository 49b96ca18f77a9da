"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

Merging pairs by rank gives every prefix of a piece one encoding, and that encoding without its last token is the encoding of a shorter
prefix. So the last token of each prefix, stored by length, is all there is to know. A suffix automaton over the vocabulary yields the
tokens that end at a place; the one token among them stands last that doesn't merge with, or across, the last token of the prefix before it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm.common import prepare

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Pieces and pairs that a task remembers, at most; longer pieces than LONG characters are encoded anew each time.
REMEMBERED, LONG = 500_000, 64
#: Bytes of ids and decoded text in a batch of results.
BATCH_BYTES = 8 << 20
_NEVER = 1 << 40


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class SuffixAutomaton:
    """A generalised suffix automaton over words: each state stands for strings that end at the same places of the words, the longest of `length`.

    A word's own state has the word as its longest string, so `word` of a state is one word at most; `nearest` is the first state with a
    word on the way up the suffix links, the state itself included.
    """

    def __init__(self, words: Iterable[tuple[bytes, int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.word = [-1], [0], [-1]
        for text, name in words:
            at = 0
            for c in text:
                at = self._extend(at, c)
            self.word[at] = name
        self.nearest = [0] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.nearest[s] = s if self.word[s] >= 0 else self.nearest[self.link[s]]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.word.append(-1)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state that p leads to by c, of strings no longer than p's and c; divided from longer ones if need be."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = part
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = part
            p = self.link[p]
        return part

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new


class Vocabulary:
    """The ids, merges and special tokens of a byte-level vocabulary file."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        byte = byte_characters()
        known: dict[str, int] = said["model"]["vocab"]
        special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.special = special
        self.bytes = [b""] * (1 + max([*known.values(), *special.values()]))
        for word, i in known.items():
            self.bytes[i] = bytes(byte[c] for c in word)
        for word, i in special.items():
            self.bytes[i] = word.encode()
        #: The rank that makes a token (-1: a byte), and what it is made of.
        self.made, self.left, self.right = [-1] * len(self.bytes), [-1] * len(self.bytes), [-1] * len(self.bytes)
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(said["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, made = known[a], known[b], known[a + b]
            self.merge[x, y] = rank
            if self.made[made] < 0:
                self.made[made], self.left[made], self.right[made] = rank, x, y
        whole: dict[int, bool] = {}
        for i in sorted(known.values(), key=self.made.__getitem__):
            whole[i] = len(self.bytes[i]) == 1 or self.made[i] >= 0 and whole[self.left[i]] and whole[self.right[i]] and self.stay_apart(self.left[i], self.right[i], self.made[i])
        self.automaton = SuffixAutomaton((self.bytes[i], i) for i, ok in whole.items() if ok)

    def stay_apart(self, x: int, y: int, until: int = _NEVER) -> bool:
        """Whether the bytes of x and y, merged by rank below `until`, end as these two tokens: no two tokens that ever meet at their border merge.

        Read backwards in time: the token at the border that was made last gives way to its part at the border. A pair would merge before
        either is used up; of equal ranks the merge further left is made first.
        """
        x_used = y_used = until
        while True:
            rank = self.merge.get((x, y))
            if rank is not None and rank < x_used and (rank <= y_used if y_used < until else rank < y_used):
                return False
            if self.made[x] > self.made[y]:
                x_used, x = self.made[x], self.right[x]
            elif self.made[y] < 0:
                return True
            else:
                y_used, y = self.made[y], self.left[y]


class Encoder(dict):
    """The ids (little-endian, 32 bits) of pieces, remembered up to a bound."""

    def __init__(self, path: str = VOCABULARY):
        super().__init__()
        self.vocabulary = Vocabulary(path)
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.vocabulary.special, key=len, reverse=True))) + ")") if self.vocabulary.special else None
        self.pairs: dict[int, bool] = {}

    def piece(self, text: bytes) -> list[int]:
        """The ids of one piece: last[k] is the last token of its first k bytes."""
        v, pairs = self.vocabulary, self.pairs
        a = v.automaton
        following, link, length, word, nearest = a.next, a.link, a.length, a.word, a.nearest
        last, state, held = [0] * (len(text) + 1), 0, 0
        for end, c in enumerate(text, 1):
            while c not in following[state]:
                state = link[state]
                held = length[state]
            state = following[state][c]
            held += 1
            k = nearest[state if length[state] <= held else link[state]]
            while True:
                token, begin = word[k], end - length[k]
                if not begin:
                    break
                pair = last[begin] << 32 | token
                apart = pairs.get(pair)
                if apart is None:
                    if len(pairs) >= REMEMBERED:
                        pairs.clear()
                    apart = pairs[pair] = v.stay_apart(last[begin], token)
                if apart:
                    break
                k = nearest[link[k]]
            last[end] = token
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= len(v.bytes[last[at]])
        return out[::-1]

    def __missing__(self, text: str) -> bytes:
        ids = np.array(self.piece(text.encode()), "<u4").tobytes()
        if len(text) <= LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[text] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.specials is None or not any(s in text for s in self.vocabulary.special):
            return b"".join(map(self.__getitem__, self.split(text)))
        parts = self.specials.split(text)  # plain, special, plain ...
        return b"".join(np.array([self.vocabulary.special[p]], "<u4").tobytes() if k % 2 else b"".join(map(self.__getitem__, self.split(p))) for k, p in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        """The text of ids; what isn't UTF-8 becomes U+FFFD."""
        return b"".join(map(self.vocabulary.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str = VOCABULARY, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of each row of docs; null text counts as empty, and a text without bytes has no ids.

    A special token's string in a text is its id. A task holds the vocabulary's automaton, half a million pieces and pairs, and one text's pieces.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(path).encode
        for batch in batches:
            names, out, size = batch.column("doc_id"), [], 0
            for k, x in enumerate(batch.column("text").to_pylist()):
                out.append(np.frombuffer(to_ids(x or ""), "<i4"))
                size += out[-1].nbytes
                if size > BATCH_BYTES or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([names.slice(k + 1 - len(out), len(out)), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])
                    out, size = [], 0

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, text of rows with doc_id and ids; null ids have a null text, and ids outside the vocabulary are an error."""
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_text = encoder(path).decode
        for batch in batches:
            texts = [None if x is None else to_text(np.array(x, "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_and_decode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """A row for each document: doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256 (of what the ids decode to).

    One pass without a shuffle. Null text counts as empty: no tokens, and the digest of no bytes twice. Repeated rows, null ids and other
    columns change nothing.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(path)
        for batch in batches:
            counts, ids, texts = [], [], []
            for x in batch.column("text"):
                raw = use.encode(x.as_py() or "")
                counts.append(len(raw) // 4)
                ids.append(hashlib.sha256(raw).hexdigest())
                texts.append(hashlib.sha256(use.decode(raw).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _DIGESTS)
