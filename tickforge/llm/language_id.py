"""Language identification by unigram piece models whose score sums over all segmentations.

Pieces are those of a fixed public vocabulary. For each language expectation-maximisation fits piece probabilities on words of a bounded
sample of labelled documents. A text's score in a language is the sum over its words of the log of the forward probability, the total
over all ways to cut the word into pieces. Whichever language scores highest is predicted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.llm.common import cut, prepare

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: Bounds of what is fitted on: documents (about) and distinct words of each language, rounds.
SAMPLE_DOCS, SAMPLE_WORDS, ROUNDS = 1500, 20_000, 4
#: Languages that are fitted or scored at once, for memory; any number gives the same result.
TOGETHER = 16
#: Longer words are scored in parts of so many characters.
PART = 60
#: What a character outside the vocabulary counts in any language; and what keeps forward sums in range, per character.
UNSEEN, SCALE = 1e-7, 30.0
#: Bytes, about, of the words and scores that a task remembers: 128 for a word and twice 8 for each language, as the table doubles.
_REMEMBERED = 96 << 20
#: A word: letters, and the marks that belong to them. Other numeric characters and signs are no letters.
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*+")


class Pieces:
    """The vocabulary: piece -> id, and what pieces begin with. The last id stands for any character without a piece."""

    def __init__(self, path: str = VOCABULARY):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.ids = {p: i for i, p in enumerate(dict.fromkeys(p.lower() for p in kept))}
        self.heads = {p[:n] for p in self.ids for n in range(1, len(p))}
        self.size = len(self.ids) + 1

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, start, end and piece id of every piece that occurs in a word, sorted by end and word."""
        get, heads, unseen, found = self.ids.get, self.heads, self.size - 1, []
        for k, w in enumerate(words):
            n = len(w)
            for i in range(n):
                base = (k << 28) | (i << 16)
                p = get(w[i])
                found.append(base | (i + 1 << 22) | (unseen if p is None else p))
                for j in range(i + 2, n + 1):
                    part = w[i:j]
                    p = get(part)
                    if p is not None:
                        found.append(base | (j << 22) | p)
                    elif part not in heads:
                        break
        table = np.array(found, np.int64)
        end = (table >> 22) & 63
        table = table[np.argsort(end, kind="stable")]
        return table >> 28, (table >> 16) & 63, (table >> 22) & 63, table & 65535


def _forward(n: int, edges, prob: np.ndarray) -> np.ndarray:
    """Scaled forward sums [word, position, language]."""
    word, start, end, piece = edges
    most = int(end[-1]) if len(end) else 0
    sums = np.zeros((n, most + 1, prob.shape[1]))
    sums[:, 0] = 1.0
    cuts = np.searchsorted(end, np.arange(1, most + 2))
    for j in range(1, most + 1):
        e = slice(cuts[j - 1], cuts[j])
        w = word[e]
        if len(w):
            gain = sums[w, start[e]] * prob[piece[e]] * (SCALE ** (j - start[e]))[:, None]
            first = np.flatnonzero(np.diff(w, prepend=-1))  # edges of an end come word by word
            sums[w[first], j] = np.add.reduceat(gain, first, axis=0)
    return sums


def _at_ends(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return sums[np.arange(len(lengths)), lengths]


def log_scores(words: list[str], pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """The log of the forward probability of each word in each language."""
    if not words:
        return np.zeros((0, prob.shape[1]))
    lengths = np.array([len(w) for w in words])
    edges, every = pieces.edges(words), range(0, prob.shape[1], TOGETHER)
    ends = np.concatenate([_at_ends(_forward(len(words), edges, prob[:, i : i + TOGETHER]), lengths) for i in every] or [np.zeros((len(words), 0))], axis=1)
    return np.log(np.maximum(ends, 1e-290)) - lengths[:, None] * np.log(SCALE)


def fit(words: list[str], counts: np.ndarray, pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities [piece, language] from words and how often each language has them, by expectation-maximisation."""
    n_lang = counts.shape[1]
    prob = np.full((pieces.size, n_lang), 1.0 / pieces.size)
    chunks = [slice(i, i + 4000) for i in range(0, len(words), 4000)]
    cut_up = [(words[c], counts[c], pieces.edges(words[c])) for c in chunks]
    for _ in range(rounds):
        seen = np.full((pieces.size, n_lang), 0.01)
        for part, times, edges in cut_up:
            word, start, end, piece = edges
            lengths = np.array([len(w) for w in part])
            ahead = _forward(len(part), edges, prob)
            behind = np.zeros_like(ahead)
            behind[np.arange(len(part)), lengths] = 1.0
            for j in range(ahead.shape[1] - 1, 0, -1):  # backwards over ends: all that ends at j, to its starts
                e = slice(*np.searchsorted(end, [j, j + 1]))
                np.add.at(behind, (word[e], start[e]), behind[word[e], j] * prob[piece[e]] * (SCALE ** (j - start[e]))[:, None])
            total = np.maximum(_at_ends(ahead, lengths), 1e-290)
            use = ahead[word, start] * prob[piece] * (SCALE ** (end - start))[:, None] * behind[word, end] / total[word] * times[word]
            np.add.at(seen, piece, use)
        prob = seen / seen.sum(axis=0)
        prob[-1] = UNSEEN
    return prob


def words_of(text: str) -> list[str]:
    """The runs of letters in lower case, each after the vocabulary's word mark, in parts of less than PART characters."""
    out = []
    for w in _LETTERS.findall(text.lower()):
        if len(w) < PART - 1:
            out.append("▁" + w)
        else:
            w = "▁" + w
            out += [w[i : i + PART - 1] for i in range(0, len(w), PART - 1)]
    return out


def held_out(doc_id="doc_id") -> "F.Column":
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, path: str = VOCABULARY) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities, from labelled documents that aren't held out.

    A hash of the id picks about SAMPLE_DOCS of each language. All languages that occur are learned, TOGETHER at a time.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE_DOCS)) / F.col("n"))
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / F.lit(1e6)
    sample = rows.join(F.broadcast(sizes.select("lang", share.alias("share"))), "lang").where(spot < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                seen.update((lang, w) for w in words_of(text))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k for k, _ in seen], pa.string()), "word": pa.array([w for _, w in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    counted = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = cut(counted.withColumn("k", F.row_number().over(best)).where(F.col("k") <= SAMPLE_WORDS).select("lang", "word", "n"))
    langs = sorted(r["lang"] for r in top.select("lang").distinct().collect())
    if not langs:
        return [], np.zeros((1, 0))
    pieces, probs = Pieces(path), []
    for i in range(0, len(langs), TOGETHER):
        some = langs[i : i + TOGETHER]
        rows = top.where(F.col("lang").isin(some)).toPandas()
        words, column = sorted(set(rows["word"])), {x: k for k, x in enumerate(some)}
        at = {w: k for k, w in enumerate(words)}
        counts = np.zeros((len(words), len(some)))
        counts[[at[w] for w in rows["word"]], [column[x] for x in rows["lang"]]] = rows["n"]
        probs.append(fit(words, counts, pieces))
    return langs, np.concatenate(probs, axis=1)


_PIECES: dict[str, Pieces] = {}


def predict(docs: DataFrame, langs: list[str], prob: np.ndarray, path: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the posterior at equal priors) of every row; `und` and 0 where there is no letter or nothing was learned."""
    model = docs.sparkSession.sparkContext.broadcast(prob.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _PIECES:
            _PIECES[path] = Pieces(path)
        pieces, slots, table = _PIECES[path], {}, np.zeros((1024, len(langs)))
        for batch in batches:
            texts, found = batch.column("text").to_pylist(), []
            for i in range(0, len(texts), 128):
                if len(slots) * (128 + 16 * len(langs)) > _REMEMBERED:
                    slots.clear()
                words = [words_of(x) if x and langs else [] for x in texts[i : i + 128]]
                new = list({w for ws in words for w in ws if w not in slots})
                for k in range(0, len(new), 4000):
                    part, n = new[k : k + 4000], len(slots)
                    if n + len(part) > len(table):
                        table = np.concatenate([table, np.zeros((max(len(part), len(table)), len(langs)))])
                    table[n : n + len(part)] = log_scores(part, pieces, model.value)
                    slots.update(zip(part, range(n, n + len(part))))
                for ws in words:
                    if not ws:
                        found.append(("und", 0.0))
                        continue
                    total = table[np.fromiter(map(slots.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                    best = int(np.argmax(total))
                    found.append((langs[best], float(1 / np.exp(total - total[best]).sum())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Learn from docs and predict all of docs. lang, source and doc_id don't bear on a prediction."""
    prepare(docs.sparkSession)
    langs, prob = learn(docs, path)
    return predict(docs, langs, prob, path)
