"""Rules on whole texts, run as a short-circuit cascade that a sample has put in order."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm.common import SPACE, prepare, sampled, texts_of, window_hashes, word_hashes

#: About how many rows are in the sample that orders the rules; the order changes the work, never a verdict.
SAMPLE_ROWS = 500
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
_UPPER, _ALPHA = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_TAIL = bytes(range(0x80, 0xC0))


class Text:
    """A text and what rules ask of it, each computed once and only if asked."""

    def __init__(self, raw: bytes, word_ids: np.ndarray | None = None):
        self.raw = raw
        if word_ids is not None:
            self.word_ids = word_ids

    @cached_property
    def n_words(self) -> int:
        return len(self.word_ids)

    @cached_property
    def word_chars(self) -> int:
        return len(self.raw.translate(None, SPACE + _TAIL))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def dup_line_bytes(self) -> int:
        return sum(map(len, self.lines)) - sum(map(len, set(self.lines)))

    @cached_property
    def n_stutters(self) -> int:
        return int(np.count_nonzero(self.word_ids[1:] == self.word_ids[:-1]))

    @cached_property
    def word_ids(self) -> np.ndarray:
        return word_hashes([self.raw])[0]

    @cached_property
    def n_repeat_words(self) -> int:
        windows = window_hashes(self.word_ids, WINDOW)
        if len(windows) < 2:
            return 0
        order = np.sort(windows)
        twice = order[1:][order[1:] == order[:-1]]
        if not len(twice):
            return 0
        starts = np.flatnonzero(np.isin(windows, twice))
        edge = np.zeros(self.n_words + 1, np.int32)
        edge[starts] += 1
        np.add.at(edge, starts + WINDOW, -1)
        return int(np.count_nonzero(np.cumsum(edge[:-1])))

    @cached_property
    def n_upper(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _UPPER))

    @cached_property
    def n_alpha(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _ALPHA))


#: Each says of a text that it is rejected. Conjunction: the order of evaluation can't change the verdict.
RULES: dict[str, Callable[[Text], bool]] = {
    "too_few_words": lambda t: t.n_words < 20,
    "repeated_passages": lambda t: 100 * t.n_repeat_words > 30 * t.n_words,
    "symbols_per_word": lambda t: 10 * t.n_symbols > t.n_words,
    "repeated_lines": lambda t: 100 * t.dup_line_bytes > 30 * len(t.raw),
    "repeated_words": lambda t: 100 * t.n_stutters > 30 * t.n_words,
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words,
    "capitals": lambda t: 100 * t.n_upper > 30 * len(t.raw),
    "few_letters": lambda t: 100 * t.n_alpha < 60 * len(t.raw.translate(None, SPACE)),
    "few_distinct_words": lambda t: 100 * len(np.unique(t.word_ids)) < 5 * min(t.n_words, 1000),
}


def cascade(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds a row, share rejected) in the order to run: most rejections per cost first, never-rejecting rules by cost."""
    prepare(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0
        spent, hits = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0)
        for batch in batches:
            for raw in texts_of(batch):
                rows += 1
                for name, rule in RULES.items():
                    began = time.perf_counter()
                    hits[name] += rule(Text(raw))
                    spent[name] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": list(RULES), "n": [rows] * len(RULES), "s": list(spent.values()), "hits": list(hits.values())})

    seen: dict[str, list[float]] = {name: [0, 0.0, 0] for name in RULES}
    for r in sampled(docs, sample_rows).select("text").mapInArrow(measure, "rule string, n long, s double, hits long").collect():
        seen[r["rule"]] = [x + y for x, y in zip(seen[r["rule"]], (r["n"], r["s"], r["hits"]))]
    rated = [(name, s / max(n, 1), hits / max(n, 1)) for name, (n, s, hits) in seen.items()]
    return sorted(rated, key=lambda x: (-x[2] / max(x[1], 1e-9), x[1], x[0]))


def _verdict(text: Text, order: list[Callable[[Text], bool]]) -> bool:
    return not any(rule(text) for rule in order)


METRICS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def measure_quality(docs: DataFrame) -> DataFrame:
    """Counts and verdict for each document; null text has no words. A row for each input row, repeated or with null doc_id too.

    kept is false as soon as one of RULES rejects; base_failed has the first two rules alone.
    """
    order = [RULES[name] for name, _, _ in cascade(docs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            raws = texts_of(batch)
            for t in map(Text, raws, word_hashes(raws)):
                failed = RULES["too_few_words"](t) or RULES["repeated_passages"](t)
                out.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, not failed and _verdict(t, order)))
            cols = list(zip(*out)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, METRICS)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows no rule rejects, all columns as they were; one pass, no shuffle."""
    order = [RULES[name] for name, _, _ in cascade(docs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = texts_of(batch)
            yield batch.filter(pa.array([_verdict(t, order) for t in map(Text, raws, word_hashes(raws))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
