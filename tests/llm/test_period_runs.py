"""Periodic runs against a brute force over all periods and places."""

import hashlib
import random
import zlib

import pytest

from tickforge.llm import period_runs
from tickforge.llm.common import load

SF = "/root/testdata/sf0.001"


def brute(words):
    """(start, length, period) of every run, by start, then period."""
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(6, 4 * q) and not any(all(words[k] == words[k + d] for k in range(i, i + n - d)) for d in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    dropped = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    said = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    rest = b" ".join(w for k, w in enumerate(words) if k not in dropped)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(rest).hexdigest())


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r))


def spliced(rng, n):
    out = []
    while len(out) < n:
        unit = [rng.choice("abcde") for _ in range(rng.randrange(1, 20))]
        out += unit * rng.randrange(1, 9)
        out = out[: len(out) - rng.randrange(len(unit))]
        out += [str(rng.random())] * (rng.random() < 0.3)
    return out[:n]


@pytest.mark.parametrize("row_words", [8, 64, 16384])
def test_runs_equal_brute_force_on_random_words(spark, monkeypatch, row_words):
    """Small rows of tiles force stitching between rows."""
    monkeypatch.setattr(period_runs, "ROW_WORDS", row_words)
    rng = random.Random(row_words)
    texts = [" ".join(spliced(rng, rng.randrange(300))) for _ in range(300)] + [" ".join(rng.choice("ab") for _ in range(rng.randrange(120))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert rows_of(period_runs.periodic_runs(docs)) == [expected(i, t) for i, t in enumerate(texts)]


def test_stitching_over_rows_without_spark():
    """A run of 40,000 words in a document of 90,000 lies in several rows of tiles, which agree where they meet."""
    unit = [f"w{k}" for k in range(700)]
    words = [f"x{k}" for k in range(30_011)] + (unit * 58)[:40_000] + [f"y{k}" for k in range(20_000)]
    h = period_runs.word_hashes([" ".join(words).encode()])[0]
    rows = list(period_runs.tile_rows(h))
    assert len(rows) > 3
    parts = sorted((s, e, q) for row in rows for q, s, e in period_runs.solve(*row))
    assert {q for _, _, q in parts} == {700}
    assert (min(s for s, _, _ in parts), max(e for _, e, _ in parts)) == (30_011, 70_011)
    assert all(b[0] <= max(x[1] for x in parts[: k + 1]) - 700 for k, b in enumerate(parts[1:]))


def test_the_given_documents(spark):
    docs = load(spark, SF, "documents")
    short = [(r.doc_id, r.text) for r in docs.where("length(text) < 3000").select("doc_id", "text").collect()]
    got = {r[0]: r for r in rows_of(period_runs.periodic_runs(docs))}
    assert len(got) == docs.count() and any(r[1] for r in got.values())
    for doc_id, text in short:
        assert got[doc_id] == expected(doc_id, text)


def test_odd_input(spark, odd, nothing):
    """Nulls, empties, repeated rows, 400,000 words, clashing columns; no rows at all."""
    clash = odd.selectExpr("*", "1 as period", "2 as octave", "3 as words", "4 as runs", "5 as fresh", "6 as start")
    got = rows_of(period_runs.periodic_runs(clash))
    rows = [(r.doc_id, r.text) for r in odd.where("doc_id is null or doc_id <> 8").select("doc_id", "text").collect()]
    assert [r for r in got if r[0] != 8] == sorted((expected(*r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r))
    (long,) = (r for r in got if r[0] == 8)
    assert long[1:6] == (1, 0, 400_000, 9000, 44444)
    assert period_runs.periodic_runs(nothing).count() == 0
    assert [f.name for f in period_runs.periodic_runs(nothing).schema] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_words_end_at_ascii_white_space_only(spark):
    """A no-break space is part of a word, so is a NUL; the other five white-space bytes end one."""
    text = "a b\tc\x0bd\x0ce\rf\n g\x00h"
    assert rows_of(period_runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"))) == [expected(1, text)]
