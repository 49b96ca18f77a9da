"""Secrets in texts: candidate strings by pattern, false positives removed by a random forest.

The forest looks at a candidate's length, its character transitions, how much of it dictionary words cover, whether it looks
like a path, and the words before and after it. The dictionary is the whole words of a public vocabulary. It is trained on labelled findings: written-out kinds of secrets and of harmless strings, and
candidates of a bounded sample of the texts that unmistakable formats or neighbours label.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm.common import prepare, sampled

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

#: Documents, about, of the sample that gives labelled findings beside the written ones; trees and their depth.
SAMPLE_DOCS, TREES, DEPTH, SEED = 2000, 25, 7, 7

# Words and public token formats.
SECRET_WORDS = frozenset("password passwd pwd passphrase secret token apikey api_key key auth authorization bearer credential credentials access_key secret_key private_key client_secret".split())
HARMLESS_WORDS = frozenset("sha sha1 sha256 md5 commit checksum digest uuid guid hash revision rev etag version build url file path example sample order invoice isbn phone tel".split())
PASSWORD_WORDS = frozenset("password passwd pwd passphrase pass".split())
CODE_WORDS = frozenset("about account after admin alpha application array async back base before beta block body build cache call change check class client code column common config content context control count create custom data date default delete demo device document domain driver element email error event example field file filter first folder format function global group handler header height hello home host html http https image index info input item javascript json language last layout length library license limit line link list load local login main manager message method model module name network node null number object order output package page param parent password path place plugin point port print process product profile project property public query read record request resource response result return root route sample schema script search section select server service session setting simple size source start state static status step store string style success system table target template test text this time title true type update upload user utils value version view virtual width window with word work world write".split())
FORMATS = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}")
#: What may stand in a value; & only where no next key=value begins.
_SIGNS = r"A-Za-z0-9+/_=.@~%!$*?#^-"
_NAMED = r"(?:\\?[\"']?(?P<name>[A-Za-z_][A-Za-z0-9_.-]{1,60})\\?[\"']?\s{0,2}(?P<is>[:=]{1,2}>?)\s{0,2})?"
#: A login in a URL; or a value with its name, if it has one. Where a name and = stand before, the two together are no value.
_CANDIDATE = re.compile(
    r"://[^\s/:@]{1,60}:(?P<login>[^\s/@]{4,200})@|(?<![A-Za-z0-9+/_=.@-])" + _NAMED + r"(?(name)|(?![A-Za-z_][A-Za-z0-9_.-]{1,60}={1,2}[A-Za-z0-9]))"
    r"(?P<quote>\\?[\"']?)(?!//)(?=[" + _SIGNS[:-1] + r"&-]{8})(?P<value>(?:[" + _SIGNS + r"]+|&(?![A-Za-z_][A-Za-z0-9_.-]{0,60}=))+)"
)
_BEFORE = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[.]")
_UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.I)


@cache
def dictionary(path: str = VOCABULARY) -> frozenset[str]:
    """Words of code, and the whole words of four or more letters of the vocabulary."""
    with open(path) as f:
        words = (w.removesuffix("</w>") for w in json.load(f)["model"]["vocab"] if w.endswith("</w>"))
        return CODE_WORDS | {w for w in words if len(w) >= 4 and w.isascii() and w.isalpha()}


def _parted(name: str) -> str:
    """In lower case, with _ between the parts of camelCase and dotted names."""
    return _HUMP.sub("_", name).lower()


def candidates(text: str) -> Iterator[tuple[int, str, str, bool, bool]]:
    """Start, value, words around, assigned, quoted, of values of 8 or more characters, and of passwords in URLs.

    Words around are three before, in lower case, then > and two after. A value under 16 characters or without a digit must be assigned
    to a secret's name, or have digits and letters and a secret's word around.
    """
    for m in _CANDIDATE.finditer(text):
        if m["login"]:
            yield m.start("login"), m["login"], "url password >", True, False
            continue
        value, name = m["value"] if m["quote"] else m["value"].rstrip(".,?!"), m["name"]
        if len(value) < 8:
            continue
        named = bool(m["is"]) and _neighbours(_parted(name))[0]
        digit = re.search(r"[0-9]", value) is not None
        if not named and not digit:
            continue
        before = _BEFORE.findall(text[max(0, m.start() - 60) : m.start()])[-3:]
        after = _BEFORE.findall(text[m.end() : m.end() + 40])[:2]
        around = " ".join(map(_parted, [*before, *([name] if name else []), ">", *after]))
        if not named and len(value) < 16:
            secret, _, follows, _, _ = _neighbours(around)
            if not (secret or follows) or value.isdigit() or not any(map(str.isalpha, value)):
                continue
        yield m.start("value"), value, around, bool(m["is"]), bool(m["quote"])


def _classes(value: str) -> np.ndarray:
    at = np.frombuffer(value.encode("ascii", "replace"), np.uint8)
    return np.select([(at >= 48) & (at <= 57), (at >= 97) & (at <= 122), (at >= 65) & (at <= 90)], [0, 1, 2], 3)


def _covered(value: str) -> float:
    """The share of characters in dictionary words of four or more letters."""
    low, hit, known = value.lower(), np.zeros(len(value), bool), dictionary()
    for n in range(4, min(11, len(low)) + 1):
        for i in range(len(low) - n + 1):
            if low[i : i + n] in known:
                hit[i : i + n] = True
    return float(hit.mean())


_VOWELS = frozenset("aeiou")
FEATURES = ["length", "digits", "uppers", "others", "transitions", "hexadecimal", "vowels", "distinct", "entropy", "covered", "slashes", "dots", "at", "uuid", "secret_word", "harmless_word", "secret_after", "harmless_after", "password_word", "assigned", "quoted", "one_class", "longest_run", "known_format"]


def _neighbours(around: str) -> tuple[bool, bool, bool, bool, bool]:
    """Whether a secret's and a harmless word stand before, whether one stands after, and whether a password's word stands before."""
    before, _, after = around.partition(">")
    words, then = set(re.split(r"[ _-]", before)) | set(before.split()), set(re.split(r"[ _-]", after))
    return bool(words & SECRET_WORDS), bool(words & HARMLESS_WORDS), bool(then & SECRET_WORDS), bool(then & HARMLESS_WORDS), bool(words & PASSWORD_WORDS)


def describe(value: str, around: str, assigned: bool, quoted: bool) -> list[float]:
    kinds, n = _classes(value), len(value)
    counts = np.array([value.count(c) for c in set(value)]) / n
    near = _neighbours(around)
    change = kinds[1:] != kinds[:-1]
    runs = np.diff(np.flatnonzero(np.concatenate([[True], change, [True]])))
    letters = [c for c in value.lower() if c.isalpha()]
    return [
        min(n, 80), float((kinds == 0).mean()), float((kinds == 2).mean()), float((kinds == 3).mean()), float(change.mean()) if n > 1 else 0.0,
        float(re.fullmatch(r"[0-9a-fA-F]+", value) is not None), sum(c in _VOWELS for c in letters) / max(1, len(letters)), len(set(value)) / n,
        float(-(counts * np.log2(counts)).sum()), _covered(value), value.count("/") / n, value.count(".") / n, float("@" in value), float(_UUID.fullmatch(value) is not None),
        *map(float, near), float(assigned), float(quoted), float(len(set(kinds.tolist())) == 1), float(runs.max()) / n, float(FORMATS.fullmatch(value) is not None),
    ]


def written_findings(seed: int = SEED, each: int = 60) -> tuple[list[list[float]], list[int]]:
    """Labelled findings of known kinds, drawn from their formats."""
    rng = np.random.default_rng(seed)
    draw = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    low, up, num, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    known = sorted(dictionary())
    word = lambda: known[int(rng.integers(len(known)))]
    password = lambda: str(rng.choice(sorted(PASSWORD_WORDS)))
    name = lambda: str(rng.choice(sorted(SECRET_WORDS)))
    plain = lambda: str(rng.choice(sorted(HARMLESS_WORDS)))
    spoken = lambda: "".join(str(rng.choice(list("bcdfghlmnprstvw"))) + str(rng.choice(list("aeiou"))) + str(rng.choice(["", "n", "r", "s", "t"])) for _ in range(int(rng.integers(4, 7))))
    x, y = [], []

    def add(label: int, value: str, before: str, assigned: bool, quoted: bool) -> None:
        x.append(describe(value, before, assigned, quoted))
        y.append(label)

    for _ in range(each):
        add(1, "AKIA" + draw(up + num, int(rng.integers(16, 18))), word(), False, False)
        add(1, "gh" + str(rng.choice(list("pous"))) + "_" + draw(low + up + num, 36), word(), bool(rng.integers(2)), False)
        add(1, draw(hexa, int(rng.choice([32, 40, 64]))), name(), True, bool(rng.integers(2)))
        add(1, draw(hexa, int(rng.integers(12, 30))), name(), True, bool(rng.integers(2)))
        add(1, draw(hexa.upper(), 40), name(), True, True)
        add(1, draw(low + up + num + "+/", int(rng.integers(20, 60))), name(), True, bool(rng.integers(2)))
        add(1, draw(low + up + num + "!$%&*", int(rng.integers(10, 20))), name(), True, bool(rng.integers(2)))
        add(1, "sk_live_" + draw(low + up + num, 24), word(), False, bool(rng.integers(2)))
        add(1, draw(low + up, 5) + draw(num, 2) + draw(low + up + num, int(rng.integers(1, 8))), name(), True, bool(rng.integers(2)))
        add(1, draw(low, int(rng.integers(4, 8))) + draw(num, 4) + draw(low, int(rng.integers(0, 5))), name(), True, bool(rng.integers(2)))
        add(1, "".join(word() for _ in range(int(rng.integers(3, 5)))), password(), True, bool(rng.integers(2)))
        add(1, draw(low + up, 4) + draw(num, 2) + draw(low + up + num + "!$", int(rng.integers(2, 9))), f"{word()} {name()} {word()}", False, bool(rng.integers(2)))
        add(1, draw(low + up + num + "!$%", int(rng.integers(8, 24))), "url password >", True, False)
        add(1, word() + draw(num, int(rng.integers(1, 3))) + draw(low + "!$%", int(rng.integers(2, 6))), password(), True, bool(rng.integers(2)))
        add(0, "_".join(word() for _ in range(int(rng.integers(2, 5)))).upper() + "_" + draw(num, int(rng.integers(1, 3))), word(), bool(rng.integers(2)), False)
        add(0, word() + draw(num, int(rng.integers(1, 3))), f"{name()} {word()}", False, bool(rng.integers(2)))
        add(0, word(), name(), True, bool(rng.integers(2)))
        add(0, word() + "_" + word() + str(rng.choice(["", "()", ".value", "[0]"])), str(rng.choice([name(), word()])), True, False)
        add(0, draw(hexa, int(rng.choice([32, 40, 64]))), f"{word()} > {plain()}", False, False)
        add(0, spoken(), name(), bool(rng.integers(2)), bool(rng.integers(2)))
        add(0, spoken().capitalize(), str(rng.choice([name(), word()])), bool(rng.integers(2)), bool(rng.integers(2)))
        add(0, spoken() + str(rng.choice(["-", "_", ".", "/"])) + spoken(), str(rng.choice([name(), word()])), bool(rng.integers(2)), bool(rng.integers(2)))
        add(0, str(rng.choice([spoken(), spoken().upper()])), word(), False, bool(rng.integers(2)))
        add(0, str(rng.choice([spoken() + draw(num, 2), draw(num, int(rng.integers(8, 16))), draw(hexa, 8)])), word(), bool(rng.integers(2)), bool(rng.integers(2)))
        add(0, draw(hexa, int(rng.choice([32, 40, 64]))), plain(), bool(rng.integers(2)), bool(rng.integers(2)))
        add(0, "-".join(draw(hexa, n) for n in (8, 4, 4, 4, 12)), str(rng.choice([plain(), word()])), bool(rng.integers(2)), False)
        add(0, draw(num, int(rng.integers(16, 20))), word(), False, False)
        add(0, "/".join(word() for _ in range(4)) + "/" + word() + draw(num, 2) + ".txt", word(), False, bool(rng.integers(2)))
        add(0, f"{word()}.{word()}{draw(num, 2)}@{word()}.example.com", word(), False, False)
        add(0, "_".join(word() for _ in range(3)) + draw(num, 1), word(), bool(rng.integers(2)), False)
        add(0, f"https//{word()}.example.com/{word()}?{word()}={draw(num, 3)}", plain(), False, False)
        add(0, str(rng.choice(["changeme", "your_password_here", "xxxxxxxxxxxx", "placeholder1", "example_token", "password123"])), name(), True, bool(rng.integers(2)))
        add(0, draw(num, 4) + "-" + draw(num, 2) + "-" + draw(num, 2) + "T" + draw(num, 6) + "Z", word(), bool(rng.integers(2)), False)
        add(0, ".".join(draw(num, int(rng.integers(1, 4))) for _ in range(6)), plain(), False, False)
    return x, y


def plain_label(value: str, around: str) -> int | None:
    """1 or 0 where format or neighbours leave no doubt, else None."""
    words = set(around.partition(">")[0].split())
    if FORMATS.fullmatch(value):
        return 1
    if "@" in value or value.isdigit() or _UUID.fullmatch(value) or words & HARMLESS_WORDS:
        return 0
    return None


class Forest:
    """Trees of axis-parallel splits, each from a bootstrap sample and random features, as flat arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.trees = [self._grow(x[i], y[i], depth, rng) for i in (rng.integers(0, len(y), len(y)) for _ in range(trees))]

    @staticmethod
    def _grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, share = [], [], [], [], []

        def node(rows: np.ndarray, depth: int) -> int:
            k = len(feature)
            for column, value in ((feature, -1), (cut, 0.0), (left, k), (right, k), (share, float(y[rows].mean()))):
                column.append(value)
            if depth and len(rows) > 4 and 0 < share[k] < 1:
                best = (0.0, -1, 0.0)
                base = share[k] * (1 - share[k])
                for f in rng.choice(x.shape[1], 6, replace=False):
                    values = x[rows, f]
                    for c in np.unique(np.quantile(values, np.linspace(0.05, 0.95, 12))):
                        low = values <= c
                        n = int(low.sum())
                        if 0 < n < len(rows):
                            a, b = y[rows][low].mean(), y[rows][~low].mean()
                            gain = base - (n * a * (1 - a) + (len(rows) - n) * b * (1 - b)) / len(rows)
                            if gain > best[0] + 1e-12:
                                best = (gain, int(f), float(c))
                if best[1] >= 0:
                    low = x[rows, best[1]] <= best[2]
                    feature[k], cut[k] = best[1], best[2]
                    left[k] = node(rows[low], depth - 1)
                    right[k] = node(rows[~low], depth - 1)
            return k

        node(np.arange(len(y)), depth)
        return np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(share)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(64):
                f = feature[at]
                if not (f >= 0).any():
                    break
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
                at = np.where(f < 0, at, np.where(go, left[at], right[at]))
            total += share[at]
        return total / len(self.trees)


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Forest:
    """Train on the written findings and on what plain_label says of candidates in `sample` documents."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = [], []
            for text in batch.column("text").to_pylist():
                for _, value, before, assigned, quoted in candidates(text or ""):
                    telling = len(value) >= 16 and re.search("[0-9]", value)  # ordinary words would crowd out the rest
                    if telling and (known := plain_label(value, before)) is not None and len(y) < 2000:
                        x.append(describe(value, before, assigned, quoted))
                        y.append(known)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32())], names=["x", "y"])

    x, y = written_findings()
    for r in sampled(docs, sample).select("text").mapInArrow(label, "x array<double>, y int").orderBy(F.xxhash64("x", "y")).limit(4000).collect():
        x.append(r["x"])
        y.append(r["y"])
    return Forest(np.array(x), np.array(y, float))


#: Values whose scores a task remembers.
_REMEMBERED = 200_000
_FOUND = "doc_id long, start long, length long, kind string, score double, masked string"


def scan(docs: DataFrame, sample: int = SAMPLE_DOCS, least: float = 0.5) -> DataFrame:
    """A row for each secret found: doc_id, start and length in code points, kind, score, and the value masked but for four characters.

    kind is `format` for a public token format, `assigned` for the value of a secret's name, else `opaque`. Null and empty texts
    have none; rows that repeat are scanned each; a null doc_id is carried along; an empty table gives none. A long text is scanned whole, in one
    pass. Columns but doc_id and text are not looked at. Equal scores tie at `least`, which counts as found.
    """
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, scores = model.value, {}
        for batch in batches:
            found, new = [], {}
            if len(scores) > _REMEMBERED:
                scores.clear()
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for start, value, before, assigned, quoted in candidates(text or ""):
                    key = (value, *_neighbours(before), assigned, quoted)
                    if key not in scores and key not in new:
                        new[key] = describe(value, before, assigned, quoted)
                    elif scores.get(key, 1.0) < least:
                        continue
                    found.append((doc, start, value, key))
            if new:
                scores.update(zip(new, forest.score(np.array(list(new.values()))).tolist()))
            kind = lambda v, assigned: "format" if FORMATS.match(v) else "assigned" if assigned else "opaque"
            kept = [(d, at, len(v), kind(v, k[3]), scores[k], v[:4] + "*" * (len(v) - 4)) for d, at, v, k in found if scores[k] >= least]
            cols = list(zip(*kept)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _FOUND)
