"""Reading level of documents (problem 3): sentence levels aggregated into calibrated document difficulty.

A regularised softmax model over hashed words, word pairs and character n-grams gives every sentence a distribution over
the levels; a document's sentence distributions are averaged, and a second small softmax, fitted on documents that the
first did not see, turns the averages into calibrated document levels. Both are fitted on a bounded sample of labelled
rows; labels may be noisy as long as most are right. All documents are scored over all of their sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from ._arrow import over_batches
from ._sample import by_hash
from .charform import fold

LEVELS = ("A1", "A2", "B1", "B2", "C1", "C2")
BITS = 17
_SENTENCE = re.compile(r"(?<=[.!?…”])\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+|\d+")


def _mixed(code: np.ndarray) -> np.ndarray:
    code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((code ^ (code >> np.uint64(32))) >> np.uint64(64 - BITS)).astype(np.int64)


def _number(key: str) -> int:
    return xxhash.xxh3_64_intdigest(key) >> (64 - BITS)


class Lexicon:
    """Words met so far: number, code and features (the word and its character trigrams) of each.

    Figures are one word, capitalised words after the first of a sentence are names, which say nothing about the level.
    """

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = weights
        self.clear()

    def clear(self) -> None:
        self.first, self.later, self.known = _Memo(self, False), _Memo(self, True), {}
        self.codes: list[int] = []
        self.features: list[np.ndarray] = []
        self.sums: list[np.ndarray] = []
        self.tables: tuple = (-1,)

    def number(self, raw: str, later: bool) -> int:
        word = "0" if raw[0].isdigit() else "N" if later and raw[0].isupper() else raw.lower()
        if word not in self.known:
            padded = f"<{word}>"
            keys = [word, *("#" + padded[i : i + 3] for i in range(len(padded) - 2) if len(word) > 2)]
            self.known[word] = len(self.codes)
            self.codes.append(xxhash.xxh3_64_intdigest(word))
            self.features.append(np.array([_number(k) for k in keys], np.int64))
            if self.weights is not None:
                self.sums.append(self.weights[self.features[-1]].sum(axis=0))
        return self.known[word]

    def read(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers of all sentences in one array, words per sentence)."""
        if len(self.known) > 500_000:
            self.clear()
        flat: list[int] = []
        sizes = np.zeros(len(parts), np.int64)
        first, later = self.first.__getitem__, self.later.__getitem__
        for k, s in enumerate(parts):
            raw = _WORD.findall(s)
            flat.append(first(raw[0]))
            flat += map(later, raw[1:])
            sizes[k] = len(raw)
        return np.array(flat, np.int64), sizes


    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, number of features, sums) of all words, made anew when words have come in."""
        if self.tables[0] != len(self.codes):
            sums = np.stack(self.sums) if self.sums else np.zeros((0, len(LEVELS)))
            self.tables = (len(self.codes), np.array(self.codes, np.uint64), np.fromiter(map(len, self.features), np.int64, len(self.features)), sums)
        return self.tables[1:]


class _Memo(dict):
    def __init__(self, lexicon: Lexicon, later: bool):
        self.lexicon, self.later = lexicon, later

    def __missing__(self, raw: str) -> int:
        value = self[raw] = self.lexicon.number(raw, self.later)
        return value


_LENGTHS = np.array([_number(f"={n}") for n in range(13)], np.int64)


def _pairs(lexicon: Lexicon, flat: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of neighbouring words, their sentences)."""
    codes = lexicon.arrays()[0][flat]
    inside = owner[1:] == owner[:-1]
    return _mixed(codes[:-1][inside] * np.uint64(0x9E3779B97F4A7C15) + codes[1:][inside]), owner[1:][inside]


def features(parts: list[str], lexicon: Lexicon) -> list[np.ndarray]:
    """Feature numbers of each sentence: words, their trigrams, word pairs and the sentence's length class."""
    if not parts:
        return []
    flat, sizes = lexicon.read(parts)
    owner = np.repeat(np.arange(len(parts)), sizes)
    pairs, of = _pairs(lexicon, flat, owner)
    words = np.split(flat, np.cumsum(sizes)[:-1])
    joined = np.split(pairs, np.searchsorted(of, np.arange(1, len(parts))))
    return [np.concatenate([*(lexicon.features[i] for i in w), p, _LENGTHS[[min(12, n // 4)]]]) for w, p, n in zip(words, joined, sizes.tolist())]


def sentences(text: str) -> list[str]:
    """Sentences of a text; line breaks end sentences, so texts without stops have one per line."""
    return [s for s in _SENTENCE.split(fold(text)) if _WORD.search(s)]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


class Model:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, calibration: np.ndarray):
        self.weights, self.bias, self.calibration = weights, bias, calibration
        self.lexicon = Lexicon(weights)

    def __getstate__(self):
        return (self.weights, self.bias, self.calibration)

    def __setstate__(self, state):
        self.__init__(*state)

    def sentence_levels(self, parts: list[str]) -> np.ndarray:
        """Distribution over the levels of each sentence, all of them at once."""
        flat, sizes = self.lexicon.read(parts)
        owner = np.repeat(np.arange(len(parts)), sizes)
        pairs, of = _pairs(self.lexicon, flat, owner)
        length = _LENGTHS[np.minimum(12, sizes // 4)]
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        # Sums of a word's features are kept with the word; only pairs are looked up one by one.
        _, sizes_of, sums = self.lexicon.arrays()
        n = np.add.reduceat(sizes_of[flat], begin) + np.bincount(of, minlength=len(parts)) + 1
        z = np.add.reduceat(sums[flat], begin, axis=0) + self.weights[length]
        held = np.concatenate([np.zeros((1, len(LEVELS))), np.cumsum(self.weights[pairs], axis=0, dtype=np.float64)])
        cut = np.searchsorted(of, np.arange(len(parts) + 1))
        z = z + held[cut[1:]] - held[cut[:-1]]
        return _softmax(z / np.sqrt(n)[:, None] + self.bias)

    def documents(self, texts: list[str]) -> list[tuple[np.ndarray, int] | None]:
        """(calibrated distribution over the levels, number of sentences) of each text, None for one without words."""
        parts = [sentences(t) for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        out: list = [None] * len(texts)
        held = np.nonzero(sizes)[0]
        if len(held):
            each = self.sentence_levels([s for p in parts for s in p])
            begin = np.concatenate([[0], np.cumsum(sizes[held])[:-1]])
            mean = np.add.reduceat(each, begin, axis=0) / sizes[held][:, None]
            p = _softmax(np.hstack([mean, np.ones((len(held), 1))]) @ self.calibration)
            for k, row in zip(held, p):
                out[k] = (row, int(sizes[k]))
        return out


def _fit(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, steps: int, l2: float) -> tuple[np.ndarray, np.ndarray]:
    flat = np.concatenate(rows)
    lengths = np.array([len(r) for r in rows])
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    scale = (1 / np.sqrt(lengths))[:, None]
    used, flat = np.unique(flat, return_inverse=True)
    k = len(LEVELS)
    w, b = np.zeros((len(used), k)), np.zeros(k)
    m, v = np.zeros_like(w), np.zeros_like(w)
    target = np.eye(k)[y]
    order = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(len(rows)), lengths)[order]
    cut = np.searchsorted(flat[order], np.arange(len(used)))
    for t in range(1, steps + 1):
        z = np.add.reduceat(w[flat], start, axis=0) * scale + b
        g = (_softmax(z) - target) * weight[:, None]
        grad = np.add.reduceat((g * scale)[owner], cut, axis=0) + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= 2.0 * g.sum(axis=0)
    full = np.zeros((1 << BITS, k), np.float32)
    full[used] = w
    return full, b.astype(np.float32)


def train(labelled: list[tuple[str, int]], steps: int = 50, l2: float = 1e-5) -> Model:
    """Model from (text, level number) pairs: two thirds fit the sentences, one third the calibration."""
    lexicon = Lexicon()
    first = [x for k, x in enumerate(labelled) if k % 3]
    rows, y, weight = [], [], []
    for text, level in first:
        parts = sentences(text)
        rows += features(parts, lexicon)
        y += [level] * len(parts)
        weight += [1 / max(1, len(parts))] * len(parts)
    if not rows:
        return Model(np.zeros((1 << BITS, len(LEVELS)), np.float32), np.zeros(len(LEVELS), np.float32), np.zeros((len(LEVELS) + 1, len(LEVELS))))
    weights, bias = _fit(rows, np.array(y), np.array(weight) / sum(weight), steps, l2)
    model = Model(weights, bias, np.zeros((len(LEVELS) + 1, len(LEVELS))))
    means, target = [], []
    for text, level in [x for k, x in enumerate(labelled) if not k % 3]:
        parts = sentences(text)
        if parts:
            means.append(np.append(model.sentence_levels(parts).mean(axis=0), 1.0))
            target.append(level)
    if means:
        a, t = np.stack(means), np.eye(len(LEVELS))[target]
        for _ in range(400):
            g = a.T @ (_softmax(a @ model.calibration) - t) / len(a)
            model.calibration -= 8.0 * (g + 1e-5 * model.calibration)
    return model


_TRAINED: dict[int, Model] = {}


def trained(labelled: list[tuple[str, int]]) -> Model:
    """`train`, once in a session for the same rows."""
    key = xxhash.xxh3_64_intdigest("\x00".join(f"{level}{text}" for text, level in labelled))
    if key not in _TRAINED:
        _TRAINED.clear()
        _TRAINED[key] = train(labelled)
    return _TRAINED[key]


def level_of(column: str):
    """Number of a stored label, its case and spaces ignored; null for anything else."""
    clean = F.upper(F.regexp_replace(F.col(column), r"[\s ​]+", ""))
    return F.when(clean.isin(*LEVELS), F.array_position(F.array(*map(F.lit, LEVELS)), clean) - 1).cast("int")


def sample(versions: DataFrame, text: str, label: str, bound: int) -> list[tuple[str, int]]:
    """At most `bound` labelled rows, chosen by the hash of their text."""
    rows = versions.select(F.col(f"`{text}`").alias("t"), level_of(label).alias("y")).filter("length(t) > 0 and y is not null")
    return [(r["t"], r["y"]) for r in by_hash(rows, "t", bound)]


def levels(versions: DataFrame, key: str = "id", text: str = "simplified_text", label: str = "cefr_level", bound: int = 1500, model: Model | None = None) -> DataFrame:
    """(row_id, stored, level, difficulty, confidence, n_sentences) of every text.

    level: the most likely level's number; difficulty: the expected level number; stored: the number of the stored
    label, null where it is none of the levels. Null and empty texts, and texts without words, have no row. `bound`
    limits the labelled rows that training reads.
    """
    model = model or trained(sample(versions, text, label, bound))
    shared = versions.sparkSession.sparkContext.broadcast(model)
    rows = versions.select(F.col(f"`{key}`").cast("bigint").alias("row_id"), level_of(label).alias("stored"), F.col(f"`{text}`").alias("text")).filter("text <> ''")

    def run(batches: Iterator[tuple[list, ...]]) -> Iterator[list[tuple]]:
        for ids, stored, texts in batches:
            for lo in range(0, len(ids), 500):
                part = slice(lo, lo + 500)
                scored = zip(ids[part], stored[part], shared.value.documents(texts[part]))
                yield [(row_id, label_no, int(d[0].argmax()), float(d[0] @ np.arange(len(LEVELS))), float(d[0].max()), d[1]) for row_id, label_no, d in scored if d is not None]

    return over_batches(rows, run, "row_id bigint, stored int, level int, difficulty double, confidence double, n_sentences int")


def misfits(scored: DataFrame, steps: int = 2) -> DataFrame:
    """Rows whose level lies `steps` or more from the stored one, both by the likeliest and the expected level."""
    return scored.filter((F.abs(F.col("level") - F.col("stored")) >= steps) & (F.abs(F.col("difficulty") - F.col("stored")) >= steps - 1))
