"""Abusive, hateful or sexual content (problem 10): a character n-gram linear classifier with naive Bayes scaling.

Spelling tricks are undone by the form that is scored: base letters a to z only (marks, spaces, signs and separators
gone, signs and figures inside words read as the letters they stand for, repeated letters once). Character n-grams of
that form are hashed, and beside them words and pairs of words with their marks. Each feature is scaled by its naive
Bayes log-count ratio and a regularised logistic model is trained per category on windows of labelled sentences (as they
are, without marks, taken apart by signs); a bounded sample of the corpus adds neutral text, and windows of which a first
model is sure.
Every window of every document is scored; a document's score is its highest window's.
"""

from __future__ import annotations

import itertools
import random
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import offence_texts as labelled
from ._arrow import over_batches
from ._sample import by_hash
from .charform import fold

CATEGORIES = ("abuse", "hate", "sexual")
BITS, ORDERS = 18, (3, 4, 5, 6)
#: Number that has no weight; n-grams lie in the lower half of the numbers below it, words and pairs of words in the upper.
NONE = 2 << BITS
#: Letters of a scored window, and the step between windows.
WINDOW, STEP, TRAINING_STEP, CORPUS_STEP = 28, 4, 7, 21
#: Logits from which an unlabelled window joins a category in the next round, and up to which it stays neutral.
SURE, DOUBT = 1.0, -1.0
#: Least score of a document in each category. The best of many windows counts, so neutral documents lie near their worst words.
THRESHOLDS = {"abuse": 0.5, "hate": 0.4, "sexual": 0.45}
_LEET = {"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}


#: End of the planes that hold letters in another dress.
MOST_POINT = 0x20000
_FRAMED = re.compile("(?:CIRCLED|SQUARED|PARENTHESIZED|TORTOISE SHELL BRACKETED) (?:ITALIC )?LATIN (?:CAPITAL|SMALL) LETTER ([A-Z])$")


def _table() -> np.ndarray:
    """Code point -> 1..26 for letters with that base letter, 32 + letter for signs and figures that may stand for one.

    From U+2000 on, letters by their compatibility form, and circled, squared and bracketed ones by their name.
    """
    table = np.zeros(MOST_POINT, np.uint8)
    for cp in range(0x2000, MOST_POINT):
        framed = _FRAMED.search(unicodedata.name(chr(cp), ""))
        form = framed[1].lower() if framed else unicodedata.normalize("NFKC", chr(cp))
        base = unicodedata.normalize("NFD", form.lower())[:1] if len(form) == 1 else ""
        if "a" <= base <= "z":
            table[cp] = ord(base) - 96
    for cp in range(0x2000):
        base = unicodedata.normalize("NFD", chr(cp).lower())[:1]
        base = "d" if chr(cp) in "đĐ" else base
        if "a" <= base <= "z":
            table[cp] = ord(base) - 96
        elif chr(cp) in _LEET:
            table[cp] = 32 + ord(_LEET[chr(cp)]) - 96
    return table


_LETTERS = _table()
#: Code point -> code point of the small letter with its marks; letters in another dress and signs: the letter they stand for.
_SIGNS = np.array([ord(chr(cp).lower()[0]) if cp < 0x2000 and 0 < v < 32 else 96 + (v & 31) for cp, v in enumerate(_LETTERS.tolist())], np.uint32)
_POWERS = np.cumprod(np.full(256, 0x9E3779B1, np.uint64))
_SENTENCE = re.compile(r"(?<=[.!?…”])\s+|\n+")


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letter codes of all folded texts in one array, owner of each letter, numbers of the word and of the pair that end there).

    Words keep their marks, which the letters do not: both readings are scored.
    """
    joined = "\n".join(t.replace("\n", " ") for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    codes = _LETTERS[np.where(points < MOST_POINT, points, 0)]
    plain = (codes > 0) & (codes < 32)
    beside = np.zeros(len(codes), bool)
    beside[1:] |= plain[:-1]
    beside[:-1] |= plain[1:]
    # Signs beside letters stand for letters, and then their neighbours among the signs do.
    leet = codes > 32
    reads = leet & beside
    for _ in range(3):
        spread = np.zeros(len(codes), bool)
        spread[1:] |= reads[:-1]
        spread[:-1] |= reads[1:]
        reads |= leet & spread
    keep = plain | reads
    owner = np.cumsum(points == 10)
    at = np.nonzero(keep)[0]
    codes, owner = (codes & 31)[at], owner[at]
    if not len(codes):
        return codes, owner, np.zeros((0, 2), np.int64)
    fresh = np.ones(len(codes), bool)
    fresh[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    word = np.cumsum(np.diff(at, prepend=at[0]) > 1)
    signs = _SIGNS[np.where(points < MOST_POINT, points, 0)[at]]
    # A word keeps a first letter that ends the word before; its other letters are fresh in both readings.
    own = fresh.copy()
    own[1:] |= word[1:] != word[:-1]
    words = np.full((len(codes), 2), NONE, np.int64)
    words[own] = _words(signs[own], word[own], owner[own])
    return codes[fresh], owner[fresh], words[fresh]


def _words(signs: np.ndarray, word: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashed word of two letters or more, and hashed pair with the word before it in the same text, at the last letter of each."""
    out = np.full((len(signs), 2), NONE, np.int64)
    starts = np.concatenate([[0], np.nonzero(np.diff(word))[0] + 1])
    sizes = np.diff(starts, append=len(signs))
    place = np.minimum(np.arange(len(signs)) - np.repeat(starts, sizes), len(_POWERS) - 1)
    h = np.add.reduceat(signs.astype(np.uint64) * _POWERS[place], starts)[sizes > 1]
    ends = (starts + sizes - 1)[sizes > 1]
    spread = lambda x: (1 << BITS) + ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
    out[ends, 0] = spread(h)
    joint = owner[ends[1:]] == owner[ends[:-1]]
    out[ends[1:][joint], 1] = spread(h[1:] * np.uint64(31) + h[:-1] * np.uint64(0x85EBCA6B) + np.uint64(1))[joint]
    return out


def _features(codes: np.ndarray) -> list[np.ndarray]:
    """Hashed n-grams that begin at each letter, one array per order (shorter at the end by the order)."""
    out, h = [], codes.astype(np.uint64)
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint64(29) + codes[n - 1 :]
        if n in ORDERS:
            mixed = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            out.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
    return out


def _windows(text: str, step: int = TRAINING_STEP) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows of one text for training: letters, and numbers of the words that end among them."""
    codes, _, words = letters([text])
    if len(codes) < max(ORDERS) + 1:
        return []
    return [(codes[i : i + WINDOW], words[i : i + WINDOW]) for i in range(0, max(1, len(codes) - WINDOW + step), step)]


def _bare(text: str) -> str:
    """The text without marks."""
    return "".join(c for c in unicodedata.normalize("NFD", text.replace("đ", "d").replace("Đ", "D")) if not unicodedata.combining(c))


def _examples(sample: list[str], seed: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int], int]:
    """(windows, category or -1, number of windows from labelled text)."""
    rng = random.Random(seed)
    fill = lambda s: s.replace("{i}", rng.choice(labelled.INSULTS)).replace("{g}", rng.choice(labelled.GROUPS)).replace("{x}", rng.choice(labelled.NAMES))
    windows, marks, turns = [], [], itertools.count()

    def add(text: str, mark: int) -> None:
        """In turn as it is, without marks, and with its words taken apart by signs."""
        text = fold(text)
        ways = [text, text, _bare(text), ".".join(text)]
        for w in _windows(ways[next(turns) % len(ways)]):
            windows.append(w)
            marks.append(mark)

    for mark, texts in enumerate((labelled.ABUSE, labelled.HATE, labelled.SEXUAL)):
        for text in texts:
            for _ in range(24 if "{" in text else 6):
                add(fill(fill(text)), mark)
    for text in labelled.INSULTS:
        for _ in range(4):
            add(f"{text} {text}", 0)
    for text in labelled.NEUTRAL:
        for _ in range(12 if "{" in text else 6):
            add(fill(text), -1)
    own = len(windows)
    for text in sample:
        for sentence in _SENTENCE.split(fold(text)):
            found = _windows(_bare(sentence) if next(turns) % 6 == 0 else sentence, CORPUS_STEP)
            windows += found
            marks += [-1] * len(found)
    return windows, marks, own


def _matrix(windows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Feature numbers of each window, padded with a number that has no weight."""
    rows = [np.unique(np.concatenate([*_features(codes), words[words < NONE]])) for codes, words in windows]
    out = np.full((len(rows), max(map(len, rows))), NONE, np.int32)
    for k, f in enumerate(rows):
        out[k, : len(f)] = f
    return out


class Model:
    """Weights per feature and category, already multiplied by the log-count ratios, and the intercepts."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias

    def score(self, texts: list[str]) -> np.ndarray:
        """Highest window probability of each text and category; windows stay within a sentence. 0 without letters."""
        pieces, of = [], []
        for k, text in enumerate(texts):
            parts = [p for p in _SENTENCE.split(fold(text)) if p]
            pieces += parts
            of += [k] * len(parts)
        best = np.full((len(texts), len(CATEGORIES)), -50.0, np.float32)
        codes, owner, words = letters(pieces)
        if not len(codes):
            return np.zeros_like(best)
        total = np.zeros((len(codes), len(CATEGORIES)), np.float32)
        for n, feature in zip(ORDERS, _features(codes)):
            inside = owner[: len(feature)] == owner[n - 1 :]
            total[n - 1 :][inside] += self.weights[feature[inside]]
        for feature in words.T:
            there = np.nonzero(feature < NONE)[0]
            total[there] += self.weights[feature[there]]
        run = np.concatenate([np.zeros((1, len(CATEGORIES))), np.cumsum(total, axis=0, dtype=np.float64)])
        bounds = np.searchsorted(owner, np.arange(len(pieces) + 1))
        first, end = bounds[:-1], bounds[1:]
        windows = np.where(end > first, np.maximum(0, -(-(end - first - WINDOW) // STEP)) + 1, 0)
        whose = np.repeat(np.arange(len(pieces)), windows)
        rank = np.arange(len(whose)) - np.repeat(np.cumsum(windows) - windows, windows)
        starts = first[whose] + rank * STEP
        sums = (run[np.minimum(starts + WINDOW, end[whose])] - run[np.minimum(starts + ORDERS[0] - 1, end[whose])]).astype(np.float32) + self.bias
        np.maximum.at(best, np.array(of)[whose], sums)
        return 1 / (1 + np.exp(-np.clip(best, -30, 30)))


def train(sample: list[str], seed: int = 10, rounds: int = 2, steps: int = 50, l2: float = 1e-4, smoothing: float = 0.5, share: int = 15, hard: int = 8_000) -> Model:
    """Model from the labelled sentences and a sample of the corpus.

    The sample has no labels. Of its windows one in `share` stands as neutral text for a first model. Windows of which a
    model is sure join their category in the next one; so the model learns how the corpus itself words what the labelled
    sentences say. Doubtful ones are left out; of the others the `hard` ones with the highest scores join the neutral share.
    """
    windows, marks, own = _examples(sample, seed)
    x, marks = _matrix(windows), np.array(marks)
    shared = np.zeros(len(windows), bool)
    shared[:own] = True
    shared[own:] = np.random.default_rng(seed).integers(share, size=len(windows) - own) == 0
    model = _model(x[shared], marks[shared], steps, l2, smoothing)
    for _ in range(rounds - 1):
        scores = model.weights[x[own:]].sum(axis=1) + model.bias
        best = scores.max(axis=1, initial=-1e9)
        kept, now = shared.copy(), marks.copy()
        kept[own:] &= best < DOUBT
        plain = np.nonzero(best < DOUBT)[0]
        kept[own + plain[np.argsort(-best[plain], kind="stable")[:hard]]] = True
        sure = np.nonzero(best >= SURE)[0] + own
        kept[sure], now[sure] = True, scores[sure - own].argmax(axis=1)
        model = _model(x[kept], now[kept], steps, l2, smoothing)
    return model


def _model(rows: np.ndarray, labels: np.ndarray, steps: int, l2: float, smoothing: float) -> Model:
    """L2-regularised logistic regression per category on binary features scaled by their log-count ratios.

    All categories are fitted side by side, both classes of each weighing the same; Adam.
    """
    used, flat = np.unique(rows.ravel(), return_inverse=True)
    n, width = rows.shape
    pad = used == NONE
    order = np.argsort(flat, kind="stable")
    owner, cuts = order // width, np.searchsorted(flat[order], np.arange(len(used)))
    y = (labels[:, None] == np.arange(len(CATEGORIES))).astype(np.float32)
    p = np.add.reduceat(y[owner], cuts, axis=0) + smoothing
    q = np.add.reduceat(1 - y[owner], cuts, axis=0) + smoothing
    ratio = np.log((p / p.sum(axis=0)) / (q / q.sum(axis=0))).astype(np.float32)
    ratio[pad] = 0
    cost = np.where(y > 0, 0.5 / np.maximum(1, y.sum(axis=0)), 0.5 / np.maximum(1, (1 - y).sum(axis=0))).astype(np.float32)
    scale = np.float32(1 / np.sqrt(width))
    w, b = np.zeros_like(ratio), np.zeros(len(CATEGORIES), np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        z = (w * ratio)[flat].reshape(n, width, -1).sum(axis=1) * scale + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * cost
        grad = np.add.reduceat(g[owner], cuts, axis=0) * ratio * scale + np.float32(l2) * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * g.sum(axis=0), 0.999 * vb + 0.001 * g.sum(axis=0) ** 2
        rate = 0.1 / (1 - 0.9**t)
        w = w - rate * m / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b = b - rate * mb / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros((NONE + 1, len(CATEGORIES)), np.float32)
    weights[used] = w * ratio * scale
    return Model(weights, b.astype(np.float32))


def corpus_sample(documents: DataFrame, text: str, bound: int = 1500) -> list[str]:
    """At most `bound` whole documents, chosen by the hash of their text; training only."""
    rows = documents.select(F.col(f"`{text}`").alias("t")).filter("length(t) > 40")
    return [r["t"] for r in by_hash(rows, "t", bound)]


_TRAINED: dict[int, Model] = {}


def trained(sample: list[str]) -> Model:
    """`train`, once in a session for the same sample."""
    key = hash(tuple(sample))
    if key not in _TRAINED:
        _TRAINED.clear()
        _TRAINED[key] = train(sample)
    return _TRAINED[key]


def scores(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", model: Model | None = None, sample: int = 1500) -> DataFrame:
    """(doc_id, source, abuse, hate, sexual): the score of every document in every category.

    Null and empty texts, and texts without letters, score 0. `sample` bounds the documents that training reads
    without labels; all documents are scored, each over its whole text.
    """
    model = model or trained(corpus_sample(documents, text, sample))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[tuple[list, ...]]) -> Iterator[list[tuple]]:
        for ids, sources, texts in batches:
            for lo in range(0, len(ids), 400):
                part = slice(lo, lo + 400)
                s = shared.value.score(texts[part])
                yield [(i, name, *map(float, row)) for i, name, row in zip(ids[part], sources[part], s)]

    return over_batches(rows, run, "doc_id bigint, source string, abuse double, hate double, sexual double")


def found(scored: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """(doc_id, category, score): one row per category that a document reaches."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("score"), F.lit(t).alias("least")) for c, t in thresholds.items())))
    return scored.select("doc_id", each.alias("c")).select("doc_id", "c.*").filter("score >= least").drop("least")


def rates(scored: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """(source, n_docs, abuse, hate, sexual, flagged): documents per source, and how many reach each category."""
    reached = {c: F.col(c) >= t for c, t in thresholds.items()}
    any_hit = F.sum(F.greatest(*(r.cast("int") for r in reached.values()))).alias("flagged")
    return scored.groupBy("source").agg(F.count("*").alias("n_docs"), *(F.sum(r.cast("int")).alias(c) for c, r in reached.items()), any_hit)
