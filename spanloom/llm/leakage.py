"""Evaluation passages inside training text (problem 8): latent semantic retrieval, then alignment.

Passages are TF-IDF vectors over runs of three words, weighted by how many documents of the whole corpus hold a run. A
distributed randomised SVD of the passages gives the latent space; overlapping windows of every document are projected
into it, and (window, item) pairs above a cosine are candidates. Runs of 13 words of a passage are candidates by themselves,
whatever their weight: they are looked up by hash. Candidates are aligned: a run of consecutive words, the
longest common subsequence, and whether the reference answer stands near. Held-out sets are bounded, so their vocabulary
and projection travel with the tasks after a check of their size; documents never leave their rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..runtime import bounded, stage
from ._arrow import over_batches
from .charform import fold
from .neardup import shingles

_WORD = re.compile(r"[^\W_]+")
#: Words of a window and step between windows: every run of 13 words lies whole in some window.
WINDOW, STEP, RUN = 26, 13, 13
#: Most held-out items and distinct terms that may travel with the tasks.
MOST_ITEMS, MOST_TERMS = 20_000, 2_000_000
#: Terms whose sums travel together in a product with the matrix.
BLOCK = 256
#: Parts over which the rows of the matrix are spread.
MATRIX_PARTS = 4


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words(text: str) -> list[str]:
    """Words by which texts are compared: folded form, lower case, no punctuation or symbols."""
    return _WORD.findall(fold(text).lower())


def _codes(found: list[str], memo: dict) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))


class Vocabulary:
    """Terms of the held-out passages: sorted hashes, found by a filter table and binary search."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.table = np.zeros(1 << 22, bool)
        self.table[(terms >> np.uint64(42)).astype(np.int64)] = True

    def find(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known terms and their numbers."""
        maybe = np.nonzero(self.table[(runs >> np.uint64(42)).astype(np.int64)])[0]
        if not len(maybe):
            return maybe, maybe
        at = np.minimum(np.searchsorted(self.terms, runs[maybe]), len(self.terms) - 1)
        ok = self.terms[at] == runs[maybe]
        return maybe[ok], at[ok]


class Verbatim:
    """Runs of RUN words of the held-out passages, with the passages (by number) that hold each."""

    def __init__(self, passages: list[np.ndarray]):
        runs = [np.unique(shingles(p, RUN)) if len(p) >= RUN else p[:0] for p in passages]
        every = np.concatenate(runs)
        order = np.argsort(every, kind="stable")
        self.runs, self.owners = every[order], np.repeat(np.arange(len(runs)), [len(r) for r in runs])[order]

    def find(self, codes: np.ndarray, at: np.ndarray) -> list[int]:
        """Numbers of the passages with a run in a document; at: positions of the known runs of three in it, ascending."""
        inner = RUN - 3
        starts = at[:-inner][at[inner:] - at[:-inner] == inner]
        if not len(starts):
            return []
        met = np.unique(shingles(codes, RUN)[starts])
        low, high = np.searchsorted(self.runs, met), np.searchsorted(self.runs, met, "right")
        return sorted({int(x) for a, b in zip(low, high) for x in self.owners[a:b]})


def randomised_svd(rows: DataFrame, n_terms: int, rank: int, oversample: int = 8, power: int = 1, seed: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(V, singular values) of the sparse matrix whose rows are `rows` (terms array<int>, weights array<double>).

    Range finder with `power` iterations. Every product with the matrix is made where its rows are; what meets on the
    driver is the Gram matrix of the range (rank + oversample squared) and the right factor (terms by rank), both bounded
    by the parameters and not by the number of rows.
    """
    width = rank + oversample
    omega = np.random.default_rng(seed).standard_normal((n_terms, width)).astype(np.float32)

    def product(right: np.ndarray, back: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Gram of Y = A right, and A' Y back (back: the range's orthogonaliser)."""

        def run(batches: Iterator[tuple[list, ...]]) -> Iterator[list[tuple]]:
            gram = np.zeros((width, width))
            sums: dict[int, np.ndarray] = {}
            for terms, weights in batches:
                for t, w in zip(terms, weights):
                    t, w = np.asarray(t, np.int64), np.asarray(w, np.float64)
                    y = w @ right[t]
                    gram += np.outer(y, y)
                    q = (y if back is None else y @ back).astype(np.float32)
                    # Terms of a row are distinct and ascending, so each block takes one slice of them.
                    cuts = np.searchsorted(t, np.arange(t[0] // BLOCK, t[-1] // BLOCK + 2) * BLOCK) if len(t) else ()
                    for lo, hi in zip(cuts[:-1], cuts[1:]):
                        if hi > lo:
                            block = int(t[lo] // BLOCK)
                            if block not in sums:
                                sums[block] = np.zeros((BLOCK, width), np.float32)
                            sums[block][t[lo:hi] - block * BLOCK] += w[lo:hi, None].astype(np.float32) * q
            yield [(-1, gram.tobytes()), *((k, v.tobytes()) for k, v in sums.items())]

        def add(group: pd.DataFrame) -> pd.DataFrame:
            kind = np.float64 if group["block"].iloc[0] < 0 else np.float32
            total = sum(np.frombuffer(x, kind) for x in group["part"])
            return pd.DataFrame({"block": [group["block"].iloc[0]], "part": [total.tobytes()]})

        parts = over_batches(rows.select("terms", "weights"), run, "block int, part binary").groupBy("block").applyInPandas(add, "block int, part binary")
        gram, out = np.zeros((width, width)), np.zeros((n_terms, width))
        for r in bounded(parts, MOST_TERMS // BLOCK + 2):
            if r["block"] < 0:
                gram = np.frombuffer(r["part"]).reshape(width, width)
            else:
                at = r["block"] * BLOCK
                out[at : at + BLOCK] = np.frombuffer(r["part"], np.float32).reshape(BLOCK, width)[: n_terms - at]
        return gram, out

    right = omega.astype(np.float64)
    for _ in range(power):
        _, right = product(right, None)
        right, _ = np.linalg.qr(right)
    gram, _ = product(right, None)
    values, vectors = np.linalg.eigh(gram)
    kept = values > values.max() * 1e-10 if values.max() > 0 else values > 0
    back = np.zeros((width, width))
    back[:, : kept.sum()] = vectors[:, kept] / np.sqrt(values[kept])
    _, factor = product(right, back)
    left, s, _ = np.linalg.svd(factor, full_matrices=False)
    order = s > s.max(initial=0) * 1e-7
    return left[:, order][:, :rank].astype(np.float32), s[order][:rank]


def _passages(items: DataFrame, key: str, passage: str, answer: str) -> list[tuple[int, list[str], list[str]]]:
    rows = bounded(items.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{passage}`").alias("p"), F.col(f"`{answer}`").alias("a")).filter("p <> ''"), MOST_ITEMS)
    return [(r["k"], words(r["p"]), words(r["a"] or "")) for r in sorted(rows, key=lambda r: r["k"])]


def _longest_run(doc: np.ndarray, item: np.ndarray, least: int) -> int:
    """Length of the longest run of consecutive words in both, 0 below `least`."""
    if len(doc) < least or len(item) < least:
        return 0
    common = np.isin(shingles(doc, least), shingles(item, least))
    if not common.any():
        return 0
    best, here = 0, 0
    for x in common:
        here = here + 1 if x else 0
        best = max(best, here)
    return best + least - 1


def _subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        step = np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0))
        row[1:] = np.maximum.accumulate(step)
    return int(row[-1])


def leaks(
    documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", passage: str = "passage", answer: str = "reference_answer",
    rank: int = 96, cosine: float = 0.1, reworded: float = 0.25, paraphrase: float = 0.6,
) -> DataFrame:
    """(doc_id, item_id, cosine, run, share, answered): documents that hold an item's passage, wholly, partly or reworded.

    cosine: of the best window, 0 where none reaches `cosine` (only verbatim runs come without it);
    run: longest run of consecutive words of the passage in the document, 0 if under 13; share: longest common
    subsequence of the passage and its best span over the passage's words (sought where the cosine reaches `reworded`; else
    run over the passage's words). `rank` bounds the latent space; with more passages than that, TF-IDF cosines stand beside
    the latent ones, so no pair is lost by it. answered: the reference answer's words
    stand in the document. A row needs run >= 13 or share >= `paraphrase`. Null and empty texts and passages have no
    row; copies of a document are rows of their own.
    """
    held = _passages(items, item_key, passage, answer)
    schema = "doc_id bigint, item_id bigint, cosine double, run int, share double, answered boolean"
    spark = documents.sparkSession
    memo = _Hashes()
    codes_of = [_codes(p, memo) for _, p, _ in held]
    runs_of = [shingles(c, 3) for c in codes_of]
    if not held or not sum(map(len, runs_of)):
        return spark.createDataFrame([], schema)
    terms = np.unique(np.concatenate(runs_of))
    if len(terms) > MOST_TERMS:
        raise ValueError(f"{len(terms)} terms of held-out passages; at most {MOST_TERMS} may travel with the tasks")
    vocabulary = spark.sparkContext.broadcast((Vocabulary(terms), Verbatim(codes_of)))
    docs = documents.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).filter("text <> ''")

    def locate(batches: Iterator[tuple[list, ...]]) -> Iterator[list[tuple]]:
        (known, verbatim), cache = vocabulary.value, _Hashes()
        for ids, texts in batches:
            out = []
            for doc_id, t in zip(ids, texts):
                codes = _codes(words(t), cache)
                at, which = known.find(shingles(codes, 3))
                out.append((doc_id, len(codes), at.tolist(), which.tolist(), verbatim.find(codes, at)))
            yield out

    located = stage(over_batches(docs, locate, "doc_id bigint, n_words int, at array<int>, term array<int>, whole array<int>"), "located")
    n_docs = located.count()
    found = located.select(F.explode(F.array_distinct("term")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = np.full(len(terms), np.log(1.0 + n_docs))
    for r in bounded(found, MOST_TERMS):
        idf[r["term"]] = np.log(1.0 + n_docs / (1.0 + r["df"]))

    rows = []
    for (item, _, _), runs in zip(held, runs_of):
        which, n = np.unique(np.searchsorted(terms, runs), return_counts=True)
        weights = n * idf[which]
        norm = float(np.linalg.norm(weights)) or 1.0
        rows.append((item, which.tolist(), (weights / norm).tolist()))
    matrix = spark.createDataFrame(rows, "item_id bigint, terms array<int>, weights array<double>").repartition(MATRIX_PARTS, "item_id")
    latent, _ = randomised_svd(matrix, len(terms), min(rank, len(rows)))
    points = np.stack([np.asarray(w, np.float32) @ latent[t] if t else np.zeros(latent.shape[1], np.float32) for _, t, w in rows])
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
    # A latent space smaller than the passages loses part of the cosines; then the weights themselves give them.
    postings = None
    if latent.shape[1] < len(rows):
        sizes = np.array([len(t) for _, t, _ in rows])
        flat = np.fromiter((x for _, t, _ in rows for x in t), np.int64, sizes.sum())
        heavy = np.fromiter((x for _, _, w in rows for x in w), np.float32, sizes.sum())
        order = np.argsort(flat, kind="stable")
        ends = np.searchsorted(flat[order], np.arange(len(terms) + 1))
        postings = (ends, np.repeat(np.arange(len(rows), dtype=np.int32), sizes)[order], (heavy * idf[flat])[order].astype(np.float32))
    exact = spark.sparkContext.broadcast(postings)
    model = spark.sparkContext.broadcast(((latent * idf[:, None]).astype(np.float32), points.T.copy(), np.array([i for i, _, _ in rows]), idf**2, float(np.log(1.0 + n_docs)) ** 2))

    def near(sizes: list, ats: list, hits: list) -> Iterator[tuple[tuple[int, int], float]]:
        """((document, passage), cosine) by number, of the windows of some documents that reach the cosine."""
        weighted, across, _, squares, unknown = model.value
        n_words = np.array(sizes, np.int64)
        counts = [len(x) for x in ats]
        doc = np.repeat(np.arange(len(counts)), counts)
        at = np.fromiter((x for xs in ats for x in xs), np.int64, sum(counts))
        hit = np.fromiter((x for xs in hits for x in xs), np.int64, sum(counts))
        # A run at position p lies in the windows that begin at the last two steps up to p.
        window = np.concatenate([at // STEP, at // STEP - 1])
        keep = (window >= 0) & (np.concatenate([at, at]) + 3 <= window * STEP + WINDOW)
        slot = (np.concatenate([doc, doc])[keep] << 32) | window[keep]
        which = np.concatenate([hit, hit])[keep]
        if not len(slot):
            return
        order = np.argsort(slot, kind="stable")
        slot, which = slot[order], which[order]
        first = np.nonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))[0]
        owner, start = slot[first] >> 32, slot[first] & 0xFFFFFFFF
        # The window's own length: its known terms, and the rest as runs that no document but it holds.
        inside = np.add.reduceat(squares[which], first)
        held_terms = np.diff(np.append(first, len(slot)))
        rest = np.maximum(np.minimum(WINDOW, n_words[owner] - start * STEP) - 2 - held_terms, 0) * unknown
        # No cosine exceeds the known part's share of the window's length.
        able = np.nonzero(inside >= cosine**2 * (inside + rest))[0]
        if not len(able):
            return
        chosen = np.repeat(np.isin(np.arange(len(first)), able), held_terms)
        sums = np.add.reduceat(weighted[which[chosen]], np.concatenate([[0], np.cumsum(held_terms[able])[:-1]]), axis=0)
        lengths = np.sqrt(np.maximum((inside + rest)[able], 1e-9))
        scores = (sums / lengths[:, None].astype(np.float32)) @ across
        if exact.value is not None:
            ends, columns, products = exact.value
            for k, w in enumerate(able):
                spans = [slice(ends[t], ends[t + 1]) for t in which[first[w] : first[w] + held_terms[w]]]
                dots = np.bincount(np.concatenate([columns[x] for x in spans]), np.concatenate([products[x] for x in spans]), across.shape[1])
                scores[k] = np.maximum(scores[k], dots / lengths[k])
        row, column = np.nonzero(scores >= cosine)
        for r, c in zip(row.tolist(), column.tolist()):
            yield (int(owner[able[r]]), c), float(scores[r, c])

    def search(batches: Iterator[tuple[list, ...]]) -> Iterator[list[tuple]]:
        for ids, sizes, ats, hits, wholes in batches:
            for lo in range(0, len(ids), 500):
                part = slice(lo, lo + 500)
                best = {(d, c): 0.0 for d, found in enumerate(wholes[part]) for c in found}
                for pair, score in near(sizes[part], ats[part], hits[part]):
                    best[pair] = max(best.get(pair, 0.0), score)
                yield [(ids[lo + d], int(model.value[2][c]), v) for (d, c), v in best.items()]

    candidates = over_batches(located.filter(F.size("at") > 0), search, "doc_id bigint, item_id bigint, cosine double")
    grouped = stage(candidates.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "cosine")).alias("c")), "candidates")
    passages = spark.sparkContext.broadcast({i: (p, a) for i, p, a in held})

    def align(batches: Iterator[tuple[list, ...]]) -> Iterator[list[tuple]]:
        cache, held_codes = _Hashes(), {}
        for ids, texts, chosen in batches:
            out = []
            for doc_id, t, pairs in zip(ids, texts, chosen):
                found = words(t)
                codes = _codes(found, cache)
                whole = None
                for pair in pairs:
                    item = pair["item_id"]
                    if item not in held_codes:
                        p, a = passages.value[item]
                        held_codes[item] = (_codes(p, cache), a)
                    want, reply = held_codes[item]
                    run = _longest_run(codes, want, RUN)
                    share = run / max(1, len(want))
                    if run < RUN and pair["cosine"] >= reworded:
                        share = _span_share(codes, want)
                    if run >= RUN or share >= paraphrase:
                        whole = " ".join(found) if whole is None else whole
                        out.append((doc_id, item, pair["cosine"], run, float(share), bool(reply) and " ".join(reply) in whole))
            yield out

    asked = docs.join(grouped, "doc_id").select("doc_id", "text", "c")
    return over_batches(asked, align, schema)


def _span_share(doc: np.ndarray, want: np.ndarray) -> float:
    """Best share of a passage's words that follow in order within a span of its own length (and half as much again)."""
    if not len(want):
        return 0.0
    size = len(want) + len(want) // 2
    common = np.isin(doc, want)
    best = 0.0
    for start in range(0, max(1, len(doc) - len(want) // 2), max(1, size // 3)):
        if common[start : start + size].sum() > best * len(want):
            best = max(best, _subsequence(doc[start : start + size], want) / len(want))
    return best
