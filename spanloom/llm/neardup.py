"""Near-duplicate articles by circulant MinHash (problem 5).

Runs of words are hashed; a first permutation scatters them over a ring of positions, and one second permutation, read
from each position onwards, gives all signature coordinates: coordinate k of a set is the least value found k places
after any of its positions. Because an element's K values lie side by side, a signature is the column-wise minimum of
slices of one array. Bands of the signature propose pairs, one-bit sketches thin them, and exact Jaccard similarities
over the whole sets decide.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..runtime import stage
from . import boilerplate
from ._arrow import over_slices

#: Positions on the ring; the second permutation then has 16-bit values.
RING = 1 << 16
_WORD = re.compile(r"\w+")


#: Pieces of text that a task remembers, and the longest of them.
PIECES, PIECE = 500_000, 40


class _Hashes(dict):
    """Hashes of the words of a piece of text between spaces, 8 bytes each. Words never hold a space, and a letter's
    lower case never depends on what stands beyond one."""

    def __missing__(self, piece: str) -> bytes:
        found = _WORD.findall(piece.lower())
        value = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)).tobytes()
        if len(piece) <= PIECE:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = value
        return value


def words(text: str, memo: dict) -> np.ndarray:
    """64-bit hashes of a folded text's words (runs of letters, figures and _), in lower case."""
    return np.frombuffer(b"".join(map(memo.__getitem__, text.split())), np.uint64)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words; a shorter text has one run, an empty one none."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    out = np.zeros(len(hashes) - size + 1, np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[k : len(hashes) - size + 1 + k]
    out ^= out >> np.uint64(32)
    return out * np.uint64(0x94D049BB133111EB)


class Circulant:
    """K MinHash coordinates from two permutations; deterministic in (coordinates, seed)."""

    def __init__(self, coordinates: int, seed: int = 20):
        rng = np.random.default_rng(seed)
        second = rng.permutation(RING).astype(np.uint16)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: coordinates - 1]]), coordinates)
        # The first permutation: an odd multiplier and an xor-shift are bijections of 64-bit hashes.
        self.odd = np.uint64(int(rng.integers(1 << 62)) * 2 + 1)

    def __call__(self, runs: np.ndarray) -> np.ndarray:
        mixed = runs * self.odd
        mixed ^= mixed >> np.uint64(31)
        return self.windows[(mixed >> np.uint64(48)).astype(np.int64)].min(axis=0)


def _signed(values: np.ndarray) -> list[int]:
    return values.astype(np.uint64).view(np.int64).tolist()


def distinct(runs: np.ndarray) -> np.ndarray:
    ordered = np.sort(runs)
    kept = np.ones(len(ordered), bool)
    kept[1:] = ordered[1:] != ordered[:-1]
    return ordered[kept]


def bands_of(signatures: np.ndarray, bands: int, rows: int) -> list[list[int]]:
    """Bands of each row of `signatures`."""
    part = signatures[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + part[:, :, k]
    return _signed(out ^ (out >> np.uint64(27)))


def sketch_of(signatures: np.ndarray, longs: int = 3) -> list[list[int]]:
    """One bit of each of the first 64 * `longs` coordinates of each row of `signatures`."""
    value = signatures[:, : 64 * longs].astype(np.uint64)
    bits = (((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64).tolist()


def proposed_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: pairs that share a band and whose one-bit sketches allow the threshold.

    `members` has row_id, bands, sketch. A bucket is joined with itself, never gathered; a hot bucket is a skewed join
    key, which adaptive execution splits. Sketches go along: most pairs that share one band are far apart.
    """
    each = members.select("row_id", "sketch", F.explode("bands").alias("band"))
    left = each.select(F.col("row_id").alias("a"), F.col("sketch").alias("sa"), "band")
    right = each.select(F.col("row_id").alias("b"), F.col("sketch").alias("sb"), "band")
    # One-bit coordinates agree with probability (1 + J) / 2; four standard deviations below the threshold lose nothing.
    coordinates = 192
    least = coordinates * (1 + threshold) / 2 - 4 * (coordinates * (1 - threshold**2) / 4) ** 0.5
    differing = sum(F.bit_count(F.col("sa")[k].bitwiseXOR(F.col("sb")[k])) for k in range(3))
    return left.join(right, "band").filter((F.col("a") < F.col("b")) & (coordinates - differing >= least)).select("a", "b").distinct()


def verified(proposed: DataFrame, sets: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """Exact Jaccard similarity of proposed pairs from the members' distinct runs."""
    one = sets.select(F.col("row_id").alias("a"), F.col("runs").alias("ra"))
    two = sets.select(F.col("row_id").alias("b"), F.col("runs").alias("rb"))
    both = F.size(F.array_intersect("ra", "rb"))
    joined = proposed.join(one, "a").join(two, "b").withColumn("both", both)
    joined = joined.withColumn("similarity", F.col("both") / (F.size("ra") + F.size("rb") - F.col("both")))
    reached = F.col("similarity") > threshold if strict else F.col("similarity") >= threshold
    return joined.filter(reached).select("a", "b", "similarity")


BODIES = "row_id bigint, body_key bigint, bands array<bigint>, sketch array<bigint>"
#: Bands and rows of the signature: a pair at similarity 0.5 is proposed with probability 0.90, at 0.6 with 0.997.
BANDS, ROWS = 73, 5


def _signed_bodies(pages: DataFrame, cleaner: Callable, size: int, bands: int, rows: int) -> DataFrame:
    """BODIES of the pages' main bodies. Bodies without any words share nothing with others: no key, no bands."""

    def run(batches: Iterator[tuple[list, ...]]) -> Iterator[list[tuple]]:
        minhash, memo, clean = Circulant(bands * rows), _Hashes(), cleaner()
        for batch in batches:
            keys, signatures = [], []
            for _, text, url, gone in zip(*batch):
                hashes = words("\n".join(clean(text, url, gone)), memo)
                keys.append(xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63) if len(hashes) else None)
                if len(hashes):
                    signatures.append(minhash(shingles(hashes, size)))
            signed = np.array(signatures, np.uint16).reshape(-1, bands * rows)
            of = zip(bands_of(signed, bands, rows), sketch_of(signed))
            yield [(row_id, key, *(([], []) if key is None else next(of))) for row_id, key in zip(batch[0], keys)]

    return over_slices(pages.select("row_id", "text", "url", "gone"), run, BODIES)


def _bodies_and_pairs(articles: DataFrame, size: int, threshold: float, bands: int, rows: int, key: str, text: str, url: str) -> tuple[DataFrame, DataFrame]:
    """((row_id, rep) of every page with a body, (a, b, similarity) of representatives): the smallest id of equal bodies
    stands for all of them."""
    given = articles.select(F.col(f"`{key}`").cast("bigint").alias("row_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{url}`").alias("url")).filter("text <> ''")
    pages, cleaner = boilerplate.cleaned(given)
    signed = stage(_signed_bodies(pages, cleaner, size, bands, rows), "bodies")
    keyed = signed.select("row_id", "body_key", "bands", "sketch").filter("body_key is not null")
    reps = keyed.groupBy("body_key").agg(F.min("row_id").alias("rep"))
    members = keyed.join(reps.select(F.col("rep").alias("row_id")), "row_id", "left_semi")
    near = stage(_near(members, pages, cleaner, size, threshold), "near")
    return stage(keyed.select("row_id", "body_key").join(reps, "body_key").select("row_id", "rep"), "copies"), near


def article_pairs(articles: DataFrame, size: int = 3, threshold: float = 0.5, bands: int = BANDS, rows: int = ROWS, key: str = "id", text: str = "original_text", url: str = "source_url") -> DataFrame:
    """(a, b, similarity), a < b: articles of which more than `threshold` of the distinct word runs occur in both bodies.

    Bodies are what the path ratios of each site leave. Equal bodies are one member for the search and are paired through
    it afterwards. Null and empty texts, and bodies without words, have no row.
    """
    of, near = _bodies_and_pairs(articles, size, threshold, bands, rows, key, text, url)
    # Copies are expanded only here: every pair of articles is a row of the result.
    across = near.join(of.select(F.col("rep").alias("a"), F.col("row_id").alias("x")), "a").join(of.select(F.col("rep").alias("b"), F.col("row_id").alias("y")), "b")
    across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    several = of.join(of.filter("row_id <> rep").select("rep").distinct(), "rep", "left_semi")
    within = several.select("rep", F.col("row_id").alias("a")).join(several.select("rep", F.col("row_id").alias("b")), "rep").filter("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    return across.unionByName(within)


def article_groups(articles: DataFrame, size: int = 3, threshold: float = 0.5, bands: int = BANDS, rows: int = ROWS, key: str = "id", text: str = "original_text", url: str = "source_url") -> DataFrame:
    """(row_id, group_id, copies, links): every article with a body and its group, the smallest id that similar pairs lead to.

    copies: articles with an equal body, itself included; links: distinct other bodies that are similar. Groups grow over
    representatives only, so a body stored many times is one node and copies are never paired.
    """
    of, near = _bodies_and_pairs(articles, size, threshold, bands, rows, key, text, url)
    both = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("links"))
    roots = components(near.select("a", "b")).select(F.col("node").alias("rep"), "root")
    copies = of.groupBy("rep").agg(F.count("*").alias("copies"))
    per_rep = copies.join(links, "rep", "left").join(roots, "rep", "left")
    return of.join(per_rep, "rep").select("row_id", F.coalesce("root", "rep").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the smallest node of its component.

    Large-star and small-star in turn, each an aggregate over a node's neighbours (a minimum, no list), until the edges
    stay as they are. Every round is a written table; nothing is gathered on the driver but the sum that tells the end.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "star")
    before = None
    while True:
        sides = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sides.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u")
        small = linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v")))
        now = stage(small.filter("u <> v").distinct(), "star")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root"))


def _near(members: DataFrame, pages: DataFrame, cleaner: Callable, size: int, threshold: float) -> DataFrame:
    proposed = stage(proposed_pairs(members, threshold), "proposed")
    wanted = proposed.select(F.col("a").alias("row_id")).union(proposed.select("b")).distinct()

    def run(batches: Iterator[tuple[list, ...]]) -> Iterator[list[tuple]]:
        memo, clean = _Hashes(), cleaner()
        for batch in batches:
            out = []
            for row_id, text, url, gone in zip(*batch):
                hashes = words("\n".join(clean(text, url, gone)), memo)
                out.append((row_id, _signed(distinct(shingles(hashes, size)))))
            yield out

    sets = over_slices(pages.join(wanted, "row_id", "left_semi").select("row_id", "text", "url", "gone"), run, "row_id bigint, runs array<bigint>")
    return verified(proposed, stage(sets, "runs"), threshold, strict=True)
