"""Mixing sources to target weights (problem 9) by a low-discrepancy schedule of equal-token blocks.

Token totals per source and the caps on repetition fix how many tokens each source gives. Its documents, shuffled anew for
each repetition, are cut into blocks of equal tokens. Golden-ratio points mapped through the cumulative weights name the
source of every slot; the k-th slot of a source takes its k-th block. Running sums and ranks are taken within bounded
buckets and shifted by the totals of the buckets before, so no source is ever one task.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import bounded, stage
from ._arrow import over_batches

#: Vocabulary file of a public byte-level BPE tokenizer (rank file), and its fixed splitting pattern.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
GOLDEN = (math.sqrt(5) - 1) / 2
#: Cells of the unit interval in which a slot's source is looked up.
CELLS = 1024
_ENCODERS: dict = {}


def encoder(path: str):
    """The tokenizer of a rank file, loaded once per process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def counted(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of documents with tokens and a source; null and empty texts count none and are left out."""
    rows = documents.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text")).filter("text <> '' and source is not null")

    # The file goes to the executors with the session; its path on the driver is all that a caller needs to know.
    documents.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def run(batches: Iterator[tuple[list, ...]]) -> Iterator[list[tuple]]:
        encode = encoder(SparkFiles.get(name)).encode_ordinary
        for ids, names, texts in batches:
            yield [(i, s, len(encode(t))) for i, s, t in zip(ids, names, texts)]

    return over_batches(rows, run, "doc_id bigint, source string, tokens bigint")


def quotas(available: dict[str, int], shares: dict[str, float], repeats: dict[str, int], total: int | None = None) -> dict[str, int]:
    """Tokens to take from each source.

    Without `total`, the most tokens at which every source that has any reaches its share of them; shares of sources
    without tokens go to the others in proportion. With `total`, sources at their cap give what they have and the rest
    is shared in proportion again, until the total or all caps are reached.
    """
    most = {s: available.get(s, 0) * max(0, repeats.get(s, 1)) for s in shares}
    live = {s for s in shares if most[s] > 0 and shares[s] > 0}
    if not live:
        return {s: 0 for s in shares}
    if total is None:
        weight = sum(shares[s] for s in live)
        whole = min(most[s] * weight / shares[s] for s in live)
        return {s: round(whole * shares[s] / weight) if s in live else 0 for s in shares}
    out = {s: 0 for s in shares}
    rest, free = float(total), set(live)
    while free:
        weight = sum(shares[s] for s in free)
        full = {s for s in free if rest * shares[s] / weight >= most[s]}
        if not full:
            out |= {s: round(rest * shares[s] / weight) for s in free}
            break
        for s in full:
            out[s] = most[s]
            rest -= most[s]
        free -= full
    return out


def _plan(tokens: DataFrame, targets: DataFrame, total: int | None) -> list[tuple[str, float, int, int, int]]:
    """(source, share, max_repeats, available, quota); the table of targets is small and its size is checked."""
    wanted = targets.groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats")).filter("source is not null")
    sums = tokens.groupBy("source").agg(F.sum("tokens").alias("available"))
    rows = bounded(wanted.join(sums, "source", "left"), 100_000)
    available = {r["source"]: r["available"] or 0 for r in rows}
    shares = {r["source"]: float(r["share"] or 0) for r in rows}
    repeats = {r["source"]: 1 if r["repeats"] is None else int(r["repeats"]) for r in rows}
    quota = quotas(available, shares, repeats, total)
    return sorted((s, shares[s], repeats[s], available[s], quota[s]) for s in shares)


def _running(df: DataFrame, group: list[str], bucket: str, order: list, value: str) -> DataFrame:
    """Sum of `value` before each row, per group in the order of (bucket, order); buckets are bounded, groups are not."""
    within = Window.partitionBy(*group, bucket).orderBy(*order)
    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("__t"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, bucket, F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"))
    summed = df.withColumn("__b", F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
    return summed.join(offsets, [*group, bucket]).withColumn("before", F.col("__b") + F.col("__o")).drop("__b", "__o")


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, block: int = 8192, seed: int = 9, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text", source: str = "source", bucket_docs: int = 50_000) -> DataFrame:
    """(slot, doc_id, source, repeat, tokens): every document of the mixture with its place in the schedule.

    A document appears at most max_repeats times, once in each repetition; a repetition is begun only when the one
    before is used up. Sources not in `targets` are left out; targets without documents stay empty.
    """
    tokens = stage(counted(documents, key, text, source, tokenizer), "tokens")
    plan = _plan(tokens, targets, total)
    return _scheduled(tokens, plan, block, seed, bucket_docs)


def mixture_of_total(documents: DataFrame, targets: DataFrame, block: int = 8192, seed: int = 9, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text", source: str = "source", bucket_docs: int = 50_000) -> DataFrame:
    """`mixture` with the tokens of all documents as its total: scarce sources repeat up to their caps, then the others fill."""
    tokens = stage(counted(documents, key, text, source, tokenizer), "tokens")
    total = int(tokens.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    return _scheduled(tokens, _plan(tokens, targets, total), block, seed, bucket_docs)


def _scheduled(tokens: DataFrame, plan: list, block: int, seed: int, bucket_docs: int) -> DataFrame:
    spark = tokens.sparkSession
    live = [(s, share, repeats, have, quota) for s, share, repeats, have, quota in plan if quota > 0]
    schema = "slot bigint, doc_id bigint, source string, repeat int, tokens bigint"
    if not live:
        return spark.createDataFrame([], schema)
    size = spark.createDataFrame([(s, math.ceil(q / have), q, have) for s, _, _, have, q in live], "source string, epochs int, quota bigint, have bigint")
    counts = tokens.groupBy("source").agg(F.count("*").alias("docs"))
    size = F.broadcast(size.join(counts, "source"))
    each = tokens.filter("tokens > 0").join(size, "source").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    each = each.withColumn("__h", F.xxhash64(F.lit(seed), "repeat", "doc_id"))
    each = each.withColumn("bucket", F.pmod(F.xxhash64("__h"), F.greatest(F.lit(1), F.ceil(F.col("docs") / bucket_docs)).cast("bigint")).cast("int"))
    placed = _running(each, ["source", "repeat"], "bucket", ["__h", "doc_id"], "tokens")
    start = F.col("repeat") * F.col("have") + F.col("before")
    # A document belongs to the mixture when more than half of it lies within the quota.
    taken = placed.filter(2 * start + F.col("tokens") <= 2 * F.col("quota")).select("source", "doc_id", "repeat", "tokens", F.floor(start / block).cast("bigint").alias("block"))

    whole = sum(q for *_, q in live)
    blocks = {s: math.ceil(q / block) for s, _, _, _, q in live}
    # Points per source differ from their expectation by less than the logarithm of their number; the margin covers it.
    n = sum(blocks.values()) + 64 * len(live) + 16
    n = max(n, max(math.ceil((b + 8 + 4 * math.log2(b + 2)) * whole / q) for (s, _, _, _, q), b in zip(live, blocks.values())))
    # Every source's stretch of the unit interval, once per cell that it touches: a slot meets the sources of its cell only.
    pieces, upto = [], 0.0
    for k, (s, _, _, _, q) in enumerate(live):
        low, upto = upto, 2.0 if k == len(live) - 1 else upto + q / whole
        pieces += [(s, low, upto, cell) for cell in range(int(low * CELLS), min(CELLS - 1, int(upto * CELLS)) + 1)]
    edges = F.broadcast(spark.createDataFrame(pieces, "source string, low double, high double, cell int"))
    point = F.expr(f"pmod(cast({seed} as double) * {GOLDEN!r} + (id + 1) * {GOLDEN!r}, 1.0D)")
    cell = F.floor(F.col("u") * CELLS).cast("int")
    slots = spark.range(n).select(F.col("id").alias("slot"), point.alias("u"), F.floor(F.col("id") / (1 << 20)).alias("bucket")).withColumn("cell", cell)
    slots = slots.join(edges, "cell").filter("u >= low and u < high").select("slot", "bucket", "source", F.lit(1).alias("one"))
    ranked = _running(slots, ["source"], "bucket", ["slot"], "one").select("source", "slot", F.col("before").alias("block"))
    return taken.join(ranked, ["source", "block"]).select("slot", "doc_id", "source", "repeat", "tokens")


def shares(documents: DataFrame, targets: DataFrame, total: int | None = None, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text", source: str = "source", block: int = 8192, seed: int = 9) -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, mixed_tokens, reached_share, repeats): the mixture's shares."""
    tokens = stage(counted(documents, key, text, source, tokenizer), "tokens")
    plan = _plan(tokens, targets, total)
    sums = _scheduled(tokens, plan, block, seed, 50_000).groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"))
    table = tokens.sparkSession.createDataFrame([(s, w, r, a) for s, w, r, a, _ in plan], "source string, target_share double, max_repeats int, available_tokens bigint")
    joined = table.join(sums, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    # One row per target: a table whose size was checked when the plan was made.
    whole = F.sum("mixed_tokens").over(Window.partitionBy())
    joined = joined.withColumn("reached_share", F.when(whole > 0, F.round(F.col("mixed_tokens") / whole, 6)).otherwise(F.lit(0.0)))
    return joined.withColumn("repeats", F.when(F.col("available_tokens") > 0, F.round(F.col("mixed_tokens") / F.col("available_tokens"), 4)).otherwise(F.lit(0.0)))
