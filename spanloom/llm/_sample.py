"""Bounded training samples, chosen by the hash of the text: the same rows at every run and partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def by_hash(rows: DataFrame, text: str, bound: int) -> list:
    """At most `bound` rows with the least hashes of `text`, in that order.

    The hash is cut at a threshold first, so that the tasks together send about twice the bound and not each of them the
    bound; should fewer rows lie below the threshold, it is dropped.
    """
    hashed = rows.withColumn("__h", F.xxhash64(text))
    n = rows.count()
    share = min(1.0, (2.0 * bound + 200) / max(1, n))
    least = int(-(2**63) + share * 2**64) if share < 1 else 2**63 - 1
    taken = hashed.filter(F.col("__h") <= F.lit(least)).orderBy("__h", text).limit(bound).collect()
    if len(taken) < min(bound, n):
        taken = hashed.orderBy("__h", text).limit(bound).collect()
    return taken
