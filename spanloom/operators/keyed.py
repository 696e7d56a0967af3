"""Keyed storage on Parquet: first-wins dedupe, insert-if-absent, upsert, staleness and work selection.

Plain Parquet has no MERGE; every operator here returns the new snapshot as a DataFrame, made of anti-joins and unions,
and the sink writes it beside the old one. Null keys are keys of their own unless a function says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def _matches(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in `order`. Ties beyond the order are broken by nothing: give a total order.

    As an aggregate it combines on the map side, so a hot key costs a partial row per task; no window sorts it.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, "__row.*").select(*df.columns)


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshot with those incoming rows whose key was absent."""
    new = incoming.join(existing, _matches(incoming, existing, keys), "left_anti")
    return existing.unionByName(new)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshot in which incoming rows replace those of the same key."""
    kept = existing.join(incoming, _matches(existing, incoming, keys), "left_anti")
    return kept.unionByName(incoming)


def replace_children(children: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Snapshot in which all children of every incoming parent are replaced by the incoming ones."""
    parents = incoming.select(parent).distinct()
    return children.join(parents, parent, "left_anti").unionByName(incoming)


def cascade_delete(children: DataFrame, gone: DataFrame, parent: str) -> DataFrame:
    """Children whose parent is not among the deleted ones."""
    return children.join(gone.select(parent).distinct(), parent, "left_anti")


def select_new(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work not done yet."""
    return work.join(done, _matches(work, done, keys), "left_anti")


def select_refresh(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that is done and shall be done again."""
    return work.join(done, _matches(work, done, keys), "left_semi")


def outdated(rows: DataFrame, version: str, current: str) -> DataFrame:
    """Rows made by another version than the current one; unknown versions (null) are not outdated."""
    return rows.filter(F.col(version).isNotNull() & (F.col(version) != current))


def latest_status(events: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """Latest status per key of an append-only log."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias(status))


def append_note(notes: Column, note: str) -> Column:
    """Note text with `note` appended once, separated by '; '."""
    have = F.coalesce(notes, F.lit(""))
    return F.when(F.contains(have, F.lit(note)), have).when(have == "", F.lit(note)).otherwise(F.concat(have, F.lit("; " + note)))


def top_cover(df: DataFrame, key: str, width: str, ties: str) -> DataFrame:
    """The widest row per key, ties to the smallest `ties`."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(width), -F.col(ties))).alias("r")).select(key, "r.*")


def numbered(df: DataFrame, parts: list[str], order: list[Column], name: str = "ordinal") -> DataFrame:
    """0-based ordinals per group. Groups are parents' children; their size is bounded by the parent."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*parts).orderBy(*order)) - 1)


def last_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last in `order`; the counterpart of `first_wins` for insert-or-replace loads."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, "__row.*").select(*df.columns)


def updated(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshot with the other columns of `incoming` in place of the stored ones where a key has any, and column `updated`.

    `incoming` has one row per key; keys that are not stored are left out.
    """
    others = [c for c in existing.columns if c not in keys]
    new = incoming.select(*keys, *(F.col(c).alias(f"__{c}") for c in others), F.lit(True).alias("__new"))
    joined = existing.alias("e").join(new.alias("n"), _matches_aliased("e", "n", keys), "left")
    hit = F.coalesce(F.col("n.__new"), F.lit(False))
    return joined.select(*(F.col(f"e.{k}") for k in keys), *(F.when(hit, F.col(f"n.__{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in others), hit.alias("updated"))


def _matches_aliased(left: str, right: str, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys))


def cache_put(cache: DataFrame | None, puts: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value) of a cache after some puts: of one key the last put in `order` counts, and any put over what was cached."""
    last = puts.groupBy(key).agg(F.max_by(value, order).alias(value))
    return last if cache is None else upsert(cache.select(key, value), last, [key])


def first_found(df: DataFrame, keys: dict[str, Column], lookup: DataFrame, on: str, value: str) -> DataFrame:
    """Rows with `value` of the first key in order that has a text in `lookup`, and `source`, the key's name or `none`.

    One join per key; `lookup` has one row per `on`.
    """
    out = df
    for name, key in keys.items():
        side = lookup.select(F.col(on).alias(f"__k_{name}"), F.nullif(F.col(value), F.lit("")).alias(f"__v_{name}"))
        out = out.withColumn(f"__k_{name}", key).join(side, f"__k_{name}", "left")
    source = F.lit("none")
    for name in reversed(keys):
        source = F.when(F.col(f"__v_{name}").isNotNull(), name).otherwise(source)
    return out.select(*df.columns, F.coalesce(*(F.col(f"__v_{n}") for n in keys)).alias(value), source.alias("source"))


def limited(df: DataFrame, order: list[Column], n: int | None) -> DataFrame:
    """The first `n` rows in a total order; 0 and None mean all rows."""
    return df.orderBy(*order).limit(n) if n else df


def queue_states(log: DataFrame, key: str, event: str, order: list[str], approve: str, reject: str, install: str) -> DataFrame:
    """(key, approved, installed) of an append-only queue log.

    approved: the last decision, null before any; installed: whether an installation follows the last approval of an
    approved entry. Entries with neither are pending. One aggregate, so a hot entry costs partial rows only.
    """
    at = F.struct(*order)
    decided = F.col(event).isin(approve, reject)
    folded = log.groupBy(key).agg(
        F.max_by(F.when(decided, F.col(event) == approve), F.when(decided, at)).alias("approved"),
        F.max(F.when(F.col(event) == approve, at)).alias("__approved"), F.max(F.when(F.col(event) == install, at)).alias("__installed"),
    )
    return folded.select(key, "approved", F.coalesce(F.col("approved") & (F.col("__installed") > F.col("__approved")), F.lit(False)).alias("installed"))
