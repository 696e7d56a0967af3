"""Practice items: content-determined option order, answer positions, scoring and coverage of key points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T


def option_order(items: DataFrame) -> DataFrame:
    """Options sorted by sha256(question, unit separator, option), the answer following its option.

    The order depends on content only: it is stable, and a second application changes nothing. Items with fewer than two
    options, null options or an index outside them are unchanged. Equal options keep their first order.
    """
    keyed = F.array_sort(F.transform("options", lambda x, i: F.struct(F.sha2(F.concat(F.coalesce("question", F.lit("")), F.lit("\u001f"), F.coalesce(x, F.lit(""))), 256).alias("h"), i.alias("i"), x.alias("x"))))
    able = F.coalesce((F.size("options") >= 2) & (F.col("answer") >= 0) & (F.col("answer") < F.size("options")), F.lit(False))
    moved = items.withColumn("__k", F.when(able, keyed))
    place = F.array_position(F.transform("__k", lambda s: s["i"]), F.col("answer")) - 1
    moved = moved.withColumn("answer", F.when(able, place.cast("int")).otherwise(F.col("answer")))
    return moved.withColumn("options", F.when(able, F.transform("__k", lambda s: s["x"])).otherwise(F.col("options"))).drop("__k")


def answer_positions(items: DataFrame) -> DataFrame:
    """Answers per position with whole percentages."""
    counts = items.filter("kind = 'mcq' and answer >= 0").groupBy("answer").agg(F.count("*").alias("n"))
    # One row per position: the window reads as many rows as an item has options.
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.select("answer", "n", F.floor(100 * F.col("n") / total).cast("bigint").alias("percent"))


def valid(items: DataFrame) -> DataFrame:
    """Items that can be asked: a question, and for choices two options and an index within them; min_words at least 0."""
    choice = (F.size("options") >= 2) & (F.col("answer") >= 0) & (F.col("answer") < F.size("options"))
    asked = F.coalesce(T.strip("question"), F.lit("")) != ""
    kept = items.filter(asked & ((F.col("kind") != "mcq") | F.coalesce(choice, F.lit(False))))
    return kept.withColumn("min_words", F.greatest(F.lit(0), F.coalesce("min_words", F.lit(0))))


def covered(points: Column, answer: Column, stop: tuple[str, ...]) -> Column:
    """Number of key points of which at least half of the content words (rounded up) occur in the answer."""
    text = F.lower(F.coalesce(answer, F.lit("")))

    def hit(point: Column) -> Column:
        words = T.content_words(point, stop)
        found = F.size(F.filter(words, lambda w: F.contains(text, w)))
        return (F.size(words) > 0) & (found >= F.ceil(F.size(words) / 2))

    return F.size(F.filter(points, hit))
