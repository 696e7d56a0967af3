"""Queries of the training-data operators, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import boilerplate, charform, leakage, mixing, neardup, offence, pairs, readability, repeated, truncation


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of every page that are not the page's own prose."""
    bad = boilerplate.furniture(_t(spark, sf, "articles"))
    return bad.select(F.col("row_id").alias("article_id"), "line_no")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Quiz items without a usable answer, with their defect."""
    return pairs.judged(_t(spark, sf, "quiz_items")).filter("defect is not null").select("item_id", "defect")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Versions whose text lies two or more levels from the stored label."""
    return readability.misfits(readability.levels(_t(spark, sf, "article_versions"))).select(F.col("row_id").alias("version_id"))


def p3_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Level and difficulty of every version's text."""
    scored = readability.levels(_t(spark, sf, "article_versions"))
    return scored.select(F.col("row_id").alias("version_id"), "stored", "level", F.round("difficulty", 3).alias("difficulty"), "n_sentences")


def _values(spark: SparkSession, sf: str) -> DataFrame:
    raw = _t(spark, sf, "raw_articles").select(F.lit("raw_articles").alias("table_name"), F.col("feed_row_id").alias("row_id"), "source", F.col("summary").alias("text"), F.lit(False).alias("page"))
    full = _t(spark, sf, "articles").select(F.lit("articles").alias("table_name"), F.col("id").alias("row_id"), "source", F.col("original_text").alias("text"), (F.col("body_source") == "full").alias("page"))
    return raw.unionByName(full)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries and page texts that end before their last sentence does."""
    return truncation.judged(_values(spark, sf)).filter("cut").select("table_name", "row_id")


def p4_rates(spark: SparkSession, sf: str) -> DataFrame:
    """How often the values of each source are cut."""
    return truncation.rates(truncation.judged(_values(spark, sf)))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of full articles of which more than half of the distinct runs of three words occur in both bodies."""
    full = _t(spark, sf, "articles").filter("body_source = 'full'")
    pairs = neardup.article_pairs(full)
    return pairs.select(F.col("a").alias("article_id_a"), F.col("b").alias("article_id_b"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Values of entries and articles that are not in the usual character form."""
    return _forms(spark, sf).filter("changed").select("table_name", "row_id", "field_name")


def _forms(spark: SparkSession, sf: str) -> DataFrame:
    entries = charform.cells(_t(spark, sf, "entries"), "entries", "entry_id", ["headword", "display"])
    articles = charform.cells(_t(spark, sf, "articles"), "articles", "id", ["original_text"])
    return charform.unify(entries.unionByName(articles))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every occurrence of a line that stands in at least six articles of its source."""
    return repeated.repeats(_t(spark, sf, "articles")).select(F.col("row_id").alias("article_id"), "line_no")


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(_t(spark, sf, "documents"), _t(spark, sf, "eval_items"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with at least 13 consecutive words of an item's passage."""
    return _leaks(spark, sf).filter(F.col("run") >= leakage.RUN).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Leaked items with the extent of the copy or paraphrase and whether the answer stands with it."""
    return _leaks(spark, sf).select("doc_id", "item_id", "run", F.round("share", 4).alias("share"), "answered")


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """Schedule of the documents that mix the sources to their target shares."""
    return mixing.mixture(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"))


def p9_mixture_total(spark: SparkSession, sf: str) -> DataFrame:
    """The mixture of as many tokens as all documents have, sources at their cap giving what they have."""
    documents = _t(spark, sf, "documents")
    return mixing.mixture_of_total(documents, _t(spark, sf, "mix_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and reached shares of every source."""
    return mixing.shares(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"))


def p1_body(spark: SparkSession, sf: str) -> DataFrame:
    """The story of every page, without the furniture."""
    return boilerplate.bodies(_t(spark, sf, "articles")).select(F.col("row_id").alias("article_id"), "body", "n_lines", "n_furniture")


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every full article with its group of near-duplicates."""
    full = _t(spark, sf, "articles").filter("body_source = 'full'")
    return neardup.article_groups(full).select(F.col("row_id").alias("article_id"), "group_id", "copies", "links")


def p6_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every value that is not in the usual form, with that form."""
    return _forms(spark, sf).filter("changed").select("table_name", "row_id", "field_name", "form")


def p7_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Articles without the lines that repeat in their source."""
    return repeated.without(_t(spark, sf, "articles")).select(F.col("row_id").alias("article_id"), "removed", "text")


def p7_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Line templates with wildcard slots that cover at least six articles of their source."""
    return repeated.templates(_t(spark, sf, "articles"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with abusive, hateful or sexual language, one row per category."""
    return offence.found(offence.scores(_t(spark, sf, "documents"))).select("doc_id", "category")


def p10_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's score in every category."""
    return offence.scores(_t(spark, sf, "documents"))


def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of offensive documents per source."""
    return offence.rates(offence.scores(_t(spark, sf, "documents")))


_ALL = (
    p1_found, p1_body, p2_found, p3_found, p3_levels, p4_found, p4_rates, p5_found, p5_groups, p6_found, p6_forms, p7_found, p7_clean, p7_templates,
    p8_found, p8_leaks, p9_mixture, p9_mixture_total, p9_shares, p10_found, p10_scores, p10_rates,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {}
