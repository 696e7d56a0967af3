"""Readers: header CSV, ranked lines, word lists, JSON lines, feeds and dictionary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import clock, text as T
from ..functions.arrow import composed
from ..runtime import exists


def csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header (and perhaps a byte-order mark), every column a string, in the named order."""
    df = spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False).csv(path)
    df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    return df.select(*(F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def ranked_lines(spark: SparkSession, path: str) -> DataFrame:
    """(rank, line) of the non-blank lines of one file; rank is the 1-based place among them.

    Line places need the file as a whole, so it is one record: for lists that fit into a task, as word lists do.
    """
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")).alias("n", "line"))
    return rows.select((F.col("n") + 1).alias("rank"), F.trim("line").alias("line"))


def word_lists(spark: SparkSession, folder: str, names: list[str]) -> tuple[DataFrame, list[str]]:
    """((form, display, sources) merged over the lists, names of missing ones).

    The first list in order that has a form gives its display; sources keep the order of the lists. Blank lines and
    lines that begin with # are left out.
    """
    there = [n for n in names if exists(spark, f"{folder.rstrip('/')}/{n}")]
    missing = [n for n in names if n not in there]
    schema = "form string, display string, sources array<string>"
    if not there:
        return spark.createDataFrame([], schema), missing
    parts = [spark.read.text(f"{folder.rstrip('/')}/{n}").select(F.lit(k).alias("ord"), F.lit(n.rsplit(".", 1)[0]).alias("source"), T.squeeze("value").alias("display")) for k, n in enumerate(there)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = composed(every, "display").filter("display <> '' and not startswith(display, '#')").withColumn("form", T.form("display"))
    sources = F.transform(F.array_sort(F.collect_set(F.struct("ord", "source"))), lambda s: s["source"])
    return every.groupBy("form").agg(F.min(F.struct("ord", "display"))["display"].alias("display"), sources.alias("sources")), missing


RECORD = "word string, pos string, lang_code string, senses array<struct<glosses: array<string>, tags: array<string>>>"


def records(spark: SparkSession, path: str, lang: str = "vi", wanted: DataFrame | None = None) -> DataFrame:
    """Dictionary records of JSON lines in one language; malformed lines are dropped, `wanted` (word) limits the words."""
    df = spark.read.schema(RECORD).option("mode", "DROPMALFORMED").json(path).filter((F.col("lang_code") == lang) & F.col("word").isNotNull())
    return df if wanted is None else df.join(wanted.select("word"), "word", "left_semi")


def senses(rows: DataFrame, kinds: list[str], meta: str, cap: int = 8) -> DataFrame:
    """(word, pos, rank, gloss) of dictionary records: content senses before pointers, kinds in order, equal ones once.

    Ranks are taken before equal glosses (letter case aside) are dropped, so they may have gaps; at most `cap` are kept
    of a record.
    """
    rows = rows.withColumn("record", F.xxhash64("word", "pos", F.to_json("senses")))
    flat = rows.select("word", "pos", "record", F.posexplode("senses").alias("i", "s")).select("word", "pos", "record", "i", F.posexplode("s.glosses").alias("j", "g"))
    flat = flat.withColumn("gloss", T.clean_gloss("g")).filter("gloss <> ''").withColumn("meta", F.col("gloss").rlike(meta))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, kinds)), F.col("pos")).cast("int"), F.lit(0)) - 1, F.lit(len(kinds)))
    ranked = flat.withColumn("rank", F.row_number().over(Window.partitionBy("record").orderBy("meta", place, "i", "j")) - 1)
    once = ranked.groupBy("record", "word", "pos", F.lower("gloss").alias("fold")).agg(F.min(F.struct("rank", "gloss")).alias("k"))
    kept = once.withColumn("n", F.row_number().over(Window.partitionBy("record").orderBy("k.rank"))).filter(F.col("n") <= cap)
    return kept.select("word", "pos", "k.rank", "k.gloss")


ITEM = "title string, link string, guid string, description string, summary string, pubDate string, updated string, author string"


ENTRY = "title string, link array<struct<_href: string, _rel: string>>, id string, summary string, content string, published string, updated string, author struct<name: string>"


def feed(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(source, guid, url, title, summary, published_at, author) of a feed's items, RSS or Atom.

    Items without a link or a title are dropped; the link stands in for a missing guid, the updated for a missing
    published date. A file that cannot be read gives no rows.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], FEED)
    filled = lambda *names: F.coalesce(*(F.nullif(F.trim(n), F.lit("")) for n in names))

    def rows(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).option("mode", "DROPMALFORMED").schema(schema).load(path)

    rss = rows("item", ITEM)
    url = filled("link")
    items = rss.select(F.lit(source).alias("source"), F.coalesce(filled("guid"), url).alias("guid"), url.alias("url"), filled("title").alias("title"), F.coalesce(filled("summary", "description"), F.lit("")).alias("summary"), F.coalesce(clock.feed_date(F.col("pubDate")), clock.feed_date(F.col("updated"))).alias("published_at"), filled("author").alias("author"))
    atom = rows("entry", ENTRY)
    # The page is the link that names no relation or is the alternate one; others are feeds and enclosures.
    page = F.get(F.filter("link", lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate")), F.lit(0))["_href"]
    url = F.nullif(F.trim(page), F.lit(""))
    time = lambda name: F.try_to_timestamp(F.trim(name))
    entries = atom.select(F.lit(source).alias("source"), F.coalesce(filled("id"), url).alias("guid"), url.alias("url"), filled("title").alias("title"), F.coalesce(filled("summary", "content"), F.lit("")).alias("summary"), F.coalesce(time("published"), time("updated")).alias("published_at"), filled("author.name").alias("author"))
    return items.unionByName(entries).filter("url is not null and title is not null")


FEED = "source string, guid string, url string, title string, summary string, published_at timestamp, author string"


def feeds(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """(items of all feeds by their source's name, failures by source): a feed that cannot be read does not stop the others."""
    parts, failed = [], {}
    for source, path in paths.items():
        try:
            if not exists(spark, path):
                raise FileNotFoundError(path)
            part = feed(spark, path, source)
            # Reading one row shows whether the file is XML at all; items come later, with everything else.
            part.limit(1).count()
            parts.append(part)
        except Exception as e:  # noqa: BLE001
            failed[source] = f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"
    out = parts[0] if parts else spark.createDataFrame([], FEED)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, failed


def dictionary_table(spark: SparkSession, folder: str, longest: int = 4) -> DataFrame:
    """(headword, display, syllable_count, senses) from Parquet tables entries and glosses; without glosses none has senses."""
    entries = spark.read.parquet(f"{folder.rstrip('/')}/entries.parquet").filter(F.col("syllable_count") <= longest)
    path = f"{folder.rstrip('/')}/glosses.parquet"
    if not exists(spark, path):
        return entries.select("headword", "display", "syllable_count", F.array().cast("array<string>").alias("senses"))
    glosses = spark.read.parquet(path).groupBy("headword").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "gloss"))), lambda s: s["gloss"]).alias("senses"))
    return entries.join(glosses, "headword", "left").select("headword", "display", "syllable_count", F.coalesce("senses", F.array().cast("array<string>")).alias("senses"))
