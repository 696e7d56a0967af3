"""Queries over text normalisation, dictionaries and senses, feeds, pages and framed streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import clock, text as T
from ..functions.arrow import composed
from ..operators import pages
from ..sources import frames
from ._register import query, table

SP = "[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


@query(f"select doc_id, trim(regexp_replace(text, '{SP}+', ' ', 'g')) squeezed from documents")
def whitespace_squeeze(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.squeeze("text").alias("squeezed"))


@query(f"""select id, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(simplified_text, '\\r\\n?', chr(10), 'g'), '\\n(?:{SP}*\\n)+'), lambda p: trim(regexp_replace(p, '{SP}+', ' ', 'g'))), lambda p: p <> ''), chr(10) || chr(10)) body from article_versions""")
def paragraph_squeeze(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "article_versions").select("id", T.paragraph_squeeze("simplified_text").alias("body"))


@query("select entry_id, nfc_normalize(headword) headword, nfc_normalize(headword) <> headword changed from entries")
def nfc_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return pages.composed(table(spark, sf, "entries"), "entry_id", "headword").select(F.col("key").alias("entry_id"), F.col("form").alias("headword"), "changed")


@query(f"select entry_id, replace(lower(trim(regexp_replace(nfc_normalize(headword), '{SP}+', ' ', 'g'))), ' ', '_') form, lower(trim(regexp_replace(nfc_normalize(display), '{SP}+', ' ', 'g'))) plain from entries")
def normalised_forms(spark: SparkSession, sf: str) -> DataFrame:
    rows = composed(table(spark, sf, "entries").select("entry_id", "headword", "display"), "headword", "display")
    return rows.select("entry_id", T.form("headword").alias("form"), F.lower(T.squeeze("display")).alias("plain"))


@query(f"""with d as (select replace(lower(trim(regexp_replace(nfc_normalize(headword), '{SP}+', ' ', 'g'))), ' ', '_') form, display, entry_id, unnest(sources) s, generate_subscripts(sources, 1) k from entries),
f as (select form, s, min(entry_id * 1000 + k) seen from d where form <> '' group by form, s)
select d.form, d.display, f.sources from (select form, arg_min(display, entry_id) display from d where form <> '' group by form) d join (select form, string_agg(s, ',' order by seen) sources from f group by form) f on f.form = d.form""")
def dictionary_build(spark: SparkSession, sf: str) -> DataFrame:
    """One row per composed form: the first entry's display, and the sources in the order in which entries bring them."""
    entries = composed(table(spark, sf, "entries").select("headword", "display", "entry_id", "sources"), "headword")
    rows = entries.select(T.form("headword").alias("form"), "display", "entry_id", F.posexplode("sources").alias("k", "s")).filter("form <> ''")
    seen = rows.groupBy("form", "s").agg(F.min(F.struct("entry_id", "k", "display")).alias("f"))
    sources = F.transform(F.array_sort(F.collect_list(F.struct("f.entry_id", "f.k", "s"))), lambda x: x["s"])
    return seen.groupBy("form").agg(F.min("f")["display"].alias("display"), F.array_join(sources, ",").alias("sources"))


@query("select count(*) headwords, count_if(syllable_count > 1) compounds, max(syllable_count) longest, count(definition) glossed from entries")
def dictionary_stats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "entries").agg(F.count("*").alias("headwords"), F.count_if(F.col("syllable_count") > 1).alias("compounds"), F.max("syllable_count").alias("longest"), F.count("definition").alias("glossed"))


# The order of parts of speech and the openings of senses that only point elsewhere, for the test senses.
KINDS = ("kho_b", "kho_a", "kho_c")
META = "(?i)^(?:khi|vì|sau khi|đến)"
SENSES = f"""s0 as (select entry_id, lower(headword) hw, unnest(sources) pos, trim(regexp_replace(definition, '{SP}+', ' ', 'g')) g from entries where definition is not null),
s1 as (select entry_id, hw, pos, case when length(g) > 40 then rtrim(left(g, 39)) || '…' else g end gloss, regexp_matches(g, '{META}') meta, coalesce(nullif(list_position(['kho_b', 'kho_a', 'kho_c'], pos), 0) - 1, 3) p from s0),
s2 as (select *, row_number() over (partition by entry_id order by meta, p, pos) - 1 rank from s1)"""


def _senses(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "entries").filter("definition is not null").select("entry_id", F.lower("headword").alias("hw"), F.explode("sources").alias("pos"), "definition")
    order = F.array(*map(F.lit, KINDS))
    rows = rows.select("entry_id", "hw", "pos", T.clean_gloss("definition", 40).alias("gloss"), T.squeeze("definition").rlike(META.replace("(?i)", "(?iu)")).alias("meta"), F.coalesce(F.nullif(F.array_position(order, F.col("pos")).cast("int"), F.lit(0)) - 1, F.lit(len(KINDS))).alias("p"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("entry_id").orderBy("meta", "p", "pos")) - 1)


@query(f"with {SENSES} select entry_id, hw, pos, gloss, meta, rank from s2")
def sense_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return _senses(spark, sf).select("entry_id", "hw", "pos", "gloss", "meta", F.col("rank").cast("bigint").alias("rank"))


@query(f"with {SENSES}, f as (select *, row_number() over (partition by entry_id, lower(gloss) order by rank) k from s2) select hw, array_to_string(list(gloss order by rank, entry_id, pos), ' | ') senses from f where k = 1 and rank < 8 group by hw")
def senses_grouped(spark: SparkSession, sf: str) -> DataFrame:
    kept = _senses(spark, sf).filter("rank < 8").groupBy("entry_id", "hw", F.lower("gloss").alias("fold")).agg(F.min(F.struct("rank", "entry_id", "pos", "gloss")).alias("s"))
    return kept.groupBy("hw").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["gloss"]), " | ").alias("senses"))


@query("select source, lower(title) title, min(feed_row_id) first_id, count(*) n from raw_articles where title is not null group by 1, 2")
def first_wins_casefold(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_articles").filter("title is not null").groupBy("source", F.lower("title").alias("title")).agg(F.min("feed_row_id").alias("first_id"), F.count("*").alias("n"))


@query("select item_id, array_to_string(list_filter(list_transform(string_split_regex(array_to_string(key_points, '; '), '[;\\n]'), lambda s: trim(s)), lambda s: s <> ''), '|') points from quiz_items where key_points is not null")
def coerced_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "quiz_items").filter("key_points is not null").select("item_id", F.array_join(T.string_list(F.array_join("key_points", "; ")), "|").alias("points"))


@query("""select item_id, v.id version_id, q.ordinal, q.kind from quiz_items q join article_versions v on v.id = q.version_id""")
def exercise_rows(spark: SparkSession, sf: str) -> DataFrame:
    q, v = table(spark, sf, "quiz_items"), table(spark, sf, "article_versions").select(F.col("id").alias("version_id"))
    return q.join(v, "version_id").select("item_id", "version_id", "ordinal", "kind")


@query("""with p as (select version_id, 'vocab' kind, lower(unnest(key_points)) term, item_id from quiz_items where key_points is not null),
f as (select version_id, kind, term, min(item_id) item_id from p where term <> '' group by 1, 2, 3)
select version_id, kind, term, row_number() over (partition by version_id, kind order by item_id, term) - 1 ordinal from f""")
def preteach_rows(spark: SparkSession, sf: str) -> DataFrame:
    terms = table(spark, sf, "quiz_items").select("version_id", F.lit("vocab").alias("kind"), F.explode("key_points").alias("t"), "item_id").select("version_id", "kind", F.lower("t").alias("term"), "item_id")
    first = terms.filter("term <> ''").groupBy("version_id", "kind", "term").agg(F.min("item_id").alias("item_id"))
    ordinal = F.row_number().over(Window.partitionBy("version_id", "kind").orderBy("item_id", "term")) - 1
    return first.select("version_id", "kind", "term", ordinal.cast("bigint").alias("ordinal"))


@query("""with g as (select lower(headword) form, min(definition) gloss from entries group by 1) select doc_id, g.gloss is not null known from documents d left join g on g.form = lower(split_part(d.title, ' ', 1))""")
def preteach_gloss_join(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "entries").groupBy(F.lower("headword").alias("form")).agg(F.min("definition").alias("gloss"))
    d = table(spark, sf, "documents").select("doc_id", F.lower(F.split_part("title", F.lit(" "), F.lit(1))).alias("form"))
    return d.join(g, "form", "left").select("doc_id", F.col("gloss").isNotNull().alias("known"))


@query("""select feed_row_id, published_at as parsed from raw_articles where published_at is not null""")
def feed_date_parse(spark: SparkSession, sf: str) -> DataFrame:
    """RFC 822 dates as feeds write them (three ways of naming the zone) of the stored times, read back as UTC."""
    whole = F.date_trunc("second", "published_at")
    here, there = F.date_format(whole, "EEE, d MMM yyyy HH:mm:ss"), F.date_format(whole + F.expr("interval 7 hours"), "d MMM yyyy HH:mm:ss")
    kind = F.col("feed_row_id") % 3
    text = F.when(kind == 0, F.concat(here, F.lit(" +0000"))).when(kind == 1, F.concat(there, F.lit(" +0700"))).otherwise(F.concat(here, F.lit(" GMT")))
    rows = table(spark, sf, "raw_articles").filter("published_at is not null")
    return rows.select("feed_row_id", (clock.feed_date(text) + (F.col("published_at") - whole)).alias("parsed"))


@query()
def strip_html(spark: SparkSession, sf: str) -> DataFrame:
    """Every feed field as plain text: plain ones, entities, unbalanced and cut tags too, which SQL's expressions cannot parse."""
    return pages.stripped(table(spark, sf, "raw_articles"), "feed_row_id", "summary").select(F.col("key").alias("feed_row_id"), "plain")


@query()
def page_body(spark: SparkSession, sf: str) -> DataFrame:
    """Body of every fetched page, its lines set as paragraphs of one container among furniture."""
    lines = F.transform(F.split("original_text", "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>")))
    html = F.concat(F.lit("<html><nav>Menu</nav><main>"), F.array_join(lines, ""), F.lit("</main><footer>x</footer></html>"))
    return pages.bodies(table(spark, sf, "articles").select("id", html.alias("html")), "id", "html")


@query()
def change_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Share of an article's words that its version changed."""
    v = table(spark, sf, "article_versions").select("id", "article_id", F.col("simplified_text").alias("after"))
    a = table(spark, sf, "articles").select(F.col("id").alias("article_id"), F.col("original_text").alias("before"))
    return pages.change_ratios(v.join(a, "article_id").select("id", "before", "after"))


@query("""
with e as (select user_id, event_type, ts, event_id, try_cast(json_extract_string(props, '$.k') as bigint) k from events where event_type <> 'error')
select user_id, string_agg(event_type, '' order by ts, event_id) as content, last(k order by ts, event_id) as last_usage from e group by user_id""")
def stream_frames_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Content and last usage of framed streams, one per user, made of the events in their order."""
    e = table(spark, sf, "events").filter("event_type <> 'error'")
    delta = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("event_type").alias("content")).alias("delta"))).alias("choices"), F.struct(F.get_json_object("props", "$.k").cast("bigint").alias("total_tokens")).alias("usage")))
    lines = e.select(F.col("user_id").alias("call_id"), F.struct("ts", "event_id").alias("seq"), F.concat(F.lit("data: "), delta).alias("line"))
    return frames.fold(lines).select(F.col("call_id").alias("user_id"), "content", F.col("total_tokens").alias("last_usage"))


@query("""select event_id, try_cast(json_extract_string(props, '$.k') as bigint) k, 'object' as shape from events""")
def tolerant_json(spark: SparkSession, sf: str) -> DataFrame:
    """Objects recovered from fenced and padded text."""
    fence = "```"
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(fence + "json\n"), "props", F.lit("\n" + fence))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Kết quả: "), "props", F.lit(" hết."))).otherwise(F.col("props"))
    found = frames.json_object(text)
    return table(spark, sf, "events").select("event_id", F.get_json_object(found, "$.k").try_cast("bigint").alias("k"), F.when(found.isNotNull(), "object").otherwise("bad").alias("shape"))
