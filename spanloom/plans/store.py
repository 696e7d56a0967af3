"""Queries over keyed storage, work selection, practice items, queues, time policy and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import clock, text as T
from ..operators import keyed, quiz
from ._register import query, table

LEVEL = "upper(regexp_replace(cefr_level, '[^A-Za-z0-9]', '', 'g'))"


def _level() -> Column:
    return F.upper(F.regexp_replace("cefr_level", "[^A-Za-z0-9]", ""))


@query("""
select source, guid, feed_row_id, title from (
  select *, row_number() over (partition by source, guid order by polled_at, feed_row_id) rn from raw_articles) where rn = 1""")
def feed_dedupe_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    feed = table(spark, sf, "raw_articles").select("source", "guid", "feed_row_id", "title", "polled_at")
    return keyed.first_wins(feed, ["source", "guid"], [F.col("polled_at"), F.col("feed_row_id")]).drop("polled_at")


@query("""
select source, count(*) n_rows, count(distinct guid) n_items, max(published_at) newest from
 (select source, guid, published_at from raw_articles union all select source, guid, published_at from articles) group by source""")
def feeds_union(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["source", "guid", "published_at"]
    both = table(spark, sf, "raw_articles").select(*cols).unionByName(table(spark, sf, "articles").select(*cols))
    return both.groupBy("source").agg(F.count("*").alias("n_rows"), F.countDistinct("guid").alias("n_items"), F.max("published_at").alias("newest"))


@query("""select distinct r.source, r.guid from raw_articles r where not exists (select 1 from articles a where a.source = r.source and a.guid = r.guid)""")
def work_selection_new(spark: SparkSession, sf: str) -> DataFrame:
    work = table(spark, sf, "raw_articles").select("source", "guid").distinct()
    return keyed.select_new(work, table(spark, sf, "articles").select("source", "guid"), ["source", "guid"])


@query("""select distinct r.source, r.guid from raw_articles r where exists (select 1 from articles a where a.source = r.source and a.guid = r.guid)""")
def work_selection_refresh(spark: SparkSession, sf: str) -> DataFrame:
    work = table(spark, sf, "raw_articles").select("source", "guid").distinct()
    return keyed.select_refresh(work, table(spark, sf, "articles").select("source", "guid"), ["source", "guid"])


@query("""select id, article_id, prompt_version from article_versions where prompt_version is not null and prompt_version <> 'reading-v3'""")
def work_selection_outdated(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.outdated(table(spark, sf, "article_versions").select("id", "article_id", "prompt_version"), "prompt_version", "reading-v3")


@query("""
select id, body_source, case when length(regexp_replace(regexp_replace(coalesce(original_text, ''), '^[\\t-\\r ]+', ''), '[\\t-\\r ]+$', '')) >= 400 then 'ready' else 'skipped' end status,
 case when length(regexp_replace(regexp_replace(coalesce(original_text, ''), '^[\\t-\\r ]+', ''), '[\\t-\\r ]+$', '')) >= 400 then '' else 'body too short' end reason from articles""")
def length_gate_status(spark: SparkSession, sf: str) -> DataFrame:
    body = F.regexp_replace(F.coalesce("original_text", F.lit("")), r"^[\t-\r ]+|[\t-\r ]+$", "")
    long = F.length(body) >= 400
    return table(spark, sf, "articles").select("id", "body_source", F.when(long, "ready").otherwise("skipped").alias("status"), F.when(long, "").otherwise("body too short").alias("reason"))


@query("""
select source, count_if(body_source = 'full') full_bodies, count_if(body_source = 'rss') feed_bodies, count_if(original_text is null or length(original_text) < 400) short_bodies from articles group by source""")
def run_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    short = F.col("original_text").isNull() | (F.length("original_text") < 400)
    return table(spark, sf, "articles").groupBy("source").agg(F.count_if(F.col("body_source") == "full").alias("full_bodies"), F.count_if(F.col("body_source") == "rss").alias("feed_bodies"), F.count_if(short).alias("short_bodies"))


@query("""select v.id version_id, a.source, a.guid, a.title, coalesce(a.published_at, v.created_at) shown_at from article_versions v join articles a on v.article_id = a.id""")
def versions_joined_newest(spark: SparkSession, sf: str) -> DataFrame:
    v, a = table(spark, sf, "article_versions"), table(spark, sf, "articles")
    joined = v.join(a, v["article_id"] == a["id"]).select(v["id"].alias("version_id"), "source", "guid", "title", F.coalesce(a["published_at"], v["created_at"]).alias("shown_at"))
    return joined.orderBy(F.col("shown_at").desc(), F.col("version_id").desc())


@query(f"""select v.id version_id, a.source, {LEVEL} as level from article_versions v join articles a on v.article_id = a.id where {LEVEL} in ('A2', 'B1') and a.source <> 'doccham'""")
def versions_filtered(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "article_versions").select("id", "article_id", _level().alias("level")).filter(F.col("level").isin("A2", "B1"))
    a = table(spark, sf, "articles").select(F.col("id").alias("article_id"), "source").filter("source <> 'doccham'")
    return v.join(a, "article_id").select(F.col("id").alias("version_id"), "source", "level")


@query("""select entry_id, headword, freq_rank from entries order by freq_rank nulls last, entry_id""")
def ranked_nulls_last(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "entries").select("entry_id", "headword", "freq_rank").orderBy(F.col("freq_rank").asc_nulls_last(), "entry_id")


@query("""select count_if(freq_rank <= 1500 and syllable_count >= 2) kept, count_if(freq_rank > 1500 or freq_rank is null or syllable_count < 2) skipped from entries""")
def rank_filter_skip_count(spark: SparkSession, sf: str) -> DataFrame:
    keep = F.coalesce((F.col("freq_rank") <= 1500) & (F.col("syllable_count") >= 2), F.lit(False))
    return table(spark, sf, "entries").agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("skipped"))


@query("""
with known as (select distinct lower(o) o from (select unnest(options) o from quiz_items) group by 1 having count(*) >= 2 or max(length(o)) > 0),
opts as (select item_id, unnest(options) o from quiz_items where kind = 'mcq')
select item_id from opts left join known on lower(opts.o) = known.o group by item_id having count(*) = 4 and count(known.o) = 4""")
def all_options_known(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "quiz_items")
    known = items.select(F.explode("options").alias("o")).filter("length(o) > 0").select(F.lower("o").alias("known")).distinct()
    opts = items.filter("kind = 'mcq'").select("item_id", F.explode("options").alias("o"))
    joined = opts.join(known, F.lower("o") == F.col("known"), "left")
    return joined.groupBy("item_id").agg(F.count("*").alias("n"), F.count("known").alias("k")).filter("n = 4 and k = 4").select("item_id")


@query("""select item_id, version_id, kind, array_to_string(options, '|') options, answer from (
 select item_id, version_id, kind, answer0, case when ok then list_transform(list_sort(list_transform(options, lambda x, i: {'h': sha256(coalesce(question, '') || chr(31) || coalesce(x, '')), 'i': i - 1, 'x': x})), lambda s: s.x) else options end as options,
  case when ok then list_position(list_transform(list_sort(list_transform(options, lambda x, i: {'h': sha256(coalesce(question, '') || chr(31) || coalesce(x, '')), 'i': i - 1, 'x': x})), lambda s: s.i), answer0) - 1 else answer0 end answer
 from (select *, answer answer0, coalesce(len(options) >= 2 and answer >= 0 and answer < len(options), false) ok from quiz_items))""")
def option_order(spark: SparkSession, sf: str) -> DataFrame:
    moved = quiz.option_order(table(spark, sf, "quiz_items"))
    return moved.select("item_id", "version_id", "kind", F.array_join("options", "|").alias("options"), F.col("answer"))


@query("""
with c as (select answer, count(*) n from quiz_items where kind = 'mcq' and answer >= 0 group by answer)
select answer, n, cast(floor(100 * n / (select sum(n) from c)) as bigint) percent from c""")
def answer_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return quiz.answer_positions(table(spark, sf, "quiz_items"))


@query("""
select version_id, count_if(kind = 'mcq') asked, count_if(kind = 'mcq' and answer = item_id % 4) correct from quiz_items group by version_id""")
def quiz_score(spark: SparkSession, sf: str) -> DataFrame:
    chosen = F.col("item_id") % 4
    choice = F.col("kind") == "mcq"
    return table(spark, sf, "quiz_items").groupBy("version_id").agg(F.count_if(choice).alias("asked"), F.count_if(choice & (F.col("answer") == chosen)).alias("correct"))


STOP = ("các", "được", "có", "ở", "phải", "thêm", "đi")


@query(f"""
select item_id, len(key_points) points, len(list_filter(key_points, lambda p: len(list_filter(string_split(regexp_replace(lower(p), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: length(w) > 1 and not list_contains({list(STOP)!r}, w))) > 0 and
  len(list_filter(list_filter(string_split(regexp_replace(lower(p), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: length(w) > 1 and not list_contains({list(STOP)!r}, w)), lambda w: contains(lower(coalesce(sample, '')), w)))
  >= ceil(len(list_filter(string_split(regexp_replace(lower(p), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: length(w) > 1 and not list_contains({list(STOP)!r}, w))) / 2))) covered
from quiz_items where kind <> 'mcq' and key_points is not null""")
def key_point_coverage(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "quiz_items").filter("kind <> 'mcq' and key_points is not null")
    return items.select("item_id", F.size("key_points").alias("points"), quiz.covered(F.col("key_points"), F.col("sample"), STOP).alias("covered"))


@query("""select item_id, len(string_split_regex(trim(regexp_replace(sample, '[\\t-\\r ]+', ' ', 'g')), ' ')) words, len(string_split_regex(trim(regexp_replace(sample, '[\\t-\\r ]+', ' ', 'g')), ' ')) >= min_words enough
from quiz_items where kind = 'writing' and trim(regexp_replace(sample, '[\\t-\\r ]+', ' ', 'g')) <> ''""")
def word_count_min(spark: SparkSession, sf: str) -> DataFrame:
    squeezed = F.trim(F.regexp_replace("sample", r"[\t-\r ]+", " "))
    items = table(spark, sf, "quiz_items").filter("kind = 'writing'").filter(squeezed != "")
    n = F.size(F.split(squeezed, " "))
    return items.select("item_id", n.alias("words"), (n >= F.col("min_words")).alias("enough"))


@query("""select kind, count(*) n from quiz_items where trim(coalesce(question, '')) <> '' and (kind <> 'mcq' or coalesce(len(options) >= 2 and answer >= 0 and answer < len(options), false)) group by kind""")
def valid_items(spark: SparkSession, sf: str) -> DataFrame:
    return quiz.valid(table(spark, sf, "quiz_items")).groupBy("kind").agg(F.count("*").alias("n"))


@query("""
with ranked as (select source, guid, title, feed_row_id, row_number() over (partition by source, guid order by polled_at, feed_row_id) a, row_number() over (partition by source, guid order by polled_at desc, feed_row_id desc) z, count(*) over (partition by source, guid) n from raw_articles)
select source, guid, feed_row_id, title from ranked where case when n > 1 then z = 1 else a = 1 end""")
def upsert_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """First polls as the stored snapshot, the last poll of items seen again as the incoming rows."""
    feed = table(spark, sf, "raw_articles").select("source", "guid", "feed_row_id", "title", "polled_at")
    order = F.struct("polled_at", "feed_row_id")
    row = F.struct("feed_row_id", "title")
    seen = feed.groupBy("source", "guid").agg(F.min_by(row, order).alias("a"), F.max_by(row, order).alias("z"), F.count("*").alias("n"))
    existing = seen.select("source", "guid", "a.*")
    incoming = seen.filter("n > 1").select("source", "guid", "z.*")
    return keyed.upsert(existing, incoming, ["source", "guid"])


@query("""
with p as (select distinct version_id from quiz_items q join article_versions v on v.id = q.version_id where exercises_prompt_version <> 'exercises-v2' and kind = 'mcq')
select version_id, item_id, 'old' origin from quiz_items where version_id not in (select version_id from p)
union all select version_id, item_id, 'new' from quiz_items where version_id in (select version_id from p) and kind = 'mcq'""")
def replace_children(spark: SparkSession, sf: str) -> DataFrame:
    """Items of versions with an outdated prompt are replaced by their choices only."""
    q = table(spark, sf, "quiz_items").select("version_id", "item_id", "kind")
    stale = table(spark, sf, "article_versions").filter("exercises_prompt_version <> 'exercises-v2'").select(F.col("id").alias("version_id"))
    new = q.filter("kind = 'mcq'").join(stale, "version_id", "left_semi").select("version_id", "item_id", F.lit("new").alias("origin"))
    return keyed.replace_children(q.select("version_id", "item_id", F.lit("old").alias("origin")), new, "version_id")


@query("""
select source, guid, id from articles union all select source, guid, feed_row_id from (
 select source, guid, min(feed_row_id) feed_row_id from raw_articles group by source, guid) r where not exists (select 1 from articles a where a.source = r.source and a.guid = r.guid)""")
def insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    have = table(spark, sf, "articles").select("source", "guid", "id")
    feed = table(spark, sf, "raw_articles").groupBy("source", "guid").agg(F.min("feed_row_id").alias("id"))
    return keyed.insert_absent(have, feed, ["source", "guid"])


@query("""select id, case when contains(coalesce(notes, ''), 're-segmented') then coalesce(notes, '') when coalesce(notes, '') = '' then 're-segmented' else notes || '; re-segmented' end notes from article_versions""")
def note_append(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "article_versions").select("id", keyed.append_note(F.col("notes"), "re-segmented").alias("notes"))


@query("""select sha256(source || chr(31) || guid || chr(31) || coalesce(title, '')) key, min(feed_row_id) first_id, max(feed_row_id) last_id from raw_articles group by 1""")
def cache_key_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    key = F.sha2(F.concat_ws("\u001f", "source", "guid", F.coalesce("title", F.lit(""))), 256)
    return table(spark, sf, "raw_articles").groupBy(key.alias("key")).agg(F.min("feed_row_id").alias("first_id"), F.max("feed_row_id").alias("last_id"))


@query("""select user_id, event_type status from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn = 1""")
def queue_latest_status(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.latest_status(table(spark, sf, "events").withColumnRenamed("event_type", "status"), "user_id", "status", ["ts", "event_id"])


@query("""select user_id from (select user_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn = 1 and event_type in ('view', 'click')""")
def queue_pending(spark: SparkSession, sf: str) -> DataFrame:
    return queue_latest_status(spark, sf).filter(F.col("status").isin("view", "click")).select("user_id")


@query("""select cast(ts as date) as day, event_id, rn as run from (select *, row_number() over (partition by cast(ts as date), event_type order by ts, event_id) rn from events where event_type = 'purchase') where rn <= 6""")
def daily_cap(spark: SparkSession, sf: str) -> DataFrame:
    day = F.to_date("ts")
    runs = table(spark, sf, "events").filter("event_type = 'purchase'").withColumn("day", day)
    ranked = runs.withColumn("run", F.row_number().over(Window.partitionBy("day").orderBy("ts", "event_id")))
    return ranked.filter("run <= 6").select("day", "event_id", "run")


@query("""select cast(ts as date) as day, event_type, count(*) n, round(sum(value), 2) total from events group by 1, 2""")
def utc_day_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


HOURS, DAYS, CHEAP = [(8, 12), (13, 18)], {0, 1, 2, 3, 4}, ("2024-01-01",)
_PEAK = "(((hour({0}) >= 8 and hour({0}) < 12) or (hour({0}) >= 13 and hour({0}) < 18)) and isodow({0}) <= 5 and strftime({0}, '%Y-%m-%d') <> '2024-01-01')"


@query(f"""select event_id, {_PEAK.format('ts')} peak from events""")
def peak_flag(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", clock.is_peak(F.col("ts"), HOURS, DAYS, CHEAP).alias("peak"))


@query(f"""select event_id, list_filter(list_transform(range(0, 192), lambda k: date_trunc('hour', ts) + to_hours(k)), lambda h: not {_PEAK.format('h')})[1] next_cheap from events""")
def next_offpeak(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", clock.next_offpeak(F.col("ts"), HOURS, DAYS, CHEAP).alias("next_cheap"))


@query("""select event_type, sum(coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 0)) total_k, count_if(try_cast(json_extract_string(props, '$.k') as bigint) is null) unusable from events group by event_type""")
def usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(F.coalesce(k, F.lit(0))).alias("total_k"), F.count_if(k.isNull()).alias("unusable"))


@query("""
with v as (select id, article_id, length(simplified_text) chars from article_versions),
q as (select version_id, count_if(kind <> 'writing') questions, bool_or(kind = 'writing') writing from quiz_items group by version_id)
select v.id version_id, a.source, a.title, a.attribution, v.chars, coalesce(q.questions, 0) questions, coalesce(q.writing, false) writing from v join articles a on a.id = v.article_id left join q on q.version_id = v.id""")
def bundle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "article_versions").select(F.col("id").alias("version_id"), "article_id", F.length("simplified_text").alias("chars"))
    a = table(spark, sf, "articles").select(F.col("id").alias("article_id"), "source", "title", "attribution")
    q = table(spark, sf, "quiz_items").groupBy("version_id").agg(F.count_if(F.col("kind") != "writing").alias("questions"), F.bool_or(F.col("kind") == "writing").alias("writing"))
    joined = v.join(a, "article_id").join(q, "version_id", "left")
    return joined.select("version_id", "source", "title", "attribution", "chars", F.coalesce("questions", F.lit(0)).alias("questions"), F.coalesce("writing", F.lit(False)).alias("writing"))


@query()
def bundle_json(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON bundle per version: its article, text and ordered items."""
    v = table(spark, sf, "article_versions")
    a = table(spark, sf, "articles").select(F.col("id").alias("article_id"), "source", "title", "source_url", "attribution")
    item = F.struct("ordinal", "item_id", "kind", "question", "options", "answer", "why", "sample", "key_points", "min_words")
    items = table(spark, sf, "quiz_items").groupBy("version_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    joined = v.join(a, "article_id").join(items, v["id"] == items["version_id"], "left")
    body = F.to_json(F.struct(v["id"].alias("version_id"), _level().alias("level"), "source", "title", "source_url", "attribution", F.coalesce("simplified_text", F.lit("")).alias("text"), "items"))
    return joined.select(v["id"].alias("version_id"), body.alias("bundle"))


@query(f"""select source, list_aggregate(list_sort(list(distinct {LEVEL})), 'string_agg', ',') levels from article_versions v join articles a on a.id = v.article_id where {LEVEL} <> '' group by source""")
def sorted_levels(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "article_versions").select("article_id", _level().alias("level")).filter("level <> ''").distinct()
    a = table(spark, sf, "articles").select(F.col("id").alias("article_id"), "source")
    return v.join(a, "article_id").groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("level")), ",").alias("levels"))


@query("""
select item_id, case when len(options) > 0 then len(options) end n_encoded, options is not null and len(options) > 0 kept from quiz_items""")
def json_array_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    encoded = F.when(F.size("options") > 0, F.to_json("options"))
    back = F.from_json(encoded, "array<string>")
    return table(spark, sf, "quiz_items").select("item_id", F.when(back.isNotNull(), F.size(back)).alias("n_encoded"), back.eqNullSafe(F.when(F.size("options") > 0, F.col("options"))).__and__(encoded.isNotNull()).alias("kept"))


@query("""select o_orderkey, greatest(1, least(20, coalesce(try_cast(regexp_extract(o_orderpriority, '^[0-9]+') as int), 5) * 7)) lim from orders""")
def input_clamp(spark: SparkSession, sf: str) -> DataFrame:
    n = F.coalesce(F.regexp_extract("o_orderpriority", "^[0-9]+", 0).try_cast("int"), F.lit(5)) * 7
    return table(spark, sf, "orders").select("o_orderkey", F.greatest(F.lit(1), F.least(F.lit(20), n)).alias("lim"))


@query("""select l_orderkey, l_linenumber, greatest(0, least(cast(l_quantity as int), 30)) i, greatest(greatest(0, least(cast(l_quantity as int), 30)) + 1, least(cast(l_tax * 1000 as int), 31)) j from lineitem""")
def selection_clamp(spark: SparkSession, sf: str) -> DataFrame:
    i = F.greatest(F.lit(0), F.least(F.col("l_quantity").cast("int"), F.lit(30)))
    j = F.greatest(i + 1, F.least(F.round(F.col("l_tax") * 1000).cast("int"), F.lit(31)))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", i.alias("i"), j.alias("j"))


@query("""select event_id, case when value is not null and k is not null and k > value then 'crop' when value is null or k is null then 'whole' else 'invalid' end crop, case when value <= 0.02 then null else value end start_at from (select *, try_cast(json_extract_string(props, '$.k') as double) k from events)""")
def crop_validity(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("double")
    crop = F.when(F.col("value").isNotNull() & k.isNotNull() & (k > F.col("value")), "crop").when(F.col("value").isNull() | k.isNull(), "whole").otherwise("invalid")
    return table(spark, sf, "events").select("event_id", crop.alias("crop"), F.when(F.col("value") <= 0.02, F.lit(None)).otherwise(F.col("value")).alias("start_at"))


@query("""select event_id, try_cast(regexp_extract(line, 'max_volume: (-?[0-9.]+) dB', 1) as double) db from (select event_id, 'x max_volume: -' || cast(value as varchar) || ' dB' line from events) where try_cast(regexp_extract(line, 'max_volume: (-?[0-9.]+) dB', 1) as double) >= -15""")
def peak_gate(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.lit("x max_volume: -"), F.col("value").cast("string"), F.lit(" dB"))
    level = F.regexp_extract(line, r"max_volume: (-?[0-9.]+) dB", 1).try_cast("double")
    return table(spark, sf, "events").select("event_id", level.alias("db")).filter("db >= -15")
