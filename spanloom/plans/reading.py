"""Queries over a reader's whole way: ingest with statuses, token repair, selections, lookups with fallbacks, queue states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import clock, text as T
from ..functions.arrow import composed
from ..operators import keyed, pages, quiz, spans as S
from . import spans as P
from . import store  # noqa: F401  (its SQL is used here)
from ._register import ORACLES, query, table

#: Fewest characters of a body that is worth reading.
FLOOR = 400
_BODY = "trim(regexp_replace(coalesce({0}, ''), '^[\\t-\\r ]+|[\\t-\\r ]+$', '', 'g'))"
INGEST = f"""f as (select source, guid, max(length({_BODY.format("summary")})) feed_chars, bool_or(url is null or url = '') linkless from raw_articles group by source, guid),
a as (select source, guid, max(case when body_source = 'full' then length({_BODY.format("original_text")}) end) full_chars, count(*) stored from articles group by source, guid),
v as (select a.source, a.guid, count(*) versions from articles a join article_versions v on v.article_id = a.id group by 1, 2),
s as (select f.source, f.guid, case when coalesce(full_chars, 0) >= {FLOOR} then 'full' else 'rss' end body_source, case when coalesce(full_chars, 0) >= {FLOOR} then full_chars else coalesce(feed_chars, 0) end chars, stored is not null known, coalesce(versions, 0) versions, linkless
 from f left join a on a.source = f.source and a.guid = f.guid left join v on v.source = f.source and v.guid = f.guid),
i as (select source, guid, body_source, case when linkless then 'failed' when versions > 0 then 'duplicate' when chars < {FLOOR} then 'skipped' when known then 'refreshed' else 'ingested' end status,
 case when linkless then 'no link' when versions > 0 then 'already rewritten' when chars = 0 then 'no body' when chars < {FLOOR} then 'body too short' else '' end reason from s)"""


def _stripped_length(column: str) -> Column:
    return F.length(F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), r"^[\t-\r ]+|[\t-\r ]+$", "")))


@query(f"with {INGEST} select source, guid, body_source, status, reason from i")
def ingest_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """What a run does with every item of the feeds: the body it takes (the page's, else the feed's), its status and why."""
    feed = table(spark, sf, "raw_articles").groupBy("source", "guid").agg(F.max(_stripped_length("summary")).alias("feed_chars"), F.bool_or(F.col("url").isNull() | (F.col("url") == "")).alias("linkless"))
    articles = table(spark, sf, "articles")
    full = F.when(F.col("body_source") == "full", _stripped_length("original_text"))
    stored = articles.groupBy("source", "guid").agg(F.max(full).alias("full_chars"), F.lit(True).alias("known"))
    done = articles.select("id", "source", "guid").join(table(spark, sf, "article_versions").select(F.col("article_id").alias("id")), "id").groupBy("source", "guid").agg(F.count("*").alias("versions"))
    state = feed.join(stored, ["source", "guid"], "left").join(done, ["source", "guid"], "left")
    whole = F.coalesce("full_chars", F.lit(0)) >= FLOOR
    chars = F.when(whole, F.col("full_chars")).otherwise(F.coalesce("feed_chars", F.lit(0)))
    rewritten, known = F.coalesce("versions", F.lit(0)) > 0, F.coalesce("known", F.lit(False))
    status = F.when(F.col("linkless"), "failed").when(rewritten, "duplicate").when(chars < FLOOR, "skipped").when(known, "refreshed").otherwise("ingested")
    reason = F.when(F.col("linkless"), "no link").when(rewritten, "already rewritten").when(chars == 0, "no body").when(chars < FLOOR, "body too short").otherwise("")
    return state.select("source", "guid", F.when(whole, "full").otherwise("rss").alias("body_source"), status.alias("status"), reason.alias("reason"))


@query(f"with {INGEST} select source, count_if(status = 'ingested') ingested, count_if(status = 'refreshed') refreshed, count_if(status = 'duplicate') duplicates, count_if(status = 'failed') failed, count_if(status = 'skipped') skipped from i group by source")
def ingest_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome counts of a run per source."""
    names = {"ingested": "ingested", "refreshed": "refreshed", "duplicates": "duplicate", "failed": "failed", "skipped": "skipped"}
    return ingest_statuses(spark, sf).groupBy("source").agg(*(F.count_if(F.col("status") == s).alias(n) for n, s in names.items()))


@query()
def transcription_warning(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of the levels A1 to B2 that change less than a twentieth of their article's words: copies, not rewrites."""
    v = table(spark, sf, "article_versions").select("id", "article_id", F.col("simplified_text").alias("after"), F.upper(F.regexp_replace("cefr_level", "[^A-Za-z0-9]", "")).alias("level"))
    a = table(spark, sf, "articles").select(F.col("id").alias("article_id"), F.col("original_text").alias("before"))
    low = v.filter(F.col("level").isin("A1", "A2", "B1", "B2")).join(a, "article_id").select("id", "before", "after")
    return pages.change_ratios(low).select(F.col("id").alias("version_id"), "ratio", (F.col("ratio") < 0.05).alias("warned"))


_RETOLD = """k as (select key, i as first, z as last, case z - i when 1 then w else f2 end form, case z - i when 1 then false else list_contains({0}, w) and list_contains({0}, w1) and coalesce(g.gloss, '') = '' end refused
 from bspans join ospans using (key, i) left join w g on g.form = f2)"""


@query(f"""with recursive {P.UNITS}, {P.LEX}, {P.RECONCILED}, {_RETOLD.format(P._STOPS)},
o as (select key, first, last, form, false split from k where not refused union all
 select key, first + d, first + d + 1, string_split(form, '_')[d + 1], true from k, range(2) x(d) where refused)
select key, cast(row_number() over (partition by key order by first) - 1 as int) ordinal, cast(first as int) as first, cast(last as int) as last, form, split from o""")
def resegment_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Stored token maps (the second segmentation's) with refused tokens split into single units, all others untouched."""
    stored = S.tiles(P._versions(spark, sf), "key", "simplified_text", P.by_vowel)
    return S.repaired(stored, P._words(spark, sf), P._sizes(spark, sf))


# Selections: four ranges of units per text, chosen by the key.
_PICKS = """n as (select key, count(*) n from u group by key),
sel as (select distinct key, cast((key * 7 + k * 13) % n as int) as first, cast(least((key * 7 + k * 13) % n + 1 + k % 3, n) as int) as last from n, range(4) r(k))"""


def _selections(spark: SparkSession, sf: str) -> DataFrame:
    sizes = P._sizes(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    first = (F.col("key") * 7 + F.col("k") * 13) % F.col("n")
    return sizes.select("key", first.cast("int").alias("first"), F.least(first + 1 + F.col("k") % 3, F.col("n")).cast("int").alias("last")).distinct()


@query(f"""with recursive {P.UNITS}, {P.LEX}, {P.RECONCILED}, {_PICKS}
select s.key, s.first, s.last, s.form, s.source <> 'first' locked from sel join spans s using (key, first, last)""")
def token_exact_range(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens that are exactly the selected range of units."""
    return _selections(spark, sf).join(P.reconcile_spans(spark, sf).hint("merge"), ["key", "first", "last"]).select("key", "first", "last", "form", "locked")


# The cache that lookups fill: answers by the hash of text and surface, of which the last one counts.
_CACHE = "cache as (select sha256(cast(key as varchar) || chr(31) || lower(unit)) k, lower(unit) || ' ' || max(ordinal) answer from u where ordinal % 5 = 0 group by key, lower(unit))"


def _cache(spark: SparkSession, sf: str) -> DataFrame:
    puts = P._units(spark, sf).filter("ordinal % 5 = 0").select(_cache_key(F.col("key"), F.lower("unit")).alias("k"), F.concat_ws(" ", F.lower("unit"), F.col("ordinal")).alias("answer"), "ordinal")
    return keyed.cache_put(None, puts, "k", "answer", "ordinal")


def _cache_key(key: Column, surface: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", key.cast("string"), surface), 256)


@query(f"""with recursive {P.UNITS}, {P.LEX}, {P.RECONCILED}, {P.RUNS}, {_PICKS}, {_CACHE},
words as (select s.key, s.first, s.last, string_agg(lower(u.unit), '_' order by u.ordinal) form from sel s join u on u.key = s.key and u.ordinal >= s.first and u.ordinal < s.last group by 1, 2, 3),
x as (select s.key, s.first, s.last, s.form, case when t.form is not null then w.gloss end stored, case when s.last - s.first > 1 then l.gloss end looked, c.answer
 from words s left join spans t using (key, first, last) left join w on w.form = t.form
 left join (select distinct r.key, r.first, r.last, w.gloss from runs r join w on w.form = r.form) l on l.key = s.key and l.first = s.first and l.last = s.last left join cache c on c.k = sha256(cast(s.key as varchar) || chr(31) || s.form))
select key, first, last, form, coalesce(stored, looked, answer) definition, case when stored is not null then 'token' when looked is not null then 'lookup' when answer is not null then 'cache' else 'none' end source from x""")
def selection_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Definition of each selected range: the exact token's, else the lookup index's, else the cache's, else none."""
    picks = _selections(spark, sf)
    words = _words_of(spark, sf, picks)
    tokens = P.reconcile_spans(spark, sf).select("key", "first", "last", F.col("form").alias("token"))
    glosses = P._words(spark, sf)
    stored = glosses.select(F.col("form").alias("token"), F.col("gloss").alias("stored"))
    index = S.dictionary_runs(P._versions(spark, sf), "key", "simplified_text", glosses, compounds=6).select("key", "first", "last", F.col("gloss").alias("looked"))
    # Tokens, runs and the cache are as many as the units of all texts, which the planner does not know: they are merged.
    joined = words.join(tokens.hint("merge"), ["key", "first", "last"], "left").join(stored, "token", "left").join(index.hint("merge"), ["key", "first", "last"], "left")
    joined = joined.withColumn("k", _cache_key(F.col("key"), F.col("form"))).join(_cache(spark, sf).hint("merge"), "k", "left")
    source = F.when(F.col("stored").isNotNull(), "token").when(F.col("looked").isNotNull(), "lookup").when(F.col("answer").isNotNull(), "cache").otherwise("none")
    return joined.select("key", "first", "last", "form", F.coalesce("stored", "looked", "answer").alias("definition"), source.alias("source"))


def _words_of(spark: SparkSession, sf: str, picks: DataFrame) -> DataFrame:
    """(key, first, last, form): ranges with their units' form; a range has three units at most."""
    units = P._units(spark, sf).select("key", "ordinal", F.lower("unit").alias("low"))
    each = picks.withColumn("ordinal", F.explode(F.sequence(F.col("first"), F.col("last") - 1))).join(units.hint("merge"), ["key", "ordinal"])
    form = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "low"))), lambda x: x["low"]), "_")
    return each.groupBy("key", "first", "last").agg(form.alias("form"))


@query(f"""with recursive {P.UNITS}, {P.LEX}, {P.RECONCILED}, {P.PROBES}, {_CACHE}, q as (select distinct key, off from p),
c as (select q.key, q.off, s.form, w.gloss from q left join spans s on s.key = q.key and s.start <= q.off and s.stop > q.off left join w on w.form = s.form)
select c.key, c.off as "offset", coalesce(c.form, '') form, coalesce(c.gloss, h.answer) definition, case when c.gloss is not null then 'stored' when h.answer is not null then 'cache' else 'none' end source
from c left join cache h on h.k = sha256(cast(c.key as varchar) || chr(31) || c.form)""")
def resolve_offset(spark: SparkSession, sf: str) -> DataFrame:
    """Definition under each offset: the covering token's stored one, else the cached answer, else none (nothing is asked)."""
    probes = P._probes(P._texts(spark, sf)).distinct()
    hit = S.holding(P._spans_of(spark, sf).select("key", "start", "end", "form"), probes).select("key", "offset", "form")
    found = probes.join(hit.hint("merge"), ["key", "offset"], "left").join(P._words(spark, sf).select("form", "gloss"), "form", "left")
    found = found.withColumn("k", _cache_key(F.col("key"), F.col("form"))).join(_cache(spark, sf).hint("merge"), "k", "left")
    source = F.when(F.col("gloss").isNotNull(), "stored").when(F.col("answer").isNotNull(), "cache").otherwise("none")
    return found.select("key", "offset", F.coalesce("form", F.lit("")).alias("form"), F.coalesce("gloss", "answer").alias("definition"), source.alias("source"))


@query(f"""with {P.LEX}, t as (select distinct unnest(options) o from quiz_items), c as (select o, nfc_normalize(o) n from t where o <> ''),
k as (select o, lower(replace(trim(regexp_replace(n, '[\\t-\\r ]+', ' ', 'g')), ' ', '_')) a, replace(n, ' ', '_') b, lower(regexp_extract(n, '{P.U}')) c from c)
select o, coalesce(x.gloss, y.gloss, z.gloss) definition, case when x.gloss is not null then 'form' when y.gloss is not null then 'raw' when z.gloss is not null then 'unit' else 'none' end source
from k left join w x on x.form = k.a left join w y on y.form = k.b left join w z on z.form = k.c""")
def definition_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Definition by keys in order: the form, the form in its own case, the first unit alone; the first with a text wins."""
    options = table(spark, sf, "quiz_items").select(F.explode("options").alias("o")).filter("o <> ''").distinct().withColumn("n", F.col("o"))
    options = composed(options, "n")
    keys = {"form": F.lower(F.translate(F.trim(F.regexp_replace("n", r"[\t-\r ]+", " ")), " ", "_")), "raw": F.translate("n", " ", "_"), "unit": F.lower(F.regexp_extract("n", T.UNIT, 0))}
    return keyed.first_found(options, keys, P._words(spark, sf).select("form", "gloss"), "form", "gloss").select("o", F.col("gloss").alias("definition"), "source")


@query("""with s as (select entry_id, definition, sources from entries where definition is not null and len(sources) > 0)
select entry_id, array_to_string(sources[2:5], '|') token_extras, array_to_string(sources[2:4], '|') lookup_extras from s""")
def extra_senses(spark: SparkSession, sf: str) -> DataFrame:
    """Senses beyond the first: up to four for a token, up to three for a lookup."""
    rows = table(spark, sf, "entries").filter("definition is not null and size(sources) > 0")
    return rows.select("entry_id", F.array_join(F.slice("sources", 2, 4), "|").alias("token_extras"), F.array_join(F.slice("sources", 2, 3), "|").alias("lookup_extras"))


@query("""select feed_row_id, source, cast(row_number() over (partition by source order by coalesce(strftime(published_at, '%Y-%m-%dT%H:%M:%S'), '') desc, guid desc, feed_row_id desc) as int) place from raw_articles""")
def feed_newest_first(spark: SparkSession, sf: str) -> DataFrame:
    """Place of every item in its source's feed: newest first, undated ones last, then by guid. One source is one listing."""
    shown = F.coalesce(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    place = F.row_number().over(Window.partitionBy("source").orderBy(shown.desc(), F.col("guid").desc(), F.col("feed_row_id").desc()))
    return table(spark, sf, "raw_articles").select("feed_row_id", "source", place.alias("place"))


@query("""(select 'five' kind, entry_id from entries order by freq_rank nulls last, entry_id limit 5) union all select 'all', entry_id from entries union all select 'none', entry_id from entries""")
def limit_or_all(spark: SparkSession, sf: str) -> DataFrame:
    """A limit after a total order, where 0 and None mean all rows."""
    entries = table(spark, sf, "entries").select("entry_id", "freq_rank")
    order = [F.col("freq_rank").asc_nulls_last(), F.col("entry_id")]
    parts = [keyed.limited(entries, order, n).select(F.lit(kind).alias("kind"), "entry_id") for kind, n in (("five", 5), ("all", 0), ("none", None))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""select item_id, array_to_string(list_filter(list_transform(options, lambda t: len(regexp_extract_all(replace(coalesce(t, ''), '_', ' '), '{P.U}'))), lambda n: n > 0), ',') counts from quiz_items where options is not null""")
def grouping_from_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Units per token of a list of tokens; tokens without units have none."""
    counts = F.filter(F.transform("options", lambda t: T.words_in_chunk(F.coalesce(t, F.lit("")))), lambda n: n > 0)
    return table(spark, sf, "quiz_items").filter("options is not null").select("item_id", F.array_join(F.transform(counts, lambda n: n.cast("string")), ",").alias("counts"))


@query("""with f as (select source, guid, arg_max(summary, (length(summary), feed_row_id)) summary from raw_articles where summary is not null group by 1, 2)
select a.id, case when f.summary is not null and a.body_source = 'rss' and length(f.summary) > length(coalesce(a.original_text, '')) then f.summary else a.original_text end original_text,
 coalesce(f.summary is not null and a.body_source = 'rss' and length(f.summary) > length(coalesce(a.original_text, '')), false) updated from articles a left join f on f.source = a.source and f.guid = a.guid""")
def update_body(spark: SparkSession, sf: str) -> DataFrame:
    """Feed bodies replaced in place by the longest summary that the feed ever gave, where that is longer."""
    feed = table(spark, sf, "raw_articles").filter("summary is not null").groupBy("source", "guid").agg(F.max_by("summary", F.struct(F.length("summary"), "feed_row_id")).alias("summary"))
    articles = table(spark, sf, "articles").select("id", "source", "guid", "body_source", "original_text")
    longer = (F.col("body_source") == "rss") & (F.length("summary") > F.length(F.coalesce("original_text", F.lit(""))))
    better = articles.join(feed, ["source", "guid"]).filter(longer).select("id", F.col("summary").alias("original_text"))
    return keyed.updated(articles.select("id", "original_text"), better, ["id"])


@query(f"""with m as ({ORACLES["option_order"]}), q as (select item_id, array_to_string(options, '|') options0, answer answer0 from quiz_items)
select item_id, answer0 as before, m.answer as after from m join q using (item_id) where m.options is distinct from options0 or m.answer is distinct from answer0""")
def reorder_dry_run(spark: SparkSession, sf: str) -> DataFrame:
    """What a reordering of options would change, without changing it: answers before and after, of changed items only."""
    items = table(spark, sf, "quiz_items").select("item_id", "question", "options", "answer")
    moved = quiz.option_order(items).select("item_id", F.col("options").alias("o"), F.col("answer").alias("after"))
    changed = ~(F.col("o").eqNullSafe(F.col("options")) & F.col("after").eqNullSafe(F.col("answer")))
    return items.join(moved, "item_id").filter(changed).select("item_id", F.col("answer").alias("before"), "after")


# Queue log: purchases approve, errors reject, signups install; all other events submit.
_STATES = """d as (select user_id, arg_max(event_type = 'purchase', (ts, event_id)) filter (where event_type in ('purchase', 'error')) approved,
 max((ts, event_id)) filter (where event_type = 'purchase') approved_at, max((ts, event_id)) filter (where event_type = 'signup') installed_at from events group by user_id),
s as (select user_id, approved, coalesce(approved and installed_at > approved_at, false) installed from d)"""


def _states(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.queue_states(table(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"], approve="purchase", reject="error", install="signup")


@query(f"with {_STATES} select user_id, approved, installed from s")
def queue_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """State of every queue entry after its decisions and installations; an approval after an installation asks for a new one."""
    return _states(spark, sf)


@query(f"with {_STATES} select user_id from s where approved and not installed")
def queue_installable(spark: SparkSession, sf: str) -> DataFrame:
    """Approved entries that are not installed."""
    return _states(spark, sf).filter("approved and not installed").select("user_id")


@query(f"with {_STATES} select case when approved is null then 'pending' when not approved then 'rejected' when installed then 'installed' else 'approved' end scan, count(*) n, min(user_id) first_id from s group by 1")
def queue_scans(spark: SparkSession, sf: str) -> DataFrame:
    """Entries in each scan of the queue and the first of each."""
    scan = F.when(F.col("approved").isNull(), "pending").when(~F.col("approved"), "rejected").when(F.col("installed"), "installed").otherwise("approved")
    return _states(spark, sf).groupBy(scan.alias("scan")).agg(F.count("*").alias("n"), F.min("user_id").alias("first_id"))


@query("""with d as (select nfc_normalize(lower(headword)) hw, max(entry_id) entry_id from entries group by 1) select d.hw headword, e.entry_id, e.display, e.syllable_count from d join entries e using (entry_id)""")
def dictionary_load(spark: SparkSession, sf: str) -> DataFrame:
    """A word list loaded anew: later entries of a headword replace earlier ones."""
    rows = composed(table(spark, sf, "entries").select("headword", "entry_id", "display", "syllable_count"), "headword").withColumn("headword", F.lower("headword"))
    return keyed.last_wins(rows, ["headword"], [F.col("entry_id")])


_HOURS, _DAYS, _CHEAP = clock.windows("01:00-04:00,06:00-10:00"), clock.weekdays("Mon,Tue,Wed,Thu,Fri"), ("2024-01-01", "2024-01-03")
_DEAR = "(((hour({0}) >= 1 and hour({0}) < 4) or (hour({0}) >= 6 and hour({0}) < 10)) and isodow({0}) <= 5 and strftime({0}, '%Y-%m-%d') not in ('2024-01-01', '2024-01-03'))"


@query(f"""with e as (select event_id, ts, {_DEAR.format("ts")} peak, list_filter(list_transform(range(0, 192), lambda k: date_trunc('hour', ts) + to_hours(k)), lambda h: not {_DEAR.format("h")})[1] opens from events)
select event_id, not peak allowed, case when peak then 'PEAK now (' || strftime(ts, '%Y-%m-%d %H:%M') || ' UTC) — off-peak resumes ' || strftime(opens, '%Y-%m-%d %H:%M') || ' UTC (in ' || date_diff('hour', date_trunc('hour', ts), opens) || 'h)' else 'off-peak now (' || strftime(ts, '%Y-%m-%d %H:%M') || ' UTC)' end status from e""")
def peak_status(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a paid run may start at each time, and the line that says so."""
    ts = F.col("ts")
    return table(spark, sf, "events").select("event_id", (~clock.is_peak(ts, _HOURS, _DAYS, _CHEAP)).alias("allowed"), clock.status(ts, _HOURS, _DAYS, _CHEAP).alias("status"))


@query("""with q as (select version_id, item_id, options, answer from quiz_items where kind = 'mcq' and len(options) > 0 and len(list_filter(options, lambda o: o is null)) = 0),
v as (select version_id, list_sort(list_distinct(flatten(list(options)))) d, list_sort(list({'i': item_id, 'o': options, 'a': answer})) items from q group by version_id)
select version_id, cast(to_json({'options': d, 'items': list_transform(items, lambda x: {'i': x.i, 'o': list_transform(x.o, lambda y: list_position(d, y) - 1), 'a': x.a})}) as varchar) document from v""")
def drill_document(spark: SparkSession, sf: str) -> DataFrame:
    """Compact JSON per version: its options once, sorted, and its items with options by their place among them."""
    whole = (F.col("kind") == "mcq") & (F.size("options") > 0) & F.forall("options", lambda o: o.isNotNull())
    items = table(spark, sf, "quiz_items").filter(whole)
    listed = items.groupBy("version_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("options")))).alias("d"), F.array_sort(F.collect_list(F.struct(F.col("item_id").alias("i"), F.col("options").alias("o"), F.col("answer").alias("a")))).alias("items"))
    coded = F.transform("items", lambda x: F.struct(x["i"].alias("i"), F.transform(x["o"], lambda y: F.array_position("d", y) - 1).alias("o"), x["a"].alias("a")))
    return listed.select("version_id", F.to_json(F.struct(F.col("d").alias("options"), coded.alias("items")), {"ignoreNullFields": "false"}).alias("document"))


@query("""with s as (select entry_id, replace(lower(headword), ' ', '_') || ' ' || coalesce(definition, '') g from entries)
select entry_id, trim(regexp_replace(replace(g, '_', ' '), '[\\t-\\r ]+', ' ', 'g')) plain, len(regexp_extract_all(replace(g, '_', ' '), '[\\p{L}\\p{N}_]+')) units from s""")
def grouping_plain(spark: SparkSession, sf: str) -> DataFrame:
    """Plain text of an underscore-joined segmentation, and its units."""
    plain = F.trim(F.regexp_replace(F.translate(P._segmented(), "_", " "), r"[\t-\r ]+", " "))
    return table(spark, sf, "entries").select("entry_id", plain.alias("plain"), F.size(T.units(plain)).alias("units"))


@query(f"""with recursive {P.UNITS}, {P.LEX}, {P.RECONCILED}, {P.RUNS},
n as (select key, count(*) units from u group by key), s as (select key, count(*) tokens, count_if(source = 'first') ambiguous from spans group by key),
l as (select key, count(*) lookups from runs join w on runs.form = w.form where last - first <= 4 or gloss is not null group by key),
q as (select version_id key, count_if(kind <> 'writing') questions, bool_or(kind = 'writing') writing from quiz_items group by 1)
select n.key, units, tokens, ambiguous, coalesce(lookups, 0) lookups, coalesce(questions, 0) questions, coalesce(writing, false) writing from n join s using (key) left join l using (key) left join q using (key)""")
def manifest_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of a version's units, tokens, ambiguous tokens, lookup spans and questions, and whether it has a writing task."""
    units = P._sizes(spark, sf).select("key", F.col("n").cast("bigint").alias("units"))
    tokens = S.summary(P._spans_of(spark, sf)).select("key", F.col("total").alias("tokens"), "ambiguous")
    lookups = P.ngram_lookup_index(spark, sf).groupBy("key").agg(F.count("*").alias("lookups"))
    asked = table(spark, sf, "quiz_items").groupBy(F.col("version_id").alias("key")).agg(F.count_if(F.col("kind") != "writing").alias("questions"), F.bool_or(F.col("kind") == "writing").alias("writing"))
    joined = units.join(tokens, "key").join(lookups, "key", "left").join(asked, "key", "left")
    return joined.select("key", "units", "tokens", "ambiguous", F.coalesce("lookups", F.lit(0)).alias("lookups"), F.coalesce("questions", F.lit(0)).alias("questions"), F.coalesce("writing", F.lit(False)).alias("writing"))


@query("select id, case when upper(trim(cefr_level)) in ('A1', 'A2', 'B1', 'B2', 'C1', 'C2') then upper(trim(cefr_level)) else 'B1' end as level from article_versions")
def level_default(spark: SparkSession, sf: str) -> DataFrame:
    """Requested level in capitals, B1 where none of the levels is named."""
    level = F.upper(F.trim("cefr_level"))
    return table(spark, sf, "article_versions").select("id", F.when(level.isin("A1", "A2", "B1", "B2", "C1", "C2"), level).otherwise("B1").alias("level"))


@query("""with m as (select vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)) / len(embedding)) rms, list_max(list_transform(embedding, lambda x: abs(x::double))) peak from embeddings),
g as (select vec_id, embedding, least(0.1 / rms, 0.97 / peak) gain from m where rms > 0)
select vec_id, unnest(range(len(embedding))) k, round(unnest(list_transform(embedding, lambda x: x::double * gain)), 4) + 0.0 x from g""")
def rms_applied(spark: SparkSession, sf: str) -> DataFrame:
    """Signals at a level of 0.1 with their peak under 0.97, sample by sample."""
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    peak = F.aggregate("embedding", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", F.sqrt(square / F.size("embedding")).alias("rms"), peak.alias("peak")).filter("rms > 0")
    gained = rows.withColumn("gain", F.least(F.lit(0.1) / F.col("rms"), F.lit(0.97) / F.col("peak")))
    each = gained.select("vec_id", F.posexplode(F.transform("embedding", lambda x: x.cast("double") * F.col("gain"))).alias("k", "x"))
    return each.select("vec_id", F.col("k").cast("bigint").alias("k"), (F.round("x", 4) + F.lit(0.0)).alias("x"))
