"""Queries over syllables, drill items, recognition checks and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import phonology as P, text as T
from ..operators.pages import composed
from ..runtime import stage
from ._register import query, table

_MARKED = "".join(T.TONES.values())
_TONE_SQL = "case " + " ".join(f"when m <> '' and contains('{letters}', m) then '{name}'" for name, letters in T.TONES.items()) + " else 'ngang' end"


def _syllables(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "entries").select("entry_id", "freq_rank", F.explode("syllables").alias("syllable")).filter("syllable <> ''")


@query(f"""with s as (select entry_id, nfc_normalize(lower(unnest(syllables))) syllable from entries), d as (select distinct syllable from s where syllable <> ''),
t as (select syllable, regexp_extract(syllable, '([{_MARKED}])[^{_MARKED}]*$', 1) m from d)
select syllable, translate(syllable, '{_MARKED}', '{T.BASE * 5}') base, {_TONE_SQL} tone from t""")
def tone_split(spark: SparkSession, sf: str) -> DataFrame:
    each = _syllables(spark, sf).select("entry_id", F.lower("syllable").alias("syllable"))
    distinct = composed(each, "entry_id", "syllable").select(F.col("form").alias("syllable")).distinct()
    return distinct.select("syllable", T.toneless("syllable").alias("base"), T.tone("syllable").alias("tone"))


@query()
def syllable_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Onset, glide, nucleus, coda and tone of every distinct syllable; nulls where it is none."""
    return P.parsed(tone_split(spark, sf).select("syllable"), "syllable")


@query()
def parse_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """The twelve most frequent values of each field."""
    parts = syllable_parse(spark, sf).filter("base is not null")
    fields = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("onset", "glide", "nucleus", "coda", "tone"))))
    counts = parts.select(fields.alias("f")).groupBy("f.field", "f.value").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))).filter("place <= 12")


@query("""with o as (select lower(unnest(options)) o, item_id from quiz_items where kind = 'mcq'), c as (select o, max(item_id) clip from o where o is not null group by o)
select q.item_id, c.clip from quiz_items q left join c on c.o = lower(q.options[q.answer + 1]) where q.kind = 'mcq' and q.answer between 0 and 3""")
def clip_lookup_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Lookup by text in which the last row of a key wins."""
    items = table(spark, sf, "quiz_items").filter("kind = 'mcq'")
    clips = items.select(F.explode("options").alias("o"), "item_id").filter("o is not null").groupBy(F.lower("o").alias("o")).agg(F.max("item_id").alias("clip"))
    asked = items.filter("answer between 0 and 3").select("item_id", F.lower(F.get("options", F.col("answer"))).alias("o"))
    return asked.join(clips, "o", "left").select("item_id", "clip")


@query("""with p as (select item_id, coalesce(options[1], '') a, coalesce(options[2], '') b from quiz_items where kind = 'mcq' and len(options) >= 2),
l as (select item_id, case when a = '' then '–' else a end x, case when b = '' then '–' else b end y from p)
select item_id, least(x, y) || ' / ' || greatest(x, y) label from l""")
def contrast_labels(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "quiz_items").filter("kind = 'mcq' and size(options) >= 2")
    side = lambda k: F.coalesce(F.get("options", F.lit(k)), F.lit(""))
    return items.select("item_id", P.contrast(side(0), side(1)).alias("label"))


@query("""with o as (select distinct unnest(options) o from quiz_items where kind = 'mcq'), ids as (select o, dense_rank() over (order by o) - 1 id from o where o is not null),
e as (select item_id, unnest(options) o, generate_subscripts(options, 1) k from quiz_items where kind = 'mcq')
select item_id, string_agg(cast(ids.id as varchar), ',' order by k) codes from e join ids on ids.o = e.o group by item_id having count(*) = 4""")
def drill_item_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Options as dense ids, all four known. Ids come from ranges: ranks inside a range plus the counts before it."""
    e = table(spark, sf, "quiz_items").filter("kind = 'mcq'").select("item_id", F.posexplode("options").alias("k", "o"))
    texts = e.select("o").filter("o is not null").distinct()
    ids = dense_ids(texts, "o")
    joined = e.join(ids, "o").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("k", "id"))).alias("c")).filter("size(c) = 4")
    return joined.select("item_id", F.array_join(F.transform("c", lambda s: s["id"].cast("string")), ",").alias("codes"))


def dense_ids(values: DataFrame, column: str) -> DataFrame:
    """(column, id): 0-based ids of distinct values in their order, without a single-task window over all of them.

    Values are sorted by range partitions, numbered within each, and shifted by the counts of the partitions before.
    """
    ranged = values.repartitionByRange(column).sortWithinPartitions(column).withColumn("part", F.spark_partition_id())
    # Materialised once: the partition of a value must not change between the two uses.
    ranged = stage(ranged, "ranges")
    before = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = ranged.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(column)) - 1)
    return inside.join(F.broadcast(before.select("part", "offset")), "part").select(column, (F.col("rank") + F.col("offset")).alias("id"))


@query(f"""with c as (select item_id, nfc_normalize(regexp_replace(lower(coalesce(sample, '')), '[^\\p{{L}}\\p{{M}}]', '', 'g')) heard, nfc_normalize(regexp_replace(lower(coalesce(why, '')), '[^\\p{{L}}\\p{{M}}]', '', 'g')) said from quiz_items)
select case when heard = said then 'ok' when translate(heard, '{_MARKED}', '{T.BASE * 5}') = translate(said, '{_MARKED}', '{T.BASE * 5}') then 'tone_mismatch' else 'mismatch' end status, count(*) n from c group by 1""")
def asr_status(spark: SparkSession, sf: str) -> DataFrame:
    clean = lambda c: F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{M}]", "")
    heard, said = F.col("heard"), F.col("said")
    status = F.when(heard == said, "ok").when(T.toneless(heard) == T.toneless(said), "tone_mismatch").otherwise("mismatch")
    q = table(spark, sf, "quiz_items")
    h = composed(q.select("item_id", clean("sample").alias("x")), "item_id", "x").select("key", F.col("form").alias("heard"))
    s = composed(q.select("item_id", clean("why").alias("x")), "item_id", "x").select("key", F.col("form").alias("said"))
    return h.join(s, "key").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(f"""with s as (select entry_id, nfc_normalize(lower(unnest(syllables))) syllable from entries), d as (select distinct syllable from s where syllable <> ''),
t as (select syllable, regexp_extract(syllable, '([{_MARKED}])[^{_MARKED}]*$', 1) m from d), n as (select syllable, {_TONE_SQL} tone from t)
select syllable, case when tone in ('hoi', 'nga') then 0.8::double else 1.0::double end speed from n""")
def tone_speed(spark: SparkSession, sf: str) -> DataFrame:
    """Speed at which each syllable is said: the two broken tones slower."""
    return tone_split(spark, sf).select("syllable", F.when(F.col("tone").isin("hoi", "nga"), 0.8).otherwise(1.0).alias("speed"))


@query("""with e as (select vec_id, unnest(embedding) x, generate_subscripts(embedding, 1) - 1 k, len(embedding) n from embeddings)
select vec_id, cast(floor(k * 8 / n) as bigint) bucket, round(min(x::double), 5) lo, round(max(x::double), 5) hi from e group by 1, 2""")
def waveform_minmax(spark: SparkSession, sf: str) -> DataFrame:
    """Signals downsampled to eight buckets of least and greatest value."""
    e = table(spark, sf, "embeddings").select("vec_id", F.size("embedding").alias("n"), F.posexplode("embedding").alias("k", "x"))
    bucket = F.floor(F.col("k") * 8 / F.col("n")).cast("bigint")
    return e.groupBy("vec_id", bucket.alias("bucket")).agg(F.round(F.min("x").cast("double"), 5).alias("lo"), F.round(F.max("x").cast("double"), 5).alias("hi"))


@query("""with m as (select vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)) / len(embedding)) rms, list_max(list_transform(embedding, lambda x: abs(x::double))) peak from embeddings)
select vec_id, round(least(0.1 / rms, 0.97 / peak), 4) gain, 0.1 / rms > 0.97 / peak limited from m where rms > 0""")
def rms_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """Gain to a level of 0.1, limited to a peak of 0.97."""
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    peak = F.aggregate("embedding", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    rows = table(spark, sf, "embeddings").select("vec_id", F.sqrt(square / F.size("embedding")).alias("rms"), peak.alias("peak")).filter("rms > 0")
    gain, limit = F.lit(0.1) / F.col("rms"), F.lit(0.97) / F.col("peak")
    return rows.select("vec_id", F.round(F.least(gain, limit), 4).alias("gain"), (gain > limit).alias("limited"))


@query("""select label, arg_min(vec_id, (len(embedding), vec_id)) take from embeddings group by label""")
def best_take(spark: SparkSession, sf: str) -> DataFrame:
    """The shortest take of each label, ties to the first."""
    return table(spark, sf, "embeddings").groupBy("label").agg(F.min_by("vec_id", F.struct(F.size("embedding"), "vec_id")).alias("take"))


@query("""select q.item_id from quiz_items q where q.kind = 'mcq' and exists (select 1 from (select distinct lower(unnest(key_points)) p from quiz_items) k where k.p = lower(q.options[1]))""")
def used_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Items whose first option is used as a key point somewhere."""
    used = table(spark, sf, "quiz_items").select(F.explode(F.transform("key_points", lambda p: F.lower(p))).alias("p"))
    asked = table(spark, sf, "quiz_items").filter("kind = 'mcq'").select("item_id", F.lower(F.get("options", F.lit(0))).alias("p"))
    return asked.join(used, "p", "left_semi").select("item_id")
