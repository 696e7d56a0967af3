"""Queries over units, spans, dictionary lookups and reconciled segmentations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..functions.arrow import composed
from ..operators import keyed, spans as S
from ._register import query, table

U = "[\\p{L}\\p{N}_]+"
#: Units of versions in DuckDB, with offsets by running sums.
UNITS = f"""
t0 as materialized (select id as key, nfc_normalize(simplified_text) as txt from article_versions where simplified_text <> ''),
t as (select key, txt, regexp_extract_all(txt, '{U}') toks, string_split_regex(txt, '{U}') gaps from t0),
e as (select key, unnest(toks) unit, unnest(gaps[1:len(toks)]) gap, unnest(range(len(toks))) ordinal from t),
u as materialized (select key, cast(ordinal as int) ordinal, unit, gap, cast(sum(length(gap) + length(unit)) over (partition by key order by ordinal) - length(unit) as int) as start, cast(sum(length(gap) + length(unit)) over (partition by key order by ordinal) as int) as "end" from e)"""
LEX = "d as (select lower(trim(regexp_replace(nfc_normalize(headword), '[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))) hw, definition from entries), w as (select replace(hw, ' ', '_') form, min(definition) gloss from d where hw <> '' group by 1)"
RUNS = "runs as (" + " union all ".join(
    f"select key, ordinal as first, ordinal + {n} as last, lower(unit)" + "".join(f" || '_' || lower(lead(unit, {k}) over (partition by key order by ordinal))" for k in range(1, n)) + " form from u" for n in range(2, 7)
) + ")"


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "article_versions").select(F.col("id").alias("key"), "simplified_text")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """Versions with their composed text, for expressions on it."""
    return composed(_versions(spark, sf).filter("simplified_text <> ''"), "simplified_text")


def _units(spark: SparkSession, sf: str) -> DataFrame:
    return S.unit_rows(_versions(spark, sf), "key", "simplified_text")


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return S.dictionary(table(spark, sf, "entries"))


@query(f"with {UNITS}, {LEX}, {RUNS} select key, first, last, runs.form, gloss from runs join w on runs.form = w.form where last - first <= 4 or gloss is not null")
def ngram_lookup_index(spark: SparkSession, sf: str) -> DataFrame:
    return S.dictionary_runs(_versions(spark, sf), "key", "simplified_text", _words(spark, sf))


@query(f"with {UNITS} select key, ordinal, start, \"end\", unit from u")
def word_units_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return _units(spark, sf)


@query(f"select doc_id, len(regexp_extract_all(text, '{U}')) units from documents where text is not null")
def word_units(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", T.unit_count("text").alias("units"))


@query(f"""with {UNITS}, p as (select key, ordinal, unit l, lead(unit) over w r, lead(gap) over w g from u window w as (partition by key order by ordinal))
select key, count_if(g = ' ' or (g in ('.', ',', '/', ':', '-', '–') and regexp_full_match(l, '[0-9]+') and regexp_full_match(r, '[0-9]+'))) joined, count(*) pairs from p where r is not null group by key""")
def contiguous_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return S.side_by_side(_versions(spark, sf), "key", "simplified_text")


@query(f"""with {UNITS}, {LEX}, {RUNS}, n as (select key, ordinal, lead(gap) over w g, unit l, lead(unit) over w r from u window w as (partition by key order by ordinal)),
ok as (select key, ordinal, case when g = ' ' or (g in ('.', ',', '/', ':', '-', '–') and regexp_full_match(l, '[0-9]+') and regexp_full_match(r, '[0-9]+')) then 0 else 1 end bad from n),
b as (select key, ordinal, sum(bad) over (partition by key order by ordinal) - bad upto from ok)
select r.key, r.first, max(r.last - r.first) length from runs r join w on r.form = w.form join b x on x.key = r.key and x.ordinal = r.first join b y on y.key = r.key and y.ordinal = r.last - 1
where r.last - r.first <= 4 and x.upto = y.upto group by r.key, r.first""")
def longest_dictionary_match(spark: SparkSession, sf: str) -> DataFrame:
    return S.longest_runs(_versions(spark, sf), "key", "simplified_text", _words(spark, sf))


def by_length(units: list[str]) -> list[int]:
    """A simple segmentation: a short unit joins the next one."""
    out, i = [], 0
    while i < len(units):
        step = 2 if len(units[i]) <= 3 and i + 1 < len(units) else 1
        out.append(step)
        i += step
    return out


def by_vowel(units: list[str]) -> list[int]:
    """A simple segmentation: a unit that ends in a vowel joins the next one."""
    out, i = [], 0
    while i < len(units):
        step = 2 if T.BASE.find(units[i][-1:]) >= 0 and i + 1 < len(units) else 1
        out.append(step)
        i += step
    return out


_SIDE = "(g = ' ' or (g in ('.', ',', '/', ':', '-', '–') and regexp_full_match(l, '[0-9]+') and regexp_full_match(r, '[0-9]+')))"
_STOPS = "[" + ", ".join(f"'{w}'" for w in T.FUNCTION_WORDS) + "]"


def _reconciled(one: str, two: str, name: str = "spans") -> str:
    """CTEs that end in `spans` (key, ordinal, first, last, source, form, alternative); one and two: conditions on the unit
    `w` under which a segmentation joins it with the next one. Segmentations and spans are reached from unit 0 by recursion."""
    tiles = "".join(
        f""", {t}{name}(key, i, z) as (select key, 0, case when {c} and n > 1 then 2 else 1 end from o{name} where i = 0
union all select o.key, o.i, case when {c} and o.i + 1 < o.n then o.i + 2 else o.i + 1 end from {t}{name} x join o{name} o on o.key = x.key and o.i = x.z)"""
        for t, c in (("a", one), ("b", two))
    )
    dictionary = " ".join(f"when size{name} >= {k} and f{k} in (select form from w) then i + {k}" for k in (4, 3, 2))
    return f"""p{name} as (select key, ordinal i, unit l, lead(unit) over v r, lead(gap) over v g, lower(unit) w, lower(lead(unit, 1) over v) w1, lower(lead(unit, 2) over v) w2, lower(lead(unit, 3) over v) w3, start, "end" e1, lead("end", 1) over v e2, lead("end", 2) over v e3, lead("end", 3) over v e4, count(*) over (partition by key) n from u window v as (partition by key order by ordinal)),
q{name} as (select *, sum(case when {_SIDE} then 0 else 1 end) over (partition by key order by i) - case when {_SIDE} then 0 else 1 end bad from p{name}),
o{name} as (select *, w || '_' || w1 f2, w || '_' || w1 || '_' || w2 f3, w || '_' || w1 || '_' || w2 || '_' || w3 f4,
 1 + coalesce((lead(bad, 1) over k = bad)::int, 0) + coalesce((lead(bad, 1) over k = bad and lead(bad, 2) over k = bad)::int, 0) + coalesce((lead(bad, 1) over k = bad and lead(bad, 2) over k = bad and lead(bad, 3) over k = bad)::int, 0) size{name}
 from q{name} window k as (partition by key order by i)){tiles},
c{name} as (select o.*, case {dictionary} end d, coalesce(a.z, o.i + 1) x, coalesce(b.z, o.i + 1) y from o{name} o left join a{name} a using (key, i) left join b{name} b using (key, i)),
e{name} as (select *, coalesce(d, x) z0, case coalesce(d, x) - i when 1 then w when 2 then f2 when 3 then f3 else f4 end form0 from c{name}),
h{name} as (select e.*, (d is null and greatest(x, y) - i > size{name}) or (z0 > i + 1 and list_contains({_STOPS}, w) and list_contains({_STOPS}, w1) and (z0 - i < 3 or list_contains({_STOPS}, w2)) and (z0 - i < 4 or list_contains({_STOPS}, w3)) and coalesce(g.gloss, '') = '') single from e{name} e left join w g on g.form = e.form0),
n{name} as (select key, i, case when single then i + 1 else z0 end z, case when single then 'split' when d is not null then 'dictionary' when x = y then 'agreed' else 'first' end source,
 case when single then w else form0 end form, case when single or d is not null or x = y then null when y - i = 1 then w else f2 end alternative,
 start, case when single then e1 when z0 - i = 1 then e1 when z0 - i = 2 then e2 when z0 - i = 3 then e3 else e4 end stop from h{name}),
r{name}(key, i, z, source, form, alternative, start, stop) as (select key, i, z, source, form, alternative, start, stop from n{name} where i = 0 union all select n.key, n.i, n.z, n.source, n.form, n.alternative, n.start, n.stop from r{name} x join n{name} n on n.key = x.key and n.i = x.z),
{name} as materialized (select key, cast(row_number() over (partition by key order by i) - 1 as int) ordinal, i as first, z as last, source, form, alternative, start, stop from r{name})"""


_SHORT_UNIT, _VOWEL_END = "length(w) <= 3", f"contains('{T.BASE}', right(w, 1))"
RECONCILED = _reconciled(_SHORT_UNIT, _VOWEL_END)
_SUMMARY = "count(*) total, count_if(source <> 'first') locked, count_if(source = 'first') ambiguous, count_if(source = 'dictionary') from_dictionary, count_if(source = 'agreed') from_agreement, count_if(source = 'split') split_by_guard, round(100.0 * count_if(source <> 'first') / count(*), 1) locked_percent"


def _spans_of(spark: SparkSession, sf: str) -> DataFrame:
    return S.reconciled(_versions(spark, sf), "key", "simplified_text", _words(spark, sf), by_length, by_vowel)


@query(f"with recursive {UNITS}, {LEX}, {RECONCILED} select key, ordinal, first, last, source, source <> 'first' locked, form, alternative from spans")
def reconcile_spans(spark: SparkSession, sf: str) -> DataFrame:
    return _spans_of(spark, sf).select("key", "ordinal", "first", "last", "source", "locked", "form", "alternative")


@query(f"with recursive {UNITS}, {LEX}, {RECONCILED} select key, {_SUMMARY} from spans group by key")
def reconcile_summary(spark: SparkSession, sf: str) -> DataFrame:
    return S.summary(_spans_of(spark, sf))


@query(f"""with recursive {UNITS}, {LEX}, {RECONCILED}, {_reconciled(_VOWEL_END, _VOWEL_END, "again")}
select key, count_if(s.form is null or t.form is null) // 2 changed from spans s full join again t using (key, first, last) group by key having count_if(s.form is null or t.form is null) >= 2""")
def span_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Texts whose spans change when the second segmentation alone is reconciled again."""
    again = S.reconciled(_versions(spark, sf), "key", "simplified_text", _words(spark, sf), by_vowel, by_vowel)
    return S.span_changes(reconcile_spans(spark, sf), again)


@query(f"""with {UNITS}, n as (select key, count(*) n from u group by key), s as (select key, ordinal f, least(ordinal + 2, n) l from u join n using (key) where ordinal % 2 = 0 and not (key % 3 = 0 and ordinal = 2) and not (key % 5 = 0 and ordinal = 4)),
k as (select key, f, l, lead(f) over (partition by key order by f) nf, n from s join n using (key))
select key, cast(2 * count_if(nf is not null and nf <> l) as int) as gaps from k group by key having count_if(nf is not null and nf <> l) > 0""")
def cover_check(spark: SparkSession, sf: str) -> DataFrame:
    """Tilings by two units from which spans were taken: every gap has a start and an end that meet nothing."""
    sizes = _sizes(spark, sf)
    tiles = sizes.select("key", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(2))).alias("first"))
    gone = ((F.col("key") % 3 == 0) & (F.col("first") == 2)) | ((F.col("key") % 5 == 0) & (F.col("first") == 4))
    spans = tiles.filter(~gone).select("key", "first", F.least(F.col("first") + 2, "n").alias("last"))
    # A tiling whose last span is gone ends early; its gap has one end only, and is no gap between spans.
    ends = spans.groupBy("key").agg(F.max("last").alias("n"))
    return S.cover_problems(spans, ends).select("key", F.col("gaps").cast("int").alias("gaps"))


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("key", T.unit_count("simplified_text").alias("n")).filter("n > 0")


@query(f"""with recursive {UNITS}, {LEX}, {RECONCILED}
select s.key, s.ordinal, s.start, s.stop as "end", substr(t.txt, s.start + 1, s.stop - s.start) surface, s.form, w.gloss definition, case when w.gloss is not null then 'dictionary' else 'none' end definition_src
from spans s join t0 t on t.key = s.key left join w on w.form = s.form""")
def token_map(spark: SparkSession, sf: str) -> DataFrame:
    """(key, ordinal, start, end, surface, form, definition, definition_src): tokens with offsets and definitions."""
    known = _spans_of(spark, sf).join(_words(spark, sf), "form", "left")
    return known.select("key", "ordinal", "start", "end", "surface", "form", F.col("gloss").alias("definition"), F.when(F.col("gloss").isNotNull(), "dictionary").otherwise("none").alias("definition_src"))


SPANS = 's as (select key, start, "end", 1 width from u union all select key, start, e2, 2 from (select key, start, lead("end") over (partition by key order by ordinal) e2 from u) where e2 is not null)'
PROBES = "p as (select key, cast((key * 37 + k * 101) % length(txt) as int) as off from t, range(4) r(k))"


def _probes(texts: DataFrame) -> DataFrame:
    at = (F.col("key") * 37 + F.col("k") * 101) % F.length("simplified_text")
    return texts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("key", at.cast("int").alias("offset"))


@query(f"""with {UNITS}, {SPANS}, {PROBES} select key, "offset", start, "end", width from (
select p.key, p.off as "offset", s.start, s."end", s.width, row_number() over (partition by p.key, p.off order by s.width desc, s.start) rn from (select distinct * from p) p join s on s.key = p.key and s.start <= p.off and s."end" > p.off) where rn = 1""")
def token_at_offset(spark: SparkSession, sf: str) -> DataFrame:
    return S.covering(S.span_rows(_versions(spark, sf), "key", "simplified_text", 2), _probes(_texts(spark, sf)))


@query(f"""with {UNITS}, {PROBES} select p.key, p.off as "offset", max(u.ordinal) ordinal from (select distinct * from p) p join u on u.key = p.key and u.start <= p.off group by p.key, p.off""")
def offset_to_unit(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest unit at or before each offset."""
    probes = _probes(_texts(spark, sf)).distinct()
    return S.preceding(_units(spark, sf), probes)


@query(f"""with {UNITS} select key, ordinal // 10 as block, count(*) units, min(start) as start, max("end") as "end" from u group by key, ordinal // 10""")
def tokens_in_range(spark: SparkSession, sf: str) -> DataFrame:
    """Units inside consecutive ranges of ten."""
    block = F.floor(F.col("ordinal") / 10).cast("int").alias("block")
    return _units(spark, sf).groupBy("key", block).agg(F.count("*").alias("units"), F.min("start").alias("start"), F.max("end").alias("end"))


@query("""with t as (select id key, unnest(string_split(nfc_normalize(simplified_text), chr(10) || chr(10))) para, generate_subscripts(string_split(nfc_normalize(simplified_text), chr(10) || chr(10)), 1) - 1 n from article_versions where simplified_text <> '')
select key, n, cast(sum(length(para) + 2) over (partition by key order by n) - length(para) - 2 as int) as start, length(para) chars from t""")
def paragraph_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs between blank lines with their offsets: running sums over a text's paragraphs."""
    rows = _texts(spark, sf).select("key", F.posexplode(F.transform(F.split("simplified_text", "\n\n", -1), F.length)).alias("n", "chars"))
    before = F.sum(F.col("chars") + 2).over(Window.partitionBy("key").orderBy("n")) - F.col("chars") - 2
    return rows.select("key", F.col("n").cast("bigint").alias("n"), before.cast("int").alias("start"), "chars")


@query(f"""with {UNITS}, q as (select id key, unnest(string_split(nfc_normalize(simplified_text), chr(10) || chr(10))) para, generate_subscripts(string_split(nfc_normalize(simplified_text), chr(10) || chr(10)), 1) - 1 n from article_versions where simplified_text <> ''),
o as (select key, n, sum(length(para) + 2) over (partition by key order by n) - length(para) - 2 a, sum(length(para) + 2) over (partition by key order by n) - 2 z from q)
select o.key, o.n, count(*) units from o join u on u.key = o.key and u."end" > o.a and u.start < o.z group by o.key, o.n""")
def paragraph_overlap(spark: SparkSession, sf: str) -> DataFrame:
    parts = paragraph_offsets(spark, sf).select("key", "n", F.col("start").alias("a"), (F.col("start") + F.col("chars")).alias("z"))
    return S.overlapping(parts, _units(spark, sf)).groupBy("key", "n").agg(F.count("*").alias("units"))


@query(f"""with t as materialized (select id as key, nfc_normalize(simplified_text) as txt from article_versions where simplified_text <> ''), {PROBES}, x as (select distinct p.key, off, txt from p join t on t.key = p.key)
select key, off as "offset", trim(regexp_extract(substr(txt, 1, off), '([^.!?…\\n]*)$', 1) || regexp_extract(substr(txt, off + 1), '^([^.!?…\\n]*[.!?…\\n]?)', 1), ' ' || chr(10) || chr(13) || chr(9)) sentence from x""")
def sentence_around(spark: SparkSession, sf: str) -> DataFrame:
    probes = _probes(_texts(spark, sf)).distinct().join(_texts(spark, sf), "key")
    return probes.select("key", "offset", T.sentence_around("simplified_text", "offset").alias("sentence"))


@query(f"""with t as materialized (select id as key, nfc_normalize(simplified_text) as txt from article_versions where simplified_text <> ''), {PROBES}, x as (select distinct p.key, off, txt from p join t on t.key = p.key)
select key, off as "offset", case when regexp_extract(substr(txt, off + 1), '^([^\\t-\\r ]*)', 1) = '' then '' else regexp_extract(substr(txt, 1, off), '([^\\t-\\r ]*)$', 1) || regexp_extract(substr(txt, off + 1), '^([^\\t-\\r ]*)', 1) end word from x""")
def word_at(spark: SparkSession, sf: str) -> DataFrame:
    probes = _probes(_texts(spark, sf)).distinct().join(_texts(spark, sf), "key")
    return probes.select("key", "offset", T.word_at("simplified_text", "offset").alias("word"))


@query(f"""with {UNITS}, {PROBES}, {LEX}, c as (select p.key, p.off, u.unit from (select distinct * from p) p left join u on u.key = p.key and u.start <= p.off and u."end" > p.off)
select c.key, c.off as "offset", coalesce(c.unit, '') surface, w.gloss definition, case when c.unit is null then 'none' when w.gloss is not null then 'stored' else 'none' end source from c left join w on w.form = lower(c.unit)""")
def resolve_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Definition under each offset: the covering unit's stored sense, else none."""
    probes = _probes(_texts(spark, sf)).distinct()
    units = _units(spark, sf)
    hit = S.holding(units.select("key", "start", "end", "unit"), probes).select("key", "offset", "unit")
    found = probes.join(hit, ["key", "offset"], "left").join(_words(spark, sf), F.lower("unit") == F.col("form"), "left")
    return found.select("key", "offset", F.coalesce("unit", F.lit("")).alias("surface"), F.col("gloss").alias("definition"), F.when(F.col("gloss").isNotNull(), "stored").otherwise("none").alias("source"))


@query("""with s as (select entry_id, string_split(replace(lower(headword), ' ', '_') || ' ' || coalesce(definition, ''), ' ') chunks from entries)
select entry_id, array_to_string(list_filter(list_transform(chunks, lambda c: len(regexp_extract_all(replace(c, '_', ' '), '[\\p{L}\\p{N}_]+'))), lambda n: n > 0), ',') counts from s""")
def grouping_counts(spark: SparkSession, sf: str) -> DataFrame:
    segmented = _segmented()
    return table(spark, sf, "entries").select("entry_id", F.array_join(F.transform(F.filter(F.transform(F.split(segmented, " ", -1), T.words_in_chunk), lambda n: n > 0), lambda n: n.cast("string")), ",").alias("counts"))


def _segmented() -> Column:
    return F.concat(F.translate(F.lower("headword"), " ", "_"), F.lit(" "), F.coalesce("definition", F.lit("")))


@query("""select entry_id, len(regexp_extract_all(replace(replace(lower(headword), ' ', '_') || ' ' || coalesce(definition, ''), '_', ' '), '[\\p{L}\\p{N}_]+')) = syllable_count + len(regexp_extract_all(replace(coalesce(definition, ''), '_', ' '), '[\\p{L}\\p{N}_]+')) covers from entries""")
def grouping_cover_check(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("syllable_count") + T.words_in_chunk(F.coalesce("definition", F.lit("")))
    return table(spark, sf, "entries").select("entry_id", T.covers(T.grouping(_segmented()), n).alias("covers"))


@query("""with s as (select entry_id, string_split(replace(lower(headword), ' ', '_') || ' ' || coalesce(definition, ''), ' ') chunks from entries),
c as (select entry_id, list_filter(list_transform(chunks, lambda c: len(regexp_extract_all(replace(c, '_', ' '), '[\\p{L}\\p{N}_]+'))), lambda n: n > 0) counts from s),
e as (select entry_id, unnest(counts) n, unnest(range(len(counts))) k from c)
select entry_id, k, cast(sum(n) over (partition by entry_id order by k) - n as bigint) as first, cast(sum(n) over (partition by entry_id order by k) as bigint) as last from e""")
def counts_to_spans(spark: SparkSession, sf: str) -> DataFrame:
    counts = F.filter(F.transform(F.split(_segmented(), " ", -1), T.words_in_chunk), lambda n: n > 0)
    each = table(spark, sf, "entries").select("entry_id", F.posexplode(counts).alias("k", "n"))
    last = F.sum("n").over(Window.partitionBy("entry_id").orderBy("k"))
    return each.select("entry_id", F.col("k").cast("bigint").alias("k"), (last - F.col("n")).alias("first"), last.alias("last"))


@query(f"""with {UNITS}, {LEX}, p as (select version_id, lower(split_part(k, ' ', 1)) term, min(k) vi from (select version_id, unnest(key_points) k from quiz_items) group by 1, 2)
select u.key, u.ordinal, coalesce(w.gloss, p.vi) definition, case when w.gloss is not null then 'dictionary' when p.vi is not null then 'preteach' else 'none' end source
from u left join w on w.form = lower(u.unit) left join p on p.version_id = u.key and p.term = lower(u.unit)""")
def definition_policy(spark: SparkSession, sf: str) -> DataFrame:
    """The dictionary's sense first, else the version's own term, else none."""
    points = table(spark, sf, "quiz_items").select(F.col("version_id").alias("key"), F.explode("key_points").alias("k"))
    taught = points.groupBy("key", F.lower(F.split_part("k", F.lit(" "), F.lit(1))).alias("low")).agg(F.min("k").alias("vi"))
    words = _words(spark, sf).select(F.col("form").alias("low"), "gloss")
    found = _units(spark, sf).withColumn("low", F.lower("unit")).join(words, "low", "left").join(taught, ["key", "low"], "left")
    source = F.when(F.col("gloss").isNotNull(), "dictionary").when(F.col("vi").isNotNull(), "preteach").otherwise("none")
    return found.select("key", "ordinal", F.coalesce("gloss", "vi").alias("definition"), source.alias("source"))


@query(f"""with {UNITS} select u.key, count_if(substr(t.txt, start + 1, "end" - start) = unit) same, count(*) n from u join t on t.key = u.key group by u.key""")
def span_slice_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every unit is the slice of its text at its offsets."""
    return S.slices(_versions(spark, sf), "key", "simplified_text")


@query(f"""with {UNITS}, n as (select key, count(*) n from u group by key),
a as (select key, ordinal f, least(ordinal + 2, n) l from u join n using (key) where ordinal % 2 = 0), b as (select key, ordinal f, least(ordinal + 3, n) l from u join n using (key) where ordinal % 3 = 0)
select key, count_if(a.f is null or b.f is null) // 2 as changed from a full join b using (key, f, l) group by key having count_if(a.f is null or b.f is null) >= 2""")
def span_symmetric_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Changes between tilings of every text by two and by three units."""
    sizes = _sizes(spark, sf)
    tile = lambda k: sizes.select("key", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(k))).alias("first"), "n").select("key", "first", F.least(F.col("first") + k, "n").alias("last"))
    return S.span_changes(tile(2), tile(3))


@query(f"""with {UNITS}, {LEX}, {RUNS}, h as (select key, first, last, runs.form, last - first width from runs join w on runs.form = w.form where last - first <= 4 or gloss is not null)
select key, first, form, width from (select *, row_number() over (partition by key order by width desc, first) rn from h) where rn = 1""")
def widest_cover_top1(spark: SparkSession, sf: str) -> DataFrame:
    runs = ngram_lookup_index(spark, sf).withColumn("width", F.col("last") - F.col("first"))
    return keyed.top_cover(runs.select("key", "first", "form", "width"), "key", "width", "first").select("key", "first", "form", "width")


@query(f"""with t as materialized (select id as key, nfc_normalize(simplified_text) as txt from article_versions where simplified_text <> ''), {PROBES}, x as (select distinct p.key, off, txt from p join t on t.key = p.key)
select key, off as "offset", trim(regexp_extract(substr(txt, 1, off), '([^.!?…,\\n]*)$', 1) || regexp_extract(substr(txt, off + 1), '^([^.!?…,\\n]*[.!?…,\\n]?)', 1), ' ' || chr(10) || chr(13) || chr(9)) sentence from x""")
def sentence_around_comma(spark: SparkSession, sf: str) -> DataFrame:
    probes = _probes(_texts(spark, sf)).distinct().join(_texts(spark, sf), "key")
    return probes.select("key", "offset", T.sentence_around("simplified_text", "offset", ".!?…,\n").alias("sentence"))


@query("""with c as (select entry_id, syllable_count n, len(regexp_extract_all(headword, '[\\p{L}\\p{N}_]+')) k from entries)
select entry_id, case when k = n then 'ok' else 'syllable_mismatch' end quality, case when k = n then 1 else n end spans from c""")
def segmentation_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """A grouping that does not cover its units falls back to single ones."""
    counts = T.grouping(F.translate("headword", " ", "_"))
    good = T.covers(counts, F.col("syllable_count"))
    return table(spark, sf, "entries").select("entry_id", F.when(good, "ok").otherwise("syllable_mismatch").alias("quality"), F.when(good, 1).otherwise(F.col("syllable_count")).alias("spans"))


@query("""select item_id, array_to_string(options, '|') forms from quiz_items where len(options) > 0""")
def candidate_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Forms of candidates kept as JSON text."""
    stored = F.to_json(F.transform("options", lambda o: F.struct(F.lit("first").alias("source"), o.alias("form"))))
    back = F.from_json(stored, "array<struct<source: string, form: string>>")
    return table(spark, sf, "quiz_items").filter("size(options) > 0").select("item_id", F.array_join(F.transform(back, lambda c: c["form"]), "|").alias("forms"))
