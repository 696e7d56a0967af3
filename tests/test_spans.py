from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import spans as S
from spanloom.plans.spans import by_length, by_vowel


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression.alias("y")).first()["y"]


def units_of(text):
    return [(m.start(), m.end()) for m in S._UNIT.finditer(text)]


def test_offsets_give_back_the_units(spark):
    df = spark.createDataFrame([(1, "Ông ấy  mua 300.000 đồng.\n\nBBC 🙂 nói"), (2, ""), (3, None)], "id int, t string")
    rows = S.unit_rows(df, "id", "t").collect()
    text = "Ông ấy  mua 300.000 đồng.\n\nBBC 🙂 nói"
    assert [r["unit"] for r in rows] == [text[r["start"] : r["end"]] for r in rows]
    assert {r["key"] for r in rows} == {1}


def test_contiguous_gaps():
    text = "một hai, ba 300.000 bốn  năm 3-4"
    u = units_of(text)
    words = [text[a:b] for a, b in u]
    side = {(words[i], words[i + 1]): S.contiguous(text, u, i) for i in range(len(u) - 1)}
    assert side[("một", "hai")] and not side[("hai", "ba")] and side[("300", "000")] and not side[("bốn", "năm")] and side[("3", "4")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("ông bà của và không khí trước đây máy bay , . \n".split(" ")), max_size=14))
def test_reconciled_spans_tile(parts):
    text = " ".join(parts)
    u = units_of(text)
    low = [text[a:b].lower() for a, b in u]
    a, b = S.fallback(by_length(low), by_vowel(low), len(u))
    spans = S.reconcile_units(text, u, a, b, {"không_khí": "air", "trước_đây": None, "của_ông": None})
    assert [s[0] for s in spans] == [0, *(s[1] for s in spans[:-1])] if spans else not u
    assert not spans or spans[-1][1] == len(u)
    for i, j, source, locked, other in spans:
        assert locked == (source != "first") and (other is None) == locked
        assert all(S.contiguous(text, u, k) for k in range(i, j - 1))


def test_decision_order():
    text = "trước đây máy bay của ông"
    u = units_of(text)
    single = {i: i + 1 for i in range(6)}
    known = {"trước_đây": "formerly", "của_ông": None}
    got = S.reconcile_units(text, u, single | {2: 4}, single | {2: 4}, known)
    assert [(g[0], g[1], g[2]) for g in got] == [(0, 2, "dictionary"), (2, 4, "agreed"), (4, 5, "split"), (5, 6, "agreed")]
    got = S.reconcile_units(text, u, single | {2: 4}, single, {})
    assert (2, 4, "first", False, "máy") in got


def test_bad_groupings_fall_back():
    assert S.ends([1, 2], 3) == {0: 1, 1: 3}
    assert S.ends([1, 0, 2], 3) is None and S.ends([1], 3) is None
    assert S.fallback([5], [1, 1], 2) == ({0: 1, 1: 2}, {0: 1, 1: 2})
    assert S.fallback([5], [9], 2) == ({0: 1, 1: 2}, {0: 1, 1: 2})


def test_runs_by_lexicon_and_by_join_agree(spark):
    texts = spark.createDataFrame([(1, "cái máy bay giấy rơi máy bay"), (2, "không có gì"), (3, None)], "id int, t string")
    words = spark.createDataFrame([("máy_bay", "plane"), ("cái_máy", None), ("cái_máy_bay_giấy_rơi", None), ("máy_bay_giấy_rơi_máy", "x")], "form string, gloss string")
    fast = S.dictionary_runs(texts, "id", "t", words)
    slow = S.dictionary_runs(texts, "id", "t", words, most=1)
    assert sorted(map(tuple, fast.collect()), key=str) == sorted(map(tuple, slow.collect()), key=str)
    forms = {r["form"] for r in fast.collect()}
    assert "cái_máy_bay_giấy_rơi" not in forms and "máy_bay_giấy_rơi_máy" in forms


def test_covering_prefers_the_widest(spark):
    spans = spark.createDataFrame([(1, 0, 3, 1), (1, 0, 7, 2), (1, 4, 7, 1)], "key int, start int, end int, width int")
    probes = spark.createDataFrame([(1, 5), (1, 9), (2, 0)], "key int, offset int")
    assert [tuple(r) for r in S.covering(spans, probes).collect()] == [(1, 5, 0, 7, 2)]


def test_gaps_and_changes_are_found(spark):
    spans = spark.createDataFrame([(1, 0, 2), (1, 2, 3), (2, 0, 1), (2, 2, 3)], "key int, first int, last int")
    sizes = spark.createDataFrame([(1, 3), (2, 3)], "key int, n int")
    assert {r["key"] for r in S.cover_problems(spans, sizes).collect()} == {2}
    after = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 1), (2, 2, 3)], "key int, first int, last int")
    assert [tuple(r) for r in S.span_changes(spans, after).collect()] == [(1, 1)]


def test_text_columns(spark):
    assert one(spark, "  a  b\t\n ", T.squeeze("x")) == "a b"
    assert one(spark, "a\r\n\r\n b  c\n \n\nd", T.paragraph_squeeze("x")) == "a\n\nb c\n\nd"
    assert one(spark, "Một. Hai ba! Bốn", T.sentence_around("x", F.lit(7))) == "Hai ba!"
    assert one(spark, "Một. Hai ba! Bốn", T.sentence_around("x", F.lit(99))) == "Bốn"
    assert one(spark, "a bc d", T.word_at("x", F.lit(2))) == "bc" and one(spark, "a bc d", T.word_at("x", F.lit(1))) == ""
    assert one(spark, "x" * 300, T.clean_gloss("x")) == "x" * 199 + "…"
    assert one(spark, "quốc_gia là , tốt", T.grouping("x")) == [2, 1, 1]
    assert one(spark, " a ; b\n;c", T.string_list("x")) == ["a", "b", "c"]
    assert one(spark, None, T.squeeze("x")) is None


def test_reconciling_with_a_large_word_list_agrees(spark):
    texts = spark.createDataFrame([(1, "trước đây máy bay của ông rơi"), (2, ""), (3, None), (4, "ông của và không khí 3.000")], "id int, t string")
    words = spark.createDataFrame([("máy_bay", "plane"), ("trước_đây", None), ("không_khí", "air"), ("của_ông", None)], "form string, gloss string")
    fast = S.reconciled(texts, "id", "t", words, by_length, by_vowel)
    slow = S.reconciled(texts, "id", "t", words, by_length, by_vowel, most=1)
    assert sorted(map(tuple, fast.collect()), key=str) == sorted(map(tuple, slow.collect()), key=str)
    assert {r["surface"] for r in fast.collect()} >= {"không khí"}
    for most in (1, 100):
        got = {tuple(r) for r in S.longest_runs(texts, "id", "t", words, most=most).collect()}
        assert got == {(1, 0, 2), (1, 2, 2), (1, 4, 2), (4, 3, 2)}


def test_decomposed_text_and_headwords_meet(spark):
    import unicodedata

    split = unicodedata.normalize("NFD", "không khí")
    entries = spark.createDataFrame([(split, "air", 2), ("không khí", None, 2), (None, "x", 1), ("", "y", 1)], "headword string, definition string, syllable_count int")
    assert [tuple(r) for r in S.dictionary(entries).collect()] == [("không_khí", "air", 2)]
    texts = spark.createDataFrame([(1, split + " lạnh")], "id int, t string")
    assert [tuple(r) for r in S.dictionary_runs(texts, "id", "t", S.dictionary(entries)).collect()] == [(1, 0, 2, "không_khí", "air")]
    assert [(r["start"], r["end"]) for r in S.unit_rows(texts, "id", "t").collect()] == [(0, 5), (6, 9), (10, 14)]


def test_lookups_over_stretches_agree_with_brute_force(spark):
    import random

    rng = random.Random(4)
    spans = [(k % 3, a, a + rng.randint(0, 700), k) for k in range(60) for a in [rng.randint(0, 2000)]]
    probes = [(k % 4, rng.randint(0, 2500)) for k in range(80)]
    df = spark.createDataFrame(spans, "key int, start int, end int, id int")
    ps = spark.createDataFrame(probes, "key int, offset int")
    want = sorted((k, o, i) for k, o in probes for key, a, b, i in spans if key == k and a <= o < b)
    assert sorted((r["key"], r["offset"], r["id"]) for r in S.holding(df, ps).collect()) == want
    left = spark.createDataFrame([(k, a, b, i) for k, a, b, i in spans[:20]], "key int, a int, z int, n int")
    want = sorted((n, i) for k, a, z, n in spans[:20] for key, s, e, i in spans if key == k and e > a and s < z and e > s and z > a)
    assert sorted((r["n"], r["id"]) for r in S.overlapping(left, df).collect()) == want
    units = spark.createDataFrame([(k, 10 * n, n) for k in range(2) for n in range(1, 9)], "key int, start int, ordinal int")
    got = {(r["key"], r["offset"]): r["ordinal"] for r in S.preceding(units, ps.distinct()).collect()}
    assert got == {(k, o): min(o // 10, 8) for k, o in probes if k < 2 and o >= 10}
