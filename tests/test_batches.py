"""How much the row functions hold at one time: batches that leave Python stay small, however many texts come in one."""

import os
import unicodedata

import pyarrow as pa
import pytest

from spanloom.functions import arrow
from spanloom.operators import spans as S
from spanloom.plans import registry
from spanloom.plans.spans import by_length, by_vowel

SF = "/root/testdata/sf0.001"

TEXTS = 3_000
#: Rows of a batch that goes out; all units of TEXTS texts are seven times as many.
MOST = 50_000
TEXT = "Ông ấy mua máy bay giấy, " * 20


@pytest.fixture
def caught(monkeypatch):
    """Runs what an operator gives to mapInArrow over one batch of Spark's and returns the batches that go out."""

    def run(df, operator, *columns):
        functions, kind = [], type(df)
        real = kind.mapInArrow
        monkeypatch.setattr(kind, "mapInArrow", lambda self, f, schema, *a, **k: (functions.append(f), real(self, f, schema, *a, **k))[1])
        operator(df)
        return list(functions[-1](iter([pa.RecordBatch.from_pydict(dict(columns))])))

    return run


def texts(spark):
    return spark.createDataFrame([(1, "a b")], "id bigint, t string")


def lexicon(spark):
    return spark.createDataFrame([("máy_bay", "plane")], "form string, gloss string")


def test_units_leave_in_small_batches(spark, caught):
    out = caught(texts(spark), lambda df: S.unit_rows(df, "id", "t"), ("key", range(TEXTS)), ("text", [TEXT] * TEXTS))
    assert max(b.num_rows for b in out) <= MOST
    assert sum(b.num_rows for b in out) == 120 * TEXTS
    assert pa.Table.from_batches(out).group_by("key").aggregate([("ordinal", "max")])["ordinal_max"].unique().to_pylist() == [119]


def test_one_long_text_leaves_in_small_batches(spark, caught):
    out = caught(texts(spark), lambda df: S.unit_rows(df, "id", "t"), ("key", [1, 2, 3]), ("text", ["x y", "a " * 120_000, "z"]))
    assert max(b.num_rows for b in out) <= MOST
    assert [k for b in out for k in b["key"].to_pylist()] == [1] * 2 + [2] * 120_000 + [3]


def test_runs_of_units_are_spans(spark, caught):
    rows = S.span_rows(spark.createDataFrame([(1, "a  bc, d"), (2, "x"), (3, ""), (4, None), (5, "…")], "id int, t string"), "id", "t", 2).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 1, 1), (1, 0, 5, 2), (1, 3, 5, 1), (1, 3, 8, 2), (1, 7, 8, 1), (2, 0, 1, 1)]
    out = caught(texts(spark), lambda df: S.span_rows(df, "id", "t", 2), ("key", range(TEXTS)), ("text", [TEXT] * TEXTS))
    assert max(b.num_rows for b in out) <= MOST and sum(b.num_rows for b in out) == (120 + 119) * TEXTS


def test_spans_and_runs_leave_in_small_batches(spark, caught):
    many = ("key", range(TEXTS)), ("text", [TEXT] * TEXTS)
    out = caught(texts(spark), lambda df: S.reconciled(df, "id", "t", lexicon(spark), by_length, by_vowel), *many)
    assert max(b.num_rows for b in out) <= MOST and len({sum(b["key"].to_pylist().count(k) for b in out) for k in (0, TEXTS - 1)}) == 1
    out = caught(texts(spark), lambda df: S.dictionary_runs(df, "id", "t", lexicon(spark)), *many)
    assert max(b.num_rows for b in out) <= MOST and sum(b.num_rows for b in out) == 20 * TEXTS
    out = caught(texts(spark), lambda df: S._joined_runs(S._texts(df, "id", "t"), lexicon(spark), 6, 4), *many)
    assert max(b.num_rows for b in out) <= MOST and sum(b.num_rows for b in out) == (119 + 118 + 117 + 116 + 115) * TEXTS


def test_texts_are_composed_in_the_same_process(spark):
    split = unicodedata.normalize("NFD", "không khí")
    df = spark.createDataFrame([(1, split)], "id int, t string")
    for rows in (S.unit_rows(df, "id", "t"), S.span_rows(df, "id", "t", 1), S.reconciled(df, "id", "t", lexicon(spark), by_length, by_vowel)):
        assert rows._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        assert {r["end"] for r in rows.collect()} == {5, 9}


def test_slices_keep_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(arrow, "SLICE_BYTES", 64)
    batch = pa.RecordBatch.from_pydict({"k": range(40), "t": [None if i % 7 == 0 else "é" * (i % 5 * 20) for i in range(40)]})
    parts = list(arrow._slices(iter([batch, batch.slice(0, 0), batch.slice(5, 20)])))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist() + batch.slice(5, 20).to_pylist()
    assert len(parts) > 20 and all(sum(len((x or "").encode()) for x in p["t"].to_pylist()) <= 64 for p in parts if p.num_rows > 1)


def broadcasts(df):
    """What the planner would send to the driver and to every executor if it took everything for small."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["paragraph_overlap", "selection_cascade", "token_at_offset", "resolve_offset", "token_exact_range"])
def test_units_and_spans_are_not_broadcast(spark, name):
    # The dictionary alone may travel.
    assert broadcasts(registry.QUERIES[name](spark, SF)) == (name in ("selection_cascade", "resolve_offset"))
