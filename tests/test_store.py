from pyspark.sql import functions as F

from spanloom.functions import clock
from spanloom.operators import keyed, quiz


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_first_wins_and_null_keys(spark):
    df = spark.createDataFrame([("a", 1, "x", 2), ("a", 1, "y", 1), (None, 1, "z", 1)], "s string, g int, v string, o int")
    assert rows(keyed.first_wins(df, ["s", "g"], [F.col("o")])) == [("a", 1, "y", 1), (None, 1, "z", 1)]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c"), (None, "N")], "k int, v string")
    once = keyed.upsert(old, new, ["k"])
    assert rows(once) == rows(keyed.upsert(once, new, ["k"])) == [(1, "a"), (2, "B"), (3, "c"), (None, "N")]
    assert rows(keyed.insert_absent(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "c"), (None, "n")]


def test_children_are_replaced_and_removed(spark):
    kids = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "p int, v string")
    new = spark.createDataFrame([(1, "z")], "p int, v string")
    assert rows(keyed.replace_children(kids, new, "p")) == [(1, "z"), (2, "c")]
    assert rows(keyed.cascade_delete(kids, new, "p")) == [(2, "c")]


def test_notes_are_appended_once(spark):
    df = spark.createDataFrame([(None,), ("",), ("x",), ("x; done",)], "n string")
    assert [r[0] for r in df.select(keyed.append_note(F.col("n"), "done")).collect()] == ["done", "done", "x; done", "x; done"]


def test_option_order(spark):
    data = [(i, f"q{i}", ["a", "b", "c", "d"], i % 4) for i in range(200)] + [(900, "q", None, 0), (901, "q", ["a"], 0), (902, "q", ["a", "b"], 7), (903, None, ["a", "a"], 1)]
    df = spark.createDataFrame(data, "item_id int, question string, options array<string>, answer int")
    once = quiz.option_order(df)
    got = {r["item_id"]: r for r in once.collect()}
    assert all(got[i]["options"][got[i]["answer"]] == "abcd"[i % 4] for i in range(200))
    counts = [sum(got[i]["answer"] == p for i in range(200)) for p in range(4)]
    assert min(counts) > 25
    assert got[900]["options"] is None and got[901]["options"] == ["a"] and got[902]["answer"] == 7 and sorted(got[903]["options"]) == ["a", "a"]
    # The order is a function of the content: a second application leaves the options as they are.
    again = {r["item_id"]: r for r in quiz.option_order(once).collect()}
    assert all(again[i]["options"] == got[i]["options"] and again[i]["options"][again[i]["answer"]] == "abcd"[i % 4] for i in range(200))


def test_coverage_and_validity(spark):
    df = spark.createDataFrame([(1, ["người dân yên tâm", ""], "Người dân rất yên tâm.")], "i int, k array<string>, s string")
    assert df.select(quiz.covered(F.col("k"), F.col("s"), ("rất",))).first()[0] == 1
    items = spark.createDataFrame([("mcq", "q", ["a", "b"], 1, -5), ("mcq", "q", ["a"], 0, 0), ("mcq", " ", ["a", "b"], 0, 0), ("short", "q", None, -1, None)], "kind string, question string, options array<string>, answer int, min_words int")
    assert rows(quiz.valid(items).select("kind", "min_words")) == [("mcq", 0), ("short", 0)]


def test_clock(spark):
    hours, days = clock.windows("8-12,13-18"), clock.weekdays("mon,tue,wed,thu,fri")
    assert hours == [(8, 12), (13, 18)] and days == {0, 1, 2, 3, 4} and clock.weekdays("7, sun") == {0, 6}
    for bad in ("8", "12-8", "a-b", "0-25"):
        try:
            clock.windows(bad)
            raise AssertionError(bad)
        except ValueError:
            pass
    times = ["2024-01-02 07:59:59", "2024-01-02 08:00:00", "2024-01-02 12:00:00", "2024-01-05 17:30:00", "2024-01-06 09:00:00", "2024-01-08 09:10:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.to_timestamp("t").alias("t"))
    got = df.select(clock.is_peak(F.col("t"), hours, days, ("2024-01-08",)).alias("p"), clock.next_offpeak(F.col("t"), hours, days, ("2024-01-08",)).cast("string").alias("n")).collect()
    assert [r["p"] for r in got] == [False, True, False, True, False, False]
    assert [r["n"] for r in got][:4] == ["2024-01-02 07:00:00", "2024-01-02 12:00:00", "2024-01-02 12:00:00", "2024-01-05 18:00:00"]
    dates = spark.createDataFrame([("Tue, 02 Jan 2024 09:30:00 +0700",), ("2 Jan 2024 02:30:00 GMT",), ("rubbish",), (None,)], "d string")
    assert [str(r[0]) for r in dates.select(clock.feed_date(F.col("d")).cast("string")).collect()] == ["2024-01-02 02:30:00", "2024-01-02 02:30:00", "None", "None"]


def test_hour_windows_and_their_words():
    assert clock.windows("01:00-04:00, 06:00-10:00") == [(1, 4), (6, 10)] == clock.windows("1-4,6-10")
    assert clock.describe([(1, 4)], {0, 4}) == "peak = 01:00-04:00 UTC on Mon, Fri (all other hours off-peak)"
    for bad in ("01:30-04:00", "4-4", "25:00-26:00"):
        try:
            clock.windows(bad)
            raise AssertionError(bad)
        except ValueError:
            pass


def test_next_cheap_hour_against_stepping(spark):
    import datetime as d

    hours, days, cheap = [(0, 24)], {0, 1, 2, 3, 4, 5}, ("2024-01-04",)
    start = d.datetime(2024, 1, 1)
    times = [start + d.timedelta(hours=7 * k, minutes=k) for k in range(60)]
    df = spark.createDataFrame([(t.strftime("%Y-%m-%d %H:%M:%S"),) for t in times], "t string").select(F.to_timestamp("t").alias("t"))
    got = [r[0] for r in df.select(F.date_format(clock.next_offpeak(F.col("t"), hours, days, cheap), "yyyy-MM-dd HH:mm")).collect()]
    for t, n in zip(times, got):
        h = t.replace(minute=0)
        while h.weekday() in days and h.strftime("%Y-%m-%d") not in cheap:
            h += d.timedelta(hours=1)
        assert n == h.strftime("%Y-%m-%d %H:%M")
    never = df.limit(1).select(clock.next_offpeak(F.col("t"), [(0, 24)], set(range(7)))).first()[0]
    assert never is None


def test_updates_caches_fallbacks_and_queue_states(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (9, "x"), (None, None)], "k int, v string")
    assert rows(keyed.updated(old, new, ["k"])) == [(1, "a", False), (2, "B", True), (None, None, True)]
    puts = spark.createDataFrame([("x", "1", 1), ("x", "2", 2), ("y", "3", 1)], "k string, a string, o int")
    cache = keyed.cache_put(None, puts, "k", "a", "o")
    assert rows(cache) == [("x", "2"), ("y", "3")]
    assert rows(keyed.cache_put(cache, puts.limit(1), "k", "a", "o")) == [("x", "1"), ("y", "3")]
    lookup = spark.createDataFrame([("a", ""), ("b", "B"), ("c", "C")], "form string, gloss string")
    asked = spark.createDataFrame([("a", "b"), ("c", "b"), ("z", "z"), (None, None)], "p string, q string")
    assert rows(keyed.first_found(asked, {"p": F.col("p"), "q": F.col("q")}, lookup, "form", "gloss")) == [("a", "b", "B", "q"), ("c", "b", "C", "p"), ("z", "z", None, "none"), (None, None, None, "none")]
    log = [(1, "yes", 1), (1, "in", 2), (2, "yes", 1), (2, "in", 2), (2, "yes", 3), (3, "yes", 1), (3, "no", 2), (4, "sent", 1), (5, "in", 1), (5, "yes", 2)]
    states = keyed.queue_states(spark.createDataFrame(log, "id int, e string, t int"), "id", "e", ["t"], "yes", "no", "in")
    assert rows(states) == [(1, True, True), (2, True, False), (3, False, False), (4, None, False), (5, True, False)]
    three = spark.createDataFrame([(3,), (1,), (2,)], "n int")
    assert [keyed.limited(three, [F.col("n")], n).count() for n in (2, 0, None)] == [2, 3, 3]
