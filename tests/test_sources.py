import json

from pyspark.sql import functions as F

from spanloom.functions import phonology as P, text as T
from spanloom.operators import pages
from spanloom.plans import documents
from spanloom.sources import frames, readers, writers
from spanloom.streaming import queues


def test_csv_and_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿clip_id,syllable\n1,ba\n2,má\n", encoding="utf-8")
    df = readers.csv(spark, str(tmp_path / "a.csv"), ["clip_id", "syllable", "freq_rank"])
    assert sorted(map(tuple, df.collect())) == [("1", "ba", None), ("2", "má", None)]
    (tmp_path / "l.txt").write_text("ba\n\n má \n", encoding="utf-8")
    assert [tuple(r) for r in readers.ranked_lines(spark, str(tmp_path / "l.txt")).collect()] == [(1, "ba"), (2, "má")]


def test_word_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Máy bay\n# no\nnhà\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("máy  bay\ncây\n", encoding="utf-8")
    df, missing = readers.word_lists(spark, str(tmp_path), ["a.txt", "b.txt", "c.txt"])
    got = {r["form"]: (r["display"], r["sources"]) for r in df.collect()}
    assert missing == ["c.txt"] and got == {"máy_bay": ("Máy bay", ["a", "b"]), "nhà": ("nhà", ["a"]), "cây": ("cây", ["b"])}
    empty, missing = readers.word_lists(spark, str(tmp_path), ["z.txt"])
    assert empty.count() == 0 and missing == ["z.txt"]


def test_records_and_senses(spark, tmp_path):
    lines = [
        {"word": "bay", "pos": "verb", "lang_code": "vi", "senses": [{"glosses": ["plural of x"]}, {"glosses": ["to fly"]}, {"glosses": ["To fly"]}]},
        {"word": "fly", "pos": "verb", "lang_code": "en", "senses": []},
    ]
    (tmp_path / "r.jsonl").write_text("\n".join([*map(json.dumps, lines), "{broken"]), encoding="utf-8")
    df = readers.records(spark, str(tmp_path / "r.jsonl"), wanted=spark.createDataFrame([("bay",)], "word string"))
    assert df.count() == 1
    got = sorted(map(tuple, readers.senses(df, ["noun", "verb"], "(?i)^plural").collect()), key=lambda r: r[2])
    assert got == [("bay", "verb", 0, "to fly"), ("bay", "verb", 2, "plural of x")]


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        "<rss><channel><item><title>T1</title><link>http://a</link><description>d &amp; e</description><pubDate>Tue, 02 Jan 2024 09:30:00 +0700</pubDate></item>"
        "<item><title>T2</title><guid>g</guid></item><item><link>http://c</link></item></channel></rss>",
        encoding="utf-8",
    )
    got = readers.feed(spark, str(tmp_path / "f.xml"), "s").collect()
    assert [(r["guid"], r["title"], r["summary"], str(r["published_at"])) for r in got] == [("http://a", "T1", "d & e", "2024-01-02 02:30:00")]
    assert readers.feed(spark, str(tmp_path / "none.xml"), "s").count() == 0


def test_dictionary_without_glosses(spark, tmp_path):
    spark.createDataFrame([("máy bay", "máy bay", 2), ("a b c d e", "x", 5)], "headword string, display string, syllable_count int").write.parquet(str(tmp_path / "entries.parquet"))
    got = readers.dictionary_table(spark, str(tmp_path)).collect()
    assert [(r["headword"], r["senses"]) for r in got] == [("máy bay", [])]
    spark.createDataFrame([("máy bay", 1, "b"), ("máy bay", 0, "a")], "headword string, rank int, gloss string").write.parquet(str(tmp_path / "glosses.parquet"))
    assert readers.dictionary_table(spark, str(tmp_path)).first()["senses"] == ["a", "b"]


def test_report_resumes(spark, tmp_path):
    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "id int, status string")
    path = str(tmp_path / "report")
    assert writers.report(df, path, "id") == 2 and writers.report(df, path, "id") == 0
    assert writers.report(df.unionByName(spark.createDataFrame([(3, "ok")], df.schema)), path, "id") == 1
    assert writers.snapshot(df, str(tmp_path / "t")) != writers.snapshot(df, str(tmp_path / "t"))


def test_frames(spark):
    lines = [
        (1, 0, 'data: {"choices":[{"delta":{"content":"Xin "}}]}'), (1, 1, "data: {oops"), (1, 2, ": comment"), (1, 3, 'data: {"choices":[{"delta":{"content":null,"reasoning_content":"hm"}}]}'),
        (1, 4, 'data: {"choices":[{"delta":{"content":"chào"}}],"usage":{"total_tokens":5}}'), (1, 5, "data: [DONE]"), (1, 6, 'data: {"choices":[{"delta":{"content":"!"}}]}'),
    ]
    got = frames.fold(spark.createDataFrame(lines, "call_id int, seq int, line string")).collect()
    assert [tuple(r) for r in got] == [(1, "Xin chào", 5)]
    texts = ['```json\n{"a": 1}\n```', 'well {"a": 1} done', "no", None, "[1]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.get_json_object(frames.json_object(F.col("t")), "$.a").alias("a"))
    assert [r["a"] for r in df.collect()] == ["1", "1", None, None, None]


PAGE = """<html><body><header><p>Menu that is quite long, long enough to look like prose indeed.</p></header><div id=m>{}</div>
<aside><p>Another story that should never be part of the body of this page.</p></aside><footer><p>Footer</p></footer><script>var x = "<p>no</p>"</script></body></html>"""


def test_page_body():
    prose = "This is one paragraph of the story, long enough to count as prose here."
    assert pages.body(PAGE.format(f"<p>{prose}</p><p>{prose} Two</p>")) == f"{prose}\n\n{prose} Two"
    assert pages.body(PAGE.format(f"<div><p>{prose}</p></div><div><p>{prose} Two</p></div>")) == f"{prose}\n\n{prose} Two"
    assert pages.body(PAGE.format(f"<p><a href=x>{prose}</a></p>")) == ""
    assert pages.body("") == "" and pages.body("<p>unclosed " + "x" * 50) == "unclosed " + "x" * 50


def test_bodies_with_reasons(spark):
    df = spark.createDataFrame([(1, None), (2, "<p>short</p>"), (3, "<main>" + "<p>" + "word " * 60 + "</p></main>")], "id int, h string")
    got = {r["key"]: (r["ok"], r["reason"]) for r in pages.bodies(df, "id", "h").collect()}
    assert got == {1: (False, "no page"), 2: (False, "no prose"), 3: (True, "")}


def test_markup_and_change():
    assert pages.plain("<p>a &amp; b</p><p>c</p><script>x</script>") == "a & b c" and pages.plain(" a  > b ") == "a > b"
    assert pages.change_ratio("a b c d", "a x c d") == 0.25 and pages.change_ratio("", "a") == 0 and pages.change_ratio("a", "b c d") == 3


def test_strip_html_of_every_summary(spark, tmp_path):
    cases = {
        "a  b": "a b", "<p>a &amp; b</p>": "a & b", "<p>a<br": "a", "<p>a</": "a", "<p>a</p": "a", "a <a href='x": "a", "<p>a<!-- b": "a", "<p>a &am": "a &am", "<p>a": "a", "a</p>b": "a b",
        "<p>a</p><p>b</p>": "a b", "<p>1 < 2</p>": "1 < 2", "<p>a <": "a <", "": "", "<p></p>": "", "&#7843; b": "&#7843; b", "<p>&#7843;</p>": "ả",
    }
    data = [*enumerate(cases), (900, None)]
    spark.createDataFrame(data, "feed_row_id int, summary string").write.parquet(str(tmp_path / "raw_articles.parquet"))
    got = {r["feed_row_id"]: r["plain"] for r in documents.strip_html(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(cases.values()))


def test_phonology(spark):
    words = ["nghiêng", "quốc", "gì", "gia", "hoa", "oi", "yến", "thuyền", "được", "xyz", "ba"]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    got = {r["s"]: (r["onset"], r["glide"], r["nucleus"], r["coda"], r["tone"]) for r in P.parsed(df, "s").collect()}
    assert got["nghiêng"] == ("ngh", "", "iê", "ng", "ngang") and got["được"] == ("đ", "", "ươ", "c", "nang") and got["thuyền"] == ("th", "u", "yê", "n", "huyen")
    assert got["gì"] == ("g", "", "i", "", "huyen") and got["hoa"] == ("h", "o", "a", "", "ngang") and got["oi"] == ("", "o", "i", "", "ngang")
    assert got["gia"] == ("gi", "", "a", "", "ngang") and got["xyz"][0] is None and got["yến"] == ("", "", "yê", "n", "sac")
    assert df.filter("s = 'quốc'").select(T.toneless("s"), T.tone("s")).first()[:] == ("quôc", "sac")


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 01:00:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-02 01:00:00"), (3, "2024-01-05 00:00:00")]
    df = spark.createDataFrame(rows, "k int, t string").select("k", F.to_timestamp("t").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = queues.drain(stream(), lambda d: d.filter("k <> 2").dropDuplicates(["k"]), str(tmp_path / "acks"), "k", str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "acks")).collect()) == [1, 3]
    for name, made in (("seen", queues.first_seen(stream(), ["k"], "ts")), ("days", queues.day_counts(stream(), "ts"))):
        q = made.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r["k"] for r in spark.table("seen").collect()) == [1, 2, 3]
    assert {str(r["day"])[:10]: r["n"] for r in spark.table("days").collect()} == {"2024-01-01": 2, "2024-01-02": 1}


def test_feeds_are_read_each_for_itself(spark, tmp_path):
    good = tmp_path / "good.xml"
    good.write_text("<rss><channel><item><title>Một</title><link>https://a.example/1</link><guid>1</guid></item></channel></rss>")
    (tmp_path / "empty.xml").write_text("")
    items, failed = readers.feeds(spark, {"a": str(good), "b": str(tmp_path / "missing.xml"), "c": str(tmp_path / "empty.xml")})
    assert [(r["source"], r["title"]) for r in items.collect()] == [("a", "Một")] and set(failed) == {"b", "c"}
    items, failed = readers.feeds(spark, {"b": str(tmp_path / "missing.xml")})
    assert items.count() == 0 and set(failed) == {"b"}


def test_wholesale_replacement(spark, tmp_path):
    root = str(tmp_path / "table")
    writers.replace(spark.range(12).coalesce(1), root, per_file=5)
    first = writers.current(spark, root)
    assert first.count() == 12 and len(first.inputFiles()) == 3
    writers.replace(spark.range(3), root)
    assert writers.current(spark, root).count() == 3 and first.count() == 12


def test_word_lists_meet_in_composed_form(spark, tmp_path):
    import unicodedata

    (tmp_path / "a.txt").write_text("không khí\n# note\n\n")
    (tmp_path / "b.txt").write_text(unicodedata.normalize("NFD", "Không  khí") + "\n")
    merged, missing = readers.word_lists(spark, str(tmp_path), ["a.txt", "b.txt", "c.txt"])
    assert [tuple(r) for r in merged.collect()] == [("không_khí", "không khí", ["a", "b"])] and missing == ["c.txt"]


def test_atom_feeds(spark, tmp_path):
    (tmp_path / "atom.xml").write_text(
        '<feed xmlns="http://www.w3.org/2005/Atom"><title>Báo</title><link href="https://a.example/"/>'
        '<entry><title>Một</title><link rel="enclosure" href="https://a.example/1.mp3"/><link rel="alternate" href="https://a.example/1"/><id>tag:1</id><published>2024-01-02T09:30:00+07:00</published><author><name>Lan</name></author><summary>Tóm tắt</summary></entry>'
        '<entry><title>Hai</title><link href="https://a.example/2"/><updated>2024-01-03T00:00:00Z</updated></entry><entry><title>Không có trang</title></entry></feed>'
    )
    got = {r["guid"]: (r["url"], r["title"], str(r["published_at"]), r["author"], r["summary"]) for r in readers.feed(spark, str(tmp_path / "atom.xml"), "a").withColumn("published_at", F.col("published_at").cast("string")).collect()}
    assert got == {"tag:1": ("https://a.example/1", "Một", "2024-01-02 02:30:00", "Lan", "Tóm tắt"), "https://a.example/2": ("https://a.example/2", "Hai", "2024-01-03 00:00:00", None, "")}
