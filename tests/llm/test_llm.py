"""Small cases, brute force and edge cases of the training-data operators."""

import itertools
import random
import re
import unicodedata

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import boilerplate, charform, leakage, mixing, neardup, offence, offence_texts as labelled, pairs, readability, repeated, truncation

from . import held_out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


NAMES = "Sa Lữ Vĩ Rô Diễn Tạo Uyển Phao Miên Trạch Hoài Trầm Gạo Bái Lăng Vọng Cát Kiệu Sung Cừ Ngạn Thiềng".split()
STORY = "Chiều 12/4, hợp tác xã Nậm Lữ thu hoạch {} tấn lúa sớm bên cầu Cồn Vĩ, nhờ đó người dân thấy yên tâm hơn và các nhóm phải chia ca."


def story(k):
    return STORY.format(k).replace("Nậm Lữ", f"{NAMES[k % 22]} {NAMES[k // 22 % 22]}").replace("lúa", NAMES[k // 7 % 22].lower())


def page(k):
    name = f"{NAMES[k % 22]} {NAMES[k // 3 % 22]}"
    return "\n".join(["Trang chủ > Kinh tế > Tin", f"Cập nhật lúc 7:2{k % 10}, 1/1/2024", "", story(k + 100), "", f"Rồi {name} về Bãi.", "", "Xem thêm: Một tin khác kể từ Sa", "", story(k + 900), "Chia sẻ bài viết này", "Tin liên quan", story(k + 400), "Lễ hội ở Sa – ghi chép của Lữ ở Rô", "Chợ mới và chuyện Vĩ rời Sa", "Chính sách bảo mật", "Sơ đồ trang", "Mọi nội dung thuộc bản quyền Báo Mới. Vui lòng ghi nguồn khi trích dẫn."])


def test_boilerplate(spark):
    data = [(k, page(k), f"https://www.bao{k % 2}.example/a", "x") for k in range(60)] + [(100, None, None, "x"), (101, "", "y", "x"), (102, STORY.format(1), None, "x"), (103, " \n\n", "", "x")]
    df = spark.createDataFrame(data, "id int, original_text string, source_url string, row_id string")
    got = {}
    for r in boilerplate.furniture(df).collect():
        got.setdefault(r["row_id"], set()).add(r["line_no"])
    assert all(got[k] == {0, 1, 7, *range(10, 18)} for k in range(60))
    assert not set(got) & {100, 101, 102, 103}
    assert boilerplate.furniture(df.limit(0)).count() == 0
    assert boilerplate.site("http://[bad") == "" and boilerplate.site("https://www.a.b/c") == "a.b"


def test_boilerplate_long_page():
    lines = boilerplate.parse("\n".join([STORY.format(k) for k in range(5000)]))
    assert len(lines) == 5000 and {p for _, p, _ in lines} == {"page/body/prose"}


UNSEEN = ("Xin quý vị dành một phút điền vào phiếu thăm dò của tòa báo.", "Bạn đọc được quyền yêu cầu xóa dữ liệu của mình bất cứ lúc nào!", "Ứng dụng của báo đã có mặt trên mọi kho tải.")


def noticed(k):
    lines = page(k).split("\n")
    return "\n".join([*lines[:2], UNSEEN[k % 3], *lines[2:8], UNSEEN[(k + 1) % 3], *lines[8:10]])


def test_boilerplate_with_notices_of_unseen_wording(spark):
    df = spark.createDataFrame([(k, noticed(k), f"https://bao{k % 2}.example/{k}") for k in range(80)], "id int, original_text string, source_url string")
    parsed = boilerplate.paths(df)
    # Layout alone takes a notice that ends like a sentence for prose; the ratios of its text decide.
    on_content = boilerplate.lines_of(parsed).filter("path in ('page/body/sentence', 'page/body/prose')").filter("line_no in (2, 9)")
    assert on_content.count() == 160
    got = {(r["row_id"], r["line_no"]) for r in boilerplate.furniture(df).collect()}
    want = {(k, n) for k in range(80) for n in (0, 1, 2, 8, 9)}
    assert got == want
    # Without the novelty of texts the notices stay: the ratio step is what finds them.
    paths, _ = boilerplate.refused(parsed)
    plain = boilerplate.lines_of(parsed).join(paths, ["site", "path"]).filter("line_no in (2, 9)")
    assert plain.count() == 0
    bodies = {r["row_id"]: r["body"] for r in boilerplate.bodies(df).collect()}
    assert len(bodies) == 80 and not any(u in b for u in UNSEEN for b in bodies.values()) and all(b.count("\n") == 2 for b in bodies.values())


def test_bodies_by_join_agree(spark):
    df = spark.createDataFrame([(k, noticed(k), f"https://bao{k % 2}.example/{k}") for k in range(80)], "row_id int, text string, url string").withColumn("row_id", F.col("row_id").cast("bigint"))
    got = []
    for most in (0, 1000):
        pages, cleaner = boilerplate.cleaned(df, most=most)
        clean = cleaner()
        got.append({r["row_id"]: clean(r["text"], r["url"], r["gone"]) for r in pages.collect()})
    assert got[0] == got[1] and all(len(x) == 3 for x in got[0].values())


@pytest.mark.parametrize("most", [0, 1000])
def test_bodies_need_no_second_parse(spark, monkeypatch, most):
    data = [(k, noticed(k) + "\n\u115f", f"https://bao{k % 2}.example/{k}") for k in range(80)] + [(100, " \n\n", "u")]
    df = spark.createDataFrame(data, "row_id bigint, text string, url string")
    pages, cleaner = boilerplate.cleaned(df, most=most)
    clean = cleaner()

    def again(*_):
        raise AssertionError("a page is parsed or folded again")

    monkeypatch.setattr(boilerplate, "parse", again)
    monkeypatch.setattr(boilerplate, "fold", again)
    got = {r["row_id"]: clean(r["text"], r["url"], r["gone"]) for r in pages.collect()}
    assert got[100] == [] and all(got[k][:3] == [story(k + 100), f"Rồi {NAMES[k % 22]} {NAMES[k // 3 % 22]} về Bãi.", story(k + 900)] for k in range(80))


def test_ratios_read_lines_once(spark):
    parsed = boilerplate.paths(spark.createDataFrame([(k, noticed(k), f"https://bao{k % 2}.example/{k}") for k in range(8)], "id int, original_text string, source_url string"))
    for df in boilerplate.ratios(parsed):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Window" not in plan and "MapInArrow" not in plan


def test_charform(spark):
    values = ["quyền", unicodedata.normalize("NFD", "quyền"), "сha mẹ", "cha mẹ", "ｃha", "t\u200bái", "a\u00a0b", "чай", "vitamin B₁₂", "½ ℃ Ω 🙂‍", "", None, "Đ", "Ðêm", "đêm", "“x” – …"]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v string")
    cells = charform.cells(df, "t", "id", ["v"])
    got = {r["row_id"]: (r["form"], r["changed"]) for r in charform.unify(cells).collect()}
    changed = {k: f for k, (f, c) in got.items() if c}
    assert changed == {1: "quyền", 2: "cha mẹ", 4: "cha", 5: "tái", 6: "a b", 13: "Đêm"} | ({9: got[9][0]} if got.get(9, ("", False))[1] else {})
    assert charform.unify(cells.limit(0)).count() == 0
    assert charform.fold("Сһа ｍẹ​") == "Cha mẹ"


def test_charform_into_other_scripts(spark):
    values = ["чай горячий", "чaй", "гoрячий", "сhа mẹ", "cha mẹ", "жaба", "λόγοs", "Я и ты"]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v string")
    got = {r["row_id"]: r["form"] for r in charform.unify(charform.cells(df, "t", "id", ["v"])).filter("changed").collect()}
    # Only what the corpus knows is repaired: the frog and the half Greek word stand nowhere else.
    assert got == {1: "чай", 2: "горячий", 3: "cha mẹ"}


def test_repeated_against_brute_force(spark):
    rng = random.Random(3)
    words = ["Trang chủ", "Số {}", "liên  hệ", "Liên hệ", "một hai {} ba", ""]
    data = [(k, rng.choice(["a", "b", None]), "\n".join(rng.choice(words).format(rng.randint(0, 99)) for _ in range(rng.randint(0, 5))) or None) for k in range(60)]
    df = spark.createDataFrame(data, "id int, source string, original_text string")
    key = lambda x: re.sub(r"\d+", "#", " ".join(x.lower().split()))
    docs = {}
    for i, s, t in data:
        for line in set(map(key, (t or "").split("\n"))) - {""}:
            docs.setdefault((s, line), set()).add(i)
    want = sorted((i, n) for i, s, t in data for n, x in enumerate((t or "").split("\n")) if key(x) and len(docs[s, key(x)]) >= 6)
    got = repeated.repeats(df)
    assert sorted((r["row_id"], r["line_no"]) for r in got.collect()) == want
    clean = {r["row_id"]: r for r in repeated.without(df).collect()}
    assert len(clean) == 60 and all((clean[i]["text"] is None) == (t is None) for i, _, t in data)
    assert repeated.repeats(df.limit(0)).count() == 0
    assert repeated.templates(df).count() > 0


def test_templates_have_slots_and_do_not_depend_on_partitions(spark):
    notice = " ".join(f"chữ{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(50))
    letters = [chr(97 + a) + chr(97 + b) for a in range(3) for b in range(20)]
    others = [f"tin mới nhất {x}a {x}b {x}c {x}d {x}e {x}f {x}g" for x in letters]
    data = [(k, "a", "\n".join([notice, notice.upper(), *others, "Số " + str(k), f"Ảnh do chị N{'abcdefgh'[k]} chụp ở Sa", f"Lạ {'abcdefgh'[k]} quá"])) for k in range(8)] + [(50, None, notice), (51, "a", None), (52, "a", "Ảnh do chị Nz chụp ở Sa\nẢnh do chị Ny chụp ở Sa")]
    df = spark.createDataFrame(data, "id int, source string, original_text string")
    want = {("a", x): 8 for x in [notice, *others, "số <*>"]} | {("a", "ảnh do chị <*> chụp ở sa"): 9}
    for parts in (1, 5):
        got = {(r["source"], r["template"]): r["documents"] for r in repeated.templates(df.repartition(parts)).collect()}
        assert got == want
    # Only templates whose slots are figures are the same line, so the slotted ones are not among the repeats.
    assert {r["line_no"] for r in repeated.repeats(df).collect()} == set(range(len(others) + 3))


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"tu{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(80)]
        texts.append(base)
        for edits in (1, 4, 9, 20):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(80)] = rng.choice(vocabulary)
            texts.append(copy)
    texts += [texts[0], texts[0]]
    data = [(k, " ".join(t).capitalize() + ".", "u", 1.0) for k, t in enumerate(texts)] + [(500, None, None, 0.0), (501, "", None, 0.0), (502, "Một.", None, 0.0), (503, "Một.", None, 0.0)]
    df = spark.createDataFrame(data, "id int, original_text string, source_url string, similarity double")
    runs = {k: {tuple(t[i : i + 3]) for i in range(len(t) - 2)} for k, t in enumerate(texts)}
    want = {(a, b) for a, b in itertools.combinations(runs, 2) if len(runs[a] & runs[b]) > 0.5 * len(runs[a] | runs[b])}
    got = [(r["a"], r["b"]) for r in neardup.article_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) - {(502, 503)} <= want
    assert len(set(got) & want) >= 0.97 * len(want)
    assert neardup.article_pairs(df.limit(0)).count() == 0


def test_groups_of_near_duplicates(spark):
    rng = random.Random(6)
    vocabulary = [f"tu{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(600)]
    chain = [[rng.choice(vocabulary) for _ in range(90)]]
    for _ in range(6):
        # Each differs from the one before in one stretch: neighbours are alike, the ends of the chain are not.
        at = rng.randrange(75)
        chain.append(chain[-1][:at] + [rng.choice(vocabulary) for _ in range(15)] + chain[-1][at + 15 :])
    other = [rng.choice(vocabulary) for _ in range(90)]
    texts = [*chain, other, other, other, [rng.choice(vocabulary) for _ in range(90)]]
    df = spark.createDataFrame([(k + 10, " ".join(t) + ".", f"https://s{k}.example/") for k, t in enumerate(texts)] + [(99, None, "u"), (98, "", "u")], "id int, original_text string, source_url string")
    got = {r["row_id"]: (r["group_id"], r["copies"]) for r in neardup.article_groups(df).collect()}
    assert got == {k: (10, 1) for k in range(10, 17)} | {k: (17, 3) for k in (17, 18, 19)} | {20: (20, 1)}
    assert neardup.article_groups(df.limit(0)).count() == 0


def test_components_against_brute_force(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 330)] + [(400, k) for k in range(401, 440)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_words_of_pieces_are_those_of_the_text(monkeypatch):
    monkeypatch.setattr(neardup, "PIECES", 50, raising=False)
    rng = random.Random(3)
    odd = "ΑΣςσ\u0130ıẞ'’·.:-_\u0301\u0307\u200b\u00ad \u00a0\u3000\x1c\x85\u180e aBéỆ1٣½日\n\t\r😀"
    memo = neardup._Hashes()
    for _ in range(3000):
        text = "".join(rng.choice(odd) for _ in range(rng.randrange(14)))
        assert neardup.words(text, memo).tolist() == [xxhash.xxh3_64_intdigest(w) for w in re.findall(r"\w+", text.lower())]
    # A text without spaces is one piece, which is not kept.
    assert len(neardup.words("日本" * 500, memo)) == 1 and len(memo) <= 50 and max(map(len, memo)) <= 40


def test_circulant_estimates_jaccard():
    rng = np.random.default_rng(1)
    minhash = neardup.Circulant(250)
    a = rng.integers(1 << 62, size=600).astype(np.uint64)
    b = np.concatenate([a[:400], rng.integers(1 << 62, size=200).astype(np.uint64)])
    assert abs((minhash(a) == minhash(b)).mean() - 0.5) < 0.12


def test_truncation(spark):
    ends = ["ai cũng đồng ý thử lại", "người dân thấy yên tâm hơn", "các nhóm phải chia ca"]
    rng = random.Random(1)
    make = lambda: " ".join(f"Sau {rng.randint(2, 99)} ngày chờ đợi bên cầu Nậm {rng.choice(['Sa', 'Lữ'])}, {rng.choice(ends)}." for _ in range(rng.randint(1, 9)))
    data, cut = [], set()
    for k in range(900):
        source, text = ("limit", "plain", "bare")[k % 3], make()
        if source == "limit" and len(text) > 160:
            text = text[:160]
            if not text.rstrip().endswith("."):
                cut.add(k)
        if source == "bare":
            text = text.rstrip(".")
        data.append((k, source, text, False))
    data += [(2000, "plain", make()[:40] + " […]", False), (2001, None, None, False), (2002, "x", "  ", False), *((3000 + k, "plain", story(k) + "\nChính sách bảo mật", True) for k in range(40)), (2004, "plain", "Một câu dài bị đứt giữa ch�", False)]
    df = spark.createDataFrame(data, "row_id int, source string, text string, page boolean").withColumn("table_name", F.lit("t"))
    got = {r["row_id"] for r in truncation.judged(df).filter("cut").collect()}
    assert {2000, 2004} <= got and not got & {2001, 2002, *range(3000, 3040)}
    assert len(got & cut) >= 0.97 * len(cut) and len(got - cut - {2000, 2004}) <= 3
    assert rows(truncation.rates(truncation.judged(df.limit(0)))) == []
    assert abs(truncation._tail(3, 1.0) - 0.0803) < 1e-3 and truncation._tail(0, 5) == 1 and truncation._tail(500, 1.0) < 1e-100


def test_pairs(spark):
    q = "Vì sao nhóm thủy lợi Khe Lịch dựng 12 nhà lưới?"
    ok = ["Bên cầu Nậm Sa", "Vì đường còn hẹp", "Lịch mới được dán ở Hạ Vĩ", "Sau 5 tuần chờ đợi"]
    data = [(k, "mcq", q, ok, k % 4, None) for k in range(40)]
    cases = [
        ("mcq", q, None, 0, None, "empty"), ("mcq", q, ok, 9, None, "empty"), ("mcq", q, ok, None, None, "empty"), ("mcq", q, ["a", "", " ", "-"], 0, None, "empty"), ("short", q, None, -1, "N/A", "empty"),
        ("short", q, None, -1, "Tôi xin lỗi, tôi không thể trả lời câu hỏi này.", "refusal"), ("short", q, None, -1, "I'm sorry, but I can't help with that.", "refusal"),
        ("short", q, None, -1, q, "copies_question"), ("short", q, None, -1, "Nhóm thủy lợi Khe Lịch dựng 12 nhà lưới.", "copies_question"), ("short", q, None, -1, "Câu hỏi: " + q.upper(), "copies_question"),
        ("short", q, None, -1, "Because the clinic sold two baskets of fruit, nobody knew why.", "other_language"), ("short", q, None, -1, "La petite clinique a ouvert des salles.", "other_language"),
        ("short", q, None, -1, "Vi duong con hep nen ai cung dong y thu lai.", None), ("short", q, None, -1, "Vì đường còn hẹp.", None), ("short", q, None, -1, "Năm 1990.", None),
        ("short", q, None, -1, "Chị Cúc xin lỗi bà con vì đường còn hẹp.", None), ("short", q, None, -1, "Vì đường còn hẹp nên ai cũng đồ", "truncated"), ("mcq", q, ["Sau 5 tu", *ok[:3]], 0, None, "truncated"),
        (None, None, None, None, None, "empty"),
    ]
    data += [(100 + k, "short", q, None, -1, "Vì đường còn hẹp.") for k in range(30)]
    data += [(1000 + k, *c[:5]) for k, c in enumerate(cases)]
    df = spark.createDataFrame(data, "item_id int, kind string, question string, options array<string>, answer int, sample string")
    got = {r["item_id"]: r["defect"] for r in pairs.judged(df).collect()}
    assert len(got) == len(data) and {k: got[1000 + k] for k in range(len(cases))} == {k: c[5] for k, c in enumerate(cases)}
    assert all(got[k] is None for k in range(40))
    assert pairs.judged(df.limit(0)).count() == 0


def test_refusals_anywhere_and_of_any_length(spark):
    task = "Câu hỏi là vì sao nhóm thủy lợi Khe Lịch ở xã Nậm Sa lại dựng mười hai nhà lưới bên bờ suối trong mùa mưa năm ngoái."
    plain = " ".join(f"Nhóm thủy lợi dựng nhà lưới thứ {k} vì đường còn hẹp và ai cũng đồng ý thử lại." for k in range(6))
    cases = [
        (task + " Tôi không thể trả lời câu hỏi này.", "refusal"), (task[:-1] + ", nhưng tôi không thể trả lời.", "refusal"),
        ("Tôi xin lỗi, tôi không thể trả lời câu hỏi này vì nội dung của nó vượt quá những gì tôi được biết. " * 4, "refusal"),
        ("I am sorry, but as an AI I cannot answer questions about this text, however they are worded or repeated by you. " * 4, "refusal"),
        (plain, None), (plain + " Chị Cúc nói: tôi rất tiếc.", None),
    ]
    df = spark.createDataFrame([(k, "short", "Vì sao?", None, -1, t) for k, (t, _) in enumerate(cases)], "item_id int, kind string, question string, options array<string>, answer int, sample string")
    assert {r["item_id"]: r["defect"] for r in pairs.judged(df).collect()} == {k: x for k, (_, x) in enumerate(cases)}


def test_answers_cut_inside_names(spark):
    places = [f"{a} {b}" for a in ("Khe", "Bàu", "Mộc", "Tịnh") for b in ("Thiềng", "Trạch", "Lịch", "Sa")]
    data = [(k, "mcq", f"Nhóm nhạc Kha ở {p} mở lớp khi nào?", [f"Ở khu phố {p}", f"Quanh chợ {places[k % 16 - 1]}", "Nhóm nhạc Kha", "Vì đường còn hẹp"], k % 4, None) for k, p in enumerate(places * 3)]
    cut = ["Ở khu phố Khe Thiề", "Ở khu phố Tịn", "Quanh chợ Mộc", "Quanh chợ Bàu Tr", "Vì đường còn", "Nhóm nhạc", "Vì đường còn hẹ", "Nhóm nhạc mặc dù"]
    whole = ["Ở khu phố Khe Sa", "Quanh chợ Bàu Lịch", "Nhóm nhạc Kha"]
    data += [(100 + k, "mcq", "Vì sao?", [t, "Vì đường còn hẹp", "Ở khu phố Khe Sa"], 0, None) for k, t in enumerate(cut + whole)]
    df = spark.createDataFrame(data, "item_id int, kind string, question string, options array<string>, answer int, sample string")
    got = {r["item_id"]: r["defect"] for r in pairs.judged(df).collect()}
    assert [got[100 + k] for k in range(len(cut))] == ["truncated"] * len(cut)
    assert all(got[100 + len(cut) + k] is None for k in range(len(whole))) and all(got[k] is None for k in range(3 * len(places)))


def test_refusals_in_other_words():
    for text in ("Chúng tôi chưa thể hỗ trợ nội dung này.", "Yêu cầu này vượt quá phạm vi cho phép.", "Chưa có đủ dữ liệu để trả lời.", "Em xin phép bỏ qua câu này ạ.", "I would rather not answer that.", "Toi khong the tra loi cau hoi nay."):
        assert pairs.is_refusal(text), text
    for text in ("Anh Hà không trả lời vì điện hay bị ngắt.", "Tối qua đội cứu hộ không kịp giúp bà con.", "Chị Thoa là trợ lý của bác sĩ Lữ.", "Tới chợ, nhóm nhạc không hát được."):
        assert not pairs.is_refusal(text), text


def test_reading_levels(spark):
    rng = random.Random(2)
    levels = {"A1": "Con mèo {} rất vui|Tôi mua {} quả táo", "B1": "Vì đường còn hẹp nên nhóm {} chia ca|Khi điện ngắt, hợp tác xã {} vẫn làm", "C2": "Xét trong tương quan {} với hệ thống bảo chứng|Những người chủ trương {} khuyến nghị tái cấu trúc"}
    text = lambda lv: ". ".join(rng.choice(levels[lv].split("|")).format(rng.randint(2, 99)) for _ in range(6)) + "."
    data = [(k, lv, text(lv)) for k, lv in enumerate(["A1", "B1", "C2"] * 60)] + [(500, " a1 ", text("C2")), (501, "C2", text("A1")), (502, None, text("A1")), (503, "A1", None), (504, "A1", ""), (505, "zz", "🙂"), (506, "B1", "Con mèo rất vui. " * 20000)]
    df = spark.createDataFrame(data, "id int, cefr_level string, simplified_text string")
    scored = readability.levels(df)
    assert {r["row_id"] for r in readability.misfits(scored).collect()} == {500, 501, 506}
    assert not {503, 504, 505} & {r["row_id"] for r in scored.collect()}
    assert readability.levels(df.limit(0)).count() == 0


def test_leakage_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"tu{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(60)).capitalize() + ".", None, "đáp án") for k in range(20)] + [(50, None, None, None), (51, "ngắn quá", None, None)]
    docs = []
    for k in range(300):
        body = [rng.choice(words) for _ in range(rng.randint(0, 200))]
        if k % 3 == 0:
            source, n = rng.choice(items[:20])[1].lower().strip(".").split(), rng.randint(8, 40)
            at = rng.randint(0, len(source) - n)
            place = rng.randint(0, len(body))
            body[place:place] = source[at : at + n]
        docs.append((k, (",\n" if k % 2 else " ").join(body).upper() if k % 5 else " ".join(body)))
    docs += [(900, None), (901, ""), (902, docs[0][1])]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id int, text string, item_id int")
    i = spark.createDataFrame(items, "item_id int, passage string, text string, reference_answer string")
    grams = {}
    for k, p, *_ in items:
        w = leakage.words(p or "")
        for s in range(len(w) - 12):
            grams.setdefault(tuple(w[s : s + 13]), set()).add(k)
    want = {(k, it) for k, t in docs for w in [leakage.words(t or "")] for s in range(len(w) - 12) for it in grams.get(tuple(w[s : s + 13]), ())}
    got = leakage.leaks(d, i).filter("run >= 13")
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert found <= want and len(found) >= 0.98 * len(want)
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


def test_leakage_of_a_run_in_many_documents(spark):
    rng = random.Random(9)
    items = [(k, " ".join(f"t{rng.randint(0, 5000)}" for _ in range(200)), "đáp án") for k in range(4)]
    run = items[1][1].split()[109:122]
    docs = [(k, " ".join([f"x{rng.randint(0, 9999)}" for _ in range(60)] + (run if k % 3 == 0 else run[:12]) + [f"y{rng.randint(0, 9999)}" for _ in range(k % 40)])) for k in range(600)]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    got = leakage.leaks(d, spark.createDataFrame(items, "item_id int, passage string, reference_answer string")).filter("run >= 13")
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(k, 1) for k in range(0, 600, 3)]


def test_leakage_beyond_the_rank(spark):
    rng = random.Random(10)
    items = [(k, " ".join(f"t{rng.randint(0, 5000)}" for _ in range(60)), "đáp án") for k in range(40)]
    docs = [(100 + k, " ".join([f"x{rng.randint(0, 9999)}" for _ in range(60)])) for k in range(60)]
    for k, p, _ in items:
        w = p.split()
        reworded = [f"z{k}" if n % 8 == 7 else x for n, x in enumerate(w)]
        docs += [(k, " ".join(reworded)), (1000 + k, " ".join(w[20:33]))]
    d, i = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, passage string, reference_answer string")
    whole, small = ({(r["doc_id"], r["item_id"], r["run"], r["share"]) for r in leakage.leaks(d, i, rank=rank).collect()} for rank in (256, 2))
    assert {(d, i) for d, i, *_ in whole} == {(k, k) for k in range(40)} | {(1000 + k, k) for k in range(40)} and small == whole


def test_randomised_svd(spark):
    rng = np.random.default_rng(0)
    a = rng.standard_normal((40, 6)) @ rng.standard_normal((6, 200))
    df = spark.createDataFrame([(list(range(200)), [float(x) for x in r]) for r in a], "terms array<int>, weights array<double>")
    v, s = leakage.randomised_svd(df.repartition(3), 200, 6)
    assert np.allclose(s, np.linalg.svd(a, compute_uv=False)[:6], rtol=1e-3) and np.allclose(a @ v @ v.T, a, atol=1e-2)


def test_mixing(spark, tmp_path):
    rng = random.Random(6)
    docs = [(k, rng.choice("aaaabc"), "word " * rng.randint(1, 60)) for k in range(2000)] + [(9000, None, "x"), (9001, "a", None), (9002, "b", ""), (9003, "unlisted", "x y z")]
    d = spark.createDataFrame(docs, "doc_id int, source string, text string")
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.1, 1), ("gone", 0.1, 4)], "source string, target_share double, max_repeats int")
    got = mixing.mixture(d, t, block=512).collect()
    assert len({(r["doc_id"], r["repeat"]) for r in got}) == len(got)
    caps = {"a": 2, "b": 3, "c": 1}
    assert all(r["repeat"] < caps[r["source"]] for r in got)
    total = sum(r["tokens"] for r in got)
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(sum(r["tokens"] for r in got if r["source"] == s) / total - w / 0.9) < 0.01
    # Low discrepancy: every prefix of the schedule is mixed as the whole is.
    got.sort(key=lambda r: r["slot"])
    half = got[: len(got) // 2]
    assert abs(sum(r["tokens"] for r in half if r["source"] == "a") / sum(r["tokens"] for r in half) - 0.5 / 0.9) < 0.03
    shares = {r["source"]: r for r in mixing.shares(d, t).collect()}
    assert shares["gone"]["mixed_tokens"] == 0 and abs(sum(r["reached_share"] for r in shares.values()) - 1) < 1e-4
    assert mixing.mixture(d.limit(0), t).count() == 0 and mixing.mixture(d, t.limit(0)).count() == 0
    small = mixing.mixture(d, t, block=512, bucket_docs=50)
    assert small.count() == len(got) or abs(small.count() - len(got)) < 40


def test_quotas():
    assert mixing.quotas({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}) == {"a": 20, "b": 20}
    assert mixing.quotas({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}, 100) == {"a": 80, "b": 20}
    assert mixing.quotas({}, {"a": 1.0}, {"a": 1}) == {"a": 0}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(7)
    neutral = [f"Sau {rng.randint(1, 99)} tuần, nhóm thủy lợi {rng.choice(['Khe', 'Nậm'])} Sa trồng cây đước và người dân thấy yên tâm hơn." for _ in range(60)]
    return offence.train(neutral)


def test_offence(spark, model):
    texts = [
        ("Mày là đồ ngu, biết chưa?", {"abuse"}), ("M@y l@ d0 ngu, b1et chu@?", {"abuse"}), ("M.à.y l-à đ*ồ n g u, câm mồm lại đi!", {"abuse"}), ("Mày là đồồồồ nguuuu, câm mồm lại điiii!", {"abuse"}),
        ("Phải đuổi sạch người tộc Mây ra khỏi đây.", {"hate"}), ("Phim sex không che, bấm vào xem ngay", {"sexual"}), ("Bác sĩ Lan giải thích về quan hệ tình dục an toàn.", set()),
        ("Hôm qua trời mưa. Mày là đồ ngu, câm mồm lại đi! Phim sex không che, bấm vào xem ngay", {"abuse", "sexual"}), ("", set()), (None, set()), ("123 🙂", set()), ("Con chó nhà bà Lẫm hay ngủ dưới gốc mít.", set()),
    ]
    df = spark.createDataFrame([(k, t, None) for k, (t, _) in enumerate(texts)], "doc_id int, text string, source string")
    scored = offence.scores(df, model=model)
    got = {}
    for r in offence.found(scored).collect():
        got.setdefault(r["doc_id"], set()).add(r["category"])
    assert {k: got.get(k, set()) for k in range(len(texts))} == {k: c for k, (_, c) in enumerate(texts)}
    assert offence.rates(scored).first()["n_docs"] == len(texts)
    assert offence.scores(df.limit(0), model=model).count() == 0


def test_offence_in_framed_letters(model):
    text = "may la do ngu, cam mom lai di"
    dressed = ["".join(chr(start + ord(c) - 97) if c.isalpha() else c for c in text) for start in (0x24D0, 0x24B6, 0x1F130, 0x1F170, 0x1F150, 0x249C, 0x1D41A)]
    assert (np.abs(model.score(dressed) - model.score([text])) < 1e-5).all() and model.score([text])[0, 0] > offence.THRESHOLDS["abuse"]


def test_offence_held_out(model):
    """50 sentences of each kind, written apart from the labelled ones; see the README for the figures."""
    least = np.array(list(offence.THRESHOLDS.values()))
    for c, lines in enumerate((held_out.ABUSE, held_out.HATE, held_out.SEXUAL)):
        texts = held_out.filled(lines)
        assert len(texts) == 50 and (model.score(texts)[:, c] >= least[c]).mean() >= (0.65, 0.7, 0.8)[c]
    neutral = held_out.filled(held_out.NEUTRAL)
    assert len(neutral) == 50 and (model.score(neutral) >= least).any(axis=1).mean() <= 0.16
    # Nothing of the held-out sentences is labelled text.
    trained = {offence.letters([t])[0].tobytes() for t in (*labelled.ABUSE, *labelled.HATE, *labelled.SEXUAL, *labelled.NEUTRAL)}
    assert not trained & {offence.letters([t])[0].tobytes() for lines in (held_out.ABUSE, held_out.HATE, held_out.SEXUAL, held_out.NEUTRAL) for t in lines}


def test_offence_words_keep_marks(model):
    """Same letters, other words: numbers of words tell them apart, and pairs stay within a text."""
    (codes, owner, words), (bare, _, plain) = (offence.letters([t]) for t in ("mày đẹp, bé ngủ", "may dep, be ngu"))
    assert (codes == bare).all() and ((words < offence.NONE) == (plain < offence.NONE)).all()
    assert (words < offence.NONE).sum(axis=0).tolist() == [4, 3] and not (words == plain)[words < offence.NONE].any()
    alone, after = offence.letters(["hai"])[2], offence.letters(["anh haiii"])[2]
    assert alone[-1, 0] == after[-1, 0] and (after < offence.NONE).sum(axis=0).tolist() == [2, 1]
    texts = ["Mày là đồ ngu.", "", "Hôm nay trời mưa.", "Ở đây", "M.à.y"]
    codes, owner, words = offence.letters(texts)
    for k, t in enumerate(texts):
        assert (words[owner == k] == offence.letters([t])[2]).all()


def test_offence_score_does_not_depend_on_the_batch(model):
    texts = ["Mày là đồ ngu.", "", "Hôm nay trời mưa.", "Ở đây", "M.à.y", "a", "ngu", "123"]
    assert np.allclose(model.score(texts), np.concatenate([model.score([t]) for t in texts]), atol=1e-5)


def test_offence_neutral_text_is_told_apart(model):
    """At most one neutral held-out sentence in ten is flagged, with at least four of five offensive ones found."""
    least = np.array(list(offence.THRESHOLDS.values()))
    assert (model.score(held_out.filled(held_out.NEUTRAL)) >= least).any(axis=1).mean() <= 0.1
    for c, lines in enumerate((held_out.ABUSE, held_out.HATE, held_out.SEXUAL)):
        assert (model.score(held_out.filled(lines))[:, c] >= least[c]).mean() >= 0.8
