"""Text functions as JVM column expressions. Null in, null out, unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space as text pipelines understand it (ASCII and Unicode), for Java and RE2 alike.
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: One unit: a run of letters, figures and underscores.
UNIT = r"[\p{L}\p{N}_]+"
#: Gaps inside numbers, between two runs of figures.
NUMBER_GAPS = (".", ",", "/", ":", "-", "–")
# Function words of the merge guard.
FUNCTION_WORDS = (
    "của và với cho các những một mọi này đó kia ấy nào ai gì thì mà nên nhưng hoặc nếu vì do bởi để đã đang sẽ vừa mới cũng đều chỉ còn rất quá lắm hơn không "
    "chẳng chưa phải được bị có là ở tại từ đến tới về ra vào lên xuống rồi trước sau trong ngoài trên dưới giữa khi lúc nay ông bà anh chị em nó họ ta tôi "
    "mình chúng người tháng ngày năm lại đây thế vậy"
).split()


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Text without white space at both ends (any white space, unlike `trim`)."""
    return F.regexp_replace(_c(x), rf"^{SPACE}+|{SPACE}+\z", "")


def squeeze(x: Column | str) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(x), f"{SPACE}+", " "))


def paragraphs(x: Column | str) -> Column:
    """Squeezed non-empty paragraphs (separated by blank lines; CR LF and CR count as line ends)."""
    text = F.regexp_replace(_c(x), "\r\n?", "\n")
    return F.filter(F.transform(F.split(text, rf"\n(?:{SPACE}*\n)+"), squeeze), lambda p: p != "")


def paragraph_squeeze(x: Column | str) -> Column:
    """Squeezed paragraphs with one blank line between them."""
    return F.array_join(paragraphs(x), "\n\n")


def units(x: Column | str) -> Column:
    """Units of a text in order."""
    return F.regexp_extract_all(_c(x), F.lit(f"({UNIT})"), F.lit(1))


def unit_count(x: Column | str) -> Column:
    """Number of units; an underscore joins, so `a_b` is one."""
    return F.size(units(x))


def words_in_chunk(x: Column | str) -> Column:
    """Units of a chunk in which underscores separate."""
    return F.size(units(F.translate(_c(x), "_", " ")))


def grouping(segmented: Column | str) -> Column:
    """Counts of units per white-space chunk of an underscore-joined text; chunks without units have none."""
    return F.filter(F.transform(F.split(_c(segmented), f"{SPACE}+"), words_in_chunk), lambda n: n > 0)


def covers(counts: Column | str, n: Column | str) -> Column:
    """Whether a grouping is all positive and covers exactly n units."""
    c = _c(counts)
    return F.forall(c, lambda k: k > 0) & (F.aggregate(c, F.lit(0), lambda a, k: a + k) == _c(n))


def form(x: Column | str) -> Column:
    """Headword form: squeezed, lower case, spaces as underscores."""
    return F.translate(F.lower(squeeze(x)), " ", "_")


def clean_gloss(x: Column | str, most: int = 200) -> Column:
    """Squeezed gloss of at most `most` characters, an ellipsis where it was cut."""
    s = squeeze(x)
    return F.when(F.length(s) > most, F.concat(F.rtrim(F.substring(s, 1, most - 1)), F.lit("…"))).otherwise(s)


def sentence_around(text: Column | str, offset: Column | str, ends: str = ".!?…\n") -> Column:
    """The sentence around a 0-based offset: from after the last end mark before it to the next one, inclusive, stripped.

    Offsets are clamped to the text.
    """
    t = _c(text)
    at = F.greatest(F.lit(0), F.least(_c(offset), F.length(t))).cast("int")
    cls = "".join("\\" + e if e in ".?" else e for e in ends)
    before = F.regexp_extract(F.substring(t, F.lit(1), at), rf"([^{cls}]*)\z", 1)
    after = F.regexp_extract(F.substring(t, at + 1, F.length(t)), f"^([^{cls}]*[{cls}]?)", 1)
    return strip(F.concat(before, after))


def word_at(text: Column | str, offset: Column | str) -> Column:
    """White-space-delimited chunk under a 0-based offset; '' on white space or outside the text."""
    t, o = _c(text), _c(offset).cast("int")
    before = F.regexp_extract(F.substring(t, F.lit(1), o), r"([^\t-\r ]*)\z", 1)
    after = F.regexp_extract(F.substring(t, o + 1, F.length(t)), r"^([^\t-\r ]*)", 1)
    return F.when((o < 0) | (o >= F.length(t)) | (after == ""), F.lit("")).otherwise(F.concat(before, after))


def content_words(x: Column | str, stop: tuple[str, ...]) -> Column:
    """Lower-case words longer than one letter that are no stop words."""
    words = F.split(F.regexp_replace(F.lower(_c(x)), r"[^\p{L}\p{N}]+", " "), " ")
    stops = F.array(*map(F.lit, stop))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(stops, w))


def string_list(x: Column | str) -> Column:
    """A list given as text: split at semicolons and line ends, stripped, blanks dropped."""
    return F.filter(F.transform(F.split(_c(x), "[;\n]"), lambda s: F.trim(s)), lambda s: s != "")


# Letters by tone; each line holds the vowels in the order of BASE with that tone's mark.
BASE = "aăâeêioôơuưyAĂÂEÊIOÔƠUƯY"
TONES = {
    "huyen": "àằầèềìòồờùừỳÀẰẦÈỀÌÒỒỜÙỪỲ",
    "sac": "áắấéếíóốớúứýÁẮẤÉẾÍÓỐỚÚỨÝ",
    "hoi": "ảẳẩẻểỉỏổởủửỷẢẲẨẺỂỈỎỔỞỦỬỶ",
    "nga": "ãẵẫẽễĩõỗỡũữỹÃẴẪẼỄĨÕỖỠŨỮỸ",
    "nang": "ạặậẹệịọộợụựỵẠẶẬẸỆỊỌỘỢỤỰỴ",
}


def toneless(x: Column | str) -> Column:
    """A composed syllable without its tone mark."""
    return F.translate(_c(x), "".join(TONES.values()), BASE * len(TONES))


def tone(x: Column | str) -> Column:
    """Tone name of a composed syllable: that of its last marked vowel, `ngang` without one."""
    last = F.regexp_extract(_c(x), "([" + "".join(TONES.values()) + "])[^" + "".join(TONES.values()) + "]*\\z", 1)
    out = F.lit("ngang")
    for name, letters in TONES.items():
        out = F.when((last != "") & F.lit(letters).contains(last), F.lit(name)).otherwise(out)
    return F.when(_c(x).isNotNull(), out)
