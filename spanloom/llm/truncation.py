"""Text cut off by field limits (problem 4): discrete length hazards and a model of sentence endings.

For every source and measure (characters, bytes) the hazard of an unfinished ending at a length is compared with the
hazards of neighbouring lengths; lengths whose excess survives false-discovery control are the source's limits. Whether
an ending is unfinished is learnt from the corpus: how often its last tokens are followed by the end of a sentence. A
value is cut when its ending is unfinished, judged leniently at a limit and in sources that close their sentences, and
strictly in sources whose habit is to leave the last stop out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import stage
from . import boilerplate
from ._arrow import over_batches
from .charform import fold

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]")
_MARK = re.compile(r"(?:\s*(?:…|\.{3,}|\[\s*(?:…|\.{2,})\s*\]|\(\s*(?:…|\.{2,})\s*\)|[\[(]?\s*(?:xem|đọc) (?:tiếp|thêm)\s*[\])]?\s*(?:»|>|→)?))+\s*\Z", re.I)
_TAG = re.compile(r"<[^<>]*>")
_OPEN_TAG = re.compile(r"<[a-zA-Z/!][^<>]*\Z|<\Z|&(?:#\d{0,5}|am?p?|apos?|ap|lt?|gt?|qu?o?t?|nb?s?p?)?\Z")
_DONE = re.compile(r"[.!?。](?:[”’\"')\]]*)\Z")
_TERMINAL = frozenset(".!?…。")
_CLOSER = frozenset("”’\"')]»")
_OPENER = frozenset("“‘\"'([«–-•—")
NONE = np.uint64(0)


class _Classes(dict):
    """Token -> class number; figures are one class, capitalised words another. Flags sit in the lowest three bits."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        if token[0].isdigit():
            name, flags = "0", 4
        elif token[0].isupper():
            name, flags = "N", 4
        else:
            name, flags = token, 0
        flags |= (1 if token in _TERMINAL else 0) | (2 if token in _CLOSER else 0) | (4 if token in _OPENER else 0)
        value = self[token] = (xxhash.xxh3_64_intdigest(name) & ~7) | flags
        return value


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return ((first * np.uint64(0x9E3779B97F4A7C15)) ^ (first >> np.uint64(31))) + second


def ending(text: str, page: bool, memo: _Classes, kinds: dict) -> tuple[str, bool, bool, bool, bool]:
    """(core, ended, marked, broken, furniture) of a value's ending.

    core is the text without a gap mark or markup at its end; marked: a gap mark stood there; broken: markup or a
    character breaks off; furniture: the value is a page whose last line is not its own prose.
    """
    plain = fold(text).rstrip()
    broken = plain.endswith("�")
    if broken:
        plain = plain.rstrip("�").rstrip()
    tail = _OPEN_TAG.search(plain)
    if tail:
        broken, plain = True, plain[: tail.start()].rstrip()
    if plain.endswith(">"):
        unclosed = re.search(r"<(b|i|em|strong|p|a|br|span|div)\b[^<>]*>\s*\Z", plain)
        broken = broken or bool(unclosed and unclosed[1] in ("b", "i", "em", "strong", "a", "span"))
        plain = _TAG.sub(" ", plain[-400:]).rstrip()
    mark = _MARK.search(plain[-40:])
    marked = mark is not None
    if mark:
        plain = plain[: len(plain) - (len(plain[-40:]) - mark.start())].rstrip()
    furniture = False
    if page and not marked and not broken and not _DONE.search(plain.rpartition("\n")[2].strip()[-8:]):
        kind = boilerplate.parse(text, kinds)
        furniture = bool(kind) and kind[-1][1] not in _STORY
    return plain, bool(_DONE.search(plain[-8:])), marked, broken, furniture


#: Layout paths of a page on which a story stands.
_STORY = frozenset(f"page/body/{kind}" for kind in ("sentence", "prose", "cut"))
VALUES = "table_name string, row_id bigint, source string, chars int, bytes int, ended boolean, marked boolean, broken boolean, furniture boolean, last1 bigint, last2 bigint, text_key bigint, page boolean, shape bigint"


def _read(values: DataFrame) -> DataFrame:
    """One row per value, and per batch the counts of sentence ends after each one- and two-token context."""
    wanted = values.select("table_name", "row_id", "source", "text", "page").filter("text <> ''")

    def run(batches: Iterator[tuple[list, ...]]) -> Iterator[list[tuple]]:
        memo, kinds = _Classes(), {}
        for tables, ids, sources, texts, pages in batches:
            out, streams = [], []
            for table, row_id, source, text, page in zip(tables, ids, sources, texts, pages):
                if not text.strip():
                    continue
                core, ended, marked, broken, furniture = ending(text, page, memo, kinds)
                tokens = _TOKEN.findall(fold(_TAG.sub(" ", text)) if "<" in text else fold(text))
                codes = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
                streams += [codes, np.zeros(2, np.uint64)]
                last = _TOKEN.findall(core[-80:])[-2:]
                one = memo[last[-1]] if last else 0
                two = int(_pair(np.array([memo[last[0]] if len(last) > 1 else 0], np.uint64), np.array([one], np.uint64))[0])
                out.append((table, row_id, source, len(text), len(text.encode()), ended, marked, broken, furniture, one - (1 << 63), two - (1 << 63), xxhash.xxh3_64_intdigest(text) - (1 << 63), page, boilerplate.shape(" ".join(core.rpartition("\n")[2].split())) if page and not ended else None, None, None, None, None))
            if streams:
                out += _contexts(np.concatenate(streams))
            yield out

    return over_batches(wanted, run, VALUES + ", rank int, context bigint, n bigint, ends bigint")


def _contexts(codes: np.ndarray) -> list[tuple]:
    here, after = codes[:-1], codes[1:]
    closes = (here & np.uint64(2)) != 0
    ends = ((after & np.uint64(1)) != 0) | (closes & ((after & np.uint64(4)) != 0))
    known = (here != NONE) & (after != NONE)
    before = np.concatenate([np.zeros(1, np.uint64), codes[:-2]])
    rows = []
    for rank, context in ((1, here[known]), (2, _pair(before, here)[known])):
        each, where = np.unique(context, return_inverse=True)
        n = np.bincount(where, minlength=len(each))
        e = np.bincount(where, weights=ends[known], minlength=len(each)).astype(int)
        signed = (each ^ np.uint64(1 << 63)).view(np.int64)
        rows += [(None,) * 14 + (rank, c, int(a), int(b)) for c, a, b in zip(signed.tolist(), n, e)]
    return rows


def _tail(k: int, rate: float) -> float:
    """P(X >= k) of a Poisson variable."""
    if k <= 0:
        return 1.0
    if rate > 200:
        return 0.5 * math.erfc((k - 0.5 - rate) / math.sqrt(2 * rate))
    term = math.exp(-rate)
    below = term
    for i in range(1, k):
        term *= rate / i
        below += term
    if below < 1 - 1e-9:
        return 1 - below
    term *= rate / k
    total, i = term, k
    while term > total * 1e-12 and i < k + 500:
        i += 1
        term *= rate / i
        total += term
    return max(total, 1e-300)


def limits(endings: DataFrame, rate: float = 0.001, near: int = 8, far: int = 40) -> DataFrame:
    """(page, source, measure, length): lengths at which unfinished endings are too frequent.

    `endings` has page, source, chars, bytes, ended, text_key; equal texts count once. Per source and measure the count at each length is tested
    against the counts `near` to `far` away on both sides; Benjamini-Hochberg holds the false-discovery rate.
    """
    measured = endings.filter("not ended").select("page", "source", "chars", "bytes", "text_key").distinct().select("page", "source", F.explode(F.array(F.struct(F.lit("chars").alias("measure"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("measure"), F.col("bytes").alias("length")))).alias("m")).select("page", "source", "m.*")
    counts = measured.groupBy("page", "source", "measure", "length").agg(F.count("*").alias("k"))
    part = Window.partitionBy("page", "source", "measure")
    order = part.orderBy("length")
    around = F.coalesce(F.sum("k").over(order.rangeBetween(-far, -near)), F.lit(0)) + F.coalesce(F.sum("k").over(order.rangeBetween(near, far)), F.lit(0))
    tested = counts.withColumn("expected", (around + 0.5) / (2.0 * (far - near + 1)))

    def run(batches: Iterator[tuple[list, ...]]) -> Iterator[list[tuple]]:
        for b in batches:
            yield [(t, s, m, length, k, _tail(k, e)) for t, s, m, length, k, e in zip(*b)]

    tested = over_batches(tested.select("page", "source", "measure", "length", "k", "expected"), run, "page boolean, source string, measure string, length int, k bigint, p double")
    ranked = tested.withColumn("rank", F.row_number().over(part.orderBy("p", "length"))).withColumn("tests", F.count("*").over(part))
    passed = F.max(F.when(F.col("p") <= F.col("rank") / F.col("tests") * rate, F.col("rank"))).over(part)
    return ranked.withColumn("last", passed).filter("rank <= last and k >= 3").select("page", "source", "measure", "length")


def judged(values: DataFrame, rate: float = 0.001) -> DataFrame:
    """(table_name, row_id, source, chars, at_limit, habit, finished, cut) for every non-blank value.

    `values` has table_name, row_id, source, text and page (whether the text is a page that may end in furniture); pages
    and feed fields of a source have their own limits and habits, whichever table they stand in. Null,
    empty and blank values have no row; a null source is judged as a source of its own.
    """
    read = stage(_read(values.withColumn("source", F.coalesce("source", F.lit("\u0000")))), "endings")
    endings = read.filter("rank is null").drop("rank", "context", "n", "ends")
    # A page's open last line that the ratios of the source's pages refuse is a notice.
    pages = boilerplate.paths(values.filter("page"), "row_id", "text", "source", host=lambda name: name or "\u0000")
    _, own = boilerplate.refused(stage(pages, "page-lines"))
    notices = own.filter("path = 'page/body/cut'").select(F.col("site").alias("source"), "shape", F.lit(True).alias("notice"))
    endings = endings.join(notices, ["source", "shape"], "left").withColumn("furniture", F.col("furniture") | F.coalesce("notice", F.lit(False))).drop("notice", "shape")
    contexts = read.filter("rank is not null").groupBy("rank", "context").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    open_ends = endings.filter("not ended and not furniture")
    found = stage(limits(open_ends, rate), "limits")
    by_chars = found.filter("measure = 'chars'").select("page", "source", F.col("length").alias("chars"), F.lit(True).alias("c"))
    by_bytes = found.filter("measure = 'bytes'").select("page", "source", F.col("length").alias("bytes"), F.lit(True).alias("b"))
    placed = endings.join(by_chars, ["page", "source", "chars"], "left").join(by_bytes, ["page", "source", "bytes"], "left")
    placed = placed.withColumn("at_limit", F.coalesce("c", "b", F.lit(False))).drop("c", "b")
    one = contexts.filter("rank = 1").select(F.col("context").alias("last1"), (F.col("ends") / F.col("n")).alias("p1"))
    two = contexts.filter("rank = 2").select(F.col("context").alias("last2"), F.col("n").alias("n2"), F.col("ends").alias("e2"))
    asked = placed.filter("not ended").join(one, "last1", "left").join(two, "last2", "left")
    p1 = F.coalesce("p1", F.lit(0.0))
    finished = F.when(F.col("p1").isNull(), 0.0).otherwise((F.coalesce("e2", F.lit(0)) + p1) / (F.coalesce("n2", F.lit(0)) + 1))
    columns = ["table_name", "page", "row_id", "source", "chars", "ended", "marked", "broken", "furniture", "at_limit"]
    every = placed.filter("ended").select(*columns, F.lit(1.0).alias("finished")).unionByName(asked.select(*columns, finished.alias("finished")))
    # The habit of a source: how often its finished values outside the limits close their last sentence.
    whole = "not furniture and not marked and not broken and not at_limit and (ended or finished >= 0.2)"
    habit = every.filter(whole).groupBy("page", "source").agg(F.avg(F.col("ended").cast("int")).alias("habit"))
    every = every.join(habit, ["page", "source"], "left")
    lenient = F.col("at_limit") | (F.coalesce("habit", F.lit(1.0)) >= 0.5)
    cut = ~F.col("furniture") & ~F.col("ended") & (F.col("marked") | F.col("broken") | F.when(lenient, F.col("finished") < 0.8).otherwise(F.col("finished") < 0.003))
    return every.select("table_name", "row_id", F.nullif("source", F.lit("\u0000")).alias("source"), "chars", "at_limit", "habit", "finished", cut.alias("cut"))


def rates(decided: DataFrame) -> DataFrame:
    """(table_name, source, n_values, cut_values, cut_share): how often each source truncates."""
    n = F.count("*")
    cut = F.sum(F.col("cut").cast("int"))
    return decided.groupBy("table_name", "source").agg(n.alias("n_values"), cut.alias("cut_values"), F.round(cut / n, 6).alias("cut_share"))
