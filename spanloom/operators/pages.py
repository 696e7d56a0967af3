"""Pages and long texts that need more than the JVM's functions: composition, markup, bodies, differences."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame, functions as F

from ..functions.arrow import over_batches

# Elements whose text is never part of a body, and elements without an end tag.
SKIPPED = frozenset("script style noscript template nav header footer aside form button figure figcaption iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("p div br li ul ol tr td th table section article main h1 h2 h3 h4 h5 h6 blockquote pre".split())


def composed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form, changed): text in canonical composition; null stays null and unchanged."""
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[tuple[list, ...]]) -> Iterator[list[tuple]]:
        for keys, texts in batches:
            out = []
            for k, t in zip(keys, texts):
                form = None if t is None else unicodedata.normalize("NFC", t)
                out.append((k, form, form != t))
            yield out

    return over_batches(rows, run, "key bigint, form string, changed boolean")


#: What the parser has not read yet when a text ends inside a tag, a comment or a declaration.
_CUT_TAG = re.compile("<[a-zA-Z/!?]")


class _Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in BLOCKS:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in BLOCKS:
            self.parts.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def plain(text: str) -> str:
    """Text without markup, white space squeezed; text without `<` is only squeezed. A tag or comment that the end cuts
    off is markup too.
    """
    if "<" in text:
        parser = _Plain()
        parser.feed(text)
        if _CUT_TAG.match(parser.rawdata):
            parser.rawdata = ""
        parser.close()
        text = "".join(parser.parts)
    return " ".join(text.split())


def stripped(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, plain) of every non-null text."""
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).filter("text is not null")

    def run(batches: Iterator[tuple[list, ...]]) -> Iterator[list[tuple]]:
        for keys, texts in batches:
            yield [(k, plain(t)) for k, t in zip(keys, texts)]

    return over_batches(rows, run, "key bigint, plain string")


class _Tree(HTMLParser):
    """Paragraphs with their chain of open elements, their text and the text inside links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []
        self.found: list[tuple[tuple[int, ...], str, int]] = []
        self.paragraph: list[str] | None = None
        self.linked = self.count = 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        if tag == "p":
            self._close()
            self.paragraph, self.linked = [], 0
        self.count += 1
        self.open.append((tag, self.count))

    def handle_endtag(self, tag):
        if tag == "p":
            self._close()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if self.paragraph is not None and not any(t in SKIPPED for t, _ in self.open):
            self.paragraph.append(data)
            if any(t == "a" for t, _ in self.open):
                self.linked += len(data.strip())

    def _close(self):
        if self.paragraph is not None:
            text = " ".join("".join(self.paragraph).split())
            if text:
                self.found.append((tuple(n for t, n in self.open if t != "p"), text, self.linked))
        self.paragraph = None


def body(html: str, least: int = 40, links: float = 0.5, share: float = 0.95) -> str:
    """Main body of a page: qualifying paragraphs of the deepest element that holds `share` of their text.

    A paragraph qualifies with `least` characters and at most `links` of them inside links. Without such an element all
    qualifying paragraphs count.
    """
    tree = _Tree()
    tree.feed(html)
    tree._close()
    good = [(chain, text) for chain, text, linked in tree.found if len(text) >= least and linked <= links * len(text)]
    total = sum(len(t) for _, t in good)
    mass: dict[int, int] = defaultdict(int)
    depth: dict[int, int] = {}
    for chain, text in good:
        for d, node in enumerate(chain):
            mass[node] += len(text)
            depth[node] = d
    holders = [n for n, m in mass.items() if m >= share * total]
    if not holders:
        return "\n\n".join(t for _, t in good)
    best = max(holders, key=lambda n: (depth[n], -n))
    return "\n\n".join(t for chain, t in good if best in chain)


def bodies(df: DataFrame, key: str, html: str, floor: int = 240) -> DataFrame:
    """(key, text, ok, reason): a body under `floor` characters, and a null page, fail with a reason."""
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(html).alias("html"))

    def run(batches: Iterator[tuple[list, ...]]) -> Iterator[list[tuple]]:
        for keys, pages in batches:
            out = []
            for k, page in zip(keys, pages):
                text = body(page) if page else ""
                ok = len(text) >= floor
                out.append((k, text, ok, "" if ok else "no page" if not page else "no prose" if not text else "too short"))
            yield out

    return over_batches(rows, run, "key bigint, text string, ok boolean, reason string")


def change_ratio(before: str, after: str) -> float:
    """Words deleted or inserted, whichever is more in each place, over the words before; 0 without words before."""
    a, b = before.split(), after.split()
    if not a:
        return 0.0
    blocks = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    return sum(max(j - i, y - x) for kind, i, j, x, y in blocks if kind != "equal") / len(a)


def change_ratios(df: DataFrame) -> DataFrame:
    """(id, ratio) of rows (id, before, after); nulls count as empty texts."""
    rows = df.select(F.col("id").cast("bigint"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")))

    def run(batches: Iterator[tuple[list, ...]]) -> Iterator[list[tuple]]:
        for ids, before, after in batches:
            yield [(i, round(change_ratio(b, a), 6)) for i, b, a in zip(ids, before, after)]

    return over_batches(rows, run, "id bigint, ratio double")
