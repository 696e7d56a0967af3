"""Character forms: one look, one code-point sequence (problem 6), and the folding that the other operators compare by.

The repair is aware of scripts. Composition, compatibility widths, spaces and invisible signs have one usual form that
needs no context. Look-alike letters do: `с` is a Latin c in `сha` and a Cyrillic s in `чай`. A token's script is that of
its letters that look like no other script's; a token is repaired only when it mixes scripts (or stands alone in foreign
look-alikes amid another script's text), into its own script, and when the result occurs in the vocabulary of the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from ..runtime import stage
from ._arrow import over_batches

# Letters of other scripts that look like a Latin letter.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "ɡ": "g", "ɑ": "a", "ı": "i",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Һ": "H", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
    "ο": "o", "ν": "v", "κ": "k", "ρ": "p",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "Ð": "Đ", "Ɖ": "Đ", "ð": "đ", "ɖ": "đ",
}
# Signs without a look of their own, and spaces other than the plain one.
INVISIBLE = (
    "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮"
    "⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿︀︎️"
)
SPACES = "               　"

_WIDTHS = "！-～￠-￦KÅﬀ-ﬆ\U0001d400-\U0001d7ff"
#: Class (for Java and Python) of every character that may not be in its usual form.
SUSPECT = "[" + INVISIBLE + SPACES + r"\u0300-\u036f\u1dc0-\u1dff\u1f00-\u1fff\u0370-\u052f" + "".join(LOOKALIKES) + _WIDTHS + "]"
_SUSPECT = re.compile(SUSPECT)
_WIDE = re.compile(f"[{_WIDTHS}]")
_LOOKS = {ord(k): v for k, v in LOOKALIKES.items()}
_WORD = re.compile(r"[^\W\d_]+")
_EMOJI = re.compile("[\U0001f000-\U0001faff☀-➿⬀-⯿]")


def _one(ch: str, looks: bool) -> str:
    if ch in INVISIBLE:
        return ""
    if ch in SPACES:
        return " "
    if looks and ch in LOOKALIKES:
        return LOOKALIKES[ch]
    return unicodedata.normalize("NFKC", ch) if _WIDE.match(ch) else ch


_FOLDS = {ch: _one(ch, True) for ch in INVISIBLE + SPACES + "".join(LOOKALIKES)}


def _replace(text: str, looks: bool) -> str:
    """Replace what needs no context, one pass for each distinct suspect character."""
    odd = set(_SUSPECT.findall(text))
    for ch in odd:
        new = _FOLDS[ch] if looks and ch in _FOLDS else _one(ch, looks)
        if new != ch:
            text = text.replace(ch, new)
    return unicodedata.normalize("NFC", text) if odd else text


def fold(text: str) -> str:
    """Form for comparison: composed, plain spaces, nothing invisible, look-alikes as Latin. Case is kept."""
    return _replace(text, True)


def _script(ch: str) -> str:
    name = unicodedata.name(ch, "")
    return name.partition(" ")[0]


#: Latin letters that look like a letter of another script, and per script the table from Latin into it.
_INTO = {name: {ord(v): k for k, v in LOOKALIKES.items() if unicodedata.name(k).startswith(name)} for name in ("CYRILLIC", "GREEK")}
_LATIN_LOOKS = frozenset(chr(c) for table in _INTO.values() for c in table)


def _whole(word: str) -> bool:
    """Whether a word is of one other script throughout and has a letter that only that script has."""
    scripts = {_script(c) for c in word}
    return len(scripts) == 1 and scripts <= set(_INTO) and any(c not in LOOKALIKES for c in word)


def _genuine(word: str) -> bool:
    return any(c not in LOOKALIKES and c.isalpha() and _script(c) != "LATIN" for c in word)


def usual(text: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The context-free part of the repair, and the tokens left for the vocabulary: (start, end, proposal).

    Emoji sequences keep their joiners and selectors. Compatibility forms are undone for widths and letter variants
    only: superscripts, subscripts, fractions and unit signs keep their own look.
    """
    if not _SUSPECT.search(text):
        return text, []
    if ("\u200d" in text or "\ufe0f" in text or "\ufe0e" in text) and _EMOJI.search(text):
        kept = []
        for k, ch in enumerate(text):
            joins = ch in "\u200d\ufe0f\ufe0e" and k > 0 and (_EMOJI.match(text[k - 1]) or text[k - 1] in "\u200d\ufe0f")
            kept.append(chr(0xE000 + "\u200d\ufe0f\ufe0e".index(ch)) if joins else ch)
        text = "".join(kept)
        text = _replace(text, False).replace("\ue000", "\u200d").replace("\ue001", "\ufe0f").replace("\ue002", "\ufe0e")
    else:
        text = _replace(text, False)
    asks = []
    words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
    for k, (start, end, word) in enumerate(words):
        if word.isascii():
            continue
        strong = {_script(c) for c in word if c not in LOOKALIKES and c not in _LATIN_LOOKS}
        if len(strong) == 1 and (script := strong.pop()) in _INTO and any(c in _LATIN_LOOKS for c in word):
            # The letters that look like no other script's are of that script: Latin look-alikes among them are the odd ones.
            proposal = word.translate(_INTO[script])
            if proposal != word and all(_script(c) == script for c in proposal):
                asks.append((start, end, proposal))
            continue
        if not any(c in LOOKALIKES for c in word):
            continue
        proposal = unicodedata.normalize("NFC", word.translate(_LOOKS))
        if not all(_script(c) == "LATIN" for c in proposal):
            continue
        mixed = any(c not in LOOKALIKES for c in word)
        # A token wholly of look-alikes is judged by its neighbours: beside words of its own script it is genuine.
        if mixed or not any(_genuine(w) for _, _, w in words[max(0, k - 1) : k] + words[k + 1 : k + 2]):
            asks.append((start, end, proposal))
    return text, asks


def settle(text: str, asks: list[tuple[int, int, str]], known) -> str:
    """Put in those proposals whose lower-case form is known."""
    for start, end, proposal in reversed(asks):
        if proposal.lower() in known:
            text = text[:start] + proposal + text[end:]
    return unicodedata.normalize("NFC", text)


def cells(df: DataFrame, table: str, key: str, fields: list[str]) -> DataFrame:
    """(table_name, row_id, field_name, value): one row per value of the named fields."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").alias("value")) for f in fields)))
    return df.select(F.lit(table).alias("table_name"), F.col(f"`{key}`").cast("bigint").alias("row_id"), pairs.alias("c")).select("table_name", "row_id", "c.field_name", "c.value")


def unify(cells: DataFrame) -> DataFrame:
    """Usual form of every cell with a suspect character: (table_name, row_id, field_name, value, form, changed).

    `cells` has table_name, row_id, field_name, value. Cells without a suspect character are in the usual form and have
    no row; null and empty values are never suspect. A look-alike is replaced only where the repaired token is a token
    of the corpus that needed no repair. One pass gives the suspect cells with their proposals and each task's distinct
    tokens; proposals ask for tokens through a join, so neither side is ever gathered.
    """

    def propose(batches: Iterator[tuple[list, ...]]) -> Iterator[list[tuple]]:
        tokens: set[str] = set()
        sent: set[str] = set()
        for b in batches:
            out = []
            for table, row_id, field, value in zip(*b):
                words = _WORD.findall(value.lower())
                if not _SUSPECT.search(value):
                    tokens.update(words)
                    continue
                tokens.update(w for w in words if not _SUSPECT.search(w) or _whole(w))
                plain, asks = usual(value)
                out.append((table, row_id, field, value, plain, [a[0] for a in asks], [a[1] for a in asks], [a[2] for a in asks], None))
            yield out
            tokens -= sent
            sent |= tokens
            yield [(None,) * 8 + (t,) for t in tokens]
            tokens = set()
            if len(sent) > 500_000:
                sent = set()

    schema = "table_name string, row_id bigint, field_name string, value string, plain string, starts array<int>, ends array<int>, words array<string>, token string"
    passed = stage(over_batches(cells.select("table_name", "row_id", "field_name", "value").filter("value <> ''"), propose, schema), "charform")
    proposed = passed.filter("token is null").drop("token")
    known = passed.filter("token is not null").select(F.col("token").alias("w")).distinct()
    asked = proposed.filter(F.size("words") > 0).select("table_name", "row_id", "field_name", F.explode(F.transform("words", F.lower)).alias("w"))
    granted = asked.join(known, "w").groupBy("table_name", "row_id", "field_name").agg(F.collect_set("w").alias("granted"))

    def finish(batches: Iterator[tuple[list, ...]]) -> Iterator[list[tuple]]:
        for b in batches:
            out = []
            for table, row_id, field, value, plain, starts, ends, words, ok in zip(*b):
                form = settle(plain, list(zip(starts, ends, words)), set(ok))
                out.append((table, row_id, field, value, form, form != value))
            yield out

    joined = proposed.join(granted, ["table_name", "row_id", "field_name"], "left").withColumn("granted", F.coalesce("granted", F.array().cast("array<string>")))
    wanted = joined.select("table_name", "row_id", "field_name", "value", "plain", "starts", "ends", "words", "granted")
    return over_batches(wanted, finish, "table_name string, row_id bigint, field_name string, value string, form string, changed boolean")
