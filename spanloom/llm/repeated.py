"""Lines repeated across the documents of one source (problem 7).

Lines are parsed through a token tree of fixed depth: source, number of tokens, three leading tokens, last token; what is
left of a line hangs below that leaf. Runs of figures are slots from the start. Trees of different tasks have the same
nodes for the same lines, so they are merged by adding the documents of each node. What is left of a line stays in its
template where at least `least` documents of the source agree on it; everything else becomes a wildcard slot. A template
without slots other than figures is one and the same line in `least` documents or more, so `repeats` reads it off the
merged tree; `templates` gives the slotted ones too. Every step is a sum over nodes: nothing depends on partitions, and no
node is left out or merged by force.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame, functions as F

from ..runtime import stage
from ._arrow import over_batches
from .charform import fold

_FIGURES = re.compile(r"\d+")
#: Leading tokens on a tree's way from the root to a leaf; the number of tokens and the last token are on it too.
DEPTH = 3
SLOT = "<*>"


def template(line: str) -> str:
    """Form of a line: folded form and case, one space between tokens, every run of figures a slot."""
    return " ".join(_FIGURES.sub(SLOT, line.lower()).split())


def route(form: str, depth: int = DEPTH) -> str:
    """Way of a form through the tree: its number of tokens, its leading tokens and its last one, slots kept."""
    tokens = form.split(" ")
    return " ".join([str(len(tokens)), *tokens[:depth], tokens[-1]])


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


class _Places(dict):
    """Folded line -> (leaf, form) numbers, None for a blank one; short lines recur, so most are looked up."""

    def place(self, line: str) -> tuple[int, int] | None:
        if line in self:
            return self[line]
        form = template(line)
        value = (_digest(route(form)), _digest(form)) if form else None
        if len(line) <= 200:
            if len(self) > 100_000:
                self.clear()
            self[line] = value
        return value


def lines(documents: DataFrame, key: str = "id", text: str = "original_text", source: str = "source") -> DataFrame:
    """(row_id, source, line_no[], leaf[], form[], first[]): tree node of every non-blank line, and whether it is the
    document's first line at that node. Null and empty texts have no lines; a null source is a source of its own. A line
    that only folds to nothing is a form of its own.
    """
    rows = documents.select(F.col(f"`{key}`").cast("bigint").alias("row_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text")).filter("text <> ''")

    def run(batches: Iterator[tuple[list, ...]]) -> Iterator[list[tuple]]:
        places = _Places()
        for ids, names, docs in batches:
            out = []
            for row_id, name, doc in zip(ids, names, docs):
                folded = fold(doc)
                raws = None if folded is doc else doc.split("\n")
                nos, leaves, forms, firsts, seen = [], [], [], [], set()
                for no, line in enumerate(folded.split("\n")):
                    node = places.place(line) if line else None
                    if node is None:
                        if raws is None or not raws[no].strip():
                            continue
                        node = (_digest(""), _digest(raws[no]))
                    nos.append(no)
                    leaves.append(node[0])
                    forms.append(node[1])
                    firsts.append(node[1] not in seen)
                    seen.add(node[1])
                out.append((row_id, name, nos, leaves, forms, firsts))
            yield out

    return over_batches(rows, run, "row_id bigint, source string, line_no array<int>, leaf array<bigint>, form array<bigint>, first array<boolean>")


def merged(parsed: DataFrame) -> DataFrame:
    """(source, leaf, form, documents): the trees of all tasks, merged by adding the documents of each node.

    Each document adds one to each of its nodes, so sums combine on the map side and a hot source or line costs no more
    than its share of partial sums.
    """
    each = parsed.select("source", F.explode(F.arrays_zip("leaf", "form", "first")).alias("l")).filter("l.first")
    return each.groupBy("source", F.col("l.leaf").alias("leaf"), F.col("l.form").alias("form")).agg(F.count("*").alias("documents"))


def repeats(documents: DataFrame, key: str = "id", text: str = "original_text", source: str = "source", least: int = 6) -> DataFrame:
    """(row_id, source, line_no, documents): every occurrence of a line that stands in `least` documents of its source:
    the lines whose template in the merged tree has no slot but figures."""
    parsed = stage(lines(documents, key, text, source), "source-lines")
    chosen = merged(parsed).filter(F.col("documents") >= least)
    each = parsed.select("row_id", "source", F.explode(F.arrays_zip("line_no", "leaf", "form")).alias("l")).select("row_id", "source", "l.line_no", "l.leaf", "l.form")
    same = [each["source"].eqNullSafe(chosen["source"]), each["leaf"] == chosen["leaf"], each["form"] == chosen["form"]]
    return each.join(chosen, same).select(each["row_id"], each["source"], "line_no", "documents")


def without(documents: DataFrame, key: str = "id", text: str = "original_text", source: str = "source", least: int = 6) -> DataFrame:
    """(row_id, removed, text): every document without its repeated lines; nulls stay null."""
    gone = repeats(documents, key, text, source, least).groupBy("row_id").agg(F.collect_set("line_no").alias("gone"))
    rows = documents.select(F.col(f"`{key}`").cast("bigint").alias("row_id"), F.col(f"`{text}`").alias("text"))
    kept = F.array_join(F.transform(F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~F.array_contains("gone", s["i"])), lambda s: s["x"]), "\n")
    joined = rows.join(gone, "row_id", "left")
    return joined.select("row_id", F.coalesce(F.size("gone"), F.lit(0)).alias("removed"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"))


def _texts(documents: DataFrame, text: str, source: str) -> DataFrame:
    """(source, leaf, form, words): the text of every node's line; a task gives a text once as long as it remembers it."""
    rows = documents.select(F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text")).filter("text <> ''")

    def run(batches: Iterator[tuple[list, ...]]) -> Iterator[list[tuple]]:
        given: set = set()
        for names, docs in batches:
            out = []
            for name, doc in zip(names, docs):
                for line in fold(doc).split("\n"):
                    form = template(line)
                    node = (name, _digest(form)) if form else None
                    if node is not None and node not in given:
                        given.add(node)
                        out.append((name, _digest(route(form)), node[1], form))
            yield out
            if len(given) > 2_000_000:
                given.clear()

    return over_batches(rows, run, "source string, leaf bigint, form bigint, words string")


def templates(documents: DataFrame, key: str = "id", text: str = "original_text", source: str = "source", least: int = 6) -> DataFrame:
    """(source, template, documents): templates that cover at least `least` documents of their source, slots in any place.

    Below a leaf that `least` documents reach, a line that itself stands in as many is a template. Of every other line, a
    token stays where `least` documents of the leaf's other lines have it at its place, and is a slot elsewhere; slots side by side are
    one. A document counts once for each template. Null and empty texts have none.
    """
    parsed = stage(lines(documents, key, text, source), "template-lines")
    tree = merged(parsed)
    name = F.coalesce("source", F.lit("\u0000")).alias("source")
    tree = stage(tree.select(name, "leaf", "form", "documents"), "tree")
    live = tree.groupBy("source", "leaf").agg(F.sum("documents").alias("all")).filter(F.col("all") >= least).select("source", "leaf")
    nodes = tree.join(live, ["source", "leaf"], "left_semi")
    worded = _texts(documents, text, source).select(name, "leaf", "form", "words").join(live, ["source", "leaf"], "left_semi").groupBy("source", "leaf", "form").agg(F.first("words").alias("words"))
    nodes = stage(nodes.join(worded, ["source", "leaf", "form"]), "nodes")
    open_nodes = nodes.filter(F.col("documents") < least)
    each = open_nodes.select("source", "leaf", "form", "documents", F.posexplode(F.split("words", " ")).alias("at", "token"))
    kept = each.groupBy("source", "leaf", "at", "token").agg(F.sum("documents").alias("n")).filter(F.col("n") >= least).select("source", "leaf", "at", "token", F.lit(True).alias("kept"))
    slotted = each.join(kept, ["source", "leaf", "at", "token"], "left").groupBy("source", "leaf", "form").agg(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("kept"), F.col("token")).otherwise(SLOT).alias("token")))).alias("t"))
    joined = F.array_join(F.transform("t", lambda x: x["token"]), " ")
    slotted = slotted.select("source", "leaf", "form", F.regexp_replace(joined, r"<\*>(?: <\*>)+", SLOT).alias("template"))
    named = slotted.unionByName(nodes.filter(F.col("documents") >= least).select("source", "leaf", "form", F.col("words").alias("template")))
    rows = parsed.select("row_id", name, F.explode(F.arrays_zip("leaf", "form", "first")).alias("l")).filter("l.first").select("row_id", "source", "l.leaf", "l.form")
    covered = rows.join(named, ["source", "leaf", "form"]).select("source", "template", "row_id").distinct()
    counts = covered.groupBy("source", "template").agg(F.count("*").alias("documents")).filter(F.col("documents") >= least)
    return counts.select(F.nullif("source", F.lit("\u0000")).alias("source"), "template", "documents")
