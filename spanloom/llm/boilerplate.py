"""Main body of a page by tag-path ratios (problem 1), for pages stored as lines of text.

Text without markup still has a tree: a page has a body and a foot, these hold blocks of some layout (separator rows,
marked items, labelled lines, captions, comments, sentences), and a block holds its text. `parse` gives every line its path
in that tree from layout alone: separators, marks, labels, ends, lengths and places. Per site and node the operator then aggregates
text length per node, sentence ends per node, and how far the very same text spreads over the site's pages: a notice is
one text on many pages, prose is hardly ever the same twice. The ratios of rare paths are smoothed towards those of the
same path over all sites, those of a path are fused with those of its zone and of its text, and nodes above the threshold
are content. Only the tables of paths and of recurring texts are gathered per site; lines of a page never leave their page.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import DRIVER_ROWS, bounded, stage
from ._arrow import over_slices
from .charform import fold

# Headings of lists at the foot of news pages, and how a picture's source is named after a sentence.
RELATED = r"(?:tin|bài) liên quan|đọc thêm|xem thêm|cùng chuyên mục|xem nhiều|đọc nhiều|mới nhất|tin mới|có thể bạn (?:quan tâm|thích)|bài (?:khác|nổi bật)|đọc tiếp"
COMMENTS = r"(?:bình luận|ý kiến bạn đọc|phản hồi)\s*\(?\d*\)?"
PICTURES = ("ảnh", "hình", "minh họa", "đồ họa", "video")

_HEADING = re.compile(rf"(?:(?P<related>{RELATED})|(?P<comments>{COMMENTS}))\W*\Z")
#: A name with something in brackets, a time or a number among it, and what was said: the layout of a comment.
_COMMENT = re.compile(r"[^.!?:]{3,60} \([^()]*\d[^()]*\)\s*:")
#: A picture's source: behind a sentence, or as the label of the line.
_CAPTION = re.compile(rf"(?:.*[.!?]\s+)?\W*(?:{'|'.join(PICTURES)})\b(?: \w+){{0,2}}(?: của| do|\s*:|\])")
_ITEM = re.compile(r"[»>→▶■►▲#©\[]")
#: A label of up to four words, none of them a name or a figure, before a colon and something that is no speech.
_LABEL = re.compile(r"[^\W\d_]+(?: [a-zà-ÿăđĩũơưạ-ỹ]+){0,3}\s*: *(?![“\"'‘–-])\S")
_SEPARATED = re.compile(r"\S(?: [>|·•/»] |\s{3,})\S")
_DIGITS = re.compile(r"\d+")
#: A line that ends so ends a sentence.
STOPS = (".", "!", "?", "…", "。")
CLOSERS = "”’\"')]»  "


def _ended(line: str) -> bool:
    return line.endswith(STOPS) or line.endswith("”") or (line[-1:] in CLOSERS and line.rstrip(CLOSERS).endswith(STOPS))


def _kind(line: str, ended: bool) -> str | None:
    """Kind of a line that its layout names, else None."""
    if _ITEM.match(line):
        return "item"
    low = line.lower()
    if not ended and (m := _HEADING.match(low)):
        return m.lastgroup
    if _COMMENT.match(line):
        return "comment"
    if any(w in low for w in PICTURES) and _CAPTION.match(low):
        return "caption"
    return "label" if _LABEL.match(low if line.isupper() else line) else None


def parse(text: str, memo: dict | None = None) -> list[tuple[int, str, str]]:
    """(line number, path, folded line) of every non-blank line of a page.

    Paths are page/zone/kind. Zones: body, and foot from the first list of other stories or comments on. Kinds: item,
    label, caption, comment; related and comments (headings); row (separators); sentence (ends a sentence), prose (a long
    one), cut (the page's last line when nothing ends it), open (anything else). `memo` keeps the kinds of short lines
    between pages; notices recur, so most are looked up.
    """
    raws = text.split("\n")
    folded = fold(text)
    lines = raws if folded is text else folded.split("\n")
    out = []
    zone = "body"
    last = len(raws) - 1
    while last >= 0 and (not raws[last] or raws[last].isspace()):
        last -= 1
    prosaic = False
    for no in range(last + 1):
        given = lines[no]
        if not given:
            if raws[no].strip():
                out.append((no, f"page/{zone}/open", raws[no]))
            continue
        line = given.strip()
        if "  " in line or "\t" in line:
            line = " ".join(line.split())
        if not line:
            if raws[no].strip():
                out.append((no, f"page/{zone}/open", raws[no]))
            continue
        ended = _ended(line)
        # Only short lines recur often enough to be worth remembering; all are looked at.
        kind = memo.get(line, "") if memo is not None and len(line) <= 200 else ""
        if kind == "":
            kind = _kind(line, ended)
            if memo is not None and len(line) <= 200:
                if len(memo) > 50_000:
                    memo.clear()
                memo[line] = kind
        if kind in ("related", "comments"):
            zone = "foot"
        elif kind is None and not ended and ("   " in given.strip() or len(_SEPARATED.findall(line)) > 1):
            kind = "row"
        if kind is None:
            if ended:
                kind = "prose" if len(line) > 90 else "sentence"
            elif no == last and zone == "body" and (len(line) > 40 or prosaic):
                kind = "cut"
            else:
                kind = "open"
        prosaic = kind in ("prose", "sentence")
        out.append((no, f"page/{zone}/{kind}", line))
    return out


def site(url: str | None) -> str:
    """Host of a URL without `www.`; the empty site for null or unparsable URLs."""
    try:
        host = urlsplit(url or "").hostname or ""
    except ValueError:
        host = ""
    return host.removeprefix("www.")


#: Order of path numbers in parsed pages.
KINDS = ("sentence", "prose", "cut", "open", "row", "item", "label", "caption", "comment", "related", "comments")
PATHS = tuple(f"page/{zone}/{kind}" for zone in ("body", "foot") for kind in KINDS)
_NUMBER = {path: k for k, path in enumerate(PATHS)}
PARSED = "row_id bigint, site string, line_no array<int>, path array<int>, chars array<int>, ended array<boolean>, shape array<bigint>"


def shape(line: str) -> int:
    """Number of a line's text, its figures masked and its case folded."""
    return xxhash.xxh3_64_intdigest(_DIGITS.sub("0", line.lower())) - (1 << 63)


def describe(row_id: int, host: str, lines: list[tuple[int, str, str]]) -> tuple:
    """One row of PARSED."""
    return (
        row_id,
        host,
        [no for no, _, _ in lines],
        [_NUMBER[path] for _, path, _ in lines],
        [len(line) for _, _, line in lines],
        [path.endswith("/cut") or _ended(line) for _, path, line in lines],
        [shape(line) for _, _, line in lines],
    )


def paths(pages: DataFrame, key: str = "id", text: str = "original_text", url: str = "source_url", host: Callable = site, worded: bool = False) -> DataFrame:
    """One row per page with its lines' numbers, paths, lengths and shapes (PARSED), without their text.

    `host` gives a page's site by its URL. Null and empty texts have no lines and no row. `shape` hashes the line with its figures masked and its case folded.
    With `worded` the rows gain text, the page's lines as parsed and nothing else, and url.
    """
    rows = pages.select(F.col(f"`{key}`").cast("bigint").alias("row_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{url}`").alias("url")).filter("text <> ''")

    def run(batches: Iterator[tuple[list, ...]]) -> Iterator[list[tuple]]:
        memo: dict = {}
        for ids, texts, urls in batches:
            out = []
            for i, t, u in zip(ids, texts, urls):
                lines = parse(t, memo)
                row = describe(i, host(u), lines)
                out.append((*row, "\n".join(line for _, _, line in lines), u) if worded else row)
            yield out

    return over_slices(rows, run, PARSED + ", text string, url string" if worded else PARSED)


def lines_of(parsed: DataFrame) -> DataFrame:
    """(row_id, site, line_no, path, chars, ended, shape): one row per line of parsed pages."""
    names = F.array(*(F.lit(p) for p in PATHS))
    zipped = F.explode(F.arrays_zip("line_no", "path", "chars", "ended", "shape")).alias("l")
    return parsed.select("row_id", "site", zipped).select("row_id", "site", "l.line_no", F.element_at(names, F.col("l.path") + 1).alias("path"), "l.chars", "l.ended", "l.shape")


#: Share of a site's pages over which a text may spread before it counts as half a notice, and pages added to every site.
SPREAD, MORE_PAGES = 0.02, 50
#: Ratio from which a zone counts as one of content, and least score of content.
ZONE, THRESHOLD = 0.3, 0.8


def novelty(n, pages):
    """How much a text on `n` of a site's pages is its own page's: 1 for one, 1/2 at SPREAD, near 0 beyond."""
    return 1 / (1 + F.pow((n - 1) / (pages + MORE_PAGES) / SPREAD, 4))


def ratios(parsed: DataFrame, full: float = 25.0, prior: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """((site, path, nodes, score), (site, path, shape, novelty)): every path's score, and the texts that recur on a site.

    A text's novelty falls with the share of the site's pages that have it, on whatever path. A path's ratio is the mean
    over its nodes of text per node (1 from `full` characters on) times sentence ends per node, each node weighing as much
    as it is novel, smoothed with `prior` nodes' worth of what the path has over all sites. A path's score is the geometric
    mean of this and of its zone's ratio (1 from ZONE on), in which notices weigh in full. A node's score is its path's times its novelty.
    """
    pages = parsed.groupBy("site").agg(F.count("*").alias("pages"))
    leaf = lines_of(parsed).groupBy("site", "path", "shape").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum(F.col("ended").cast("int")).alias("ended"))
    # Rows of a text are as many as it has paths. All that follows reads these rows, and both means the sums, so they are made once.
    leaf = leaf.withColumn("of", F.sum("n").over(Window.partitionBy("site", "shape"))).join(pages, "site").withColumn("novelty", novelty(F.col("of"), F.col("pages")))
    leaf = stage(leaf.drop("pages"), "leaves")
    whole = F.least(F.lit(1.0), F.col("chars") / F.col("n") / full) * (F.col("ended") / F.col("n")) * F.col("novelty") * F.col("n")
    path = stage(leaf.groupBy("site", "path").agg(F.sum(whole).alias("mass"), F.sum(F.col("novelty") * F.col("n")).alias("novel"), F.sum("n").alias("n")), "sums")
    path = path.withColumn("zone", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    mean = lambda over: (F.sum("mass") / F.greatest(F.sum(over), F.lit(1e-9))).alias("mean")
    # The paths and zones of the page model are few, so these sides have a fixed bound.
    path = path.join(F.broadcast(path.groupBy("path").agg(mean("novel"))), "path").withColumn("own", (F.col("mass") + F.col("mean") * prior) / (F.col("novel") + prior)).drop("mean")
    path = path.join(F.broadcast(path.groupBy("zone").agg(mean("n"))), "zone").withColumn("score", F.sqrt(F.col("own") * F.least(F.lit(1.0), F.col("mean") / ZONE)))
    return path.select("site", "path", F.col("n").alias("nodes"), "score"), leaf.filter("of > 1").select("site", "path", "shape", "novelty")


def refused(parsed: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """((site, path, score) of paths, (site, path, shape, score) of texts on the other paths) that are not content."""
    paths, texts = ratios(parsed)
    paths = stage(paths, "paths")
    out = paths.filter(F.col("score") < threshold).select("site", "path", "score")
    own = texts.join(paths.filter(F.col("score") >= threshold).select("site", "path", "score"), ["site", "path"])
    own = own.withColumn("score", F.col("score") * F.col("novelty")).filter(F.col("score") < threshold)
    return out, stage(own.select("site", "path", "shape", "score"), "recurring")


def furniture(pages: DataFrame, key: str = "id", text: str = "original_text", url: str = "source_url", threshold: float = THRESHOLD) -> DataFrame:
    """(row_id, line_no, path, score): every line of every page that is not the page's own prose."""
    parsed = stage(paths(pages, key, text, url), "page-lines")
    return _dropped(lines_of(parsed), *refused(parsed, threshold))


def _dropped(lines: DataFrame, out: DataFrame, own: DataFrame) -> DataFrame:
    wanted = lines.select("row_id", "site", "line_no", "path", "shape")
    joined = wanted.join(out.withColumnRenamed("score", "a"), ["site", "path"], "left").join(own.withColumnRenamed("score", "b"), ["site", "path", "shape"], "left")
    return joined.filter("a is not null or b is not null").select("row_id", "line_no", "path", F.coalesce("a", "b").alias("score"))


def cleaned(pages: DataFrame, threshold: float = THRESHOLD, most: int = DRIVER_ROWS) -> tuple[DataFrame, Callable]:
    """(pages, cleaner) for operators that need bodies: pages are read once, `pages` has row_id, their lines as parsed in
    text, and url, and gains column `gone`.

    `cleaner()` gives, in a task, a function of (text, url, gone) to the folded content lines. What is refused on each site
    travels with the tasks while it is at most `most` rows, and `gone` holds the paths and shapes of a page's lines; beyond
    that every page is joined with the numbers of its furniture lines, and `gone` holds the numbers of its lines and these.
    """
    parsed = stage(paths(pages, "row_id", "text", "url", worded=True), "page-lines", codec="zstd")
    out, own = refused(parsed, threshold)
    if out.limit(most + 1).count() + own.limit(most + 1).count() > most:
        gone = stage(_dropped(lines_of(parsed), out, own).groupBy("row_id").agg(F.collect_set("line_no").alias("dropped")), "gone")

        def cut() -> Callable:
            def clean(text: str, url: str | None, gone: list[list]) -> list[str]:
                numbers, dropped = gone[0], set(gone[1])
                return [line for no, line in zip(numbers, text.split("\n")) if no not in dropped]

            return clean

        joined = parsed.select("row_id", "text", "url", "line_no").join(gone, "row_id", "left")
        return joined.select("row_id", "text", "url", F.array("line_no", F.coalesce("dropped", F.array().cast("array<int>"))).alias("gone")), cut
    paths_of: dict[str, set] = {}
    texts_of: dict[str, set] = {}
    for r in bounded(out, most):
        paths_of.setdefault(r["site"], set()).add(_NUMBER[r["path"]])
    for r in bounded(own, most):
        texts_of.setdefault(r["site"], set()).add((_NUMBER[r["path"]], r["shape"]))
    shared = pages.sparkSession.sparkContext.broadcast((paths_of, texts_of))

    def known() -> Callable:
        bad_paths, bad_texts = shared.value

        def clean(text: str, url: str | None, gone: list[list]) -> list[str]:
            host = site(url)
            bad, texts = bad_paths.get(host, ()), bad_texts.get(host, ())
            return [line for line, path, shape in zip(text.split("\n"), *gone) if path not in bad and (path, shape) not in texts]

        return clean

    return parsed.select("row_id", "text", "url", F.array(F.col("path").cast("array<bigint>"), "shape").alias("gone")), known


def bodies(pages: DataFrame, key: str = "id", text: str = "original_text", url: str = "source_url", threshold: float = THRESHOLD) -> DataFrame:
    """(row_id, body, n_lines, n_furniture): the content lines of every page in order, one per line; '' where none is.

    Null and empty texts have no row.
    """
    gone = furniture(pages, key, text, url, threshold).groupBy("row_id").agg(F.collect_set("line_no").alias("gone"))
    rows = pages.select(F.col(f"`{key}`").cast("bigint").alias("row_id"), F.col(f"`{text}`").alias("text")).filter("text <> ''")
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    said = F.filter(numbered, lambda s: F.trim(s["x"]) != "")
    gone_or_none = F.coalesce("gone", F.array().cast("array<int>"))
    kept = F.filter(said, lambda s: ~F.array_contains(gone_or_none, s["i"]))
    joined = rows.join(gone, "row_id", "left")
    return joined.select("row_id", F.array_join(F.transform(kept, lambda s: s["x"]), "\n").alias("body"), F.size(said).alias("n_lines"), F.size(gone_or_none).alias("n_furniture"))
