"""Main-text extraction by consensus host paths.

Pass one scores the containers of every page and sums the scores by host and generalised path (tag names and
classes with digits replaced) in Spark; the path with the most votes wins for the host. Pass two extracts every
page again from the containers on its host's winning path; a page on which these hold nothing, or clearly less than
an article or main element, uses its own best container.

A container scores the characters of its running text less twice those of links, and so do the containers around it, a
touch less from level to level: a heading or lead beside the body belongs to the article, a list of links doesn't.
The page's body scores only a part, as it gathers what stands around an article.

Text in menus, headers, footers, side bars, notices, adverts, forms, comments, scripts and styles is left out, by tag or
by the words of class, id and role. Character references are decoded, white space inside a block becomes one
space, and blocks are joined by one newline in page order. Nothing else is dropped. Work is linear in the size of a page,
however deep its elements lie: paths are numbers made from the parent's, and what holds for an element's inside is kept with it.

Defined cases: null or empty html, or html without text, gives ''; a null url is a host of its own; markup
that breaks off counts up to its end; repeated rows give equal results; an empty table gives an empty result; further
columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, read, tidy

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']*(?:"[^"]*"|'[^']*'))*[^>"']*|[^>]*)(?:>|\Z))""", re.S)
_MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_CONTAINERS = {"article", "main", "section", "div", "td", "body"}
_DROPPED = {"nav", "footer", "aside", "form", "head", "button", "select", "svg", "object", "dialog", "menu", "audio", "video", "canvas", "option", "label", *_RAW}
#: Words of class, id or role that mark page furniture.
_FURNITURE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager",
    "header", "masthead", "footer", "sidebar", "aside", "complementary", "contentinfo", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "notification", "popup", "modal", "overlay", "comment", "comments",
    "disqus", "reply", "replies", "respond", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "signup", "login", "search", "toolbar", "widget", "hidden", "skip", "form", "disclaimer",
}
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_WALLS = {"table", "ul", "ol", "dl", "article", "section", "div", "main", "body", "aside", "nav", "footer", "header", "form"}
#: What a container's score counts for in the containers around it, and in the page's body.
_SHARE_UP, _SHARE_BODY = 0.999, 0.8
_SEMANTIC = 1.5
#: A page on which the host's path has less than this part of an article's score uses the article.
_LEAST_SHARE = 0.5


class _Open:
    """An open element: its path's number and last step, whether text inside is dropped, linked or in an article, the place of the nearest wall, its score so far, and whether it is on the wanted path."""

    __slots__ = ("article", "dropped", "linked", "path", "score", "step", "tag", "wall", "wanted")

    def __init__(self, tag: str, path: int, step: str, dropped: bool, linked: bool, article: bool, wall: int):
        self.tag, self.path, self.step, self.dropped, self.linked, self.article, self.wall = tag, path, step, dropped, linked, article, wall
        self.score, self.wanted = 0.0, False


def _furniture(tag: str, marks: str, in_article: bool) -> bool:
    """True if the tag or a word of its marks speaks of page furniture; a header inside an article is the article's own, and `no-sidebar` means none."""
    if tag in _DROPPED or tag == "header" and not in_article:
        return True
    if tag in ("body", "article", "main", "html"):
        return False
    words = [w for w in re.split(r"[^a-z0-9]+", marks) if w]
    named = (w for w, before in zip(words, ["", *words]) if w in _FURNITURE and before not in ("no", "has", "with", "without"))
    return any(not in_article or w not in ("header", "masthead") for w in named)


def walk(html: str, opened=None, closed=None) -> Iterator[tuple[str, _Open]]:
    """(text, innermost open element) of each run of text, and ("\\n", ...) where a block begins or ends; opened(element, around) and closed(element, around) are told of every element."""
    stack, places, at = [_Open("", 0, "", False, False, False, 0)], {}, 0

    def cut(depth: int) -> None:
        while len(stack) > depth:
            x = stack.pop()
            places[x.tag].pop()
            if closed:
                closed(x, stack[-1])

    def place(tag: str) -> int:
        """Place of the innermost open element of a tag; 0 where there is none."""
        known = places.get(tag)
        return known[-1] if known else 0

    while True:
        m = _TAG.search(html, at)
        if m is None:
            if at < len(html):
                yield html[at:], stack[-1]
            break
        if m.start() > at:
            yield html[at : m.start()], stack[-1]
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        block = tag in _BLOCKS
        if m[1]:
            depth = place(tag)
            if depth and (block or stack[-1].wall <= depth):
                if block:
                    yield "\n", stack[-1]
                cut(depth)
            if block:
                yield "\n", stack[-1]
            continue
        if block:
            yield "\n", stack[-1]
            closes = _CLOSES.get(tag) or ({"p"} if tag != "br" else set())
            while (k := max(map(place, closes), default=0)) > stack[-1].wall:
                cut(k)
                if tag == "p":
                    break
        if tag in _VOID:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if m[3].rstrip().endswith("/") and not block:
            continue
        above, marks, classes = stack[-1], "", []
        for x in _MARKS.finditer(m[3]) if m[3] else ():
            said = (x[2] or x[3] or x[4] or "").lower()
            marks += " " + said
            if x[1].lower() == "class":
                classes = re.sub(r"\d+", "N", said).split()
        step = ".".join([tag, *sorted(classes)]) if block else above.step
        path = xxhash.xxh64_intdigest(step, above.path) if block else above.path
        dropped = above.dropped or _furniture(tag, marks, above.article)
        x = _Open(tag, path, step, dropped, above.linked or tag == "a", above.article or tag == "article", len(stack) if tag in _WALLS else above.wall)
        places.setdefault(tag, []).append(len(stack))
        if opened:
            opened(x, above)
        stack.append(x)
    cut(1)


def scores(html: str) -> dict[int, tuple[float, str]]:
    """Score and last step of each generalised container path."""
    found: dict[int, tuple[float, str]] = {}

    def closed(x: _Open, around: _Open) -> None:
        worth = x.score
        if worth and x.tag in _CONTAINERS:
            found[x.path] = found.get(x.path, (0.0,))[0] + worth * (_SEMANTIC if x.tag in ("article", "main") else _SHARE_BODY if x.tag == "body" else 1.0), x.step
            worth *= _SHARE_UP
        around.score += worth

    for text, x in walk(html, closed=closed):
        if text != "\n" and not x.dropped and (n := len(" ".join((unescape(text) if "&" in text else text).split()))):
            x.score += -2.0 * n if x.linked else float(n)
    return found


def best_path(found: dict[int, tuple[float, str]]) -> int | None:
    return max(found, key=lambda p: (found[p][0], p)) if found else None


def extract(html: str, path: int | None) -> str:
    """Blocks below the containers on the path, or the whole page's where path is None."""
    blocks, run = [], []

    def opened(x: _Open, around: _Open) -> None:
        x.wanted = around.wanted or x.path == path

    def close() -> None:
        if run:
            said = " ".join(unescape("".join(run)).split())
            run.clear()
            if said:
                blocks.append(said)

    for text, x in walk(html, opened):
        if text == "\n":
            close()
        elif not x.dropped and (path is None or x.wanted):
            run.append(text)
    close()
    return "\n".join(blocks)


def main_text(page: str, path: int | None) -> str:
    """A page's text from the host's path; from its own best container where that path holds nothing, or clearly less than an article or main element."""
    found = scores(page)
    own = best_path(found)
    if own is not None and path in found and found[path][0] > 0:
        article = found[own][1].split(".")[0] in ("article", "main")
        if not article or found[path][0] >= _LEAST_SHARE * found[own][0]:
            own = path
    return extract(page, own)


def _voter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, steps, worth = [], [], [], []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
            for path, (score, step) in scores(html.as_py() or "").items():
                hosts.append(host)
                paths.append(path - 2**63)
                steps.append(step)
                worth.append(round(score * 100))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(steps, pa.string()), pa.array(worth, pa.int64())], names=["host", "path", "step", "score"])


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html.as_py() or "", None if path is None else path + 2**63) for html, path in zip(batch.column(2), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), batch.column(4)], names=["page_id", "url", "text", "path"])


def host_of(url):
    """Lower-case host of a url; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, step): the container path with the most votes of each host, by number, and its last step; ties go to the greatest number."""
    votes = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(tidy(_voter), "host string, path long, step string, score long")
    return votes.groupBy("host", "path", "step").agg(F.sum("score").alias("score")).groupBy("host").agg(F.max(F.struct("score", "path", "step")).alias("m")).select("host", "m.path", "m.step")


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, path) of every page; path is the last step of its host's winning path."""
    known = durable(host_paths(pages))
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    return rows.join(known, "host", "left").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", "path", "step").mapInArrow(tidy(_extractor), "page_id long, url string, text string, path string")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")
