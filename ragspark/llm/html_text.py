"""Main text of web pages by the distribution of text over lines.

Markup is stripped into lines, one a block. What never belongs to an article (scripts, menus, forms, adverts,
reader comments, ...) leaves a gap of empty lines. Text lengths are summed over sliding windows of lines: a stretch
between two windows without text is a passage, from its surge to its dive point. Passages lie in regions: an article or
main element is one, and outside of it each menu, header, footer or sidebar begins another. A region whose highest
window reaches the bar is text, all its passages from the first surge to the last dive; regions below the bar (slogans,
teasers, imprints) are not. Where a region of an article reaches the bar, those outside of articles do not count. The bar
is SURGE characters, or half of the page's highest window where that is less, so it never grows with a long paragraph.

All steps take time linear in the page's length: tags are read in one pass and matched by a stack a name.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .workspace import bounded, sliced

WINDOW = 3
#: Characters that a window of WINDOW lines must hold to be a surge, unless the whole page has little text.
SURGE = 80
#: Share of link text from which a passage outside an article is a menu.
LINKS = 0.6

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# fixed values: elements by how they are treated
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
SILENT = frozenset("annotation annotation-xml applet audio button canvas datalist embed form head iframe map nav noembed noframes noscript object script select style template textarea title video aside footer menu".split())
#: Silent elements that stand in a line of text and do not end it.
INLINE = frozenset("annotation annotation-xml button select".split())
RAW = frozenset("script style textarea title".split())
CONTENT = frozenset("article main".split())
#: Elements that end a region of the page outside an article.
APART = frozenset("header footer nav aside menu".split())
SPACES = frozenset("br td th img wbr input".split())
NOISE = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies disclaimer discussion disqus footer header masthead menu menubar modal nav navbar navigation newsletter notice notices overlay popup promo promoted promotion related replies respond search share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget".split())
#: Names of noise that an id inside an article gives to a section of the text as well.
TOPICS = frozenset("banner consent cookie cookies disclaimer discussion menu navigation notice notices promotion related replies search share sharing social subscription".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: First words of names of reader comments, whatever element has them, and what follows them in names that only tell a state.
COMMENTS, STATES = frozenset("comment comments commentlist disqus".split()), frozenset("allowed closed disabled enabled open status".split())
_WORDS = re.compile(r"[a-z]+")


def _noise(name: str, attributes: str, inside: bool) -> int:
    """3 if a class, id or role is named after reader comments. 2 if all its words name noise or, inside an article, the first
    of several does and is no topic; 1 if some word does outside an article, else 0. Whole pages and articles are
    never noise but as comments."""
    if name in ("body", "html", "main") or not attributes or inside and name in HEADINGS:
        return 0
    found = 0
    for m in _NAMED.finditer(attributes):
        for token in (m[2] or m[3] or m[4] or "").split():
            words = _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
            if words and words[0] in COMMENTS and not STATES & set(words[1:]):
                return 3
            if name == "article" or not words:
                continue
            if all(w in NOISE for w in words) and not (inside and m[1].lower() == "id" and len(words) == 1 and words[0] in TOPICS):
                found = 2
            elif inside and len(words) > 1 and words[0] in NOISE - TOPICS:
                found = 2
            elif not inside and any(w in NOISE for w in words):
                found = max(found, 1)
    return found


class Tag(NamedTuple):
    start: int
    end: int
    name: str
    shut: bool
    attributes: str


def tags(page: str) -> list[Tag]:
    """All tags in order. Comments, declarations and what raw elements (scripts, ...) hold have an empty name. A quote
    that is never closed does not quote; a tag that never ends is text."""
    out: list[Tag] = []
    lower, at, n = None, 0, len(page)
    none = {c: n for c in ">\"'"}  # from here on the page is known not to have the character

    def find(c: str, i: int) -> int:
        if i >= none[c]:
            return -1
        j = page.find(c, i)
        if j < 0:
            none[c] = i
        return j

    while (begin := page.find("<", at)) >= 0:
        at = begin + 1
        if page.startswith(("!", "?"), at):
            if page.startswith("!--", at):
                j = page.find("-->", at + 3)
                at = n if j < 0 else j + 3
            elif (j := find(">", at)) >= 0:
                at = j + 1
            else:
                continue
            out.append(Tag(begin, at, "", False, ""))
            continue
        m = _NAME.match(page, at)
        if not m or find(">", m.end()) < 0:
            continue
        i = m.end()
        while (q := _STOP.search(page, i)) and q[0] != ">":
            j = find(q[0], q.end())
            i = q.end() if j < 0 else j + 1
        end = q.end() if q else find(">", m.end()) + 1
        name = m[2].lower()
        out.append(Tag(begin, end, name, m[1] == "/", page[m.end() : end - 1]))
        at = end
        if name in RAW and not m[1] and not out[-1].attributes.endswith("/"):
            if lower is None:
                lower = page.lower()
                lower = lower if len(lower) == n else re.sub("[A-Z]", lambda c: c[0].lower(), page)
            j = lower.find("</" + name, at)
            close = n if j < 0 else find(">", j) + 1 or n
            out.append(Tag(n if j < 0 else j, close, name, True, ""))
            at = close
    return out


def closings(found: list[Tag]) -> list[int]:
    """The place of each opening tag's closing tag; 0 for those never closed, and for closing tags."""
    out, open_ = [0] * len(found), {}
    for i, t in enumerate(found):
        if t.shut:
            if open_.get(t.name):
                out[open_[t.name].pop()] = i
        elif t.name and not t.attributes.endswith("/"):
            open_.setdefault(t.name, []).append(i)
    return out


class Line(NamedTuple):
    text: str
    region: int
    inside: bool
    heading: bool
    linked: int


def lines_of(page: str) -> list[Line]:
    """The lines of a page with their regions; WINDOW empty lines stand for what was taken out."""
    found = tags(page)
    ends = closings(found)
    holds = [0]  # how many articles, main elements and first headings open before each tag
    for t in found:
        holds.append(holds[-1] + (not t.shut and t.name in ("article", "main", "h1")))
    out: list[Line] = []
    held: list[str] = []
    linked, in_link, in_title, heading, depth, met, region, at, i = 0, False, False, False, 0, False, 0, 0, 0

    def close() -> None:
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append(Line(text, region, depth > 0, heading, linked))
            held.clear()
        linked = 0

    def apart(new: bool) -> None:
        nonlocal region
        close()
        region += new
        out.extend([Line("", region, depth > 0, False, 0)] * WINDOW)

    def say(text: str) -> None:
        nonlocal linked
        if text:
            held.append(text)
            if in_link and not in_title:
                linked += len(text.strip())

    while i < len(found):
        t = found[i]
        if t.start > at:
            say(page[at : t.start])
        at, name, last = max(at, t.end), t.name, ends[i]
        i += 1
        if not name:
            continue
        noise = 0 if t.shut else _noise(name, t.attributes, depth > 0)
        if not t.shut and (name in SILENT or name == "header" and not depth or noise):
            # a form, header or named wrapper around the text is not noise; after an article, one named so in full is, and
            # one of comments always
            wraps = not depth and (name not in SILENT or name == "form") and (noise < 2 or noise == 2 and not met)
            if last and not (wraps and holds[last] > holds[i]):
                if name in BLOCKS or name not in INLINE:
                    apart(name in APART and not depth)
                at, i = found[last].end, last + 1
                continue
        if name in CONTENT:
            close()
            depth = max(0, depth + (-1 if t.shut else 1))
            apart(depth == (0 if t.shut else 1))
            in_title, heading, met = False, False, True
        elif name in BLOCKS:
            close()
            in_title, heading = name == "h1" and not t.shut, name in HEADINGS and not t.shut
            if name == "h1" and not depth and not t.shut:
                apart(False)
        elif name in SPACES:
            say(" ")
        elif name == "a":
            in_link = not t.shut
    say(page[at:])
    close()
    return out


def passages(lengths: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(surge, dive, peak) of each stretch of lines between zero window sums; peak is its highest window sum."""
    if not len(lengths):
        return []
    sums = np.convolve(lengths, np.ones(window, np.int64))  # sums[i]: lines i - window + 1 to i
    cover = sums > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], cover.view(np.int8), [0]])))
    return [(int(a), int(z) - window + 1, int(sums[a:z].max())) for a, z in edges.reshape(-1, 2)]


def chosen(lines: list[Line], window: int = WINDOW) -> list[tuple[int, int]]:
    """(surge, dive) of the passages that are text."""
    found = []
    for a, z, peak in passages(np.array([len(x.text) for x in lines], np.int64), window):
        # links count as text inside an article only; outside, a passage of links is a menu
        size, links = sum(len(x.text) for x in lines[a:z]), sum(x.linked for x in lines[a:z])
        if lines[a].inside or links < LINKS * size:
            found.append((a, z, peak))
    bar = min(SURGE, max((p for _, _, p in found), default=0) / 2)
    kept: dict[int, bool] = {}
    for a, z, peak in found:
        r = lines[a].region
        kept[r] = kept.get(r, False) or peak >= bar or any(x.heading for x in lines[a:z])
    inside = any(kept[lines[a].region] and lines[a].inside for a, _, _ in found)
    return [(a, z) for a, z, _ in found if kept[lines[a].region] and lines[a].inside == inside]


def main_text(page: str | None) -> str:
    lines = lines_of(page or "")
    return "\n".join(x.text for a, z in chosen(lines) for x in lines[a:z] if x.text)


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html, ...).

    Null and empty html and pages without text give the empty text. Very long pages take linear time and are read whole.
    Rows are independent of each other, so repeated rows give equal rows; page_id and url pass through, null or not.
    Other columns are ignored; an empty table gives no rows."""
    bounded(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
