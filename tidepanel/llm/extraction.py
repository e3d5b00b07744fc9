"""Main text of HTML pages by tag-path ratios.

Each piece of text hangs on a root-to-leaf path of tags (with their classes). Per path a page gives text length outside
links, length inside links and punctuation marks. Ratios per path, the length per visit of the path and the
punctuation per word, are smoothed over neighbouring paths in page order and fused; paths over a threshold that
follows from the page itself are seeds. The content lies in the deepest element that holds nearly all the seeds' text, or
in an article or main element that holds most of it. In such an element everything is kept but furniture: tags, roles and
class names of menus, adverts, forms and comments. In any other, the ratios also say where the content begins and ends: it
goes from the first seed to the last one and on to both sides over headings and paths with punctuation outside links;
what lies beyond goes, and so do lists of links.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Tags by their part in a page.
FURNITURE = frozenset("nav footer aside form script style noscript template iframe object embed svg canvas button select textarea input label dialog menu head".split())
RAW = frozenset("script style textarea title xmp noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr",), "tbody": ("thead", "tr", "td", "th"),
}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HOLDERS = frozenset(["", "html", "body", "article", "main", "section", "div", "td", "center"])
SCOPE = frozenset("article section div td th table body aside main blockquote ul ol dl figure header footer nav form".split())
#: Words in classes, ids and roles that mark furniture.
WORDS = frozenset(
    "ad ads advert adverts advertisement adsense advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification popup promo promoted promotion recommended related reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget complementary".split()
)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
MARK = re.compile(r"\b(class|id|role|aria-hidden|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？؟।]")


class _Page:
    """Paths of one page: for each path its parent, tag, classes and what its texts sum to."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.parent, self.tag, self.bad, self.worded = [-1], [""], [False], [False]
        self.plain, self.linked, self.marks, self.words, self.visits = [0], [0], [0], [0], [0]
        self.order: list[int] = []

    def path(self, parent: int, tag: str, mark: str, bad: bool, worded: bool) -> int:
        key = (parent, tag, mark)
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.parent)
            self.parent.append(parent)
            self.tag.append(tag)
            self.bad.append(bad or self.bad[parent])
            self.worded.append(worded)
            for x in (self.plain, self.linked, self.marks, self.words, self.visits):
                x.append(0)
        return n


def _furniture(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, str]:
    """Whether a tag is furniture, whether its class, id or role says so, and its classes as part of the path."""
    worded, bad, mark = False, tag in FURNITURE or tag == "header" and not inside, ""
    if attributes and "=" in attributes or "hidden" in attributes:
        for m in MARK.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id", "role"):
                mark += f".{value}" if name == "class" else ""
                worded = worded or tag not in ("html", "body", "article", "main") and not WORDS.isdisjoint(SPLIT.split(value))
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                bad = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                bad = True
    return bad, worded, mark


def _blocks(source: str) -> tuple[_Page, list[tuple[list, str]]]:
    """The page's paths, and its blocks of text in page order, each with (path, size, in a link) of its texts."""
    page, blocks = _Page(), []
    stack: list[tuple[str, int, bool]] = []  # tag, path, inside an article
    parts: list[str] = []
    held: list[tuple[int, int, bool]] = []
    links, at, n = 0, 0, len(source)

    def text(raw: str) -> None:
        said = html.unescape(raw) if "&" in raw else raw
        here = stack[-1][1] if stack else 0
        if size := len(said.strip()):
            if links:
                page.linked[here] += size
            else:
                page.plain[here] += size
                page.marks[here] += len(PUNCTUATION.findall(said))
                page.words[here] += said.count(" ") + 1
            if not page.visits[here]:
                page.order.append(here)
            page.visits[here] += 1
            held.append((here, size, links > 0))
        parts.append(said)

    def flush() -> None:
        said = " ".join("".join(parts).split())
        parts.clear()
        if said:
            blocks.append((list(held), said))
        held.clear()

    def close(k: int) -> None:
        nonlocal links
        for tag, _, _ in stack[k:]:
            links -= tag == "a"
        del stack[k:]

    for m in TAG.finditer(source):
        if m.start() < at:
            continue
        if m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag not in INLINE:
                flush()
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            if k >= 0:
                close(k)
            continue
        attributes = m[3] or m[6] or ""
        if tag not in INLINE:
            flush()
        elif tag == "br":
            parts.append(" ")
        if tag in ENDS_P or tag in CLOSES:
            shut = CLOSES.get(tag, ()) + (("p",) if tag in ENDS_P else ())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in shut:
                    close(k)
                elif stack[k][0] in SCOPE:
                    break
        inside = bool(stack) and stack[-1][2]
        bad, worded, mark = _furniture(tag, attributes, inside)
        here = page.path(stack[-1][1] if stack else 0, tag, mark, bad, worded)
        if tag in VOID or attributes.endswith("/") and tag not in INLINE and tag not in ENDS_P:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else n
            continue
        stack.append((tag, here, inside or tag in ("article", "main")))
        links += tag == "a"
    if at < n:
        text(source[at:])
    flush()
    return page, blocks


def _scores(page: _Page) -> dict[int, float]:
    """The fused, smoothed ratio of each path that is no furniture, in page order."""
    order = [k for k in page.order if not page.bad[k]]
    length = [page.plain[k] / page.visits[k] for k in order]
    marks = [page.marks[k] / max(1, page.words[k]) for k in order]

    def smooth(x):
        return [sum(w * x[j] for j, w in ((i - 1, 0.25), (i, 0.5), (i + 1, 0.25)) if 0 <= j < len(x)) for i in range(len(x))]

    fused = {}
    for k, a, b in zip(order, smooth(length), smooth(marks), strict=True):
        fused[k] = math.log1p(a) * (0.2 + b) * math.log1p(page.plain[k])
    return fused


def _seeds(page: _Page, strong: bool = False) -> set[int]:
    """The paths whose score reaches the bar that the page's own scores set; half the best score, if strong."""
    fused = _scores(page)
    if not fused:
        return set()
    values = list(fused.values())
    bar = max(values) / 2 if strong else min(sum(values) / len(values), max(values) / 2)
    return {k for k, v in fused.items() if v >= bar}


def _seed_text(page: _Page) -> dict[int, int]:
    """How much of the seeds' text each path holds."""
    held: dict[int, int] = {}
    for k in _seeds(page):
        size = page.plain[k]
        while k >= 0:
            held[k] = held.get(k, 0) + size
            k = page.parent[k]
    return held


def _condemn(page: _Page) -> None:
    """Mark what a word in a class, id or role calls furniture, but for elements that hold most of the seed text."""
    held = _seed_text(page)
    for k in range(1, len(page.parent)):  # parents come first
        page.bad[k] = page.bad[k] or page.bad[page.parent[k]] or page.worded[k] and 2 * held.get(k, 0) <= held.get(0, 0)


def main_text(source: str | None) -> str:
    """The blocks of the page's main text, joined by a newline."""
    if not source:
        return ""
    page, blocks = _blocks(source)
    _condemn(page)
    held = _seed_text(page)
    if not held:
        return ""
    total = held.get(0, 0)
    semantic = {k: s for k, s in held.items() if page.tag[k] in ("article", "main")}
    marked = bool(semantic) and max(semantic.values()) >= 0.3 * total
    if marked:
        root_of = {max(semantic, key=lambda k: (semantic[k], k))}
    else:
        root_of = {max((k for k, s in held.items() if s >= 0.9 * total and page.tag[k] in HOLDERS), key=lambda k: (_depth(page, k), k))}
        if not total:
            return ""
    keep: dict[int, bool] = {}

    def kept(k: int) -> bool:
        if k not in keep:
            j, under = k, False
            while j >= 0 and not under:
                under = j in root_of
                j = page.parent[j]
            keep[k] = under and not page.bad[k]
        return keep[k]

    def menu(k: int) -> bool:
        return not marked and page.linked[k] > 0 and page.plain[k] == 0 and page.visits[k] >= 3 and page.linked[k] / page.visits[k] < 40 and _listed(page, k)

    def stays(texts: list) -> bool:
        size, linked = sum(n for _, n, _ in texts), sum(n for _, n, link in texts if link)
        if linked >= 0.9 * size and any(menu(k) for k, _, link in texts if link):
            return False
        return 2 * sum(n for k, n, _ in texts if kept(k)) > size

    found = [(texts, said) for texts, said in blocks if stays(texts)]
    return "\n".join(said for _, said in (found if marked else _spanned(page, found)))


def _spanned(page: _Page, blocks: list[tuple[list, str]]) -> list[tuple[list, str]]:
    """The blocks from the first with a seed to the last, and what stands beside them and reads like content."""
    seeds = _seeds(page, strong=True)
    seeds = {k for k in seeds if page.marks[k]} or seeds
    at = [i for i, (texts, _) in enumerate(blocks) if any(k in seeds for k, _, _ in texts)]
    if not at:
        return []
    first, last = at[0], at[-1]

    def reads(i: int) -> bool:
        return 0 <= i < len(blocks) and all(_headed(page, k) or page.marks[k] and not page.linked[k] for k, _, _ in blocks[i][0])

    while reads(first - 1):
        first -= 1
    while reads(last + 1):
        last += 1
    return blocks[first : last + 1]


def _headed(page: _Page, k: int) -> bool:
    """Whether a path lies in a heading."""
    while k > 0:
        if page.tag[k] in ("h1", "h2", "h3", "h4", "h5", "h6"):
            return True
        k = page.parent[k]
    return False


def _depth(page: _Page, k: int) -> int:
    d = 0
    while k > 0:
        k, d = page.parent[k], d + 1
    return d


def _listed(page: _Page, k: int) -> bool:
    """Whether a path lies in a list."""
    while k > 0:
        if page.tag[k] in ("li", "dd", "dt"):
            return True
        k = page.parent[k]
    return False


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """pages without the source, plus `text` and `n_chars` (its code points); null, empty or bare pages: empty text.

    Each page is read whole and by itself, so memory is bounded by the longest page.
    """
    rest = [c for c in pages.columns if c not in (source, "text", "n_chars")]
    schema = shared.widened(pages.select(*rest), "text string, n_chars long")

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*rest, "text", "n_chars"])

    return pages.select(*rest, F.col(source).alias(*shared.free_names(rest, "extracted_from"))).mapInArrow(run, schema)


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
