"""Main text of web pages by tag-path ratios.

A page becomes text blocks, each with its root-to-leaf tag path. Text length, text outside links and punctuation are
summed by path; the ratios are smoothed over the page's order of blocks, fused, and lowered for paths through elements
whose class, id or role names something else than an article. Paths over a share of the best value are content. Blocks
of weaker paths (headings, short items) are content where they stand in an element most of whose text is.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)/?>""", re.S)
#: Fixed by the HTML standard: elements without content, and elements that don't break a line.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr audio b bdi bdo big canvas cite code data del dfn em font i ins kbd label mark math mi mn mo mrow msub msup object q s samp small span strike strong sub sup time tt u var video".split())
#: Elements whose content is no text of the page, those of a form's controls, and those that hold no part of an article.
RAW = set("script style title textarea noscript iframe template svg select".split())
BOILERPLATE = set("nav footer aside form menu dialog head fieldset".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Names in class, id or role that tell of something else than the article; their paths count for HINTED of their value.
HINTS = set("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary contentinfo consent cookie cookies copyright disqus footer form menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe tags toc toolbar warning widget".split())
HINTED = 0.01
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUND = ("ul", "ol", "dl", "table", "div", "article", "section")
ATTR = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|(\S+))""", re.I)
MARKS = re.compile(r"""[.,;:!?…。、，；：！？¿¡]""")
SMOOTH = (0.25, 0.5, 0.25)


def hinted(attrs: str) -> bool:
    """Whether a class, id or role is a hint, or a compound of two parts one of which is (ad-box, site-footer); longer
    compounds name a subject (warning-signs-of-flood)."""
    for name in " ".join("".join(v) for v in ATTR.findall(attrs)).lower().split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        if len(parts) <= 2 and not HINTS.isdisjoint(parts):
            return True
    return False


@dataclass
class Node:
    """An element that breaks lines: its parent, its tag, the path from the root, and whether it is boilerplate or hinted."""

    parent: Node | None
    tag: str
    path: int
    bad: bool
    hint: bool
    text: int = 0
    strong: int = 0


def blocks(page: str) -> list[tuple[Node, str, int]]:
    """(element, text, letters in links) of every text block outside boilerplate, in page order. Linear in the page's length."""
    out: list[tuple[Node, str, int]] = []
    paths: dict[tuple[int, str, bool], int] = {}
    top = Node(None, "", 0, False, False)
    stack, opened = [top], Counter()
    closers: dict[str, tuple[list[int], list[int]]] = {}
    parts: list[str] = []
    link = linked = at = 0
    skip = False  # inside a button

    def flush() -> None:
        nonlocal linked, skip
        text = " ".join(entities.unescape("".join(parts)).split())
        if text and not stack[-1].bad:
            out.append((stack[-1], text, linked))
        parts.clear()
        linked, skip = 0, False

    def cut(depth: int) -> None:
        opened.subtract(n.tag for n in stack[depth:])
        del stack[depth:]

    while True:
        m = TOKEN.search(page, at)
        chunk = page[at : m.start() if m else len(page)]
        if chunk and not skip:
            parts.append(chunk)
            linked += len(chunk) * (link > 0)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        close, tag, attrs = m[1], m[2].lower(), m[3]
        if tag in VOID:
            parts.append(" ") if tag == "br" else None
            if tag == "hr":
                flush()
        elif tag == "button":
            skip = not close
        elif tag in INLINE:
            if tag == "a":
                link = max(0, link + (-1 if close else 1))
        elif tag in RAW:
            if not close:
                if tag not in closers:
                    found = [x.span() for x in re.finditer(rf"</{tag}\b[^>]*>", page, re.I)]
                    closers[tag] = ([x for x, _ in found], [x for _, x in found])
                i = bisect_left(closers[tag][0], at)
                at = closers[tag][1][i] if i < len(closers[tag][0]) else (len(page) if tag in ("script", "style", "textarea", "title") else at)
        elif close:
            flush()
            link = 0
            if opened[tag] > 0:
                cut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
        else:
            flush()
            link = 0
            if "p" in CLOSES.get(tag, ()) or tag not in CLOSES:
                while stack[-1].tag == "p":
                    cut(len(stack) - 1)
            if any(opened[x] > 0 for x in CLOSES.get(tag, ())):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in CLOSES[tag]:
                        cut(i)
                        break
                    if stack[i].tag in BOUND:
                        break
            up = stack[-1]
            bad = up.bad or tag in BOILERPLATE or tag == "header" and not (opened["article"] > 0 or opened["main"] > 0)
            hint = up.hint or bool(attrs) and tag not in ("html", "body", "article", "main") and hinted(attrs)
            stack.append(Node(up, tag, paths.setdefault((up.path, tag, hint), len(paths) + 1), bad, hint))
            opened[tag] += 1
    flush()
    return out


def main_text(page: str | None, share: float = 0.3) -> str:
    """The blocks of the article, joined by newlines."""
    found = blocks(page or "")
    if not found:
        return ""
    length, marks, plain, count = (defaultdict(int) for _ in range(4))
    for node, text, linked in found:
        length[node.path] += len(text)
        marks[node.path] += len(MARKS.findall(text))
        plain[node.path] += max(0, len(text) - linked)
        count[node.path] += 1
    value = {p: plain[p] / count[p] * (1 + marks[p] / count[p]) * plain[p] / length[p] for p in length}
    ratio = [value[node.path] * (HINTED if node.hint else 1) for node, _, _ in found]
    smooth = [sum(w * ratio[min(max(i + d, 0), len(ratio) - 1)] for w, d in zip(SMOOTH, (-1, 0, 1), strict=True)) for i in range(len(ratio))]
    fused: dict[int, float] = defaultdict(float)
    for (node, _, _), r, s in zip(found, ratio, smooth, strict=True):
        fused[node.path] += (r * s) ** 0.5 / count[node.path]
    free = {node.path for node, _, _ in found if not node.hint}
    best = max((fused[p] for p in free), default=0.0)  # a hinted path is content only if it is better than all others even so
    top = max(fused.values())
    strong = {p for p, v in fused.items() if v >= share * top and v > 0 and (p in free or v > best)} or set(fused)
    for node, text, _ in found:  # an element's own text, then that of what it holds
        node.text += len(text)
        node.strong += len(text) * (node.path in strong)
    nodes: dict[int, Node] = {}
    order: list[Node] = []
    for node, _, _ in found:
        way = []
        while node is not None and id(node) not in nodes:
            nodes[id(node)] = node
            way.append(node)
            node = node.parent
        order += reversed(way)
    for node in reversed(order):  # parents stand before what they hold
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.strong += node.strong
    home: dict[int, bool] = {}  # whether the nearest element around that holds content holds little else
    for node in order:
        own = node.strong > 0 and node.tag not in ("", "html", "body")
        home[id(node)] = 2 * node.strong >= node.text if own else node.parent is not None and home[id(node.parent)]
    bare = any(node.path in strong and (node.parent is None or node.parent.tag in ("", "html", "body")) for node, _, _ in found)

    def kept(node: Node, text: str, linked: int) -> bool:
        if node.path in strong:
            return True
        if node.hint or 5 * (len(text) - linked) < len(text) and node.tag not in HEADINGS:
            return False
        return home[id(node)] or bare and (node.parent is None or node.parent.tag in ("", "html", "body"))

    return "\n".join(text for node, text, linked in found if kept(node, text, linked))


@F.pandas_udf(StringType())
def article(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([main_text(p) for p in batch], dtype=object)


def extract(pages: DataFrame, html: str | Column = "html") -> DataFrame:
    """pages with a column main_text: each row's article, '' where there is none. Null and empty html give ''.

    Every row is worked on by itself, so repeated rows give repeated results; a column main_text that is there already
    is replaced; other columns stay; an empty table gives an empty table.
    """
    return pages.withColumn("main_text", article(html))
