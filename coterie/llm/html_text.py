"""Main text of web pages by tag-path ratios.

A page is cut into text nodes, each with its path of block elements from the root; a step of a path is
the tag with its classes and id.  Paths are numbered with their parent's number, so a deep page costs a
few numbers per element.  What is never text of a page (scripts, styles, forms, hidden elements) is
left out.

For every path the text length, the punctuation and the text in links are summed over its nodes.  The
ratios to the number of nodes are fused: length x (1 + punctuation) x share outside links, squared; paths
below an element that names itself no article (by tag, role, class or id) count ``NAMED`` of that.  The
scores are spread to the nodes, smoothed over neighbours in page order, and averaged by path.  A path is
content when its score is ``THRESHOLD`` of the page's level, the mean over characters (weighted alike).  Outside of the
article, the path that holds nearly all content, its own ratio has to reach that too; inside, the ratio
of the whole article counts half, so that short lines and headings stay where links and named elements go.

Edge cases: a null or blank page gives an empty text, and so does one without content; broken markup is
read as it comes (a stray ``<`` is text, unclosed elements end with their parents); a null url is kept;
repeated rows stay; pages of any length and depth are read whole; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame

from coterie.llm.common import small_batches

# HTML element and attribute names.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
NO_TEXT = frozenset(
    "head form button select option datalist noscript template iframe object embed svg canvas audio video map script style "
    "textarea title noembed noframes xmp math input label fieldset".split()
)
LINES = frozenset("p h1 h2 h3 h4 h5 h6 dt pre legend caption".split())
#: Elements that are no article by their tag; a header is one inside an article.
AROUND = frozenset("nav aside footer menu dialog header".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words of a class or id that mark what is no article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promos promotion banner banners menu menus nav "
    "navbar navigation breadcrumb breadcrumbs sidebar sidebars rail widget widgets footer cookie cookies consent gdpr notice "
    "notices notification notifications alert alerts popup modal overlay toast comment comments commentlist disqus replies "
    "reply respond share sharing social related recommended recommendations trending newsletter subscribe subscription signup "
    "login pagination pager tagcloud copyright disclaimer skip toolbar teaser outbrain taboola".split()
)
#: The same, but part of the article where it stands inside one.
TOP_MARKS = frozenset("header masthead topbar top".split())
SELF_CLOSING = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
STOP = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?>\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？…]")


#: What a path below an element named no article counts, and the share of the page's level that is content.
NAMED, THRESHOLD = 0.05, 0.1
#: Share of the content that lies in the article, and of the page in a named element that is then its frame.
NEARLY_ALL, FRAME = 0.9, 0.6


class _Paths:
    """The paths of a page: by number the parent, what names the last step no article, and its elements.

    ``single``: one element that may hold others, as an article does (not a paragraph or a heading).
    """

    def __init__(self):
        self.parent, self.named, self.by_name, self.single, self.numbers = [-1], [False], [False], [True], {}

    def step(self, parent: int, label: tuple, named: bool, by_name: bool) -> int:
        n = self.numbers.setdefault((parent, label), len(self.parent))
        if n == len(self.parent):
            self.parent.append(parent)
            self.named.append(named)
            self.by_name.append(by_name)
            self.single.append(label[0] not in LINES)
        else:
            self.single[n] = False
        return n

    def subtree(self, own: np.ndarray) -> np.ndarray:
        """Sums over each path and all below; parents have smaller numbers."""
        out = own.astype(float)
        for k in range(len(out) - 1, 0, -1):
            out[self.parent[k]] += out[k]
        return out


class _Open:
    """An open element: tag, path, whether it is a block, in a link, in article or main, and without text."""

    __slots__ = ("tag", "path", "block", "link", "scope", "mute")

    def __init__(self, tag, path, block, link, scope, mute):
        self.tag, self.path, self.block, self.link, self.scope, self.mute = tag, path, block, link, scope, mute


def _look(tag: str, attributes: str, scope: bool) -> tuple[bool, bool, tuple]:
    """(hidden, named no article by role, class or id, its classes and id); ``scope``: inside article or main."""
    hidden = named = False
    names = []
    if attributes:
        for m in _ATTR.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                hidden = True
            elif name == "role":
                named |= value.lower() in ROLES
            elif name in ("class", "id"):
                words = {w.lower() for w in _WORD.findall(value)}
                names.append(value)
                named |= bool(words & MARKS or not scope and words & TOP_MARKS)
    page = tag in ("html", "body", "main", "article")
    return hidden and not page, named and not page, tuple(names)


def _text_nodes(page: str):
    """The paths of a page and its text nodes in order: (path, text, characters in links)."""
    paths = _Paths()
    stack, nodes = [_Open("", 0, True, False, False, False)], []
    parts: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if parts:
            if text := _SPACE.sub(" ", html.unescape("".join(parts))).strip():
                nodes.append((stack[-1].path, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def say(text):
        nonlocal linked
        if not stack[-1].mute:
            parts.append(text)
            if stack[-1].link:
                linked += len(text.strip())

    at, n = 0, len(page)
    while at < n:
        i = page.find("<", at)
        if i < 0:
            say(page[at:])
            break
        if i > at:
            say(page[at:i])
        if m := _OTHER.match(page, i):
            if page.startswith("<![CDATA[", i):
                say(html.escape(page[i + 9 : m.end() - 3]))
            at = m.end()
            continue
        m = _TAG.match(page, i)
        if not m:
            say("&lt;")
            at = i + 1
            continue
        at = m.end()
        close, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        tag = tag.lower()
        if close:
            k = len(stack) - 1
            while k > 0 and stack[k].tag != tag and not (stack[k].block and tag not in BLOCKS):
                k -= 1
            if k > 0 and stack[k].tag == tag:
                if any(e.block for e in stack[k:]):
                    flush()
                del stack[k:]
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        is_block = tag in BLOCKS
        if is_block:
            flush()
            for old, by in SELF_CLOSING.items():
                if tag in by:
                    k = len(stack) - 1
                    while k > 0 and stack[k].tag != old and stack[k].tag not in STOP.get(old, BLOCKS - {"p"}):
                        k -= 1
                    if k > 0 and stack[k].tag == old:
                        del stack[k:]
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        up = stack[-1]
        hidden, by_name, names = _look(tag, rest, up.scope)
        by_tag = tag in AROUND and not (tag == "header" and up.scope)
        path = paths.step(up.path, (tag, *names), by_tag or by_name, by_name and not by_tag) if is_block else up.path
        mute = up.mute or hidden or tag in NO_TEXT or not is_block and (by_name or by_tag)
        stack.append(_Open(tag, path, is_block, up.link or tag == "a", up.scope or tag in ("article", "main"), mute))
    flush()
    return paths, nodes


def path_scores(paths: _Paths, nodes: list) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """By path: the smoothed fused score, the page's level, the fused ratio by itself, and what paths count."""
    n = len(paths.parent)
    which = np.array([p for p, _, _ in nodes])
    size = np.array([len(t) for _, t, _ in nodes], float)
    links = np.array([l for _, _, l in nodes], float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for _, t, _ in nodes], float)
    total = lambda x: np.bincount(which, x, n)
    count, chars = np.maximum(np.bincount(which, minlength=n), 1), total(size)
    free = 1 - total(links) / np.maximum(chars, 1)
    plain = chars / count * (1 + total(marks) / count) * free**2
    held = paths.subtree(total(size - links))
    named = np.array(paths.named) & ~(np.array(paths.by_name) & (held > FRAME * held[0]))
    for k in range(1, n):
        named[k] |= named[paths.parent[k]]
    worth = np.where(named, NAMED, 1.0)
    ratio = plain * worth
    padded = np.pad(ratio[which], 1)
    smooth = 0.25 * padded[:-2] + 0.5 * padded[1:-1] + 0.25 * padded[2:]
    score = total(smooth) / count * worth * free
    weight = size * worth[which]
    level = float((plain[which] * weight).sum() / weight.sum())
    return score, level, ratio, worth * free


def main_text(page: str | None) -> str:
    """The article of one page, its blocks joined by line feeds."""
    paths, nodes = _text_nodes(page or "")
    if not nodes:
        return ""
    score, level, ratio, counts = path_scores(paths, nodes)
    limit = THRESHOLD * level
    strict = np.minimum(score, ratio)
    chars = np.zeros(len(score))
    for p, text, _ in nodes:
        chars[p] += len(text)
    held = paths.subtree(np.where(strict >= limit, chars, 0) * (counts > 0))
    top = int(np.flatnonzero((held >= NEARLY_ALL * held[0]) & np.array(paths.single))[-1])
    inside = np.zeros(len(score), bool)
    inside[top] = True
    for k in range(top + 1, len(score)):
        inside[k] = inside[paths.parent[k]]
    blended = np.where(inside & (held[0] > 0), (score + level * counts) / 2, strict)
    content = blended >= limit
    return "\n".join(t for p, t, _ in nodes if content[p])


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns ``keep`` with ``text`` and ``n_chars`` of every page."""
    import pyarrow as pa

    small_batches(pages.sparkSession, 256)

    def run(batches):
        for b in batches:
            texts = [main_text(p) for p in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*(f"c{i}" for i in range(len(keep))), "text", "n_chars"],
            )

    kinds = ", ".join(f"c{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    return pages.select(*keep, html_col).mapInArrow(run, f"{kinds}, text string, n_chars bigint").toDF(*keep, "text", "n_chars")


QUERY = "op5_main_text"


def query(spark, sf_dir: str) -> DataFrame:
    from coterie.llm.common import table

    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
