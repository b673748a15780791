"""Main text of web pages by tree scoring.

A page becomes a tree of block elements. Every paragraph of text has points for its length and its
commas, less the share of its letters that are links; it passes them whole to its parent and in
falling shares to further ancestors. An ancestor's points are discounted by its own link density;
the best one, raised to an enclosing article, and its siblings with enough points are kept. What
is marked as menu, header, footer, sidebar, notice, advert, form, script, style or reader comment
is left out before scoring, unless it holds the article: a mark is lifted from what has most of the
page's points and may be a wrapper, and from what holds an article or main with most of them. Marks
and form controls inside stay.

Null or empty html, and pages without text, give an empty text. Unclosed and misplaced tags are
taken as browsers do; an unclosed comment or script runs to the end. Scanning is linear in the
page. Null page_id or url are passed on, repeated rows give repeated results, an empty table an
empty one; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import slices

# Element names of HTML by what they mean for the text, and words in class and id
# names that mark a part as something other than the article, or as the article.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol
    p pre section summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title".split())
DROPPED = frozenset("aside button dialog footer form head header menu nav datalist".split())
CLOSES_P = BLOCKS - {"body", "html", "head", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
             "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
             "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, {"html"})}
OTHER_WORDS = frozenset("""ad ads adv advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments
    consent cookie cookies disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter
    notice notices outbrain pager pagination popup promo related reply respond share sharing shoutbox sidebar signup
    social sponsor sponsored subscribe taboola toolbar widget""".split())
ARTICLE_WORDS = frozenset("article body content entry has main no page post story text with wrapper container".split())
ALWAYS_OTHER = frozenset("comment comments disqus respond shoutbox".split())
#: Elements and names that often wrap a whole page, and controls of forms.
WRAPPERS = frozenset("form header aside nav menu".split())
CONTROLS = frozenset("button datalist head label legend output select".split())
#: How surely an element is no part of an article: perhaps a wrapper, the part itself, reader
#: comments, a control. A wrapper's mark is lifted if it has so many points and times the rest's.
NOT_MARKED, WRAPPER, PART, COMMENT, CONTROL = range(5)
LEAST_POINTS, TIMES_REST = 3.0, 3.0
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+'|"[^"]*+"(?=[\s/>])|'[^']*+'(?=[\s/>]))*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>""")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?![\w-])""", re.I)
_NAME_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_RAW_END = {tag: re.compile("</" + tag, re.I | re.A) for tag in RAW}
_HEADING = re.compile(r"h[1-6]\Z")


def _marked(attributes: str, tag: str) -> int:
    """How the attributes say that the element is no part of an article, if they do."""
    protected = tag in ("html", "body", "article", "main")
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            for word in value.split():
                parts = [p.lower() for p in _NAME_PARTS.split(word) if p]
                if ALWAYS_OTHER.intersection(parts):
                    return NOT_MARKED if tag in ("html", "body") else COMMENT
                if not protected and parts and (
                        parts[0] in OTHER_WORDS
                        or OTHER_WORDS.intersection(parts) and not ARTICLE_WORDS.intersection(parts)):
                    return PART if OTHER_WORDS.issuperset(parts) and parts != ["form"] else WRAPPER
        elif protected:
            continue
        elif name == "role":
            if value.lower() in OTHER_ROLES:
                return WRAPPER if value.lower() == "form" else PART
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return PART
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return PART
    return NOT_MARKED


class _Tree:
    """Block elements in page order; ``blocks`` are (element, text, letters in links)."""

    def __init__(self, html: str):
        self.tag, self.parent, self.mark = ["#"], [0], [NOT_MARKED]
        self.blocks: list[tuple[int, str, int]] = []
        self._stack: list[tuple[str, int, bool]] = [("#", 0, True)]  # open elements; inline ones keep their block's number
        self._open: dict[str, int] = {}
        self._parts: list[str] = []
        self._links, self._in_links = 0, 0
        self._read(html)
        self._end_block()

    def _end_block(self) -> None:
        if self._parts:
            text = " ".join(unescape("".join(self._parts)).split())
            node = self._stack[-1][1]
            if text:
                self.blocks.append((node, text, min(self._links, len(text))))
            self._parts = []
        self._links = 0

    def _text(self, text: str) -> None:
        if text:
            self._parts.append(text)
            if self._in_links:
                self._links += len(text)

    def _pop(self, depth: int) -> None:
        """Close everything above ``depth`` open elements."""
        for name, *_ in self._stack[depth:]:
            self._open[name] -= 1
            self._in_links -= name == "a"
        del self._stack[depth:]

    def _close(self, names: set[str] | frozenset[str], within: set[str] | frozenset[str]) -> None:
        """Close the nearest open element of ``names`` that stands inside ``within``."""
        if not any(self._open.get(n) for n in names):
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            name = self._stack[depth][0]
            if name in names:
                self._end_block()
                self._pop(depth)
                return
            if name in within:
                return

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._end_block()
        if tag in CLOSES_P:
            self._close({"p"}, {"table", "td", "th", "button", "article", "section", "div", "blockquote", "li"} - {tag})
        if tag in CLOSED_BY:
            self._close(*CLOSED_BY[tag])
        if tag == "br":
            self._text(" ")
        if tag in VOID:
            return
        node = self._stack[-1][1]
        mark = _marked(attributes, tag) if attributes else NOT_MARKED
        if tag in CONTROLS and (tag in DROPPED or self._open.get("form")):
            mark = CONTROL
        elif tag in DROPPED and not (tag == "header" and (self._open.get("article") or self._open.get("main"))):
            mark = max(mark, WRAPPER if tag in WRAPPERS else PART)
        made = tag in BLOCKS or mark != NOT_MARKED
        if made:
            self._end_block()
            self.tag.append(tag)
            self.parent.append(node)
            self.mark.append(mark)
            node = len(self.tag) - 1
        self._stack.append((tag, node, made))
        self._open[tag] = self._open.get(tag, 0) + 1
        self._in_links += tag == "a"

    def _end(self, tag: str) -> None:
        if not self._open.get(tag):
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            name = self._stack[depth][0]
            if name == tag:
                if any(made for _, _, made in self._stack[depth:]):
                    self._end_block()
                self._pop(depth)
                return
            if tag not in BLOCKS and name in BLOCKS:
                return  # an inline end tag doesn't close blocks

    def _read(self, html: str) -> None:
        at, size, absent = 0, len(html), set()
        while at < size:
            mark = html.find("<", at)
            if mark < 0:
                self._text(html[at:])
                return
            if mark > at:
                self._text(html[at:mark])
            m = _TAG.match(html, mark)
            if m:
                at = m.end()
                closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
                tag = tag.lower()
                if closing:
                    self._end(tag)
                elif tag in RAW:
                    if not attributes.endswith("/"):
                        # No end tag was found from an earlier place: there is none from here on.
                        found = None if tag in absent else _RAW_END[tag].search(html, at)
                        if not found:
                            absent.add(tag)
                        end = html.find(">", found.start()) if found else -1
                        at = end + 1 if end >= 0 else size
                else:
                    self._start(tag, attributes)
            elif html.startswith("<!--", mark):
                end = html.find("-->", mark + 4)
                at = end + 3 if end >= 0 else size
            elif html.startswith(("<!", "<?", "</"), mark):
                end = html.find(">", mark)
                at = end + 1 if end >= 0 else size
            else:
                self._text("<")
                at = mark + 1


def _gain(words: str, linked: int) -> float:
    size = len(words)
    return ((size >= 25) + words.count(",") + min(size / 100, 3) + size / 1000) * (1 - linked / size)


def _left_out(tree: _Tree) -> list[bool]:
    """Which elements are left out, after marks are lifted from what holds the article."""
    n, mark = len(tree.tag), tree.mark
    if not any(mark):
        return [False] * n
    own = [0.0] * n
    for node, words, linked in tree.blocks:
        own[node] += _gain(words, linked)
    # Points inside each element without the marked parts in it, and with them, as far as they may
    # be wrappers; most points of an article or main inside.
    plain, whole, article = list(own), list(own), [0.0] * n
    for node in range(n - 1, 0, -1):
        up, kind = tree.parent[node], mark[node]
        if tree.tag[node] in ("article", "main"):
            article[node] = max(article[node], whole[node])
        if kind == NOT_MARKED:
            plain[up] += plain[node]
        if kind <= WRAPPER:
            whole[up] += whole[node]
        if kind <= PART:
            article[up] = max(article[up], article[node])
    rest = plain[0]
    shut, has_article, comments = [False] * n, False, 0.0
    for node in range(1, n):
        if not shut[tree.parent[node]]:
            comments += whole[node] * (mark[node] == COMMENT)
            has_article |= not mark[node] and tree.tag[node] in ("article", "main")
        shut[node] = shut[tree.parent[node]] or bool(mark[node])
    # Outer elements come first: what is lifted joins the rest that inner ones are held against.
    out = [False] * n
    for node in range(1, n):
        kind = mark[node]
        out[node] = out[tree.parent[node]]
        if kind == NOT_MARKED or out[node]:
            continue
        if kind == WRAPPER:
            lift = whole[node] >= max(LEAST_POINTS, TIMES_REST * rest, whole[0] / 2)
        else:
            lift = kind == COMMENT and tree.tag[node] in ("article", "main") and not has_article \
                and whole[node] > max(LEAST_POINTS, rest + comments - whole[node])
        if lift or kind <= PART and article[node] > max(LEAST_POINTS, rest):
            rest += plain[node]
        else:
            out[node] = True
    return out


def main_text(html: str) -> str:
    tree = _Tree(html)
    out = _left_out(tree)
    blocks = [b for b in tree.blocks if not out[b[0]]]
    n = len(tree.tag)
    points, text, links = [0.0] * n, [0] * n, [0] * n
    for node, words, linked in blocks:
        gain = _gain(words, linked)
        # An element that is itself a paragraph passes its points on; a container keeps them.
        at = tree.parent[node] if tree.tag[node] in ("p", "pre", "li", "td", "blockquote") or _HEADING.match(tree.tag[node]) else node
        for share in (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12):
            points[at] += gain * share
            if not at:
                break
            at = tree.parent[at]
    for node, words, linked in blocks:
        text[node] += len(words)
        links[node] += linked
    for node in range(n - 1, 0, -1):
        text[tree.parent[node]] += text[node]
        links[tree.parent[node]] += links[node]
    score = [p * (1 - k / t) if t else -1.0 for p, t, k in zip(points, text, links, strict=True)]
    alive = [i for i in range(n) if text[i]]
    if not alive:
        return ""
    best = max(alive, key=lambda i: (score[i], -i))
    for outer in ("article", "main"):
        at = best
        while at and tree.tag[at] != outer:
            at = tree.parent[at]
        if at:
            best = at
            break
    kept = {best}
    if best:
        for other in range(1, n):
            if tree.parent[other] == tree.parent[best] and other != best and text[other]:
                dense = links[other] / text[other]
                paragraph = tree.tag[other] == "p" and (dense < 0.25 if text[other] > 80 else not dense)
                if score[other] >= max(10.0, 0.2 * score[best]) or paragraph or tree.tag[other] in ("h1", "h2"):
                    kept.add(other)
    inside, in_article = [False] * n, [False] * n
    for node in range(n):
        in_article[node] = tree.tag[node] in ("article", "main") or bool(node) and in_article[tree.parent[node]]
        listed = not in_article[node] and tree.tag[node] in ("ul", "ol") and text[node] and links[node] > 0.66 * text[node]
        inside[node] = (node in kept or bool(node) and inside[tree.parent[node]]) and not listed
    return "\n\n".join(words for node, words, _ in blocks if inside[node])


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch, "html"):
            texts = [main_text(x or "") for x in rows.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    run: Callable = _extractor
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
