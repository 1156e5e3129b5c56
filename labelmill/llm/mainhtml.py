"""Main text of web pages by composite text density.

A page is read into a tree that forgives what real pages do: tags that end by themselves, end tags that
match nothing, a page that stops anywhere. Parts that are never the article go: what their tag, role,
name or style marks as menu, header, footer, sidebar, notice, advert, form, code or reader comment.

Every node that is left has a density: its characters for each tag below it, weighed down by how
much of it is link text. A node's sum is that of its children and of its own text. The node with
the largest sum is the main one, and the least density between it and the body is the threshold:
of each subtree that reaches it on the way down, the node with the largest sum is kept whole. Where the
page names its article (``article`` or ``main``), those of them that hold or lie in such a node
are taken whole, so that short paragraphs and lists of the article stay.

Work and memory grow with the page's length; nothing is recursive, so depth doesn't matter.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements by what a parser has to know of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("iframe noembed noframes script style textarea title xmp".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A new one of these ends an open one of the second list, unless one of the third was opened since.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    **dict.fromkeys(("dd", "dt"), (("dd", "dt"), ("dl",))),
    "tr": (("tr",), ("table",)),
    **dict.fromkeys(("td", "th"), (("td", "th"), ("table", "tr"))),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (("thead", "tbody", "tfoot", "tr"), ("table",))),
    **dict.fromkeys(("option", "optgroup"), (("option",), ("select",))),
}
CLOSED_IN = ("td", "th", "caption", "table", "button", "object", "template")
TABLE_PARTS = frozenset("table tbody thead tfoot tr td th caption".split())

NEVER = frozenset("aside audio button canvas datalist dialog embed footer head iframe input menu nav noembed noframes noscript object script search select style svg template textarea title video xmp".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split())
#: Words in a class or id that mark a part as no article.
MARKS = frozenset(
    "ad ads adsbygoogle adsense advert advertisement advertising adverts alert announcement banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion "
    "disqus footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo "
    "promotion recommended related replies reply respond search share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: These say that a name speaks of something else, or of the article's own part where they come last.
NEGATED = frozenset("category has no tag topic type with without".split())
OWN = frozenset("article body content entry main post".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
_NAME = re.compile(r"[^\s/>]++")
_ATTRIBUTE = re.compile(r"""([^\s=/>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW_TEXT}


def _named(value: str, header_only: bool = False) -> bool:
    """Whether a class or id marks a part as no article."""
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if not words or NEGATED.intersection(words):
            continue
        found = MARKS.intersection(words)
        if not found or (OWN.intersection(words) and (words[-1] not in MARKS or words[-1] == "header")):
            continue
        if (found == {"header"}) == header_only:
            return True
    return False


class Page:
    """The tree of a page: for each node its tag, parent and mark, and all of it in order.

    ``order`` holds texts, i where node i begins and ~i where it ends.
    """

    def __init__(self, html: str) -> None:
        self.tags, self.parents, self.marks, self.order = ["html"], [-1], [""], [0]
        self._stack, self._at = [0], {"html": [0]}
        self._blocks = [0]
        self._read(html)
        while self._stack:
            self._pop()

    def _pop(self) -> None:
        node = self._stack.pop()
        tag = self.tags[node]
        self._at[tag].pop()
        if tag in BLOCK:
            self._blocks.pop()
        self.order.append(~node)

    def _place(self, *tags: str) -> int:
        return max((self._at[t][-1] for t in tags if self._at.get(t)), default=-1)

    def _end_to(self, place: int) -> None:
        while len(self._stack) > place:
            self._pop()

    def _text(self, text: str) -> None:
        if text:
            if self._at.get("head") and not text.isspace():
                self._end_to(self._place("head"))
            self.order.append(unescape(text) if "&" in text else text)

    def _start(self, tag: str, rest: str) -> None:
        if tag == "html" or (tag == "body" and self._at.get("body")):
            return
        if self._at.get("head") and tag not in IN_HEAD:
            self._end_to(self._place("head"))
        if tag in BLOCK and self._place("p") > self._place(*CLOSED_IN):
            self._end_to(self._place("p"))
        if tag in ENDS:
            ended, since = ENDS[tag]
            scope = self._place(*since)
            # The outermost of those open, so that a row group ends with its row.
            open_ones = [self._at[t][-1] for t in ended if self._at.get(t) and self._at[t][-1] > scope]
            if open_ones:
                self._end_to(min(open_ones))
        node = len(self.tags)
        self.tags.append(tag)
        self.parents.append(self._stack[-1])
        self.marks.append(self._mark(tag, rest))
        self.order.append(node)
        if tag in VOID or (rest.endswith("/") and (self._at.get("svg") or self._at.get("math"))):
            self.order.append(~node)
            return
        self._at.setdefault(tag, []).append(len(self._stack))
        if tag in BLOCK:
            self._blocks.append(len(self._stack))
        self._stack.append(node)

    def _end(self, tag: str) -> None:
        if tag in ("html", "body") or not self._at.get(tag):
            return
        place = self._at[tag][-1]
        if tag not in BLOCK:
            within = self._blocks[-1]
        else:
            within = -1 if tag in TABLE_PARTS else self._place(*(t for t in CLOSED_IN if t != tag))
        if place > within:
            self._end_to(place)

    @staticmethod
    def _mark(tag: str, rest: str) -> str:
        """``never`` goes in any case, ``part`` unless it holds the article, ``header`` unless it heads the article."""
        if tag in NEVER:
            return "never"
        mark = {"form": "part", "header": "header"}.get(tag, "")
        if not rest or tag in ("body", "html", "main"):
            return mark
        for name, *values in _ATTRIBUTE.findall(rest):
            name, value = name.lower(), "".join(values)
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
                return "never"
            if name == "role" and value.strip().lower() in ROLES:
                mark = "part"
            elif name in ("class", "id") and mark != "part":
                if tag == "article":
                    mark = "never" if MARKS.intersection(unescape(value).lower().split()) else mark
                elif _named(unescape(value)):
                    mark = "part"
                elif not mark and _named(unescape(value), header_only=True):
                    mark = "header"
        return mark

    def _read(self, html: str) -> None:
        at, text_from, n = 0, 0, len(html)
        while True:
            at = html.find("<", at)
            if at < 0 or at + 1 >= n:
                break
            c = html[at + 1]
            ends = c == "/"
            if c.isascii() and (c.isalpha() or (ends and html[at + 2 : at + 3].isascii() and html[at + 2 : at + 3].isalpha())):
                self._text(html[text_from:at])
                name = _NAME.match(html, at + 1 + ends)
                close = _REST.match(html, name.end())
                if not close:
                    text_from = n
                    break
                tag = name[0].lower()
                at = text_from = close.end()
                if ends:
                    self._end(tag)
                    continue
                self._start(tag, html[name.end() : at - 1])
                if tag in RAW_TEXT:
                    found = _RAW_END[tag].search(html, at)
                    at = text_from = found.start() if found else n
            elif c in "!?/":
                self._text(html[text_from:at])
                if html.startswith("<!--", at):
                    close = html.find("-->", at + 2)
                    size = 3
                else:
                    close, size = html.find(">", at + 1), 1
                at = text_from = close + size if close >= 0 else n
            else:
                at += 1
        self._text(html[text_from:])

    def dropped(self) -> list[bool]:
        """Which nodes are no part of the article, by what marks them or a node above them."""
        n = len(self.tags)
        holds, heads = [False] * n, [False] * n
        for i in range(n - 1, 0, -1):
            up = self.parents[i]
            holds[up] |= holds[i] or (self.tags[i] in ("article", "main") and self.marks[i] != "never")
            heads[up] |= heads[i] or self.tags[i] in HEADINGS
        out, inside = [False] * n, [False] * n
        for i in range(1, n):
            up, tag, mark = self.parents[i], self.tags[i], self.marks[i]
            inside[i] = inside[up] or tag in ("article", "main")
            goes = mark == "never" or (mark == "part" and not holds[i]) or (mark == "header" and not holds[i] and not (inside[up] and heads[i]))
            out[i] = out[up] or goes
        return out


def density(chars: int, tags: int, link_chars: int, links: int, page_chars: int, page_links: int) -> float:
    """Characters for each tag, adjusted for links: composite text density."""
    if not chars:
        return 0.0
    tags, links, link = max(tags, 1), max(links, 1), max(link_chars, 1)
    base = log(chars / max(chars - link_chars, 1) * link + max(page_links, 1) / page_chars * chars + e)
    return chars / tags * max(log(chars / link * tags / links), 0.0) / log(base)


def _chosen(page: Page, dropped: list[bool]) -> set[int]:
    """The nodes whose whole text, without what is dropped, is the article."""
    n = len(page.tags)
    tags, parents = page.tags, page.parents
    own, chars, count, link_chars, links = ([0] * n for _ in range(5))
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[parents[i]] or tags[i] == "a"
    stack = []
    for x in page.order:
        if isinstance(x, str):
            own[stack[-1]] += sum(map(len, x.split()))
        elif x >= 0:
            stack.append(x)
        else:
            stack.pop()
    for i in range(n - 1, -1, -1):
        if dropped[i]:
            continue
        chars[i] += own[i]
        link_chars[i] += own[i] if in_link[i] else 0
        if i:
            up = parents[i]
            chars[up] += chars[i]
            count[up] += count[i] + 1
            link_chars[up] += link_chars[i]
            links[up] += links[i] + (tags[i] == "a")
    if not chars[0]:
        return set()
    value = [0.0 if dropped[i] else density(chars[i], count[i], link_chars[i], links[i], chars[0], link_chars[0]) for i in range(n)]
    sums = [0.0 if dropped[i] or in_link[i] else density(own[i], 1, 0, 0, chars[0], link_chars[0]) for i in range(n)]
    for i in range(n - 1, 0, -1):
        sums[parents[i]] += value[i]
    # The best node of each subtree, the outermost of equals.
    best = list(range(n))
    for i in range(n - 1, 0, -1):
        up = parents[i]
        if not dropped[i] and (sums[best[i]] > sums[best[up]] or (sums[best[i]] == sums[best[up]] and best[up] != up and best[i] < best[up])):
            best[up] = best[i]
    main, threshold = best[0], value[best[0]]
    while main > 0 and tags[main] != "body":
        main = parents[main]
        if main:
            threshold = min(threshold, value[main])
    reached, found = [False] * n, set()
    for i in range(n):
        reached[i] = not dropped[i] and (i == 0 or tags[i] == "body" or (reached[parents[i]] and value[i] >= threshold > 0))
        if reached[i]:
            found.add(best[i])
    return _articles(page, dropped, found, sums, best)


def _articles(page: Page, dropped: list[bool], found: set[int], sums: list[float], best: list[int]) -> set[int]:
    """What was found, or the article elements that it stands for, if the page has some."""
    n, tags, parents = len(page.tags), page.tags, page.parents
    above = [-1] * n
    for kind in ("article", "main"):
        for i in range(1, n):
            above[i] = above[parents[i]] if above[parents[i]] >= 0 else (i if tags[i] == kind and not dropped[i] else -1)
        named = [i for i in range(1, n) if above[i] == i]
        if named:
            break
    titles = [i for i in range(1, n) if tags[i] == "h1" and not dropped[i]]
    if not named:
        return found | set(titles if len(titles) == 1 else [])
    holds = [i in found for i in range(n)]
    for i in range(n - 1, 0, -1):
        holds[parents[i]] |= holds[i]
    under = [i in found for i in range(n)]
    for i in range(1, n):
        under[i] |= under[parents[i]]
    # A node above several articles stands for all of them only if no article holds one itself.
    kept = {i for i in named if holds[i]} or {i for i in named if under[i]} or {max(named, key=lambda i: sums[best[i]])}
    within = [False] * n
    for i in range(1, n):
        within[i] = within[parents[i]] or tags[i] == "main"
    return kept | {i for i in titles if within[i] and above[i] < 0}


def main_text(html: str | None) -> str:
    """The article's blocks, one a line; empty if there is none."""
    if not html or html.isspace():
        return ""
    page = Page(html)
    dropped = page.dropped()
    chosen = _chosen(page, dropped)
    kept = [False] * len(page.tags)
    for i in range(len(kept)):
        kept[i] = not dropped[i] and (i in chosen or (i > 0 and kept[page.parents[i]]))
    blocks, run, stack = [], [], []

    def end_block():
        text = " ".join("".join(run).split())
        if text:
            blocks.append(text)
        run.clear()

    for x in page.order:
        if isinstance(x, str):
            if kept[stack[-1]]:
                run.append(x)
            continue
        node = x if x >= 0 else ~x
        if page.tags[node] in BLOCK:
            end_block()
        elif x >= 0 and page.tags[node] == "br" and kept[node]:
            run.append(" ")
        if x >= 0:
            stack.append(x)
        else:
            stack.pop()
    end_block()
    return "\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages.

    Null and empty html, and pages without an article, give an empty text. Rows that repeat a page_id,
    or have none, each give a row; an empty table stays empty; other columns play no part. A page of any length is
    read whole, by one task.
    """

    def work(batches):
        for batch in batches:
            texts = [main_text(html) for html in map(lambda x: x.as_py(), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(work, f"page_id {kind}, url string, text string, n_chars long")
