"""Main text of web pages by tree scoring.

Each paragraph earns points for its length and its commas, less the share of its text that is links,
and passes them up: all to its parent, half to the grandparent, and a falling share further up.  The
element with the most points, its own link density discounted, is the article; siblings with a good
part of its score, and plain paragraphs beside it, belong to it as well.  Parts that are never article
text by tag or role - menus, forms, adverts and the like - are left out of both, and so are those that
a class or id calls so, unless what they hold shows the name to be wrong (see `_wrong_parts`).  An article's
own header stays, and inside an article or main element only a box goes whose name says nothing else.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

# Elements by role in HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input".split())
_SKIP = frozenset("head script style noscript template iframe object svg canvas audio video nav header footer aside form button select textarea dialog menu title noembed noframes".split())
#: Of these, those that may stand inside a paragraph and don't end it.
_QUIET = frozenset("script style noscript template iframe object svg canvas audio video button select textarea".split())
_SAME_CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "p": ()}
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
# Words of class and id names.
_NOT_TEXT = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice notices pager pagination popup promo promotion promotions related recommended reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split())
_TEXT = frozenset("article body content entry main post story text".split())
#: Words that may stand beside them in the name of a box.
_BOX = frozenset("area block blocks body bottom box button buttons container content inner item items left link links list outer panel post posts right row section sections text top wrap wrapper".split())
#: In an article or main element, text of these tags doesn't go for its names.
_SPOKEN = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote q td th caption figcaption".split())
#: Of the former, those that may well hold most of a page's text and yet not be the article.
_OTHERS = frozenset("comment comments disqus recommended related replies reply respond".split())
#: Names that begin or end so tell of a state (has-sidebar, comments-off) or a kind of text (long-form).
_STATE_FIRST = frozenset("free has hide is long no non not with without".split())
_STATE_LAST = frozenset("closed disabled none off".split())
_WHOLE = ("body", "html", "article", "main")
_WORDS = re.compile(r"[a-z]+")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: Share of the best score from which a sibling belongs to the article.
SIBLING_SHARE = 0.2
#: A list or box of so many links, with at least this share of its text in them, is a menu, unless it
#: is a p or in an article or main element.
MENU_LINKS, MENU_SHARE = 3, 0.8
#: Elements deeper than this become siblings, as in browsers; levels up to which points are passed.
MAX_DEPTH, LEVELS = 512, 10


class _Page:
    """Elements as parallel lists, and the blocks of text in page order.  Elements in `drop` are
    left out for their names."""

    def __init__(self, drop: frozenset[int] = frozenset()) -> None:
        self.drop = drop
        self.parent, self.tag, self.skip, self.weight = [-1], ["#"], [False], [0.0]
        self.named: dict[int, tuple[set[str], bool]] = {}  # element: words of _NOT_TEXT, has it a name of _TEXT alone
        self.articles: set[int] = set()  # by tag or role
        self.inside = [False]  # is the element in one of those
        self.blocks: list[tuple[int, str, int, bool]] = []  # element, text, characters in links, is a p
        self.stack, self.links = [0], 0
        self.text: list[str] = []
        self.linked: list[str] = []

    def words(self, data: str) -> None:
        if data and not self.skip[self.stack[-1]]:
            self.text.append(data)
            if self.links:
                self.linked.append(data)

    def flush(self) -> None:
        if self.text:
            block = " ".join(unescape("".join(self.text)).split())
            if block:
                at = self.stack[-1]
                while self.tag[at] in _INLINE:
                    at = self.parent[at]
                linked = len(" ".join(unescape("".join(self.linked)).split())) if self.linked else 0
                self.blocks.append((at, block, linked, self.tag[at] == "p"))
            self.text, self.linked = [], []

    def open(self, tag: str, attrs: str) -> None:
        if tag not in _INLINE and tag not in _QUIET:
            self.flush()
            self.close_implied(tag)
        elif tag == "br":
            self.words(" ")
        if tag in _VOID:
            return
        e = len(self.tag)
        inside = self.inside[self.stack[-1]]
        own_header = tag == "header" and inside
        skip, weight, article = self.skip[self.stack[-1]] or tag in _SKIP and not own_header or e in self.drop, 25.0 if tag in ("article", "main") else 0.0, tag in ("article", "main")
        wrong, right = set(), False
        for m in _ATTR.finditer(attrs) if attrs and not skip else ():
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "role":
                skip |= value.strip() in _ROLES
                weight += 25 * (value.strip() in ("main", "article"))
                article |= value.strip() in ("main", "article")
                continue
            for name in value.split():
                words = _WORDS.findall(name)
                weight += 25 * sum(w in _TEXT for w in words)
                right |= bool(words) and _TEXT.issuperset(words)
                if not words or words[0] in _STATE_FIRST or words[-1] in _STATE_LAST:
                    continue
                if not inside:
                    wrong |= _NOT_TEXT.intersection(words)
                elif tag not in _SPOKEN and (_NOT_TEXT | _BOX).issuperset(words):
                    wrong |= _NOT_TEXT.intersection(words) - {"header"}
        if wrong and not skip:
            self.named[e] = wrong, right
            weight -= 25 * len(wrong) * (tag not in _WHOLE)
        if article and not skip:
            self.articles.add(e)
        if skip and not self.skip[self.stack[-1]] and tag not in _QUIET:
            self.words(" ")
            self.flush()
        if len(self.stack) > MAX_DEPTH:
            self.pop_to(len(self.stack) - 1)
        self.parent.append(self.stack[-1])
        self.tag.append(tag)
        self.skip.append(skip)
        self.weight.append(weight)
        self.inside.append(inside or article)
        self.stack.append(len(self.tag) - 1)
        self.links += tag == "a"

    def close_implied(self, tag: str) -> None:
        """An open p ends where a block begins; li, td and the like end where the next one begins."""
        if tag in _SAME_CLOSES and tag != "p":
            self.close_to({tag, {"dt": "dd", "dd": "dt", "td": "th", "th": "td"}.get(tag, tag)}, _SAME_CLOSES[tag])
        self.close_to({"p"}, ("table", "button", "object", "td", "th", "li", "div", "section", "article", "blockquote"))

    def close_to(self, tags: set[str], until: tuple[str, ...]) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            t = self.tag[self.stack[i]]
            if t in tags:
                self.pop_to(i)
                return
            if t in until:
                return

    def close(self, tag: str) -> None:
        if tag not in _INLINE and tag not in _QUIET:
            self.flush()
        for i in range(len(self.stack) - 1, 0, -1):
            t = self.tag[self.stack[i]]
            if t == tag:
                self.pop_to(i)
                return
            if tag in _INLINE and t not in _INLINE:
                return  # a stray end tag doesn't close blocks

    def pop_to(self, i: int) -> None:
        if any(self.skip[e] and not self.skip[self.parent[e]] and self.tag[e] not in _QUIET for e in self.stack[i:]):
            self.flush()
        for e in self.stack[i:]:
            self.links -= self.tag[e] == "a"
        del self.stack[i:]


def _parsed(html: str, drop: frozenset[int] = frozenset()) -> _Page:
    page, at, n = _Page(drop), 0, len(html)
    lower, no_end = html.lower() if html.isascii() else None, set()
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            page.words(html[at:])
            break
        page.words(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4) if "-->" not in no_end else -1
            if end < 0:
                no_end.add("-->")
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                at = end + 3
            continue
        name = _NAME.match(html, lt + 1 + html.startswith("/", lt + 1))
        if not name and not html.startswith(("<!", "<?", "</"), lt):
            page.words("<")
            at = lt + 1
            continue
        gt = html.find(">", lt)
        if gt < 0:
            break  # the page was cut inside a tag
        for quote in "\"'":
            # A > inside a quoted value doesn't end the tag.
            if quote not in no_end and html.count(quote, lt, gt) % 2 and (html.count("'" if quote == '"' else '"', lt, gt) % 2 == 0):
                q = html.find(quote, gt)
                if q < 0:
                    no_end.add(quote)
                elif "<" not in html[gt:q] and (g := html.find(">", q)) >= 0:
                    gt = g
        at = gt + 1
        if not name:
            continue
        tag = name[0].lower()
        if html[lt + 1] == "/":
            page.close(tag)
            continue
        page.open(tag, html[name.end() : gt])
        if tag in _RAW and html[gt - 1] != "/":
            m = None
            if tag not in no_end:
                if lower is not None:
                    end = lower.find(f"</{tag}", at)
                else:
                    m = re.compile(f"</{tag}", re.I).search(html, at)
                    end = m.start() if m else -1
                if end < 0:
                    no_end.add(tag)
            else:
                end = -1
            at = n if end < 0 else end
    page.flush()
    return page


def _wrong_parts(page: _Page) -> frozenset[int]:
    """Of a page without drops, the elements whose names are right in calling them no article text.

    A name is wrong if another name of the element is one of text alone; if most of what the page has
    in article and main elements is in the element; or if most of the page's unlinked text is.  The
    last doesn't hold for comments and the like, nor do these count in the page's text."""
    n = len(page.tag)
    inside, gone = [False] * n, [False] * n
    for e in range(1, n):
        inside[e] = inside[page.parent[e]] or (e in page.articles and e not in page.named)
    drop: set[int] = set()
    for others in (True, False):
        text, marked = [0] * n, [0] * n
        for at, block, linked, _ in page.blocks:
            if not gone[at]:
                text[at] += len(block) - linked
                marked[at] += (len(block) - linked) * inside[at]
        for e in range(n - 1, 0, -1):
            text[page.parent[e]] += text[e]
            marked[page.parent[e]] += marked[e]
        for e in range(1, n):
            gone[e] |= gone[page.parent[e]]
            words, right = page.named.get(e, (frozenset(), True))
            if gone[e] or right or page.tag[e] in _WHOLE or others == _OTHERS.isdisjoint(words):
                continue
            if 2 * marked[e] <= marked[0] and (others or 2 * text[e] <= text[0]):
                drop.add(e)
                gone[e] = True
    return frozenset(drop)


def extract(html: str) -> str:
    """The article's blocks, joined by line ends; empty if there is none.  If nothing is left without
    the parts that their names call no text, these are the page's text."""
    page = _parsed(html or "")
    drop = _wrong_parts(page) if page.named else frozenset()
    return (_article(_parsed(html, drop)) if drop else "") or _article(page)


def _article(page: _Page) -> str:
    if not page.blocks:
        return ""
    score: dict[int, float] = defaultdict(float)
    n = len(page.tag)
    chars, linked, links = [0] * n, [0] * n, [int(t == "a") for t in page.tag]
    for at, text, in_links, _ in page.blocks:
        chars[at] += len(text)
        linked[at] += in_links
    for e in range(n - 1, 0, -1):
        for total in (chars, linked, links):
            total[page.parent[e]] += total[e]
    for at, text, in_links, is_p in page.blocks:
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - min(1, in_links / len(text)))
        up, level = page.parent[at] if is_p else at, 0
        while up >= 0 and level < LEVELS:
            score[up] += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = page.parent[up], level + 1
    final = {e: (s + page.weight[e]) * (1 - linked[e] / max(1, chars[e])) for e, s in score.items()}
    best = max(final, key=lambda e: (final[e], -e))
    if final[best] <= 0:
        return ""
    top = up = best
    while up > 0:  # an article's own sections are parts of it
        if page.tag[up] in ("article", "main"):
            top = up
        up = page.parent[up]
    kept = {top}
    if page.tag[top] not in ("article", "main", "body", "html", "#"):
        least = max(10.0, SIBLING_SHARE * final[best])
        for e in range(1, len(page.tag)):
            if page.parent[e] != page.parent[top] or not chars[e]:
                continue
            density = linked[e] / chars[e]
            plain = page.tag[e] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "blockquote", "pre", "table") and density < 0.25
            if final.get(e, 0) >= least or plain:
                kept.add(e)
    inside: dict[int, bool] = {}
    out = []
    for at, text, _, _ in page.blocks:
        if at not in inside:
            up, menu, article = at, False, False
            while up > 0 and up not in kept:
                menu |= page.tag[up] != "p" and links[up] >= MENU_LINKS and linked[up] >= MENU_SHARE * chars[up]
                article |= up in page.articles
                up = page.parent[up]
            inside[at] = up in kept and (not menu or article or up in page.articles)
        if inside[at]:
            out.append(text)
    return "\n".join(out)


def _extracted(batches):
    for batch in batches:
        found = [extract(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row for each input row.  Null and blank pages have empty
    texts; repeated rows get equal results; an empty table gives an empty result; other columns are
    ignored."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    out = rows.mapInArrow(bounded(_extracted), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
