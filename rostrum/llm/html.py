"""Main text of web pages by composite text density.

Each page becomes a tree. A node's density is its characters for each tag below it, lessened where much of it is link text
(the ratio of characters to link characters and of tags to link tags enters as a logarithm, whose base grows with the share of
links in the node and in the whole body). A node's density sum adds up its children's densities; the node with the greatest
sum holds the article. The least density on the path from the body to the densest node is the threshold: as long as
the parent of the chosen node reaches it by its own direct children, the choice moves up.

The choice is made over all that a page shows, menus and adverts included; only what shows no text (head, scripts, styles, hidden
elements) is left out. Where it lies in what the page marks as its article (article, main), all of that is taken, so that a short
title isn't cut off. Inside the choice, elements that are none of an article's (menus, headers, footers, sidebars, forms, notices,
adverts, comments) go by their tags and by the words of their class, id and role. A choice that lies in such an element, or loses
a fifth of its text to them, held part of the frame: density then chooses once more from what is left.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_column

# Names of the HTML standard, and words that pages use for what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe noscript".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul br".split())
INLINE_FORMAT = frozenset("a b big code em font i nobr s small span strike strong tt u abbr cite mark q sub sup".split())
CLOSES_P = BLOCK - {"br", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPE = frozenset("html body table ul ol dl select div article section main td th".split())
P_SCOPE = frozenset("html body table td th caption button object template".split())
SILENT = frozenset("head script style noscript iframe svg canvas template object embed audio video map title".split())
DROPPED = frozenset("nav footer aside form button select textarea input dialog menu label fieldset".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
DROPPED_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar side rail widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer foot masthead topbar toolbar comment comments disqus reply replies respond share sharing social related recommended newsletter subscribe signup login search tags skip".split())

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)""", re.S)
NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[A-Za-z]+")
#: A class name with one of these speaks of a page's state or layout, not of what the element is: no-sidebar, comments-open.
STATES = frozenset("no not has have with without is open opened closed enabled disabled show hide on off allow allowed".split())
REMARKS = frozenset("comment comments disqus reply replies respond".split())
#: The share of a page's characters outside links above which an element is its wrapper, whatever its name.
MOST = 0.5
#: The density, as a share of the chosen article's, from which its sibling articles are taken too.
LIKE = 0.5
#: The share of the chosen element's characters from which a marked article inside it is taken for the whole.
MARKED = 0.2
#: The share of the choice's characters that are left without unwanted elements, below which density chooses once more.
LEFT = 0.8
KEEP, MAYBE, REMARK, DROP, UNSEEN = range(5)


def unwanted(tag: str, attributes: str, in_article: bool) -> int:
    """UNSEEN for an element that shows no text; DROP for one that is none of the article's; MAYBE if that is so by form, role, class
    or id alone, which wrappers of the article may have too; REMARK likewise for comments."""
    if tag in SILENT:
        return UNSEEN
    form = tag in ("form", "fieldset")
    out = DROP if tag in DROPPED and not form or tag == "header" and not in_article else MAYBE if form else KEEP
    if not attributes or tag in ("html", "body", "article", "main") and not re.search("comment|repl", attributes, re.I):
        return out
    for m in NAMED.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return UNSEEN
        if name == "role" and value in DROPPED_ROLES:
            out = max(out, MAYBE)
        for parts in map(WORDS.findall, value.split() if name in ("class", "id") else ()):
            if not DROPPED_WORDS.isdisjoint(parts) and STATES.isdisjoint(parts):
                out = max(out, MAYBE if REMARKS.isdisjoint(parts) else REMARK)
    return out


class Page:
    """A page's tree in document order: tags, parents, and the texts with their nodes; None for a text marks a block's edge."""

    def __init__(self, source: str):
        self.tags, self.parents, self.kept, self.texts, self.doubts = ["#root"], [-1], [True], [], [KEEP]
        self.stack = [0]
        self.open: dict[str, list[int]] = {"#block": []}  # depths in the stack at which a tag is open, so that no search walks it
        within, clear = [False], [True]  # whether a node is in an article, and in no element that is surely none of its
        at, n = 0, len(source)
        while at < n:
            m = TOKEN.search(source, at)
            if not m or m.start() > at:
                self.texts.append((self.stack[-1], source[at : m.start() if m else n]))
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if tag in BLOCK:
                self.texts.append((self.stack[-1], None))
            if m[1]:
                self.close(tag)
                continue
            if tag in CLOSES_P:
                self.pop(("p",), P_SCOPE)
            if tag in SIBLINGS:
                self.pop(SIBLINGS[tag], SCOPE - set(SIBLINGS[tag]))
            up = self.stack[-1]
            self.tags.append(tag)
            self.parents.append(up)
            within.append(within[up] or tag in ("article", "main"))
            self.doubts.append(unwanted(tag, m[3], clear[up] and within[up]))
            clear.append(clear[up] and self.doubts[-1] < DROP)
            self.kept.append(self.kept[up] and self.doubts[-1] != UNSEEN)
            if tag in RAW and not m[3].endswith("/"):
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
                at = end.start() if end else n
                self.push(tag)
            elif tag not in VOID:
                self.push(tag)

    def push(self, tag: str) -> None:
        for name in (tag, "#block") if tag in BLOCK else (tag,):
            self.open.setdefault(name, []).append(len(self.stack))
        self.stack.append(len(self.tags) - 1)

    def cut(self, depth: int) -> None:
        """Closes what is open from this depth on."""
        for k in self.stack[depth:]:
            tag = self.tags[k]
            self.open[tag].pop()
            if tag in BLOCK:
                self.open["#block"].pop()
        del self.stack[depth:]

    def innermost(self, tags) -> int:
        """The depth of the innermost open element of these tags, 0 if there is none."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def settle(self) -> None:
        """Takes unwanted elements out; of doubtful ones those stay that hold most of the page, or the article where there is none elsewhere."""
        n = len(self.tags)
        if not any(self.kept[k] and self.doubts[k] for k in range(n)):
            return
        for k in range(1, n):
            self.kept[k] = self.kept[k] and self.kept[self.parents[k]] and self.doubts[k] != DROP
        chars, in_link, clear, holds = [0] * n, [False] * n, [True] * n, [False] * n
        for k in range(1, n):
            in_link[k] = in_link[self.parents[k]] or self.tags[k] == "a"
            clear[k] = clear[self.parents[k]] and not self.doubts[k]
        for k, t in self.texts:
            if t and self.kept[k] and not in_link[k]:
                chars[k] += len(t) - t.count(" ") - t.count("\n")
        marked = [k for k in range(n) if self.kept[k] and not self.doubts[k] and self.tags[k] in ("article", "main")]
        alone = not any(clear[k] for k in marked)
        for k in marked:
            holds[k] = alone
        for k in range(n - 1, 0, -1):
            chars[self.parents[k]] += chars[k]
            holds[self.parents[k]] |= holds[k]
        for k in range(1, n):
            out = self.doubts[k] and not holds[k] and (self.doubts[k] == REMARK or chars[k] <= MOST * chars[0])
            self.kept[k] = self.kept[k] and self.kept[self.parents[k]] and not out

    def pop(self, tags: tuple[str, ...], scope: frozenset) -> None:
        """Closes the innermost open element of these tags, unless an element of the scope is open inside it."""
        depth = self.innermost(tags)
        if depth and depth >= self.innermost(scope):
            self.cut(depth)

    def close(self, tag: str) -> None:
        """An end tag: closes down to its element; one that is open nowhere, or lies beyond a block if it is inline, does nothing."""
        depth = self.innermost((tag,))
        if depth and (tag not in INLINE_FORMAT or depth > self.innermost(("#block",))):
            self.cut(depth)

    def main_text(self) -> str:
        """The article's text: blocks in page order, white space as one space."""
        tops = self.choose()
        shown = self.below(tops)
        self.settle()
        inside = self.below(tops)
        size = lambda nodes: sum(len(t) - t.count(" ") - t.count("\n") for k, t in self.texts if t and nodes[k])
        if shown != inside and size(inside) < LEFT * size(shown):
            inside = self.below(self.choose())
        return " ".join("".join(" " if t is None else html.unescape(t) for k, t in self.texts if t is None or inside[k]).split())

    def below(self, tops: set[int]) -> list[bool]:
        """Whether a node is kept and one of these or below one."""
        inside = [False] * len(self.tags)
        for k in range(len(self.tags)):
            inside[k] = self.kept[k] and (k in tops or self.parents[k] >= 0 and inside[self.parents[k]])
        return inside

    def choose(self) -> set[int]:
        """The nodes that hold the article: one, or sibling articles of like density."""
        n = len(self.tags)
        chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link, scope = [False] * n, [False] * n
        marked = [k for k in range(n) if self.kept[k] and self.tags[k] in ("article", "main")]
        for k in range(1, n):
            up = self.parents[k]
            in_link[k] = in_link[up] or self.tags[k] == "a"
            scope[k] = scope[up] or self.tags[k] in ("article", "main")
        for k, t in self.texts:
            if t and self.kept[k]:
                size = len(t) - t.count(" ") - t.count("\n")
                chars[k] += size
                links[k] += size * in_link[k]
        for k in range(n - 1, 0, -1):  # children come after their parents
            up = self.parents[k]
            if self.kept[k]:
                chars[up] += chars[k]
                links[up] += links[k]
                tags[up] += tags[k] + 1
                link_tags[up] += link_tags[k] + (self.tags[k] == "a")
        body = self.tags.index("body") if "body" in self.tags else 0
        share = links[body] / max(1, chars[body])
        density, sums = [0.0] * n, [0.0] * n
        for k in range(n):
            if chars[k] and self.kept[k]:
                c, lc, t, lt = chars[k], max(1, links[k]), max(1, tags[k]), max(1, link_tags[k])
                base = math.log(c / max(1, c - links[k]) * links[k] + share * c + math.e)
                density[k] = max(0.0, c / t * (math.log(max(1.0, c / lc * t / lt)) / math.log(base) if base > 1 + 1e-9 else math.log(max(1.0, c / lc * t / lt) + 1)))
                if self.parents[k] >= 0:
                    sums[self.parents[k]] += density[k]
        in_body = [body == 0] * n
        for k in range(1, n):
            in_body[k] = in_body[k] or k == body or in_body[self.parents[k]]
        among = [k for k in range(n) if self.kept[k] and in_body[k]]
        if not among:
            return {body}
        leaf = max(among, key=lambda k: (density[k], -k))
        path, k = [], leaf
        while k >= 0:
            path.append(density[k])
            k = self.parents[k] if k != body else -1
        threshold = min(path)
        chosen = max(among, key=lambda k: (max(sums[k], density[k] if k == leaf else 0.0), -k))
        while chosen != body and self.parents[chosen] > 0 and density[self.parents[chosen]] >= threshold and chars[self.parents[chosen]] > chars[chosen] and self.parents[chosen] != body:
            chosen = self.parents[chosen]
        return self.widened(chosen, marked, scope, density, chars)

    def widened(self, chosen: int, marked: list[int], scope: list[bool], density: list[float], chars: list[int]) -> set[int]:
        """The choice of density, held against what the page marks as article: a choice in an article becomes all of it and of its
        siblings of like density; one around articles becomes the largest of these if it holds a fair share of the choice; others stay."""
        if not scope[chosen] or not marked:
            inside = [False] * len(self.tags)
            for k in range(chosen, len(self.tags)):
                inside[k] = k == chosen or self.parents[k] >= chosen and inside[self.parents[k]]
            largest = max((k for k in marked if inside[k]), key=lambda k: (chars[k], -k), default=None)
            if largest is None or chars[largest] < MARKED * chars[chosen]:
                return {chosen}
            chosen = largest
        while self.tags[chosen] not in ("article", "main") or self.parents[chosen] >= 0 and scope[self.parents[chosen]]:
            chosen = self.parents[chosen]
        alike = (k for k in marked if self.tags[k] == self.tags[chosen] and self.parents[k] == self.parents[chosen])
        return {chosen, *(k for k in alike if density[k] >= LIKE * density[chosen])}


def main_text(page="html"):
    """A string column: the main text of a column of whole pages; empty for null or where there is none."""

    def make():
        return lambda pages: [[Page(p).main_text() if p else "" for p in pages]]

    return text_column(make, "text string")(page)["text"]


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages. Null or empty pages give empty text; repeated rows are taken alike; of
    nodes with equal sums the first is taken; long pages are read whole; broken markup is read as far as it goes; an empty table
    gives no rows; other columns are left out."""
    return pages.select("page_id", "url", main_text(pages["html"]).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
