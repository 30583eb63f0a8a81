"""Main text of web pages by composite text density.

A page is read once into a tree.  Every node counts its characters, its tags, and
the same inside links.  Its density is characters per tag, taken down by the share
of links:

    C / T * log_base((C / LC) * (T / LT)),
    base = ln(C / (C - LC) * LC + LC_body / C_body * C + e)

with C, LC characters and T, LT tags of the node, all of them and those of links.
The densities of a node's children are summed; the container with the largest sum
holds the article.  The least density on the path from the body to it is the
threshold at which other parts beside that path belong to the article too; a part
that is no paragraph and small against the container does not, as its few characters
without a tag look dense.  An ``article`` or ``main`` element around the container is
taken as a whole, with other articles of the page that reach the threshold.  Lists that
are all links are left out of a container that no such element names.

Parts that are never article (menus, headers and footers of the page, sidebars,
notices, adverts, forms, scripts, comments) are told by tag, role and class before
densities are counted.  A class or id counts as a whole or as a compound of names of
parts and places, and a name alone never drops what holds most of the page's text.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from webloom.llm.common import append

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Element names of HTML and usual names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object canvas textarea select title".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul center caption".split()
)
CONTAINER = frozenset("article body blockquote center dd details div figure html main ol section table tbody td tr ul dl pre".split())
BOILERPLATE = frozenset("head nav footer aside form menu dialog button script style noscript template svg iframe object canvas textarea select title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer header masthead comment comments commentlist disqus respond replies cookie cookies "
    "consent gdpr notice notices alert newsletter subscribe signup share sharing social related recommended popup modal login "
    "search pagination pager toolbar topbar skip".split()
)
#: Beside words of ``PARTS`` in a compound name of a page part ("site-footer"); others,
#: as in "has-sidebar" or "related-work", say something else.
PLACES = frozenset("site page main global primary secondary top bottom left right header list box bar wrap wrapper section block area widget links form inner".split())
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = HEADINGS | frozenset("p pre blockquote figure table dl".split())
LISTING = frozenset("ul ol menu dl div section td".split())
#: A part beside the container has this share of its characters at least; a list of so
#: many links and nothing else is a menu.
LEAST_PART, LINKS_OF_A_MENU = 1 / 5, 3
#: A part named so stays if it holds more than this share of the page's unlinked text.
LARGE_SHARE, LARGE_COMMENTS = 1 / 2, 9 / 10
#: Why an element is dropped: by tag, role or hiding; by name; by name as comments.
_STAYS, _NEVER, _NAMED, _COMMENT = range(4)
#: An open element of the values ends where one of the keys begins.
ENDS = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
_LIST = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"])}
_TABLE = frozenset(["table"])


def _end_of(source: str, at: int, name: str) -> int:
    """Where an element of raw text ends that is open at ``at``; drawings may hold others."""
    depth = 1
    for tag in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])([^>]*)>", re.IGNORECASE).finditer(source, at):
        if tag[1]:
            depth -= 1
            if not depth:
                return tag.end()
        elif name == "svg" and not tag[2].rstrip().endswith("/"):
            depth += 1
    return len(source)


class Page:
    """The tree of a page in arrays; a child always comes after its parent."""

    def __init__(self, source: str):
        self.tag, self.parent, self.reason = ["#root"], [-1], [_STAYS]
        self.inside_link, self.in_article = [False], [False]
        #: (node, text or None for the edge of a block), in page order.
        self.flow: list[tuple[int, str | None]] = []
        self._read(source)
        self.skipped = self._skip()

    def _read(self, source: str) -> None:
        stack, at, size = [0], 0, len(source)
        while at < size:
            found = _TAG.search(source, at)
            if not found:
                self._text(stack[-1], source[at:])
                return
            if found.start() > at:
                self._text(stack[-1], source[at : found.start()])
            at = found.end()
            name = found[2] or found[5]
            if not name:
                continue
            name = name.lower()
            if found[1] or found[4]:
                self._close(stack, name)
            else:
                self._open(stack, name, found[3] or found[6] or "")
                if name in RAW and stack[-1] and self.tag[stack[-1]] == name:
                    at = _end_of(source, at, name)
                    self._close(stack, name)

    def _text(self, node: int, raw: str) -> None:
        self.flow.append((node, html.unescape(raw) if "&" in raw else raw))

    def _open(self, stack: list[int], name: str, attributes: str) -> None:
        if name == "body" or name == "html":
            known = next((n for n in stack if self.tag[n] == name), None)
            if known is not None:
                return
        if name in BLOCK:
            self._close_paragraph(stack)
        if name in ENDS:
            self._close_until(stack, ENDS[name], _LIST.get(name, _TABLE))
        if name in BLOCK:
            self.flow.append((stack[-1], None))
        if name == "br":
            self.flow.append((stack[-1], " "))
        if name in VOID:
            return
        node, parent = len(self.tag), stack[-1]
        self.tag.append(name)
        self.parent.append(parent)
        self.reason.append(self._reason(name, attributes, self.in_article[parent]))
        self.in_article.append(self.in_article[parent] or name in ("article", "main"))
        self.inside_link.append(self.inside_link[parent] or name == "a")
        if attributes.rstrip().endswith("/") and name not in BLOCK and (name not in RAW or name == "svg"):
            return
        stack.append(node)

    def _reason(self, name: str, attributes: str, in_article: bool) -> int:
        if name in BOILERPLATE:
            return _NEVER
        if name == "header" and not in_article:
            return _NEVER
        if not attributes.strip() or name in ("html", "body", "main"):
            return _STAYS
        given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").replace(" ", "").lower():
            return _NEVER
        if given.get("role", "").lower() in ROLES:
            return _NEVER
        names = given.get("class", "").lower().split()
        if name not in HEADINGS and name not in ("article", "section"):  # there an id is an anchor
            names += given.get("id", "").lower().split()
        known: set[str] = set()
        for given_name in names:
            words = set(re.findall("[a-z]+", given_name))
            if words & PARTS and words <= PARTS | PLACES:
                known |= words & PARTS
        if name in HEADINGS or name in ("article", "p"):
            known &= {"comment", "comments", "ad", "ads", "advert"}
        return (_COMMENT if known & COMMENTS else _NAMED) if known else _STAYS

    def _skip(self) -> list[bool]:
        """The nodes that are dropped with all in them."""
        size = len(self.tag)
        never, unlinked = [False] * size, [0] * size
        for node in range(1, size):
            never[node] = never[self.parent[node]] or self.reason[node] == _NEVER
        for node, text in self.flow:
            if text and not never[node] and not self.inside_link[node]:
                unlinked[node] += len("".join(text.split()))
        for node in range(size - 1, 0, -1):
            unlinked[self.parent[node]] += unlinked[node]
        skipped = [False] * size
        named = [False] * size  # itself or around it
        for node in range(1, size):
            named[node] = named[self.parent[node]] or self.reason[node] > _NEVER
        # An article that no name drops is the text of the page, however short, against parts beside it.
        told = any(unlinked[n] and not named[n] and not never[n] and self.tag[n] in ("article", "main") and not self._all_named(n, unlinked, never) for n in range(1, size))
        least = {_NAMED: LARGE_SHARE * unlinked[0], _COMMENT: LARGE_COMMENTS * unlinked[0]}
        for node in range(1, size):
            reason = self.reason[node]
            skipped[node] = skipped[self.parent[node]] or never[node] or reason in least and (unlinked[node] <= least[reason] or told and not self.in_article[self.parent[node]])
        return skipped

    def _all_named(self, top: int, unlinked: list[int], never: list[bool]) -> bool:
        """No unlinked text of ``top`` is outside parts that a name drops."""
        rest = unlinked[top]
        covered = {top: False}
        for node in range(top + 1, len(self.tag)):
            up = covered.get(self.parent[node])
            if up is None:
                continue
            covered[node] = up or (self.reason[node] > _NEVER)
            if covered[node] and not up and not never[node]:
                rest -= unlinked[node]
        return rest <= 0

    def _close_paragraph(self, stack: list[int]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag == "p":
                del stack[k:]
                self.flow.append((stack[-1], None))
                return
            if tag in BLOCK:
                return

    def _close_until(self, stack: list[int], ends: frozenset[str], scope: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in ends:
                del stack[k:]
                self.flow.append((stack[-1], None))
                return
            if tag in scope:
                return

    def _close(self, stack: list[int], name: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag == name:
                del stack[k:]
                if name in BLOCK or name in RAW:
                    self.flow.append((stack[-1], None))
                return
            if name not in BLOCK and tag in BLOCK:  # a stray end of an inline element
                return

    # -- densities ----------------------------------------------------------

    def measures(self) -> tuple[list[int], list[int], list[int], list[int]]:
        """Characters, tags, link characters and link tags of every subtree."""
        size = len(self.tag)
        chars, tags, link_chars, link_tags = ([0] * size for _ in range(4))
        for node, text in self.flow:
            if text and not self.skipped[node]:
                n = len("".join(text.split()))
                chars[node] += n
                link_chars[node] += n * self.inside_link[node]
        for node in range(size - 1, 0, -1):
            if self.skipped[node]:
                continue
            up = self.parent[node]
            chars[up] += chars[node]
            link_chars[up] += link_chars[node]
            tags[up] += tags[node] + 1
            link_tags[up] += link_tags[node] + (self.tag[node] == "a")
        return chars, tags, link_chars, link_tags

    def densities(self) -> list[float]:
        chars, tags, link_chars, link_tags = self.measures()
        body = self.tag.index("body") if "body" in self.tag else 0
        body_share = link_chars[body] / max(chars[body], 1)
        found = [0.0] * len(self.tag)
        for node, c in enumerate(chars):
            if c and not self.skipped[node]:
                t, lc, lt = max(tags[node], 1), link_chars[node], link_tags[node]
                if not link_chars[body] and not lc:  # a page without links: the plain density
                    found[node] = c / t
                    continue
                base = math.log(c / max(c - lc, 1) * lc + body_share * c + math.e)
                ratio = c / max(lc, 1) * (t / max(lt, 1))
                found[node] = c / t * math.log(max(ratio, 1.0)) / math.log(base)
        return found

    def main_nodes(self) -> list[int]:
        """The roots of the article's subtrees."""
        density = self.densities()
        sums = [0.0] * len(density)
        for node in range(len(density) - 1, 0, -1):
            sums[self.parent[node]] += density[node]
        body = self.tag.index("body") if "body" in self.tag else 0
        held = [n for n in range(len(sums)) if not self.skipped[n] and (self.tag[n] in CONTAINER or n == 0)]
        best = max(held, key=lambda n: (sums[n], -n))
        if not sums[best]:
            return [body]
        path, whole = [best], None
        while path[-1] > 0 and path[-1] != body:
            if self.tag[path[-1]] in ("article", "main"):
                whole = path[-1]
            path.append(self.parent[path[-1]])
        threshold = min((density[n] for n in path), default=0.0)
        if whole is not None:
            return self._articles(whole, density, threshold)
        on_path = set(path)
        beside = [n for n in range(1, len(density)) if not self.skipped[n] and self.parent[n] in on_path and n not in on_path and self.parent[n] != best]
        chars, _, link_chars, link_tags = self.measures()
        kept = [n for n in beside if density[n] >= threshold > 0 and (self.tag[n] in TEXTUAL or chars[n] >= LEAST_PART * chars[best])]
        for node in range(1, len(density)):
            if self.tag[node] in LISTING and link_tags[node] >= LINKS_OF_A_MENU and link_chars[node] == chars[node]:
                self.skipped[node] = True
        return self._with_headings([best] + kept)

    def _articles(self, whole: int, density: list[float], threshold: float) -> list[int]:
        """``whole`` and the articles outside of it that are as dense as the threshold."""
        found, inside = [], [False] * len(density)
        for node in range(1, len(density)):
            up = self.parent[node]
            inside[node] = inside[up] or self.tag[up] in ("article", "main")
            if node == whole or self.tag[node] == "article" and not inside[node] and not self.skipped[node] and density[node] >= threshold > 0:
                found.append(node)
        return found

    def _with_headings(self, chosen: list[int]) -> list[int]:
        """``chosen`` and the headings directly before each of them."""
        before, last = {}, {}
        for node in range(1, len(self.tag)):
            before[node] = last.get(self.parent[node])
            if not self.skipped[node]:
                last[self.parent[node]] = node
        found = set(chosen)
        for node in chosen:
            ahead = before.get(node)
            while ahead is not None and self.tag[ahead] in HEADINGS:
                found.add(ahead)
                ahead = before[ahead]
        return sorted(found)

    def text(self) -> str:
        wanted = [False] * len(self.tag)
        for node in self.main_nodes():
            wanted[node] = True
        for node in range(1, len(self.tag)):
            wanted[node] = (wanted[node] or wanted[self.parent[node]]) and not self.skipped[node]
        blocks, held = [], []
        for node, text in self.flow:
            if text is None:
                if held:
                    blocks.append(" ".join("".join(held).split()))
                    held = []
            elif wanted[node]:
                held.append(text)
        if held:
            blocks.append(" ".join("".join(held).split()))
        return "\n".join(b for b in blocks if b)


def main_text(source: str) -> str:
    """The article of a page; empty if there is no text outside the page's furniture."""
    return Page(source).text() if source else ""


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``pages`` with the article of each.  A null page is an empty one; text without
    markup is its own article; rows are independent of each other."""

    def start() -> Callable[[list[str]], list[pa.Array]]:
        return lambda sources: [pa.array([main_text(s) for s in sources], pa.string())]

    return append(pages, html_col, pa.schema([(text_col, pa.string())]), start, keep)
