"""Flat text blocks of a page: their text, words, linked words, and the kind of place they stand in.

One pass over the markup, linear in its length.  Elements need not be closed, attributes may be broken; what cannot be
a tag is text."""

from __future__ import annotations

import html as references
import re
from collections import Counter

#: Fixed values of the markup language: elements that end a block, elements without an end, elements whose content is
#: no text of the page.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MUTE = frozenset("audio button canvas iframe noscript object script select style svg template textarea title video".split())
#: An element of these closes an open one of the same group that holds nothing else.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"},
          "option": {"option"}}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

#: Names of places, as elements, roles, or words of a class or an id: no part of the article, the page's main part, the
#: article itself.  A header inside the main part is a heading of it.
AROUND = frozenset(
    "ad ads advert advertisement advertisements advertising adverts alert aside author-box banner breadcrumb breadcrumbs "
    "comment comments commentlist complementary consent contentinfo cookie cookies copyright dialog disclaimer discussion "
    "disqus footer form gdpr legal login masthead menu menubar modal nav navbar navigation newsletter notice notices "
    "notification overlay pager pagination paywall popup privacy promo promoted promotion recommended related replies "
    "reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "tags toolbar topbar warning widget widgets".split())
MAIN = frozenset("content main maincontent primary".split())
ARTICLE = frozenset("article articlebody entry post prose story".split())
#: With these a name tells what is beside the element, not what it is.
BESIDE = frozenset("has no with without".split())

ATTRIBUTES = re.compile(
    r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+|["'])*+>""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
NAMED = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
WORD = re.compile(r"[a-z]+")


def place(tag: str, attributes: str) -> str:
    """"around", "header", "main", "article" or "" for an element."""
    found = set()
    if attributes and tag not in ("body", "html"):
        for name, *values in NAMED.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return "around"
            if name != "style":
                # articleBody and main-content are two words each.
                for one in re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower().split():
                    words = set(WORD.findall(one))
                    if not words & BESIDE:
                        found |= words
    found.add(tag)
    if found & AROUND:
        return "around"
    if "header" in found:
        return "header"
    return "article" if found & ARTICLE else "main" if found & MAIN else ""


class Blocks:
    """rows: (text, words, linked words, inside: 0 nothing, 1 main part, 2 article, around: 0 or 1, heading: 0 or 1)."""

    def __init__(self, page: str):
        self.rows: list[tuple[str, int, int, int, int, int]] = []
        self.parts: list[tuple[str, bool]] = []
        self.open: list[tuple[str, str]] = []
        self.kinds: Counter = Counter()
        self.tags: Counter = Counter()
        self.link = -1  # how many elements were open when the open link began
        self.scan(page)
        self.end_block()

    def end_block(self) -> None:
        if not self.parts:
            return
        parts, self.parts = self.parts, []
        words = " ".join("".join(text for text, _ in parts).split())
        if words:
            linked = sum(len(text.split()) for text, link in parts if link)
            count = words.count(" ") + 1
            inside = 2 if self.kinds["article"] else 1 if self.kinds["main"] else 0
            self.rows.append((words, count, min(linked, count), inside, int(self.kinds["around"] > 0),
                              int(any(self.tags[h] for h in HEADINGS))))

    def push(self, tag: str, attributes: str) -> None:
        kind = place(tag, attributes)
        if kind == "header":
            kind = "" if self.kinds["main"] or self.kinds["article"] else "around"
        self.open.append((tag, kind))
        self.kinds[kind] += 1
        self.tags[tag] += 1

    def pop(self) -> str:
        tag, kind = self.open.pop()
        self.kinds[kind] -= 1
        self.tags[tag] -= 1
        if len(self.open) < self.link:
            self.link = -1
        return tag

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append((" ", False))
        elif tag == "a":
            self.link = len(self.open)
        elif tag in BLOCK:
            self.end_block()
            if self.open and (self.open[-1][0] == "p" or self.open[-1][0] in CLOSES.get(tag, ())):
                self.pop()
            if tag not in VOID:
                self.push(tag, attributes)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = -1
        elif tag in BLOCK:
            self.end_block()
            if self.tags[tag]:
                while self.pop() != tag:
                    pass

    def scan(self, page: str) -> None:
        at, no_end = 0, set()
        while True:
            begin = page.find("<", at)
            text = page[at:begin if begin >= 0 else len(page)]
            if text:
                self.parts.append((references.unescape(text), self.link >= 0))
            if begin < 0:
                return
            if page.startswith("<!--", begin):
                close = page.find("-->", begin + 4)
                at = close + 3 if close >= 0 else len(page)
                continue
            closing = page.startswith("/", begin + 1)
            name = NAME.match(page, begin + 1 + closing)
            if name is None:
                if page[begin + 1:begin + 2] in ("!", "?", "/") and (close := page.find(">", begin)) >= 0:
                    at = close + 1
                else:
                    self.parts.append(("<", self.link >= 0))
                    at = begin + 1
                continue
            rest = None if ">" in no_end else ATTRIBUTES.match(page, name.end())
            if rest is None:  # the page ends inside a tag
                no_end.add(">")
                at = len(page)
                continue
            tag, at = name.group().lower(), rest.end()
            attributes = page[name.end():at - 1]
            if closing:
                self.end(tag)
            elif tag in MUTE and tag not in no_end:
                close = re.compile(f"</{tag}\\b[^>]*>?", re.I).search(page, at)
                if close:
                    at = close.end()
                elif tag in ("script", "style"):
                    at = len(page)
                else:
                    no_end.add(tag)
            else:
                self.start(tag, attributes)


def blocks(page: str) -> list[tuple[str, int, int, int, int, int]]:
    return Blocks(page).rows
