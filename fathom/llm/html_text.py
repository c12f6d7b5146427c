"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is cut into flat blocks at every tag that is not inline.  A block is described by
its word count and link density, those of its two neighbours, and its kind (heading,
paragraph or bare text).  Marks of the page help where there are any: whether the block
stands inside an article or inside a part that is named as something else (menu, footer,
form, advert, reader comments ...), and whether the page has an article at all.  A decision
tree grown on ``LABELLED`` decides which blocks are main text.  Pages without any marks are
decided by numbers and kinds alone.

Three things are looked at over the whole page.  Where paragraph tags hold less of the words
outside links than long blocks without such a tag, a second tree, grown on ``UNTAGGED``, decides by words and links
alone.  Of several articles, those that are short beside the longest are teasers.  What
readers wrote begins at a short heading that says so and ends with the element around it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_TAG = re.compile(
    r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)|<[!?/][^>]*(?:>|$)""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|style|itemprop|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/>]|$)""", re.IGNORECASE)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe noframes noembed xmp svg math object audio video canvas select".split())
_ASIDE = frozenset("nav footer aside form menu dialog button fieldset".split())
_HOLDERS = frozenset(
    "nav footer aside form menu dialog button fieldset header article main section div ul ol dl table figure details center td blockquote span p a li".split()
)
#: Words of class, id and role that name a part of the page other than the article.
_NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices alert"
    " popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar sidebar aside rail widget widgets related recommended recommendations"
    " trending popular share sharing social follow footer contentinfo complementary comment comments commentlist respond reply replies discussion disqus newsletter subscribe"
    " subscription signup signin login register search searchform form toc skip copyright masthead topbar feedback responses replies letters guestbook reviews teaser teasers"
    " outbrain taboola upsell paywall donate callout".split()
)
#: Short headings that what readers wrote stands under, and short calls that are no text (fixed values).
_READERS = re.compile(r"(?:\d+ )?(?:reader |user |all |your )?(?:comments?|responses?|replies|reader letters|letters from readers|discussion|kommentare?|commentaires?|comentarios?|leave a (?:reply|comment)|post a comment)\b", re.IGNORECASE)
_CALLS = re.compile(r"(?:subscribe (?:to|now|today)|sign up (?:for|to|now|today)|share this|follow us|read more|read also|related (?:articles|stories|posts)|advertisement\b|click here|log in to|we use cookies|this (?:site|website) uses cookies)", re.IGNORECASE)
READERS_WORDS, CALL_WORDS = 6, 12
#: Share of the longest article's words under which another article is a teaser.
TEASER = 0.3
#: Of these, words that a wrapper of the whole page carries too, for its layout.
_LAYOUT = frozenset("sidebar aside rail banner nav navbar navigation menu toolbar topbar masthead footer overlay modal cookie cookies consent ad ads adv skip".split())
#: Whole names that mark even an article element as something else.
_NO_ARTICLE = frozenset("ad ads advert advertisement sponsored promo promoted comment reply".split())
_STATES = frozenset("has have with without no not is hide hidden show".split())
_FRAMES = frozenset("wrap wrapper inner outer container area box block section row holder layout list links buttons title".split())
_CONTENT = frozenset("content main primary body page article".split())
_HEADS = frozenset("header head top".split())
#: Class or id values, and item properties, that mark the article where no element does.
_BODY = re.compile(r"(?:^|\s)(?:(?:article|post|entry|story|news|blog|main|page)[-_]?(?:content|body|text|main)|articlebody|article|post|entry|story|content)(?=\s|$)")
_WORD = re.compile(r"[a-z]+")


_KINDS = dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), 2) | dict.fromkeys("p pre blockquote li dd dt td th figcaption".split(), 1)
_PHRASES = frozenset("p li span a td".split())


class Block(NamedTuple):
    """``kind``: 2 in a heading, 1 in a paragraph, list item or cell, 0 for bare text.

    ``piece``: number of the outermost article around it; ``depth``: elements around it, paragraphs and the like left out.
    """

    text: str
    words: int
    links: float
    kind: int
    article: bool
    aside: bool
    piece: int = 0
    depth: int = 0


def _named(token: str) -> set[str]:
    """Words of ``_NAMED`` that a class, id or role is mainly about.

    That is its first or last word, frames like ``-wrap`` left out.  States (``has-sidebar``)
    and layouts of content (``content-sidebar-wrap``) are about something else.
    """
    words = _WORD.findall(token.split("--")[0])
    if not words or words[0] in _STATES and len(words) > 1:
        return set()
    main = words[:]
    while len(main) > 1 and main[-1] in _FRAMES:
        main.pop()
    if words[0] in _CONTENT and len(words) > 2 and words[-1] in _FRAMES and main[-1] in _LAYOUT:
        return set()
    return {main[0], main[-1]} & _NAMED


class Marks(NamedTuple):
    """``aside``: by the element itself; ``named``: words of class, id and role that say so."""

    aside: bool
    named: frozenset[str]
    head: bool
    body: bool


def _marks(name: str, attributes: str) -> Marks:
    """Whether an element is something else, a page header, and the article."""
    aside, head, body, named, tokens = name in _ASIDE, name == "header", name in ("article", "main"), set(), []
    if attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                aside = True
            elif key in ("class", "id", "role") and name not in ("body", "html", "main"):
                tokens += value.split()
                head = head or bool(set(_WORD.findall(value)) & _HEADS) and not re.match(r"h[1-6]$", name)
                body = body or value == "main" and key == "role" or bool(_BODY.search(value))
            elif key == "itemprop":
                body = body or value == "articlebody"
        for token in tokens:
            named |= _named(token)
        if body:
            sure = set(tokens) & _NO_ARTICLE
            named = set() if any(_BODY.search(t) for t in tokens) else sure
    return Marks(aside, frozenset(named), head, body)


def flat_blocks(page: str) -> list[Block]:
    """Blocks of text in page order, white space turned into single blanks.

    If all articles of a page lie in elements whose class, id or role has a word of ``_LAYOUT``
    only, those wrap the article and are not something else.
    """
    out, around = _blocks(page, frozenset())
    if around and not any(b.article and not b.aside for b in out):
        out, _ = _blocks(page, frozenset(around))
    return out


class _Open:
    """Open elements of a page; every step takes constant time, however deep they are nested."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.marks: list[tuple[bool, bool]] = []  # inside an article, inside something else
        self.places: dict[str, list[int]] = {}
        self.firm: list[int] = []  # where elements stand that a stray </p> or </a> does not go beyond
        self.layout: list[tuple[int, int]] = []  # (place, start) of elements named by layout only, no article found inside so far

    def push(self, name: str, article: bool, aside: bool, start: int | None) -> None:
        at = len(self.names)
        self.names.append(name)
        self.marks.append((article, aside))
        self.places.setdefault(name, []).append(at)
        if name not in _PHRASES:
            self.firm.append(at)
        if start is not None:
            self.layout.append((at, start))

    def find(self, name: str) -> int | None:
        """Place of the element that an end tag closes."""
        places = self.places.get(name)
        if not places or name in _PHRASES and self.firm and self.firm[-1] > places[-1]:
            return None
        return places[-1]

    def close(self, at: int) -> None:
        while len(self.names) > at:
            name = self.names.pop()
            self.marks.pop()
            self.places[name].pop()
        for stack, place in ((self.firm, lambda x: x), (self.layout, lambda x: x[0])):
            while stack and place(stack[-1]) >= at:
                stack.pop()

    def around(self) -> set[int]:
        """Starts of the elements named by layout only that hold what comes now, each told once."""
        found = {start for _, start in self.layout}
        self.layout.clear()
        return found

    def inside(self) -> tuple[bool, bool]:
        return self.marks[-1] if self.marks else (False, False)


def _blocks(page: str, wrappers: frozenset[int]) -> tuple[list[Block], set[int]]:
    """Blocks, and where the elements start that hold an article and are named by layout only."""
    out: list[Block] = []
    around: set[int] = set()
    text: list[str] = []
    linked: list[str] = []
    held = _Open()
    article = aside = False
    link, at, skip, kind = False, 0, "", 0
    piece = pieces_seen = 0

    def close():
        if text:
            words = " ".join("".join(text).split())
            if words:
                n = words.count(" ") + 1
                out.append(Block(words, n, min(1.0, len("".join(linked).split()) / n), kind, article, aside, piece, len(held.firm)))
            text.clear()
            linked.clear()

    for tag in _TAG.finditer(page):
        if tag.start() < at:
            continue
        if skip:
            if not (tag[1] or tag[4]) or (tag[2] or tag[5] or "").lower() != skip:
                continue
            skip, at = "", tag.end()
            continue
        if tag.start() > at:
            said = html.unescape(page[at : tag.start()])
            text.append(said)
            if link:
                linked.append(said)
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        attributes = tag[3] or tag[6] or ""
        closing = bool(tag[1] or tag[4])
        if name in _RAW:
            if name not in ("noscript", "select"):
                text.append(" ")
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{name}(?=[\s/>]|$)", re.IGNORECASE).search(page, at)
                if end is None:
                    at = len(page)
                    break
                skip, at = name, end.start()
            continue
        if name == "br":
            text.append(" ")
        elif name not in _INLINE:
            close()
            kind = 0 if closing else _KINDS.get(name, 0)
        if name == "a":
            link = not closing
        if name in _HOLDERS and not attributes.endswith("/"):
            if closing:
                place = held.find(name)
                if place is not None:
                    if name in _INLINE and held.marks[place][1] != aside:
                        close()
                    held.close(place)
                    article, aside = held.inside()
            else:
                if name in ("p", "li") and held.names and held.names[-1] == name:
                    held.close(len(held.names) - 1)
                    article, aside = held.inside()
                marks = _marks(name, attributes)
                body, layout = marks.body, bool(marks.named) and not marks.aside and marks.named <= _LAYOUT
                other = marks.aside or bool(marks.named) and not (layout and tag.start() in wrappers)
                now = aside or other or marks.head and not article
                if body:
                    around |= held.around()
                if name in _INLINE and now != aside:
                    close()
                if body and not article and name not in _INLINE:
                    pieces_seen += 1
                    piece = pieces_seen
                article = article or body and name not in _INLINE
                aside = now
                held.push(name, article, aside, tag.start() if layout else None)
    if at < len(page) and not skip:
        text.append(html.unescape(page[at:]))
    close()
    return out, around


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "kind", "article", "aside", "page_has_article")

#: Labelled blocks (fixed values): the features above, then 1 for main text.
LABELLED = (
    # no marks: paragraphs, by links and by what stands around them
    (60, 0.0, 40, 0.0, 55, 0.0, 1, 0, 0, 0, 1), (25, 0.0, 70, 0.0, 30, 0.0, 1, 0, 0, 0, 1), (2, 0.0, 33, 0.0, 41, 0.0, 1, 0, 0, 0, 1), (110, 0.1, 3, 1.0, 20, 0.0, 1, 0, 0, 0, 1),
    (40, 0.25, 60, 0.0, 35, 0.1, 1, 0, 0, 0, 1), (30, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 0, 1), (1, 0.0, 2, 0.0, 3, 0.0, 1, 0, 0, 0, 1), (1, 0.0, 60, 0.0, 9, 0.0, 1, 0, 0, 0, 1),
    (4, 0.0, 12, 0.0, 2, 0.0, 1, 0, 0, 0, 1), (9, 0.0, 5, 0.0, 80, 0.0, 1, 0, 0, 0, 1), (60, 0.0, 3, 1.0, 5, 0.0, 1, 0, 0, 0, 1), (45, 0.0, 0, 0.0, 3, 1.0, 1, 0, 0, 0, 1),
    (150, 0.02, 12, 0.0, 0, 0.0, 1, 0, 0, 0, 1), (14, 0.3, 60, 0.0, 25, 0.0, 1, 0, 0, 0, 1), (35, 0.0, 5, 1.0, 12, 0.2, 1, 0, 0, 0, 1), (6, 0.0, 8, 0.0, 7, 0.0, 1, 0, 0, 0, 1),
    (1, 0.0, 60, 0.0, 2, 0.0, 1, 0, 0, 0, 1), (12, 0.0, 40, 0.0, 1, 0.0, 1, 0, 0, 0, 1), (20, 0.0, 4, 0.0, 3, 0.0, 1, 0, 0, 0, 1), (2, 0.0, 1, 0.0, 1, 0.0, 1, 0, 0, 0, 1),
    (3, 1.0, 3, 1.0, 2, 1.0, 1, 0, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 0, 0), (2, 1.0, 80, 0.0, 3, 1.0, 1, 0, 0, 0, 0), (8, 0.9, 5, 1.0, 60, 0.0, 1, 0, 0, 0, 0),
    (12, 0.7, 9, 0.8, 10, 0.9, 1, 0, 0, 0, 0), (28, 0.8, 60, 0.0, 30, 0.9, 1, 0, 0, 0, 0), (6, 0.0, 70, 0.0, 0, 0.0, 1, 0, 0, 0, 0), (2, 0.0, 25, 0.0, 0, 0.0, 1, 0, 0, 0, 0),
    (4, 0.0, 2, 1.0, 3, 1.0, 1, 0, 0, 0, 0), (7, 0.1, 5, 1.0, 4, 1.0, 1, 0, 0, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 0, 0), (1, 1.0, 2, 1.0, 9, 0.0, 1, 0, 0, 0, 0),
    (8, 0.0, 0, 0.0, 10, 0.8, 1, 0, 0, 0, 1), (12, 0.0, 0, 0.0, 25, 0.9, 1, 0, 0, 0, 1),
    # no marks: headings belong to the text below them
    (5, 0.0, 2, 1.0, 60, 0.0, 2, 0, 0, 0, 1), (10, 0.0, 8, 0.0, 45, 0.0, 2, 0, 0, 0, 1), (4, 0.0, 70, 0.0, 50, 0.0, 2, 0, 0, 0, 1), (9, 0.0, 50, 0.0, 2, 0.0, 2, 0, 0, 0, 1),
    (7, 0.0, 0, 0.0, 90, 0.0, 2, 0, 0, 0, 1), (12, 0.0, 9, 0.0, 14, 0.0, 2, 0, 0, 0, 1), (6, 0.0, 1, 1.0, 11, 0.1, 2, 0, 0, 0, 1), (3, 0.0, 25, 0.0, 8, 0.0, 2, 0, 0, 0, 1),
    (5, 0.0, 20, 0.0, 1, 0.0, 2, 0, 0, 0, 1), (16, 0.0, 6, 0.0, 3, 0.0, 2, 0, 0, 0, 1),
    (2, 0.0, 0, 0.0, 1, 1.0, 2, 0, 0, 0, 0), (3, 0.0, 60, 0.0, 3, 1.0, 2, 0, 0, 0, 0), (2, 0.0, 30, 0.0, 0, 0.0, 2, 0, 0, 0, 0), (4, 1.0, 0, 0.0, 2, 1.0, 2, 0, 0, 0, 0),
    (5, 1.0, 3, 0.0, 30, 0.0, 2, 0, 0, 0, 0), (6, 0.0, 2, 1.0, 4, 1.0, 2, 0, 0, 0, 0),
    # no marks: bare text is main only where it is long
    (60, 0.0, 40, 0.0, 55, 0.0, 0, 0, 0, 0, 1), (40, 0.0, 3, 1.0, 5, 0.0, 0, 0, 0, 0, 1), (120, 0.05, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (70, 0.1, 8, 0.9, 30, 0.0, 0, 0, 0, 0, 1),
    (45, 0.0, 6, 0.0, 90, 0.0, 0, 0, 0, 0, 1), (35, 0.2, 60, 0.0, 4, 1.0, 0, 0, 0, 0, 1),
    (8, 0.0, 1, 1.0, 10, 0.0, 0, 0, 0, 0, 0), (12, 0.0, 2, 1.0, 9, 0.0, 0, 0, 0, 0, 0), (9, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (14, 0.0, 3, 0.0, 0, 0.0, 0, 0, 0, 0, 0),
    (2, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0, 0), (7, 0.0, 50, 0.0, 60, 0.0, 0, 0, 0, 0, 0), (18, 0.1, 40, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (3, 1.0, 3, 1.0, 3, 1.0, 0, 0, 0, 0, 0),
    (30, 0.9, 60, 0.0, 4, 1.0, 0, 0, 0, 0, 0), (15, 0.0, 1, 1.0, 12, 0.0, 0, 0, 0, 0, 0), (20, 0.0, 8, 0.0, 70, 0.0, 0, 0, 0, 0, 0), (5, 0.5, 3, 1.0, 2, 0.0, 0, 0, 0, 0, 0),
    # inside an article, nothing else named: main text of any length and link density
    (9, 0.0, 6, 0.0, 9, 0.0, 1, 1, 0, 1, 1), (1, 0.0, 40, 0.0, 60, 0.0, 1, 1, 0, 1, 1), (60, 0.0, 1, 0.0, 45, 0.1, 0, 1, 0, 1, 1), (120, 0.02, 60, 0.0, 0, 0.0, 1, 1, 0, 1, 1),
    (2, 1.0, 50, 0.0, 80, 0.0, 1, 1, 0, 1, 1), (14, 0.6, 3, 1.0, 25, 0.0, 0, 1, 0, 1, 1), (35, 0.0, 0, 0.0, 4, 1.0, 1, 1, 0, 1, 1), (4, 0.0, 1, 1.0, 30, 0.0, 2, 1, 0, 1, 1),
    (300, 0.01, 5, 0.5, 6, 0.2, 1, 1, 0, 1, 1), (1, 0.0, 1, 0.0, 1, 0.0, 0, 1, 0, 1, 1), (3, 1.0, 2, 1.0, 2, 1.0, 1, 1, 0, 1, 1), (25, 0.0, 20, 0.0, 22, 0.0, 1, 1, 0, 1, 1),
    (5, 0.0, 70, 0.0, 3, 0.0, 0, 1, 0, 1, 1), (6, 0.0, 80, 0.0, 0, 0.0, 1, 1, 0, 1, 1), (3, 0.0, 9, 0.0, 1, 1.0, 2, 1, 0, 1, 1),
    # named as something else, inside an article or not
    (3, 1.0, 3, 1.0, 3, 1.0, 1, 0, 1, 1, 0), (40, 0.0, 30, 0.0, 25, 0.0, 1, 1, 1, 1, 0), (7, 0.0, 1, 1.0, 8, 0.0, 0, 0, 1, 1, 0), (80, 0.0, 60, 0.0, 70, 0.0, 1, 0, 1, 1, 0),
    (1, 0.0, 100, 0.0, 0, 0.0, 0, 1, 1, 1, 0), (12, 0.3, 9, 0.0, 11, 0.2, 1, 1, 1, 1, 0), (3, 1.0, 2, 1.0, 4, 1.0, 1, 0, 1, 0, 0), (45, 0.0, 25, 0.0, 60, 0.0, 1, 0, 1, 0, 0),
    (150, 0.02, 90, 0.0, 0, 0.0, 0, 0, 1, 0, 0), (6, 0.0, 0, 0.0, 80, 0.0, 2, 0, 1, 0, 0), (20, 0.1, 200, 0.0, 3, 1.0, 1, 0, 1, 0, 0), (2, 0.0, 2, 0.0, 2, 0.0, 2, 0, 1, 0, 0),
    (5, 0.0, 30, 0.0, 40, 0.0, 2, 1, 1, 1, 0), (60, 0.0, 4, 0.0, 90, 0.0, 0, 1, 1, 1, 0),
    # outside the article of a page that has one
    (8, 0.0, 3, 1.0, 9, 0.0, 0, 0, 0, 1, 0), (35, 0.0, 8, 0.0, 12, 0.0, 1, 0, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 1, 0), (60, 0.0, 3, 1.0, 5, 0.0, 1, 0, 0, 1, 0),
    (200, 0.0, 4, 0.0, 2, 0.0, 0, 0, 0, 1, 0), (50, 0.0, 60, 0.0, 70, 0.0, 1, 0, 0, 1, 0), (90, 0.1, 100, 0.0, 0, 0.0, 1, 0, 0, 1, 0), (5, 0.0, 60, 0.0, 4, 1.0, 2, 0, 0, 1, 0),
    (16, 0.5, 2, 1.0, 40, 0.0, 1, 0, 0, 1, 0), (4, 0.0, 30, 0.0, 50, 0.0, 2, 0, 0, 1, 0), (2, 0.0, 3, 0.0, 9, 0.0, 1, 0, 0, 1, 0), (70, 0.0, 80, 0.0, 30, 0.0, 0, 0, 0, 1, 0),
)

#: The same for pages without paragraph tags (fixed values): words and links of a block and its neighbours, 1 for main text.
UNTAGGED = (
    (60, 0.0, 40, 0.0, 55, 0.0, 1), (25, 0.0, 70, 0.0, 30, 0.0, 1), (40, 0.1, 3, 1.0, 20, 0.0, 1), (15, 0.0, 0, 0.0, 0, 0.0, 1),
    (2, 0.0, 33, 0.0, 41, 0.0, 1), (1, 0.0, 60, 0.0, 30, 0.0, 1), (9, 0.0, 25, 0.0, 80, 0.0, 1), (120, 0.02, 60, 0.0, 0, 0.0, 1),
    (6, 0.0, 7, 0.0, 40, 0.0, 1), (1, 0.0, 2, 0.0, 30, 0.0, 1), (2, 0.0, 40, 0.0, 1, 0.0, 1), (30, 0.0, 0, 0.0, 12, 1.0, 1),
    (5, 0.0, 90, 0.0, 14, 0.0, 1), (20, 0.0, 2, 0.0, 9, 0.0, 1), (7, 0.0, 60, 0.0, 8, 0.0, 1), (8, 0.0, 9, 0.0, 6, 0.0, 1),
    (8, 0.0, 1, 1.0, 10, 0.0, 0), (12, 0.0, 2, 1.0, 9, 0.0, 0), (5, 0.0, 3, 1.0, 4, 0.0, 0), (9, 0.0, 60, 0.0, 0, 0.0, 0),
    (14, 0.0, 3, 0.0, 0, 0.0, 0), (4, 0.0, 30, 0.0, 0, 0.0, 0), (6, 0.0, 80, 0.0, 3, 1.0, 0), (3, 1.0, 3, 1.0, 2, 1.0, 0),
    (30, 0.9, 60, 0.0, 4, 1.0, 0), (1, 1.0, 60, 0.0, 40, 0.0, 0), (2, 1.0, 40, 0.0, 2, 1.0, 0), (3, 1.0, 60, 0.0, 4, 1.0, 0),
    (2, 1.0, 2, 1.0, 0, 0.0, 0), (1, 1.0, 1, 1.0, 0, 0.0, 0), (3, 1.0, 0, 0.0, 2, 1.0, 0), (2, 1.0, 1, 1.0, 70, 0.0, 0), (2, 0.0, 1, 1.0, 1, 1.0, 0), (11, 0.1, 90, 0.0, 2, 1.0, 0),
)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """Decision tree by Gini impurity: (feature, threshold, low side, high side) or a class."""
    if depth == 0 or len(set(y.tolist())) == 1:
        return int(2 * y.sum() > len(y))
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            cost = sum(2 * side.sum() * (1 - side.mean()) for side in (y[low], y[~low]))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(cut), low)
    if best is None:
        return int(2 * y.sum() > len(y))
    _, f, cut, low = best
    return f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


@cache
def trained_tree(tagged: bool = True):
    table = np.array(LABELLED if tagged else UNTAGGED, float)
    return grow(table[:, :-1], table[:, -1])


def _is_main(tree, row) -> bool:
    while not isinstance(tree, int):
        f, cut, low, high = tree
        tree = low if row[f] <= cut else high
    return bool(tree)


#: Words from which a block without a paragraph tag counts as text that lacks one.
LONG = 25


def _tagged(blocks: list[Block]) -> bool:
    """Whether the page puts its text into paragraph tags: long blocks without one do not outweigh them."""
    plain = [b for b in blocks if b.links < 0.5 and not b.aside]
    held = sum(b.words for b in plain if b.kind)
    return held > 0 and held >= sum(b.words for b in plain if not b.kind and b.words >= LONG)


def _without_teasers(blocks: list[Block]) -> list[Block]:
    """Articles that are short beside the longest count as outside of it."""
    size: dict[int, int] = {}
    for b in blocks:
        if b.article and not b.aside:
            size[b.piece] = size.get(b.piece, 0) + b.words
    longest = max(size.values(), default=0)
    return [b._replace(article=False) if b.article and size.get(b.piece, 0) < TEASER * longest else b for b in blocks]


def _without_readers(blocks: list[Block]) -> list[Block]:
    """What follows a heading of readers' words is something else, up to where its element ends; calls are too."""
    out, below = [], None
    for b in blocks:
        if below is not None and b.depth < below:
            below = None
        if below is None and b.words <= READERS_WORDS and b.links < 0.5 and _READERS.match(b.text) and any(o.words > b.words for o in out):
            below = b.depth
        called = b.words <= CALL_WORDS and bool(_CALLS.match(b.text))
        out.append(b._replace(aside=True) if below is not None or called else b)
    return out


def main_text(page: str) -> str:
    """Main blocks of a page in order, joined by single blanks; empty if there are none."""
    blocks = _without_readers(_without_teasers(flat_blocks(page)))
    has_article = any(b.article and not b.aside for b in blocks)
    tagged = has_article or _tagged(blocks)
    tree, kept = trained_tree(tagged), []
    edge = Block("", 0, 0.0, 0, False, False)
    for before, own, after in zip([edge, *blocks], blocks, [*blocks[1:], edge]):
        row = (own.words, own.links, before.words, before.links, after.words, after.links)
        if _is_main(tree, (*row, own.kind, own.article, own.aside, has_article)) if tagged else not own.aside and _is_main(tree, row):
            kept.append(own.text)
    return " ".join(kept)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row; null html is an empty page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py() or "") for p in batch.column(2)]
            n = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), n], ["page_id", "url", "text", "n_chars"])

    picked = pages.select("page_id", "url", pages["html"].cast("string").alias("html"))
    schema = picked.drop("html").schema.add("text", "string").add("n_chars", "long")
    return picked.mapInArrow(run, schema)
