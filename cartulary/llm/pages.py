"""Main text of web pages: flat text blocks, classified by a decision tree over themselves and their neighbours."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

#: Their content is no text of the page and holds no tags; unclosed, it goes to the end of the page.
RAW = "script style noscript iframe textarea title"
#: Their content is no text of the page either, but it holds tags, which may end it.
ASIDE = set("template svg foreignobject canvas object head select button".split())
#: Of these, those whose content is the page's if they have no end of their own.
EMPTY = {"template", "canvas", "object"}
#: What an open element cannot hold, so that its start ends the element; head ends at anything but HEAD.
HEAD = set("base basefont bgsound link meta noscript script style template title html head object".split())
SELECT = set("select option optgroup hr script template".split())
LABEL_ENDS = set(  # of a button
    "button p h1 h2 h3 h4 h5 h6 article main section nav aside header footer form table ul ol dl figure blockquote pre body".split()
)
DRAWN = set(  # tags of pages, which are none of drawings: they end an open svg
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing main menu meta"
    " nobr ol p pre ruby s small span strong strike sub sup table tt u ul var article section nav aside header footer".split()
)
RAW_START = re.compile(r"<(" + "|".join(RAW.split()) + r")\b", re.I)
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW.split()}
START = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
STOPS = re.compile(r"[>\"']")
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr input".split()
)
#: Elements that may hold blocks and whose ends are tracked.
HOLDERS = set("article main section div nav aside header footer form menu dialog ul ol dl table figure fieldset details".split())
BODY = {"article", "main"}
APART = {"nav", "aside", "header", "footer", "form", "menu", "dialog"}
#: Parts of class names, ids and roles: of the article itself, and of what stands around it.
OWN_WORDS = set("article post entry content story main body".split())
APART_WORDS = set(
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner nav navigation navbar menu"
    " breadcrumb breadcrumbs sidebar side footer header masthead cookie cookies consent notice notification alert"
    " popup modal overlay comment comments reply replies disqus form login signup subscribe newsletter search share"
    " sharing social related recommended teaser widget complementary contentinfo".split()
)
HINTS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place", "apart")


def ends(tag: str, held: str) -> bool:
    """Whether the start of an element implies the end of the open element ``held``."""
    if held == "head":
        return tag not in HEAD
    if held == "select":
        return tag == "input" or tag not in SELECT and tag not in INLINE
    return tag in {"svg": DRAWN, "button": LABEL_ENDS}.get(held, ())


class Tag(NamedTuple):
    start: int
    end: int
    name: str  # empty for what is no element: comments, declarations, and RAW elements with all they hold
    closes: bool
    attrs: str


def tags(html: str) -> Iterator[Tag]:
    """The markup of a page from left to right, in time proportional to its length.

    A tag ends at the first ``>`` outside quotes.  Once a quote is found to have no end in the page, quotes of its
    kind are ordinary characters; once a tag is found to have no ``>`` outside quotes, quotes of both kinds are.  So
    the rest of a page is looked through for nothing three times at most, however often it tries.
    """
    last, at, ordinary = html.rfind(">"), 0, set()

    def tag_end(k: int) -> int:
        """Where the tag that begins before ``k`` ends."""
        first = k
        while stop := STOPS.search(html, k):
            k = stop.end()
            if stop.group() == ">":
                return k
            if stop.group() not in ordinary:
                closing = html.find(stop.group(), k)
                if closing < 0:
                    ordinary.add(stop.group())
                else:
                    k = closing + 1
        ordinary.update("\"'")
        return html.find(">", first) + 1

    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = end + 3 if end >= 0 else len(html)
            yield Tag(at, end, "", False, "")
            at = end
            continue
        if html.startswith("<![CDATA[", at):
            yield Tag(at, at + 9, "", False, "")
            at += 9
            continue
        if at > last:
            return
        if html.startswith(("<!", "<?"), at):
            end = html.find(">", at) + 1
            yield Tag(at, end, "", False, "")
            at = end
            continue
        if not (m := START.match(html, at)):
            at += 1
            continue
        end = tag_end(m.end())
        name = m[2].lower()
        if not m[1] and (raw := RAW_START.match(html, at)):
            closing = RAW_END[raw[1].lower()].search(html, end)
            end, name = (closing.end() if closing else len(html)), ""
        yield Tag(at, end, name, bool(m[1]), html[m.end() : end - 1] if name else "")
        at = end


class Block(NamedTuple):
    text: str
    words: int
    linked: int  # words inside links
    inside: bool  # of an article or main element
    apart: bool  # in a menu, header, footer, sidebar, notice, advert, form or comment


def set_apart(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element holds something else than the article.  A header inside the article holds its title."""
    if HIDDEN.search(attrs):
        return True
    hints = {w for m in HINTS.finditer(attrs) for w in re.split(r"[^a-z0-9]+", "".join(x or "" for x in m.groups()).lower())}
    if hints & {"comment", "comments", "reply", "replies", "disqus"}:
        return True
    if tag in APART and not (tag == "header" and inside):
        return True
    return bool(hints & APART_WORDS) and not hints & OWN_WORDS and tag not in BODY


def blocks(html: str) -> list[Block]:
    """The page's text between block-level tags, in page order, white space folded, references decoded."""
    made: list[Block] = []
    held: list[tuple[str, bool, bool, tuple | None]] = []  # open holders: tag, inside, apart, what an ASIDE interrupts
    inside = apart = False
    parts: list[str] = []
    linked, in_link = 0, 0

    def end() -> None:
        nonlocal parts, linked
        text = " ".join(unescape("".join(parts)).split())
        if text:
            n = text.count(" ") + 1
            made.append(Block(text, n, min(linked, n), inside, apart))
        parts, linked = [], 0

    def leave(closed: bool) -> str:
        """The last holder ends, by its own end tag or not: what stood in an ASIDE goes, the text before it goes on."""
        nonlocal inside, apart, parts, linked, in_link
        tag, inside, apart, before = held.pop()
        if before:
            inner, rest = made[before[0] :], (parts, linked, in_link)
            del made[before[0] :]
            _, parts, linked, in_link = before
            if tag in EMPTY and not closed:
                if inner:
                    end()
                made.extend(inner)
                parts, linked, in_link = parts + rest[0], linked + rest[1], rest[2]
        return tag

    def add(piece: str) -> None:
        nonlocal linked
        if held and held[-1][0] == "head" and piece.strip():
            leave(False)
        if piece:
            parts.append(piece)
            if in_link:
                linked += len(piece.split())

    at = 0
    for start, after, tag, closes, attrs in tags(html):
        add(html[at:start].replace("]]>", ""))
        at = after
        if not tag:
            continue
        if not closes:
            while held and ends(tag, held[-1][0]):
                leave(False)
        if tag in ASIDE:
            if not closes:
                if not attrs.endswith("/"):
                    held.append((tag, inside, apart, (len(made), parts, linked, in_link)))
                    parts, linked, in_link = [], 0, 0
            elif any(t == tag for t, *_ in held):
                while held[-1][0] != tag:
                    leave(False)
                leave(True)
            continue
        if tag == "a":
            in_link = 0 if closes else 1
        if tag in INLINE:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        end()
        in_link = 0
        if tag not in HOLDERS:
            continue
        if not closes:
            held.append((tag, inside, apart, None))
            apart = apart or set_apart(tag, attrs, inside)
            inside = inside or tag in BODY
        elif any(t == tag for t, *_ in held):
            while leave(False) != tag:
                end()
    add(html[at:].replace("]]>", ""))
    while any(before for *_, before in held):
        if not held[-1][3]:
            end()
        leave(False)
    end()
    return made


def features(found: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` per block.  place: 1 inside the article element, -1 outside it, 0 if there is none."""
    has = any(b.inside and not b.apart for b in found)
    words = np.array([0, *(b.words for b in found), 0], dtype=float)
    links = np.array([0, *(b.linked / b.words for b in found), 0], dtype=float)
    place = [(1 if b.inside else -1) if has else 0 for b in found]
    around = [x for k in (slice(1, -1), slice(None, -2), slice(2, None)) for x in (words[k], links[k])]
    return np.column_stack([*around, place, [float(b.apart) for b in found]])


#: Labelled blocks: FEATURES, then 1 for main text.  Written by hand from pages of common layouts.
LABELLED = [
    # inside an article element: title, paragraphs long and short, quotes, linked phrases and items
    (9, 0.0, 6, 1.0, 80, 0.0, 1, 0, 1), (12, 0.0, 11, 0.0, 45, 0.0, 1, 0, 1), (80, 0.0, 9, 0.0, 64, 0.0, 1, 0, 1),
    (64, 0.05, 80, 0.0, 3, 0.0, 1, 0, 1), (3, 0.0, 64, 0.05, 40, 0.0, 1, 0, 1), (40, 0.0, 3, 0.0, 8, 0.3, 1, 0, 1),
    (1, 0.0, 30, 0.0, 52, 0.0, 1, 0, 1), (25, 0.4, 31, 0.0, 16, 0.0, 1, 0, 1), (5, 1.0, 60, 0.0, 44, 0.1, 1, 0, 1),
    (2, 0.0, 41, 0.0, 12, 0.0, 1, 0, 1), (300, 0.01, 7, 0.0, 250, 0.0, 1, 0, 1), (14, 0.5, 20, 0.0, 9, 0.5, 1, 0, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1), (2, 1.0, 3, 1.0, 1, 1.0, 1, 0, 1), (7, 0.0, 6, 1.0, 2, 0.0, 1, 0, 1),
    (18, 0.0, 2, 0.0, 4, 0.0, 1, 0, 1), (4, 0.0, 5, 0.0, 10, 0.0, 1, 0, 1), (10, 0.9, 8, 0.0, 7, 0.0, 1, 0, 1),
    (33, 0.0, 1, 0.0, 1, 0.0, 1, 0, 1), (140, 0.0, 0, 0.0, 5, 0.0, 1, 0, 1), (6, 0.0, 140, 0.0, 9, 0.0, 1, 0, 1),
    (26, 0.0, 15, 0.0, 11, 0.0, 1, 0, 1), (55, 0.0, 22, 0.0, 2, 0.0, 1, 0, 1), (8, 0.1, 4, 0.0, 3, 0.0, 1, 0, 1),
    # and lists of links, which are the article's own
    (4, 1.0, 30, 0.0, 5, 1.0, 1, 0, 1), (5, 1.0, 4, 1.0, 3, 1.0, 1, 0, 1), (3, 1.0, 5, 1.0, 8, 1.0, 1, 0, 1),
    (8, 1.0, 3, 1.0, 40, 0.0, 1, 0, 1), (5, 0.0, 4, 1.0, 6, 1.0, 1, 0, 1), (2, 0.0, 7, 1.0, 3, 1.0, 1, 0, 1),
    (1, 0.0, 2, 1.0, 9, 0.9, 1, 0, 1), (12, 0.9, 2, 1.0, 14, 0.8, 1, 0, 1), (7, 0.6, 12, 0.9, 11, 0.7, 1, 0, 1),
    (20, 0.8, 7, 1.0, 6, 1.0, 1, 0, 1), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 1), (3, 0.5, 20, 0.8, 2, 1.0, 1, 0, 1),
    (6, 0.9, 35, 0.0, 60, 0.0, 1, 0, 1), (4, 1.0, 80, 0.1, 25, 0.0, 1, 0, 1), (9, 0.8, 16, 0.0, 0, 0.0, 1, 0, 1),
    # set apart inside it: adverts, sharing lists, notices, reader comments
    (11, 0.0, 60, 0.0, 72, 0.0, 1, 1, 0), (3, 1.0, 50, 0.0, 3, 1.0, 1, 1, 0), (35, 0.0, 12, 0.0, 40, 0.0, 1, 1, 0),
    (70, 0.0, 3, 1.0, 66, 0.0, 1, 1, 0), (120, 0.0, 2, 0.0, 4, 0.0, 1, 1, 0), (2, 0.0, 70, 0.0, 0, 0.0, 1, 1, 0),
    (12, 0.0, 33, 0.0, 48, 0.0, 1, 1, 0), (48, 0.0, 12, 0.0, 77, 0.0, 1, 1, 0), (1, 0.0, 28, 0.0, 36, 0.0, 1, 1, 0),
    (9, 0.3, 58, 0.0, 21, 0.0, 1, 1, 0), (200, 0.0, 90, 0.0, 61, 0.0, 1, 1, 0), (26, 0.0, 17, 0.0, 15, 0.0, 1, 1, 0),
    # outside the article element of a page that has one
    (1, 1.0, 0, 0.0, 1, 1.0, -1, 1, 0), (2, 1.0, 1, 1.0, 2, 1.0, -1, 0, 0), (11, 0.0, 2, 1.0, 9, 0.0, -1, 1, 0),
    (20, 0.0, 64, 0.0, 0, 0.0, -1, 1, 0), (45, 0.0, 30, 0.0, 50, 0.0, -1, 0, 0), (90, 0.02, 40, 0.0, 6, 0.0, -1, 0, 0),
    (6, 0.0, 90, 0.0, 0, 0.0, -1, 0, 0), (60, 0.0, 8, 0.0, 70, 0.0, -1, 1, 0),
    (13, 0.0, 35, 0.0, 26, 0.0, -1, 0, 0), (38, 0.0, 19, 0.0, 41, 0.0, -1, 0, 0), (17, 0.0, 6, 1.0, 11, 0.0, -1, 1, 0),
    (4, 0.0, 51, 0.0, 13, 0.0, -1, 0, 0), (28, 0.1, 60, 0.0, 47, 0.0, -1, 0, 0), (130, 0.0, 25, 0.0, 33, 0.0, -1, 0, 0),
    (9, 1.0, 7, 1.0, 30, 0.0, -1, 1, 0), (52, 0.0, 44, 0.0, 1, 0.0, -1, 1, 0), (5, 0.0, 14, 0.0, 62, 0.0, -1, 0, 0),
    # pages without such an element: long blocks with few links are text, whatever is around them
    (60, 0.0, 8, 0.0, 75, 0.0, 0, 0, 1), (75, 0.1, 60, 0.0, 30, 0.0, 0, 0, 1), (30, 0.0, 75, 0.1, 90, 0.0, 0, 0, 1),
    (18, 0.0, 50, 0.0, 61, 0.0, 0, 0, 1), (12, 0.0, 44, 0.0, 38, 0.0, 0, 0, 1), (22, 0.2, 70, 0.0, 25, 0.0, 0, 0, 1),
    (150, 0.0, 3, 0.0, 4, 0.5, 0, 0, 1), (41, 0.25, 12, 0.0, 2, 1.0, 0, 0, 1), (33, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1),
    (16, 0.0, 0, 0.0, 40, 0.0, 0, 0, 1), (14, 0.0, 2, 1.0, 3, 1.0, 0, 0, 1), (26, 0.0, 3, 1.0, 2, 1.0, 0, 0, 1),
    (48, 0.0, 1, 1.0, 2, 1.0, 0, 0, 1), (11, 0.0, 3, 0.0, 2, 0.0, 0, 0, 1), (13, 0.1, 0, 0.0, 2, 1.0, 0, 0, 1),
    # short ones are beside text: titles above it, headings and short paragraphs within it, captions, credits below it
    (3, 0.0, 2, 1.0, 60, 0.0, 0, 0, 1), (8, 0.0, 2, 1.0, 60, 0.0, 0, 0, 1), (6, 0.0, 48, 0.0, 55, 0.0, 0, 0, 1),
    (4, 0.0, 30, 0.0, 42, 0.0, 0, 0, 1), (1, 0.0, 25, 0.0, 18, 0.0, 0, 0, 1), (5, 0.0, 70, 0.0, 3, 0.0, 0, 0, 1),
    (2, 0.0, 3, 0.0, 64, 0.0, 0, 0, 1), (4, 0.0, 90, 0.0, 0, 0.0, 0, 0, 1), (7, 0.0, 33, 0.0, 2, 1.0, 0, 0, 1),
    (3, 0.0, 0, 0.0, 28, 0.0, 0, 0, 1), (6, 0.0, 12, 0.0, 1, 1.0, 0, 0, 1), (5, 0.0, 2, 1.0, 15, 0.1, 0, 0, 1),
    (4, 0.0, 4, 0.0, 35, 0.0, 0, 0, 1), (2, 0.0, 21, 0.1, 4, 0.0, 0, 0, 1), (1, 0.0, 2, 1.0, 19, 0.0, 0, 0, 1),
    (7, 0.1, 16, 0.0, 11, 0.0, 0, 0, 1), (3, 0.0, 55, 0.0, 3, 1.0, 0, 0, 1), (5, 0.2, 40, 0.0, 27, 0.0, 0, 0, 1),
    # or beside one another: a page of short paragraphs
    (4, 0.0, 3, 0.0, 4, 0.0, 0, 0, 1), (3, 0.0, 0, 0.0, 4, 0.0, 0, 0, 1), (5, 0.0, 4, 0.0, 0, 0.0, 0, 0, 1),
    (4, 0.0, 6, 0.0, 5, 0.0, 0, 0, 1), (2, 0.0, 4, 0.0, 7, 0.0, 0, 0, 1), (6, 0.0, 2, 0.0, 3, 0.0, 0, 0, 1),
    (3, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (5, 0.0, 2, 1.0, 4, 0.0, 0, 0, 1), (4, 0.0, 5, 0.0, 1, 1.0, 0, 0, 1),
    (1, 0.0, 1, 0.0, 1, 0.0, 0, 0, 1), (7, 0.0, 5, 0.0, 6, 0.0, 0, 0, 1), (2, 0.0, 3, 0.0, 2, 0.0, 0, 0, 1),
    # menus and lists of links are not, nor is what stands between links: labels of menus and separators
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0), (2, 1.0, 1, 1.0, 3, 1.0, 0, 0, 0), (3, 1.0, 2, 1.0, 10, 0.9, 0, 0, 0),
    (10, 0.9, 3, 1.0, 8, 1.0, 0, 0, 0), (25, 0.8, 20, 0.9, 18, 0.9, 0, 0, 0), (7, 0.5, 3, 0.5, 2, 1.0, 0, 0, 0),
    (2, 1.0, 60, 0.0, 2, 1.0, 0, 0, 0), (6, 0.7, 80, 0.0, 5, 0.6, 0, 0, 0), (1, 1.0, 4, 0.0, 50, 0.0, 0, 0, 0),
    (12, 0.8, 44, 0.0, 31, 0.0, 0, 0, 0), (3, 1.0, 22, 0.0, 0, 0.0, 0, 0, 0), (16, 1.0, 0, 0.0, 24, 0.0, 0, 0, 0),
    (4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0), (1, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0), (2, 0.0, 3, 1.0, 1, 1.0, 0, 0, 0),
    (5, 0.0, 2, 1.0, 4, 0.9, 0, 0, 0), (3, 0.0, 6, 0.8, 2, 1.0, 0, 0, 0), (6, 0.0, 3, 1.0, 5, 0.7, 0, 0, 0),
    (7, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0), (2, 0.1, 4, 1.0, 8, 1.0, 0, 0, 0), (4, 0.0, 12, 0.9, 10, 0.9, 0, 0, 0),
    (3, 0.0, 1, 1.0, 20, 0.9, 0, 0, 0), (5, 0.1, 15, 0.8, 2, 1.0, 0, 0, 0), (1, 0.0, 2, 1.0, 5, 0.8, 0, 0, 0),
    (14, 1.0, 9, 1.0, 16, 1.0, 0, 0, 0), (30, 0.9, 12, 0.9, 22, 0.9, 0, 0, 0), (18, 0.8, 5, 1.0, 13, 0.9, 0, 0, 0),
    (13, 0.6, 3, 1.0, 2, 1.0, 0, 0, 0), (40, 0.9, 4, 0.0, 6, 1.0, 0, 0, 0), (20, 0.7, 0, 0.0, 11, 0.8, 0, 0, 0),
    # what is set apart is not either
    (30, 0.0, 12, 0.0, 9, 0.0, 0, 1, 0), (60, 0.0, 4, 0.0, 44, 0.0, 0, 1, 0), (40, 0.0, 22, 0.0, 31, 0.0, 0, 1, 0),
    (85, 0.0, 60, 0.0, 70, 0.0, 0, 1, 0), (15, 0.0, 52, 0.0, 66, 0.0, 0, 1, 0), (4, 0.0, 90, 0.0, 0, 0.0, 0, 1, 0),
    (3, 0.0, 41, 0.0, 2, 0.0, 0, 1, 0), (5, 0.0, 3, 0.0, 4, 0.0, 0, 1, 0), (2, 0.0, 0, 0.0, 1, 0.0, 0, 1, 0),
]


def grow(rows: np.ndarray, right: np.ndarray, depth: int = 8, least: int = 2):
    """A decision tree by Gini impurity: a number (the leaf's share of main text) or
    ``(feature, threshold, at or below, above)``; a leaf has ``least`` rows at least."""
    share = right.mean()
    if depth == 0 or share in (0.0, 1.0):
        return float(share)
    best = None
    for k in range(rows.shape[1]):
        cuts = np.unique(rows[:, k])
        for t in (cuts[:-1] + cuts[1:]) / 2:
            low = rows[:, k] <= t
            if min(low.sum(), (~low).sum()) < least:
                continue
            a, b = right[low].mean(), right[~low].mean()
            gini = low.mean() * a * (1 - a) + (~low).mean() * b * (1 - b)
            if best is None or gini < best[0] - 1e-12:
                best = (gini, k, float(t), low)
    if best is None:
        return float(share)
    _, k, t, low = best
    return k, t, grow(rows[low], right[low], depth - 1, least), grow(rows[~low], right[~low], depth - 1, least)


def decide(tree, rows: np.ndarray) -> np.ndarray:
    """Whether each row is main text."""
    if not isinstance(tree, tuple):
        return np.full(len(rows), tree >= 0.5)
    k, t, low, high = tree
    return np.where(rows[:, k] <= t, decide(low, rows), decide(high, rows))


def trained(labelled=LABELLED):
    table = np.array(labelled, dtype=float)
    return grow(table[:, :-1], table[:, -1])


def main_text(html: str | None, tree) -> str:
    """The blocks that the tree calls main text, joined by one space; a null or empty page has none."""
    found = blocks(html) if html else []
    return " ".join(b.text for b, keep in zip(found, decide(tree, features(found))) if keep) if found else ""


def extract(html: Column, labelled=LABELLED) -> Column:
    tree = trained(labelled)

    @F.pandas_udf("string")
    def each(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, tree) for p in pages], dtype=object)

    return each(html)


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``main_text``: the text of the article of each page, from the whole html.

    Null, empty and text-free pages have an empty text.  Unclosed elements end with the element around them,
    unclosed scripts, styles, text areas, titles, frames and comments with the page.  Drawings, objects, buttons,
    lists to select from, templates and the head are no text; where they are unclosed they end by themselves (/>) or
    at the first element that they cannot hold.  Blocks of any length stay whole, repeated pages get equal texts.
    """
    return pages.withColumn("main_text", extract(F.col(html)))
