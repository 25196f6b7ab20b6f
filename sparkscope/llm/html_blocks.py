"""Leaf blocks of HTML pages in page order, with the path of tags above each."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple
from zlib import crc32

# Element names by how they are treated.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split()) | frozenset(
    "math semantics mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable maction mi mn mo mtext ms".split()
)
SPACES = frozenset("br mspace mtr mtd mlabeledtr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template svg annotation annotation-xml iframe object select button textarea canvas audio video title".split()

_ATTRIBUTES = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_MARKUP = re.compile(
    r"<!--(?:.*?-->|.*)"
    rf"|<svg(?=[\s/>]){_ATTRIBUTES}(?<=/)>"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s/>])(?:{_ATTRIBUTES}>|[^>]*+>).*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>{_ATTRIBUTES})>"
    r"|<[!?/][^>]*+>"
    r"|<[a-zA-Z][^>]*+>",
    re.S | re.I,
)
_MARKED = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]{2,}(?![a-z])")
# Elements that have an input of their own.
TAGS = "html body div section article main nav header footer aside form fieldset ul ol li dl dt dd p h1 h2 h3 h4 h5 h6 table tr td th thead tbody caption figure figcaption blockquote pre address details summary dialog menu center".split()
MARKER_SLOTS = 1024
_TAG = {t: i for i, t in enumerate(TAGS)}


class Path(NamedTuple):
    """The elements above a block. Each adds to the one it stands in, so depth costs nothing."""

    slots: frozenset[int]  # of all elements: places in TAGS, then hashed markers
    last: int  # place of the last element in TAGS, or -1
    depth: int


class Block(NamedTuple):
    path: Path
    text: str
    linked: int  # characters inside links


_TOP = Path(frozenset(), -1, 0)
_elements: dict[str, frozenset[int]] = {}


def element(name: str, rest: str) -> frozenset[int]:
    """Slots of an element and all its markers."""
    key = f"{name} {rest}"
    found = _elements.get(key)
    if found is None:
        if len(_elements) > 20_000:
            _elements.clear()
        markers = {p.lower() for m in _MARKED.finditer(rest) for p in _PARTS.findall(m[1] or m[2] or m[3] or "") if len(p) > 1}
        found = _elements[key] = frozenset([*([_TAG[name]] if name in _TAG else []), *(len(TAGS) + crc32(p.encode()) % MARKER_SLOTS for p in markers)])
    return found


def blocks(html: str | None) -> list[Block]:
    """The blocks with text. Comments, raw elements and markup are left out; references are decoded; white space is one space."""
    out: list[Block] = []
    path = [_TOP]
    names: list[str] = []
    opened: dict[str, int] = {}
    text: list[str] = []
    linked = links = at = 0
    html = html or ""

    def close_block():
        nonlocal linked
        if text:
            if whole := " ".join(unescape("".join(text)).split()):
                out.append(Block(path[-1], whole, linked))
            text.clear()
        linked = 0

    def add(piece: str):
        nonlocal linked
        if piece:
            text.append(piece)
            if links:
                linked += len(piece)

    def close_element():
        opened[names[-1]] -= 1
        path.pop()
        return names.pop()

    for m in _MARKUP.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                links = 0 if m["end"] else 1
            continue
        if name in SPACES:
            add(" ")
            continue
        close_block()
        links = 0
        if m["end"]:
            if opened.get(name):
                while close_element() != name:
                    pass
            continue
        while names and (names[-1] == "p" or (names[-1] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"))):
            close_element()
        # What a head may hold is raw or void, so text and other elements come after it, with or without its end tag.
        # A slash before the end of a start tag means nothing in HTML.
        if name in VOID or name == "head":
            continue
        own, above = element(name, m["rest"]), path[-1]
        names.append(name)
        opened[name] = opened.get(name, 0) + 1
        path.append(Path(above.slots if own <= above.slots else above.slots | own, _TAG.get(name, -1), above.depth + 1))
    add(html[at:])
    close_block()
    return out
