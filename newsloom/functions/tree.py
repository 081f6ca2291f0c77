"""A page as a tree of elements, and selectors for tags, classes, ids, attributes and descendants.

The standard parser gives the events; elements without an end tag are closed by what stands around them.
Selectors are the part of CSS that page rules need: ``time[datetime]``, ``meta[property='x']``,
``[data-name="y"]``, ``table.bar``, ``#id``, descendants (a space), children (``>``), lists (a comma).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

#: Elements that never have an end tag: fixed values of HTML.
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])


@dataclass
class Element:
    tag: str
    given: dict[str, str]
    above: Element | None = None
    below: list[Element | str] = field(default_factory=list)

    def walk(self) -> Iterator[Element]:
        """The elements below, in the order of the page."""
        waiting = [x for x in reversed(self.below) if isinstance(x, Element)]
        while waiting:
            one = waiting.pop()
            yield one
            waiting += [x for x in reversed(one.below) if isinstance(x, Element)]

    def texts(self) -> Iterator[str]:
        """The texts below, in the order of the page."""
        waiting: list[Element | str] = list(reversed(self.below))
        while waiting:
            one = waiting.pop()
            if isinstance(one, str):
                yield one
            else:
                waiting += reversed(one.below)

    def text(self, between: str = "") -> str:
        """Its texts without white space around them, joined."""
        return between.join(t for t in map(str.strip, self.texts()) if t)

    def remove(self) -> None:
        if self.above is not None:
            self.above.below = [x for x in self.above.below if x is not self]
            self.above = None

    def all(self, selector: str) -> list[Element]:
        chains = parsed(selector)
        return [e for e in self.walk() if any(fits(e, chain, self) for chain in chains)]

    def first(self, selector: str) -> Element | None:
        chains = parsed(selector)
        return next((e for e in self.walk() if any(fits(e, chain, self) for chain in chains)), None)


#: ("start", tag, attributes), ("end", tag, {}) or ("text", text, {}).
Event = tuple[str, str, dict[str, str | None]]


class Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[Event] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.events.append(("start", tag, dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        self.events.append(("end", tag, {}))

    def handle_data(self, data: str) -> None:
        self.events.append(("text", data, {}))


def page_events(page: str | None) -> list[Event]:
    """What the standard parser finds in a page, in its order, whatever was opened or closed before."""
    reader = Reader()
    reader.feed(page or "")
    reader.close()
    return reader.events


def page_tree(page: str | None) -> Element:
    """The elements of a page below an element without a tag. An end tag closes the nearest element of its tag and
    all that is open in it; one without an open element is left out."""
    root = at = Element("", {})
    for kind, said, given in page_events(page):
        if kind == "text":
            at.below.append(said)
        elif kind == "start":
            one = Element(said, {k: v or "" for k, v in given.items()}, at)
            at.below.append(one)
            at = at if said in VOID else one
        else:
            one = at
            while one is not None and one.tag != said:
                one = one.above
            at = at if one is None or one is root else one.above
    return root


#: A test of an element: by its tag, and by attributes (name, how the value is compared, value).
Simple = tuple[str, tuple[tuple[str, str, str], ...]]
PIECE = re.compile(
    r"""\s*(?P<comma>,)\s*|\s*(?P<child>>)\s*|(?P<below>\s+)|(?P<tag>[A-Za-z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"""
    r"""|\[\s*(?P<name>[\w:-]+)\s*(?:(?P<how>[~|^$*]?=)\s*(?:'(?P<one>[^']*)'|"(?P<two>[^"]*)"|(?P<bare>[^\]\s]+))\s*)?\]"""
)


@lru_cache(maxsize=256)
def parsed(selector: str) -> tuple[tuple[tuple[str, Simple], ...], ...]:
    """Chains of (how it stands to the one before: '', ' ' or '>', test), from the outermost to the element itself."""
    chains: list[list[tuple[str, str, list]]] = [[("", "*", [])]]
    at, selector = 0, selector.strip()
    fresh = True
    while at < len(selector):
        m = PIECE.match(selector, at)
        if m is None:
            raise ValueError(f"no selector: {selector!r}")
        at = m.end()
        if m["comma"] or m["child"] or m["below"]:
            if fresh:
                raise ValueError(f"no selector: {selector!r}")
            if m["comma"]:
                chains.append([("", "*", [])])
            else:
                chains[-1].append((">" if m["child"] else " ", "*", []))
            fresh = True
            continue
        how, tag, tests = chains[-1][-1]
        if m["tag"]:
            if not fresh:
                raise ValueError(f"no selector: {selector!r}")
            tag = m["tag"].lower()
        elif m["id"]:
            tests = [*tests, ("id", "=", m["id"])]
        elif m["cls"]:
            tests = [*tests, ("class", "~=", m["cls"])]
        else:
            value = next((v for v in (m["one"], m["two"], m["bare"]) if v is not None), "")
            tests = [*tests, (m["name"].lower(), m["how"] or "", value)]
        chains[-1][-1] = (how, tag, tests)
        fresh = False
    if fresh:
        raise ValueError(f"no selector: {selector!r}")
    return tuple(tuple((how, (tag, tuple(tests))) for how, tag, tests in chain) for chain in chains)


def passes(element: Element, test: Simple) -> bool:
    tag, attributes = test
    if tag not in ("*", element.tag):
        return False
    for name, how, value in attributes:
        own = element.given.get(name)
        if own is None:
            return False
        good = {
            "": True,
            "=": own == value,
            "~=": value in own.split(),
            "|=": own == value or own.startswith(f"{value}-"),
            "^=": bool(value) and own.startswith(value),
            "$=": bool(value) and own.endswith(value),
            "*=": bool(value) and value in own,
        }[how]
        if not good:
            return False
    return True


def fits(element: Element, chain: tuple[tuple[str, Simple], ...], top: Element) -> bool:
    """Whether the last test of the chain holds for the element, and the others for what it stands in, below ``top``."""
    if not passes(element, chain[-1][1]):
        return False
    if len(chain) == 1:
        return True
    above, how = element.above, chain[-1][0]
    while above is not None and above is not top:
        if fits(above, chain[:-1], top):
            return True
        if how == ">":
            return False
        above = above.above
    return False
