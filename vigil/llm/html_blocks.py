"""Leaf blocks of HTML pages, with the features that the page model reads.

A block is the text between two boundaries of block elements.  Its features come
from its ancestors' tags and the words of their classes, ids and roles, from its
text, and from its place on the page.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np

#: Elements of HTML.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html iframe legend li main menu nav noframes ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
AREAS = frozenset("article main nav aside header footer form section".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template title head iframe object textarea select option svg math canvas audio video".split())
#: Elements that an opening element of the key ends, if they are the innermost block.
CLOSES = {
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"),
    "option": ("option",), "thead": ("p",), "tbody": ("thead", "tr", "td", "th", "p"), "tfoot": ("tbody", "tr", "td", "th", "p"),
}
_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"[a-z]+")


class Blocks(HTMLParser):
    """Collects (text, ancestors, share of the text in links) of each block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.found: list[tuple[str, tuple[tuple[str, tuple[str, ...]], ...], float]] = []
        self.parts: list[str] = []
        self.linked = self.links = self.unseen = 0

    def flush(self):
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.found.append((text, tuple(self.stack), min(1.0, self.linked / len(text))))
            self.parts = []
        self.linked = 0

    def pop(self, to: int):
        for tag, _ in self.stack[to:]:
            self.links -= tag == "a"
            self.unseen -= tag in UNSEEN
        del self.stack[to:]

    def handle_starttag(self, tag, attrs):
        if tag == "body" and self.unseen:  # a head that isn't closed ends here
            self.flush()
            self.pop(next((i for i, x in enumerate(self.stack) if x[0] == "head"), len(self.stack)))
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCK:
            self.flush()
            ends = CLOSES.get(tag, ("p",))
            for i in range(len(self.stack) - 1, -1, -1):
                name = self.stack[i][0]
                if name in ends:
                    self.pop(i)
                elif name in BLOCK:
                    break
        if tag not in VOID:
            names = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "aria-label", "itemprop"))
            hidden = any(k == "hidden" or (k == "style" and v and re.search(r"display\s*:\s*none", v)) for k, v in attrs)
            self.stack.append((tag, tuple(_TOKEN.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower())) + ("hidden",) * hidden))
            self.links += tag == "a"
            self.unseen += tag in UNSEEN

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name == tag:
                self.pop(i)
                return
            if name in BLOCK and tag not in BLOCK:  # inline elements don't end across blocks
                return

    def handle_data(self, data):
        if not self.unseen:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def blocks(html: str) -> list[tuple[str, tuple, float]]:
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.found


SIZE = 1 << 13


@lru_cache(1 << 16)
def _slot(name: str) -> int:
    h = 2166136261
    for b in name.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % SIZE


def features(found: list[tuple[str, tuple, float]]) -> list[np.ndarray]:
    """The indices of each block's features, hashed."""
    out, n = [], len(found)
    for i, (text, above, linked) in enumerate(found):
        names = {"bias", f"place {min(9, 10 * i // max(1, n))}"}
        for depth, (tag, tokens) in enumerate(reversed(above)):
            names.add(f"in {tag}")
            if depth < 2:
                names.add(f"under {depth} {tag}")
            names.update(f"named {t}" for t in tokens)
        words = text.split(" ")
        if n == 1:
            names.add("alone")
        area = next((tag for tag, _ in reversed(above) if tag in AREAS), "none")
        names |= {f"area {area}", f"area {area} linked {int(4 * linked)}", f"area {area} words {min(8, len(words).bit_length())}", f"area {area} ends {text[-1] in '.!?'}"}
        names.add(f"words {min(8, len(words).bit_length())}")
        names.add(f"linked {int(4 * linked)}")
        names.add("ends" if text[-1] in ".!?\"'»”…:" else "open")
        names.add(f"points {min(3, sum(text.count(c) for c in '.,;!?'))}")
        names.add("sign" if re.search(r"[©®™»›•·]", text) else "plain")
        names.add(f"digits {min(3, 8 * sum(c.isdigit() for c in text) // len(text))}")
        names.update(f"word {w}" for w in _TOKEN.findall(text.lower()) if w in TELLING)
        out.append(np.array(sorted({_slot(x) for x in names})))
    return out


#: Words that tell what a block is, in English.
TELLING = frozenset(
    "about accept account ad advert advertisement all archive by categories click close comment comments consent contact continue cookie cookies copyright "
    "email facebook follow help home imprint legal like links login logout menu more newsletter next now policy popular posted prev previous privacy read "
    "register related replies reply reserved rights search settings share sign site skip sponsored subscribe tags terms to top twitter update view".split()
)
