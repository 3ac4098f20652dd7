"""HTML to the sequence of its text blocks, each with its path of tags and names.

A block is text between two boundaries of block elements; inline elements don't cut it
and <br> does.  Scripts, styles and what else is not text of the page are left out.
White space becomes one space, character references are decoded.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np

#: Elements inside a line, elements without content, and elements whose content is no text of the page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr button input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style head noscript template iframe svg math object canvas audio video select textarea title".split())
#: Of SILENT, those that without an end tag go on to the end of the page, as in browsers.
RAW = frozenset("script style textarea title".split())
#: An opening tag of the value ends an open element of the key.
CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|[^<]++|<""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|style|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Widths of the hashed path, the hashed names of the nearest elements, the hashed words, and the measures.
PATH, NEAR, WORDS, NUMBERS = 128, 96, 32, 8
WIDTH = PATH + NEAR + WORDS + NUMBERS
#: So many block elements around a text are its nearest.
NEAREST = 3


@dataclass
class Block:
    text: str
    links: int
    path: np.ndarray
    near: np.ndarray


class _Element:
    __slots__ = ("block", "names", "parent", "path", "tag")

    def __init__(self, tag: str, names: tuple[str, ...], parent: _Element | None):
        self.tag, self.names, self.parent, self.path = tag, names, parent, None
        self.block = parent.block if tag in INLINE and parent is not None else self

    def vector(self) -> np.ndarray:
        todo, e = [], self
        while e is not None and e.path is None:
            todo.append(e)
            e = e.parent
        v = np.zeros(PATH, np.float32) if e is None else e.path
        for e in reversed(todo):
            v = v.copy()
            for name in e.names:
                h = zlib.crc32(name.encode())
                v[h % PATH] += 1.0 if h & 0x10000 else -1.0
            e.path = v
        return v

    def near(self) -> np.ndarray:
        v, e = np.zeros(NEAR, np.float32), self.block
        for n in range(NEAREST):
            for name in e.names:
                h = zlib.crc32(b"near" + name.encode())
                v[h % NEAR] += (1.0 if h & 0x10000 else -1.0) * (NEAREST - n) / NEAREST
            if e.parent is None:
                break
            e = e.parent.block
        return v


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    out = ["t:" + tag]
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            value, kind = m[2] or m[3] or m[4] or "", m[1].lower()
            if kind == "style":
                if re.search(r"display\s*:\s*none", value, re.I):
                    out.append("c:hidden")
            elif kind in ("hidden", "aria-hidden"):
                if value.lower() != "false":
                    out.append("c:hidden")
            else:
                out += ["c:" + x.lower() for x in _NAME.findall(value)]
    return tuple(dict.fromkeys(out))


def blocks(page: str | None) -> list[Block]:
    """All text blocks in page order; null or empty: none."""
    page = page or ""
    out: list[Block] = []
    stack: list[_Element] = [_Element("", (), None)]
    is_open: Counter[str] = Counter()
    parts: list[str] = []
    at: _Element | None = None
    links = in_link = pos = 0

    def flush() -> None:
        nonlocal parts, at, links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                e = at or stack[-1]
                out.append(Block(text, links, e.vector(), e.near()))
            parts, at, links = [], None, 0

    endless = set()  # tags without an end in the rest of the page
    while pos < len(page):
        m = _TOKEN.match(page, pos)
        pos = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                parts.append(m[0])
                if not m[0].isspace():
                    at = at or stack[-1]
                    links += len(m[0]) * (in_link > 0)
            continue
        tag = tag.lower()
        if m[1]:
            if is_open[tag]:
                if tag not in INLINE:
                    flush()
                while True:
                    gone = stack.pop().tag
                    is_open[gone] -= 1
                    in_link -= gone == "a"
                    if gone == tag:
                        break
            elif tag not in INLINE:
                flush()
            continue
        if tag in SILENT and not m[3].endswith("/"):
            flush()
            # A head without an end stops at the body.
            end = None if tag in endless else re.compile(rf"</{tag}\s*>" + ("|(?=<body[\\s>])" if tag == "head" else ""), re.I).search(page, pos)
            if end:
                pos = end.end()
            elif tag in RAW:
                pos = len(page)
            else:
                endless.add(tag)
            continue
        if tag not in INLINE:
            flush()
            closes = CLOSES.get(tag, frozenset()) | {"p"}
            for i in range(len(stack) - 1, max(0, len(stack) - 8), -1):
                if stack[i].tag in closes:
                    in_link -= sum(e.tag == "a" for e in stack[i:])
                    is_open.subtract(e.tag for e in stack[i:])
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE and stack[i].tag not in ("li", "td", "th", "dd", "dt"):
                    break
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(_Element(tag, _names(tag, m[3]), stack[-1]))
            is_open[tag] += 1
            in_link += tag == "a"
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """(blocks, WIDTH): tag path, hashed words, and measures of each block."""
    x = np.zeros((len(found), WIDTH), np.float32)
    for i, b in enumerate(found):
        words = b.text.split()
        x[i, :PATH] = np.clip(b.path, -3, 3)
        counts = np.bincount([zlib.crc32(w.lower().encode()) % WORDS for w in words], minlength=WORDS)
        x[i, PATH : PATH + NEAR] = 2 * b.near
        x[i, PATH + NEAR : -NUMBERS] = counts / np.sqrt(len(words))
        n = len(b.text)
        ends = sum(b.text.count(c) for c in ".!?")
        x[i, -NUMBERS:] = np.log1p(n) / 5, np.log1p(len(words)) / 4, min(1.0, b.links / n), min(1.0, 5 * ends / len(words)), b.text[-1] in ".!?\"'”»", sum(c.isdigit() for c in b.text) / n, i / len(found), b.text[0].isupper()
    return x
