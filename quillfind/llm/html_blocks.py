"""HTML to leaf blocks: runs of text between block-level tags, each with its tag path."""

from __future__ import annotations

import html
import re
import zlib
from functools import lru_cache

#: Elements that break lines, that have no end tag, and whose content is not text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav noscript ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul video".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = ("script", "style", "template", "svg", "math")
#: An element that starts one of the right closes an open one of the left.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_CLOSES_P = BLOCK_TAGS - {"br", "button", "label", "option", "select", "textarea", "body", "html", "title", "head"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|svg|math)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<([/]?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/a-zA-Z][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[a-z]+")
#: Elements that start only where one that they close may be open, and those past which they do not look.
_CLOSERS = {tag: [left for left, right in CLOSED_BY.items() if tag in right] for tag in {t for right in CLOSED_BY.values() for t in right}}
_FENCES = ("ul", "ol", "table", "dl", "select")
#: Hash buckets of the tags and names of a path.
PATH_BUCKETS = 1024


@lru_cache(maxsize=100_000)
def bucket(word: str, n: int = PATH_BUCKETS) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) * 2654435761 % (1 << 32) * n >> 32


@lru_cache(maxsize=50_000)
def _marks(tag: str, attributes: str) -> tuple[int, ...]:
    """The buckets of an element's tag and of its names."""
    names = [p for v in _NAMES.findall(attributes) for p in _PART.findall(v.lower())] if "=" in attributes else []
    return (bucket("t:" + tag), *(bucket("n:" + x) for x in names))


class Block:
    """A leaf: its text, the buckets of all its ancestors' tags and names and of the two nearest tags, and the length of its text in links."""

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple[int, ...], linked: int) -> None:
        self.text, self.path, self.linked = text, path, linked


class _Open:
    """The open elements, with the places of those that rules look for, so that no rule scans the stack."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[int, ...]]] = []
        self.where: dict[str, list[int]] = {}
        self.closing_p: list[int] = []
        self.marks: dict[int, int] = {}
        self._path: tuple[int, ...] | None = None

    def last(self, tag: str) -> int:
        at = self.where.get(tag)
        return at[-1] if at else -1

    def push(self, tag: str, marks: tuple[int, ...]) -> None:
        self.where.setdefault(tag, []).append(len(self.stack))
        if tag in _CLOSES_P:
            self.closing_p.append(len(self.stack))
        for k in marks:
            self.marks[k] = self.marks.get(k, 0) + 1
        self.stack.append((tag, marks))
        self._path = None

    def cut(self, at: int) -> None:
        """Close all from place at on."""
        while len(self.stack) > at:
            tag, marks = self.stack.pop()
            self.where[tag].pop()
            if tag in _CLOSES_P:
                self.closing_p.pop()
            for k in marks:
                self.marks[k] -= 1
                if not self.marks[k]:
                    del self.marks[k]
        self._path = None

    def path(self) -> tuple[int, ...]:
        if self._path is None:
            near = {bucket(f"u{up}:{tag}") for up, (tag, _) in enumerate(reversed(self.stack[-2:]))}
            self._path = tuple(near | self.marks.keys())
        return self._path


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, without empty ones. Broken markup never fails, and time follows its length.

    White space of any kind, that of character references too, becomes one space.
    """
    out: list[Block] = []
    opened = _Open()
    held: list[str] = []
    linked = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(Block(text, opened.path(), linked))
            held.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            held.append(piece)
            if opened.stack and opened.stack[-1][0] == "a":
                linked += len(piece)
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK_TAGS:
            flush()
        if m[2]:
            if opened.last(tag) >= 0:
                opened.cut(opened.last(tag))
            continue
        if tag in VOID_TAGS:
            continue
        if tag in _CLOSES_P and opened.closing_p and opened.stack[opened.closing_p[-1]][0] == "p":
            opened.cut(opened.closing_p[-1])
        if tag in _CLOSERS:
            found = max(map(opened.last, _CLOSERS[tag]))
            if found > max(map(opened.last, _FENCES)):
                opened.cut(found)
        opened.push(tag, _marks(tag, m[4]))
    if at < len(page):
        held.append(page[at:])
    flush()
    return out
