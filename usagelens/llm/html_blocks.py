"""The leaf blocks of a web page: what stands between two borders of block elements.

One pass over the markup with a stack of open elements. Inline elements do not end a block, a
line break is white space, scripts, styles, titles, comments and declarations hold no text.
End tags that HTML lets authors leave out are implied; stray ones are passed over; an
unfinished tag or comment takes the rest of the page, as in browsers.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from dataclasses import dataclass

# Attributes: a quote counts only behind an equals sign and if it is closed.
_ATTRS = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+"""
_MARKUP = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)({_ATTRS})(>|\Z)|</[^>]*+(?:>|\Z)", re.S
)
_NAMED = re.compile(r"""\b(class|id|role|itemprop|data-mark)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym area b bdi bdo big br cite code data del dfn em embed font i img input ins kbd link map mark meta "
    "nobr param picture q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr".split()
)
RAW = frozenset("script style title iframe noembed noframes xmp template svg math".split())
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an element ends when it starts, and what it does not look beyond.
_IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("table tr".split())),
    "th": (frozenset("td th".split()), frozenset("table tr".split())),
    "tbody": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tr td th".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_P_SCOPE = frozenset("td th caption table button object".split())
_TABLE = frozenset("table thead tbody tfoot tr td th caption".split())
#: Of a path, so many outer and inner elements are described.
OUTER, INNER = 8, 16
BUCKETS = 2048


def bucket(token: str) -> int:
    """The place of a path token; the same on every machine."""
    return zlib.crc32(token.encode()) % BUCKETS


@dataclass(slots=True)
class Block:
    """A block's text, the buckets of its tag path, its leaf element, and what is in it."""

    text: str
    path: tuple[int, ...]
    leaf: str
    linked: int
    inline: frozenset[str]
    mark: str


class _Element:
    __slots__ = ("mark", "name", "tokens")

    def __init__(self, name: str, tokens: tuple[int, ...], mark: str) -> None:
        self.name, self.tokens, self.mark = name, tokens, mark


_KNOWN: dict[tuple[str, str], tuple[tuple[int, ...], str]] = {}


def _described(name: str, attrs: str) -> tuple[tuple[int, ...], str]:
    """Buckets of the element's name and the words of its names, and its mark."""
    key = (name, attrs)
    if key in _KNOWN:
        return _KNOWN[key]
    words, mark = [f"<{name}"], ""
    for found in _NAMED.finditer(attrs):
        value = found[2] or found[3] or found[4] or ""
        if found[1].lower() == "data-mark":
            mark = value
        else:
            words += [f".{w.lower()}" for w in _PART.findall(value)]
    if _HIDDEN.search(attrs):
        words.append("hidden")
    own = tuple(dict.fromkeys(bucket(w) for w in words))
    if len(_KNOWN) > 20_000:
        _KNOWN.clear()
    _KNOWN[key] = (own, mark)
    return own, mark


@functools.lru_cache(4096)
def _below(above: str, name: str) -> int:
    """The bucket of an element in its parent: a header of an article is none of the page."""
    return bucket(f"{above}>{name}")


def blocks(page: str | None) -> list[Block]:
    """All blocks with text, in page order."""
    found: list[Block] = []
    if not page:
        return found
    stack: list[_Element] = []
    opened: dict[str, int] = {}
    pieces: list[str] = []
    inline: set[str] = set()
    linked, link = 0, -1  # link: the depth at which a link opened

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                own = stack if len(stack) <= OUTER + INNER else stack[:OUTER] + stack[-INNER:]
                path = tuple(t for e in own for t in e.tokens)
                mark = next((e.mark for e in reversed(own) if e.mark), "")
                found.append(Block(text, path, own[-1].name if own else "", linked, frozenset(inline), mark))
            pieces.clear()
        inline.clear()
        if link >= 0:
            inline.add("a")
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal link
        for e in stack[depth:]:
            opened[e.name] -= 1
        del stack[depth:]
        if link > depth:
            link = -1

    def end(names: frozenset[str], barrier: frozenset[str]) -> None:
        """Closes the innermost element of these names, unless a barrier is nearer."""
        if any(opened.get(n) for n in names):
            for depth in range(len(stack) - 1, -1, -1):
                name = stack[depth].name
                if name in names:
                    pop_to(depth)
                    return
                if name in barrier:
                    return

    at, size = 0, len(page)
    while at < size:
        m = _MARKUP.search(page, at)
        stop = m.start() if m else size
        if stop > at:
            text = page[at:stop]
            if "&" in text:
                text = html.unescape(text)
            pieces.append(text)
            if link >= 0:
                linked += len(text)
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name or not m[4]:  # a comment or declaration; a tag that the page ends in
            continue
        name = name.lower()
        # inserted text with a class is how some pages mark adverts
        boxed = name == "ins" and (opened.get("ins") if m[1] else "class" in m[3])
        if name in INLINE and not boxed:
            if name == "br":
                pieces.append(" ")
            elif name == "a":
                link = -1 if m[1] else len(stack)
            if not m[1]:
                inline.add(name)
            continue
        if m[1]:
            if name in RAW or name in ("body", "html"):
                continue
            flush()
            names = _HEADINGS if name in _HEADINGS else frozenset([name])
            end(names, frozenset() if name in _TABLE else _P_SCOPE - {name})
            continue
        if name in RAW:
            if not m[3].endswith("/") or name not in ("svg", "math"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else size
            continue
        flush()
        if name in _ENDS_P:
            end(frozenset(["p"]), _P_SCOPE)
        if name in _HEADINGS and stack and stack[-1].name in _HEADINGS:
            pop_to(len(stack) - 1)
        if name in _IMPLIED:
            names, barrier = _IMPLIED[name]
            while any(opened.get(n) for n in names):
                before = len(stack)
                end(names, barrier)
                if len(stack) == before:
                    break
        if name in VOID or (name == "body" and opened.get("body")):
            continue
        if name == "body" and opened.get("head"):
            end(frozenset(["head"]), frozenset())
        tokens, mark = _described(name, m[3])
        above = stack[-1].name if stack else ""
        stack.append(_Element(name, (*tokens, _below(above, name)), mark))
        opened[name] = opened.get(name, 0) + 1
    flush()
    return found
