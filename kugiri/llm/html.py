"""A forgiving reader of HTML: text blocks with their place in the document tree, and media references, in document order."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>]++)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math head".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr picture source audio video embed object button".split())
#: An element of the key ends open ones of the value.
CLOSES = {t: ("p",) for t in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
CLOSES |= {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table select article section div body blockquote figure".split())
#: The attributes that may hold an element's address, the first that does counts; an address put off until it is looked at goes before a placeholder.
MEDIA = {
    "img": ("src", "data-src", "data-original", "srcset", "data-srcset"), "source": ("src", "srcset", "data-src", "data-srcset"), "video": ("src", "data-src"), "audio": ("src", "data-src"),
    "embed": ("src",), "object": ("data",), "iframe": ("src", "data-src"),
}
SPACE = re.compile(r"\s+")
SRCSET = re.compile(r"[\s,]*(\S*[^\s,])")


class Node:
    """An open block element: its place in the tree by the elements around it, of which it has what they hand down."""

    __slots__ = ("tag", "number", "hint", "parent", "depth", "figure", "caption", "kept")

    def __init__(self, tag: str, number: int, hint: str, parent: Node | None):
        self.tag, self.number, self.hint, self.parent = tag, number, hint, parent
        self.depth = parent.depth + 1 if parent else 1
        self.figure: int = number if tag == "figure" else parent.figure if parent else 0
        self.caption: bool = tag == "figcaption" or tag != "figure" and bool(parent and parent.caption)
        self.kept: dict = {}  # what a reader works out for an element once


@dataclass
class Block:
    """Text of one block element. node: the innermost open block element, None outside any."""

    text: str
    node: Node | None
    linked: int = 0
    seq: int = 0


@dataclass
class Media:
    tag: str
    src: str
    alt: str
    node: Node | None
    seq: int = 0
    attributes: dict = field(default_factory=dict)


def address(tag: str, got: dict[str, str]) -> str:
    """Where an element's media are, whole; of a set of sources the first."""
    found = []
    for name in MEDIA[tag]:
        value = got.get(name, "").strip()
        if name.endswith("srcset") and value:
            m = SRCSET.match(value)
            value = m.group(1) if m else ""
        if value:
            found.append(value)
    return next((v for v in found if v[:5].lower() != "data:"), found[0] if found else "")


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def read(html: str, media: bool = False, nested: bool = False) -> list[Block | Media]:
    """Blocks (and media, those for readers without scripts among them) in document order. Whatever isn't well formed is read as far as it goes; blank blocks are left out."""
    out: list[Block | Media] = []
    stack: list[tuple[str, Node | None]] = []  # with the innermost block element
    opened: Counter = Counter()
    parts: list[str] = []
    ends: dict[str, re.Pattern] = {}
    linked = number = at = anchors = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, stack[-1][1] if stack else None, min(linked, len(text)), len(out)))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal anchors
        for tag, _ in stack[k:]:
            opened[tag] -= 1
            anchors -= tag == "a"
        del stack[k:]

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if anchors:
                linked += len(piece.strip())

    while m := MARK.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        cdata, end, tag, rest, end2, tag2, rest2 = m.groups()
        if cdata is not None:
            text(entities.escape(cdata))
            continue
        if tag is None:
            if tag2 is None:
                continue
            end, tag, rest = end2, tag2, rest2
        tag = tag.lower()
        if tag not in INLINE:
            flush() if tag != "br" else parts.append("\n")
        if end:
            if opened[tag]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if media and tag in MEDIA:
            got = attributes(rest)
            found = [(tag, src)] if (src := address(tag, got)) else []
            if tag == "video" and got.get("poster", "").strip():
                found.insert(0, ("poster", got["poster"].strip()))
            for kind, src in found:
                flush()
                out.append(Media(kind, src, SPACE.sub(" ", got.get("alt") or got.get("title") or "").strip(), stack[-1][1] if stack else None, len(out), got))
        if tag in RAW and not rest.endswith("/"):
            if tag not in ends:
                ends[tag] = re.compile(rf"</{tag}\s*>", re.I)
            done = ends[tag].search(html, at)
            if tag == "head" and not done:
                continue
            if media and tag == "noscript" and not nested:
                flush()
                for x in read(html[at : done.start() if done else len(html)], True, True):
                    if isinstance(x, Media):
                        out.append(Media(x.tag, x.src, x.alt, stack[-1][1] if stack else None, len(out), x.attributes))
            at = done.end() if done else len(html)
            continue
        for other in CLOSES.get(tag, ()):
            for k in range(len(stack) - 1, -1, -1) if opened[other] else ():
                if stack[k][0] == other:
                    close(k)
                    break
                if stack[k][0] in SCOPE:
                    break
        if tag not in VOID and not rest.endswith("/"):
            around = stack[-1][1] if stack else None
            if tag not in INLINE:
                number += 1
                hint = " ".join((got.get("class", ""), got.get("id", ""), got.get("role", ""))).strip().lower() if "=" in rest and (got := attributes(rest)) else ""
                around = Node(tag, number, hint, around)
            stack.append((tag, around))
            opened[tag] += 1
            anchors += tag == "a"
    text(html[at:])
    flush()
    return out
