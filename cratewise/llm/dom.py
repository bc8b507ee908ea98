"""Leaf blocks of a web page: runs of text between block-level tags, with the tags they stand in."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# Elements of the HTML standard, by how they lay out text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html iframe label legend li main menu nav object ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul video audio".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their contents are no markup and no text.
RAW_TAGS = frozenset("script style title textarea".split())
#: An opening tag closes an open one of its group, or an open paragraph, unless a scope stands between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table tbody thead tfoot div section article aside nav header footer main form blockquote body".split())
SPACED_TAGS = frozenset("br img input wbr".split())
#: Tags of running text; with the others, all that a block tells of.
INLINE_TAGS = frozenset("a b i em strong span font u small".split())
TOLD_TAGS = BLOCK_TAGS | INLINE_TAGS | frozenset("code sub sup q cite time mark kbd abbr del ins svg math noscript template iframe".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A slash that belongs to a value without quotes closes nothing.
_OWN_SLASH = re.compile(r"=[^\s\"']*/\Z")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    tags: tuple[str, ...]  # distinct open tags, outermost first
    words: frozenset[str] = field(default_factory=frozenset)  # of their classes, ids and roles
    last: str = "none"  # the innermost tag that is not of running text


def _names(attributes: str) -> frozenset[str]:
    """The words of an element's class, id and role, in lower case and without a plural s."""
    found = set()
    for m in _NAMES.finditer(attributes):
        for w in _WORD.findall(next(x for x in m.groups() if x is not None)):
            w = w.lower()
            found.add(w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w)
    return frozenset(found)


def blocks(html: str, telling: frozenset[str] | None = None) -> list[Block]:
    """The non-empty blocks of a page in order; scripts, styles, titles and comments are no text.

    Works on any string: unclosed, crossed and cut-off tags end where their surroundings do. Open tags and the words
    of their names (only those in ``telling``, if given) are counted beside the stack, so a block costs the same at any depth.
    """
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str], str]] = []
    open_tags: dict[str, int] = {}
    open_words: dict[str, int] = {}
    parts: list[str] = []
    endless: set[str] = set()  # raw tags that have no end from here on
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            tags = tuple(t for t in open_tags if t in TOLD_TAGS)
            out.append(Block(text, min(linked, len(text)), tags, frozenset(open_words), stack[-1][2] if stack else "none"))
        linked = 0

    def push(name: str, words: frozenset[str]) -> None:
        last = name if name not in INLINE_TAGS and name != "html" else stack[-1][2] if stack else "none"
        stack.append((name, words, last))
        open_tags[name] = open_tags.get(name, 0) + 1
        for w in words:
            open_words[w] = open_words.get(w, 0) + 1

    def pop() -> str:
        name, words, _ = stack.pop()
        for counts, keys in ((open_tags, (name,)), (open_words, words)):
            for key in keys:
                counts[key] -= 1
                if not counts[key]:
                    del counts[key]
        return name

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.match(html, at)
        at = m.end()
        name = m[2]
        if name is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                # a tag that the end of the page cuts off is no text
                if piece == "<" and re.match(r"<[a-zA-Z/!]", html[m.start() : m.start() + 2]):
                    rest = html.find(">", at)
                    at = size if rest < 0 else rest + 1
                    continue
                piece = unescape(piece)
                parts.append(piece)
                if "a" in open_tags:
                    linked += len(piece.strip())
            continue
        name = name.lower()
        if m[1]:
            if name in open_tags:
                if name in BLOCK_TAGS:
                    flush()
                while pop() != name:
                    pass
            continue
        if name in RAW_TAGS:
            end = None if name in endless else re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(html, at)
            if end:
                at = end.end()
            else:  # what follows is not swallowed
                endless.add(name)
            continue
        if name in BLOCK_TAGS:
            flush()
            closes = CLOSES.get(name, {"p"})
            for k in range(len(stack) - 1, -1, -1) if any(t in open_tags for t in closes) else ():
                if stack[k][0] in closes:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in SCOPES:
                    break
        elif name in SPACED_TAGS:
            parts.append(" ")
        if name not in VOID_TAGS and not (m[3].endswith("/") and not _OWN_SLASH.search(m[3][-200:])):
            words = _names(m[3]) if "=" in m[3] and name not in ("html", "body") else frozenset()
            push(name, words if telling is None else words & telling)
    flush()
    return out
