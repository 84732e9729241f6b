"""Block-level trees of HTML pages, as far as text extraction needs them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

_s = lambda text: frozenset(text.split())
#: Elements whose text is never read as markup.
RAW = _s("script style textarea title xmp iframe noembed noframes plaintext")
#: Of these, elements whose text a page shows as it is.
SHOWN_RAW = _s("xmp plaintext")
#: Elements that are left out with all that they hold, whatever the model says: scripts, styles, the head, frames, and controls of forms.
DROPPED = (RAW - SHOWN_RAW) | _s("head select option button datalist input")
VOID = _s("area base br col embed hr img input link meta param source track wbr")
#: Elements that run inside a line of text; all others are blocks.
INLINE = _s(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr br img math svg object audio video canvas map picture source track"
)
#: Inside these every element runs inside the line.
FOREIGN = _s("math svg")
#: A paragraph ends where one of these begins.
ENDS_PARAGRAPH = _s(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre section summary table ul"
)
#: An open element of the value ends where the key begins, unless a list or table lies between.
ENDS_SAME = {"li": _s("li"), "dd": _s("dd dt"), "dt": _s("dd dt"), "tr": _s("tr td th"), "td": _s("td th"), "th": _s("td th"), "tbody": _s("tr td th thead tbody tfoot"), "tfoot": _s("tr td th thead tbody"), "body": _s("head")}
SCOPES = _s("ul ol dl table html body article section div")


@dataclass
class Tree:
    """Blocks in page order; a parent stands before its children. ``lines`` are (node, text) in page order."""

    tags: list[str] = field(default_factory=lambda: ["html"])
    names: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    parents: list[int] = field(default_factory=lambda: [-1])
    labels: list[int | None] = field(default_factory=lambda: [None])
    text: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    lines: list[tuple[int, str]] = field(default_factory=list)


def _attributes(source: str, labelled: bool) -> tuple[tuple[str, ...], int | None]:
    """Words of class, id and role, and in labelled pages the label, if any."""
    words: list[str] = []
    label = None
    for name, value in _ATTRIBUTE.findall(source):
        name = name.lower()
        if name in ("class", "id", "role", "aria-label"):
            words += [w.lower() for w in _NAME_PART.findall(unescape(value.strip("\"'")))]
        elif labelled and name == "data-label":
            label = int(value.strip("\"'"))
    return tuple(dict.fromkeys(words)), label


class _Open:
    """The open elements, and where each tag stands among them."""

    def __init__(self) -> None:
        self.tags, self.blocks, self.left_out = ["html"], [0], [False]
        self.at: dict[str, list[int]] = {}

    def push(self, tag: str, block: int, left_out: bool) -> None:
        self.at.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)
        self.blocks.append(block)
        self.left_out.append(left_out)

    def pop(self) -> str:
        tag = self.tags.pop()
        self.at[tag].pop()
        self.blocks.pop()
        self.left_out.pop()
        return tag

    def last(self, tags: frozenset[str]) -> int:
        """The innermost open element of these tags; 0 if there is none."""
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=0)


def parse(html: str, labelled: bool = False) -> Tree:
    """The tree of a page; anything can be parsed, in time in proportion to its length. White space of a line is one blank each.

    Only with ``labelled``, for training, are labels read from ``data-label``.
    """
    tree = Tree()
    stack = _Open()
    links = foreign = 0
    parts: list[str] = []
    at = 0

    def end_line() -> None:
        if parts:
            line = " ".join("".join(parts).split())
            parts.clear()
            if line:
                tree.lines.append((stack.blocks[-1], line))

    def take(source: str, plain: bool = False) -> None:
        if source and not stack.left_out[-1]:
            source = source if plain else unescape(source)
            parts.append(source)
            n = len(source) - source.count(" ")
            tree.text[stack.blocks[-1]] += n
            if links:
                tree.linked[stack.blocks[-1]] += n

    def pop(k: int) -> None:
        nonlocal links, foreign
        if any(t not in INLINE and not foreign for t in stack.tags[k:]):
            end_line()
        while len(stack.tags) > k:
            tag = stack.pop()
            links -= tag == "a"
            foreign -= tag in FOREIGN

    def close(wanted: frozenset[str], scopes: frozenset[str]) -> None:
        k = stack.last(wanted)
        if k and k >= stack.last(scopes):
            pop(k)

    while m := _TOKEN.search(html, at):
        take(html[at : m.start()])
        at = m.end()
        if m[1] is not None:
            take(m[1], plain=True)
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            if tag == "p" and not stack.last(frozenset("p")):
                end_line()
            close(frozenset((tag,)), frozenset() if tag not in INLINE else _s("table article section body"))
            continue
        if foreign:
            if tag not in VOID and not m[4].endswith("/"):
                foreign += tag in FOREIGN
                links += tag == "a"
                stack.push(tag, stack.blocks[-1], stack.left_out[-1] or tag in DROPPED)
            continue
        if tag in ENDS_PARAGRAPH:
            close(_s("p"), _s("table button"))
        if tag in ENDS_SAME:
            while len(stack.tags) > 1 and stack.tags[-1] in INLINE | {"p"} and stack.last(ENDS_SAME[tag]):
                pop(len(stack.tags) - 1)
            if tag in ("tr", "tbody", "tfoot"):
                while stack.tags[-1] in ENDS_SAME[tag]:
                    pop(len(stack.tags) - 1)
            else:
                close(ENDS_SAME[tag], SCOPES - ENDS_SAME[tag])
        if tag == "br":
            parts.append(" ")
        if tag not in INLINE:
            end_line()
        if tag in VOID:
            continue
        if tag == "html":
            tree.names[0], tree.labels[0] = _attributes(m[4], labelled)
            continue
        words, label = _attributes(m[4], labelled) if m[4] else ((), None)
        dropped = stack.left_out[-1] or tag in DROPPED
        block = stack.blocks[-1]
        if tag not in INLINE and not dropped:
            tree.tags.append(tag)
            tree.names.append(words)
            tree.parents.append(block)
            tree.labels.append(label)
            tree.text.append(0)
            tree.linked.append(0)
            block = len(tree.tags) - 1
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            if tag in SHOWN_RAW and not dropped:
                stack.push(tag, block, False)
                take(html[at : end.start() if end else len(html)], plain=True)
                pop(len(stack.tags) - 1)
            at = end.end() if end else len(html)
            continue
        if m[4].endswith("/") and tag in FOREIGN:
            continue
        links += tag == "a"
        foreign += tag in FOREIGN
        stack.push(tag, block, dropped)
    take(html[at:])
    end_line()
    return tree
