"""Lenient HTML reading: a flat list of elements and text pieces, in page order."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Element names by how they behave.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template textarea title iframe".split())
# Elements with a language of their own, in which "/>" closes any tag.
FOREIGN = {"svg", "math"}
BLOCKS = set(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
# A start tag of the left ends an open element of the right.
_ENDS_P = BLOCKS - {"body", "head", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "summary", "figcaption", "dd", "dt", "li"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
         "option": {"option"}}
# Start tags that end an open foreign element, and the elements in it that hold HTML again.
_ENDS_FOREIGN = BLOCKS | set("b big br center code em embed font i img listing nobr ruby s small span strike strong sub sup tt u var".split())
_HOLDS_HTML = set("foreignobject desc mi mo mn ms mtext annotation-xml".split())
# In a formula or a drawing, parts that stand apart: those of the left, and these elements themselves.
_APART = set("mfrac mroot msub msup msubsup munder mover munderover mmultiscripts mtr mtable semantics".split())
_APART_SELF = {"text", "annotation"}
_NONE: set[str] = set()
_SCOPE = set("ul ol dl table tbody thead tfoot select article section div aside nav main body".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+)")


@dataclass(slots=True)
class Element:
    """One element: its tag, attributes, parent (an index, -1: none), depth and end."""

    tag: str
    attributes: str
    parent: int
    depth: int
    start: int
    end: int = 0


@dataclass
class Page:
    """Elements in page order and text pieces (element, decoded text)."""

    elements: list[Element]
    texts: list[tuple[int, str]]


def attributes_of(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(raw)}


def read(source: str) -> Page:
    """The elements and texts of a page; whatever is left open ends with the page.

    Content of scripts, styles and the like is no text; that of formulas, drawings,
    objects and noscript is.  Broken markup never fails: stray end tags are skipped,
    a tag cut off by the end of the page is a tag, and a formula or drawing left open
    ends at the next HTML element.  A drawing without text is one element.
    """
    elements = [Element("#root", "", -1, 0, 0)]
    texts: list[tuple[int, str]] = []
    stack = [0]
    # Places in the stack of each tag's open elements, and of those that bound a scope, so
    # that no tag walks over the open elements.
    places: dict[str, list[int]] = {}
    scopes = [0]
    foreign = 0  # open foreign elements
    solid = -1  # the last text that is not blank
    at, size = 0, len(source)

    def close(k: int) -> None:
        nonlocal foreign
        while len(stack) > k:
            i = stack.pop()
            if stack:
                places[elements[i].tag].pop()
                if scopes[-1] == len(stack):
                    scopes.pop()
            if elements[i].tag in FOREIGN:
                foreign -= 1
                if solid < elements[i].start:
                    del texts[elements[i].start:], elements[i + 1:]
            elements[i].end = len(elements)

    def last(tags) -> int:
        """The innermost open element of these tags; 0 if there is none."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def add(raw: str) -> None:
        nonlocal solid
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            texts.append((stack[-1], text))
            if text.strip():
                solid = len(texts) - 1

    search = _TOKEN.search
    while at < size:
        found = search(source, at)
        if found is None:
            add(source[at:])
            break
        start = found.start()
        if start > at:
            add(source[at:start])
        at = found.end()
        raw_text, slash, tag, raw = found.groups()
        if raw_text:
            add(raw_text)
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if elements[stack[-1]].tag == tag:
                close(len(stack) - 1)
                continue
            k = last((tag,))
            if k and (tag in BLOCKS or k >= scopes[-1]):
                close(k)
            continue
        self_closed = bool(raw) and raw.rstrip().endswith("/")
        if foreign and tag in _ENDS_FOREIGN:
            k = last(FOREIGN)
            if k and k > max(last(_HOLDS_HTML), last(_ENDS_FOREIGN)):
                close(k)
        ends = _SAME.get(tag, _NONE)
        if tag in _ENDS_P or ends:
            k = last((*ends, "p") if tag in _ENDS_P else ends)
            if k and k >= scopes[-1]:
                close(k)
        if foreign and (tag in _APART_SELF or elements[stack[-1]].tag in _APART):
            add(" ")
        elements.append(Element(tag, raw, stack[-1], elements[stack[-1]].depth + 1, len(texts)))
        if tag == "br":
            add(" ")
        if tag in VOID or (self_closed and tag not in BLOCKS and (foreign or tag not in RAW)):
            elements[-1].end = len(elements)
            continue
        places.setdefault(tag, []).append(len(stack))
        if tag in _SCOPE:
            scopes.append(len(stack))
        stack.append(len(elements) - 1)
        foreign += tag in FOREIGN
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]|</{re.escape(tag)}\Z", re.I).search(source, at)
            # What is not closed runs to the end of the page.
            if stop is None:
                at = size
            else:
                at = source.find(">", stop.start()) + 1 or size
            close(len(stack) - 1)
    close(0)
    return Page(elements, texts)


def block_of(page: Page) -> list[int]:
    """Each element's nearest block element, itself included."""
    out: list[int] = []
    for i, element in enumerate(page.elements):
        out.append(i if element.tag in BLOCKS or i == 0 else out[element.parent])
    return out


def blocks(page: Page, keep=None) -> list[str]:
    """Texts of runs of pieces in the same block, white space folded, empty ones left out.

    ``keep`` says per element whether its own text counts.
    """
    owner = block_of(page)
    runs: list[tuple[tuple[int, int], list[str]]] = []
    breaks = _breaks(page)
    for i, (element, text) in enumerate(page.texts):
        if keep is not None and not keep[element]:
            continue
        key = (owner[element], breaks[i])
        if not runs or runs[-1][0] != key:
            runs.append((key, []))
        runs[-1][1].append(text)
    folded = (" ".join("".join(parts).split()) for _, parts in runs)
    return [text for text in folded if text]


def _breaks(page: Page) -> list[int]:
    """Per text piece, how many block elements began or ended before it."""
    starts = [0] * (len(page.texts) + 1)
    for element in page.elements[1:]:
        if element.tag in BLOCKS:
            starts[min(element.start, len(page.texts))] += 1
    out, total = [], 0
    for i in range(len(page.texts)):
        total += starts[i]
        out.append(total)
    return out


def plain_text(source: str | None) -> str:
    """All text of a page, a block a line."""
    page = read(source or "")
    hidden = [e.tag == "head" for e in page.elements]
    for i, element in enumerate(page.elements):
        if element.parent >= 0 and hidden[element.parent]:
            hidden[i] = True
    return "\n".join(blocks(page, [not h for h in hidden]))
