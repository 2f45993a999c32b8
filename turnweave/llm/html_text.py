"""Visible text of HTML pages, laid out in blocks, lists and aligned table cells.

A tree builder with implied end tags (p, li, dt, dd, option, tr, td, th, table parts,
and what a block start or an ancestor's end closes) reads the tags; a renderer walks the
tree. Elements that are never shown (``NEVER_SHOWN``; desc and metadata in svg, annotations
in math; a dialog that is not open) or are not displayed (``hidden``, ``display: none``,
``type=hidden``) give no text, nor does anything in them. ``visibility: hidden`` or
``collapse`` hides text, but not that of a descendant with ``visibility: visible``. Of a
style's declarations for one property the last counts; style sheets are not read.

Blocks start on a line of their own, paragraphs and headings stand between empty lines, br
breaks a line, pre, listing, xmp, plaintext and textarea keep their white space, each option
is a line, list items get "- " or their number (start, reversed and value count), and lists, dd
and blockquote two spaces of indent a level, up to
``MAX_INDENT`` levels. Table cells start where their column starts; a column is as wide
as its cells (East Asian wide characters are two columns, combining ones none), and those
that span several columns widen the last of them. Cells are found
below any wrapper in a table; what stands in a table, row group or row outside of cells
comes before the rows. In tables nested ``MAX_TABLES`` deep, cells are blocks.

Tags follow the standard's tokenizer: a quote opens a quoted value right behind "=" only.
Text that is not white space ends the head, as a tag of the body does. The content of xmp and
plaintext is no markup, and plaintext goes on to the end of the page.
Trees of any depth are built and walked without recursion, but for nested tables.

Edge cases: null html gives null, no tags give the text itself, unclosed and misnested
tags are repaired, character references are decoded once, an unclosed comment, script or
tag ends with the page. Repeated rows are rendered one by one; extra columns are not read.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import bound_batches

MAX_INDENT, MAX_TABLES = 40, 20
#: Bounds of spans that the standard sets.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65_534

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER_SHOWN = frozenset("head script style template noscript title iframe object canvas audio video datalist rp noframes noembed".split())
#: Not shown within the element named.
_NOT_SHOWN_IN = {"desc": "svg", "metadata": "svg", "annotation": "math", "annotation-xml": "math"}
RAW = frozenset("script style textarea title iframe noscript noframes noembed xmp plaintext".split())
PRE = frozenset("pre listing xmp plaintext".split())
#: What may stand in the head.
_IN_HEAD = frozenset("base link meta title style script noscript noframes template".split())
SPACED = PRE | frozenset("p h1 h2 h3 h4 h5 h6 blockquote figure ul ol dl table".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog div dt fieldset figcaption footer form header hgroup html legend li main menu nav section summary tr caption hr option".split())
#: A start tag of the key ends an open element of the value, up to the given bounds.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
_ENDS_P = BLOCK - frozenset("html body li dt dd tr caption option legend summary".split())
_SCOPE = frozenset("table td th caption button".split())

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*(?:>|\Z))|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: One attribute, or nothing: behind "=", a quote opens a value that ends at the same quote, all else ends at white space or ">".
_ATTRIBUTE = re.compile(r"[\s/]*(?:(=?[^\s/>=]+|=)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?)?")
_WHITE = re.compile(r"[ \t\n\r\f]+")


class Element:
    """``shown``: whether it is displayed; ``visible``: what its own style says of visibility, or None.

    ``start``: the first number of an ol, or the own number of an item, or None; ``step``: from number to number.
    """

    __slots__ = ("children", "columns", "name", "rows", "shown", "start", "step", "visible")

    def __init__(self, name: str, shown: bool = True, visible: bool | None = None) -> None:
        self.name, self.shown, self.visible = name, shown, visible
        self.columns = self.rows = self.step = 1
        self.start: int | None = None
        self.children: list[Element | str] = []


def _width(text: str) -> int:
    """The columns that a text takes."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _first_number(element: Element) -> int:
    """The number of a list's first item; of a reversed one that has none, how many items it has."""
    if element.start is not None:
        return element.start
    return sum(isinstance(x, Element) and x.name == "li" and x.shown for x in element.children) if element.step < 0 else 1


def _number(text: str, least: int, most: int, default: int | None = 1) -> int | None:
    found = re.match(r"\s*([+-]?\d{1,9})", text)
    return min(max(int(found[1]), least), most) if found else default


def _element(name: str, attributes: dict[str, str]) -> Element:
    style = {}
    for declaration in attributes.get("style", "").lower().split(";"):
        key, _, value = declaration.partition(":")
        style[key.strip()] = value.replace("!important", "").strip()
    hidden = "hidden" in attributes or style.get("display") == "none" or (name == "input" and attributes.get("type", "").lower() == "hidden")
    hidden = hidden or (name == "dialog" and "open" not in attributes)
    visible = {"visible": True, "hidden": False, "collapse": False}.get(style.get("visibility", ""))
    out = Element(name, not hidden and name not in NEVER_SHOWN, visible)
    if name in ("ol", "li"):
        out.start = _number(attributes.get("start" if name == "ol" else "value", ""), -(10**9), 10**9, None)
        out.step = -1 if "reversed" in attributes and name == "ol" else 1
    elif name in ("td", "th"):
        out.columns = _number(attributes.get("colspan", ""), 1, MAX_COLSPAN)
        out.rows = _number(attributes.get("rowspan", ""), 0, MAX_ROWSPAN) or MAX_ROWSPAN  # 0: to the end
    return out


def _tag(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """The attributes of a tag from behind its name, whether it closes itself, and where it ends."""
    found: dict[str, str] = {}
    closed = False
    while True:
        one = _ATTRIBUTE.match(page, at)
        at = one.end()
        if one[1] is None:
            closed = page[at - 1 : at] == "/"
            break
        found.setdefault(one[1].lower(), html.unescape(one[2] or one[3] or one[4] or ""))
    return found, closed, min(at + 1, len(page))


def build_tree(page: str) -> Element:
    """The elements of a page, with implied tags closed."""
    root = Element("#root")
    stack = [root]
    places: dict[str, list[int]] = {}  # where in the stack the open elements of a name are

    def push(element: Element) -> None:
        places.setdefault(element.name, []).append(len(stack))
        stack.append(element)

    def cut(at: int) -> None:
        while len(stack) > at:
            places[stack.pop().name].pop()

    def last(names: set[str] | frozenset[str]) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def close(names: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> None:
        """End the outermost open element of these names that is within the bounds, and all in it."""
        bound = last(bounds)
        if last(names) > bound:
            cut(min(own[bisect_right(own, bound)] for x in names if (own := places.get(x)) and own[-1] > bound))

    def say(text: str) -> None:
        if stack[-1].name == "head" and _WHITE.sub("", text):
            cut(len(stack) - 1)
        stack[-1].children.append(html.unescape(text))

    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            say(page[at:])
            break
        if found.start() > at:
            say(page[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        name = found[2].lower()
        attributes, closed, at = _tag(page, at)
        if found[1]:
            opened = last({name})
            if opened and (name in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") or last(_SCOPE) <= opened):
                cut(opened)
            elif name == "p":  # an end without a start is an empty paragraph
                stack[-1].children.append(Element("p"))
            elif name == "br":
                stack[-1].children.append(Element("br"))
            continue
        if name in _ENDS_P:
            close({"p"}, _SCOPE)
        if name in _CLOSES:
            close(*_CLOSES[name])
        element = _element(name, attributes)
        if places.get(_NOT_SHOWN_IN.get(name, "")):
            element.shown = False
        if stack[-1].name == "head" and name not in _IN_HEAD:
            cut(len(stack) - 1)
        stack[-1].children.append(element)
        if name in VOID or (closed and (name in ("svg", "math") or places.get("svg") or places.get("math"))):
            continue
        if name in RAW and not (places.get("svg") or places.get("math")):
            end = None if name == "plaintext" else re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            text = page[at : end.start() if end else size]
            element.children.append(html.unescape(text.removeprefix("\n")) if name == "textarea" else text)
            at = end.end() if end else size
        else:
            push(element)
            if name in ("pre", "listing") and page.startswith("\n", at):
                at += 1  # a line feed right behind the tag is none of the text
    return root


class _Lines:
    """Text as it is laid out: lines, what has to stand between blocks, and what lines begin with."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now, self.gap, self.space = "", 0, False
        self.prefix: list[str] = []  # of each level: the mark of an item that has no line yet, else spaces

    def _end(self) -> None:
        text = self.now.rstrip()
        if text and self.prefix:
            text = "".join(self.prefix) + text
            self.prefix = ["  "] * len(self.prefix)
        self.lines.append(text)
        self.now = ""

    def add(self, text: str, pre: bool = False) -> None:
        if pre:
            first, *rest = text.split("\n")
            self._put(first)
            for line in rest:
                self._end()
                self.now = line
            return
        words = _WHITE.sub(" ", text)
        if words.startswith(" "):
            self.space, words = True, words[1:]
        if not words:
            return
        ends = words.endswith(" ")
        self._put(words[:-1] if ends else words)
        self.space = ends

    def _put(self, text: str) -> None:
        if not text:
            return
        if not self.now and self.gap and self.lines:
            self.lines += [""] * (self.gap - 1)
        if self.now and self.space:
            self.now += " "
        self.gap, self.space = 0, False
        self.now += text

    def break_(self, gap: int = 1) -> None:
        """End the line; gap 2: an empty line before what comes next."""
        if self.now:
            self._end()
        self.space = False
        self.gap = max(self.gap, gap)

    def newline(self) -> None:
        self._end()
        self.space = False

    def done(self) -> list[str]:
        self.break_()
        first, end = 0, len(self.lines)
        while end and not self.lines[end - 1]:
            end -= 1
        while first < end and not self.lines[first]:
            first += 1
        return self.lines[first:end]


def _dealt(table: Element, visible: bool) -> tuple[list[list[tuple[Element, bool]]], Element]:
    """The rows of cells below a table, each cell with whether it is visible, and an element of all else that the table shows."""
    rows: list[list[tuple[Element, bool]]] = []
    rest = Element("div", True, visible)
    # What is left of an element, the row that its cells go to (None: of the element around), where all else goes.
    stack = [(iter(table.children), None, rest, visible)]
    while stack:
        children, row, loose, seen = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
        elif isinstance(child, str):
            loose.children.append(child)
        elif not child.shown:
            continue
        elif child.name in ("td", "th"):
            if row is None:
                row = []
                rows.append(row)
                stack[-1] = (children, row, loose, seen)
            row.append((child, seen if child.visible is None else child.visible))
        elif child.name == "table" or not child.children:
            loose.children.append(child)
        else:
            own = Element(child.name, True, child.visible)
            own.start, own.step = child.start, child.step
            loose.children.append(own)
            inner = row
            if child.name in ("tr", "thead", "tbody", "tfoot"):
                inner = None
                stack[-1] = (children, None, loose, seen)  # cells behind it begin a row
            if child.name == "tr":
                inner = []
                rows.append(inner)
            stack.append((iter(child.children), inner, own, seen if child.visible is None else child.visible))
    return rows, rest


def _placed(rows: list[list[tuple[Element, bool]]], depth: int) -> list[list[tuple[int, int, list[str]]]]:
    """Of each row's cells the column, the number of columns and the lines; cells leave out what a cell above reaches into."""
    held: list[tuple[int, int, int]] = []  # columns from and to that cells of rows above reach into, for how many rows more
    out = []
    for row in rows:
        at, i, placed, below = 0, 0, [], []
        for cell, visible in row:
            while i < len(held) and (held[i][1] <= at or held[i][0] < at + cell.columns):
                at = max(at, held[i][1])
                i += 1
            placed.append((at, cell.columns, _laid(cell, visible, depth + 1)))
            if cell.rows > 1:
                below.append((at, at + cell.columns, cell.rows - 1))
            at += cell.columns
        held = sorted([(a, b, n - 1) for a, b, n in held if n > 1] + below)
        out.append(placed)
    return out


def _table(table: Element, visible: bool, out: _Lines, depth: int) -> None:
    rows, rest = _dealt(table, visible)
    for line in _laid(rest, visible, depth):
        out.add(line, pre=True)
        out.break_()
    placed = _placed(rows, depth)
    widths: dict[int, int] = {}
    cells = sorted(((n, at, lines) for row in placed for at, n, lines in row), key=lambda x: x[:2])
    for n, at, lines in cells:  # those of one column first
        need = max(map(_width, lines), default=0)
        own = [widths[c] for c in range(at, at + n) if widths.get(c)]
        short = need - sum(own) - 2 * max(0, len(own) - 1)
        if n == 1:
            widths[at] = max(widths.get(at, 0), need)
        elif short > 0:
            widths[at + n - 1] = widths.get(at + n - 1, 0) + max(1, short - (0 if widths.get(at + n - 1) or not own else 2))
    starts, x = {}, 0
    used = {at for row in placed for at, _, _ in row}
    for c in sorted(widths.keys() | used):
        starts[c] = x
        x += widths[c] + 2 if widths.get(c) else 0
    for row in placed:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            line = ""
            for at, _, lines in row:
                if k < len(lines) and lines[k]:
                    line += " " * (starts[at] - _width(line)) + lines[k]
            out.add(line, pre=True)
            out.break_()


def _laid(element: Element, visible: bool = True, depth: int = 0) -> list[str]:
    """The lines of an element's content."""
    out = _Lines()
    # Open elements: children left, white space kept, visible, the number of the next item, what to do at the end.
    stack: list[list] = [[iter(element.children), element, False, visible, _first_number(element), None]]
    while stack:
        frame = stack[-1]
        children, parent, pre, seen, number, ending = frame
        child = next(children, None)
        if child is None:
            stack.pop()
            if ending:
                out.break_(ending[0])
                del out.prefix[ending[1] :]
            continue
        if isinstance(child, str):
            if seen:
                out.add(child, pre)
            continue
        if not child.shown:
            continue
        name = child.name
        inside = seen if child.visible is None else child.visible
        if name == "br":
            out.newline()
            continue
        if name not in BLOCK:
            if name in ("td", "th", "text"):  # text: of svg
                if name != "text" and depth >= MAX_TABLES:
                    out.break_()
                out.space = True
            stack.append([iter(child.children), child, pre or name == "textarea", inside, 1, None])
            continue
        gap = 2 if name in SPACED and not (name in ("ul", "ol") and parent.name == "li") else 1
        out.break_(gap)
        if name == "table" and depth < MAX_TABLES:
            _table(child, inside, out, depth)
            out.break_(gap)
            continue
        level = len(out.prefix)
        own = ""
        if name == "li":
            number = number if child.start is None else child.start
            own = f"{number}. " if parent.name == "ol" else "- "
            frame[4] = number + parent.step
        elif name in ("dd", "blockquote"):
            own = "  "
        if own and level < MAX_INDENT:
            out.prefix.append(own)
        stack.append([iter(child.children), child, pre or name in PRE, inside, _first_number(child), (gap, level)])
    return out.done()


def render(page: str | None) -> str | None:
    """The visible text of a page."""
    if page is None:
        return None
    lines: list[str] = []
    for line in _laid(build_tree(page.replace("\r\n", "\n"))):
        if line or (lines and lines[-1]):
            lines.append(line)
    return "\n".join(lines)


def extract_text(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """page_id and text of every page."""

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["page_id", "text"])

    bound_batches(pages)
    kind = pages.schema[id_column].dataType.simpleString()
    return pages.select(F.col(id_column).alias("page_id"), F.col(html_column).cast("string")).mapInArrow(rendered, f"page_id {kind}, text string")
