"""Visible text of HTML pages, laid out.

A scanner feeds a tree builder that knows implied tags (a new paragraph ends the last,
a list item or table cell ends its neighbour, and so on) and drops what is not shown. A
renderer walks the tree: inline white space collapses, blocks start new lines, spaced
blocks stand between empty lines, list items carry their marks, and table cells are
aligned in columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventflow.llm.common import text_of

# Element classes of HTML; fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title plaintext".split())
HIDDEN = frozenset(
    "head script style template iframe noembed noframes audio video canvas object datalist title".split()
)
# In drawings and formulas, whose other text is shown.
FOREIGN = frozenset("svg math".split())
HIDDEN_FOREIGN = frozenset("annotation annotation-xml metadata defs desc symbol clippath mask pattern marker".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset menu dir xmp listing".split())
BLOCK = SPACED | frozenset(
    "html body div section article aside header footer nav main address center form li dt dd details summary dialog "
    "figcaption legend optgroup option caption tr hgroup search textarea".split()
)
CLOSES_P = BLOCK - frozenset("option optgroup tr caption html body textarea".split())
PRE = frozenset("pre xmp listing plaintext textarea".split())
LISTS = frozenset("ul ol menu dir".split())
# A start tag ends open elements of the first set, up to the nearest of the second.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "caption": ({"caption"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base link meta title style script template noscript head".split())
# Inline elements do not keep a block's end tag from closing it, but a table cell or the like does.
SCOPES = frozenset("table td th caption html template button".split())

#: Elements nested deeper become children of the one at this depth; their text stays. Within a hidden element twice as deep.
DEPTH = 150
TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)"
    # A quote opens a value directly after the equals sign only; anywhere else it is a character like others.
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?P<attributes>(?:[\s/]|=?[^\s/=>]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|(?=[\"'])[^>]*|[^\s>\"'][^\s>]*)?)?|=)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(=?[^\s/=>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)|content-visibility\s*:\s*hidden)\b", re.I)
BARE_END = re.compile(r"=\s*[^\s\"'>]+/\Z")  # the slash belongs to a value without quotes
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("name", "attributes", "children", "depth")

    def __init__(self, name: str, attributes: dict[str, str], depth: int):
        self.name, self.attributes, self.depth, self.children = name, attributes, depth, []


def attributes_of(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape(double or single or bare))
    return found


def shown(name: str, attributes: dict[str, str]) -> bool:
    """Whether an element is rendered at all."""
    if name in HIDDEN or "hidden" in attributes or UNSEEN.search(attributes.get("style", "")):
        return False
    return not (name == "input" or name == "dialog" and "open" not in attributes)


class Builder:
    """Builds the tree: open elements are a stack, text goes to the innermost."""

    def __init__(self):
        self.root = Node("html", {}, 0)
        self.stack = [self.root]
        self.head = True  # still in the head, which ends with the first thing that cannot be in it

    def text(self, text: str) -> None:
        if text:
            if self.head and self.stack[-1].name in ("html", "head") and not SPACE.fullmatch(text):
                self._end_up_to({"head"}, frozenset())
                self.head = False
            self.stack[-1].children.append(text)

    def _end_up_to(self, names: set[str], scope: set[str] | frozenset[str]) -> None:
        """Ends all open elements of ``names`` above the nearest of ``scope``, with what is in them."""
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.stack[i].name
            if name in scope:
                return
            if name in names:
                del self.stack[i:]

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if name == "head" and self.head:
            self._push(name, attributes)
            return
        if name in ("html", "body"):
            self.head = False
            self._end_up_to({"head"}, frozenset())
            if not shown(name, attributes):
                self._push(name, attributes)
            return
        if name not in IN_HEAD and any(x.name == "head" for x in self.stack[:3]):
            self._end_up_to({"head"}, frozenset())
            self.head = False
        if name in CLOSES_P:
            self._end_up_to({"p"}, SCOPES)
        if name in HEADINGS and self.stack[-1].name in HEADINGS:
            self.stack.pop()
        if name in IMPLIED:
            self._end_up_to(*IMPLIED[name])
        if name in ("td", "th") and self.stack[-1].name in ("table", "tbody", "thead", "tfoot"):
            self._push("tr", {})
        self._push(name, attributes)

    def foreign(self) -> bool:
        """Whether the innermost elements are those of a drawing or formula."""
        return any(x.name in FOREIGN for x in self.stack)

    def _push(self, name: str, attributes: dict[str, str]) -> None:
        if (name in HIDDEN_FOREIGN or name == "text") and self.foreign():
            # No attribute of a page has a space in its name.
            attributes = attributes | {"hidden" if name in HIDDEN_FOREIGN else " block": ""}
        parent, depth = self.stack[-1], DEPTH
        if len(self.stack) > DEPTH and not shown(self.stack[DEPTH].name, self.stack[DEPTH].attributes):
            depth = 2 * DEPTH  # what is in a hidden element stays in it; it is not rendered
        if len(self.stack) >= depth and name not in VOID:
            parent = self.stack[depth - 1]
        node = Node(name, attributes, len(self.stack))
        parent.children.append(node)
        if name not in VOID:
            if len(self.stack) >= depth:
                del self.stack[depth:]
            self.stack.append(node)

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", {})
            return
        if name == "p" and not any(x.name == "p" for x in self.stack):
            self.start("p", {})
        if name in ("html", "body"):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            open_name = self.stack[i].name
            if open_name == name or name in HEADINGS and open_name in HEADINGS:
                del self.stack[i:]
                return
            if open_name in BLOCK and name not in BLOCK and name not in ("td", "th", "tbody", "thead", "tfoot", "select"):
                return  # the end of an inline element does not end the blocks in it
            if open_name in SCOPES and name not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                return
            if open_name == "table" and name != "table":
                return


def tree_of(html: str) -> Node:
    build, at = Builder(), 0
    lower = None
    while True:
        found = TOKEN.search(html, at)
        if found is None:
            build.text(unescape(html[at:]))
            return build.root
        if found.start() > at:
            build.text(unescape(html[at : found.start()]))
        at = found.end()
        name = found["name"]
        if name is None:
            if found[0].startswith("<![CDATA["):
                build.text(found[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if found["end"]:
            build.end(name)
            continue
        build.start(name, attributes_of(found["attributes"]) if found["attributes"].strip(" /") else {})
        if found["attributes"].endswith("/") and not BARE_END.search(found["attributes"]) and build.foreign():
            if name not in VOID:
                build.end(name)  # only drawings and formulas have empty elements of this form
            continue
        if name in RAW:
            lower = html.lower() if lower is None else lower
            # Lower case can change a text's length in rare alphabets; then search without it.
            stop = lower.find(f"</{name}", at) if len(lower) == len(html) else html.find(f"</{name}", at)
            stop = len(html) if stop < 0 or name == "plaintext" else stop
            raw = html[at:stop]
            build.text(unescape(raw) if name in ("title", "textarea") else raw)
            at = stop


class Lines:
    """Text lines under construction: what is put in collapses white space unless it is preformatted."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False  # a collapsed space waits for the next word
        self.gap = False  # an empty line waits for the next text

    def put(self, text: str) -> None:
        if self.gap and not self.now:
            if self.lines:
                self.lines.append("")
            self.gap = False
        self.now.append(text)

    def inline(self, text: str) -> None:
        words = SPACE.split(text)
        if not words[0] and self.now:
            self.space = True
        words_in = [w for w in words if w]
        if words_in:
            lead = " " if self.space and self.now else ""
            self.put(lead + " ".join(words_in))
            self.space = not words[-1]

    def preformatted(self, text: str) -> None:
        for i, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if i:
                self.line_break()
            if line:
                self.put(line)

    def line_break(self) -> None:
        """Ends the line, also an empty one."""
        if not self.now:
            self.put("")
        self.lines.append("".join(self.now).rstrip())
        self.now, self.space = [], False

    def block(self) -> None:
        """The next text starts a new line."""
        if self.now:
            self.line_break()
        self.space = False

    def spaced(self) -> None:
        """The next text starts a new line after an empty one."""
        self.block()
        self.gap = True

    def add(self, lines: list[str]) -> None:
        self.block()
        for line in lines:
            self.put(line)
            self.lines.append("".join(self.now).rstrip())
            self.now = []

    def done(self) -> list[str]:
        self.block()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def render(children: list, out: Lines, pre: bool = False) -> Lines:
    for child in children:
        if isinstance(child, str):
            out.preformatted(child) if pre else out.inline(child)
            continue
        name = child.name
        if name == "br":
            out.line_break()
        elif name == "hr":
            out.spaced()
            out.add(["---"])
            out.spaced()
        elif name == "wbr" or not shown(name, child.attributes):
            continue
        elif name == "table":
            out.spaced()
            out.add(table_lines(child))
            out.spaced()
        elif name in LISTS:
            nested = any(isinstance(x, Node) and x.name == "li" for x in child.children) and getattr(out, "item", False)
            out.block() if nested else out.spaced()
            out.add(list_lines(child))
            out.block() if nested else out.spaced()
        elif name == "blockquote" or name == "dd":
            out.spaced() if name == "blockquote" else out.block()
            out.add([("  " + line).rstrip() for line in render(child.children, Lines()).done()])
            out.spaced() if name == "blockquote" else out.block()
        elif name == "details" and "open" not in child.attributes:
            out.block()
            first = next((x for x in child.children if isinstance(x, Node) and x.name == "summary"), None)
            render([first] if first else [], out)
            out.block()
        elif name in PRE:
            out.spaced()
            inside = child.children
            if inside and isinstance(inside[0], str) and inside[0][:1] == "\n":
                inside = [inside[0][1:], *inside[1:]]
            out.add(render(inside, Lines(), True).done())
            out.spaced()
        elif name in SPACED:
            out.spaced()
            render(child.children, out, pre)
            out.spaced()
        elif name in BLOCK or " block" in child.attributes:
            out.block()
            render(child.children, out, pre)
            out.block()
        elif name in ("td", "th"):  # a cell outside a table
            out.block()
            render(child.children, out, pre)
        else:
            render(child.children, out, pre)
    return out


def list_lines(node: Node) -> list[str]:
    """Items with bullets or numbers; what follows the first line of an item is indented."""
    lines: list[str] = []
    number = re.fullmatch(r"\s*(-?\d{1,9})\s*", node.attributes.get("start", "1"))
    count = int(number[1]) if number else 1
    loose: list = []

    def flush() -> None:
        if loose:
            lines.extend(render(loose, Lines()).done())
            loose.clear()

    for child in node.children:
        if isinstance(child, str) or child.name != "li":
            loose.append(child)
            continue
        flush()
        if not shown("li", child.attributes):
            continue
        value = re.fullmatch(r"\s*(-?\d{1,9})\s*", child.attributes.get("value", "")) if node.name == "ol" else None
        count = int(value[1]) if value else count
        mark = f"{count}. " if node.name == "ol" else "- "
        count += 1
        inner = Lines()
        inner.item = True
        item = render(child.children, inner).done() or [""]
        lines.append((mark + item[0]).rstrip())
        lines.extend((" " * len(mark) + line).rstrip() for line in item[1:])
    flush()
    return lines


def _span(node: Node, name: str) -> int:
    text = node.attributes.get(name, "1").strip()
    return max(1, min(int(text), 1000)) if text.isdigit() and len(text) < 10 else 1


def table_lines(table: Node) -> list[str]:
    """Rows as lines, cells in columns as wide as their widest line; captions above."""
    captions, rows, rest = [], [], []

    def gather(node: Node) -> None:
        for child in node.children:
            if isinstance(child, str):
                rest.append(child)
            elif not shown(child.name, child.attributes):
                continue
            elif child.name == "tr":
                rows.append(child)
            elif child.name in ("tbody", "thead", "tfoot"):
                gather(child)
            elif child.name == "caption":
                captions.append(child)
            elif child.name not in ("colgroup", "col"):
                rest.append(child)

    gather(table)
    lines = [line for c in captions for line in render(c.children, Lines()).done()]
    lines += render(rest, Lines()).done()  # text that stands between rows comes before the table
    grid: list[dict[int, tuple[list[str], int]]] = []
    taken: dict[int, int] = {}  # columns that a cell of an earlier row reaches down into, and for how many rows
    for row in rows:
        cells: dict[int, tuple[list[str], int]] = {}
        column, below, stray = 0, {}, []
        for child in row.children:
            if isinstance(child, str) or child.name not in ("td", "th"):
                stray.append(child)
                continue
            if not shown(child.name, child.attributes):
                continue
            while taken.get(column):
                column += 1
            width, height = _span(child, "colspan"), _span(child, "rowspan")
            cells[column] = (render(child.children, Lines()).done(), width)
            if height > 1:
                below.update(dict.fromkeys(range(column, column + width), height))
            column += width
        if outside := render(stray, Lines()).done():
            lines += outside
        grid.append(cells)
        taken = {c: n - 1 for c, n in taken.items() if n > 1} | {c: n - 1 for c, n in below.items()}
    widths: dict[int, int] = {}
    for cells in grid:
        for column, (cell, span) in cells.items():
            if span == 1:
                widths[column] = max(widths.get(column, 0), max(map(len, cell), default=0))
    for cells in grid:
        for column, (cell, span) in cells.items():
            room = sum(widths.get(c, 0) for c in range(column, column + span)) + 2 * (span - 1)
            if span > 1 and (more := max(map(len, cell), default=0) - room) > 0:
                widths[column + span - 1] = widths.get(column + span - 1, 0) + more
    place, at = {}, 0
    for column in range(max(widths, default=-1) + 1):
        place[column] = at
        at += widths.get(column, 0) + (2 if widths.get(column) else 0)
    for cells in grid:
        for k in range(max((len(cell) for cell, _ in cells.values()), default=0)):
            line = ""
            for column, (cell, _) in sorted(cells.items()):
                if k < len(cell) and cell[k]:
                    line = line.ljust(place.get(column, at)) + cell[k]
            lines.append(line.rstrip())
    return lines


def visible_text(html: str | None) -> str:
    return "\n".join(render([tree_of(html)], Lines()).done()) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id and the page's visible text.

    Null and empty pages have an empty text. Text that is no HTML comes out as one
    paragraph. Null ids and repeated rows are passed on; other columns are left out.
    """

    @F.pandas_udf("string")
    def text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield pd.Series([visible_text(page) for page in batch], dtype=object)

    return pages.select(F.col(id_col).alias("page_id"), text(text_of(html_col)).alias("text"))
