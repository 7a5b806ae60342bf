"""HTML extraction by layout-aware rendering.

A tolerant tree builder (implied end tags, void and raw-text elements) feeds a renderer that leaves out what isn't
visible and keeps the layout: blocks on lines of their own, a blank line around paragraphs, headings, lists and tables,
list items with marks and indents, table cells padded to columns, white space collapsed except in preformatted text.

Defined results: null and empty pages give an empty text; a page without tags is its own text; unclosed, stray and
badly nested tags never fail; head and body tags may be left out; tables inside tables are rendered inside their cell's
text; what a style makes invisible is left out but for what is made visible inside it, and so is the body of closed details;
cells that span rows keep their column free below; drawings give their text; depth and size of a page aren't limited, and
parsing takes time in proportion to it but for tags with an odd quote inside others' quotes; repeated rows give equal texts; other columns stay, one named like the output is replaced.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessaly.llm.bpe import with_column

TAG = re.compile(r"<[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<[a-zA-Z][^>]*>?")
COMMENT_END = re.compile(r"--!?>")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
NOT_DISPLAYED = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
HIDDEN = {"script", "style", "head", "title", "noscript", "template", "iframe", "annotation", "annotation-xml", "datalist", "defs", "desc", "metadata", "symbol", "clippath"}
#: What an open head holds; any other start tag, and text, ends it.
HEAD_CONTENT = {"base", "basefont", "bgsound", "link", "meta", "title", "style", "script", "noscript", "template"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol",
    "p", "pre", "section", "summary", "table", "ul", "caption", "optgroup", "option",
}
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "menu", "dir", "table", "blockquote", "pre", "figure", "hr"}
#: An opening tag ends these open elements, up to the given containers.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
#: Elements that an open p doesn't outlive, and those across whose borders no end tag reaches.
CLOSES_P = BLOCKS - {"html", "body", "option", "optgroup", "caption", "legend", "summary"}
BORDERS = {"table", "td", "th", "html"}
#: Inside a drawing only these hold text that is drawn.
DRAWN = {"text", "foreignobject"}


class Tokens:
    """Finds the comments, declarations and tags of a page, one after the other. What has no end to its right is known
    from the page's last > and last comment end, so it isn't looked for again at each beginning."""

    def __init__(self, page: str):
        self.page, self.last, self.open_comment = page, page.rfind(">"), False

    def end(self, start: int) -> int | None:
        """Where the token that begins with the < at start ends; None if none begins there."""
        page = self.page
        if page.startswith("<!--", start):
            for short in ("<!-->", "<!--->"):
                if page.startswith(short, start):
                    return start + len(short)
            found = None if self.open_comment else COMMENT_END.search(page, start + 4)
            self.open_comment = found is None
            return found.end() if found else len(page)
        after = page[start + 1 : start + 3]
        if after[:1] in ("!", "?") or after[:1] == "/" and after[1:].isascii() and after[1:].isalpha():
            return page.index(">", start) + 1 if start < self.last else None
        found = TAG.match(page, start)
        return found.end() if found else None

    def next(self, at: int) -> tuple[int, int] | None:
        """Start and end of the first token from at on."""
        while (start := self.page.find("<", at)) >= 0:
            if (end := self.end(start)) is not None:
                return start, end
            at = start + 1
        return None


class Element:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def get(self, name: str) -> str | None:
        for key, value in ATTRIBUTE.findall(self.attributes):
            if key.lower() == name:
                return html.unescape(value.strip("\"'"))
        return None


def parse(page: str) -> Element:
    """The tree of a page; texts are strings among the children."""
    root = Element("html")
    stack = [root]
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of a tag in the stack
    begun = False  # a head was met, or what no head holds

    def nearest(tags: set[str]) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def close(k: int) -> None:
        for x in stack[k:]:
            places[x.tag].pop()
        del stack[k:]

    def end(tags: set[str], within: set[str]) -> None:
        """Close the outermost open element of tags that is nearer than any of within and below others of tags only."""
        k = nearest(tags)
        if k > nearest(within):
            while k > 1 and stack[k - 1].tag in tags and stack[k - 1].tag not in within:
                k -= 1
            close(k)

    at, tokens = 0, Tokens(page)
    while at < len(page):
        found = tokens.next(at)
        if found is None or found[0] > at:
            stop = found[0] if found else len(page)
            if page[at:stop].strip(" \t\n\r\f"):
                begun = True
                if stack[-1].tag == "head":
                    close(len(stack) - 1)
            stack[-1].children.append(html.unescape(page[at:stop]))
        if found is None:
            break
        token, at = page[found[0] : found[1]], found[1]
        name = NAME.match(token)
        if name is None:
            continue  # a comment or declaration
        tag = name[1].lower()
        if token[1] == "/":
            if tag == "br":
                stack[-1].children.append(Element("br"))
                continue
            borders = BORDERS - {tag} - ({"td", "th"} if tag in ("tr", "tbody", "thead", "tfoot", "table") else set())
            if (k := nearest({tag})) > nearest(borders):
                close(k)
            continue
        if tag == "body" and places[tag] or tag == "html" or tag == "head" and begun:
            continue
        if tag not in HEAD_CONTENT:
            begun = True
            if stack[-1].tag == "head":
                close(len(stack) - 1)
        if tag in CLOSES_P:
            end({"p"}, BORDERS | {"button"})
        if tag in ENDS:
            end(*ENDS[tag])
        element = Element(tag, token[name.end() :].rstrip(">"))
        stack[-1].children.append(element)
        if tag in RAW:
            ending = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(page, at)
            stop = ending.start() if ending else len(page)
            element.children.append(html.unescape(page[at:stop]) if tag in ("textarea", "title") else page[at:stop])
            at = ending.end() if ending else len(page)
        elif tag not in VOID and not (token.endswith("/>") and tag not in BLOCKS):
            places[tag].append(len(stack))
            stack.append(element)
    return root


def hidden(e: Element) -> bool:
    if e.tag in HIDDEN:
        return True
    a = e.attributes
    if not a:
        return e.tag == "dialog"
    lowered = a.lower()
    if "hidden" in lowered and e.get("hidden") is not None:
        return True
    if e.tag == "input" or "style" in lowered and NOT_DISPLAYED.search(e.get("style") or ""):
        return True
    return e.tag == "dialog" and e.get("open") is None


def shown(e: Element, before: bool) -> bool:
    """Whether text in an element is visible, if that around it is or isn't."""
    if e.tag == "svg":
        return False
    if e.tag in DRAWN:
        return True
    style = VISIBILITY.findall(e.get("style") or "") if "visibility" in e.attributes.lower() else None
    return style[-1].lower() == "visible" if style else before


def columns_wide(text: str) -> int:
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text) if not text.isascii() else len(text)


class Page:
    """Lines of a rendering: inline text gathers in a line, blocks break it, spaced blocks ask for a blank line."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the line that is open
        self.space = False  # collapsed white space waits for a next word
        self.blank = False  # a blank line waits for a next line
        self.indents: list[str] = []  # of the open lists and quotes, each one's own
        self.mark: tuple[int, str] | None = None  # of a list item that has no text yet: what stands before it, and it

    def text(self, text: str, preformatted: bool) -> None:
        if preformatted:
            first, *rest = text.split("\n")
            self.add(first)
            for x in rest:
                self.flush(True)
                self.add(x)
            return
        words = text.split(" ") if text.isascii() and not re.search(r"[\t\n\r\f]", text) else re.split(r"[ \t\n\r\f]+", text)
        words_there = [w for w in words if w]
        if not words_there:
            self.space = self.space or bool(text)
            return
        if (self.space or words[0] == "") and self.parts:
            self.add(" ")
        self.add(" ".join(words_there))
        self.space = words[-1] == ""

    def add(self, text: str) -> None:
        if text:
            self.parts.append(text)

    def flush(self, keep_empty: bool = False) -> None:
        line = "".join(self.parts)
        line = line.rstrip(" ") if not keep_empty else line.rstrip()
        self.space = False
        self.parts.clear()
        if line or keep_empty:
            if self.blank and self.lines and self.lines[-1] != "":
                self.lines.append("")
            self.blank = False
            lead = "".join(self.indents)
            if self.mark and line:
                lead, self.mark = "".join(self.indents[: self.mark[0]]) + self.mark[1], None
            self.lines.append((lead + line).rstrip())

    def rendering(self) -> str:
        self.flush()
        return "\n".join(self.lines).strip("\n")


def list_mark(item: Element, parent: Element | None, number: int, depth: int) -> str:
    if parent is not None and parent.tag == "ol":
        return f"{number}. "
    return "*-+"[depth % 3] + " "


def table_rows(table: Element) -> tuple[list[Element], list[list[Element]]]:
    """The captions and the rows of cells of a table; whatever else stands in it counts as a row of one cell."""
    captions, rows, todo = [], [], [iter(table.children)]
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
        elif isinstance(child, str):
            if child.strip():
                rows.append([_cell(child)])
        elif hidden(child) or child.tag in ("col", "colgroup"):
            continue
        elif child.tag == "caption":
            captions.append(child)
        elif child.tag in ("thead", "tbody", "tfoot"):
            todo.append(iter(child.children))
        elif child.tag == "tr":
            rows.append([c if isinstance(c, Element) and c.tag in ("td", "th") else _cell(c) for c in child.children if isinstance(c, Element) and not hidden(c) or isinstance(c, str) and c.strip()])
        elif child.tag in ("td", "th"):
            rows.append([child])
        else:
            rows.append([_cell(child)])
    return captions, rows


def _cell(child) -> Element:
    cell = Element("td")
    cell.children.append(child)
    return cell


def numbering(parent: Element | None) -> tuple[int, int]:
    """The step and the first number of a list's items; a reversed list counts down to 1, or from where it starts."""
    if parent is None or parent.tag != "ol":
        return 1, 1
    start, down = parent.get("start") or "", "reversed" in parent.attributes.lower() and parent.get("reversed") is not None
    if re.fullmatch(r"-?\d{1,9}", start):
        return -1 if down else 1, int(start)
    return (-1, sum(isinstance(c, Element) and c.tag == "li" for c in parent.children)) if down else (1, 1)


def unfolded(e: Element) -> list:
    """The children of an element that are shown: of a closed details its first summary only."""
    if e.tag != "details" or e.get("open") is not None:
        return e.children
    return [c for c in e.children if isinstance(c, Element) and c.tag == "summary"][:1]


def _span(cell: Element, name: str, most: int) -> int:
    """How many columns or rows a cell takes; a rowspan of 0 takes all that follow."""
    text = (cell.get(name) or "1").strip()
    if not text.isdecimal() or int(text) == 0 and name == "colspan":
        return 1
    return min(int(text), most) or most


def table_lines(table: Element, seen: bool) -> tuple[list[str], list[str]]:
    """The captions, and the rows with cells padded to columns and two spaces between; a cell's lines stay apart."""
    captions, rows = table_rows(table)
    grid: list[list[list[str]]] = []
    below: dict[int, int] = {}  # columns that a cell from above takes, and for how many rows yet
    for row in rows:
        cells: list[list[str]] = []
        taken: dict[int, int] = {}

        def skip() -> None:
            while below.get(len(cells), 0) > 0:
                cells.append([""])

        for cell in row:
            skip()
            text = render(cell, shown(cell, seen)).split("\n")
            wide, high = _span(cell, "colspan", 1000), _span(cell, "rowspan", 65534)
            if high > 1:
                taken |= dict.fromkeys(range(len(cells), len(cells) + wide), high)
            cells += [text, *[[""]] * (wide - 1)]
        skip()
        below = {c: n - 1 for c, n in (below | taken).items() if n > 1}
        if any(any(x) for x in cells):
            grid.append(cells)
    widths: list[int] = []
    for cells in grid:
        widths += [0] * (len(cells) - len(widths))
        for i, cell in enumerate(cells):
            widths[i] = max(widths[i], *(columns_wide(x) for x in cell))
    lines = []
    for cells in grid:
        for k in range(max(map(len, cells))):
            parts = [(c[k] if k < len(c) else "") for c in cells]
            lines.append("  ".join(p + " " * (widths[i] - columns_wide(p)) for i, p in enumerate(parts)).rstrip())
    return [render(c, shown(c, seen)) for c in captions], lines


def render(root: Element, seen: bool = True) -> str:
    """All visible text below an element; seen: whether text in it is. Works through an own stack, and calls itself for
    cells only."""
    page = Page()
    # (what to do, element, parent, preformatted, list depth, whether text is visible)
    todo: list[tuple] = [("in", c, root, False, 0, seen) for c in reversed(root.children)]
    numbers: dict[int, int] = {}
    steps: dict[int, int] = {}
    while todo:
        what, e, parent, pre, depth, seen = todo.pop()
        if isinstance(e, str):
            if seen:
                page.text(e, pre)
            continue
        tag = e.tag
        if what == "out":
            page.flush()
            if tag in ("li", "blockquote", "dd"):
                page.indents.pop()
                page.mark = None
            if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and depth):
                page.blank = True
            continue
        if hidden(e):
            continue
        seen = shown(e, seen)
        if tag == "br":
            if page.parts:
                page.flush()
            elif page.lines:
                page.blank = True
        elif tag == "img":
            if seen and (alt := (e.get("alt") or "").strip()):
                page.text(alt, False)
        elif tag == "table":
            page.flush()
            page.blank = True
            captions, lines = table_lines(e, seen)
            for line in "\n".join([*captions, *lines]).split("\n"):
                page.add(line)
                page.flush()
            page.blank = True
        elif tag in BLOCKS:
            page.flush()
            if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and depth):
                page.blank = True
            if tag == "hr":
                continue
            below = depth + (tag in ("ul", "ol", "menu", "dir"))
            if tag == "li":
                start = e.get("value") or ""
                step, first = numbering(parent) if id(parent) not in numbers else (steps[id(parent)], 0)
                number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else numbers.get(id(parent), first - step) + step
                numbers[id(parent)], steps[id(parent)] = number, step
                mark = list_mark(e, parent, number, max(0, depth - 1))
                page.mark = (len(page.indents), mark)
                page.indents.append(" " * len(mark))
            elif tag == "blockquote":
                page.indents.append("> ")
            elif tag == "dd":
                page.indents.append("    ")
            todo.append(("out", e, parent, pre, depth, seen))
            todo += [("in", c, e, pre or tag == "pre", below, seen) for c in reversed(unfolded(e))]
        elif tag in ("td", "th", "text", "svg"):
            page.space = True
            todo.append(("in", " ", e, False, depth, True))
            todo += [("in", c, e, pre, depth, seen) for c in reversed(e.children)]
        else:
            todo += [("in", c, e, pre or tag in ("textarea", "xmp"), depth, seen) for c in reversed(e.children)]
    return page.rendering()


def visible_text(page: str | None) -> str:
    if not page:
        return ""
    # render() and table_lines() call each other once for each level of tables
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 1000 + 4 * page.lower().count("<table")))
    try:
        return render(parse(page))
    finally:
        sys.setrecursionlimit(before)


def extract(pages: DataFrame, source: str = "html", out: str = "text") -> DataFrame:
    """pages with the visible text of each; one pass, no shuffle."""

    def make(column: pa.Array, arrow: pa.DataType) -> pa.Array:
        return pa.array([visible_text(x.as_py()) for x in column], arrow)

    return with_column(pages, out, T.StringType(), pa.string(), source, make)
