"""Visible text of HTML pages, laid out as a reader sees it.

A tokenizer of one regular expression feeds a small tree builder: void elements, implied
end tags (a new ``p``, ``li``, ``td``, ``tr``, ``option``, ``dt`` closes the open one) and
implied starts (a cell outside a row opens one). A second walk drops what is not shown and
renders blocks, lists, preformatted text and tables with aligned cells. Pages are
independent, so the work is one pass without a shuffle.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm.store import text_batches

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
HIDDEN = frozenset(
    "head script style template noscript iframe noembed noframes object audio video canvas svg math datalist"
    " title meta link base param source track area map dialog".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre"
    " section summary ul table caption tbody thead tfoot tr".split()
)
#: Blocks with an empty line around them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure".split())
#: What an opening tag closes, and the elements that such closing doesn't leave.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
}
CLOSES["thead"] = CLOSES["tfoot"] = CLOSES["caption"] = CLOSES["colgroup"] = CLOSES["tbody"]
#: Elements whose start ends an open paragraph.
ENDS_P = BLOCK - frozenset("body html option optgroup tr tbody thead tfoot caption".split())
#: An end tag inside these doesn't close anything outside them.
SCOPE = frozenset(["table", "td", "th", "caption", "button", "object", "template", "html"])
#: Parts of a table that hold no text themselves, and what they do hold.
TABLE = frozenset(["table"])
TABLE_PARTS = frozenset("table tbody thead tfoot tr".split())
IN_TABLE = frozenset("caption colgroup col tbody thead tfoot tr td th script style template".split())
#: What deeper elements show counts as shown by the element at this depth.
MAX_DEPTH = 400
#: Cells up to this long set the width of their column; what follows a longer one starts a line of its own.
WIDE = 120
#: Kinds of inputs that don't show their value.
VALUELESS = frozenset("checkbox radio file image color range hidden password".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_SPACES = re.compile(r"[ \t\n\r\f]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)|content-visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "deep")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children, self.parent, self.deep = tag, attrs, [], None, False


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if "=" in raw or raw.strip("/ \t\n\r\f"):
        for name, a, b, c in _ATTR.findall(raw):
            out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def parse(page: str) -> Node:
    """The element tree; text is kept as strings among the children."""
    root = Node("html", {})
    stack, at, n = [root], 0, len(page)
    where: dict[str, list[int]] = {}  # places in the stack, so that no rule has to search it

    def push(node: Node) -> None:
        where.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def cut(i: int) -> None:
        while len(stack) > i:
            node = stack.pop()
            where[node.tag].pop()
            if node.deep and node.tag in BLOCK:
                node.children.append(Node("div", {}))

    def last(tags: frozenset[str]) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=0)

    def close(tags: frozenset[str], border: frozenset[str]) -> None:
        while (i := last(tags)) and i > last(border):
            cut(i)

    def place(what: Node | str) -> None:
        """Into the open element; what has no place in a table goes before it, as in browsers."""
        into, before = stack[-1], None
        if into.tag in TABLE_PARTS and not into.deep and not (isinstance(what, Node) and what.tag in IN_TABLE):
            before = stack[i] if (i := last(TABLE)) else None
            into = before.parent if before else into
        if isinstance(what, Node):
            what.parent = into
        held = into.children
        # the open table is among the last of its parent's children
        held.insert(next(i for i in range(len(held) - 1, -1, -1) if held[i] is before) if before else len(held), what)

    def put(text: str) -> None:
        if text and not (stack[-1].tag in TABLE_PARTS and not text.strip()):
            place(text)

    def start(tag: str, attrs: dict[str, str]) -> None:
        if tag in ENDS_P:
            close(frozenset(["p"]), SCOPE)
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            start("tr", {})
        node = Node(tag, attrs)
        if len(stack) < MAX_DEPTH:
            place(node)
            if tag not in VOID:
                push(node)
            return
        if tag in ("td", "th"):
            place(" ")
        place(node)
        if tag not in VOID:
            # open for the rules above; what it holds is its parent's, or nobody's if it is hidden
            inner = Node(tag, attrs)
            inner.deep = True
            if shown(node):
                inner.children = stack[-1].children
            push(inner)

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            put(entities.unescape(page[at:]))
            break
        if m.start() > at:
            put(entities.unescape(page[at : m.start()]))
        at = m.end()
        if tag := m["tag"]:
            tag = tag.lower()
            if tag in ("html", "body"):
                if tag == "body":
                    close(frozenset(["head"]), frozenset())
                stack[0].attrs = {**_attributes(m["attrs"]), **stack[0].attrs}
                continue
            start(tag, _attributes(m["attrs"]))
            if tag in RAW:
                shut = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                end = shut.start() if shut else n
                if tag in ("textarea", "xmp"):
                    put(entities.unescape(page[at:end]) if tag == "textarea" else page[at:end])
                if len(stack) > 1 and stack[-1].tag == tag:
                    cut(len(stack) - 1)
                at = n if shut is None else (page.find(">", end) + 1 or n)
        elif end_tag := m["end"]:
            end_tag = end_tag.lower()
            if end_tag == "br":
                start("br", {})
            elif end_tag == "p" and not where.get("p"):
                start("p", {})
                cut(len(stack) - 1)
            else:
                border = SCOPE if end_tag not in ("tr", "tbody", "thead", "tfoot", "table") else TABLE
                close_one = where.get(end_tag)
                if close_one and close_one[-1] > last(border - {end_tag}):
                    cut(close_one[-1])
        elif m["cdata"]:
            put(m["cdata"])
    return root


def shown(node: Node) -> bool:
    """Whether the element and what it holds can be seen at all."""
    a = node.attrs
    if node.tag in HIDDEN and not (node.tag == "dialog" and "open" in a):
        return False
    if not a:
        return True
    return not (
        "hidden" in a
        or (node.tag == "input" and a.get("type", "").lower() == "hidden")
        or ("style" in a and _UNSEEN.search(a["style"]))
    )


class _Page:
    """Lines of output with collapsed spaces and block gaps."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.gap = False
        self.prefix = ""
        self.mark = ""

    def text(self, s: str) -> None:
        parts = _SPACES.split(s)
        if len(parts) > 1 and parts[0] == "":
            self.space = True
        body = " ".join(p for p in parts if p)
        if not body:
            self.space = self.space or bool(s)
            return
        if self.line and self.space:
            self.line.append(" ")
        self.line.append(body)
        self.space = parts[-1] == ""

    def end(self) -> None:
        self.space = False
        if self.line:
            self.put("".join(self.line))
            self.line = []

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        lead = self.prefix
        if self.mark:
            lead, self.mark = self.prefix[: len(self.prefix) - len(self.mark)] + self.mark, ""
        self.lines.append((lead + line).rstrip() if not line.strip() else lead + line)

    def space_out(self) -> None:
        self.end()
        self.gap = True


def _walk(node: Node, page: _Page, depth: int = 0, number: list[int] | None = None) -> None:
    for child in node.children:
        if isinstance(child, str):
            page.text(child)
            continue
        if not shown(child):
            continue
        tag = child.tag
        if tag == "br":
            if page.line:
                page.end()
            else:
                page.put("")
        elif tag == "hr":
            page.space_out()
        elif tag == "img":
            if alt := child.attrs.get("alt", "").strip():
                page.text(alt)
        elif tag == "input":
            kind = child.attrs.get("type", "text").lower()
            if kind not in VALUELESS:
                page.text(child.attrs.get("value", ""))
            elif kind == "image":
                page.text(child.attrs.get("alt", ""))
        elif tag == "table":
            page.space_out()
            for line in _table(child):
                page.put(line)
            page.gap = True
        elif tag == "pre" or tag == "textarea":
            page.space_out()
            for line in _plain(child).strip("\n").split("\n"):
                page.put(line.rstrip())
            page.gap = True
        elif tag in ("ul", "ol", "menu", "dir"):
            if page.mark or page.prefix:
                page.end()
            else:
                page.space_out()
            start = child.attrs.get("start", "")
            count = [int(start) - 1 if re.fullmatch(r"-?[0-9]{1,9}", start) else 0] if tag == "ol" else None
            _walk(child, page, depth + 1, count)
            page.end()
            page.gap = page.gap or not page.prefix
        elif tag == "li":
            page.end()
            if number is not None:
                number[0] += 1
            mark = f"{number[0]}. " if number is not None else "- "
            kept, page.prefix = page.prefix, page.prefix + " " * len(mark)
            page.mark = mark
            _walk(child, page, depth, None)
            page.end()
            page.mark, page.prefix = "", kept
        elif tag in BLOCK:
            spaced = tag in SPACED
            page.end()
            page.gap = page.gap or (spaced and not page.mark)
            indent = "  " if tag in ("blockquote", "dd") else ""
            page.prefix += indent
            _walk(child, page, depth, number if tag not in ("div",) else None)
            page.end()
            if indent:
                page.prefix = page.prefix[: -len(indent)]
            page.gap = page.gap or spaced
        else:
            _walk(child, page, depth, number)


def _plain(node: Node) -> str:
    """Text with its own spaces and line breaks."""
    out = []
    for child in node.children:
        if isinstance(child, str):
            out.append(child)
        elif shown(child):
            out.append("\n" if child.tag == "br" else _plain(child))
    return "".join(out)


def _rows(node: Node) -> Iterator[Node]:
    for child in node.children:
        if isinstance(child, Node) and shown(child):
            if child.tag in ("tr", "caption"):
                yield child
            elif child.tag in TABLE_PARTS:
                yield from _rows(child)


def _span(cell: Node) -> int:
    span = cell.attrs.get("colspan", "1")
    return min(int(span), 100) if re.fullmatch(r"[1-9][0-9]{0,3}", span) else 1


def _table(table: Node) -> list[str]:
    """Rows with every cell at the place of its column; nested tables stay in one cell.

    A column is as wide as its longest cell of at most ``WIDE``. After a longer cell the rest of
    its row goes on in the next line, each cell still at its place, so a long cell
    costs no padding in other rows.
    """
    head: list[str] = []
    grid: list[list[str]] = []
    for row in _rows(table):
        if row.tag == "caption":
            head.append(" ".join(render(row).split()))
            continue
        cells: list[str] = []
        for cell in row.children:
            if isinstance(cell, Node) and cell.tag in ("td", "th") and shown(cell):
                cells.append(" ".join(render(cell).split()))
                cells.extend([""] * (_span(cell) - 1))
        if any(cells):
            grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for i, cell in enumerate(cells):
            widths[i] = max(widths.get(i, 0), len(cell) if len(cell) <= WIDE else 0)
    out = [h for h in head if h]
    for cells in grid:
        line, place = "", 0
        for i, cell in enumerate(cells):
            if cell:
                if line and len(line) > place - 2:
                    out.append(line)
                    line = ""
                line = line.ljust(place) + cell
            place += widths[i] + 2
        out.append(line)
    return out


def render(node: Node) -> str:
    page = _Page()
    _walk(node, page)
    page.end()
    return "\n".join(page.lines).strip("\n")


def visible_text(source: str | None) -> str:
    """All text that a page shows. Null or empty: the empty text."""
    if not source:
        return ""
    return render(parse(source.replace("\x00", "")))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """The given columns without ``html``, and ``text``: all visible text of the page.

    Null and empty pages give an empty text; broken markup is repaired like browsers do;
    repeated rows stay; a column named ``text`` that the input has is replaced. Only the
    page's own column goes to Python with a copy of the others.
    """
    text_batches(pages.sparkSession)
    rest = [F.col(f"`{c}`") for c in pages.columns if c not in (html, "text")]
    source = pages.select(*rest, F.col(html).cast("string").alias("__html"))
    schema = source.drop("__html").withColumn("text", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("__html")
            # a few pages at a time, so texts and trees of a batch never pile up
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = pa.array([visible_text(x.as_py()) for x in part.column(at)], pa.string())
                columns = [part.column(k) for k in range(part.num_columns) if k != at]
                names = [x for x in part.schema.names if x != "__html"]
                yield pa.RecordBatch.from_arrays([*columns, texts], [*names, "text"])

    return source.mapInArrow(run, schema)
