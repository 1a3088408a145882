"""HTML to text, laid out as it would be read.

A tree builder adds the end tags that HTML leaves out, visibility rules take away what no reader sees, and a
renderer emits all visible text: blocks on lines of their own with blank lines around paragraphs, list markers with
indentation, and table cells padded into columns. Both walk with explicit stacks, so depth costs no recursion.

Pages are independent, so this is one Arrow pass over the pages without a shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^>"']++)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
#: What is a tag even where the page ends before a >.
_OPEN_END = re.compile(r"<[!?].*\Z", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
_DECLARED = re.compile(r"(?<![\w-])(display|visibility)\s*+:\s*+([a-z-]++)", re.I)
_BLANK = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes datalist object audio video canvas map svg math link meta base".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split()
)
#: Blocks with a blank line before and after.
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
LISTS = frozenset("ul ol menu dir".split())
ROW_KINDS = frozenset("tr thead tbody tfoot".split())
#: A start tag closes the open element of these kinds, up to the kind of element that bounds the search.
CLOSES = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: An end tag doesn't reach beyond these unless it names them.
SCOPE = frozenset({"table", "td", "th", "caption", "button", "template", "html"})
EDGES = SCOPE | BLOCKS
#: Tables inside tables beyond this depth are written as plain blocks.
TABLE_DEPTH = 20
#: Most columns and rows that a cell spans, as in the HTML standard; spans end at that column of a table.
COLUMNS, ROWS = 1000, 65_534
#: Most characters of a column and of an indentation, characters that the columns of a table share, and what each has at least.
WIDEST, INDENT = 80, 120
LINE, NARROWEST = 2_000, 4
#: A table that would take more blanks than this is written without them, so that no page fills the memory of a task.
PADDING = 1 << 26


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str]
    children: list = field(default_factory=list)  # Node or str

    def hidden(self) -> bool:
        if self.tag in UNSEEN or "hidden" in self.attrs or self.tag == "dialog" and "open" not in self.attrs:
            return True
        if self.tag == "input" and self.attrs.get("type", "").lower() == "hidden":
            return True
        style = self.style()
        return style.get("display") == "none" or self.tag in ROW_KINDS and style.get("visibility") == "collapse"

    def style(self) -> dict[str, str]:
        """The last declarations of display and visibility."""
        return {m[1].lower(): m[2].lower() for m in _DECLARED.finditer(self.attrs["style"])} if "style" in self.attrs else {}

    def visible(self, inherited: bool) -> bool:
        """Whether text right in this element is seen; elements in it may say otherwise."""
        own = self.style().get("visibility", "")
        return own in ("visible", "initial") or own not in ("hidden", "collapse") and inherited


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        found.setdefault(m[1].lower(), html.unescape(value))
    return found


class _Open:
    """Open elements, with the places of each kind, so that no search walks down the stack."""

    def __init__(self, root: Node) -> None:
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.edges: list[int] = []

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag in SCOPE:
            self.scopes.append(at)
        if node.tag in EDGES:
            self.edges.append(at)

    def cut(self, at: int) -> None:
        """Ends all elements from place at on."""
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()
            if tag in EDGES:
                self.edges.pop()

    def last(self, kinds) -> int:
        """Place of the innermost open element of some kinds; 0 if there is none."""
        return max((own[-1] for k in kinds if (own := self.places.get(k))), default=0)

    def close(self, kinds, bounds) -> None:
        """Ends the innermost element of these kinds, with those of its kinds right around it, unless a bound is further in."""
        at = self.last(kinds)
        if at and at >= self.last(bounds) and at >= self.last(("table",)):
            while at > 1 and self.stack[at - 1].tag in kinds:
                at -= 1
            self.cut(at)

    def end(self, name: str) -> None:
        """What an end tag does."""
        at = self.last((name,))
        if at and (name in ("table", "tr", "tbody", "thead", "tfoot") or not self.scopes or at >= self.scopes[-1]):
            self.cut(at)

    def end_paragraph(self) -> None:
        """A block ends the paragraph that it is directly in."""
        if self.edges and self.stack[self.edges[-1]].tag == "p":
            self.cut(self.edges[-1])


def parse(page: str) -> Node:
    """The tree of a page, in one pass. Any text has one: what is not a tag is text, and open elements end with the page."""
    root = Node("html", {})
    stack = _Open(root)
    at, n, last_end = 0, len(page), page.rfind(">")

    def text(x: str) -> None:
        if x:
            stack.stack[-1].children.append(html.unescape(x) if "&" in x else x)

    while at < n:
        # without a > ahead nothing but a comment is a tag, so an open < does not search the rest again and again
        m = _TOKEN.search(page, at) if at <= last_end else _OPEN_END.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m.re is _OPEN_END:
            continue
        ends, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if ends:
            if name == "br":
                stack.stack[-1].children.append(Node("br", {}))
            else:
                stack.end(name)
            continue
        if name in ("html", "body"):
            root.attrs.update({k: v for k, v in _attributes(rest).items() if k not in root.attrs} if rest else {})
            if name == "body":
                stack.close(("head",), ())
            continue
        if name in BLOCKS:
            if stack.stack[-1].tag == "head":
                stack.close(("head",), ())
            stack.end_paragraph()
        if name in CLOSES:
            stack.close(*CLOSES[name])
        node = Node(name, _attributes(rest) if rest else {})
        stack.stack[-1].children.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if name == "textarea":
                node.children.append(html.unescape(page[at : end.start() if end else n]))
            at = end.end() if end else n
            if end:
                at = (page.find(">", at) + 1) or n
        elif name not in VOID:
            stack.push(node)
    return root


class _Page:
    """Lines under construction. gap: empty lines owed before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.blank = False
        self.indent: list[str] = []
        self.marker = ""

    def put(self, text: str) -> None:
        if not text:
            return
        if not self.line:
            self.lines.extend([""] * (self.gap if self.lines else 0))
            self.gap = 0
            lead = "".join(self.indent[:INDENT])[:INDENT]
            if self.marker:
                lead = lead[: -len(self.marker)] + self.marker if lead.endswith(" " * len(self.marker)) else lead + self.marker
                self.marker = ""
            self.line.append(lead)
        elif self.blank:
            self.line.append(" ")
        self.blank = False
        self.line.append(text)

    def flow(self, text: str) -> None:
        """Text outside pre: runs of blanks are one blank, and none at the ends of a line."""
        words = _BLANK.sub(" ", text)
        if words[:1] == " ":
            self.blank = self.blank or len(self.line) > 1
            words = words[1:]
        tail = words[-1:] == " "
        self.put(words[:-1] if tail else words)
        self.blank = self.blank or tail and len(self.line) > 1

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
        self.line, self.blank = [], False

    def block(self, space: bool) -> None:
        self.end_line()
        self.gap = max(self.gap, 1 if space else 0)


def _span(text: str, most: int) -> int:
    return min(most, max(1, int(text))) if text.isdecimal() and len(text) < 7 else 1


def _laid_out(rows: list[list[tuple]]) -> list[list[tuple]]:
    """Cells (content, columns, rows) -> (first column, columns, content); a cell leaves out what cells above it reach down to."""
    reach: dict[int, int] = {}  # column -> last row that a cell from above takes
    out = []
    for r, row in enumerate(rows):
        at, placed = 0, []
        for content, wide, high in row:
            while reach.get(at, -1) >= r:
                at += 1
            wide = max(1, min(wide, COLUMNS - at))
            placed.append((at, wide, content))
            if high > 1 and at < COLUMNS:
                reach.update((c, r + high - 1) for c in range(at, at + wide))
            at += wide
        out.append(placed)
    return out


def _wrapped(lines: list[str], most: int) -> list[str]:
    """Lines of at most so many characters, parted at blanks where there are any."""
    out = []
    for x in lines:
        at = 0
        while len(x) - at > most:
            cut = x.rfind(" ", at + 1, at + most + 1)
            if cut < 0 or x[at:cut].isspace():
                cut = at + most
            out.append(x[at:cut].rstrip())
            at = cut + (x[cut] == " ")
        out.append(x[at:] if at else x)
    return out


def _table(node: Node, depth: int, seen: bool, room: int) -> list[str]:
    """Lines of a table: caption, then rows whose cells start at the same places.

    Columns are as wide as their widest cell of one column, up to WIDEST, or their share of room where that is less. What is
    longer goes on in the next line below, unless nothing stands to the right of it. Cells may span columns and rows; one
    that spans columns narrower than it pushes the rest of its line. Invisible cells keep their places.
    """
    rows: list[list[tuple[tuple[Node, bool], int, int]]] = []
    captions: list[str] = []
    todo = [(node, seen)]
    while todo:
        own, seen = todo.pop()
        row: list[tuple[tuple[Node, bool], int, int]] | None = None
        later = []
        if own.tag == "tr":
            rows.append(row := [])
        for x in own.children:
            if isinstance(x, str):
                captions.extend([x.strip()] if seen and x.strip() else [])
            elif x.hidden():
                continue
            elif x.tag in ("td", "th"):
                if row is None:
                    rows.append(row := [])
                row.append(((x, x.visible(seen)), _span(x.attrs.get("colspan", "1"), COLUMNS), _span(x.attrs.get("rowspan", "1"), ROWS)))
            elif x.tag in ROW_KINDS:
                later.append((x, x.visible(seen)))
            else:
                captions.extend(y for y in render_node(x, depth + 1, x.visible(seen), room).split("\n") if y)
        todo.extend(reversed(later))
    placed = _laid_out(rows)
    columns = max((row[-1][0] + row[-1][1] for row in placed if row), default=1)
    most = max(NARROWEST, min(WIDEST, room // columns))
    widths = [0] * columns
    grid: list[list[tuple[int, int, list[str]]]] = []
    for row in placed:
        grid.append([])
        for k, (at, wide, (x, own)) in enumerate(row):
            last = k == len(row) - 1
            lines = render_node(x, depth + 1, own, max(most, room - at * (most + 2)) if last else most * wide).split("\n")
            if wide == 1:
                lines = lines if last else _wrapped(lines, most)
                widths[at] = max(widths[at], min(most, max(map(len, lines))))
            grid[-1].append((at, wide, lines))
    starts = [0]
    for w in widths:
        starts.append(starts[-1] + w + 2)
    for row in grid:
        for k, (at, wide, lines) in enumerate(row):
            if k < len(row) - 1 and wide > 1:
                row[k] = (at, wide, _wrapped(lines, max(most, starts[at + wide] - starts[at] - 2)))
            elif k == len(row) - 1 and room < LINE:  # in a cell of another table
                row[k] = (at, wide, _wrapped(lines, max(most, room - starts[at])))
    heights = [max((len(lines) for _, _, lines in row), default=0) for row in grid]
    pad = sum(h * starts[row[-1][0]] for h, row in zip(heights, grid, strict=True) if row) <= PADDING
    out = captions
    for height, row in zip(heights, grid, strict=True):
        for k in range(height):
            line: list[str] = []
            length = 0
            for at, _, lines in row:
                if k >= len(lines) or not lines[k]:
                    continue  # blanks are only made before text
                blanks = max(starts[at] - length, 2) if pad and at else 2 if length else 0
                line.append(" " * blanks + lines[k])
                length += blanks + len(lines[k])
            out.append("".join(line).rstrip())
    return [x for x in out if x]


def render_node(root: Node, depth: int = 0, seen: bool = True, room: int = LINE) -> str:
    """Text of a node's visible contents. seen: whether text right in it is visible; room: characters that tables in it share."""
    page = _Page()
    counts: list[int | None] = []
    pre = 0
    # entries: (node or text, done, seen): a node is met before and after its children
    todo: list[tuple[Node | str, bool, bool]] = [(x, False, seen) for x in reversed(root.children)]
    while todo:
        x, done, seen = todo.pop()
        if isinstance(x, str):
            if not seen:
                continue
            if pre:
                for i, part in enumerate(x.split("\n")):
                    if i:
                        page.line = page.line or [""]
                        page.end_line()
                    page.put(part)
            else:
                page.flow(x)
            continue
        t = x.tag
        if done:
            if t in LISTS:
                counts.pop()
            if t in LISTS or t in ("blockquote", "dd", "li"):
                page.indent.pop()
            pre -= t in ("pre", "textarea")
            page.block(t in SPACED and not (t in LISTS and counts))
            if t == "li":
                page.marker = ""
            continue
        if x.hidden():
            continue
        seen = x.visible(seen)
        if t == "br":
            if not seen:
                continue
            page.line = page.line or [""]
            page.end_line()
            continue
        if t == "table" and depth < TABLE_DEPTH:
            page.block(True)
            for line in _table(x, depth, seen, room):
                page.put(line)
                page.end_line()
            page.block(True)
            continue
        kids = x.children
        if t == "details" and "open" not in x.attrs:
            kids = [y for y in kids if isinstance(y, Node) and y.tag == "summary"]
        if t in BLOCKS or t in ("tr", "td", "th", "textarea"):
            page.block(t in SPACED and not (t in LISTS and counts))
            todo.append((x, True, seen))
            if t in LISTS:
                start = x.attrs.get("start", "1")
                counts.append((int(start) if start.isdecimal() and len(start) < 10 else 1) if t == "ol" else None)
                page.indent.append("")
            elif t == "li":
                mark = "- "
                if counts and counts[-1] is not None:
                    mark = f"{counts[-1]}. "
                    counts[-1] += 1
                page.indent.append(" " * len(mark))
                page.marker = mark if seen else ""
            elif t in ("blockquote", "dd"):
                page.indent.append("    ")
            pre += t in ("pre", "textarea")
        elif seen and t == "input" and x.attrs.get("type", "").lower() in ("submit", "button", "reset"):
            page.flow(x.attrs.get("value", ""))
        todo.extend((y, False, seen) for y in reversed(kids))
    page.end_line()
    while page.lines and not page.lines[-1]:
        page.lines.pop()
    return "\n".join(page.lines)


def html_text(page: str | None) -> str:
    """The visible text of a page; empty for null."""
    root = parse(page or "")
    return "" if root.hidden() else render_node(root, seen=root.visible(True))


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, text, n_lines, n_chars.

    Null and empty pages give empty texts. A page that is not HTML is text. Repeated rows, and rows with equal or null
    ids, are rendered one by one; other columns are ignored; an empty table gives an empty result.

    What depends on size: spans of cells end at COLUMNS columns and ROWS rows; a column is at most WIDEST characters wide, or
    LINE shared by all columns (but NARROWEST at least), and longer cells are wrapped; lines are indented by INDENT characters
    at most; tables deeper than TABLE_DEPTH in each other are written as plain blocks; a table that takes more than PADDING
    blanks, tens of megabytes, has none.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([html_text(x) for x in b.column(1).to_pylist()], pa.string())], names=["page_id", "text"])

    made = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, f"page_id {dict(pages.dtypes)[id_col]}, text string")
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return made.select("page_id", "text", lines.cast("long").alias("n_lines"), F.char_length("text").cast("long").alias("n_chars"))


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
