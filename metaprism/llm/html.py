"""Layout-aware rendering of HTML to text.

A tree builder with implied tags turns any markup into a tree; visibility
rules drop what a browser does not show; the renderer emits all visible text
with block spacing, list marks and aligned table cells.  Formulas, text in
diagrams and text areas count as visible, so do labels of buttons and what
stands in an object without data; options of a select do not, nor do closed
dialogs and the bodies of closed details.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from html import unescape
from typing import Generator, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist "
                   "input select title meta link base area param source track col colgroup".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search "
                  "section summary table tbody td tfoot th thead tr ul".split())
SPACED = frozenset("p blockquote dl figure h1 h2 h3 h4 h5 h6 ol pre table ul menu dir fieldset".split())
CLOSES_P = BLOCK - frozenset("body caption dd dt html legend li tbody td tfoot th thead tr".split())
LISTS = frozenset("ul ol menu dir".split())
SCOPES = frozenset("table td th caption html button object template".split())
#: What svg and math do not show; elsewhere these names are plain elements.
UNSEEN = {"svg": frozenset("defs symbol clippath mask pattern marker filter lineargradient radialgradient metadata desc title".split()),
          "math": frozenset("annotation annotation-xml".split())}
#: An opening tag closes these open elements, up to the given fences.
IMPLIED = {
    "li": (frozenset(["li"]), LISTS | SCOPES),
    "dt": (frozenset(["dt", "dd"]), SCOPES | {"dl"}), "dd": (frozenset(["dt", "dd"]), SCOPES | {"dl"}),
    "option": (frozenset(["option"]), frozenset(["select"])), "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset(["body"])),
}
FORMATTING = frozenset("a b big code em font i s small strike strong tt u".split())
TABLE_FENCES = frozenset(["td", "th", "caption", "table"])
IN_HEAD = frozenset("base link meta noscript script style template title head html".split())
#: Tables, quotes and items that may lay out one line; deeper ones are plain blocks.
MAX_LAYOUT = 200
#: Blank places below row spans, a cell of the table, up to which they are laid
#: out; markup beyond it has its row spans read as 1, so that a page cannot ask
#: for a text that grows with its square.  No text is lost.
MAX_BLANK = 50

_TAG = re.compile(r"<(?:(?P<comment>!--)|(?P<other>[!?])|(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*))")
_ATTR = re.compile(r"""[\s/]*(?:(?P<end>>)|(?P<name>[^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"(?P<d>[^"]*)"|'(?P<s>[^']*)'|(?P<u>[^\s>]*)))?)""")
_GAP = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("tag", "attrs", "items")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.items = tag, attrs, []


def _attributes(html: str, at: int) -> tuple[dict, int, bool]:
    """Attributes from ``at`` to after the closing bracket (or the end), and
    whether the tag closes itself."""
    attrs: dict = {}
    while at < len(html):
        m = _ATTR.match(html, at)
        if m is None:
            at += 1
            continue
        at = m.end()
        if m["end"]:
            return attrs, at, m[0].endswith("/>")
        value = m["d"] if m["d"] is not None else m["s"] if m["s"] is not None else m["u"]
        attrs.setdefault(m["name"].lower(), unescape(value) if value else "")
    return attrs, at, False


def tokens(html: str) -> Iterator[tuple]:
    """("text", s), ("raw", s), ("open", name, attrs, closes itself), ("close", name)."""
    at, n, lower, foreign = 0, len(html), None, 0
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            yield "text", html[at:]
            return
        if m.start() > at:
            yield "text", html[at:m.start()]
        if m["comment"]:
            end = html.find("-->", m.end())
            short = re.compile(r"-?>").match(html, m.end())
            at = short.end() if short else n if end < 0 else end + 3
        elif m["other"]:
            end = html.find(">", m.end())
            at = n if end < 0 else end + 1
        else:
            name = m["name"].lower()
            attrs, at, closed = _attributes(html, m.end())
            if m["close"]:
                yield "close", name
                foreign = max(foreign - (name in UNSEEN), 0)
                continue
            yield "open", name, attrs, closed
            foreign += name in UNSEEN and not closed
            if name in RAW and not (closed and foreign):
                lower = html.lower() if lower is None or len(lower) != n else lower
                if len(lower) != n:  # lower-casing changed the length: search without it
                    found = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, at)
                    end = found.start() if found else n
                else:
                    end = lower.find(f"</{name}", at)
                    end = n if end < 0 else end
                if end > at:
                    yield "raw", html[at:end]
                at = end


def build(html: str) -> Node:
    """The tree, with html, body, paragraphs, items, cells and rows closed
    where the markup implies it.  Any input gives a tree."""
    root = Node("html", {})
    head, body = Node("head", {}), Node("body", {})
    root.items = [head, body]
    stack, in_head = [root, body], True
    at: dict = {}  # tag -> its places on the stack
    blocks: list = []  # places of block elements
    unsettled = False  # whether anything is there for _settle

    def push(node):
        stack[-1].items.append(node)
        at.setdefault(node.tag, []).append(len(stack))
        if node.tag in BLOCK:
            blocks.append(len(stack))
        stack.append(node)

    def pop_to(index):
        while len(stack) > max(index, 2):
            tag = stack.pop().tag
            at[tag].pop()
            if tag in BLOCK:
                blocks.pop()

    def last(names):
        return max((at[x][-1] for x in names if at.get(x)), default=-1)

    def close(names, fences):
        """Close back to the outermost of ``names`` that no fence hides."""
        fence = last(fences - names)
        found = [at[x][i] for x in names if at.get(x) for i in [bisect_right(at[x], fence)] if i < len(at[x])]
        if found:
            pop_to(min(found))

    for t in tokens(html):
        kind = t[0]
        if stack[-1].tag == "colgroup" and (t[1] not in ("col", "template", "colgroup") if kind == "open" else kind == "text" and t[1].strip()):
            pop_to(len(stack) - 1)  # its end tag is optional
        if kind in ("text", "raw"):
            source = kind == "raw" and stack[-1].tag != "textarea"
            stack[-1].items.append(t[1] if source or "&" not in t[1] else unescape(t[1]))
            continue
        name = t[1]
        if kind == "open" and (name == "details" or (t[2] and "visibility" in t[2].get("style", "").lower())):
            unsettled = True
        if kind == "close":
            if name in ("html", "body"):
                continue
            if name == "br":
                stack[-1].items.append(Node("br", {}))
            elif name == "p" and not at.get("p"):
                stack[-1].items.append(Node("p", {}))
            elif at.get(name):
                fences = TABLE_FENCES - {name} if name not in ("table", "tr", "tbody", "thead", "tfoot") else (
                    frozenset(["table"]) if name != "table" else frozenset())
                i = at[name][-1]
                # formatting that a block end cuts off stays open inside the next text only where it was opened
                if i > last(fences) and not (name in FORMATTING and blocks and blocks[-1] > i):
                    pop_to(i)
            continue
        if name in ("html", "body"):
            for k, v in t[2].items():
                (root if name == "html" else body).attrs.setdefault(k, v)
            continue
        if name == "head":
            continue
        if name in IMPLIED:
            names, fences = IMPLIED[name]
            if any(at.get(x) for x in names):
                close(names, fences)
        if name in CLOSES_P and at.get("p"):
            close(frozenset(["p"]), SCOPES | {"button"})
        if name in ("td", "th") and at.get("table") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            push(Node("tr", {}))
        node = Node(name, t[2])
        svg, math = last(("svg",)), last(("math",))
        foreign = max(svg, math) > last(("foreignobject",))
        if foreign and name in UNSEEN["svg" if svg > math else "math"]:
            node.attrs["hidden"] = ""
        if name in VOID or (t[3] and (foreign or name in UNSEEN)):
            stack[-1].items.append(node)
        else:
            push(node)
    return _settle(root) if unsettled else root


#: What the two properties may be set to here.
STYLES = {"display": frozenset("none block inline inline-block flex inline-flex grid inline-grid flow-root contents list-item table "
                               "inline-table table-row table-cell table-row-group table-header-group table-footer-group initial".split()),
          "visibility": frozenset("visible hidden collapse initial".split())}
BUTTONS = frozenset("submit reset button".split())


def _style(node: Node) -> dict:
    """display and visibility as the style attribute sets them: the last
    declaration counts, important ones before others."""
    found: dict = {}
    forced = set()
    for part in node.attrs["style"].lower().split(";"):
        k, _, v = part.partition(":")
        k = k.strip()
        if k in STYLES:
            v, _, mark = v.partition("!")
            v, strong = v.strip(), mark.strip() == "important"
            if v in STYLES[k] and (strong or k not in forced):
                found[k] = v
                if strong:
                    forced.add(k)
    return found


def visible(node: Node) -> bool:
    """Whether the element takes part in the layout.  What is only without ink
    (``visibility``) does; ``_settle`` has emptied it."""
    tag, a = node.tag, node.attrs
    if tag in HIDDEN and not (tag == "object" and "data" not in a) and not (
            tag == "input" and a.get("value") and a.get("type", "").lower() in BUTTONS):
        return False
    if tag == "dialog" and "open" not in a:
        return False
    if not a:
        return True
    return "hidden" not in a and not (a.get("style") and _style(node).get("display") == "none")


def _settle(root: Node) -> Node:
    """Takes out the bodies of closed details and all that ``visibility``
    hides.  It is inherited, until an element below sets it back.  A hidden
    cell stays, empty, in a row that is not hidden."""
    order, todo, any_dark = [], [(root, False)], False
    while todo:
        node, dark = todo.pop()
        if node.attrs.get("style"):
            v = _style(node).get("visibility")
            dark = dark if v is None else v in ("hidden", "collapse")
            any_dark = any_dark or dark
        if node.tag == "details" and "open" not in node.attrs:
            node.items = [x for x in node.items if isinstance(x, Node) and x.tag == "summary"][:1]
        order.append((node, dark))
        todo.extend((x, dark) for x in node.items if isinstance(x, Node))
    if not any_dark:
        return root
    gone, blank = set(), set()
    for node, dark in reversed(order):  # children before what holds them
        node.items = [x for x in node.items if (id(x) not in gone if isinstance(x, Node) else not dark)]
        if dark and all(id(x) in blank for x in node.items):
            if node.tag in ("td", "th"):
                node.items = []
                blank.add(id(node))
            else:
                gone.add(id(node))
    return root


class _Writer:
    """Collects lines: runs of white space collapse, blocks start lines,
    spaced blocks are set off by one empty line."""

    def __init__(self):
        self.lines, self.now, self.space, self.blank = [], [], False, 0

    def text(self, s: str, pre: bool = False):
        if pre:
            for i, line in enumerate(s.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
                if i:
                    self.flush(True)
                if line:
                    self.now.append(line)
            return
        parts = _GAP.split(s)
        if len(parts) > 1 and not parts[0]:
            self.space = True
        words = [p for p in parts if p]
        if words:
            if self.space and self.now:
                self.now.append(" ")
            self.now.append(" ".join(words))
            self.space = False
        if len(parts) > 1 and not parts[-1]:
            self.space = True

    def flush(self, keep_empty: bool = False):
        if self.now or keep_empty:
            while self.blank > 0 and self.lines:
                self.lines.append("")
                self.blank = 0
            self.blank = 0
            self.lines.append("".join(self.now).rstrip(" \t"))
            self.now = []
        self.space = False

    def gap(self):
        self.flush()
        self.blank = 1

    def block(self, lines: list, first: str = "", rest: str = ""):
        self.flush()
        for i, line in enumerate(lines):
            mark = first if i == 0 else rest
            self.now = [mark + line if line else mark.rstrip()]
            self.flush(True)


def _width(s: str) -> int:
    """Columns a line takes: wide characters two, marks none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _parts(table: Node) -> tuple[Node, list]:
    """The visible rows, each with the section it is in, below sections and any
    other wrapper, and the rest as a tree of its own.  Rows of nested tables and
    rows are not looked for."""
    order, above = [], {}
    todo = [table]
    while todo:  # elements that can hold rows, each after the one around it
        node = todo.pop()
        order.append(node)
        for x in node.items:
            if isinstance(x, Node) and x.items and x.tag not in ("tr", "table", "td", "th") and visible(x):
                above[id(x)] = node
                todo.append(x)
    holds = set()
    for node in reversed(order):
        if id(node) in holds or any(isinstance(x, Node) and x.tag == "tr" for x in node.items):
            holds.add(id(node))
            if node is not table:
                holds.add(id(above[id(node)]))
    loose, rows = Node("div", {}), []
    todo = [(iter(table.items), loose, None)]
    while todo:
        items, into, outer = todo[-1]
        for x in items:
            if not isinstance(x, Node):
                into.items.append(x)
            elif x.tag == "tr":
                if visible(x):
                    rows.append((into, x))
            elif id(x) in holds or (x.tag in ("thead", "tbody", "tfoot") and visible(x)):
                todo.append((iter(x.items), Node(x.tag, x.attrs), into))
                break
            else:
                into.items.append(x)
        else:
            todo.pop()
            if outer is not None and any(isinstance(x, Node) or x.strip() for x in into.items):
                outer.items.append(into)
    return loose, rows


def _span(cell: Node, name: str, most: int) -> int:
    v = cell.attrs.get(name, "")
    if not (v.isascii() and v.isdigit() and len(v) < 7):
        return 1
    return min(int(v), most) or (most if name == "rowspan" else 1)


class _Cell:
    """A cell with its lines, the columns and rows it takes, and how many of
    its lines are printed."""
    __slots__ = ("text", "cols", "rows", "col", "done")

    def __init__(self, text: list, cols: int = 1, rows: int = 1):
        self.text, self.cols, self.rows, self.col, self.done = text, cols, rows, 0, 0


def _place(rows: list) -> list:
    """Deals the cells of ``[(section, cells)]`` to columns: each takes the
    first free ones that hold it whole, beside those that reach down from rows
    above.  Row spans end with their section.  Per row its cells from left to
    right as (cell, begins here, ends here)."""
    n, blanks, allowed = len(rows), 0, MAX_BLANK * sum(len(cells) for _, cells in rows)
    last = list(range(n))  # last row of the section of each row
    for r in range(n - 2, -1, -1):
        if rows[r][0] is rows[r + 1][0]:
            last[r] = last[r + 1]
    out, down = [], []  # cells that reach further down, with their last row
    for r, (_, cells) in enumerate(rows):
        slots, col, i = [], 0, 0
        for cell in cells:
            while i < len(down) and down[i][0].col < col + cell.cols:
                slots.append((*down[i], False))
                col = down[i][0].col + down[i][0].cols
                i += 1
            cell.col = col
            col += cell.cols
            slots.append((cell, min(r + cell.rows - 1, last[r]), True))
        slots += [(*d, False) for d in down[i:]]
        down = [(c, end) for c, end, _ in slots if end > r]
        blanks += len(slots) - len(cells)
        if blanks > allowed:
            for _, again in rows:
                for c in again:
                    c.rows = 1
            return _place(rows)
        out.append([(c, begins, end == r) for c, end, begins in slots])
    return out


def _columns(cells: list) -> list:
    """Counts only columns in which a cell begins and returns where each
    begins, and the end: from left to right, each as soon as all cells before it
    and a bar have room."""
    starts = sorted({c.col for c in cells})
    ending: list = [[] for _ in starts]
    for c in cells:
        first = bisect_left(starts, c.col)
        c.col, c.cols = first, bisect_left(starts, c.col + c.cols) - first
        ending[first + c.cols - 1].append(c)
    left = [0]
    for here in ending:
        left.append(max([left[-1] + 3] + [left[c.col] + 3 + max(map(_width, c.text), default=0) for c in here]))
    return left


def _run(step: Generator):
    """The result of a rendering step.  Steps yield the steps they need the
    result of, so that nesting takes no recursion."""
    stack, value = [step], None
    while stack:
        try:
            step, value = stack[-1].send(value), None
        except StopIteration as done:
            stack.pop()
            value = done.value
        else:
            stack.append(step)
    return value


def _table(node: Node, out: _Writer, level: int, deep: int) -> Generator:
    """Cells side by side, every column as wide as its widest line, cells below
    a row span in the columns that it leaves free."""
    loose, rows = _parts(node)
    lines = yield _lines(loose, level, deep)
    if lines:
        out.block(lines)
    grid = []
    for section, tr in rows:
        cells = []
        for c in tr.items:
            if isinstance(c, Node) and c.tag in ("td", "th") and visible(c):
                cells.append(_Cell((yield _lines(c, level, deep)), _span(c, "colspan", 1000), _span(c, "rowspan", 65534)))
        stray = Node("div", {})
        stray.items = [c for c in tr.items if not (isinstance(c, Node) and c.tag in ("td", "th"))]
        extra = yield _lines(stray, level, deep)
        if extra:
            cells.append(_Cell(extra))
        grid.append((section, cells))
    placed = _place(grid)
    left = _columns([c for _, cells in grid for c in cells])
    for slots in placed:
        # a cell that goes on below prints one line beside each line of its rows, the rest with its last row
        due = [len(c.text) - c.done if ends else min(len(c.text), 1) if begins else 0 for c, begins, ends in slots]
        tail = max((k for k, (_, begins, _) in enumerate(slots) if begins), default=-1)
        for _ in range(max(due, default=0)):
            line, width, shown = "", 0, tail
            for k, (c, _, _) in enumerate(slots):
                if c.done < len(c.text) and c.text[c.done]:
                    shown = max(shown, k)
            for k, (c, _, _) in enumerate(slots):
                if k <= shown:
                    line += " " * (left[c.col] - 3 * (k > 0) - width) + (" | " if k else "")
                    text = c.text[c.done] if c.done < len(c.text) else ""
                    line, width = line + text, left[c.col] + _width(text)
                c.done += 1
            out.block([line.rstrip()])


def _list(node: Node, out: _Writer, level: int, deep: int) -> Generator:
    v = node.attrs.get("start", "")
    number = int(v) if re.fullmatch(r"-?[0-9]{1,9}", v) else 1
    for x in node.items:
        if not isinstance(x, Node):
            out.text(x)
        elif visible(x):
            if x.tag == "li":
                mark = f"{number}. " if node.tag == "ol" else "- "
                number += 1
                lines = yield _lines(x, level + 1, deep)
                if lines:
                    out.block(lines, mark, " " * len(mark))
            else:
                yield _render(x, out, level, False, deep)


def _lines(node: Node, level: int, deep: int) -> Generator:
    """The children of an element as lines of their own."""
    inner = _Writer()
    for x in node.items:
        if isinstance(x, Node):
            yield _render(x, inner, level, False, deep + 1)
        else:
            inner.text(x)
    inner.flush()
    return inner.lines


def _render(node: Node, out: _Writer, level: int = 0, pre: bool = False, deep: int = 0) -> Generator:
    if not visible(node):
        return
    tag = node.tag
    if tag == "br":
        out.flush(True)
        return
    if tag == "hr":
        out.block(["---"])
        return
    if tag == "img":
        if node.attrs.get("alt"):
            out.text(node.attrs["alt"])
        return
    if tag == "wbr":
        return
    if tag == "input":
        out.text(node.attrs["value"])
        return
    block, spaced = tag in BLOCK, tag in SPACED and not (tag in LISTS and level)
    if spaced:
        out.gap()
    elif block:
        out.flush()
    flat = deep >= MAX_LAYOUT
    if tag == "table" and not flat:
        yield _table(node, out, level, deep)
    elif tag in LISTS and not flat:
        yield _list(node, out, level, deep)
    elif tag == "blockquote" and not flat:
        out.block((yield _lines(node, level, deep)), "> ", "> ")
    elif tag == "dd" and not flat:
        out.block((yield _lines(node, level, deep)), "    ", "    ")
    else:
        pre = pre or tag in ("pre", "listing", "textarea")
        first = True
        for x in node.items:
            if isinstance(x, Node):
                yield _render(x, out, level, pre, deep)
            else:
                out.text(x[1:] if pre and first and tag in ("pre", "textarea") and x[:1] == "\n" else x, pre)
            first = False
    if spaced:
        out.gap()
    elif block:
        out.flush()


def render(html: str | None) -> str:
    """All visible text of a page; null and empty pages give empty text."""
    if not html:
        return ""
    out = _Writer()
    _run(_render(build(html), out))
    out.flush()
    return "\n".join(out.lines)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text, n_lines) per row.

    Null and empty html give empty text; broken markup always gives a tree;
    nesting has no bound, only beyond ``MAX_LAYOUT`` tables, quotes and items
    around each other the inner ones are plain blocks, no text is lost;
    repeated rows and null ids each keep their row; an empty table gives no
    rows; other columns are never read.
    """
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([render(h) for h in b.tolist()], dtype=object)

    text = F.pandas_udf(run, "string").asNondeterministic()(F.col(html_col))
    return (pages.select(F.col(id_col).alias(id_col), text.alias("text"))
            .withColumn("n_lines", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long")))
