"""Layout-aware text of HTML pages.

One pass over the tags keeps the open elements as a chain, closes those that the markup implies are over, and leaves
out what is not shown.  Text goes to the flow it stands in, the page's or a table cell's: inline text runs on with
white space collapsed, blocks stand on lines of their own with blank lines around paragraphs, lists are marked and
indented, and the cells of a table are padded to common columns once the table ends.

Time and output grow in proportion to the page.  Nothing recurses or walks the open elements: the nearest one of a
name is kept by name.  Indents stop at LEVELS lists and columns at TABLES nested tables, and blanks that align a table
stay below a few times its text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^=>]++|=[ \t\n\f]*+(?:\"[^\"]*\"|'[^']*')?)*+)>|<[!?][^>]*>|</(?:[^a-zA-Z>][^>]*)?>|[^<]+|<", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/>][^\s=/>]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']?[^\s>]*))?")
INTEGER = re.compile(r"[ \t\n\f]*([+-]?)0*([0-9]+)", re.ASCII)
PLACED = re.compile(r"\sd?[xy]\s*=", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")
RAW_END = {
    t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|\Z", re.I) if t != "plaintext" else re.compile(r"\Z")
    for t in ("script", "style", "title", "textarea", "noembed", "noframes", "noscript", "iframe", "xmp", "plaintext")
}

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NOT_SHOWN = set("head script style template noscript title datalist noembed noframes iframe audio video canvas object param col colgroup rp progress meter".split())
IN_HEAD = set("head html title meta link base script style noscript template".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p plaintext pre search section summary table ul caption tr td th thead tbody tfoot listing xmp optgroup option".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure menu dir hr listing plaintext xmp".split())
#: inline elements whose end tag leaves the blocks in them open
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LISTS = {"ul", "ol", "menu", "dir"}
TABLE = {"table", "#table"}
GROUPS = {"thead", "tbody", "tfoot"}
CELLS = {"td", "th"}
IN_TABLE = {"table", "caption", "tr", *GROUPS, *CELLS}
#: a start tag closes the nearest open one of these, unless one of the second set stands between
CLOSES = {
    "li": ({"li"}, LISTS | TABLE | CELLS),
    "dt": ({"dt", "dd"}, {"dl"} | TABLE | CELLS),
    "dd": ({"dt", "dd"}, {"dl"} | TABLE | CELLS),
    "tr": ({"tr", "caption"}, TABLE),
    "td": (CELLS, {"tr"} | TABLE),
    "th": (CELLS, {"tr"} | TABLE),
    "caption": ({"caption"}, TABLE),
    **{t: (GROUPS | {"caption"}, TABLE) for t in GROUPS},
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"optgroup", "option"}, {"select", "datalist"}),
}
#: in an svg only text and foreignObject are shown, in a math all but annotations; these have other rules of parsing
FOREIGN = {"svg", "svg text", "math"}
NOT_DRAWN = {
    "svg": set("title desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient".split()),
    "svg text": set("title desc metadata".split()),
    "math": set("annotation annotation-xml mphantom".split()),
}
#: start tags that end an open svg or math
BREAKS_OUT = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
SCOPE = {"caption", "button", "object", "html"} | TABLE | CELLS
LEVELS, TABLES = 20, 20
GAP = 1000  # the most columns that one cell can span, and the most separators in a row without a cell between
#: kept spaces and tabs of preformatted text, as signs that no text can hold; \x0b is a line's end
_KEEP = {0x20: "\ud800", 0x0B: "\ud800", 0x09: "\ud801", 0x0A: "\x0b"}
_BACK = {0xD800: " ", 0xD801: "\t"}


class _Flow:
    """Lines of a page or of a table cell."""

    def __init__(self, depth: int) -> None:
        self.depth, self.gap = depth, False
        self.out: list[str] = []
        self.run: list[str] = []
        self.levels: list[list] = []  # mark, and whether a line has it

    def flush(self) -> None:
        if not self.run:
            return
        text = "".join(self.run)
        self.run.clear()
        new = [x.strip(" ") for x in SPACES.sub(" ", text).split("\x0b")]
        if "\ud800" in text or "\ud801" in text:
            new = [x.translate(_BACK) for x in new]
        a, b = 0, len(new)
        while a < b and not new[a].strip():
            a += 1
        while b > a and not new[b - 1].strip():
            b -= 1
        self.emit(new[a:b])

    def emit(self, lines: list[str]) -> None:
        if not lines:
            return
        if self.gap and self.out:
            self.out.append("")
        self.gap = False
        if not self.levels:
            self.out += lines
            return
        first = "".join(" " * len(mark) if used else mark for mark, used in self.levels)
        rest = " " * len(first)
        for level in self.levels:
            level[1] = True
        self.out.append(first + lines[0])
        self.out += [rest + x if x else x for x in lines[1:]]

    def boundary(self, spaced: bool) -> None:
        """A block starts or ends; a blank line is due if it is spaced, but not before the first line of a list item."""
        self.flush()
        self.gap |= spaced and (not self.levels or self.levels[-1][1])


class _Open:
    __slots__ = ("tag", "serial", "up", "down", "own_gone", "gone", "own_unseen", "unseen", "pre", "kind", "flow", "block", "spaced", "level", "held", "cells", "rows", "owner", "span", "number", "step")

    def __init__(self, tag: str, serial: int, up: _Open | None, flow: _Flow) -> None:
        self.tag, self.serial, self.up, self.flow, self.down = tag, serial, up, flow, None
        self.own_gone, self.own_unseen, self.kind = False, None, ""
        self.gone, self.unseen, self.pre = (up.gone, up.unseen, up.pre) if up else (False, False, False)
        self.block = self.spaced = False
        self.level = self.held = self.cells = self.rows = self.owner = None
        self.span, self.number, self.step = (1, 1), 0, 1


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        value = m[2] or ""
        if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1:
            value = value[1:-1]
        out.setdefault(m[1].lower(), html.unescape(value))
    return out


def _style(a: dict[str, str]) -> dict[str, str]:
    """The declarations of a style attribute, in lower case; the last of a name counts."""
    if "style" not in a:
        return {}
    parts = (x.partition(":") for x in re.sub(r"/\*.*?\*/", " ", a["style"], flags=re.S).split(";"))
    return {k.strip().lower(): v.replace("!important", "").strip().lower() for k, _, v in parts}


def _integer(x: str | None, default: int, least: int, most: int) -> int:
    """HTML's integers: a sign and digits at the start, whatever follows; held between least and most."""
    m = INTEGER.match(x) if x else None
    if not m:
        return default
    n = int(m[2]) if len(m[2]) < 10 else 10**9
    return max(least, min(most, -n if m[1] == "-" else n))


class _Page:
    def __init__(self) -> None:
        self.serial = 0
        self.flow = _Flow(0)
        self.top = self.root = _Open("", 0, None, self.flow)
        self.opens: dict[str, list[_Open]] = defaultdict(list)
        self.blocks: list[_Open] = []

    def nearest(self, tags: set[str]) -> _Open:
        """The innermost open element of some names; the root if there is none."""
        best = self.root
        for t in tags:
            own = self.opens.get(t)
            if own and own[-1].serial > best.serial:
                best = own[-1]
        return best

    def until(self, tags: set[str], stop: set[str]) -> None:
        """Closes up to the innermost open element of tags, unless one of stop is further in."""
        node = self.nearest(tags)
        if node.serial > self.nearest(stop - tags).serial:
            self.close_to(node)

    def close_to(self, node: _Open) -> None:
        while self.top.serial >= node.serial and self.top is not self.root:
            self.close()

    def push(self, tag: str) -> _Open:
        self.serial += 1
        node = _Open(tag, self.serial, self.top, self.top.flow)
        self.top.down, self.top = node, node
        self.opens[tag].append(node)
        if tag in BLOCK or tag == "#table":
            self.blocks.append(node)
        return node

    def start_layout(self, node: _Open) -> None:
        """What the start of an element that is shown does to the flow around it."""
        flow, tag = node.flow, node.tag
        if node.block:
            flow.boundary(node.spaced)
        if tag in ("li", "dd", "blockquote"):
            mark = "  "
            if tag == "li":
                around = self.nearest(LISTS)
                mark = "- "
                if around.tag == "ol" and around.serial > self.nearest(CELLS).serial:
                    mark = f"{around.number}. "
                    around.number += around.step
            if len(flow.levels) < LEVELS:
                node.level, node.held = [mark, False], (flow.gap, len(flow.out))
                flow.levels.append(node.level)
            elif tag == "li":
                flow.run.append(mark)
        elif tag in TABLE:
            node.rows = [] if flow.depth < TABLES else None
        elif tag == "tr":
            node.owner, node.cells = self.nearest(TABLE), []
        elif tag in CELLS:
            node.owner = self.nearest({"tr"})
            if node.owner.owner.rows is not None:
                node.flow = _Flow(flow.depth + 1)
                if node.owner.cells is None:
                    node.owner.cells = []
        elif node.kind == "svg text" and tag == "text":
            flow.run.append(" ")

    def close(self) -> None:
        node = self.top
        self.top = node.up
        self.top.down = None
        self.opens[node.tag].pop()
        if self.blocks and self.blocks[-1] is node:
            self.blocks.pop()
        if node.gone:
            return
        tag, flow = node.tag, node.flow
        if node.level is not None:
            flow.flush()
            flow.levels.pop()
            gap, n = node.held
            flow.gap = gap and len(flow.out) == n
        if tag in CELLS:
            flow.flush()
            if flow is not node.up.flow:
                node.owner.cells.append((flow.out, *node.span))
        elif tag == "tr":
            if node.owner.rows is not None and node.cells:
                node.owner.rows.append(node.cells)
        elif tag in TABLE and node.rows:
            flow.flush()
            flow.emit(_table(node.rows))
        if node.block:
            node.up.flow.boundary(node.spaced) if tag in CELLS else flow.boundary(node.spaced)
        if node.kind == "svg text" and tag == "text":
            flow.run.append(" ")

    def splice(self, node: _Open) -> None:
        """Ends a formatting element but not the blocks that are open in it."""
        self.opens[node.tag].pop()
        node.up.down, node.down.up = node.down, node.up
        if node.own_gone or node.own_unseen is not None:
            x = node.down
            while x is not None:
                was = x.gone
                x.gone = x.own_gone or x.up.gone
                x.unseen = x.up.unseen if x.own_unseen is None else x.own_unseen
                if was and not x.gone:
                    self.start_layout(x)
                x = x.down

    def leave_rows(self) -> None:
        """Ends rows outside a table where something follows that is no cell."""
        around = self.nearest({"#table"})
        if around is not self.root and around.serial > self.nearest(CELLS | {"table"}).serial:
            self.close_to(around)

    def text(self, raw: str) -> None:
        while self.top.tag == "head" and raw.strip():
            self.close()
        top = self.top
        if top.gone:
            return
        if top.kind in ("closed", "svg"):
            return
        if top.tag == "tr" or top.tag in GROUPS or top.tag in TABLE:
            if not raw.strip():
                return
            self.leave_rows()
            top = self.top
        if top.unseen:
            return
        text = html.unescape(raw) if "&" in raw else raw
        top.flow.run.append(text.translate(_KEEP) if top.pre else text.replace("\x0b", " "))

    def start(self, tag: str, raw: str) -> _Open | None:
        """The element that opens, or none."""
        if tag in BREAKS_OUT:
            while self.top.kind in FOREIGN:
                self.close()
        foreign = self.top.kind if self.top.kind in FOREIGN else ""
        if (foreign or tag in ("svg", "math")) and raw.endswith("/"):
            return None
        if tag not in IN_HEAD and self.opens["head"] and not foreign:
            self.close_to(self.opens["head"][0])
        if not foreign:
            self.imply(tag)
        low = raw.lower()
        read = "style" in low or "hidden" in low or tag in ("details", "dialog") or (tag in CELLS and "span" in low) or (tag in ("ol", "li") and low) or (foreign and "n" in low)
        a = _attributes(raw) if read else {}
        top = self.top
        if tag in VOID:
            if not top.gone and tag == "br":
                top.flow.run.append("\x0b")
            elif not top.gone and tag == "hr" and "hidden" not in a:
                top.flow.boundary(True)
            elif not top.gone and tag in ("img", "area") and "alt" in low:
                top.flow.run.append(" ")
            elif tag == "input" and "value" in low and not (top.gone or top.unseen):
                a = _attributes(raw)
                style = _style(a)
                if a.get("type", "").strip().lower() in ("submit", "reset", "button") and "hidden" not in a and style.get("display") != "none" and style.get("visibility") not in ("hidden", "collapse"):
                    top.flow.run.append(a.get("value", "").replace("\x0b", " "))
            return None
        node = self.push(tag)
        style = _style(a)
        display = style.get("display", "")
        node.own_gone = tag in NOT_SHOWN or display == "none" or ("hidden" in a and not display) or (tag == "dialog" and "open" not in a)
        node.own_gone |= top.tag == "details" and top.kind == "closed" and tag != "summary"
        seen = style.get("visibility", "")
        if foreign:
            node.own_gone |= tag in NOT_DRAWN[foreign] or a.get("display", "").strip().lower() == "none"
            seen = seen or a.get("visibility", "").strip().lower()
        if foreign or tag in ("svg", "math"):
            if tag in ("svg", "math"):
                node.kind = tag
            elif foreign == "svg" and tag == "text":
                node.kind = "svg text"
            elif tag not in ("foreignobject", "mi", "mo", "mn", "ms", "mtext"):
                node.kind = foreign
                if tag == "tspan" and PLACED.search(raw):
                    node.flow.run.append(" ")
        if seen in ("hidden", "collapse", "visible"):
            node.own_unseen = seen != "visible"
            node.unseen = node.own_unseen
        node.gone |= node.own_gone
        node.pre |= tag in ("pre", "listing", "xmp", "textarea", "plaintext") or style.get("white-space", "") in ("pre", "pre-wrap", "break-spaces")
        if not foreign:
            node.block = tag in BLOCK and tag not in ("tr", *GROUPS)
            if tag not in IN_TABLE and tag not in ("li", "dd", "blockquote"):
                node.block = (node.block or display in ("block", "flex", "grid", "flow-root", "list-item", "table")) and display not in ("inline", "contents")
            node.spaced = tag in SPACED and display != "contents" and not (tag in LISTS and self.nearest({"li"}).serial > self.nearest(CELLS).serial)
        if tag == "details" and "open" not in a:
            node.kind = "closed"
        elif tag in CELLS and a:
            node.span = (_integer(a.get("colspan"), 1, 1, 1000), _integer(a.get("rowspan"), 1, 0, 65534))
        elif tag == "ol":
            node.number, node.step = _integer(a.get("start"), 1, -(10**9), 10**9), -1 if "reversed" in a else 1
        elif tag == "li" and "value" in a and self.nearest(LISTS).tag == "ol":
            around = self.nearest(LISTS)
            around.number = _integer(a["value"], around.number, -(10**9), 10**9)
        if not node.gone:
            self.start_layout(node)
        return node

    def imply(self, tag: str) -> None:
        """Closes what a start tag ends, and opens what it implies."""
        if tag in BLOCK and tag not in IN_TABLE - {"table"} and tag not in ("html", "body", "option", "optgroup"):
            self.until({"p"}, SCOPE)
        if tag in ("tr", *GROUPS):
            self.until(CELLS, TABLE)
            self.until({"tr"}, TABLE)
        if tag in CLOSES:
            self.until(*CLOSES[tag])
        if tag not in IN_TABLE and (self.top.tag == "tr" or self.top.tag in GROUPS or self.top.tag == "#table"):
            self.leave_rows()
        if tag in IN_TABLE - {"table", "caption"}:
            table = self.nearest(TABLE)
            if table is self.root or (table.tag == "#table" and table.serial < self.nearest(CELLS | {"caption"}).serial):
                around = self.push("#table")
                around.block = True
                if not around.gone:
                    self.start_layout(around)
            if tag in CELLS and self.nearest({"tr"}).serial < self.nearest(TABLE).serial:
                row = self.push("tr")
                if not row.gone:
                    self.start_layout(row)

    def end(self, tag: str) -> None:
        if tag in ("body", "html"):
            return
        if tag == "br":
            if not self.top.gone:
                self.top.flow.run.append("\x0b")
            return
        scope = self.nearest(SCOPE - {tag})
        node = self.nearest(HEADINGS if tag in HEADINGS else {tag})
        if tag in TABLE or tag in IN_TABLE:
            self.until({tag}, set() if tag == "table" else TABLE - {tag})
        elif node.serial < scope.serial or node is self.root:
            if tag == "p" and not self.top.gone:
                self.top.flow.boundary(True)
        elif tag in BLOCK:
            if tag != "li" or self.nearest(LISTS).serial < node.serial:
                self.close_to(node)
        elif not self.blocks or self.blocks[-1].serial < node.serial:
            self.close_to(node)
        elif tag in FORMATTING:
            self.splice(node)


class _Held:
    """The columns that cells of rows above hold: disjoint spans, of which neighbours are one block for who passes them."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int, int]] = []  # from, to, the row until which it is held
        self.ends: list[tuple[int, int, int]] = []  # a heap of (until, from, to)
        self.first: list[int] = []  # where each block begins,
        self.last: list[int] = []  # and where it ends

    def free(self, at: int) -> int:
        """The first column from at on that is not held."""
        k = bisect_right(self.first, at) - 1
        return max(at, self.last[k]) if k >= 0 else at

    def hold(self, a: int, b: int, until: int) -> None:
        lo = bisect_right(self.spans, (a, a, 0))
        lo -= lo > 0 and self.spans[lo - 1][1] > a
        hi = bisect_left(self.spans, (b, b, 0))
        pieces, at = [], a
        for x, y, u in self.spans[lo:hi]:  # what overlaps is held by the longer of both
            if x < a:
                pieces.append((x, a, u))
            if at < x:
                pieces.append((at, x, until))
            pieces.append((max(x, a), min(y, b), max(u, until)))
            if y > b:
                pieces.append((b, y, u))
            at = min(y, b)
        if at < b:
            pieces.append((at, b, until))
        self.spans[lo:hi] = pieces
        for x, y, u in pieces:
            heappush(self.ends, (u, x, y))
        lo, hi = bisect_left(self.last, a), bisect_right(self.first, b)
        if lo < hi:
            a, b = min(a, self.first[lo]), max(b, self.last[hi - 1])
        self.first[lo:hi], self.last[lo:hi] = [a], [b]

    def release(self, row: int) -> None:
        """Frees what is held until this row."""
        while self.ends and self.ends[0][0] <= row:
            u, a, b = heappop(self.ends)
            k = bisect_left(self.spans, (a, b, u))
            if k == len(self.spans) or self.spans[k] != (a, b, u):
                continue  # it has been parted since
            del self.spans[k]
            k = bisect_right(self.first, a) - 1
            parts = [(x, y) for x, y in ((self.first[k], a), (b, self.last[k])) if x < y]
            self.first[k : k + 1], self.last[k : k + 1] = [x for x, _ in parts], [y for _, y in parts]


def _table(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of (lines, columns, rows that a cell spans; 0 rows: all below) in common columns.

    Every column that a row skips has its separator, so that its next cell stands in its own column; more than GAP
    skipped columns in a row stand as their number, |xN|.  The blanks that align cells stay below four times the text
    and 64 a cell: where they are used up, columns get narrower, and a column with cells far longer than the others is
    aligned to a shorter width, over which they run.
    """
    n_cells = sum(map(len, rows))
    size = sum(len(x) for row in rows for lines, _, _ in row for x in lines)
    left = 4 * size + 64 * n_cells
    placed: list[list[tuple[int, int, list[str]]]] = []
    held = _Held()
    for r, row in enumerate(rows):
        held.release(r)
        at, line, more = 0, [], []
        for lines, wide, deep in row:
            at = held.free(at)
            line.append((at, at + wide, lines))
            if deep != 1:
                more.append((at, at + wide, r + deep if deep else len(rows)))
            at += wide
        for span in more:
            held.hold(*span)
        placed.append(line)
    starts = sorted({a for line in placed for a, _, _ in line})  # columns in which no cell starts are none
    placed = [[(bisect_left(starts, a), bisect_left(starts, b), lines) for a, b, lines in line] for line in placed]
    lengths: list[list[int]] = [[] for _ in starts]
    for line in placed:
        for a, b, lines in line:
            if b - a == 1:
                lengths[a] += map(len, lines)
    widths = [0] * len(starts)
    for c, own in enumerate(lengths):
        own.sort()
        k, below, most = len(own) - 1, sum(own), 4 * sum(own) + 64 * len(own)
        while k > 0:
            below -= own[k]
            if own[k] * k - below <= most:
                break
            k -= 1
        widths[c] = own[k] if own else 0
    place = _places(widths)
    wider: dict[int, int] = {}
    for line in placed:  # what spans columns widens its last one
        for a, b, lines in line:
            if b - a > 1 and lines:
                wider[b - 1] = max(wider.get(b - 1, 0), max(map(len, lines)) - (place[b] - 3 - place[a]))
    for c, more in wider.items():
        if more > 0 and more * len(placed) <= 4 * size + 64 * n_cells:
            widths[c] += more
    place = _places(widths)
    out = []
    for line in placed:
        active, k = line, 0
        while active:
            if any(k < len(lines) and lines[k] for _, _, lines in active):
                parts, at = [], 0
                for i, (a, b, lines) in enumerate(active):
                    if a - at > GAP:
                        parts.append(f" |x{a - at}| ")
                    elif a > at and (gap := place[a] - place[at]) <= left:
                        left -= gap
                        parts += [" " * w + " | " for w in widths[at:a]]
                    else:
                        parts.append(" | " * (a - at))
                    text = lines[k] if k < len(lines) else ""
                    parts.append(text)
                    if i < len(active) - 1:
                        blank = max(0, min(left, place[b] - 3 - place[a] - len(text)))
                        left -= blank
                        parts.append(" " * blank + " | ")
                    at = b
                out.append("".join(parts).rstrip(" "))
            k += 1
            active = [x for x in active if k < len(x[2])]
    return out


def _places(widths: list[int]) -> list[int]:
    """Where each column starts."""
    out = [0]
    for w in widths:
        out.append(out[-1] + w + 3)
    return out


def page_text(page: str | None) -> str:
    """All visible text of an HTML page, laid out; null is empty."""
    if not page:
        return ""
    if "\r" in page:
        page = page.replace("\r\n", "\n").replace("\r", "\n")
    p, at, n, last = _Page(), 0, len(page), page.rfind(">")
    while at < n:
        if at > last:  # no tag ends any more, and a comment hides the rest
            p.text(page[at:].partition("<!--")[0])
            break
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if not tag:
            if m[0][0] != "<" or m.end() - m.start() == 1:
                p.text(m[0])
            elif m[0].startswith("<![CDATA[") and p.top.kind in FOREIGN:
                end = page.find("]]>", m.start() + 9)
                end = n if end < 0 else end
                if p.top.kind != "svg" and not p.top.gone and not p.top.unseen:
                    p.top.flow.run.append(page[m.start() + 9 : end].replace("\x0b", " "))
                at = end + 3
            continue  # comment, doctype, processing instruction
        tag = tag.lower()
        if m[1]:
            p.end(tag)
            continue
        node = p.start(tag, m[3])
        if node is not None and tag in RAW_END and node.kind not in FOREIGN:
            end = RAW_END[tag].search(page, at)
            if not node.gone and not node.unseen:
                text = page[at : end.start()]
                node.flow.run.append((html.unescape(text) if tag == "textarea" else text).translate(_KEEP))
            at = end.end()
            p.close()
    while p.top is not p.root:
        p.close()
    p.flow.flush()
    return "\n".join(p.flow.out)


def extract_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """A row for each page: page_id, url, text, n_lines, n_chars.

    text is what a reader sees, laid out line by line; a null or empty page, or one without visible text, has the
    empty text and 0 lines.  Rows that share a page_id are pages of their own.  Broken markup is read as far as it
    goes and never fails; a formatting element that is left open ends with its block.  Of form controls the labels of
    buttons are shown, given as text or as value, and not what fields, progress bars and meters hold.  Style sheets are not read:
    what hides is the hidden attribute, an element's own style, and elements that browsers do not show.  An empty
    table gives none; other columns are left out, whatever their names.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                texts = [page_text(x) for x in some.column(2).to_pylist()]
                columns = [some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([x.count("\n") + 1 if x else 0 for x in texts], pa.int64()), pa.array([len(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_lines", "n_chars"])

    bare = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    return bare.mapInArrow(each, "page_id long, url string, text string, n_lines long, n_chars long")
