"""Page text against a second, plain implementation on trees, and on markup that is broken, deep or hostile."""

import random
import re
import time

import pytest

from gridsmith.llm import html_text


@pytest.mark.parametrize("page, want", [
    ("<b>a<p>b</b>c", "a\n\nbc"),
    ("<a>x<div>y</a>z</div>w", "x\nyz\nw"),
    ("<b hidden>a<p>b</b>c", "c"),
    ("<details class='span3'><summary>s</summary>no</details>t", "s\nt"),
    ("<details class=opened>no<summary>s</summary>no</details>t", "s\nt"),
    ("<div style='visibility:hidden'>no<span style='visibility:visible'>yes</span>no</div>", "yes"),
    ("<div style='--x:display:none'>yes</div><p style='DISPLAY : none !important'>no", "yes"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ('<ol start="--5"><li>a</ol>', "1. a"), ('<ol start="²"><li>a</ol>', "1. a"), ('<ol start="-3x"><li>a<li>b</ol>', "-3. a\n-2. b"),
    ("<ol><li>a<li value=7>b<li>c</ol>", "1. a\n7. b\n8. c"),
    (f"<table><tr><td colspan={'9' * 5000}>a<td>b<tr><td>c</table>", "a | b\nc"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
    ("<table><tr><td>a<br>b<td>c<tr><td>longer<td>d</table>", "a      | c\nb\nlonger | d"),
    ("<table><tr><td>|</table>", "|"),
    ("<table><tr><td>a<td><tr><td>b<td>c</table>", "a |\nb | c"),
    ("<table><tr><td>x<td>y</table>", "x | y"), ("<table><td>x<td>y</table>", "x | y"),
    ("<p title=it's>a don't</p>b", "a don't\n\nb"), ('<p title=">">a', "a"), ("<!-->a<!--->b<!-- > -->c", "abc"), ("a</>b</ x>c", "abc"),
    ("<head><title>t</title>shown", "shown"), ("<head>" * 5000 + "a", "a"), ("<noscript><table></noscript>a", "a"),
    ("<ul><li>a</ul></li>b", "- a\n\nb"), ("<li><ul></li><li>x</ul>", "- - x"), ("<div><p>a</p></div><div>b</div>", "a\n\nb"),
    ("<span style='display:block'>a</span>b", "a\nb"), ("a\r\nb<pre>\r\n c\r\n  d</pre>", "a b\n\n c\n  d"),
    ("<svg><text><![CDATA[a<b]]></text></svg>", "a<b"), ("<a", "<a"), ("1 <2 </b", "1 <2 </b"), ("<plaintext>a</b>", "a</b>"),
    ("<blockquote><p>a<p>b</blockquote>c", "  a\n\n  b\n\nc"),
    ("<div>x<div style='display:contents'>y</div></div>", "xy"), ("a <progress>50%</progress><meter>3</meter> b", "a b"),
    ("<input type=submit value='Go &amp; see'><input value=no><div hidden><input type=button value=no></div>", "Go & see"),
    ("<table><tr><td rowspan=3>a<td colspan=2>b<td>c<tr><td>d<td rowspan=2>e<tr><td>f<td>g</table>", "a | b     | c\n  | d | e\n  | f |   | g"),
])
def test_broken_and_rare_markup(page, want):
    assert html_text.page_text(page) == want


def big():
    n = 20_000
    yield "nested", "<div>" * 200_000 + "deep", "deep"
    yield "nested spans in blocks", "<b><div>" * n + "x" + "</b>" * n, "x"
    yield "lists", "<ul><li>" * n + "x", None
    yield "tables", "<table><tr><td>a<td>" * 3000 + "x", None
    yield "one long cell", "<table>" + "<tr><td>a<td>b" * 3000 + "<tr><td>" + "z" * 200_000 + "<td>c</table>", None
    yield "wide spans", "<table><tr>" + "<td>a" * 5000 + "<tr><td colspan=1000>b<td>c" * 5000 + "</table>", None
    yield "tall cell", "<table><tr>" + "<td>a" * 3000 + "<td>" + "l<br>" * 5000 + "</table>", None
    yield "deep spans", "<table><tr>" + "".join(f"<td rowspan={60000 - i}>a" for i in range(4000)) + "<tr><td>b" * 4000, None
    yield "no end of tags", "<a x='" * n, None
    yield "quotes", "<a '\">" * n + "x", "x"
    yield "comments", "<!--" * n, ""
    yield "raw", "<script>" * n, ""
    yield "lines in deep blocks", "<section>" * n + "a<br>" * n, None


@pytest.mark.parametrize("name, page, want", [pytest.param(*x, id=x[0]) for x in big()])
def test_hostile_pages_take_linear_time_and_space(name, page, want):
    began = time.process_time()
    got = html_text.page_text(page)
    assert time.process_time() - began < 5
    assert len(got) <= 40 * len(page)
    assert want is None or got == want
    for letter in "abcxz":
        assert got.count(letter) >= 1 or f"{letter}<" not in page


@pytest.mark.parametrize("spanned, below", [(120, 280), (300, 200), (20, 40), (50, 30), (20, 200), (1000, 50)])
def test_cells_below_row_spans_stand_in_their_column(spanned, below):
    page = "<table><tr>" + "<td rowspan=9999>a" * spanned + "<tr><td>b" * below + "</table>"
    lines = html_text.page_text(page).split("\n")
    assert len(lines) == below + 1 and all(x.count("|") == spanned and x.endswith("| b") for x in lines[1:])


def test_a_long_gap_is_a_number():
    page = "<table><tr>" + "<td rowspan=9>a" * 1001 + "<tr><td>b<tr><td>c</table>"
    assert html_text.page_text(page).split("\n")[1:] == [" |x1001| b", " |x1001| c"]


def test_columns_that_are_held():
    """Spans that begin, end and overlap, against one mark for each column."""
    r = random.Random(1)
    for _ in range(500):
        n, until, held = r.randint(1, 9), {}, html_text._Held()
        for row in range(n):
            held.release(row)
            at, new = 0, []
            for _ in range(r.randint(0, 4)):
                want = next(c for c in range(at, 999) if until.get(c, 0) <= row)
                assert held.free(at) == want
                wide, deep = r.choice([1, 1, 2, 4]), r.choice([1, 2, 3, 9])
                new += [(want, want + wide, row + deep)] if deep > 1 else []
                at = want + wide
            for a, b, u in new:
                held.hold(a, b, u)
                until.update({c: max(until.get(c, 0), u) for c in range(a, b)})


WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


def tree(r, depth, inside):
    """A random node: a text, or (tag, attributes, children)."""
    if depth == 0 or r.random() < 0.3:
        return r.choice(WORDS) + r.choice(["", " ", "\n "])
    tag = r.choice(["div", "p", "span", "b", "ul", "ol", "table", "blockquote", "h2"] if inside == "block" else ["span", "b", "i"])
    attributes = " hidden" if r.random() < 0.07 else " style='visibility: hidden'" if r.random() < 0.04 else ""
    if tag in ("ul", "ol"):
        return tag, attributes, [("li", "", [tree(r, depth - 2, "block") for _ in range(r.randint(1, 3))]) for _ in range(r.randint(1, 4))] if depth > 1 else []
    if tag == "table":
        n = r.randint(1, 3)
        span = lambda: r.choice(["", "", "", " colspan=2", " rowspan=2", " rowspan=3 colspan=2", " rowspan=0"])
        return tag, attributes, [("tr", "", [("td", span(), [tree(r, max(0, depth - 3), "block") for _ in range(r.randint(0, 2))]) for _ in range(n)]) for _ in range(r.randint(1, 4))]
    inner = "block" if tag in ("div", "blockquote") else "inline"
    return tag, attributes, [tree(r, depth - 1, inner) for _ in range(r.randint(0, 4))]


def markup(node, r):
    if isinstance(node, str):
        return node
    tag, attributes, children = node
    end = "" if tag in ("li", "td", "tr") and r.random() < 0.5 else f"</{tag}>"
    return f"<{tag}{attributes}>{''.join(markup(x, r) for x in children)}{end}"


def laid_out(node):
    """Plain layout: each element gives (kind, content) pieces; blocks are laid out on their own and set below each other."""

    def pieces(node, seen, in_list):
        if isinstance(node, str):
            return [("text", node)] if seen else []
        tag, attributes, children = node
        if "hidden" in attributes and "visibility" not in attributes:
            return []
        seen = seen and "visibility" not in attributes
        inner = in_list or tag == "li"
        if tag in ("span", "b", "i"):
            return [p for c in children for p in pieces(c, seen, in_list)]
        if tag == "table":
            spans = lambda td: [int((re.search(rf"{x}=(\d)", td[1]) or [0, 1])[1]) for x in ("colspan", "rowspan")]
            rows = [[(lines_of([p for c in td[2] for p in pieces(c, seen, False)]), *spans(td)) for td in tr[2]] for tr in children]
            return [("edge", True), ("lines", grid(rows)), ("edge", True)]
        spaced = tag in ("p", "ul", "ol", "blockquote", "h2") and not (tag in ("ul", "ol") and in_list)
        if tag in ("ul", "ol"):
            out = []
            for i, li in enumerate(children, 1):
                lines = lines_of([p for c in li[2] for p in pieces(c, seen, True)])
                mark = f"{i}. " if tag == "ol" else "- "
                out += [("edge", False), ("lines", [mark + lines[0], *(" " * len(mark) + x if x else x for x in lines[1:])] if lines else []), ("edge", False)]
            return [("edge", spaced), *out, ("edge", spaced)]
        own = [p for c in children for p in pieces(c, seen, inner)]
        if tag == "blockquote":
            own = [("lines", ["  " + x if x else x for x in lines_of(own)])]
        return [("edge", spaced), *own, ("edge", spaced)]

    def lines_of(parts):
        out, run, gap = [], "", False
        for kind, x in [*parts, ("edge", False)]:
            if kind == "text":
                run += x
                continue
            new = [" ".join(run.split())] if run.strip() else []
            run = ""
            new = new if kind == "edge" else new + x
            if new:
                out += [""] * (gap and bool(out)) + new
                gap = False
            gap |= kind == "edge" and x
        return out

    def grid(rows):
        held, cells = {}, []  # (row, column) that a cell has; (row, from, to, lines)
        for r, row in enumerate(rows):
            at = 0
            for lines, wide, deep in row:
                while (r, at) in held:
                    at += 1
                cells.append((r, at, at + wide, lines))
                for y in range(r + 1, r + deep if deep else len(rows)):
                    held.update({(y, x): True for x in range(at, at + wide)})
                at += wide
        starts = sorted({a for _, a, _, _ in cells})  # columns in which no cell starts are none
        cells = [(r, sum(x < a for x in starts), sum(x < b for x in starts), lines) for r, a, b, lines in cells]
        longest = lambda lines: max(map(len, lines), default=0)
        widths = [max((longest(lines) for _, a, b, lines in cells if (a, b) == (c, c + 1)), default=0) for c in range(len(starts))]
        wide = lambda a, b: sum(widths[a:b]) + 3 * (b - a - 1)
        more = {}
        for _, a, b, lines in cells:
            if b - a > 1 and lines:
                more[b - 1] = max(more.get(b - 1, 0), longest(lines) - wide(a, b))
        widths = [w + max(0, more.get(c, 0)) for c, w in enumerate(widths)]
        out = []
        for r in range(len(rows)):
            mine = [x[1:] for x in cells if x[0] == r]
            for k in range(max((len(lines) for _, _, lines in mine), default=0)):
                shown = [x for x in mine if k == 0 or k < len(x[2])]
                text, at = "", 0
                for i, (a, b, lines) in enumerate(shown):
                    text += "".join(" " * w + " | " for w in widths[at:a])
                    own = lines[k] if k < len(lines) else ""
                    text += own.ljust(wide(a, b)) + " | " if i < len(shown) - 1 else own
                    at = b
                if any(k < len(lines) and lines[k] for _, _, lines in mine):
                    out.append(text.rstrip(" "))
        return out

    return "\n".join(lines_of(pieces(node, True, False)))


@pytest.mark.parametrize("seed", range(600))
def test_random_pages_against_plain_layout(seed):
    r = random.Random(seed)
    node = ("div", "", [tree(r, 6, "block") for _ in range(r.randint(1, 5))])
    page = markup(node, r)
    assert html_text.page_text(page) == laid_out(node), page
