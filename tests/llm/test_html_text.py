"""Visible text in markup that is rare: rows in inline elements, formulas, drawings."""

import pytest

from gridsmith.llm import html_text


@pytest.mark.parametrize("page, want", [
    ("<table><font><tr><td>x</td><td>y</td></tr></font></table>", "x | y"),
    ("<table><tr><a><td>x</td></a><td>y</td></tr></table>", "x | y"),
    ("<table><span><tbody><tr><td>x</td></tr></tbody></span></table>", "x"),
    ("a<span><td>x</td></span>b", "a\nx\nb"),
    ("<p>a</p><x-grid><tr><td>x<td>y</tr><tr><td>z</td></tr></x-grid><p>b</p>", "a\n\nx | y\nz\n\nb"),
    ("a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b", "a x=1 b"),
    ("<math><semantics><mi>x</mi><annotation>\\x</annotation></semantics></math>", "x"),
    ("a<svg><title>t</title><defs><text>d</text></defs>no<g><text>one</text><text>two <tspan>three</tspan></text></g></svg>b", "a one two three b"),
    ("<svg><defs/><path d='M0'/><text x='1'>x<tspan x='1' dy='2'>y</tspan></text></svg>z", "x y z"),
    ("<svg><foreignObject><p>in</p></foreignObject></svg><p>out", "in\n\nout"),
    ("<svg><g>no<p>out", "out"),
    ("<svg><text display='none'>no</text><desc>no</desc><style>no</style></svg>out", "out"),
    ("<div hidden><svg><text>no</text></svg><math><mi>no</mi></math></div>out", "out"),
])
def test_page_text(page, want):
    assert html_text.page_text(page) == want
