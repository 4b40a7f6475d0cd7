"""The scanner of op1 on elements that are self-closed, left open or nested."""

import pytest

from emberlog.llm import page_templates


@pytest.mark.parametrize("inner,want", [
    ("<p>a</p><svg/><p>b</p>", "a\n\nb"),
    ("<p>a</p><svg width='3' /><p>b</p>", "a\n\nb"),
    ("<p>a</p><object data='x'/><p>b</p>", "a\n\nb"),
    ("<p>a</p><!--><p>b</p><!-- c --><!---><p>d</p>", "a\n\nb\n\nd"),
    ("<p>a <button>press</p><p>b</p>", "a\n\nb"),
    ("<div><p>a</p><button>press</div><p>b</p>", "a\n\nb"),
    ("<p>one <svg><title>t</title><text>x</text></svg> block</p>", "one block"),
    ("<p>E = <math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math></p>", "E = mc2"),
    ("<video><source src='x'><p>no player</p></video><p>b</p>", "b"),
    ("<select><option>x<option>y</select><p>b</p>", "b"),
    ("<noscript><div>turn it on</div></noscript><p>b</p>", "b"),
    ("<object><p>x<object><p>y</object></object><p>b</p>", "b"),
    ("</svg><p>a</p></button><p>b</p>", "a\n\nb"),
    ("<p>a</p><script>if (a < b) { '</p>' }</script><p>b</p>", "a\n\nb"),
    ("<p>a</p><textarea><p>typed</p></textarea><p>b</p>", "a\n\nb"),
    ("<p>a &lt; b &amp; c</p>", "a < b & c"),
])
def test_elements(inner, want):
    assert page_templates.main_text(page_templates.walk(f"<html><body><article>{inner}</article></body></html>"), ()) == want


def test_long_page_with_open_elements():
    page = "<article>" + "<p>x<svg></p>" * 20000 + "<p>end</p></article>"
    blocks = [b[3] for b in page_templates.walk(page) if b[3]]
    assert len(blocks) == 20001 and blocks[-1] == "end"
