"""Elements whose content is text, broken markup of any length, tables of many spans."""

import time

import pytest

from verdigris.llm.html_text import render


@pytest.mark.parametrize(("html", "text"), [
    ("<textarea>a <script>x</script> b</textarea>c", "a <script>x</script> bc"), ("<textarea>foo <b>x</b> &amp;</textarea>", "foo <b>x</b> &"), ("<xmp><b>raw</b> &amp;</xmp>", "<b>raw</b> &amp;"), ("<plaintext>a<b>c</plaintext>", "a<b>c</plaintext>"),
    ("<listing>a\n  <b>b</b></listing>", "a\n  b"), ("<ruby>K<rp>(</rp><rt>k</rt><rp>)</rp></ruby>", "Kk"), ("<noframes>x</noframes>y<noembed>z</noembed>", "y"), ("a < b <3 &lt;c", "a < b <3 <c"), ("<p title='a>b' x=y/z checked>t</p>", "t"),
    ("l<a href=x", "l"), ("x<!-- a -- b --!>y<!-->z<!--->w", "xyzw"), ("x<!-- never closed <p>y", "x"), ("</>a</ x>b<?php ?>c<!x>d", "abcd"), ("<svg><title>no</title><text><![CDATA[a<b&amp;]]></text></svg>", "a<b&amp;"), ("a<![CDATA[b]]>c", "ac"),
    ("<script>if(a<b)</script>v", "v"), ("<style>x</style x>y", "y"), ("<style>x</styles></style>y", "y"), ("<script>never closed", ""), ("<title>a<b></title>b<BR/>c", "b\nc"), ("<input type=submit value='a' value='b'>", "a"), ("<", "<"), ("a</", "a</"), ("&#65;&amp", "A&"),
])
def test_raw_text_and_broken_markup(html, text):
    assert render(html) == text


@pytest.mark.parametrize("piece", ["<a ", "<!--", "<", "&", "</", "<!", "<?", "<a b='", "<a =", "<div x=", "<textarea>", "<script>", "<![CDATA[", "<svg><![CDATA[", "&#", "<p a=b c>", "=", "<p>", "<td>", "</p>", "<b><i>"])
def test_a_megabyte_of_broken_markup(piece):
    began = time.perf_counter()
    render(piece * ((1 << 20) // len(piece)))
    assert time.perf_counter() - began < 20  # seconds, on a busy machine; a quadratic reader takes hours


def test_tables_of_many_spans_and_wide_cells():
    began = time.perf_counter()
    text = render("<table>" + "<tr><td rowspan=1000 colspan=100>a</td></tr>" * 5000 + "</table>")
    assert text.split("\n") == ["a"] * 5000
    wide = render("<table><tr><td>" + "a" * 100_000 + "</td><td>b</td></tr>" + "<tr><td>aa</td><td>b</td></tr>" * 10_000 + "</table>")
    assert wide.endswith("\naa | b")
    assert len(wide) < 300_000
    assert time.perf_counter() - began < 20
