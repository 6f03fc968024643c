"""Layout of visible text, and every visible word of the given pages."""

import re
from html import unescape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventflow.llm.html_text import extract, visible_text

CASES = {
    "": "",
    "plain  text\n only": "plain text only",
    '<p>one <a href="u"">two</a> three <a href="w">four</a></p>': "one two three four",
    '<a href=x">visible</a> more <b title="y">z</b>': "visible more z",
    "<a title='it is \">\" here' href = \"a>b\" '>x</a> <b \" class=c>y</b> <i a=b'c>z</i>": "x y z",
    '<a href="open>x</a>': "x",
    "<p =x = hidden>a value<p a= hidden>another<p a = b hidden>gone": "a value\n\nanother",
    "<p>One<p>Two": "One\n\nTwo",
    "<p>a <b>b</b>c<i> d </i> e</p>": "a bc d e",
    "<div>a</div><div>b</div>": "a\nb",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>": "- a\n- b\n  3. c\n  4. d",
    "<ol><li value=7>a<li>b</ol>": "7. a\n8. b",
    "<table><tr><th>Name<th>Age<tr><td>Al<td>30</table>": "Name  Age\nAl    30",
    "<table><tr><td rowspan=2>A<td>b<tr><td>c</table>": "A  b\n   c",
    "<table><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>y</table>": "wide  z\na  b  y",
    "<table><caption>T</caption><tr><td>x<br>y<td>z</table>": "T\nx  z\ny",
    "<pre>\n a\n  b</pre>c": " a\n  b\n\nc",
    "<h1>H</h1>text<hr>more": "H\n\ntext\n\n---\n\nmore",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "<head><title>no</title><style>p{}</style></head><body>yes": "yes",
    "<title>no</title>yes": "yes",
    "<script>if (a<b) w('</p>')</script>x<template>no</template>": "x",
    "<p hidden>no</p><p style='color:red; display : none'>no</p><p style=visibility:hidden>no</p>yes": "yes",
    "<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>": "s\nt\nyes",
    "<!-- no --><![CDATA[c]]><!doctype html>d": "cd",
    "a &lt;b&gt; &amp;amp; &copy; &#228; &unknown; &": "a <b> &amp; © ä &unknown; &",
    "x < y and 3<4": "x < y and 3<4",
    "<p>open <a href='x": "open",
    "</p>a</div></b>b": "ab",
    "<select><option>a<option>b</select>": "a\nb",
    "<b>bold<p>still</b> on": "bold\n\nstill on",
    "<p>a<table><tr><td>b</table>c": "a\n\nb\n\nc",
    '<a title="1 > 0">link</a>': "link",
    "<div>" * 3000 + "deep" + "</div>" * 3000: "deep",
    "<textarea>a  <b>\n c</textarea>": "a  <b>\n c",
}


DEEP = "<div>" * 149
SHOWN = {
    "a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> b": "a x=2 b",
    "<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><g><text>One</text><text x=1>Two</text></g></svg>z": "One\nTwo\nz",
    "<svg><defs/><path d='M0'/><title/><text>label</text></svg>": "label",
    "<svg/>a<desc>b</desc>": "ab",
    "<head><title>T</title>Hello": "Hello",
    "<head><title>T</title> <meta name=a> Hello<p>more": "Hello\n\nmore",
    DEEP + "<div hidden>no<b>no</b>no<div><p>no</div>no</div>yes": "yes",
    DEEP + "<div hidden>" + "<i>no" * 400 + "</i>" * 400: "",
}


@pytest.mark.parametrize("html", SHOWN)
def test_all_that_is_visible_and_no_more(html):
    assert visible_text(html) == SHOWN[html]


@pytest.mark.parametrize("html", CASES)
def test_layout(html):
    assert visible_text(html) == CASES[html]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("<p> <li> </ul> <table> <td> </td> <tr> </table> <b> </b> <ul> <!-- --> <br> <pre> </pre> a b & < > \" ' <script> </script> <h1> </div> <dd> </body>".split()), max_size=30).map(" ".join))
def test_any_soup_has_a_text(html):
    visible_text(html)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text(html):
    visible_text(html)


def test_table_of_awkward_pages(spark):
    rows = [(1, None, "t"), (2, "", "t"), (None, "<p>x", "t"), (None, "<p>x", "t"), (5, "<p>" + "long " * 50_000, "t")]
    got = extract(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    want = [(1, ""), (2, ""), (None, "x"), (None, "x"), (5, ("long " * 50_000).strip())]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_every_visible_word_of_the_pages(spark, data):
    """A page of the tables hides only its head, scripts and comments, so its words are known."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in extract(spark.read.parquet(f"{data}/pages.parquet")).collect()}
    assert got.keys() == pages.keys()
    for page, html in pages.items():
        body = re.sub(r"(?s)<!--.*?-->|<head>.*?</head>|<[^>]*>?", " ", html)
        words = unescape(body).split()
        assert "".join(re.sub(r"(?m)^\s*- ", "", got[page]).split()) == "".join(words)
