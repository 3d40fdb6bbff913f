"""The document tree: structure by cases, links, and a source that reads back the same."""

import random

import pytest

from linkloom.sources.pages import page_links, text_urls
from linkloom.sources.tree import parse, read_back

HEAD, TAIL = "<html><head></head><body>", "</body></html>"

BODIES = {
    # Implied ends.
    "<p>one<p>two": "<p>one</p><p>two</p>",
    "<ul><li>a<li>b</ul>c": "<ul><li>a</li><li>b</li></ul>c",
    "<dl><dt>a<dd>b<dt>c</dl>": "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>",
    "<select><option>a<option>b</select>c": "<select><option>a</option><option>b</option></select>c",
    "<h1>a<h2>b</h1>c": "<h1>a</h1><h2>b</h2>c",
    "x</p>y</br>z": "x<p></p>y<br>z",
    # Tags that lead nowhere join the text around them.
    "<div>a</foo>b</div>": "<div>ab</div>",
    "<tr>a<td>b": "ab",
    "<form><form>a</form>b": "<form>a</form>b",
    # Misnested formatting.
    "<b>x<p>y</b>z</p>": "<b>x</b><p><b>y</b>z</p>",
    "<b><i><div>x</b>y</i>z</div>": "<b><i></i></b><i></i><div><i><b>x</b>y</i>z</div>",
    "<p><b>x</p>y</b>z": "<p><b>x</b></p><b>y</b>z",
    "<a href=1>x<a href=2>y</a>z": '<a href="1">x</a><a href="2">y</a>z',
    # Tables.
    "<table><tr><td>a<td>b</table>c": "<table><tbody><tr><td>a</td><td>b</td></tr></tbody></table>c",
    "<table>f<tr><td>1</table>": "f<table><tbody><tr><td>1</td></tr></tbody></table>",
    "<table><a href=1>x</table>y": '<a href="1">x</a><table></table><a href="1">y</a>',
    "<table><td><table><td>x</table>y</table>z": "<table><tbody><tr><td><table><tbody><tr><td>x</td></tr></tbody>"
    "</table>y</td></tr></tbody></table>z",
    # Text that is no markup, and what is escaped.
    "<textarea><b></textarea>x": "<textarea>&lt;b&gt;</textarea>x",
    "<div><script>a<b && c</script>": "<div><script>a<b && c</script></div>",
    "<p>\"q\" 'r' &amp; &eacute; a < b": "<p>&#34;q&#34; &#39;r&#39; &amp; é a &lt; b</p>",
    "<a href='x?a=1&amp;b=2&copy=3'>t</a>": '<a href="x?a=1&amp;b=2&amp;copy=3">t</a>',
    "a\r\nb\rc&#13;d": "a\nb\nc&#13;d",
    "<pre>\nx</pre>": "<pre>x</pre>",
    "<svg><path d=1 /><g/></svg>z": '<svg><path d="1"></path><g></g></svg>z',
    "<IMG SRC=a><br/>": '<img src="a"><br>',
    "x<!-- c --><!bogus>": "x<!-- c --><!--bogus-->",
    "a<b": "a",
}


@pytest.mark.parametrize("html", BODIES)
def test_bodies(html):
    assert read_back(parse(html))[1] == HEAD + BODIES[html] + TAIL


def test_whole_documents():
    html = "<!DOCTYPE html><!-- c --><html lang=en><head><title>a&amp;b</title></head><body id=1>x</body></html>tail"
    want = '<!DOCTYPE html><!-- c --><html lang="en"><head><title>a&amp;b</title></head><body id="1">xtail</body></html>'
    assert read_back(parse(html))[1] == want
    assert read_back(parse(""))[1] == HEAD + TAIL
    assert read_back(parse("<style>x"))[1] == "<html><head><style>x</style></head><body></body></html>"
    assert read_back(parse("<head></head><link href=a>y"))[1] == '<html><head><link href="a"></head><body>y</body></html>'


def test_anchors_in_tree_order():
    html = "<table><tr><td><a href=1>in</a></td></tr><a href=2>out</a></table><a name=x>no</a><a href>e</a>"
    assert read_back(parse(html))[0] == [("2", "out"), ("1", "in"), ("", "e")]
    assert read_back(parse("<a href=X><p>text</a>more"))[0] == [("X", ""), ("X", "text")]


def test_any_markup_reads_back_the_same():
    """Whatever comes in: no error, and a well-formed body, read again, stays as it is."""
    rng = random.Random(2)
    tags = (
        "a b i p div table tr td th tbody caption select option ul li form object button h1 h2 template svg math col "
        "colgroup head body html br hr nobr dd dl input optgroup frameset noscript x"
    ).split()
    pieces = [f"<{t} href=u{i}>" for i, t in enumerate(tags)] + [f"</{t}>" for t in tags] + ["text", " ", "<!--c-->"]
    for _ in range(3000):
        read_back(parse("".join(rng.choice(pieces) for _ in range(rng.randint(1, 40)))))
    simple = ["<div>", "</div>", "<ul><li>", "</li></ul>", "<b>", "</b>", "text", "<p>", "</p>", "<td>", "<table>", "</table>"]
    for _ in range(2000):
        once = read_back(parse("".join(rng.choice(simple) for _ in range(rng.randint(1, 15)))))[1]
        body = once.removeprefix(HEAD).removesuffix(TAIL)
        # A paragraph around a table is the one thing that reading again may change.
        if "<p>" not in body and "<b>" not in body:
            assert read_back(parse(body))[1] == once


def test_deep_and_long_markup_takes_linear_time():
    import time

    began = time.time()
    for html in ("<div>" * 50_000, "<b>" * 20_000 + "<p>x" * 2_000, "<a href=x>" * 20_000, "<table>x" * 5_000, "<i>x</p>" * 20_000):
        read_back(parse(html))
    assert time.time() - began < 60


def _links(spark, html, function=page_links):
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    return [(r.title, r.url) for r in function(df).orderBy("src", "pos").collect()]


def test_addresses_of_anchors_are_not_found_again(spark):
    for href in ("http://e.com/x", '"http://e.com/?a=1&amp;b=2"', '"http://e.com/caf&eacute;"', "'http://e.com/&#38;'", '"http://e.com/it\'s"'):
        assert len(_links(spark, f"<a href={href}>text</a>")) == 1


def test_addresses_end_where_text_or_values_do(spark):
    html = '<p>"http://q.com/1"! http://r.com/</nope>x <img src=http://i.com/y>http://s.com/(z)<td title=\'http://t.com/ u\'>'
    urls = [u for _, u in _links(spark, html, text_urls)]
    assert urls == ['http://q.com/1"!', "http://r.com/x", "http://i.com/y", "http://s.com/"]


def test_links_of_pages_without_markup(spark):
    assert _links(spark, "") == []
    assert _links(spark, None) == []
    assert _links(spark, "see http://a.com/1, HTTPS://b.com/2") == [
        ("http://a.com/1,", "http://a.com/1,"), ("HTTPS://b.com/2", "HTTPS://b.com/2")
    ]
