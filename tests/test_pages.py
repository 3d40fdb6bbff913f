import pytest

from linkloom.sources import anchor_links, page_links, scan_pages, split_emissions, text_urls
from linkloom.sources.markup import anchors

PAGE = """
<html><body>
  <a href="http://one.example">First</a>
  <div><a href="http://two.example"> Second </a></div>
  <p>See http://three.example<p>
  <p>and again http://two.example<p>
  <pre>https://three.example/f.zip</pre><div hidden>HTTPS://three.example/f.zip</div>
</body></html>
"""


def pages(spark, *bodies):
    return spark.createDataFrame(
        [(i, f"http://p/{i}", b) for i, b in enumerate(bodies)],
        "page_id int, url string, html string",
    )


@pytest.mark.parametrize(
    "html, found",
    [
        ("", []),
        ("<html><body></body></html>", []),
        ('<a href="u?a=1&copy=2&amp;b">x &eacute;</a>', [("u?a=1&copy=2&b", "x é")]),
        ("<A HREF='q'>A<b>B</b></A> z", [("q", "AB")]),
        ("<a href=1>x<a href=2>y", [("1", "x"), ("2", "y")]),
        ("<a name=x>n</a><a href>e</a>", [("", "e")]),
        ('<!-- <a href=no>n</a> --><script>"<a href=n>"</script><a href=y>y</a>', [("y", "y")]),
        ("<noscript><a href=n>n</a></noscript><a href=y>y", [("y", "y")]),
        ("<p><a href=1>t<p>more</a>", [("1", "t")]),
        ("<div><a href=1>t</div>more", [("1", "t")]),
        ("<b><a href=1>t</b>more</a>", [("1", "t")]),
        ("<ul><li><a href=1>a<li><a href=2>b</ul>", [("1", "a"), ("2", "b")]),
        ("<p title=it's><a href=1>q</a>", [("1", "q")]),
        ('<a title="a > b" href=x>1 < 2</a>', [("x", "1 < 2")]),
        ('<a href="x" href="y">d</a>', [("x", "d")]),
        ("<a href=x>t<a href=", [("x", "t")]),
    ],
)
def test_anchors(html, found):
    assert anchors(html) == found


@pytest.mark.parametrize(
    "hostile", ["<a " * 100_000, '<a href="' * 50_001, "<a x='>' " * 50_000, "<b>" * 50_000 + "</i>" * 50_000 + "<a",
                "<!--" * 50_000 + "<a"],
)
def test_hostile_markup(spark, hostile):
    assert anchors(hostile) == []
    assert anchor_links(pages(spark, hostile), method="native").isEmpty()


@pytest.mark.parametrize("method", ["parser", "native"])
def test_anchor_links(spark, method):
    body = '<a class="x" href="/a">one</a><a href="/b"> <i></i>\n</a><a>no</a><a href="/a">two</a>' \
           '<a href="/c?x=1&amp;y">R&amp;D</a>'
    got = anchor_links(pages(spark, body, "", None), method=method).orderBy("pos").collect()
    assert [(r.page_id, r.pos, r.title, r.url) for r in got] == [
        (0, 0, "one", "/a"), (0, 1, "/b", "/b"), (0, 2, "two", "/a"), (0, 3, "R&D", "/c?x=1&y"),
    ]


@pytest.mark.parametrize("method", ["parser", "native"])
def test_page_links(spark, method):
    got = page_links(pages(spark, PAGE, "<html></html>"), method=method)
    assert [(r.src, r.title, r.url) for r in got.orderBy("src", "pos").collect()] == [
        (0, "First", "http://one.example"),
        (0, " Second ", "http://two.example"),
        (1, "http://three.example", "http://three.example"),
        (1, "https://three.example/f.zip", "https://three.example/f.zip"),
        (1, "HTTPS://three.example/f.zip", "HTTPS://three.example/f.zip"),
    ]


@pytest.mark.parametrize("method", ["parser", "native"])
def test_text_url_equal_to_an_unescaped_href_is_no_second_link(spark, method):
    body = '<a href="http://h/?a=1&amp;b=2">x</a> http://h/?a=1&amp;b=2 (http://h/p)http://h/q>'
    got = page_links(pages(spark, body), method=method).orderBy("src", "pos").collect()
    assert [(r.title, r.url) for r in got] == [
        ("x", "http://h/?a=1&b=2"), ("http://h/p", "http://h/p"), ("http://h/q>", "http://h/q>"),
    ]


def test_text_urls(spark):
    body = "<!-- http://a/x'y --> \"https://b\thttp://c\r\nhttp:// http://é/ü"
    got = text_urls(pages(spark, body)).orderBy("pos").collect()
    assert [r.url for r in got] == ["http://a/x", "https://b", "http://c", "http://é/ü"]


def test_unknown_method(spark):
    for function in (anchor_links, page_links):
        with pytest.raises(ValueError):
            function(pages(spark, ""), method="other")


def test_scan_pages_and_split(spark):
    def scanner(url, body):
        yield "item", body, url
        yield "link", "t", url + "#l"
        yield "follow", None, url + "/next"

    items, links, follows = split_emissions(scan_pages(pages(spark, "b0", "b1"), scanner))
    assert sorted((r.page_id, r.title, r.url) for r in items.collect()) == [
        (0, "b0", "http://p/0"), (1, "b1", "http://p/1"),
    ]
    assert sorted(r.url for r in links.collect()) == ["http://p/0#l", "http://p/1#l"]
    assert sorted(r.url for r in follows.collect()) == ["http://p/0/next", "http://p/1/next"]
    assert "title" not in follows.columns


def test_scanner_with_unknown_kind_fails(spark):
    with pytest.raises(Exception, match="unknown emission kind"):
        scan_pages(pages(spark, "b"), lambda url, body: [("other", "", "")]).collect()
