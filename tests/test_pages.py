import pytest
from pyspark.sql import functions as F

from corpusloom.functions.html import html_to_markdown, main_html, page_title
from corpusloom.functions.urls import normalize_url, resolve_url
from corpusloom.operators.chunking import chunk_markdown
from corpusloom.operators.crawl import (
    canonicalize,
    extract_links,
    filter_links,
    robots_filter,
    robots_rules,
    sitemap_locs,
)
from corpusloom.operators.dedup import dedup_chunks
from corpusloom.sources.registry import docs_of_kind, pages_to_docs, register_source_kind, source_kinds

PROSE = "A paragraph with enough words to be kept as a passage of its own by the chunker."


@pytest.mark.parametrize("tail", ["/docs/#intro", "/docs/index.html", "/docs/index.htm", "/docs/", "/a/../docs", "/./docs"])
def test_normalize(one, tail):
    assert one(normalize_url(F.col("u")), u="HTTPS://Docs.Example:443" + tail) == "https://docs.example/docs"


@pytest.mark.parametrize(
    "href, expected",
    [
        ("/x", "https://a.b/x"), ("y", "https://a.b/d/y"), ("../z/", "https://a.b/z"), ("//c.d/e", "https://c.d/e"),
        ("?q=1", "https://a.b/d/p?q=1"), ("http://E.F", "http://e.f/"), ("ftp://x/y", None), ("mailto:x@y", None),
        ("/für x", "https://a.b/f%C3%BCr%20x"), ("/index.html#a", "https://a.b/"),
    ],
)
def test_resolve(one, href, expected):
    assert one(resolve_url(F.col("h"), F.col("b")), h=href, b="https://a.b/d/p") == expected


def test_title(one):
    assert one(page_title(F.col("h")), h="<title> A &amp; B </title><h1>C</h1>") == "A & B"
    assert one(page_title(F.col("h")), h="<title> </title><h1>C <b>d</b></h1>") == "C d"


@pytest.mark.parametrize(
    "extra", ['<aside>gone</aside>', '<div class="page-toc"><div>gone</div>gone</div>', '<p aria-hidden="true">gone</p>',
              '<div class="cookie-bar">gone</div>', "<nav>gone</nav>", "<script>gone</script>", '<ul role="navigation"><li>gone</ul>'],
)
def test_boilerplate(one, extra):
    page = f"<html><body><h2>menu</h2><main>{extra}<h1>Title</h1><p>kept <b>bold</b></p></main><p>outside</p></body></html>"
    markdown = one(html_to_markdown(F.col("h")), h=page)
    assert markdown == "# Title\n\nkept **bold**"
    html = one(main_html(F.col("h")), h=page)
    assert "gone" not in html and "outside" not in html and "kept <b>bold</b>" in html


def test_markdown_shapes(one):
    page = (
        "<body><h2>Head</h2><ul><li><a href='/a'>A</a></li><li>B</li></ul><ol><li>one</li><li>two</li></ol>"
        "<pre><code>x = 1\n  y</code></pre><blockquote>said</blockquote><p>a<br>b</p></body>"
    )
    assert one(html_to_markdown(F.col("h")), h=page) == (
        "## Head\n\n*   [A](/a)\n*   B\n\n1.  one\n\n2.  two\n\n```\nx = 1\n  y\n```\n\n> said\n\na  \nb"
    )


def test_page_chunks_drop_repeats(spark):
    body = f"<main><h1>Same</h1><p>{PROSE}</p></main>"
    menu = "".join(f'<li><a href="/{i}">entry number {i}</a></li>' for i in range(9))
    pages = [("s", "https://a/1", body), ("s", "https://a/2", body), ("t", "https://b/1", body),
             ("s", "https://a/3", body.replace("Same", "Other")), ("s", "https://a/4", f"<main><ul>{menu}</ul></main>")]
    docs = pages_to_docs(spark.createDataFrame(pages, "source_id STRING, url STRING, html STRING"))
    rows = dedup_chunks(chunk_markdown(docs), "source_id", ("url", "chunk_index")).collect()
    assert sorted((r.source_id, r.url) for r in rows) == [("s", "https://a/1"), ("s", "https://a/3"), ("t", "https://b/1")]
    again = spark.createDataFrame(rows)
    assert dedup_chunks(again, "source_id", ("url", "chunk_index")).count() == 3


def test_canonical_and_links(spark):
    html = (
        '<head><link rel="canonical" href="/real/"></head><a href="/a">1</a> <a class=x href="/a#b">2</a><a href="#top">3</a>'
        "<a href='mailto:x'>4</a><a href=\"https://other.example/x?a=1&amp;b=2\">5</a><a href='/file.PDF'>6</a>"
    )
    pages = spark.createDataFrame([("https://site.example/p/", html), ("https://site.example/q", "<p>")], "url STRING, html STRING")
    seen = {r.page_url: (r.canonical_url, r.effective_url) for r in canonicalize(pages).collect()}
    assert seen["https://site.example/p"] == ("https://site.example/real", "https://site.example/real")
    assert seen["https://site.example/q"] == (None, "https://site.example/q")
    edges = extract_links(pages)
    assert sorted(r.link for r in edges.collect()) == [
        "https://other.example/x?a=1&b=2", "https://site.example/a", "https://site.example/file.PDF"]
    assert [r.link for r in filter_links(edges).collect()] == ["https://site.example/a"]
    hosts = filter_links(edges, allowed_hosts=("other.example",))
    assert [r.link for r in hosts.collect()] == ["https://other.example/x?a=1&b=2"]
    assert filter_links(edges, False, allowed_prefixes=("/x",)).count() == 1
    assert filter_links(edges, False, excluded_prefixes=("/x",)).count() == 1


ROBOTS = {
    "wild": ("User-agent: *\nDisallow: /private\nAllow: /private/ok", {("disallow", "/private"), ("allow", "/private/ok")}),
    "exact": ("User-agent: *\nDisallow: /a\n\nUser-agent: Bot\nDisallow: /b\nCrawl-delay: 9.2\nUser-agent: *\nDisallow: /c",
              {("disallow", "/b"), ("delay", "10")}),
    "unrelated": ("User-agent: other\nDisallow: /", set()),
    "stacked": ("User-agent: bot\nUser-agent: other\nDisallow: /x", set()),
    "delays": ("User-agent: *\nCrawl-delay: abc\nCrawl-delay: 0\nCrawl-delay: 10\n# Disallow: /no\nDisallow:", {("delay", "10")}),
    "empty": ("", set()),
    "sitemap": ("Sitemap: https://s.example/map.xml\nUser-agent: *\nDisallow: /", {("disallow", "/"), ("sitemap", "https://s.example/map.xml")}),
}


def test_robots_rules(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in ROBOTS.items()], "origin STRING, txt STRING")
    found = {k: set() for k in ROBOTS}
    for r in robots_rules(df, "Bot").collect():
        found[r.origin].add((r.kind, r.value))
    assert found == {k: v[1] for k, v in ROBOTS.items()}


def test_robots_paths(spark):
    rules = spark.createDataFrame(
        [("https://a", "disallow", "/p"), ("https://a", "allow", "/p/ok"), ("https://a", "allow", "/tie"),
         ("https://a", "disallow", "/tie"), ("https://b", "disallow", "/")],
        "origin STRING, kind STRING, value STRING",
    )
    wanted = {"https://a/p/x": False, "https://a/p/ok/1": True, "https://a/tie": False, "https://a/z": True,
              "https://b/any": False, "https://c/any": True}
    urls = spark.createDataFrame([(u,) for u in wanted], "url STRING")
    assert {r.url: r.allowed for r in robots_filter(urls, rules).collect()} == wanted


def test_sitemap(spark):
    xml = "<urlset><loc> /docs/ </loc><LOC>https://a.example/docs/x#y</LOC><loc>https://b.example/z</loc><loc>/sitemap_index.xml</loc></urlset>"
    df = spark.createDataFrame([("https://a.example/sitemap.xml", xml)], "sitemap_url STRING, xml STRING")
    found = {(r.loc, r.nested) for r in sitemap_locs(df.withColumn("origin", F.lit("https://a.example"))).collect()}
    assert found == {("https://a.example/docs", False), ("https://a.example/docs/x", False), ("https://a.example/sitemap_index.xml", True)}


def test_source_kinds(spark):
    raw = spark.createDataFrame([("s", "n", "u", "# Title here\nbody")], "source_id STRING, name STRING, url STRING, text STRING")
    assert docs_of_kind("llmstxt", raw).first().title == "Title here"
    register_source_kind("upper", lambda df: df.select("source_id", "url", F.upper("name").alias("title"), "text"))
    assert docs_of_kind("upper", raw).first().title == "N" and "upper" in source_kinds()
    with pytest.raises(ValueError):
        docs_of_kind("nothing", raw)


def test_attributes_and_references(one):
    from corpusloom.functions.html import decode_entities, hrefs

    assert one(hrefs(F.col("h")), h='<a data-href="/no" href="/yes">x</a> <a data-href="/only">y</a> <a\nhref=/z>') == ["/yes", "/z"]
    text = "&#8217;&mdash;&#x27;&amp;lt;&eacute;&nope;&#0;&#xD800;&#128512; a & b &"
    assert one(decode_entities(F.col("t")), t=text) == "’—'&lt;é&nope;&#0;&#xD800;😀 a & b &"


def test_empty_main_stays_empty(one):
    assert one(main_html(F.col("h")), h="<body><p>x</p><main></main></body>") == ""


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body><p class='toc'>skip<p>kept</body>", "kept"),
        ("<body><ul><li class='toc'>skip<li>kept</ul><p>after</p></body>", "*   kept\n\nafter"),
        ("<body><div><p class='toc'>skip</div><p>kept</p></body>", "kept"),
        ("<body><pre><code class='language-js'><div>a</div><div>b</div></code></pre><p>c</p></body>", "```js\na\nb\n```\n\nc"),
        ("<body><blockquote><p>one</p><p>two</p></blockquote><p>three</p></body>", "> one\n\n> two\n\nthree"),
        ("<body><p>2 * 3_x [y]</p><p># no heading</p><p>1. no list</p></body>", "2 \\* 3\\_x \\[y\\]\n\n\\# no heading\n\n1\\. no list"),
        ("<body><p><a href='/a' title='T'>x</a> <code>a_b</code></p></body>", '[x](/a "T") `a_b`'),
    ],
)
def test_markdown_rules(one, page, want):
    assert one(html_to_markdown(F.col("h")), h=page) == want
