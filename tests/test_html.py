"""Tree building, roots, Markdown, selectors, the UDFs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loomspark.functions import dom, html, markdown, selectors

ARTICLE = """<html lang="en"><head><title>Ordered &amp; article</title></head><body><nav><a href="/n">nav</a></nav><article><h1>First</h1><p>A <strong>bold</strong> word and <a href="../rel?x=1">a link</a>.</p>
<h2>Second</h2><blockquote><p>Said one</p><p>Said two</p></blockquote><pre><code>x = 1
  y</code></pre><ul><li>one</li><li>two<ul><li>inner</li></ul></li></ul><ol start="5"><li>a</li><li>b</li></ol>
<table><tr><th>H1</th><th>H2</th></tr><tr><td>1</td><td>2</td><td>3</td></tr><tr><td>4</td></tr></table><img src="/i.png" alt="pic"><img src="data:x" alt="no"><hr><p>use <code>f( x )</code></p></article></body></html>"""


def rendered(page, base="https://example.com/a/b"):
    tree = dom.parse(page)
    return markdown.render(tree, markdown.content_root(tree), base)


def test_markdown_of_an_article():
    assert rendered(ARTICLE).split("\n") == """# Ordered & article

# First

A **bold** word and [a link](https://example.com/rel?x=1).

## Second

> Said one
> 
> Said two

```
x = 1
  y
```

- one
- two
  - inner

1. a
2. b

| H1 | H2 |
| --- | --- |
| 1 | 2 |
| 4 |  |

![pic](https://example.com/i.png)

---

use `f( x )`""".replace("> \n", ">\n").split("\n")


@pytest.mark.parametrize(
    "page, tree",
    [
        ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
        ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
        ("<p><b>a<br><p>b</p><p>c", "<p><b>a<br></b></p><p><b>b</b></p><p><b>c</b></p>"),
        ("<ul><li>a<li>b</ul>", "<ul><li>a</li><li>b</li></ul>"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "<table><tbody><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></tbody></table>"),
        ("<p>a<div>b</div>", "<p>a</p><div>b</div>"),
        ("x</p>y", "x<p></p>y"),
        ("<p><b><b><b><b>a</p><p>b", "<p><b><b><b><b>a</b></b></b></b></p><p><b><b><b>b</b></b></b></p>"),
        ("a<!-- x --b> -->b", "ab"),
        ("<a href=1>x<a href=2>y", '<a href="1">x</a><a href="2">y</a>'),
        ('<p title="a&amp;&quot;b">x &lt; y', '<p title="a&amp;&quot;b">x &lt; y</p>'),
    ],
)
def test_tree(page, tree):
    assert dom.parse(page).find("body").outer() == f"<body>{tree}</body>"


def test_raw_text_and_head():
    page = dom.parse('<title>a<b></title><script>var t="</p>";</script><p>x')
    assert page.find("title").texts() == ["a<b>"] and page.find("script").texts() == ['var t="</p>";'] and markdown.title_of(page) == "a<b>"


def test_sparse_main_gives_way_to_a_long_body_and_article_is_not_tried():
    page = f"<body><main>short</main><article>{'word ' * 50}</article><div>{'long text ' * 100}</div></body>"
    assert markdown.content_root(dom.parse(page)).tag == "body"
    assert markdown.content_root(dom.parse("<body><main>short</main><p>also short")).tag == "main"


def test_title_is_not_put_before_an_equal_beginning():
    assert rendered("<title>Acme</title><main><h1>Acme Corp</h1></main>") == "# Acme Corp"
    assert rendered("<title>Acme</title><main><p>x</main>") == "# Acme\n\nx"
    assert rendered("<main><span> a <b> </b> b</span></main>") == "a b"


def test_selectors():
    page = dom.parse('<div class="a b"><p id=x>1</p><p data-k="v w">2</p><span>3</span></div>')
    texts = lambda css: [dom.text_of(e) for e in selectors.select(page, css)]
    assert texts("div.a.b > p") == ["1", "2"] and texts("#x + p") == ["2"] and texts("[data-k~=w]") == ["2"] and texts("p ~ span") == ["3"] and texts("p:first-child, span") == ["1", "3"]
    for bad in ("", "a >", "p,,b", "$"):
        with pytest.raises(ValueError):
            selectors.compiled(bad)


@pytest.mark.parametrize(
    "css, want",
    [
        ("li:nth-child(2n+1)", "1 3 5"), ("li:nth-child(even)", "2 4"), ("li:nth-child(-n+2)", "1 2"), ("li:nth-last-child(1)", "5"), ("li:nth-of-type(3)", "3"), ("li:last-of-type, li:first-of-type", "1 5"), ("li:nth-child(n)", "1 2 3 4 5"), ("li:nth-child(0)", ""),
        ("li:not(.c):not(:last-child)", "1 2 4"), ("li:is(.c, #four)", "3 4"), ("li:not(.c, #four)", "1 2 5"), ("ul:has(> li.c) > li:first-child", "1"), ("div:has(b) p", ""), ("li:has(b)", "5"), ("li:has(+ .c)", "2"), ("li:has(~ .c)", "1 2"), ("li:has(> i)", ""), ("ul li:only-child", ""), ("b:only-of-type", "5"),
        ("[TITLE='Up' i]", "1"), ("[title=Up]", ""), ("[title|=up]", "1"), ("li:where(:not(:nth-child(n+3))) ", "1 2"), ("ul  >  li.c  ~  li", "4 5"), ("p:empty", ""), ("u:empty + li", ""), ("html:root li#four", "4"), ("li\\:x, li#four", "4"),
    ],
)
def test_pseudo_classes(css, want):
    page = dom.parse('<ul><li title="up">1</li><li>2</li><li class="c d">3</li><li id=four>4</li><li><b>5</b></li></ul><p></p>')
    assert " ".join(dom.text_of(e) for e in selectors.select(page, css)) == want


@pytest.mark.parametrize("css", ["", "a >", "> a", "p,,b", "$", "p:not(", "p:not()", "p:nth-child(x)", "p:nope", "p::before", "[a=]", "a)", ":has(> )", "p:first-child(2)"])
def test_invalid_selectors(css):
    with pytest.raises(ValueError):
        selectors.compiled(css)


def tried(e, steps):
    """Matching by trying every ancestor and sibling."""
    how, tests = steps[-1]
    if not all(e.tag == t[1] if t[0] == "tag" else t[1] in e.attrs.get("class", "").split() for t in tests):
        return False
    if len(steps) == 1:
        return True
    own = list(e.parent.elements()) if e.parent else [e]
    left, up, x = own[: next(i for i, c in enumerate(own) if c is e)], [], e.parent
    while x is not None:
        up.append(x)
        x = x.parent
    return any(tried(c, steps[:-1]) for c in {" ": up, ">": up[:1], "+": left[-1:], "~": left}[how])


def test_selectors_equal_trying_all_ways():
    rng = random.Random(6)
    for _ in range(60):
        parts = []
        for _ in range(40):
            tag = rng.choice(["div", "span", "b2"])
            parts.append(rng.choice([f"<{tag} class={rng.choice('xyz')}>", f"</{tag}>"]))
        page = dom.parse("".join(parts))
        for _ in range(8):
            css = rng.choice([" ", " > ", " + ", " ~ "]).join(rng.choice(["div", "span", ".x", "div.y", ".z"]) for _ in range(rng.randint(1, 4)))
            assert [id(e) for e in selectors.select(page, css)] == [id(e) for e in [page, *page.walk()] if tried(e, selectors.compiled(css)[0])], css


def test_deep_pages_take_seconds(spark):
    """A hundred thousand levels: rendered, matched, and in one batch with a plain page."""
    deep, began = 100_000, time.monotonic()
    for tag in ("div", "b", "span", "em"):
        assert rendered(f"<main>{f'<{tag}>' * deep}x") .replace("*", "") == "x"
    lists = "<main>" + "<ul><li>" * 3_000 + "x"
    assert rendered(lists) == "- " * 3_000 + "x"
    assert rendered("<main>" + "<blockquote>" * 3_000 + "x").endswith("> x")
    page = dom.parse("<section>" + "<div>" * deep + "<p>x")
    assert len(selectors.select(page, "section div div div p")) == 1 and len(selectors.select(page, "section div ~ p")) == 0
    assert len(selectors.select(page, "div:has(p):not(section > div)")) == deep - 1
    pages = spark.createDataFrame([("https://e.com/deep", f"<main>{'<div>' * deep}deep</main>"), ("https://e.com/b", "<main><p>plain</main>")], "url string, html string")
    assert sorted(r["markdown"] for r in html.extracted(pages, ["markdown"]).collect()) == ["deep", "plain"]
    assert time.monotonic() - began < 120


def test_columns(spark):
    pages = spark.createDataFrame([("https://e.com/x", ARTICLE), (None, None), ("https://e.com", "")], "url string, html string")
    got = html.extracted(pages).collect()
    assert got[0]["title"] == "Ordered & article" and got[0]["language"] == "en" and got[0]["links"] == ["https://e.com/rel?x=1"]
    assert got[0]["anchors"] == ["https://e.com/n", "https://e.com/rel?x=1"] and got[0]["images"] == ["https://e.com/i.png"]
    assert got[1]["markdown"] == got[2]["markdown"] == "" and got[1]["links"] == [] and got[1]["title"] is None
    with pytest.raises(ValueError):
        html.extracted(pages, ["nothing"])
    assert html.extracted(pages.limit(0)).count() == 0


def test_configured_content(spark):
    page = '<title>T</title><body><header>top</header><main><p>text</p><div class="ad">buy</div></main><aside>side</aside></body>'
    pages = spark.createDataFrame([("https://e.com", page)], "url string, html string")
    of = lambda **o: html.configured(pages, **o).first()
    assert of(only_main=True, exclude=[".ad"])["content_html"] == "<main><p>text</p></main>"
    assert "top" not in of(only_main=False, only_clean=True)["content_html"]
    assert of(include=["p", ".ad"])["content_html"] == '<p>text</p>\n<div class="ad">buy</div>'
    assert of(only_main=False)["content_markdown"] == "# T\n\ntext\n\nbuy"
    with pytest.raises(ValueError):
        html.configured(pages, include=["p >"])


def test_attributes_fall_back_to_data(spark):
    pages = spark.createDataFrame([("u", '<a href="/1" data-price="3">x</a><a data-href="/2">y</a>')], "url string, html string")
    got = html.attributes(pages, [("a", "href"), ("a", "price")]).select("attribute", "values").collect()
    assert [tuple(r) for r in got] == [("href", ["/1", "/2"]), ("price", ["3"])]


def test_entities(spark):
    assert spark.createDataFrame([("&lt;a&gt; &eacute;",), (None,)], "s string").select(html.unescaped(F.col("s"))).collect() == [("<a> é",), (None,)]


def test_entities_need_their_semicolon(spark):
    texts = ["x&amp", "a&ampb; &copy 1 &copy;", "&#65; &#x42; &#65 &#xD800; &#1114112; &#0;", "&amp;lt; &nosuch; &;", "&NotEqualTilde;"]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select(html.unescaped(F.col("s"))).collect()
    assert [r[0] for r in got] == ["x&amp", "a&ampb; &copy 1 ©", "A B &#65 &#xD800; &#1114112; \0", "&lt; &nosuch; &;", "≂̸"]


def test_cut_references_stay_where_asked(spark):
    page = '<html lang="en"><title>R&amp;D&amp</title><article><h1>R&amp;D&amp</h1><p>x &copy y &copy; z</p></article>'
    pages = spark.createDataFrame([("https://a.org/", page)], "url string, html string")
    parts = lambda **o: tuple(html.extracted(pages, ["title", "text", "markdown"], **o).select("title", "text", "markdown").first())
    assert parts() == ("R&D&", "R&D& x © y © z", "# R&D&\n\nx © y © z")
    assert parts(whole_references=True) == ("R&D&amp", "R&D&amp x &copy y © z", "# R&D&amp\n\nx &copy y © z")
    kept = html.configured(pages, only_main=False, only_clean=True, whole_references=True).first()["content_html"]
    assert "R&amp;D&amp;amp" in kept


@pytest.mark.parametrize("name", ["htm1_content_root", "htm2_configured_content", "htm3_title_language", "htm4_markdown_words", "str13_entities"])
def test_pages_with_cut_references_match_their_sql(spark, tmp_path, name):
    import duckdb

    import __spark_entry__ as entry

    head = "R&amp;D &copy; x&amp"
    page = f'<html lang="en"><head><title>{head}</title></head><body><article><h1>{head}</h1>\n<p>{head}&amp;&amp; y</p></article></body></html>'
    spark.createDataFrame([(1, "https://a.org/", page)], "page_id bigint, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()] == con.execute(entry.oracle_sql()[name]).fetchall()
