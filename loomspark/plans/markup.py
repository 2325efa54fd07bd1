"""Queries over pages made for the purpose: markup, links, images and results that the test pages lack."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import html, text, urls
from ..operators import search
from ..sources import documents, feeds, robots
from . import query, table
from .pages import HOST, SCHEME

#: What is put before an article's own text: links, images and a form.
EXTRA = '<nav><a href="/nav">n</a></nav><a href="/a?x=1#f">A</a><a href="#top">t</a><a href="javascript:x()">j</a><a href="/a?x=1#f">again</a><a href="../up">up</a><img src="/i.png" alt="i"><img src="data:image/png;base64,x"><img src="//cdn.org/j.png"><img src="/i.png">'
_IN_SITE = f"{SCHEME} || '://' || {HOST}"


def _pages(spark, sf_dir):
    """Every seventh page blank, the others with EXTRA in their article."""
    p = table(spark, sf_dir, "pages")
    blank = F.lit("<html><head><title>empty</title></head><body><p> \n </p><div><br></div></body></html>")
    return p.withColumn("html", F.when(F.col("page_id") % 7 == 0, blank).otherwise(F.replace("html", F.lit("<article>"), F.lit("<article>" + EXTRA))))


@query("htm13_root_links", f"SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '' ELSE {_IN_SITE} || '/nav ' || {_IN_SITE} || '/a?x=1#f ' || {_IN_SITE} || regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', ''), '[^/]+/$', ''), '^$', '/') || 'up' END AS links FROM pages")
def htm13_root_links(spark, sf_dir):
    return html.extracted(_pages(spark, sf_dir), ["links"]).select("page_id", F.array_join("links", " ").alias("links"))


@query("htm15_images", f"SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '' ELSE {_IN_SITE} || '/i.png ' || {SCHEME} || '://cdn.org/j.png' END AS images FROM pages")
def htm15_images(spark, sf_dir):
    return html.extracted(_pages(spark, sf_dir), ["images"]).select("page_id", F.array_join("images", " ").alias("images"))


@query("htm20_blank_pages", "SELECT page_id, 'empty_content' AS error FROM pages WHERE page_id % 7 = 0")
def htm20_blank_pages(spark, sf_dir):
    # Without the title, which Markdown would begin with.
    p = _pages(spark, sf_dir).withColumn("html", F.regexp_replace("html", "<title>.*?</title>", ""))
    return html.extracted(p, ["markdown"]).where(text.trimmed(F.col("markdown")) == "").select("page_id", F.lit("empty_content").alias("error"))


@query("htm23_enrichment", "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 0 ELSE 2 END AS n_images, CASE WHEN page_id % 7 = 0 THEN '' ELSE '/a?x=1#f,#top,javascript:x(),/a?x=1#f,../up' END AS hrefs, page_id % 7 = 0 AS blank, false AS has_html FROM pages")
def htm23_enrichment(spark, sf_dir):
    p = html.extracted(_pages(spark, sf_dir), ["title", "markdown"])
    e = search.enriched(p, ["images", "summary", "attributes", "deterministicJson"], schema={"properties": {"title": {"type": "string"}}}, selectors=[("article > a", "href")])
    hrefs = F.array_join(F.col("attributes")[0]["values"], ",")
    return e.select("page_id", F.size("images").alias("n_images"), hrefs.alias("hrefs"), (F.col("deterministicJson")["title"] == "empty").alias("blank"), F.lit("html" in e.columns).alias("has_html"))


@query("htm2_included_content", "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '' ELSE '<a href=\"/a?x=1#f\">A</a>' || chr(10) || '<a href=\"#top\">t</a>' || chr(10) || chr(10) || '<a href=\"/a?x=1#f\">again</a>' || chr(10) || '<a href=\"../up\">up</a>' END AS content FROM pages")
def htm2_included_content(spark, sf_dir):
    p = html.configured(_pages(spark, sf_dir), include=["article > a"], exclude=["a[href^=javascript]"])
    return p.select("page_id", F.col("content_html").alias("content"))


#: Markup of every kind, and its Markdown; {n} is a name, {k} a number.
MARKUP = """<html lang="en"><head><title>Page {k}</title></head><body><nav>menu</nav><article><h2>{n} &amp; co</h2><p>One <b>bold {n}</b> and <em>soft</em> <code>x = {k}</code> after <a href="/a?x={k}#f">link {k}</a><br>next
  line</p><ul><li>a</li><li>b {n}<ul><li>c</li><li>d</li></ul></li></ul><ol><li>x</li><li><p>y</p><p>z</p></li></ol><blockquote><p>said {n}</p><p>twice</p></blockquote><pre><code>l1 {k}
  l2 &lt;x&gt;</code></pre><table><tr><th>k</th><th>v</th></tr><tr><td>{k}</td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table><div><img src="/i{k}.png" alt="pic {n}"></div><hr><p><a href="#x">here</a></p><h4>End</h4><script>no()</script></article><footer>foot</footer></body></html>"""
RENDERED = """# Page {k}

## {n} & co

One **bold {n}** and *soft*`x = {k}` after [link {k}](https://h.org/a?x={k}#f)
next line

- a
- b {n}
  - c
  - d

1. x
2. y
  z

> said {n}
>
> twice

```
l1 {k}
  l2 <x>
```

| k | v |
| --- | --- |
| {k} |  |
| 1 | 2 |

![pic {n}](https://h.org/i{k}.png)

---

here

#### End"""


def _filled(template: str, n, k):
    return F.replace(F.replace(F.lit(template), F.lit("{n}"), n), F.lit("{k}"), k.cast("string"))


def _sql(template: str) -> str:
    return "replace(replace('" + template.replace("'", "''") + "', '{n}', n_name), '{k}', n_nationkey::VARCHAR)"


@query("htm4_markdown_blocks", f"SELECT n_nationkey, {_sql(RENDERED)} AS markdown FROM nation")
def htm4_markdown_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.lit("https://h.org/d/e").alias("url"), _filled(MARKUP, F.col("n_name"), F.col("n_nationkey")).alias("html"))
    return html.extracted(rows, ["markdown"]).select("n_nationkey", "markdown")


@query("htm5_configured_markdown", "SELECT n_nationkey, '# Page ' || n_nationkey || chr(10) || chr(10) || '- a' || chr(10) || '- b ' || n_name || chr(10) || '  - c' || chr(10) || '  - d' AS markdown FROM nation")
def htm5_configured_markdown(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.lit("https://h.org/d/e").alias("url"), _filled(MARKUP, F.col("n_name"), F.col("n_nationkey")).alias("html"))
    return html.configured(rows, include=["article > ul"]).select("n_nationkey", F.col("content_markdown").alias("markdown"))


ROBOTS = ("User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /de\nAllow: /de/1\n", "User-agent: loombot\nUser-agent: x\nDisallow: /*.html$ # pages\n\nUser-agent: *\nDisallow: /\n", "User-agent: *\nDisallow: /docs/\nAllow: /docs/$\n", None)
_ROBOTS_PATH = "regexp_extract(u, '^https://h.org([^?#]*)', 1)"


@query(
    "rob1_rules",
    f"""WITH p AS (SELECT event_id, event_id % 4 AS b, 'https://h.org' || ['/de/1', '/de/2', '/x.html', '/docs', '/docs/a', '/docs/', '/'][event_id % 7 + 1] AS u FROM events)
SELECT event_id, CASE b WHEN 0 THEN NOT starts_with({_ROBOTS_PATH}, '/de') OR starts_with({_ROBOTS_PATH}, '/de/1') WHEN 1 THEN NOT ends_with({_ROBOTS_PATH}, '.html') WHEN 2 THEN NOT starts_with({_ROBOTS_PATH}, '/docs/a') ELSE true END AS allowed FROM p""",
)
def rob1_rules(spark, sf_dir):
    n = F.col("event_id")
    body = F.element_at(F.array(*[F.lit(r) for r in ROBOTS]), (n % 4 + 1).cast("int"))
    path = F.element_at(F.array(*[F.lit(p) for p in ("/de/1", "/de/2", "/x.html", "/docs", "/docs/a", "/docs/", "/")]), (n % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(n, robots.allowed(body, F.concat(F.lit("https://h.org"), path), "LoomBot/1.0").alias("allowed"))


@query("url4_modes", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'https://h.org/d/s1 https://h.org/d/s2 https://h.org/d/a1' WHEN 1 THEN 'https://h.org/d/a1 https://h.org/d/a2' ELSE 'https://h.org/d/s1 https://h.org/d/s2' END AS links, ['sitemap+html_links', 'html_links', 'sitemap'][event_id % 3 + 1] AS provider FROM events")
def url4_modes(spark, sf_dir):
    at = lambda *paths: F.array(*[F.lit(f"https://h.org{p}") for p in paths])
    sitemap, anchors, base = at("/d/s1", "/d/s2", "/d/s1#x", "/other"), at("/d/a1", "/d/a2", "/d/a3"), F.lit("https://h.org/d")
    # Cut to three links each, then to those in scope, then to three in all.
    include = urls.site_map(sitemap, anchors, base, limit=3, mode="include")
    skip = urls.site_map(sitemap, F.slice(anchors, 1, 2), base, limit=3, mode="skip")
    only = urls.site_map(sitemap, anchors, base, limit=3, mode="only")
    n = F.col("event_id")
    m = F.when(n % 3 == 0, include).when(n % 3 == 1, skip).otherwise(only)
    return table(spark, sf_dir, "events").select(n, F.array_join(m["links"], " ").alias("links"), m["provider"].alias("provider"))


@query("win7_last_wins", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'the last ' || event_id ELSE 'the quick one' END AS passage FROM events")
def win7_last_wins(spark, sf_dir):
    n = F.col("event_id")
    tail = F.when(n % 3 == 0, F.concat(F.lit("the last "), n.cast("string"))).otherwise(F.lit("nothing here"))
    passages = F.concat_ws("\n\n", F.lit("# the quick head"), F.lit("the first"), F.when(n % 3 != 0, F.lit("the quick one")).otherwise(F.lit("the middle")), tail)
    return table(spark, sf_dir, "events").select(n, text.best_passage(passages, "the quick").alias("passage"))


@query("fil1_formats", 'SELECT source || \'/\' || doc_id AS url, coalesce(text, \'\') AS markdown, lang AS "rawHtml", NULL::VARCHAR AS summary FROM documents')
def fil1_formats(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    p = d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.coalesce("text", F.lit("")).alias("markdown"), F.col("lang").alias("rawHtml"), F.lit("no").alias("html"))
    return search.formats(p, ["MARKDOWN", "raw_html", "Summary", "markdown"])


@query("src11_web_results", "SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS ord, 'https://n.org/' || n_nationkey || '?q=1' AS url, n_name AS title, 'about ' || n_name AS description FROM nation WHERE n_nationkey % 4 <> 0 QUALIFY ord < 3")
def src11_web_results(spark, sf_dir):
    to = F.concat(F.lit("https://duckduckgo.com/l/?uddg="), F.url_encode(F.concat(F.lit("https://n.org/"), F.col("n_nationkey").cast("string"), F.lit("?q=1"))))
    link = F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit('<a class="result__a" href="'), to, F.lit('">'), "n_name", F.lit("</a>"))).otherwise(F.lit(""))
    box = F.concat(F.lit('<div class="result">'), link, F.lit('<a class="result__snippet">about\n <b>'), "n_name", F.lit("</b></a></div>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", box.alias("l")))), lambda x: x["l"]), "")
    f = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(body.alias("payload"))
    return feeds.web_results(f, 3).drop("payload").withColumn("ord", F.col("ord").cast("bigint"))


@query("src10_image_results", "SELECT n_regionkey, string_agg('https://i.org/' || n_nationkey || '.png=' || n_name, ' ' ORDER BY n_nationkey) AS images FROM nation WHERE n_nationkey % 3 <> 0 GROUP BY n_regionkey")
def src10_image_results(spark, sf_dir):
    murl = F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lit("https://i.org/"), F.col("n_nationkey").cast("string"), F.lit(".png")))
    m = F.to_json(F.struct(murl.alias("murl"), F.col("n_name").alias("t")))
    a = F.concat(F.lit("<a class='x iusc' m='"), m, F.lit("'></a>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", a.alias("l")))), lambda x: x["l"]), "")
    f = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(body.alias("payload"))
    return f.select("n_regionkey", F.array_join(F.transform(feeds.image_results(F.col("payload")), lambda x: F.concat_ws("=", x["url"], x["title"])), " ").alias("images"))


@query("str7_schema", "SELECT n_nationkey, n_name AS company, NULL::VARCHAR AS size FROM nation")
def str7_schema(spark, sf_dir):
    m = text.fields({"properties": {"company": {"description": "who", "type": "string"}, "size": 5}}, F.col("n_name"), F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", m.alias("m")).select("n_nationkey", F.col("m")["company"].alias("company"), F.col("m")["size"].alias("size"))


@query("str12_scalars", "SELECT event_id, event_id::VARCHAR AS a, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS b, NULL::VARCHAR AS c, 'x' AS d FROM events")
def str12_scalars(spark, sf_dir):
    n = F.col("event_id")
    reply = F.concat(F.lit('```json\n{"a": '), n.cast("string"), F.lit(', "b": '), (n % 2 == 0).cast("string"), F.lit(', "c": null, "d": " x ", "e": [1]}\n```'))
    m = text.scalar_fields(reply, ["a", "b", "c", "d"])
    return table(spark, sf_dir, "events").select(n, m.alias("m")).select("event_id", *[F.col("m")[c].alias(c) for c in "abcd"])


@query(
    "src15_documents",
    """SELECT n_nationkey, ['html', 'rtf', 'html', 'pdf', NULL][n_nationkey % 5 + 1] AS kind, ['## ' || n_name || chr(10) || chr(10) || 'See [it](/u) **now**', n_name || chr(10) || chr(10) || 'two', '* ' || n_name || chr(10) || '* b', NULL, NULL][n_nationkey % 5 + 1] AS markdown, n_nationkey % 5 >= 3 AS failed FROM nation""",
)
def src15_documents(spark, sf_dir):
    n, name = F.col("n_nationkey"), F.col("n_name")
    nth = lambda *v: F.element_at(F.array(*v), (n % len(v) + 1).cast("int"))
    file = nth(*[F.lit(f) for f in ("a.HTM", "b.rtf", "c.x.html", "d.pdf", "e")])
    page = F.concat(F.lit("<style>x</style><h2>"), name, F.lit('</h2><p>See <a href="/u">it</a> <b>now</b></p>'))
    rtf = F.concat(F.lit("{\\rtf1{\\fonttbl x;}"), name, F.lit("\\par two}"))
    items = F.concat(F.lit("<ul><li>"), name, F.lit("<li>b</ul>"))
    data = nth(page, rtf, items, F.lit("%PDF-1.4"), F.lit("x")).cast("binary")
    d = documents.parsed(table(spark, sf_dir, "nation").select(n, file.alias("filename"), data.alias("data")))
    return d.select("n_nationkey", "kind", "markdown", F.col("error").isNotNull().alias("failed"))


def _zipped(parts):
    """Binary column of a zip of (name, text) pairs, whose texts are columns."""
    names = [n for n, _ in parts]

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for row in texts.to_pylist():
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                for name, text_ in zip(names, row, strict=True):
                    z.writestr(name, text_)
            out.append(held.getvalue())
        return pa.array(out, pa.binary())

    return run(F.array(*[c for _, c in parts]))


@query(
    "src18_office",
    """WITH k AS (SELECT s_suppkey, s_name AS n, s_nationkey AS c, unnest(['docx', 'odt', 'xlsx']) AS kind FROM supplier)
SELECT s_suppkey, kind, CASE kind WHEN 'docx' THEN '## ' || n || chr(10) || chr(10) || 'Supplier ' || s_suppkey || chr(10) || chr(10) || '| name | nation |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n || ' | ' || c || ' |'
 WHEN 'odt' THEN '## ' || n || chr(10) || chr(10) || 'from ' || c ELSE '## Sheet ' || c || chr(10) || chr(10) || '| name |  | nation |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || n || ' |  | ' || c || ' |' END AS markdown FROM k""",
)
def src18_office(spark, sf_dir):
    """SRC18, SRC19: a document, a text and a workbook of every supplier."""
    n, name, nation = (F.col(c).cast("string") for c in ("s_suppkey", "s_name", "s_nationkey"))
    xml = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    cell = lambda x: xml("<w:tc><w:p><w:r><w:t>", x, "</w:t></w:r></w:p></w:tc>")
    row = lambda *cells: xml("<w:tr>", *map(cell, cells), "</w:tr>")
    docx = xml('<w:document xmlns:w="http://w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>', name, "</w:t></w:r></w:p><w:tbl>", row("name", "nation"), row(name, nation), "</w:tbl><w:p><w:r><w:t>Supplier ", n, "</w:t></w:r></w:p></w:body></w:document>")
    odt = xml('<d xmlns:t="u"><t:p>from ', nation, '</t:p><t:h t:outline-level="2">', name, "</t:h></d>")
    sheet = xml('<w><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="C2"><v>', nation, "</v></c></row></sheetData></w>")
    book = [("xl/workbook.xml", xml('<workbook xmlns:r="http://r"><sheets><sheet name="Sheet ', nation, '" r:id="r1"/></sheets></workbook>')), ("xl/_rels/workbook.xml.rels", xml('<R><x Id="r1" Target="worksheets/s.xml"/></R>')), ("xl/sharedStrings.xml", xml("<sst><si><t>name</t></si><si><t>nation</t></si><si><t>", name, "</t></si></sst>")), ("xl/worksheets/s.xml", sheet)]
    made = {"docx": [("word/document.xml", docx)], "odt": [("content.xml", odt)], "xlsx": book}
    s = table(spark, sf_dir, "supplier")
    files = [s.select("s_suppkey", F.concat(F.lit("f."), F.lit(kind)).alias("filename"), _zipped(parts).alias("data")) for kind, parts in made.items()]
    return documents.parsed(files[0].union(files[1]).union(files[2])).select("s_suppkey", "kind", "markdown")


@query("src17_pdf_pages", "SELECT user_id, string_agg(CASE WHEN event_id % 3 = 0 THEN 'scan ' || event_id WHEN event_id % 3 = 1 THEN 'a page with text enough ' || event_id ELSE 'short' END, chr(10) || chr(10) ORDER BY event_id) AS text, count(*) AS pages FROM events GROUP BY user_id")
def src17_pdf_pages(spark, sf_dir):
    n = F.col("event_id")
    own = F.when(n % 3 == 0, F.lit(" few ")).when(n % 3 == 1, F.concat(F.lit("a page with text enough "), n.cast("string"))).otherwise(F.lit("short"))
    scan = F.when(n % 3 < 2, F.concat(F.lit("scan "), n.cast("string")))
    p = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), n.alias("page"), own.alias("text"), scan.alias("ocr_text"))
    return documents.pdf_pages(p, "auto", 1 << 60).select(F.col("id").alias("user_id"), "text", "pages")
