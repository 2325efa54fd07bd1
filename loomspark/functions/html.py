"""HTML operators as Arrow-batched UDFs: a page is parsed once, all that is wanted comes in one
struct, and Catalyst works on the columns from there."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dom, markdown
from .selectors import compiled, select

PARTS = {
    "title": "string",
    "language": "string",
    "markdown": "string",
    "text": "string",
    "root_html": "string",
    "links": "array<string>",
    "anchors": "array<string>",
    "images": "array<string>",
}


def _links(page: dom.Element, base: str) -> list[str]:
    """HTM13: anchors of the content root; first of each."""
    found = []
    for a in markdown.content_root(page).walk():
        href = a.attrs.get("href") if a.tag == "a" else None
        if href is not None and not href.startswith(("#", "javascript:")):
            found.append(dom.join(base, href))
    return [x for x in dict.fromkeys(found) if x]


def _anchors(page: dom.Element, base: str) -> list[str]:
    """HTM14: anchors of the whole page, in order, repeats kept."""
    found = [dom.join(base, a.attrs["href"]) for a in page.walk() if a.tag == "a" and "href" in a.attrs]
    return [x for x in found if x]


def _images(page: dom.Element, base: str) -> list[str]:
    """HTM15."""
    found = [dom.join(base, e.attrs["src"]) for e in page.walk() if e.tag == "img" and "src" in e.attrs and not e.attrs["src"].startswith("data:")]
    return [x for x in dict.fromkeys(found) if x]


_MAKE: dict[str, Callable[[dom.Element, str], object]] = {
    "title": lambda p, u: markdown.title_of(p) or None,
    "language": lambda p, u: p.attrs.get("lang") or None,
    "markdown": lambda p, u: markdown.render(p, markdown.content_root(p), u),
    "text": lambda p, u: dom.text_of(markdown.content_root(p)),
    "root_html": lambda p, u: markdown.content_root(p).outer(),
    "links": _links,
    "anchors": _anchors,
    "images": _images,
}


def _arrow(kind: str) -> pa.DataType:
    return pa.list_(pa.string()) if kind.startswith("array") else pa.string()


def extracted(pages: DataFrame, parts: Sequence[str] = tuple(PARTS), url_col: str = "url", html_col: str = "html", whole_references: bool = False) -> DataFrame:
    """``pages`` with the wanted parts as columns. Only those are computed: a UDF's result can't
    be pruned from outside. Null html is an empty page; a null url resolves nothing.
    ``whole_references``: in text, character references without their semicolon (cut ones) stay as
    they are; by default they are decoded as browsers do."""
    wanted = list(parts)
    if unknown := [p for p in wanted if p not in PARTS]:
        raise ValueError(f"unknown parts: {unknown}")
    kind = pa.struct([(p, _arrow(PARTS[p])) for p in wanted])

    @F.arrow_udf("struct<" + ", ".join(f"{p}: {PARTS[p]}" for p in wanted) + ">")
    def page_parts(urls: pa.Array, pages: pa.Array) -> pa.Array:
        out = []
        for url, html in zip(urls.to_pylist(), pages.to_pylist(), strict=True):
            page = dom.parse(html or "", whole_references)
            out.append({p: _MAKE[p](page, url or "") for p in wanted})
        return pa.array(out, kind)

    # Marked as not deterministic, or each use of a field would run it again.
    found = page_parts.asNondeterministic()(F.col(url_col), F.col(html_col))
    return pages.withColumn("_parts", found).select("*", *[F.col(f"_parts.{p}").alias(p) for p in wanted]).drop("_parts")


def configured(pages: DataFrame, only_main: bool = True, only_clean: bool = False, include: Sequence[str] = (), exclude: Sequence[str] = (), url_col: str = "url", html_col: str = "html", whole_references: bool = False) -> DataFrame:
    """HTM2 and HTM5: adds content_html, and its content_markdown under the page's own title.
    Selectors are checked when the plan is made. ``whole_references``: see ``extracted``."""
    include, exclude = list(include), list(exclude)
    for css in [*include, *exclude]:
        compiled(css)
    kind = pa.struct([("content_html", pa.string()), ("content_markdown", pa.string())])

    @F.arrow_udf("struct<content_html: string, content_markdown: string>")
    def content(urls: pa.Array, pages: pa.Array) -> pa.Array:
        out = []
        for url, html in zip(urls.to_pylist(), pages.to_pylist(), strict=True):
            page = dom.parse(html or "", whole_references)
            chosen = markdown.configured(page, only_main, only_clean, include, exclude)
            part = dom.parse(chosen)
            text, title = markdown.render(part, markdown.content_root(part), url or ""), markdown.title_of(page)
            if title and not text.lstrip().startswith(f"# {title}"):
                text = markdown.blank_collapsed(f"# {title}\n\n{text.strip()}")
            out.append({"content_html": chosen, "content_markdown": text})
        return pa.array(out, kind)

    found = content.asNondeterministic()(F.col(url_col), F.col(html_col))
    return pages.withColumn("_parts", found).select("*", "_parts.content_html", "_parts.content_markdown").drop("_parts")


def attributes(pages: DataFrame, selectors: Sequence[tuple[str, str]], html_col: str = "html") -> DataFrame:
    """HTM16: ``pages`` exploded to (selector, attribute, values), a row for each selector; an
    attribute that an element hasn't is looked for as ``data-`` and its name."""
    selectors = list(selectors)
    names = F.array(*[F.struct(F.lit(c).alias("selector"), F.lit(a).alias("attribute")) for c, a in selectors])
    zipped = F.arrays_zip(names.alias("n"), attribute_values(F.col(html_col), selectors).alias("v"))
    return pages.withColumn("_z", F.explode(zipped)).select("*", "_z.n.selector", "_z.n.attribute", F.col("_z.v").alias("values")).drop("_z")


def attribute_values(html: Column, selectors: Sequence[tuple[str, str]]) -> Column:
    """HTM16 as a column: for each (selector, attribute) the values that aren't empty; a page is
    parsed once for all of them."""
    selectors = list(selectors)
    for css, _ in selectors:
        compiled(css)

    @F.arrow_udf("array<array<string>>")
    def values(pages: pa.Array) -> pa.Array:
        out = []
        for html in pages.to_pylist():
            page, rows = dom.parse(html or ""), []
            for css, name in selectors:
                got = [e.attrs.get(name, None if name.startswith("data-") else e.attrs.get(f"data-{name}")) for e in select(page, css)]
                rows.append([v for v in got if v])
            out.append(rows)
        return pa.array(out, pa.list_(pa.list_(pa.string())))

    return values.asNondeterministic()(html)


def selected(html: Column, css: str, attribute: str | None = None) -> Column:
    """Texts (or values of an attribute) of the elements that fit a selector."""
    compiled(css)

    @F.arrow_udf("array<string>")
    def run(pages: pa.Array) -> pa.Array:
        out = []
        for page in pages.to_pylist():
            fit = select(dom.parse(page or ""), css)
            out.append([dom.text_of(e) if attribute is None else e.attrs.get(attribute) for e in fit])
        return pa.array(out, pa.list_(pa.string()))

    return run(html)


def unescaped(text: Column) -> Column:
    """STR13: character references decoded, as the reference's decoder of texts does: whole ones,
    with their semicolon; all else stays. (In pages, the parser decodes as browsers do.)"""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else dom.whole_references(t) for t in texts.to_pylist()], pa.string())

    # Most texts have none, and needn't leave the JVM's memory as text.
    some = F.when(text.contains("&"), text)
    return F.coalesce(run(some), text)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
