"""Office documents to Markdown, on the standard library alone: html, docx, odt, rtf, xlsx.

PDF needs a library that isn't here and doc an outside program; both give a null text and an
error, as does a damaged file.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dom, text

SUFFIXES = ("html", "htm", "xhtml", "pdf", "doc", "docx", "odt", "rtf", "xls", "xlsx")


def kind_of(filename: Column) -> Column:
    """SRC15: the parser of a file by its suffix; null if there's none."""
    s = F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1))
    s = F.when(s.isin("htm", "xhtml"), F.lit("html")).otherwise(s)
    return F.when(s.isin(*SUFFIXES), s)


def _table(rows: list[list[str]]) -> str:
    """SRC19: as wide as the widest row."""
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


_MARKS = {"b": "**", "strong": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "code": "`", "kbd": "`", "samp": "`"}
_GONE = ("script", "style", "noscript", "head", "template")
_LISTS = ("ul", "ol")


def _inline(e: dom.Element) -> str:
    """Text with its marks, links and images; white space as single blanks, but for line breaks."""
    out: list[str] = []
    for c in e.children:
        if isinstance(c, str):
            out.append(re.sub(r"\s+", " ", c))
        elif c.tag == "br":
            out.append("  \n")
        elif c.tag == "img":
            out.append(f"![{c.attrs.get('alt', '')}]({c.attrs.get('src', '')})")
        elif c.tag not in _GONE and c.tag not in _LISTS:
            inner, mark = _inline(c), _MARKS.get(c.tag)
            bare = inner.strip()
            if bare and mark:
                inner = inner[: len(inner) - len(inner.lstrip())] + mark + bare + mark + inner[len(inner.rstrip()) :]
            elif bare and c.tag == "a" and c.attrs.get("href"):
                inner = f"[{bare}]({c.attrs['href']})"
            out.append(inner)
    return re.sub(r" {2,}(?!\n)", " ", "".join(out))


def _items(e: dom.Element) -> list[str]:
    """Lines of a list; inner lists stand in from their item's text."""
    lines: list[str] = []
    for i, item in enumerate(c for c in e.children if not isinstance(c, str) and c.tag == "li"):
        mark = f"{i + 1}. " if e.tag == "ol" else "* "
        paragraphs = [c for c in item.children if not isinstance(c, str) and c.tag in ("p", "div")]
        text = " ".join(x for x in [_inline(item).strip()] if x) if not paragraphs else "\n\n".join(x for x in (_inline(p).strip() for p in paragraphs) if x)
        lines.append(mark + re.sub(r"\n(?!\n)", "\n" + " " * len(mark), text))
        for inner in (c for c in item.walk() if c.tag in _LISTS and c is not item):
            if _owner(inner, item):
                lines += [" " * len(mark) + line for line in _items(inner)]
    return lines


def _owner(inner: dom.Element, item: dom.Element) -> bool:
    """Whether the list stands in the item itself, not in a deeper one."""
    todo = [c for c in item.children if not isinstance(c, str)]
    while todo:
        c = todo.pop()
        if c is inner:
            return True
        if c.tag not in _LISTS:
            todo += [x for x in c.children if not isinstance(x, str)]
    return False


def html_document(data: bytes) -> str:
    """SRC16: headings with number signs, paragraphs with their links and marks, lists, quotations,
    code and tables; no scripts and styles."""
    out: list[str] = []

    def put(e: dom.Element) -> None:
        if e.tag in _GONE:
            return
        if e.tag in dom.HEADINGS:
            out.append(f"{'#' * int(e.tag[1])} {_inline(e).strip()}")
        elif e.tag in _LISTS:
            out.append("\n".join(_items(e)))
        elif e.tag == "pre":
            out.append("```\n" + "".join(x if isinstance(x, str) else dom.text_of(x) for x in e.children).strip("\n") + "\n```")
        elif e.tag == "hr":
            out.append("---")
        elif e.tag == "table":
            rows = [[_inline(c).strip() for c in r.children if not isinstance(c, str) and c.tag in ("td", "th")] for r in e.walk() if r.tag == "tr"]
            out.append(_table([r for r in rows if r]))
        elif e.tag == "blockquote":
            before = len(out)
            blocks(e)
            inner = "\n\n".join(x for x in out[before:] if x.strip())
            del out[before:]
            out.append("\n".join(f"> {line}".rstrip() for line in inner.split("\n")))
        elif e.tag == "p":
            out.append(_inline(e).strip())
        else:
            blocks(e)

    def blocks(e: dom.Element) -> None:
        """Runs of text and inline elements as paragraphs, blocks on their own."""
        run = dom.Element("p", {})
        for c in [*e.children, None]:
            inline = isinstance(c, str) or (c is not None and c.tag not in _BLOCKS and not any(x.tag in _BLOCKS for x in c.walk()))
            if inline:
                run.children.append(c)
                continue
            if run.children:
                out.append(_inline(run).strip())
                run = dom.Element("p", {})
            if c is not None:
                put(c)

    put(dom.parse(data.decode("utf-8", "replace")))
    return "\n\n".join(x for x in out if x.strip("# *"))


_BLOCKS = frozenset("p div ul ol li table pre blockquote hr section article main header footer aside nav h1 h2 h3 h4 h5 h6 script style noscript head template body html form dl dt dd figure".split())


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def docx_document(data: bytes) -> str:
    """SRC18: paragraphs, headings by style, then tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(e for e in ET.fromstring(z.read("word/document.xml")) if _local(e.tag) == "body")
    said = lambda e: "".join(x.text or "" for x in e.iter() if _local(x.tag) == "t").strip()
    out = []
    for p in (e for e in body if _local(e.tag) == "p"):
        style = next((v for x in p.iter() if _local(x.tag) == "pStyle" for v in x.attrib.values()), "")
        level = re.match(r"[Hh]eading\s?([1-6])", style)
        if said(p):
            out.append(("#" * int(level[1]) + " " if level else "") + said(p))
    for t in (e for e in body if _local(e.tag) == "tbl"):
        out.append(_table([[said(c) for c in r if _local(c.tag) == "tc"] for r in t if _local(r.tag) == "tr"]))
    return "\n\n".join(out)


def odt_document(data: bytes) -> str:
    """SRC18: headings, then paragraphs."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("content.xml"))
    said = lambda e: "".join(e.itertext()).strip()
    heads = [f"{'#' * int(next((v for k, v in e.attrib.items() if _local(k) == 'outline-level'), '1'))} {said(e)}" for e in root.iter() if _local(e.tag) == "h"]
    return "\n\n".join([*heads, *[said(e) for e in root.iter() if _local(e.tag) == "p" and said(e)]])


def rtf_document(data: bytes) -> str:
    """SRC18: text without control words and without groups of settings."""
    out, stack, skip, at, s = [], [], False, 0, data.decode("latin-1")
    token = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|([^\\{}]+)", re.I | re.S)
    while at < len(s):
        m = token.match(s, at)
        if not m:
            break
        at = m.end()
        word, number, code, sign, brace, plain = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif sign == "*" or word in ("fonttbl", "colortbl", "stylesheet", "info", "pict"):
            skip = True
        elif not skip:
            if word in ("par", "line"):
                out.append("\n\n")
            elif word == "tab":
                out.append("\t")
            elif word == "u" and number:
                out.append(chr(int(number) % 65536))
                at += 1 if s[at : at + 1] not in ("\\", "{", "}", "") else 0
            elif code:
                out.append(bytes([int(code, 16)]).decode("cp1252", "replace"))
            elif sign in ("\\", "{", "}"):
                out.append(sign)
            elif plain:
                out.append(plain.replace("\r", "").replace("\n", ""))
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


def xlsx_document(data: bytes) -> str:
    """SRC19: a heading and a table for each sheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        strings = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        rel = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in (e for e in ET.fromstring(z.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"):
            target = rel[next(v for k, v in sheet.attrib.items() if _local(k) == "id")]
            rows = []
            for row in (e for e in ET.fromstring(z.read("xl/" + target.lstrip("/").removeprefix("xl/"))).iter() if _local(e.tag) == "row"):
                cells: list[str] = []
                for c in (e for e in row if _local(e.tag) == "c"):
                    letters = re.match(r"[A-Z]+", c.get("r", ""))
                    column = 0
                    for ch in letters[0] if letters else "":
                        column = column * 26 + ord(ch) - 64
                    cells += [""] * (column - 1 - len(cells))
                    value = "".join(x.text or "" for x in c.iter() if _local(x.tag) in ("v", "t"))
                    cells.append(strings[int(value)] if c.get("t") == "s" and value else value)
                rows.append(cells)
            out.append(f"## {sheet.get('name')}\n\n{_table(rows)}".strip())
    return "\n\n".join(out)


_PARSERS: dict[str, Callable[[bytes], str]] = {"html": html_document, "docx": docx_document, "odt": odt_document, "rtf": rtf_document, "xlsx": xlsx_document}


def parsed(files: DataFrame, name_col: str = "filename", data_col: str = "data") -> DataFrame:
    """``files`` with kind, markdown and error. A null or damaged file is an error of its row."""
    kind = pa.struct([("markdown", pa.string()), ("error", pa.string())])

    @F.arrow_udf("struct<markdown: string, error: string>")
    def run(kinds: pa.Array, datas: pa.Array) -> pa.Array:
        out = []
        for k, data in zip(kinds.to_pylist(), datas.to_pylist(), strict=True):
            row = {"markdown": None, "error": None}
            if k not in _PARSERS:
                row["error"] = "unsupported_document" if k is None else f"no parser for {k}"
            elif data is None:
                row["error"] = "empty_document"
            else:
                try:
                    row["markdown"] = _PARSERS[k](data)
                except (ValueError, KeyError, IndexError, StopIteration, zipfile.BadZipFile, ET.ParseError) as e:
                    row["error"] = f"parse_failed: {type(e).__name__}"
            out.append(row)
        return pa.array(out, kind)

    found = run.asNondeterministic()(F.col("kind"), F.col(data_col))
    return files.withColumn("kind", kind_of(F.col(name_col))).withColumn("_p", found).select("*", "_p.markdown", "_p.error").drop("_p")


def pdf_pages(pages: DataFrame, mode: str = "auto", most: int = 1000) -> DataFrame:
    """SRC14, SRC17: pages (id, page, text, ocr_text) of text PDFs joined per document: recognised
    text stands in where the mode is ``ocr``, or ``auto`` and a page has under 20 characters."""
    if mode not in ("auto", "ocr", "text"):
        raise ValueError(f"mode must be auto, ocr or text, not {mode}")
    own = text.trimmed(F.coalesce("text", F.lit("")))
    use = F.lit(mode == "ocr") | (F.lit(mode == "auto") & (F.length(own) < 20))
    chosen = F.when(use, F.coalesce(text.trimmed(F.col("ocr_text")), own)).otherwise(own)
    parts = F.array_sort(F.collect_list(F.struct("page", chosen.alias("t"))))
    kept = F.filter(F.transform(parts, lambda p: p["t"]), lambda t: t != "")
    return pages.where(F.col("page") <= most).groupBy("id").agg(F.array_join(kept, "\n\n").alias("text"), F.count(F.lit(1)).alias("pages"))
