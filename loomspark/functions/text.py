"""Text operators of search and extraction, as Column expressions."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import RESEARCH_SITES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def collapsed(text: Column) -> Column:
    """STR1: white space of any kind as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def search_query(query: Column, categories: Sequence[tuple[str, Sequence[str]]] = (), include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """STR2: site filters OR-ed in parentheses, excluded sites, file type last."""
    sites = []
    for name, own in categories:
        sites += ["github.com"] if name == "github" else list(own or RESEARCH_SITES) if name == "research" else []
    sites += include
    tail = f" ({' OR '.join(f'site:{s}' for s in sites)})" if sites else ""
    tail += "".join(f" -site:{s}" for s in exclude) + (" filetype:pdf" if any(n == "pdf" for n, _ in categories) else "")
    return F.concat(query, F.lit(tail))


def _terms(query: str) -> list[str]:
    return re.findall(r"[^\W_]+", query)


def highlights(text: Column, query: str, most: int = 5, chars: int = 500) -> Column:
    """STR3: passages (parted by blank lines) that hold any term of more than two bytes, in ASCII
    lower case; trimmed, cut, the first few."""
    terms = [t.translate(str.maketrans(_UPPER, _LOWER)) for t in _terms(query) if len(t.encode()) > 2]
    if not terms:
        return F.when(text.isNotNull(), F.array().cast("array<string>"))
    hit = lambda p: F.greatest(F.lit(False), F.lit(False), *[ascii_lower(p).contains(t) for t in terms])
    found = F.transform(F.filter(F.split(text, "\n\n"), hit), lambda p: F.substring(trimmed(p), 1, chars))
    return F.slice(F.filter(found, lambda p: p != ""), 1, most)


def passages(markdown: Column) -> Column:
    """The parts between blank lines, trimmed, without empty ones and headings."""
    return F.filter(F.transform(F.split(markdown, "\n\n"), trimmed), lambda p: (p != "") & ~p.startswith("#"))


def term_overlap(passage: Column, query: str) -> Column:
    """AGG14: how many different terms of three characters or more a passage holds."""
    terms = sorted({t.lower() for t in _terms(query) if len(t) >= 3})
    return sum((F.lower(passage).contains(t).cast("int") for t in terms), F.lit(0))


def best_passage(markdown: Column, query: str, chars: int = 2000) -> Column:
    """STR4, WIN7: the passage with most terms, of equals the last; without passages, all."""
    ranked = F.transform(passages(markdown), lambda p, i: F.struct(term_overlap(p, query).alias("n"), i.alias("i"), p.alias("p")))
    return F.substring(F.coalesce(F.array_max(ranked)["p"], trimmed(markdown)), 1, chars)


def summary(markdown: Column, chars: int = 500) -> Column:
    """STR5: the first passage that isn't a heading, else all."""
    return F.substring(F.coalesce(F.try_element_at(passages(markdown), F.lit(1)), trimmed(markdown)), 1, chars)


def first_email(text: Column) -> Column:
    found = F.filter(F.split(text, r"(?U)\s+"), lambda w: w.contains("@") & w.contains("."))
    return F.regexp_replace(F.try_element_at(found, F.lit(1)), r"(?U)^[^\p{Alnum}@.]+|[^\p{Alnum}@.]+$", "")


def field(name: str, text: Column, title: Column) -> Column:
    """STR6: a title for names that speak of one, an address for emails, else null."""
    name, out = name.lower(), F.lit(None).cast("string")
    if "email" in name:
        out = first_email(text)
    return F.coalesce(title, out) if re.search("title|company|name", name) else out


def schema_fields(schema: dict | str) -> dict[str, str]:
    """STR7: field names with description, else type, else ``string``."""
    schema = json.loads(schema) if isinstance(schema, str) else schema
    inner = schema.get("properties")
    inner = inner if isinstance(inner, dict) else schema
    text = lambda d, k: d.get(k) if isinstance(d, dict) and isinstance(d.get(k), str) else None
    return {k: text(d, "description") or text(d, "type") or "string" for k, d in inner.items()}


def fields(schema: dict | str, text: Column, title: Column) -> Column:
    """STR8: the map of all fields of a schema; null values stay."""
    names = sorted(schema_fields(schema))
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[field(n, text, title) for n in names]))


def lenient_json(content: Column) -> Column:
    """STR11: the whole as JSON, else from the first ``{`` to the last ``}``; else null."""
    return F.coalesce(F.try_parse_json(content), F.try_parse_json(F.nullif(F.regexp_extract(content, r"(?s)(\{.*\})", 1), F.lit(""))))


def scalar_fields(content: Column, names: Sequence[str]) -> Column:
    """STR11 and STR12: the wanted fields of a reply as text; blank is null."""
    v = lenient_json(content)
    one = lambda n: F.nullif(F.trim(F.try_variant_get(v, f"$.{n}", "string")), F.lit(""))
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[one(n) for n in names]))


def hmac_sha256(body: Column, key: bytes | str) -> Column:
    """STR14: ``sha256=`` and the hex digest, with a key known when the plan is made."""
    key = key.encode() if isinstance(key, str) else key
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), body.cast("binary")), 256))
    return F.concat(F.lit("sha256="), F.sha2(F.concat(pad(0x5C), inner), 256))


def owner_key(credential: Column) -> Column:
    """FIL10."""
    return F.sha2(F.coalesce(credential, F.lit("anonymous")), 256)


def source_section(url: Column, markdown: Column) -> Column:
    """One page of STR9."""
    return F.concat(F.lit("# Source: "), url, F.lit("\n\n"), markdown)


def line_diff(before: Column, after: Column) -> Column:
    """SET2: sorted lines that went and that came, under two heads; empty if the texts are equal."""
    lines = lambda c: F.split(F.regexp_replace(c, r"\r?\n$", ""), r"\r?\n")
    a, b = F.when(before == "", F.array().cast("array<string>")).otherwise(lines(before)), F.when(after == "", F.array().cast("array<string>")).otherwise(lines(after))
    mark = lambda x, m: F.transform(F.array_sort(x), lambda s: F.concat(F.lit(m), s))
    return F.when(before == after, F.lit("")).otherwise(F.array_join(F.concat(F.array(F.lit("--- previous"), F.lit("+++ current")), mark(F.array_except(a, b), "-"), mark(F.array_except(b, a), "+")), "\n"))


def decoded_base64(data: Column, most: int = 50 * 1024 * 1024) -> Column:
    """SRC20: base64 or a data URL; null if it is damaged or too large."""
    raw = F.trim(data)
    raw = F.when(raw.startswith("data:"), F.regexp_replace(raw, r"^[^,]*,", "")).otherwise(raw)
    out = F.try_to_binary(raw, F.lit("base64"))
    return F.when(F.octet_length(out) <= most, out)


def rendered_html(markdown: Column) -> Column:
    """HTM22: an escaped paragraph for each line that isn't blank."""
    escape = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    lines = F.filter(F.split(markdown, r"\r?\n"), lambda s: trimmed(s) != "")
    return F.array_join(F.transform(lines, lambda s: F.concat(F.lit("<p>"), escape(s), F.lit("</p>"))), "\n")


def completion_url(base: Column) -> Column:
    """STR18: an endpoint completed to ``/v1/chat/completions``."""
    b = F.regexp_replace(F.trim(base), "/+$", "")
    return F.when(b.endswith("/chat/completions"), b).when(b.endswith("/v1"), F.concat(b, F.lit("/chat/completions"))).otherwise(F.concat(b, F.lit("/v1/chat/completions")))


def blank_collapsed(markdown: Column) -> Column:
    """HTM12: lines trimmed on the right, runs of blank lines as one, ends trimmed."""
    lines = F.regexp_replace(markdown, r"(?U)[\p{Blank}\r]+(?=\n|$)", "")
    return trimmed(F.regexp_replace(lines, r"\n{3,}", "\n\n"))
