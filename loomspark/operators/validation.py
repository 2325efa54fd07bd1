"""Admission rules as columns: what is wrong with a row's options, formats, actions or webhook.

Each function gives an array of strings, empty if nothing is wrong; rules that end at the first
mistake give it alone. A null option is one that wasn't given.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import admitted, host, public_ip, scheme

# Names, ranges and messages of the outer interface.
FORMATS = ("markdown", "html", "rawHtml", "links", "screenshot", "images", "summary", "attributes", "question", "highlights", "json", "deterministicJson")
FORMAT_OPTIONS = {"attributes": ("selectors",), "question": ("question",), "highlights": ("query",), "screenshot": ("fullPage", "quality", "viewport")}
PROXIES = ("auto", "basic", "stealth", "enhanced")
SITEMAPS = ("skip", "include", "only")
EVENTS = ("started", "page", "completed", "failed")
PDF_SIZES = ("Letter", "Legal", "Tabloid", "A0", "A1", "A2", "A3", "A4", "A5")
UPLOADS = ("html", "htm", "xhtml", "pdf", "doc", "docx", "odt", "rtf", "xls", "xlsx")
MOST_ACTIONS, SELECTOR_BYTES, KEY_BYTES, PAYLOAD_BYTES = 50, 4_096, 128, 262_144
TIMEOUT_MS, WIDTH, HEIGHT, UPLOAD_BYTES = (1_000, 300_000), 7_680, 4_320, 50 * 1024 * 1024
_HYPHENED = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
UUID = rf"^(?:(?:urn:uuid:)?{_HYPHENED}|\{{{_HYPHENED}\}}|[0-9a-fA-F]{{32}})$"


def problems(*checks: tuple[Column, str]) -> Column:
    """Names of the checks that are true or can't be told."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for bad, name in checks]))


def _first(*rules: tuple[Column, str]) -> Column:
    """The message of the first rule that is broken, null if none is."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(message)) for bad, message in rules], F.lit(None).cast("string"))


def _blank(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s", "") == ""


#: FIL15: what makes an option's value wrong.
_RULES = {
    "wait_ms": lambda c: ~c.between(0, 60_000),
    "delay": lambda c: ~((c > 0) & (c <= 60)) | F.isnan(c.cast("double")),
    "max_concurrency": lambda c: ~c.between(1, (1 << 31) - 1),
    "idempotency_key": lambda c: ~c.rlike(UUID),
    "proxy": lambda c: ~c.isin(*PROXIES),
    "sitemap": lambda c: ~c.isin(*SITEMAPS),
    "timeout": lambda c: ~c.between(*TIMEOUT_MS),
    # Values that aren't supported.
    "remove_base64_images": lambda c: ~c,
    "fast_mode": lambda c: c,
    "block_ads": lambda c: ~c,
    "store_in_cache": lambda c: ~c,
    "mobile": lambda c: c,
    "max_age": lambda c: c != 14_400_000,
    "zero_data_retention": lambda c: c,
}


def scrape_problems(options: Mapping[str, Column]) -> Column:
    """FIL15: names of the options that are given and wrong, in the order given here."""
    if unknown := set(options) - set(_RULES):
        raise ValueError(f"unknown options: {sorted(unknown)}")
    return problems(*[(c.isNotNull() & _RULES[k](c), k) for k, c in options.items()])


ACTION = "struct<type: string, milliseconds: bigint, selector: string, text: string, script: string, quality: bigint, viewport: struct<width: bigint, height: bigint>, key: string, direction: string, format: string>"


def action_problem(actions: Column, timeout_ms: Column, initial_wait_ms: Column) -> Column:
    """FIL15 for browser actions, a JSON array: the first mistake, null if there is none. A wait
    without time and selector is one of a second; all waits must fit the timeout, and scripts and
    texts together a number of bytes."""
    parsed = F.coalesce(F.from_json(actions, f"array<{ACTION}>"), F.array().cast(f"array<{ACTION}>"))
    size = lambda c: F.octet_length(c)

    def mistake(a: Column) -> Column:
        of = lambda kind: a["type"] == kind
        view = a["viewport"]
        return _first(
            (of("wait") & a["milliseconds"].isNotNull() & a["selector"].isNotNull(), "wait action requires exactly one of milliseconds or selector"),
            (of("wait") & (size(a["selector"]) > SELECTOR_BYTES), "action selector exceeds 4096 bytes"),
            (of("click") & ~F.coalesce(size(a["selector"]).between(1, SELECTOR_BYTES), F.lit(False)), "click selector must contain 1 to 4096 bytes"),
            (of("screenshot") & ~a["quality"].between(1, 100), "screenshot quality must be between 1 and 100"),
            (of("screenshot") & view.isNotNull() & ~F.coalesce(view["width"].between(1, WIDTH) & view["height"].between(1, HEIGHT), F.lit(False)), "screenshot viewport exceeds 7680x4320"),
            (of("press") & ~F.coalesce(size(a["key"]).between(1, KEY_BYTES), F.lit(False)), "press key must contain 1 to 128 bytes"),
            (of("scroll") & ~F.coalesce(a["direction"].isin("up", "down"), F.lit(False)), "scroll direction must be up or down"),
            (of("pdf") & ~a["format"].isin(*PDF_SIZES), "pdf format is not supported"),
        )

    def judged(list_: Column) -> Column:
        waits = F.aggregate(list_, F.coalesce(initial_wait_ms, F.lit(0)).cast("bigint"), lambda n, a: n + F.when(a["type"] == "wait", F.coalesce(a["milliseconds"], F.when(a["selector"].isNull(), F.lit(1_000)).otherwise(F.lit(0)))).otherwise(F.lit(0)))
        payload = F.aggregate(list_, F.lit(0).cast("bigint"), lambda n, a: n + F.when(a["type"] == "write", F.coalesce(size(a["text"]), F.lit(0))).when(a["type"] == "executeJavascript", F.coalesce(size(a["script"]), F.lit(0))).otherwise(F.lit(0)))
        own = F.try_element_at(F.array_compact(F.transform(list_, mistake)), F.lit(1))
        before = _first((F.size(list_) > MOST_ACTIONS, "actions must contain at most 50 entries"), (~timeout_ms.between(*TIMEOUT_MS), "timeout must be between 1000 and 300000 milliseconds"))
        after = _first((waits > timeout_ms, "action waits exceed the request timeout"), (payload > PAYLOAD_BYTES, "action script and text payloads exceed 262144 bytes"))
        return F.coalesce(before, own, after)

    return F.element_at(F.transform(F.array(parsed), judged), 1)


def format_options(formats: Sequence[str | Mapping]) -> list[tuple[str, dict]]:
    """FIL2, STR17: (name, options) of the formats of one request, names as they are written;
    what isn't allowed raises ValueError when the plan is made."""
    out: list[tuple[str, dict]] = []
    for f in formats:
        if isinstance(f, str):
            name, options = f, {}
        elif isinstance(f, Mapping) and isinstance(f.get("type"), str):
            name, options = f["type"], {k: v for k, v in f.items() if k != "type"}
        else:
            raise ValueError("format must be a string or an object containing type")
        if name not in FORMATS:
            raise ValueError(f"format '{name}' is not supported")
        if name in FORMAT_OPTIONS and (unknown := [k for k in options if k not in FORMAT_OPTIONS[name]]):
            raise ValueError(f"Unsupported {name} options: {', '.join(unknown)}")
        needed = {"question": "question", "highlights": "query"}.get(name)
        if needed and not (isinstance(options.get(needed), str) and options[needed].strip()):
            raise ValueError(f"{name}.{needed} must be a text that isn't blank")
        if name == "attributes":
            rows = options.get("selectors")
            if not isinstance(rows, list) or not rows or not all(isinstance(r, Mapping) and isinstance(r.get("selector"), str) and isinstance(r.get("attribute"), str) for r in rows):
                raise ValueError("attributes.selectors must be a list of objects with selector and attribute")
        if name == "screenshot":
            _screenshot(options)
        out.append((name, options))
    if sum(name == "screenshot" for name, _ in out) > 1:
        raise ValueError("Only one screenshot format may be requested")
    return out


def _screenshot(options: Mapping) -> None:
    whole = lambda v, top: isinstance(v, int) and not isinstance(v, bool) and 1 <= v <= top
    if "fullPage" in options and not isinstance(options["fullPage"], bool):
        raise ValueError("screenshot.fullPage must be a boolean")
    if "quality" in options and not whole(options["quality"], 100):
        raise ValueError("screenshot.quality must be between 1 and 100")
    view = options.get("viewport")
    if "viewport" in options and not (isinstance(view, Mapping) and whole(view.get("width"), WIDTH) and whole(view.get("height"), HEIGHT)):
        raise ValueError("screenshot.viewport must contain width 1..7680 and height 1..4320")


def format_problem(formats: Column) -> Column:
    """FIL2 for a table of requests: ``formats`` as JSON arrays; the first mistake, null if there
    is none. Checked name by name as ``format_options`` does, in batches."""
    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        out = []
        for text in lists.to_pylist():
            try:
                format_options(json.loads(text) if text else [])
                out.append(None)
            except ValueError as e:
                out.append("formats aren't JSON" if isinstance(e, json.JSONDecodeError) else str(e))
        return pa.array(out, pa.string())

    return run(formats)


def webhook_problem(url: Column, headers: Column, events: Column) -> Column:
    """MON4, CRW1: a webhook's URL (http or https), header names (map) and events (array)."""
    named = F.exists(F.coalesce(F.map_keys(headers), F.array().cast("array<string>")), lambda k: F.lower(k).endswith("-signature") & F.lower(k).startswith("x-"))
    wrong = F.filter(F.coalesce(events, F.array().cast("array<string>")), lambda e: ~e.isin(*EVENTS))
    return F.when(
        url.isNotNull(),
        F.coalesce(
            F.when(~F.coalesce(scheme(url).isin("http", "https") & host(url).isNotNull(), F.lit(False)), F.lit("webhook URL must use http or https")),
            F.when(named, F.lit("the signature header cannot be supplied by the caller")),
            F.when(F.size(wrong) > 0, F.concat(F.lit("unsupported webhook event: "), F.try_element_at(wrong, F.lit(1)))),
        ),
    )


def monitor_problems(name: Column, schedule_seconds: Column, url: Column, webhook: Column | None = None) -> Column:
    """MON4: name (not blank, 200 bytes at most), schedule, URL, and what ``webhook_problem`` said."""
    return problems(
        (_blank(name) | (F.octet_length(name) > 200), "name"),
        (~schedule_seconds.between(60, 31_536_000), "schedule"),
        (admitted(url)["error"].isNotNull(), "url"),
        (webhook.isNotNull() if webhook is not None else F.lit(False), "webhook"),
    )


def agent_problems(prompt: Column, urls: Column, credits: Column) -> Column:
    """AGT3: prompt (not blank, 20,000 bytes at most), at most 100 URLs, credits that cover them,
    and every URL admitted. No URLs (null) are none."""
    sources = F.coalesce(urls, F.array().cast("array<string>"))
    refused = F.exists(sources, lambda u: admitted(u)["error"].isNotNull())
    return problems(
        (_blank(prompt) | (F.octet_length(prompt) > 20_000), "prompt"),
        (F.size(sources) > 100, "urls"),
        (~credits.between(1, 100) | (credits < F.size(sources)), "credits"),
        (refused, "source"),
    )


def resolved(wanted: DataFrame, addresses: DataFrame) -> DataFrame:
    """FIL14 with a table in the place of a resolver: ``wanted`` (url) with error and message, given
    addresses (host, address; what has no address at all failed to resolve). Every address of a
    host must be public."""
    of = addresses.groupBy(F.lower("host").alias("_host")).agg(F.count("address").alias("_n"), F.bool_and(F.coalesce(public_ip(F.col("address")), F.lit(False))).alias("_public"))
    met = wanted.withColumn("_host", host(F.col("url"))).join(of, "_host", "left")
    h = F.col("_host")
    error = (
        F.when(h.isNull(), F.lit("invalid_url"))
        .when((h == "localhost") | h.endswith(".localhost"), F.lit("blocked_by_policy"))
        .when(F.col("_n").isNull(), F.lit("fetch_failed"))
        .when((F.col("_n") == 0) | ~F.col("_public"), F.lit("blocked_by_policy"))
    )
    message = (
        F.when(h.isNull(), F.lit("URL host is required"))
        .when((h == "localhost") | h.endswith(".localhost"), F.lit("Localhost URLs are not allowed"))
        .when(F.col("_n").isNull(), F.lit("DNS resolution failed"))
        .when((F.col("_n") == 0) | ~F.col("_public"), F.lit("DNS resolved to a private, reserved, or local network"))
    )
    return met.withColumns({"error": error, "message": message}).drop("_host", "_n", "_public")


def upload_problem(filename: Column, size: Column) -> Column:
    """SRC21: a file name without folders and of a known kind, and a size declared within bounds."""
    kind = F.lower(F.regexp_extract(filename, r"[^.]\.([^./\\]*)$", 1))
    return F.coalesce(
        F.when(F.coalesce(F.octet_length(filename) > 512, F.lit(True)) | filename.rlike(r"[/\\]"), F.lit("Invalid upload filename")),
        F.when(~size.between(1, UPLOAD_BYTES), F.lit("declaredSizeBytes must be between 1 and 52428800")),
        F.when(~kind.isin(*UPLOADS), F.lit("Unsupported upload type")),
    )
