"""Search over result tables, document shapes, and the taxonomy of errors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from .validation import FORMATS

# Kind, HTTP status, code, message if it is always the same, whether to try again.
ERRORS = (
    ("invalid_url", 400, "invalid_url", None, False),
    ("blocked", 403, "blocked_by_policy", None, False),
    ("fetch_failed", 502, "fetch_failed", None, True),
    ("render_failed", 502, "render_failed", None, True),
    ("empty_content", 422, "empty_content", "empty_content: No content could be extracted", False),
    ("storage_unavailable", 503, "crawl_storage_unavailable", None, True),
    ("invalid_crawl", 400, "invalid_crawl_request", None, False),
    ("conflict", 409, "idempotency_key_already_used", None, False),
    ("storage_failed", 500, "crawl_storage_failed", None, True),
    ("llm_provider", 400, "unsupported_llm_provider", None, False),
    ("llm_key", 400, "missing_llm_api_key", None, False),
    ("llm_failed", 502, "llm_request_failed", None, True),
    ("llm_response", 502, "llm_response_invalid", None, False),
    ("workflow", 503, "workflow_storage_error", None, True),
    ("unauthorized", 401, "unauthorized", "Invalid web extraction API key", False),
    ("not_found", 404, "crawl_not_found", "Crawl job not found", False),
    # The bodies of these two have another shape, without a code.
    ("invalid_request", 400, "invalid_request", None, False),
    ("internal", 500, "internal_error", None, False),
)


def errors(spark: SparkSession) -> DataFrame:
    """ERR1: a table of a dozen rows."""
    return spark.createDataFrame(list(ERRORS), "kind string, status int, code string, message string, retryable boolean")


def with_error(rows: DataFrame, kind: str = "kind", detail: str | None = None) -> DataFrame:
    """ERR1: rows with status, code, message, retryable and body, the JSON that is sent. ``detail``:
    a column of what happened; it follows the code in the message where that isn't fixed. An unknown
    or null kind is an internal error."""
    e = errors(rows.sparkSession).select(F.col("kind").alias("_kind"), "status", "code", F.col("message").alias("_fixed"), "retryable")
    said = F.coalesce(F.col(detail) if detail else F.lit(None).cast("string"), F.lit(""))
    out = rows.withColumn("_said", said).join(F.broadcast(e), F.col(kind) == F.col("_kind"), "left")
    what = F.coalesce("_kind", F.lit("internal"))
    plain = what.isin("invalid_request", "internal")
    message = F.coalesce("_fixed", F.when(plain, F.col("_said")).when(F.col("_said") == "", F.col("code")).otherwise(F.concat("code", F.lit(": "), "_said")))
    coded = F.to_json(F.struct(F.struct("code", message.alias("message"), "retryable").alias("detail")))
    body = F.when(what == "invalid_request", F.to_json(F.struct(F.lit(False).alias("success"), message.alias("error")))).when(plain, F.to_json(F.struct(message.alias("detail")))).otherwise(coded)
    out = out.withColumns({"message": message, "body": body})
    return out.withColumns({"status": F.coalesce("status", F.lit(500)), "code": F.coalesce("code", F.lit("internal_error")), "retryable": F.coalesce("retryable", F.lit(False))}).drop("_kind", "_fixed", "_said")


def ranked_engines(engines: DataFrame, pool: str = "pool") -> DataFrame:
    """SRC3: engines (pool, ord, url, available_pages; null if it doesn't answer) by free capacity,
    most first, then in the order in which they were declared; ``rank`` from 1."""
    w = Window.partitionBy(pool).orderBy(F.desc(F.coalesce("available_pages", F.lit(0))), "ord")
    named = engines.withColumn("url", F.regexp_replace(F.trim("url"), "/+$", "")).where("url <> ''")
    return named.withColumn("rank", F.row_number().over(w))


def results(found: DataFrame, limit: int, include: Sequence[str] = (), exclude: Sequence[str] = (), categories: Sequence[tuple[str, Sequence[str]]] = (), query: str = "") -> DataFrame:
    """LIM2: found (query_id, ord, url, title, description) cut to the limit of each query first,
    then filtered by domain, so that fewer may remain; with category and highlights."""
    w = Window.partitionBy("query_id").orderBy("ord")
    cut = found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")
    kept = cut.where(urls.domain_allowed(F.col("url"), include, exclude))
    return kept.withColumns({"category": urls.category(F.col("url"), categories), "highlights": text.highlights(F.col("description"), query)})


def reordered(scraped: DataFrame, key: str = "query_id") -> DataFrame:
    """SRT3: the order of the input, whatever the order of arrival."""
    return scraped.orderBy(key, "ord")


#: The least that a section adds to its context: its head, the blank line and the rule.
_LEAST_SECTION = len("# Source: ") + 2 + len("\n\n---\n\n")


def concatenated(pages: DataFrame, key: str, order: str = "ord", chars: int = 24_000) -> DataFrame:
    """STR10 over STR9: sections of each key in order (null first), parted by rules, cut to so many
    characters. As a section has ``_LEAST_SECTION`` characters at least, only the first rows of a key
    can reach the result; they are picked before the shuffle, so a key may be of any size.
    ``sections`` gives all, uncut."""
    section = F.substring(text.source_section(F.col("url"), F.col("markdown")), 1, chars)
    rows = pages.select(key, order, section.alias("t")).where(F.col("t").isNotNull())
    w = Window.partitionBy(key).orderBy(order, "t")
    rows = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= chars // _LEAST_SECTION + 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "t"))), lambda p: p["t"]), "\n\n---\n\n")
    return rows.groupBy(key).agg(F.substring(joined, 1, chars).alias("context"))


def sections(pages: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """STR9 for keys of any size: (key, order, tie, section), a row per page and nothing cut. The
    sections of a key in order of ``order`` (null last) and ``tie``, put together as they are, give
    its context: all but the first begin with the rule. The join is by key, with a table of one row
    a key: adaptive execution broadcasts it if it is small, else splits hot keys."""
    rows = pages.select(key, order, text.source_section(F.col("url"), F.col("markdown")).alias("section")).where(F.col("section").isNotNull())
    rows = rows.withColumn("tie", F.row_number().over(Window.partitionBy(key, order).orderBy("section")))
    least = rows.groupBy(F.col(key).alias("_k")).agg(F.min(order).alias("_first"))
    joined = rows.join(least, F.col(key).eqNullSafe(F.col("_k")))
    first = F.col(order).eqNullSafe(F.col("_first")) & (F.col("tie") == 1)
    return joined.select(key, order, "tie", F.when(first, F.col("section")).otherwise(F.concat(F.lit("\n\n---\n\n"), "section")).alias("section"))


#: JSN2: fields of a document and of its metadata, each with the name it has outside.
DOCUMENT = (("markdown", "markdown"), ("html", "html"), ("raw_html", "rawHtml"), ("links", "links"), ("screenshot", "screenshot"), ("actions", "actions"))
METADATA = (("title", "title"), ("language", "language"), ("url", "sourceURL"), ("final_url", "url"), ("status_code", "statusCode"), ("request_id", "scrapeId"), ("engine", "engine"), ("engine_outcomes", "engineOutcomes"), ("fallback_reason", "fallbackReason"), ("proxy_used", "proxyUsed"))


def _json(*columns: Column) -> Column:
    """An object with all its fields, null ones too."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def document(fields: Mapping[str, Column]) -> Column:
    """JSN2: the JSON envelope of a page; fields that aren't given are null."""
    if unknown := set(fields) - {n for n, _ in (*DOCUMENT, *METADATA)}:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    of = lambda names: [fields.get(n, F.lit(None).cast("string")).alias(out) for n, out in names]
    return _json(*of(DOCUMENT), F.struct(*of(METADATA)).alias("metadata"))


def search_document(url: Column, title: Column, description: Column, markdown: Column, highlights: Column, category: Column, final_url: Column) -> Column:
    """JSN5: with Markdown and metadata where the page was scraped, else the result's fields alone."""
    own = [url.alias("url"), title.alias("title"), description.alias("description")]
    meta = F.struct(title.alias("title"), description.alias("description"), url.alias("sourceURL"), final_url.alias("url"), category.alias("category"))
    full = _json(*own, markdown.alias("markdown"), highlights.alias("highlights"), meta.alias("metadata"))
    return F.when(markdown.isNull(), _json(*own, highlights.alias("highlights"), category.alias("category"))).otherwise(full)


def actions(results: Column, screenshots: Column, scrapes: Column) -> Column:
    """JSN4: results (JSON array of {type, result}) with those of scripts (``result.return``) and
    of prints (``result.data``) apart, order kept; what has no such value is left out."""
    list_ = lambda c: F.coalesce(F.try_variant_get(F.try_parse_json(c), "$", "array<variant>"), F.array().cast("array<variant>"))
    of = lambda kind, path: F.filter(F.transform(F.filter(list_(results), lambda o: F.try_variant_get(o, "$.type", "string") == kind), lambda o: F.try_variant_get(o, f"$.result.{path}", "variant")), lambda v: v.isNotNull())
    none = F.array().cast("array<string>")
    return _json(
        F.coalesce(screenshots, none).alias("screenshots"),
        list_(scrapes).alias("scrapes"),
        of("executeJavascript", "return").alias("javascriptReturns"),
        of("pdf", "data").alias("pdfs"),
        list_(results).alias("results"),
    )


def data_url(screenshot: Column) -> Column:
    """HTM21: as a data URL, unless it is one."""
    return F.when(screenshot.startswith("data:"), screenshot).otherwise(F.concat(F.lit("data:image/png;base64,"), screenshot))


def formats(pages: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """FIL1, FIL2, STR17: one nullable column for each wanted format that ``pages`` has; names
    without regard to case, ``raw_html`` for ``rawHtml``; unknown names are errors."""
    known = {f.lower(): f for f in FORMATS} | {"raw_html": "rawHtml"}
    if unknown := [f for f in wanted if f.lower() not in known]:
        raise ValueError(f"unknown formats: {unknown}")
    names = dict.fromkeys(known[f.lower()] for f in wanted)
    have = {c.lower(): c for c in pages.columns}
    return pages.select("url", *[F.col(have[n.lower()]).alias(n) if n.lower() in have else F.lit(None).cast("string").alias(n) for n in names])


def enriched(pages: DataFrame, wanted: Sequence[str], query: str = "", schema: dict | str | None = None, selectors: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """HTM23: formats added in the order asked for over pages (url, html, markdown, title); html
    is used for images and attributes and goes unless ``rawHtml`` is asked for."""
    from ..functions import html

    out = pages
    for f in wanted:
        if f == "images":
            out = html.extracted(out, ["images"])
        elif f == "summary":
            out = out.withColumn("summary", text.summary(F.col("markdown")))
        elif f == "attributes":
            names = F.array(*[F.struct(F.lit(c).alias("selector"), F.lit(a).alias("attribute")) for c, a in selectors])
            out = out.withColumn("_values", html.attribute_values(F.col("html"), selectors))
            out = out.withColumn("attributes", F.zip_with(names, F.col("_values"), lambda n, v: F.struct(n["selector"].alias("selector"), n["attribute"].alias("attribute"), v.alias("values")))).drop("_values")
        elif f in ("answer", "question"):
            out = out.withColumn(f, text.best_passage(F.col("markdown"), query))
        elif f == "highlights":
            out = out.withColumn("highlights", text.highlights(F.col("markdown"), query))
        elif f in ("json", "deterministicJson"):
            out = out.withColumn(f, text.fields(schema or {}, F.col("markdown"), F.col("title")))
        elif f != "rawHtml":
            raise ValueError(f"unknown format: {f}")
    return out.withColumnRenamed("html", "rawHtml") if "rawHtml" in wanted else out.drop("html")
