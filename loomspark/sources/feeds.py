"""Sitemaps, news feeds and search results, from their payloads as text columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dom, html, selectors, text, urls
from ..operators.tables import checkpointed


def sitemap_locations(body: Column, limit: int) -> Column:
    """SRC7: what stands between ``<loc>`` and ``</loc>``, decoded; an index isn't followed."""
    found = F.slice(F.regexp_extract_all(body, F.lit(r"(?s)<loc>(.*?)(?:</loc>|(?=<loc>)|$)"), 1), 1, limit)
    joined = html.unescaped(F.array_join(found, "\x1e"))
    return F.when(F.size(found) > 0, F.split(joined, "\x1e")).otherwise(F.array().cast("array<string>"))


def news(feeds: DataFrame, limit: int, body: str = "payload") -> DataFrame:
    """SRC9: feeds exploded to ord, title, url, description; items without title or link go."""
    item = r"(?s)<item[ >].*?</item>"
    tag = lambda x, name: F.nullif(F.regexp_extract(x, rf"(?s)<{name}(?:\s[^>]*)?>(?:\s*<!\[CDATA\[)?(.*?)(?:\]\]>\s*)?</{name}>", 1), F.lit(""))
    items = F.transform(F.regexp_extract_all(F.col(body), F.lit(item), 0), lambda x: F.struct(tag(x, "title").alias("title"), tag(x, "link").alias("url"), F.coalesce(tag(x, "description"), F.lit("")).alias("description")))
    kept = F.slice(F.filter(items, lambda x: x["title"].isNotNull() & x["url"].isNotNull()), 1, limit)
    out = feeds.select("*", F.posexplode(kept).alias("ord", "_x")).select("*", html.unescaped(F.col("_x.title")).alias("title"), html.unescaped(F.col("_x.url")).alias("url"), text.collapsed(html.unescaped(F.col("_x.description"))).alias("description"))
    return out.drop("_x")


def json_results(replies: DataFrame, limit: int, body: str = "payload") -> DataFrame:
    """SRC13: replies ``{"results": [...]}`` exploded to ord, url, title, description."""
    kind = "struct<results: array<struct<url: string, title: string, content: string>>>"
    kept = F.slice(F.filter(F.from_json(body, kind)["results"], lambda x: x["url"].isNotNull()), 1, limit)
    return replies.select("*", F.posexplode(kept).alias("ord", "_x")).select("*", "_x.url", F.coalesce("_x.title", F.lit("")).alias("title"), F.coalesce("_x.content", F.lit("")).alias("description")).drop("_x")


def image_results(body: Column) -> Column:
    """SRC10: array of (url, title, page) from the JSON in ``m`` of ``a.iusc``; needs ``murl``."""
    kind = "struct<murl: string, t: string, purl: string>"
    rows = F.transform(html.selected(body, "a.iusc", "m"), lambda m: F.from_json(m, kind))
    rows = F.filter(rows, lambda x: x["murl"].isNotNull())
    return F.transform(rows, lambda x: F.struct(x["murl"].alias("url"), x["t"].alias("title"), x["purl"].alias("page")))


def web_results(pages: DataFrame, limit: int, body: str = "payload") -> DataFrame:
    """SRC11, SRC12: ``.result`` boxes exploded to ord, url (unwrapped), title, description."""
    kind = pa.list_(pa.struct([("href", pa.string()), ("title", pa.string()), ("description", pa.string())]))

    @F.arrow_udf("array<struct<href: string, title: string, description: string>>")
    def boxes(bodies: pa.Array) -> pa.Array:
        out = []
        for page in bodies.to_pylist():
            rows = []
            for box in selectors.select(dom.parse(page or ""), ".result"):
                link = next(iter(selectors.select(box, ".result__a")), None)
                if link is None or "href" not in link.attrs:
                    continue
                note = next(iter(selectors.select(box, ".result__snippet")), None)
                rows.append({"href": link.attrs["href"], "title": dom.text_of(link), "description": dom.text_of(note) if note is not None else ""})
                if len(rows) == limit:
                    break
            out.append(rows)
        return pa.array(out, kind)

    return pages.select("*", F.posexplode(boxes(F.col(body))).alias("ord", "_x")).select("*", urls.unwrapped(F.col("_x.href")).alias("url"), "_x.title", "_x.description").drop("_x")


def _joined(base: Column, link: Column) -> Column:
    @F.arrow_udf("string")
    def run(bases: pa.Array, links: pa.Array) -> pa.Array:
        return pa.array([dom.join(b or "", x or "") for b, x in zip(bases.to_pylist(), links.to_pylist(), strict=True)], pa.string())

    # Not deterministic, so that it stays a column of its own: it can't stand in a lambda.
    return run.asNondeterministic()(base, link)


def fetched(pages: DataFrame, wanted: DataFrame, hops: int = 10) -> DataFrame:
    """SRC1 without a network: ``wanted`` (url) with final_url, status, html, error and message, from
    a table of what the servers say: pages (url, status, location, html; the last three may be
    missing or null). Redirects (3xx with a location) are followed, ``hops`` of them at most, and each
    target is admitted anew; another status than 2xx, or no such page, is ``fetch_failed``.
    """
    have = lambda c, d: F.coalesce(F.col(c), d) if c in pages.columns else d
    none = F.lit(None).cast("string")
    said = pages.select(F.col("url").alias("_at"), have("status", F.lit(200)).alias("_status"), have("location", none).alias("_location"), have("html", none).alias("_html")).dropDuplicates(["_at"])
    start = wanted.select("url").distinct().withColumn("_a", urls.admitted(F.col("url")))
    at = start.select("url", F.col("_a.url").alias("_at"), F.col("_a.error").alias("error"), F.col("_a.message").alias("message"))
    done = None
    for hop in range(hops + 1):
        met = at.where("error is null").join(said, "_at", "left")
        moved = (F.col("_status").between(300, 399)) & F.col("_location").isNotNull()
        ended = met.where(~F.coalesce(moved, F.lit(False)) | F.lit(hop == hops))
        fine = F.coalesce(F.col("_status").between(200, 299), F.lit(False))
        why = F.when(F.col("_status").isNull(), F.lit("no such page")).when(moved, F.lit("too many redirects")).otherwise(F.concat(F.lit("HTTP "), F.col("_status").cast("string")))
        ended = ended.select("url", F.col("_at").alias("final_url"), F.col("_status").alias("status"), F.when(fine, F.col("_html")).alias("html"), F.when(~fine, F.lit("fetch_failed")).alias("error"), F.when(~fine, why).alias("message"))
        refused = at.where("error is not null").select("url", F.col("_at").alias("final_url"), F.lit(None).cast("int").alias("status"), none.alias("html"), "error", "message")
        done = ended.unionByName(refused) if done is None else done.unionByName(ended).unionByName(refused)
        if hop == hops:
            break
        further = met.where(moved).withColumn("_to", _joined(F.col("_at"), F.col("_location"))).withColumn("_a", urls.admitted(F.col("_to")))
        at = checkpointed(further.select("url", F.coalesce("_a.url", "_at").alias("_at"), F.col("_a.error").alias("error"), F.col("_a.message").alias("message")))
        if at.isEmpty():
            break
    return done


def webhook(events: DataFrame, key: str, names: tuple[str, ...] = ("started", "page", "completed", "failed")) -> DataFrame:
    """SNK1: events (id, type, webhook_id, success, data, error) of the configured names, with the
    body to send and its signature; sending is left to a sink."""
    body = F.to_json(F.struct("success", "type", "id", F.col("webhook_id").alias("webhookId"), "data", "error"))
    out = events.where(F.col("type").isin(*names)).withColumn("body", body)
    return out.withColumn("signature", text.hmac_sha256(F.col("body"), key))


def report(results: DataFrame, folder: str, order: list[str] | None = None) -> None:
    """SNK2: rows as JSON lines (samples) and as a Markdown table (summary), each a folder of part
    files whose names are in the order of the lines: head, rule, then the rows by ``order`` (all
    columns by default); and the table's columns and number of rows as JSON (report)."""
    order = order or results.columns
    results.write.mode("overwrite").json(f"{folder}/samples")
    head = "| " + " | ".join(results.columns) + " |\n| " + " | ".join("---" for _ in results.columns) + " |"
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in results.columns]), F.lit(" |"))
    keys = F.struct(*[F.col(c) for c in order])
    lines = results.select(keys.alias("k"), row.alias("value"))
    first = results.sparkSession.createDataFrame([(head,)], "value string").select(F.lit(None).cast(lines.schema["k"].dataType).alias("k"), "value")
    # Nulls first, so that the head leads; parts are ranges of the order.
    first.unionByName(lines).orderBy(F.asc_nulls_first("k")).select("value").write.mode("overwrite").text(f"{folder}/summary")
    results.agg(F.count(F.lit(1)).alias("rows"), F.lit(",".join(results.columns)).alias("columns")).write.mode("overwrite").json(f"{folder}/report")
