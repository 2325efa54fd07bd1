"""Queries of admission rules, errors, response shapes, uploads and owners."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import evaluation, models, search, validation, workflows
from ..operators import jobs as J
from ..operators.tables import shared_folder
from ..sources import feeds
from . import query, table
from .jobs import NOW_SQL, _now


def _nth(n, *values):
    """The value at n, from 0, as a literal list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


#: What each kind of error is sent as, written out: the query is judged by it.
ERRORS_SQL = """('invalid_url', 400, 'invalid_url', NULL, false), ('blocked', 403, 'blocked_by_policy', NULL, false), ('fetch_failed', 502, 'fetch_failed', NULL, true), ('render_failed', 502, 'render_failed', NULL, true),
 ('empty_content', 422, 'empty_content', 'empty_content: No content could be extracted', false), ('storage_unavailable', 503, 'crawl_storage_unavailable', NULL, true), ('invalid_crawl', 400, 'invalid_crawl_request', NULL, false), ('conflict', 409, 'idempotency_key_already_used', NULL, false),
 ('storage_failed', 500, 'crawl_storage_failed', NULL, true), ('llm_provider', 400, 'unsupported_llm_provider', NULL, false), ('llm_key', 400, 'missing_llm_api_key', NULL, false), ('llm_failed', 502, 'llm_request_failed', NULL, true), ('llm_response', 502, 'llm_response_invalid', NULL, false),
 ('workflow', 503, 'workflow_storage_error', NULL, true), ('unauthorized', 401, 'unauthorized', 'Invalid web extraction API key', false), ('not_found', 404, 'crawl_not_found', 'Crawl job not found', false), ('invalid_request', 400, 'invalid_request', NULL, false), ('internal', 500, 'internal_error', NULL, false)"""
KINDS = "invalid_url blocked fetch_failed render_failed empty_content storage_unavailable invalid_crawl conflict storage_failed llm_provider llm_key llm_failed llm_response workflow unauthorized not_found invalid_request internal".split() + ["something else"]


@query(
    "err1_responses",
    f"""WITH e(kind, status, code, fixed, retryable) AS (VALUES {ERRORS_SQL}),
r AS (SELECT event_id, {_list(KINDS)}[event_id % {len(KINDS)} + 1] AS kind, CASE WHEN event_id % 5 > 0 THEN event_type ELSE '' END AS said FROM events),
m AS (SELECT r.*, coalesce(status, 500) AS status, coalesce(code, 'internal_error') AS code, coalesce(retryable, false) AS retryable, coalesce(fixed, CASE WHEN coalesce(code, 'internal_error') IN ('invalid_request', 'internal_error') THEN said WHEN said = '' THEN code ELSE code || ': ' || said END) AS message FROM r LEFT JOIN e USING (kind))
SELECT event_id, status, code, message, retryable, CASE WHEN code NOT IN ('invalid_request', 'internal_error') THEN '{{"detail":{{"code":"' || code || '","message":"' || message || '","retryable":' || retryable || '}}}}'
 WHEN kind = 'invalid_request' THEN '{{"success":false,"error":"' || message || '"}}' ELSE '{{"detail":"' || message || '"}}' END AS body FROM m""",
)
def err1_responses(spark, sf_dir):
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(n, _nth(n, *KINDS).alias("kind"), F.when(n % 5 > 0, F.col("event_type")).otherwise(F.lit("")).alias("what"))
    return search.with_error(rows, detail="what").select("event_id", "status", "code", "message", "retryable", "body")


@query(
    "fil15_options",
    """SELECT event_id, array_to_string(list_filter([
 CASE WHEN event_id % 100 = 0 OR event_id * 1000 > 2147483647 THEN 'max_concurrency' END, CASE WHEN event_id % 6 IN (4, 5) THEN 'proxy' END, CASE WHEN event_id % 4 = 3 THEN 'sitemap' END, CASE WHEN event_id % 7 * 60000 < 1000 OR event_id % 7 * 60000 > 300000 THEN 'timeout' END,
 CASE WHEN event_id % 3 = 0 THEN 'idempotency_key' END, CASE WHEN event_id % 2 = 0 THEN 'remove_base64_images' END, CASE WHEN event_id % 2 = 1 THEN 'fast_mode' END, CASE WHEN event_id % 5 = 0 THEN 'max_age' END, CASE WHEN event_id % 11 = 0 THEN 'mobile' END], lambda x: x IS NOT NULL), ',') AS problems FROM events""",
)
def fil15_options(spark, sf_dir):
    n = F.col("event_id")
    key = F.when(n % 3 == 0, F.lit("7c9e6679-7425-40de944be07fc1f90ae7")).when(n % 3 == 1, F.lit("7c9e6679-7425-40de-944b-e07fc1f90ae7")).otherwise(F.lit("7c9e6679742540de944be07fc1f90ae7"))
    options = {
        "max_concurrency": F.when(n % 100 == 0, F.lit(0)).otherwise(n * 1000),
        "proxy": _nth(n, "auto", "basic", "stealth", "enhanced", "http://proxy:1", "AUTO"),
        "sitemap": _nth(n, "skip", "include", "only", "all"),
        "timeout": n % 7 * 60_000,
        "idempotency_key": key,
        "remove_base64_images": n % 2 == 1,
        "fast_mode": n % 2 == 1,
        "max_age": F.when(n % 5 == 0, F.lit(1)).when(n % 5 == 1, F.lit(14_400_000)),
        "mobile": F.when(n % 11 == 0, F.lit(True)),
    }
    return table(spark, sf_dir, "events").select(n, F.array_join(validation.scrape_problems(options), ",").alias("problems"))


#: An action list and what is wrong with it, with a timeout of 10 s and a wait of 1 s before.
ACTIONS = (
    ('[{"type":"click","selector":"a"},{"type":"scroll","direction":"up"},{"type":"pdf"},{"type":"press","key":"Enter"}]', None),
    ('[{"type":"wait","milliseconds":5,"selector":"a"}]', "wait action requires exactly one of milliseconds or selector"),
    ('[{"type":"wait"},{"type":"click","selector":""}]', "click selector must contain 1 to 4096 bytes"),
    ('[{"type":"screenshot","quality":0}]', "screenshot quality must be between 1 and 100"),
    ('[{"type":"screenshot","viewport":{"width":7681,"height":1}}]', "screenshot viewport exceeds 7680x4320"),
    ('[{"type":"press","key":""},{"type":"scroll","direction":"left"}]', "press key must contain 1 to 128 bytes"),
    ('[{"type":"scroll","direction":"left"}]', "scroll direction must be up or down"),
    ('[{"type":"pdf","format":"a4"}]', "pdf format is not supported"),
    ('[{"type":"wait","milliseconds":8000},{"type":"wait"}]', None),
    ('[{"type":"wait","milliseconds":8000},{"type":"wait"},{"type":"wait","milliseconds":1}]', "action waits exceed the request timeout"),
    ('[{"type":"write","text":"' + "x" * 200_000 + '"},{"type":"executeJavascript","script":"' + "y" * 62_145 + '"}]', "action script and text payloads exceed 262144 bytes"),
    ("[" + ",".join(['{"type":"scrape"}'] * 51) + "]", "actions must contain at most 50 entries"),
    ('[{"type":"wait","selector":"' + "s" * 4_097 + '"}]', "action selector exceeds 4096 bytes"),
)


@query("fil15_actions", f"SELECT n_nationkey, CASE WHEN n_nationkey = 22 THEN 'timeout must be between 1000 and 300000 milliseconds' ELSE {_list([said for _, said in ACTIONS])}[n_nationkey % {len(ACTIONS)} + 1] END AS problem FROM nation")
def fil15_actions(spark, sf_dir):
    n = F.col("n_nationkey")
    timeout = F.when(n == 22, F.lit(999)).otherwise(F.lit(10_000))
    return table(spark, sf_dir, "nation").select(n, validation.action_problem(_nth(n, *[a for a, _ in ACTIONS]), timeout, F.lit(1_000)).alias("problem"))


FORMAT_LISTS = (
    ('["markdown", {"type": "screenshot", "fullPage": true, "quality": 80, "viewport": {"width": 800, "height": 600}}]', None),
    ('["Markdown"]', "format 'Markdown' is not supported"),
    ('[{"type": "question"}]', "question.question must be a text that isn''t blank"),
    ('[{"type": "highlights", "query": "x", "n": 1}]', "Unsupported highlights options: n"),
    ('["screenshot", "screenshot"]', "Only one screenshot format may be requested"),
    ('[{"type": "screenshot", "quality": 101}]', "screenshot.quality must be between 1 and 100"),
    ("[5]", "format must be a string or an object containing type"),
    ('[{"type": "attributes", "selectors": [{"selector": "a", "attribute": "href"}]}, "json"]', None),
)


@query("fil2_format_options", f"SELECT n_nationkey, {_list([s and s.replace(chr(39) * 2, chr(39)) for _, s in FORMAT_LISTS])}[n_nationkey % {len(FORMAT_LISTS)} + 1] AS problem FROM nation")
def fil2_format_options(spark, sf_dir):
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n, validation.format_problem(_nth(n, *[f for f, _ in FORMAT_LISTS])).alias("problem"))


@query(
    "mon4_webhooks",
    """SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_suppkey % 4 = 0 THEN 'name' END, CASE WHEN s_suppkey % 3 = 0 THEN 'url' END, CASE WHEN s_suppkey % 5 IN (1, 2, 3) THEN 'webhook' END], lambda x: x IS NOT NULL), ',') AS problems,
 CASE s_suppkey % 5 WHEN 1 THEN 'webhook URL must use http or https' WHEN 2 THEN 'the signature header cannot be supplied by the caller' WHEN 3 THEN 'unsupported webhook event: paused' END AS webhook FROM supplier""",
)
def mon4_webhooks(spark, sf_dir):
    n = F.col("s_suppkey")
    to = F.when(n % 5 == 1, F.lit("ftp://h.org/x")).when(n % 5 < 4, F.lit("https://h.org/x"))
    headers = F.when(n % 5 == 2, F.create_map(F.lit("X-Loom-Signature"), F.lit("1"))).otherwise(F.create_map(F.lit("X-Key"), F.lit("1")))
    events = F.when(n % 5 == 3, F.array(F.lit("page"), F.lit("paused"))).otherwise(F.array(F.lit("page")))
    hook = validation.webhook_problem(to, headers, events)
    name = F.when(n % 8 == 0, F.lit(" \t")).when(n % 4 == 0, F.repeat(F.lit("é"), 101)).otherwise(F.col("s_name"))
    url = F.when(n % 3 == 0, F.lit("http://127.0.0.1/")).otherwise(F.lit("example.com"))
    return table(spark, sf_dir, "supplier").select(n, F.array_join(validation.monitor_problems(name, F.lit(60), url, hook), ",").alias("problems"), hook.alias("webhook"))


@query("agt3_sources", "SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_suppkey % 4 = 0 THEN 'prompt' END, CASE WHEN s_suppkey % 7 = 0 THEN 'urls' END, CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 7 = 1 THEN 'credits' END, CASE WHEN s_suppkey % 3 = 0 THEN 'source' END], lambda x: x IS NOT NULL), ',') AS problems FROM supplier")
def agt3_sources(spark, sf_dir):
    n = F.col("s_suppkey")
    prompt = F.when(n % 8 == 0, F.lit(" \n ")).when(n % 4 == 0, F.repeat(F.lit("é"), 10_001)).otherwise(F.col("s_name"))
    bad = F.when(n % 3 == 0, F.lit("localhost")).otherwise(F.lit("b.org"))
    sources = F.concat(F.array(F.lit("https://a.org/x"), bad), F.when(n % 7 == 0, F.array_repeat(F.lit("c.org"), 99)).otherwise(F.array().cast("array<string>")))
    return table(spark, sf_dir, "supplier").select(n, F.array_join(validation.agent_problems(prompt, sources, F.when(n % 7 == 1, F.lit(1)).otherwise(F.lit(100))), ",").alias("problems"))


#: A URL, what admission makes of it, and why not.
ADMITTED = (
    (" https://a.org/x?y#z ", "https://a.org/x?y#z", None),
    ("a.org/x", "https://a.org/x", None),
    ("ftp://a.org/x", "https://ftp://a.org/x", None),
    ("http://user@b.org:8080", "http://user@b.org:8080", None),
    ("  ", None, "invalid_url"),
    ("http://", None, "invalid_url"),
    ("http://localhost:3000/", None, "blocked_by_policy"),
    ("x.localhost", None, "blocked_by_policy"),
    ("https://10.1.2.3/", None, "blocked_by_policy"),
    ("8.8.8.8/dns", "https://8.8.8.8/dns", None),
    (None, None, "invalid_url"),
)


@query("fil13_admission", f"SELECT event_id, {_list([a for _, a, _ in ADMITTED])}[event_id % {len(ADMITTED)} + 1] AS url, {_list([e for _, _, e in ADMITTED])}[event_id % {len(ADMITTED)} + 1] AS error FROM events")
def fil13_admission(spark, sf_dir):
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(n, urls.admitted(_nth(n, *[u for u, _, _ in ADMITTED])).alias("a")).select("event_id", "a.url", "a.error")


#: IPv6 addresses and whether they are public; null for what is none.
IPV6 = (
    ("::1", False), ("::", False), ("fe80::1", False), ("febf::1", False), ("fec0::1", True), ("fc00::1", False), ("fdff:ffff::", False), ("ff02::1", False), ("2001:db8::1", True), ("2606:4700:4700::1111", True), ("::ffff:10.0.0.1", False), ("::ffff:8.8.8.8", True), ("::FFFF:7f00:1", False),
    ("64:ff9b::10.0.0.1", True), ("1:2:3:4:5:6:7:8", True), ("1:2:3:4:5:6:7::", True), ("1:2:3:4:5:6:7", None), ("1::2::3", None), (":1", None), ("1:", None), ("12345::", None), ("g::", None), ("1.2.3.4", True), ("127.0.0.1", False), ("::ffff:1.2.3", None),
)


@query("fil12_public_ip6", "SELECT n_nationkey, [" + ", ".join("NULL" if p is None else str(p).lower() for _, p in IPV6) + "][n_nationkey + 1] AS is_public FROM nation")
def fil12_public_ip6(spark, sf_dir):
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n, urls.public_ip(_nth(n, *[a for a, _ in IPV6])).alias("is_public"))


@query("src3_engine_ranking", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 4 > 0 THEN event_id % 7 ELSE 0 END DESC, event_id) AS rank, 'http://e' || event_id AS url FROM events")
def src3_engine_ranking(spark, sf_dir):
    n = F.col("event_id")
    e = table(spark, sf_dir, "events").select("user_id", n, n.alias("ord"), F.concat(F.lit(" http://e"), n.cast("string"), F.lit("//")).alias("url"), F.when(n % 4 > 0, n % 7).alias("available_pages"))
    return search.ranked_engines(e, "user_id").select("user_id", "event_id", F.col("rank").cast("bigint").alias("rank"), "url")


@query(
    "src21_uploads",
    """WITH u AS (SELECT event_id AS id, ts AS created_at, event_id % 5 > 0 AS whole FROM events WHERE event_id % 3 > 0),
s AS (SELECT e.event_id // 4 * 4 + k AS upload_id, ts + INTERVAL 1 MINUTE * (event_id % 4) * 6 AS used_at, event_id * 2 + k AS use_id FROM events e, (VALUES (0), (1)) v(k)),
j AS (SELECT s.*, CASE WHEN u.id IS NULL THEN 'unknown' WHEN used_at >= created_at + INTERVAL 15 MINUTE THEN 'expired' WHEN NOT whole THEN 'incomplete' END AS early FROM s LEFT JOIN u ON u.id = upload_id)
SELECT use_id, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY upload_id, early IS NULL ORDER BY used_at, use_id) > 1 THEN 'consumed' END) AS error FROM j""",
)
def src21_uploads(spark, sf_dir):
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    uploads = e.where(n % 3 > 0).select(n.alias("id"), F.col("ts").alias("created_at"), F.when(n % 5 > 0, F.lit("x")).alias("data"))
    uses = e.select(n, "ts", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    uses = uses.select((F.floor(n / 4) * 4 + F.col("k")).cast("bigint").alias("upload_id"), (F.col("ts") + F.make_dt_interval(mins=((n % 4) * 6).cast("int"))).alias("used_at"), (n * 2 + F.col("k")).alias("use_id"))
    return J.uploads_used(uploads, uses).select("use_id", "error")


@query("src21_upload_admission", f"SELECT n_nationkey, {_list(['Invalid upload filename', 'declaredSizeBytes must be between 1 and 52428800', 'Unsupported upload type', None, None])}[n_nationkey % 5 + 1] AS problem FROM nation")
def src21_upload_admission(spark, sf_dir):
    n = F.col("n_nationkey")
    name = _nth(n, "a/b.pdf", "b.pdf", "c.exe", "d.v2.XLSX", "e.htm")
    return table(spark, sf_dir, "nation").select(n, validation.upload_problem(name, F.when(n % 5 == 1, F.lit(0)).when(n % 5 == 4, F.lit(52_428_800))).alias("problem"))


#: What the servers say: page k answers, redirects to the next page, or fails.
@query(
    "src1_fetch",
    """WITH RECURSIVE s AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 4 THEN 200 WHEN n_nationkey = 12 THEN 404 ELSE 302 END AS status FROM nation WHERE n_nationkey <> 17),
w AS (SELECT k AS start, k AS at, 0 AS hop FROM generate_series(0, 24) t(k) UNION ALL SELECT w.start, w.at + 1, hop + 1 FROM w JOIN s ON s.k = w.at WHERE s.status = 302 AND w.at <> 20 AND hop < 10),
e AS (SELECT start, max(hop) AS hop FROM w GROUP BY 1)
SELECT 'https://s.org/p' || e.start AS url, CASE WHEN w.at = 20 THEN 'http://127.0.0.1/' ELSE 'https://s.org/p' || w.at END AS final_url, CASE WHEN w.at = 20 THEN NULL ELSE s.status END AS status, CASE WHEN s.status = 200 AND w.at <> 20 THEN 'page ' || w.at END AS html,
 CASE WHEN w.at = 20 THEN 'blocked_by_policy' WHEN s.status = 200 THEN NULL ELSE 'fetch_failed' END AS error,
 CASE WHEN w.at = 20 THEN 'Private network URLs are not allowed' WHEN s.status = 200 THEN NULL WHEN s.status IS NULL THEN 'no such page' ELSE 'HTTP ' || s.status END AS message
FROM e JOIN w ON w.start = e.start AND w.hop = e.hop LEFT JOIN s ON s.k = w.at WHERE e.start <> 20""",
)
def src1_fetch(spark, sf_dir):
    n = F.col("n_nationkey")
    at = lambda c: F.concat(F.lit("https://s.org/p"), c.cast("string"))
    status = F.when(n % 5 == 4, F.lit(200)).when(n == 12, F.lit(404)).otherwise(F.lit(302))
    to = F.when(n == 19, F.lit("http://127.0.0.1/")).when(n % 2 == 0, F.concat(F.lit("/p"), (n + 1).cast("string"))).otherwise(at(n + 1))
    pages = table(spark, sf_dir, "nation").where(n != 17).select(at(n).alias("url"), status.alias("status"), F.when(status == 302, to).alias("location"), F.when(status == 200, F.concat(F.lit("page "), n.cast("string"))).alias("html"))
    return feeds.fetched(pages, spark.range(25).where("id <> 20").select(at(F.col("id")).alias("url")))


@query(
    "jsn2_documents",
    """SELECT doc_id, '{"markdown":"' || source || '","html":null,"rawHtml":null,"links":["a","b"],"screenshot":null,"actions":null,"metadata":{"title":"' || source || '","language":' || coalesce('"' || lang || '"', 'null') || ',"sourceURL":"u","url":"v","statusCode":200,"scrapeId":"' || doc_id || '","engine":"http","engineOutcomes":null,"fallbackReason":null,"proxyUsed":null}}' AS body FROM documents""",
)
def jsn2_documents(spark, sf_dir):
    fields = {"markdown": F.col("source"), "links": F.array(F.lit("a"), F.lit("b")), "title": F.col("source"), "language": F.col("lang"), "url": F.lit("u"), "final_url": F.lit("v"), "status_code": F.lit(200), "request_id": F.col("doc_id").cast("string"), "engine": F.lit("http")}
    return table(spark, sf_dir, "documents").select("doc_id", search.document(fields).alias("body"))


@query(
    "jsn5_search_documents",
    """SELECT doc_id, '{"url":"u","title":"' || source || '","description":null,' || CASE WHEN doc_id % 2 = 0 THEN '"markdown":"m","highlights":["h"],"metadata":{"title":"' || source || '","description":null,"sourceURL":"u","url":"v","category":' ELSE '"highlights":["h"],"category":' END
 || CASE WHEN doc_id % 3 = 0 THEN '"pdf"' ELSE 'null' END || CASE WHEN doc_id % 2 = 0 THEN '}}' ELSE '}' END AS body FROM documents""",
)
def jsn5_search_documents(spark, sf_dir):
    n = F.col("doc_id")
    body = search.search_document(F.lit("u"), F.col("source"), F.lit(None).cast("string"), F.when(n % 2 == 0, F.lit("m")), F.array(F.lit("h")), F.when(n % 3 == 0, F.lit("pdf")), F.lit("v"))
    return table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))


@query(
    "jsn4_actions",
    """WITH r AS (SELECT event_id, CASE event_type WHEN 'click' THEN '{"result":{"return":' || event_id || '},"type":"executeJavascript"}' WHEN 'view' THEN '{"result":{"data":"x' || event_id || '"},"type":"pdf"}' ELSE '{"result":{},"type":"pdf"}' END AS one FROM events)
SELECT event_id, '{"screenshots":["s"],"scrapes":[{"url":"u"}],"javascriptReturns":[' || CASE WHEN one LIKE '%return%' THEN event_id || ',' || event_id ELSE '' END || '],"pdfs":[' || CASE WHEN one LIKE '%data%' THEN '"x' || event_id || '","x' || event_id || '"' ELSE '' END || '],"results":[' || one || ',{"type":"wait"},' || one || ']}' AS body FROM r""",
)
def jsn4_actions(spark, sf_dir):
    n, kind = F.col("event_id").cast("string"), F.col("event_type")
    one = F.when(kind == "click", F.concat(F.lit('{"result":{"return":'), n, F.lit('},"type":"executeJavascript"}'))).when(kind == "view", F.concat(F.lit('{"result":{"data":"x'), n, F.lit('"},"type":"pdf"}'))).otherwise(F.lit('{"result":{},"type":"pdf"}'))
    results = F.concat(F.lit("["), one, F.lit(',{"type":"wait"},'), one, F.lit("]"))
    return table(spark, sf_dir, "events").select("event_id", search.actions(results, F.array(F.lit("s")), F.lit('[{"url":"u"}]')).alias("body"))


@query("htm21_data_url", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'data:image/png;base64,' || event_type ELSE 'data:x,' || event_type END AS screenshot FROM events")
def htm21_data_url(spark, sf_dir):
    raw = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.concat(F.lit("data:x,"), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", search.data_url(raw).alias("screenshot"))


@query("fil10_owner", "SELECT event_id FROM events WHERE user_id % 5 = 2")
def fil10_owner(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("owner_key", text.owner_key(F.concat(F.lit("key"), (F.col("user_id") % 5).cast("string"))))
    return workflows.owned(rows, F.lit("key2")).select("event_id")


HISTORY = "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS position FROM events WHERE user_id % 3 = 0"


def _monitors(spark, sf_dir):
    own = F.when(F.col("user_id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("other"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), text.owner_key(own).alias("owner_key")).distinct()


@query("mon5_history", f"SELECT * FROM ({HISTORY}) WHERE position <= 100")
def mon5_history(spark, sf_dir):
    checks = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("monitor_id"), F.col("ts").alias("created_at"))
    found = workflows.check_history(_monitors(spark, sf_dir), checks, F.lit(None).cast("string"))
    return found.select(F.col("id").alias("event_id"), F.col("monitor_id").alias("user_id"), F.col("position").cast("bigint").alias("position"))


@query("mon5_manual_run", f"SELECT event_id AS id, user_id AS monitor_id, 'queued' AS status, epoch({NOW_SQL})::BIGINT AS created_at FROM events WHERE CASE WHEN event_id % 2 = 0 THEN user_id % 3 = 0 ELSE user_id % 3 > 0 END")
def mon5_manual_run(spark, sf_dir):
    n = F.col("event_id")
    asked = table(spark, sf_dir, "events").select(F.col("user_id").alias("monitor_id"), n.alias("check_id"), F.when(n % 2 == 1, F.lit("other")).alias("credential"))
    return workflows.run_checks(_monitors(spark, sf_dir), asked, _now()).withColumn("created_at", F.unix_timestamp("created_at"))


@query(
    "htm19_outcomes",
    """WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN event_id % 5 > 0 THEN value END AS score FROM events),
w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC NULLS LAST, event_id) = 1 AND score IS NOT NULL AS win FROM c)
SELECT user_id, string_agg(event_type || ':' || CASE WHEN score IS NULL THEN 'failed:timeout ' || event_id WHEN win THEN 'selected:' ELSE 'rejected:lower quality score' END, '|' ORDER BY event_id) AS trace,
 min_by(CASE WHEN score IS NULL THEN 'timeout ' || event_id END, CASE WHEN score IS NULL THEN event_id END) AS fallback_reason FROM w GROUP BY user_id""",
)
def htm19_outcomes(spark, sf_dir):
    n = F.col("event_id")
    c = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("engine"), n.alias("ord"), F.when(n % 5 > 0, F.col("value")).alias("score"), F.when(n % 5 == 0, F.concat(F.lit("timeout "), n.cast("string"))).alias("error"))
    trace = F.transform("outcomes", lambda o: F.concat_ws(":", o["engine"], o["outcome"], F.coalesce(o["reason"], F.lit(""))))
    return evaluation.chosen_engine(c, "user_id").select("user_id", F.array_join(trace, "|").alias("trace"), "fallback_reason")


def hmac_sql(body: str, key: bytes) -> str:
    """A keyed SHA-256 in DuckDB, from the definition: two passes over blobs of the padded key."""
    blob = lambda x: "'" + "".join(f"\\x{b ^ x:02X}" for b in key.ljust(64, b"\0")) + "'::BLOB"
    return f"sha256({blob(0x5C)} || unhex(sha256({blob(0x36)} || encode({body}))))"


@query("str14_hmac", f"SELECT event_id, 'sha256=' || {hmac_sql('props', b'secret')} AS signature FROM events")
def str14_hmac(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.hmac_sha256(F.col("props"), "secret").alias("signature"))


BODY = """'{"success":true,"type":"' || type || '","id":"' || event_id || '","webhookId":"w","data":"' || event_type || '"' || CASE WHEN event_id % 3 = 0 THEN ',"error":"e"' ELSE '' END || '}'"""


@query("snk1_webhook", f"SELECT event_id, body, 'sha256=' || {hmac_sql('body', b'secret')} AS signature FROM (SELECT event_id, {BODY} AS body FROM (SELECT *, ['started', 'page', 'paused'][event_id % 3 + 1] AS type FROM events) WHERE type <> 'paused')")
def snk1_webhook(spark, sf_dir):
    n = F.col("event_id")
    e = table(spark, sf_dir, "events").select(n, n.cast("string").alias("id"), _nth(n, "started", "page", "paused").alias("type"), F.lit("w").alias("webhook_id"), F.lit(True).alias("success"), F.col("event_type").alias("data"), F.when(n % 3 == 0, F.lit("e")).alias("error"))
    return feeds.webhook(e, "secret").select("event_id", "body", "signature")


@query(
    "snk2_report",
    """WITH r AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT 'samples' AS part, '{"user_id":' || user_id || ',"event_type":"' || event_type || '","n":' || n || '}' AS line FROM r
UNION ALL SELECT 'summary', '| ' || user_id || ' | ' || event_type || ' | ' || n || ' |' FROM r UNION ALL SELECT 'summary', '| user_id | event_type | n |' UNION ALL SELECT 'summary', '| --- | --- | --- |'
UNION ALL SELECT 'report', '{"rows":' || count(*) || ',"columns":"user_id,event_type,n"}' FROM r""",
)
def snk2_report(spark, sf_dir):
    """A report's three files, read back line by line."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    folder = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    feeds.report(rows, folder, ["user_id", "event_type"])
    lines = [spark.read.text(f"{folder}/{part}").select(F.lit(part).alias("part"), F.col("value").alias("line")) for part in ("samples", "summary", "report")]
    return lines[0].union(lines[1]).union(lines[2])


@query(
    "str16_prompts",
    """SELECT doc_id, 'Page address:' || chr(10) || source || chr(10) || chr(10) || 'Fields, and what each means:' || chr(10) || '{' || chr(10) || '  "company": "who",' || chr(10) || '  "size": "number"' || chr(10) || '}' || chr(10) || chr(10) || 'The object has these fields and no others; each is a text, or null where the page doesn''t say.' || chr(10) || chr(10) || 'Page:' || chr(10) || substr(coalesce(text, ''), 1, 24000) AS fields,
 'Page addresses:' || chr(10) || source || chr(10) || chr(10) || 'Task:' || chr(10) || 'Answer from the page alone: who is ' || coalesce(lang, 'x') || '?' || chr(10) || chr(10) || 'Schema:' || chr(10) || '{' || chr(10) || '  "properties": {' || chr(10) || '    "answer": {' || chr(10) || '      "type": "string"' || chr(10) || '    }' || chr(10) || '  },' || chr(10) || '  "required": [' || chr(10) || '    "answer"' || chr(10) || '  ],' || chr(10) || '  "type": "object"' || chr(10) || '}' || chr(10) || chr(10) || 'Pages:' || chr(10) || substr(coalesce(text, ''), 1, 24000) AS question,
 'Page addresses:' || chr(10) || source || chr(10) || chr(10) || 'Task:' || chr(10) || 'Quote the passages of the page that fit best: ' || coalesce(lang, 'x') || chr(10) || chr(10) || 'Schema:' || chr(10) || '{' || chr(10) || '  "properties": {' || chr(10) || '    "highlights": {' || chr(10) || '      "type": "string"' || chr(10) || '    }' || chr(10) || '  },' || chr(10) || '  "required": [' || chr(10) || '    "highlights"' || chr(10) || '  ],' || chr(10) || '  "type": "object"' || chr(10) || '}' || chr(10) || chr(10) || 'Pages:' || chr(10) || substr(coalesce(text, ''), 1, 24000) AS passages FROM documents""",
)
def str16_prompts(spark, sf_dir):
    asked = F.format_string("who is %s?", F.coalesce("lang", F.lit("x")))
    schema = {"properties": {"company": {"description": "who"}, "size": {"type": "number"}}}
    return table(spark, sf_dir, "documents").select("doc_id", models.fields_prompt(F.col("source"), schema, F.col("text")).alias("fields"), models.query_prompt(F.col("source"), F.col("text"), asked, "answer").alias("question"), models.query_prompt(F.col("source"), F.col("text"), F.coalesce("lang", F.lit("x")), "highlights").alias("passages"))


@query(
    "str16_replies",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'said ' || event_id ELSE 'the page says' END AS answer, CASE event_id % 4 WHEN 0 THEN 'ACME' WHEN 3 THEN 'Title' END AS company, event_id % 4 >= 2 AS missing FROM events",
)
def str16_replies(spark, sf_dir):
    n = F.col("event_id")
    inner = F.when(n % 4 == 0, F.concat(F.lit('Sure: {"answer": "said '), n.cast("string"), F.lit('", "company": " ACME "}'))).when(n % 4 == 1, F.lit("I can't")).otherwise(F.lit("  "))
    reply = F.when(n % 4 < 3, F.to_json(F.struct(F.array(F.struct(F.struct(inner.alias("content")).alias("message"))).alias("choices"))))
    page = F.lit("# head\n\nother words\n\nthe page says")
    got = models.fields(reply, {"company": "who"}, page, F.lit("Title"))
    return table(spark, sf_dir, "events").select(n, models.answer(reply, page, "which page").alias("answer"), got["company"].alias("company"), models.content(reply).isNull().alias("missing"))


@query(
    "fil14_resolved",
    """SELECT n_nationkey, CASE n_nationkey % 6 WHEN 1 THEN 'blocked_by_policy' WHEN 2 THEN 'fetch_failed' WHEN 3 THEN 'blocked_by_policy' WHEN 4 THEN 'invalid_url' WHEN 5 THEN 'blocked_by_policy' END AS error FROM nation""",
)
def fil14_resolved(spark, sf_dir):
    n, k = F.col("n_nationkey"), F.col("n_nationkey") % 6
    at = F.concat(F.lit("Host"), n.cast("string"), F.lit(".org"))
    url = F.when(k == 4, F.lit("nothing")).when(k == 5, F.lit("http://a.localhost/")).otherwise(F.concat(F.lit("https://"), at, F.lit(":8080/x")))
    found = F.when(k == 0, F.array(F.lit("8.8.8.8"), F.lit("2606:4700::1"))).when(k == 1, F.array(F.lit("8.8.8.8"), F.lit("::ffff:10.0.0.1"))).when(k == 3, F.array(F.lit("fe80::1"))).otherwise(F.array().cast("array<string>"))
    nations = table(spark, sf_dir, "nation")
    return validation.resolved(nations.select(n, url.alias("url")), nations.select(at.alias("host"), F.explode(found).alias("address"))).select("n_nationkey", "error")


@query(
    "ses2_handoffs",
    f"""WITH s AS (SELECT event_id AS id, ts, 'https://s.org/' || event_id AS url FROM events WHERE event_id % 3 > 0)
SELECT e.event_id AS request_id, CASE WHEN s.id IS NOT NULL AND TIMESTAMP '2024-01-10 12:00:00' <= s.ts + INTERVAL 4 HOUR THEN s.url END AS initial_url, CASE WHEN s.id IS NOT NULL AND TIMESTAMP '2024-01-10 12:00:00' <= s.ts + INTERVAL 4 HOUR THEN sha256(CASE WHEN e.event_id % 2 = 0 THEN 'k' ELSE 'anonymous' END) END AS owner_key,
 CASE WHEN s.id IS NOT NULL AND TIMESTAMP '2024-01-10 12:00:00' <= s.ts + INTERVAL 4 HOUR THEN NULL ELSE 'not_found' END AS error FROM events e LEFT JOIN s ON s.id = e.event_id + 1""",
)
def ses2_handoffs(spark, sf_dir):
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    scrapes = e.select(n.alias("request_id"), F.concat(F.lit("https://s.org/"), n.cast("string")).alias("final_url"), (n % 3 > 0).alias("rendered"), F.col("ts").alias("created_at"))
    asked = e.select((n + 1).alias("scrape_id"), n.alias("request_id"), F.when(n % 2 == 0, F.lit("k")).alias("credential"))
    return workflows.handoffs(scrapes, asked, F.expr("TIMESTAMP '2024-01-10 12:00:00'"))


@query(
    "job1_render_jobs",
    """WITH e AS (SELECT user_id, event_id, ['enqueued', 'finished', 'failed', 'deleted'][event_id % 4 + 1] AS event, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
SELECT user_id AS job_id, CASE event WHEN 'enqueued' THEN 'processing' WHEN 'failed' THEN 'failed' ELSE 'completed' END AS state, CASE WHEN event = 'finished' THEN 'r' || event_id END AS result, CASE WHEN event = 'failed' THEN 'e' || event_id END AS error FROM e WHERE r = 1 AND event <> 'deleted'""",
)
def job1_render_jobs(spark, sf_dir):
    n = F.col("event_id")
    text_of = lambda c: F.concat(F.lit(c), n.cast("string"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), n.alias("ord"), _nth(n, "enqueued", "finished", "failed", "deleted").alias("event"), text_of("r").alias("result"), text_of("e").alias("error"))
    return workflows.render_jobs(e)
