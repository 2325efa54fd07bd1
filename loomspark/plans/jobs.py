"""Queries over crawl jobs and tasks, which orders and lineitem stand in for.

The tables are derived by SQL that Spark and DuckDB both read, so the two sides start alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html, text
from ..operators import frontier, search, validation, workflows
from ..operators import jobs as J
from . import query, table

NOW_SQL = "TIMESTAMP '1995-06-15 12:00:00'"


def _now():
    return F.expr(NOW_SQL)


JOBS = """SELECT o_orderkey AS id, 'https://site' || CAST(o_custkey % 50 AS STRING) || '.example.com/' AS url,
 CASE WHEN o_orderpriority LIKE '1%' THEN 'batch_scrape' ELSE 'crawl' END AS job_type,
 CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'scraping' WHEN o_custkey % 7 = 0 THEN 'cancelled' ELSE 'completed' END AS status,
 CAST(2 + o_custkey % 5 AS INT) AS page_limit, CAST(o_custkey % 4 AS INT) AS max_depth, CAST(o_custkey % 3 AS INT) AS max_retries, CAST((o_custkey % 3) * 1000 AS BIGINT) AS delay_ms,
 CAST(1 + o_custkey % 2 AS INT) AS max_concurrency, o_custkey % 11 = 0 AS cancel_requested, o_orderdate AS created_at, o_orderdate AS started_at,
 CASE WHEN o_custkey % 4 > 0 THEN o_orderdate END AS last_task_started_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 HOUR END AS finished_at, o_orderdate + INTERVAL 7 DAY AS expires_at FROM {orders}"""
TASKS = """SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS crawl_id, 'https://site' || CAST(l_suppkey % 50 AS STRING) || '.example.com/p/' || CAST(l_partkey AS STRING) AS url,
 'http://site' || CAST(l_suppkey % 50 AS STRING) || '.example.com/p/' || CAST(l_partkey AS STRING) AS dedup_key, CAST(l_linenumber % 4 AS INT) AS depth,
 CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' THEN 'completed' WHEN l_partkey % 2 = 0 THEN 'queued' ELSE 'active' END AS status,
 CAST(1 + l_suppkey % 9 AS INT) AS attempts, l_shipdate AS next_attempt_at, l_shipdate + INTERVAL 90 SECOND AS lease_expires_at, l_shipdate AS created_at,
 CASE WHEN l_linenumber > 1 THEN l_shipdate END AS started_at, CASE WHEN l_returnflag <> 'N' AND l_partkey % 5 > 0 THEN l_shipdate + INTERVAL 30 SECOND END AS finished_at,
 CAST(NULL AS STRING) AS result, CASE WHEN l_partkey % 3 = 0 THEN 'fetch_failed' WHEN l_partkey % 3 = 1 THEN 'blocked' END AS error_code, CASE WHEN l_partkey % 3 = 0 THEN 'timeout' END AS error_message FROM {lineitem}"""


def _sql(body: str) -> str:
    strip = lambda s: s.replace("{", "").replace("}", "").replace("STRING", "VARCHAR")
    return f"WITH jobs AS ({strip(JOBS)}), tasks AS ({strip(TASKS)}) {body}"


def _frames(spark, sf_dir):
    return spark.sql(JOBS, orders=table(spark, sf_dir, "orders")), spark.sql(TASKS, lineitem=table(spark, sf_dir, "lineitem"))


def _epoch(c: str):
    return F.unix_timestamp(F.col(c)).alias(c)


COUNTS = "SELECT crawl_id, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed FROM tasks GROUP BY crawl_id"


@query("agg1_status_rollup", _sql(COUNTS))
def agg1_status_rollup(spark, sf_dir):
    return J.counts(_frames(spark, sf_dir)[1])


@query("agg2_queue_depth", _sql("SELECT count(*) FILTER (WHERE status IN ('queued', 'active')) AS depth FROM tasks"))
def agg2_queue_depth(spark, sf_dir):
    return J.queue_depth(_frames(spark, sf_dir)[1])


@query("crw9_status", _sql(f"SELECT j.id, j.url, j.status, coalesce(total, 0) AS total, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed FROM jobs j LEFT JOIN ({COUNTS}) c ON c.crawl_id = j.id"))
def crw9_status(spark, sf_dir):
    return J.status(*_frames(spark, sf_dir))


@query(
    "jsn3_envelope",
    _sql(
        f""", u AS (SELECT * FROM tasks QUALIFY count(*) OVER (PARTITION BY id) = 1), d AS (SELECT crawl_id, id, status, row_number() OVER (PARTITION BY crawl_id ORDER BY finished_at NULLS LAST, id) AS r, count(*) OVER (PARTITION BY crawl_id) AS n FROM u WHERE status IN ('completed', 'failed')),
 p AS (SELECT crawl_id, coalesce(string_agg(CASE WHEN status = 'completed' THEN '{{{{"n":' || id || '}}}}' END, ';' ORDER BY r) FILTER (WHERE r <= 2), '') AS data, max(n) AS n FROM d GROUP BY 1)
 SELECT j.id, true AS success, CASE WHEN j.status = 'queued' THEN 'scraping' ELSE j.status END AS status, coalesce(total, 0) AS total, coalesce(completed, 0) AS completed, coalesce(completed, 0) AS credits_used, epoch(expires_at)::BIGINT AS expires_at,
 coalesce(p.data, '') AS data, CASE WHEN p.n > 2 THEN '/v2/crawl/' || j.id || '?skip=2&limit=2' END AS next,
 '{{{{"success":true,"id":"' || j.id || '","status":"' || CASE WHEN j.status = 'queued' THEN 'scraping' ELSE j.status END || '","total":' || coalesce(total, 0) || ',"completed":' || coalesce(completed, 0) || ',"creditsUsed":' || coalesce(completed, 0) || ',"expiresAt":' || coalesce('"' || strftime(expires_at, '%Y-%m-%dT%H:%M:%SZ') || '"', 'null')
 || ',"data":[' || replace(coalesce(p.data, ''), ';', ',') || '],"next":' || CASE WHEN p.n > 2 THEN '"/v2/crawl/' || j.id || '?skip=2&limit=2"' ELSE 'null' END || '}}}}' AS body FROM jobs j LEFT JOIN ({COUNTS.replace('FROM tasks', 'FROM u')}) c ON c.crawl_id = j.id LEFT JOIN p ON p.crawl_id = j.id"""
    ).replace("{{", "{").replace("}}", "}"),
)
def jsn3_envelope(spark, sf_dir):
    j, t = _frames(spark, sf_dir)
    # Some ids of the stand-in repeat, which a task's id doesn't.
    t = t.join(t.groupBy("id").count().where("count = 1"), "id", "left_semi")
    t = t.withColumn("result", F.when(F.col("status") == "completed", F.concat(F.lit('{"n":'), F.col("id").cast("string"), F.lit("}"))))
    return J.envelope(j, t, limit=2).withColumns({"data": F.array_join("data", ";"), "expires_at": F.unix_timestamp("expires_at")})


@query("srt1_pagination", _sql("SELECT crawl_id, id, position, CASE WHEN n > 3 THEN 3 END AS next FROM (SELECT crawl_id, id, row_number() OVER (PARTITION BY crawl_id ORDER BY finished_at NULLS LAST, id) - 1 AS position, count(*) OVER (PARTITION BY crawl_id) AS n FROM tasks WHERE status IN ('completed', 'failed')) WHERE position >= 1 AND position < 3"))
def srt1_pagination(spark, sf_dir):
    return J.results(_frames(spark, sf_dir)[1], 1, 2).select("crawl_id", "id", "position", "next")


@query("lim3_full_drain", _sql("SELECT crawl_id, id, row_number() OVER (PARTITION BY crawl_id ORDER BY finished_at NULLS LAST, id) - 1 AS position FROM tasks WHERE status IN ('completed', 'failed')"))
def lim3_full_drain(spark, sf_dir):
    return J.all_results(_frames(spark, sf_dir)[1]).select("crawl_id", "id", "position")


@query("crw10_errors", _sql("SELECT crawl_id, url, coalesce(error_code, 'crawl_failed') AS code, coalesce(error_message, 'Crawl task failed') AS message FROM tasks WHERE status = 'failed'"))
def crw10_errors(spark, sf_dir):
    return J.errors(_frames(spark, sf_dir)[1]).drop("finished_at")


@query("srt2_listed_errors", _sql("SELECT crawl_id, id, row_number() OVER (PARTITION BY crawl_id ORDER BY finished_at NULLS LAST, id) AS position FROM tasks WHERE status = 'failed'"))
def srt2_listed_errors(spark, sf_dir):
    return J.listed_errors(_frames(spark, sf_dir)[1]).select("crawl_id", "id", "position")


@query("srt2_listed_crawls", _sql("SELECT id, row_number() OVER (ORDER BY created_at, id) AS position FROM jobs WHERE job_type = 'crawl' AND status IN ('queued', 'scraping') AND NOT cancel_requested"))
def srt2_listed_crawls(spark, sf_dir):
    return J.listed_crawls(_frames(spark, sf_dir)[0]).select("id", "position")


@query("crw11_active_crawls", _sql("SELECT id, status FROM jobs WHERE job_type = 'crawl' AND status IN ('queued', 'scraping') AND NOT cancel_requested"))
def crw11_active_crawls(spark, sf_dir):
    return J.active_crawls(_frames(spark, sf_dir)[0]).select("id", "status")


CLAIMABLE = f"""SELECT t.*, j.max_concurrency FROM tasks t JOIN jobs j ON j.id = t.crawl_id
 LEFT JOIN (SELECT crawl_id, count(*) AS busy FROM tasks WHERE status = 'active' AND lease_expires_at >= {NOW_SQL} GROUP BY 1) b ON b.crawl_id = j.id
 WHERE NOT j.cancel_requested AND j.status IN ('queued', 'scraping') AND (j.last_task_started_at IS NULL OR j.last_task_started_at + j.delay_ms * INTERVAL 1 MILLISECOND <= {NOW_SQL})
 AND coalesce(busy, 0) < j.max_concurrency AND ((t.status = 'queued' AND t.next_attempt_at <= {NOW_SQL}) OR (t.status = 'active' AND t.lease_expires_at < {NOW_SQL}))"""


@query("jon1_claimable", _sql(f"SELECT id, crawl_id, status FROM ({CLAIMABLE})"))
def jon1_claimable(spark, sf_dir):
    return J.claimable(*_frames(spark, sf_dir), _now()).select("id", "crawl_id", "status")


@query("crw5_claim", _sql(f"SELECT id, crawl_id, depth, attempts + 1 AS attempts, epoch({NOW_SQL} + INTERVAL 90 SECOND)::BIGINT AS lease_expires_at FROM (SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY next_attempt_at, created_at, id) AS r FROM ({CLAIMABLE})) WHERE r = 1"))
def crw5_claim(spark, sf_dir):
    return J.claim(*_frames(spark, sf_dir), _now()).select("id", "crawl_id", "depth", "attempts", _epoch("lease_expires_at"))


DELAY = "CAST(least(300, 5 * pow(2, least(attempts - 1, 6))) AS BIGINT)"


@query("dat2_backoff", _sql(f"SELECT id, {DELAY} AS delay_s FROM tasks"))
def dat2_backoff(spark, sf_dir):
    return _frames(spark, sf_dir)[1].select("id", J.retry_delay(F.col("attempts")).alias("delay_s"))


@query(
    "crw7_failure_retry",
    _sql(
        f"""SELECT id, attempts, CASE WHEN again THEN 'queued' ELSE 'failed' END AS status, epoch(CASE WHEN again THEN {NOW_SQL} + {DELAY} * INTERVAL 1 SECOND ELSE next_attempt_at END)::BIGINT AS next_attempt_at, NOT again AS ended
 FROM (SELECT t.*, error_code = 'fetch_failed' AND NOT cancel_requested AND attempts <= max_retries AS again FROM tasks t JOIN jobs j ON j.id = t.crawl_id WHERE t.status = 'active' AND error_code IS NOT NULL)"""
    ),
)
def crw7_failure_retry(spark, sf_dir):
    d = J.after_failure(*_frames(spark, sf_dir), _now())
    return d.select("id", "attempts", "status", _epoch("next_attempt_at"), F.col("finished_at").isNotNull().alias("ended"))


@query("crw6_success", _sql("SELECT id, CASE WHEN status = 'active' AND id % 3 = 0 THEN 'completed' ELSE status END AS status, CASE WHEN status = 'active' AND id % 3 = 0 THEN 'page' END AS result FROM tasks"))
def crw6_success(spark, sf_dir):
    t = _frames(spark, sf_dir)[1]
    return J.after_success(t, t.where("id % 3 = 0").select("id", F.lit("page").alias("result")), _now()).select("id", "status", "result")


@query("crw8_completion", _sql("SELECT id FROM jobs WHERE status IN ('queued', 'scraping') AND NOT EXISTS (SELECT 1 FROM tasks t WHERE t.crawl_id = jobs.id AND t.status IN ('queued', 'active'))"))
def crw8_completion(spark, sf_dir):
    return J.drained(*_frames(spark, sf_dir)).select("id")


@query("jon4_anti_join", _sql("SELECT id FROM jobs WHERE status IN ('queued', 'scraping') AND NOT EXISTS (SELECT 1 FROM tasks t WHERE t.crawl_id = jobs.id AND t.id % 5 = 0 AND t.status IN ('queued', 'active'))"))
def jon4_anti_join(spark, sf_dir):
    j, t = _frames(spark, sf_dir)
    return J.drained(j, t.where("id % 5 = 0")).select("id")


@query("jon2_correlated_count", _sql(f"SELECT t.id FROM tasks t JOIN jobs j ON j.id = t.crawl_id WHERE NOT cancel_requested AND j.status IN ('queued', 'scraping') AND t.status = 'queued' AND (SELECT count(*) FROM tasks o WHERE o.crawl_id = j.id AND o.status = 'active') < j.max_concurrency"))
def jon2_correlated_count(spark, sf_dir):
    # Leases that hold, tasks that are due, no throttle: only the count of active tasks decides.
    j, t = _frames(spark, sf_dir)
    t = t.withColumns({"lease_expires_at": _now() + F.expr("INTERVAL 1 HOUR"), "next_attempt_at": _now()})
    return J.claimable(j.withColumn("last_task_started_at", F.lit(None).cast("timestamp")), t, _now()).select("id")


@query("win5_throttle", _sql(f"SELECT t.id FROM tasks t JOIN jobs j ON j.id = t.crawl_id WHERE NOT cancel_requested AND j.status IN ('queued', 'scraping') AND t.status = 'queued' AND j.id % 4 * 1000 >= j.delay_ms"))
def win5_throttle(spark, sf_dir):
    # The last task began so many seconds ago.
    j, t = _frames(spark, sf_dir)
    j = j.withColumns({"last_task_started_at": _now() - F.make_dt_interval(secs=(F.col("id") % 4).cast("decimal(18,6)")), "max_concurrency": F.lit(100)})
    return J.claimable(j, t.where("status = 'queued'").withColumn("next_attempt_at", _now()), _now()).select("id")


@query("jon5_existence", _sql("SELECT DISTINCT l_orderkey + 5 AS id FROM lineitem WHERE l_orderkey + 5 IN (SELECT id FROM jobs)"))
def jon5_existence(spark, sf_dir):
    j, t = _frames(spark, sf_dir)
    return J.existing(j, t.select((F.col("crawl_id") + 5).alias("id")).distinct())


@query("crw12_cancel", _sql(f"SELECT id, CASE WHEN hit THEN 'cancelled' ELSE status END AS status, cancel_requested OR hit AS cancel_requested, epoch(CASE WHEN hit THEN coalesce(finished_at, {NOW_SQL}) ELSE finished_at END)::BIGINT AS finished_at FROM (SELECT *, id % 2 = 0 AND status IN ('queued', 'scraping') AS hit FROM jobs)"))
def crw12_cancel(spark, sf_dir):
    j = _frames(spark, sf_dir)[0]
    return J.cancelled(j, j.where("id % 2 = 0"), _now()).select("id", "status", "cancel_requested", _epoch("finished_at"))


@query("crw15_expiry", _sql(f"SELECT id FROM jobs WHERE NOT (expires_at <= {NOW_SQL} AND status IN ('completed', 'cancelled'))"))
def crw15_expiry(spark, sf_dir):
    return J.unexpired(_frames(spark, sf_dir)[0], _now()).select("id")


@query("jon9_cascade", _sql(f"SELECT id, crawl_id FROM tasks WHERE crawl_id IN (SELECT id FROM jobs WHERE NOT (expires_at <= {NOW_SQL} AND status IN ('completed', 'cancelled')))"))
def jon9_cascade(spark, sf_dir):
    j, t = _frames(spark, sf_dir)
    return J.cascade(J.unexpired(j, _now()), t, "crawl_id").select("id", "crawl_id")


@query("crw13_idempotency", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS accepted FROM events")
def crw13_idempotency(spark, sf_dir):
    return J.first_wins(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "accepted")


@query(
    "agg11_page_limit",
    _sql(
        """, f AS (SELECT crawl_id, url || '/n' AS url, dedup_key || '/n' AS dedup_key, id AS ord FROM tasks),
a AS (SELECT *, row_number() OVER (PARTITION BY crawl_id, url ORDER BY ord, url) AS r1 FROM f), b AS (SELECT *, row_number() OVER (PARTITION BY crawl_id, dedup_key ORDER BY ord, url) AS r2 FROM a WHERE r1 = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY ord, url) AS pos FROM b WHERE r2 = 1), h AS (SELECT crawl_id, count(*) AS have FROM tasks WHERE id % 2 = 0 GROUP BY 1)
SELECT c.crawl_id, c.url FROM c JOIN jobs j ON j.id = c.crawl_id LEFT JOIN h ON h.crawl_id = c.crawl_id WHERE pos + coalesce(have, 0) <= page_limit"""
    ),
)
def agg11_page_limit(spark, sf_dir):
    j, t = _frames(spark, sf_dir)
    found = t.select("crawl_id", F.concat("url", F.lit("/n")).alias("url"), F.concat("dedup_key", F.lit("/n")).alias("dedup_key"), F.lit(1).alias("depth"), F.col("id").alias("ord"))
    return J.admit(t.where("id % 2 = 0"), found, j).select("crawl_id", "url")


@query("crw2_batch", _sql("SELECT crawl_id, url FROM (SELECT crawl_id, url, min(id) FROM tasks GROUP BY crawl_id, url)"))
def crw2_batch(spark, sf_dir):
    t = _frames(spark, sf_dir)[1]
    requests = t.groupBy(F.col("crawl_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "url"))), lambda x: x["url"]).alias("urls"))
    return J.batch_seed(requests).select("crawl_id", "url")


#: Page n of a site links to pages 2n and 2n + 1 and back to the start; the sitemap names page 7.
GRAPH = "SELECT k, CASE WHEN k = 1 THEN 'https://site' || s || '.org/' ELSE 'https://site' || s || '.org/p' || k END AS url, s FROM generate_series(1, 40) a(k), generate_series(0, 9) b(s)"


@query(
    "crw3_frontier",
    """WITH RECURSIVE w AS (SELECT s_suppkey AS crawl_id, 1::BIGINT AS k, 0 AS depth FROM supplier
 UNION SELECT crawl_id, n, depth + 1 FROM (SELECT w.*, unnest(CASE WHEN depth = 0 AND crawl_id % 3 > 0 THEN [7, 2 * k, 2 * k + 1] ELSE [2 * k, 2 * k + 1] END) AS n FROM w WHERE k <= 40 AND depth < crawl_id % 5 AND crawl_id <> 4)),
m AS (SELECT crawl_id, k, min(depth) AS depth FROM w GROUP BY 1, 2)
SELECT crawl_id, CASE WHEN k = 1 THEN 'https://site' || crawl_id || '.org/' ELSE 'https://site' || crawl_id || '.org/p' || k END AS url, depth FROM m""",
)
def crw3_frontier(spark, sf_dir):
    at = lambda s, k: F.when(k == 1, F.concat(F.lit("https://site"), s.cast("string"), F.lit(".org/"))).otherwise(F.concat(F.lit("https://site"), s.cast("string"), F.lit(".org/p"), k.cast("string")))
    sites = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    grid = sites.withColumnRenamed("id", "s").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(40))))
    s, k = F.col("s"), F.col("k")
    links = F.array(at(s, 2 * k), at(s, 2 * k + 1), at(s, F.lit(1)), F.lit("https://elsewhere.org/"))
    pages = grid.select(at(s, k).alias("url"), links.alias("links"))
    maps = sites.where("id % 3 > 0").select(F.concat(F.lit("https://site"), F.col("id").cast("string"), F.lit(".org/sitemap.xml")).alias("url"), F.array(at(F.col("id"), F.lit(7))).alias("locations"))
    job = F.when(F.col("id") == 4, F.lit("batch_scrape")).otherwise(F.lit("crawl"))
    jobs = sites.select("id", at(F.col("id"), F.lit(1)).alias("url"), job.alias("job_type"), F.lit(1000).alias("page_limit"), (F.col("id") % 5).cast("int").alias("max_depth"))
    return frontier.crawl(pages, jobs, entire_domain=True, sitemaps=maps).select("crawl_id", "url", "depth")


@query("crw3_sitemap_only", "SELECT s AS crawl_id, p AS url, CASE WHEN p LIKE '%/' THEN 0 ELSE 1 END AS depth FROM (SELECT s, unnest(CASE WHEN s % 3 > 0 THEN ['https://site' || s || '.org/', 'https://site' || s || '.org/p7'] ELSE ['https://site' || s || '.org/'] END) AS p FROM (SELECT s_suppkey AS s FROM supplier))")
def crw3_sitemap_only(spark, sf_dir):
    at = F.concat(F.lit("https://site"), F.col("id").cast("string"), F.lit(".org/"))
    sites = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    pages = sites.select(at.alias("url"), F.array(F.concat(at, F.lit("p2"))).alias("links"))
    maps = sites.where("id % 3 > 0").select(F.concat(at, F.lit("sitemap.xml")).alias("url"), F.array(F.concat(at, F.lit("p7"))).alias("locations"))
    jobs = sites.select("id", at.alias("url"), F.lit(1000).alias("page_limit"), F.lit(3).alias("max_depth"))
    return frontier.crawl(pages, jobs, sitemaps=maps, sitemap="only").select("crawl_id", "url", "depth")


@query(
    "crw1_enqueue",
    f"""WITH r AS (SELECT o_orderkey AS id, ['https://a.org/x', 'b.org', 'http://localhost/', ' '][o_orderkey % 4 + 1] AS url, o_custkey % 5 - 1 AS page_limit, ['skip', 'only', 'all', NULL][o_custkey % 4 + 1] AS sitemap FROM orders),
 p AS (SELECT *, array_to_string(list_filter([CASE WHEN id % 4 >= 2 THEN 'url' END, CASE WHEN page_limit < 1 THEN 'page_limit' END, CASE WHEN sitemap = 'all' THEN 'sitemap' END], lambda x: x IS NOT NULL), ',') AS problems FROM r)
 SELECT id, problems, CASE WHEN problems = '' THEN CASE WHEN id % 4 = 1 THEN 'https://' ELSE '' END || url END AS url, CASE WHEN problems = '' THEN coalesce(sitemap, 'include') END AS sitemap, CASE WHEN problems = '' THEN 'http://' || ['a.org/x', 'b.org/'][id % 4 + 1] END AS dedup_key,
 CASE WHEN problems = '' THEN epoch({NOW_SQL} + INTERVAL 7 DAY)::BIGINT END AS expires_at FROM p""",
)
def crw1_enqueue(spark, sf_dir):
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    nth = lambda i, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (i % len(v) + 1).cast("int"))
    asked = table(spark, sf_dir, "orders").select(n.alias("id"), nth(n, "https://a.org/x", "b.org", "http://localhost/", " ").alias("url"), (c % 5 - 1).alias("page_limit"), nth(c, "skip", "only", "all", None).alias("sitemap"))
    jobs, tasks, refused = J.enqueued(asked, _now())
    in_ = jobs.join(tasks.select(F.col("crawl_id").alias("id"), "dedup_key"), "id").select("id", F.lit("").alias("problems"), "url", "sitemap", "dedup_key", _epoch("expires_at"))
    none = lambda kind: F.lit(None).cast(kind)
    return in_.union(refused.select("id", F.array_join("problems", ","), none("string"), none("string"), none("string"), none("bigint")))


@query("dat1_retention", _sql("SELECT id, epoch(created_at + INTERVAL 7 DAY)::BIGINT AS until, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created FROM jobs"))
def dat1_retention(spark, sf_dir):
    j = _frames(spark, sf_dir)[0]
    return j.select("id", F.unix_timestamp(J.retention(F.col("created_at"))).alias("until"), J.rfc3339(F.col("created_at")).alias("created"))


@query("dat4_delay_ms", "SELECT event_id, CASE WHEN value > 0 AND value <= 60 THEN ceil(value * 1000)::BIGINT END AS delay_ms, greatest(1, ceil(value / 1000))::BIGINT AS seconds FROM events")
def dat4_delay_ms(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", J.delay_ms(v).alias("delay_ms"), J.whole_seconds(v).alias("seconds"))


# Monitors over conversations: a turn is a check of its conversation's page.
MONITOR_SQL = "SELECT conv_id, turn, coalesce(lag(text) OVER w, '') AS before_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"


def _checks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("monitor_id"), F.col("turn").alias("finished_at"), F.col("turn").alias("id"), "text", F.to_json(F.struct("role", F.col("turn").alias("n"))).alias("json"))


@query("win1_previous", MONITOR_SQL)
def win1_previous(spark, sf_dir):
    d = workflows.with_previous(_checks(spark, sf_dir))
    return d.select(F.col("monitor_id").alias("conv_id"), F.col("id").alias("turn"), "before_text")


@query("jon6_as_of", "SELECT conv_id, turn, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before_text FROM conversations WHERE turn % 3 <> 1")
def jon6_as_of(spark, sf_dir):
    c = _checks(spark, sf_dir).withColumn("status", F.when(F.col("id") % 3 == 1, F.lit("failed")).otherwise(F.lit("completed")))
    return workflows.with_previous(c).select(F.col("monitor_id").alias("conv_id"), F.col("id").alias("turn"), "before_text")


@query("mon2_check_diffs", "SELECT conv_id, turn, coalesce(lag(text) OVER w, '') <> text OR lag(role) OVER w IS NULL OR lag(role) OVER w <> role AS changed FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def mon2_check_diffs(spark, sf_dir):
    c = _checks(spark, sf_dir).withColumn("json", F.regexp_replace("json", r',"n":\d+', ""))
    return workflows.check_diffs(c).select(F.col("monitor_id").alias("conv_id"), F.col("id").alias("turn"), "changed")


LINES = "CASE WHEN {x} = '' THEN [] ELSE list_sort(list_distinct(string_split({x}, chr(10)))) END"


@query("set2_line_diff", f"""SELECT conv_id, turn, CASE WHEN before_text = text THEN '' ELSE array_to_string(list_concat(['--- previous', '+++ current'],
 list_concat(list_transform(list_filter(a, lambda x: NOT list_contains(b, x)), lambda x: '-' || x), list_transform(list_filter(b, lambda x: NOT list_contains(a, x)), lambda x: '+' || x))), chr(10)) END AS diff
FROM (SELECT conv_id, turn, text, before_text, {LINES.format(x='before_text')} AS a, {LINES.format(x='text')} AS b FROM (SELECT *, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before_text FROM conversations))""")
def set2_line_diff(spark, sf_dir):
    d = workflows.with_previous(_checks(spark, sf_dir))
    return d.select(F.col("monitor_id").alias("conv_id"), F.col("id").alias("turn"), text.line_diff(F.col("before_text"), F.col("text")).alias("diff"))


@query("jsn1_json_changes", "SELECT conv_id, turn, array_to_string(CASE WHEN lag(role) OVER w IS NULL OR lag(role) OVER w <> role THEN ['/n', '/role'] ELSE ['/n'] END, ' ') AS paths FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def jsn1_json_changes(spark, sf_dir):
    d = workflows.check_diffs(_checks(spark, sf_dir))
    return d.select(F.col("monitor_id").alias("conv_id"), F.col("id").alias("turn"), F.array_join(F.transform("json_diff", lambda x: x["path"]), " ").alias("paths"))


@query("win2_latest_n", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 2")
def win2_latest_n(spark, sf_dir):
    return workflows.latest(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], 2).select("conv_id", "turn")


@query("mon1_due", f"SELECT o_orderkey AS id, epoch({NOW_SQL} + (60 + o_custkey % 100) * INTERVAL 1 SECOND)::BIGINT AS next_run_at FROM orders WHERE o_custkey % 3 <> 0 AND o_orderdate <= {NOW_SQL}")
def mon1_due(spark, sf_dir):
    m = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3 != 0).alias("enabled"), F.col("o_orderdate").alias("next_run_at"), (60 + F.col("o_custkey") % 100).alias("schedule_seconds"))
    return workflows.due(m, _now()).select("id", _epoch("next_run_at"))


@query("mon3_update", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE s_name END AS name, s_acctbal AS bal FROM supplier")
def mon3_update(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return workflows.updated(s, s.where("id % 2 = 0").select("id", F.lit("new").alias("name"), F.lit(None).cast("double").alias("bal")))


@query("mon4_admission", "SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_suppkey % 4 = 0 THEN 'name' END, CASE WHEN s_suppkey % 100 < 60 THEN 'schedule' END], lambda x: x IS NOT NULL), ',') AS problems FROM supplier")
def mon4_admission(spark, sf_dir):
    name = F.when(F.col("s_suppkey") % 4 == 0, F.lit("")).otherwise(F.col("s_name"))
    p = validation.monitor_problems(name, F.col("s_suppkey") % 100, F.lit("example.com"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(p, ",").alias("problems"))


@query("agt3_admission", "SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_suppkey % 4 = 0 THEN 'prompt' END, CASE WHEN s_suppkey % 120 NOT BETWEEN 1 AND 100 OR s_suppkey % 120 < 2 THEN 'credits' END], lambda x: x IS NOT NULL), ',') AS problems FROM supplier")
def agt3_admission(spark, sf_dir):
    prompt = F.when(F.col("s_suppkey") % 4 == 0, F.lit("")).otherwise(F.col("s_name"))
    p = validation.agent_problems(prompt, F.array(F.lit("a"), F.lit("b")), F.col("s_suppkey") % 120)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(p, ",").alias("problems"))


@query("fil15_validators", "SELECT event_id, array_to_string(list_filter([CASE WHEN value * 1000 NOT BETWEEN 0 AND 60000 THEN 'wait_ms' END, CASE WHEN NOT (value > 0 AND value <= 60) THEN 'delay' END, 'idempotency_key'], lambda x: x IS NOT NULL), ',') AS problems FROM events")
def fil15_validators(spark, sf_dir):
    v = F.col("value")
    p = validation.scrape_problems({"wait_ms": v * 1000, "delay": v, "idempotency_key": F.col("event_type")})
    return table(spark, sf_dir, "events").select("event_id", F.array_join(p, ",").alias("problems"))


@query("agt1_agent_answer", """SELECT agent_id, count(*) AS credits_used, coalesce(string_agg(CASE WHEN doc_id % 5 <> 0 THEN substr(coalesce(text, ''), 1, 1200) END, chr(10) || chr(10) ORDER BY doc_id), '') AS answer
FROM (SELECT source AS agent_id, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 4 GROUP BY agent_id""")
def agt1_agent_answer(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("agent_id"), F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 5 != 0, F.coalesce("text", F.lit(""))).alias("markdown"))
    return workflows.agent_answers(d, F.lit(4))


@query("agt2_agent_cancel", _sql("SELECT id, CASE WHEN status = 'queued' THEN 'cancelled' ELSE status END AS status FROM jobs"))
def agt2_agent_cancel(spark, sf_dir):
    return _frames(spark, sf_dir)[0].select("id", workflows.agent_cancelled(F.col("status")).alias("status"))


@query("dat7_session_ttl", _sql(f"SELECT id, {NOW_SQL} >= created_at + INTERVAL 600 SECOND OR coalesce({NOW_SQL} >= last_task_started_at + INTERVAL 10 SECOND, false) AS expired, {NOW_SQL} <= created_at + INTERVAL 4 HOUR AS handoff FROM jobs"))
def dat7_session_ttl(spark, sf_dir):
    e = workflows.session_expired(_now(), F.col("created_at"), F.col("last_task_started_at"), F.lit(600), F.lit(10))
    return _frames(spark, sf_dir)[0].select("id", e.alias("expired"), workflows.handoff_valid(_now(), F.col("created_at")).alias("handoff"))


@query("src4_cache_lookup", _sql(f"SELECT id, coalesce(created_at >= {NOW_SQL} - INTERVAL 30 DAY AND expires_at > {NOW_SQL} AND (id % 2 = 1 OR page_limit > 4), false) AS hit FROM jobs"))
def src4_cache_lookup(spark, sf_dir):
    j = _frames(spark, sf_dir)[0]
    cache = j.select(F.col("id").alias("cache_key"), F.col("url").alias("page"), F.col("created_at").alias("fetched_at"), "expires_at", F.when(F.col("page_limit") > 4, F.lit("s")).alias("screenshot"))
    ask = j.select("id", F.col("id").alias("cache_key"), F.lit(30 * 86_400).alias("max_age_s"), (F.col("id") % 2 == 0).alias("screenshot"))
    return workflows.cache_lookup(ask, cache, _now()).select("id", "hit")


@query("src5_cache_upsert", _sql(f"SELECT id AS cache_key, CASE WHEN id % 2 = 0 THEN 'fresh' ELSE url END AS page, epoch(CASE WHEN id % 2 = 0 THEN {NOW_SQL} + INTERVAL 7 DAY ELSE expires_at END)::BIGINT AS expires_at FROM jobs"))
def src5_cache_upsert(spark, sf_dir):
    j = _frames(spark, sf_dir)[0]
    cache = j.select(F.col("id").alias("cache_key"), F.col("url").alias("page"), F.col("created_at").alias("fetched_at"), "expires_at")
    fresh = j.where("id % 2 = 0").select(F.col("id").alias("cache_key"), F.lit("fresh").alias("page"))
    return workflows.cache_upsert(cache, fresh, _now()).select("cache_key", "page", _epoch("expires_at"))


@query("err1_taxonomy", _sql("SELECT id, CASE error_code WHEN 'fetch_failed' THEN 502 WHEN 'blocked' THEN 403 ELSE 500 END AS status, CASE error_code WHEN 'fetch_failed' THEN 'fetch_failed' WHEN 'blocked' THEN 'blocked_by_policy' ELSE 'internal_error' END AS code, coalesce(error_code = 'fetch_failed', false) AS retryable FROM tasks"))
def err1_taxonomy(spark, sf_dir):
    t = _frames(spark, sf_dir)[1].select("id", F.col("error_code").alias("kind"))
    return search.with_error(t).select("id", "status", "code", "retryable")
