"""Queries of benchmark statistics, limits and engine choice, over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import workflows
from . import query, table

SAMPLES = """SELECT event_type AS provider, 'case' || CAST(user_id % 4 AS VARCHAR) AS "case", event_id % 10 > 0 AS success, event_id % 3 > 0 AS quality_passed, (event_id % 9) / 8.0 AS quality_score, CAST(floor(value * 100) AS BIGINT) AS elapsed_ms, CASE WHEN event_id % 10 = 0 THEN 'timeout' END AS error FROM events"""
COLUMNS = """count(*) AS sample_count, count(*) FILTER (WHERE success) AS success_count, round_even(count(*) FILTER (WHERE success) / count(*), 4) AS success_rate, count(*) FILTER (WHERE quality_passed) AS quality_pass_count,
 quantile_disc(elapsed_ms, 0.5) AS p50_elapsed_ms, quantile_disc(elapsed_ms, 0.95) AS p95_elapsed_ms, quantile_disc(elapsed_ms, 0.99) AS p99_elapsed_ms, count(error) AS error_count"""
SHOWN = ("sample_count", "success_count", "success_rate", "quality_pass_count", "p50_elapsed_ms", "p95_elapsed_ms", "p99_elapsed_ms", "error_count")


def _samples(spark, sf_dir):
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("provider"),
        F.concat(F.lit("case"), (F.col("user_id") % 4).cast("string")).alias("case"),
        (n % 10 > 0).alias("success"),
        (n % 3 > 0).alias("quality_passed"),
        ((n % 9) / 8.0).alias("quality_score"),
        F.floor(F.col("value") * 100).cast("bigint").alias("elapsed_ms"),
        F.when(n % 10 == 0, F.lit("timeout")).alias("error"),
    )


@query("agg5_percentiles", f"SELECT provider, quantile_disc(elapsed_ms, 0.5) AS p50, quantile_disc(elapsed_ms, 0.95) AS p95, quantile_disc(elapsed_ms, 0.99) AS p99 FROM ({SAMPLES}) GROUP BY provider")
def agg5_percentiles(spark, sf_dir):
    cells = _samples(spark, sf_dir).groupBy("provider", "elapsed_ms").agg(F.count(F.lit(1)).alias("n"))
    return E.quantiles(cells, ["provider"], "elapsed_ms", "n", (50, 95, 99))


@query("agg6_sample_summary", f"SELECT provider, {COLUMNS}, round_even(avg(quality_score), 4) AS average_quality_score, round_even(count(*) FILTER (WHERE success) * 60000 / sum(elapsed_ms), 2) AS successful_pages_per_minute FROM ({SAMPLES}) GROUP BY provider")
def agg6_sample_summary(spark, sf_dir):
    return E.summary(_samples(spark, sf_dir), ["provider"]).select("provider", *SHOWN, "average_quality_score", "successful_pages_per_minute")


@query("agg7_rollup", f'SELECT provider, "case", {COLUMNS} FROM ({SAMPLES}) GROUP BY GROUPING SETS ((provider, "case"), (provider))')
def agg7_rollup(spark, sf_dir):
    return E.rollup(_samples(spark, sf_dir)).select("provider", "case", *SHOWN)


@query("agg8_cost", f"SELECT provider, CASE WHEN provider <> 'click' THEN round_even(count(*) * 2.5 / count(*) FILTER (WHERE success), 4) END AS cost FROM ({SAMPLES}) GROUP BY provider")
def agg8_cost(spark, sf_dir):
    price = F.when(F.col("provider") != "click", F.lit(2.5))
    g = _samples(spark, sf_dir).groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("s"))
    return g.select("provider", E.cost_per_1000(F.col("n"), F.col("s"), price).alias("cost"))


CHECKS = "SELECT 'u' || CAST(user_id AS VARCHAR) AS name, event_type AS \"check\", value > 20 AS passed FROM events"


def _checks(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), F.col("event_type").alias("check"), (F.col("value") > 20).alias("passed"))


@query("agg9_case_scores", f"SELECT name, round_even(avg(passed::INT), 4) AS score, count(*) FILTER (WHERE passed) AS passed_checks, count(*) AS total_checks FROM ({CHECKS}) GROUP BY name")
def agg9_case_scores(spark, sf_dir):
    return E.case_scores(_checks(spark, sf_dir)).drop("succeeded")


@query(
    "agg10_gates",
    f"""WITH s AS (SELECT name, round_even(avg(passed::INT), 4) AS score FROM ({CHECKS}) GROUP BY name)
SELECT 'minimum_overall_score' AS gate, avg(score) >= 0.5 AS passed, 0.5::DOUBLE AS expected, round_even(avg(score), 4)::DOUBLE AS actual, '' AS failed_cases FROM s
UNION ALL SELECT 'minimum_case_score', count(*) FILTER (WHERE score < 0.2) = 0, 0.2, count(*) FILTER (WHERE score < 0.2), coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE score < 0.2), '') FROM s
UNION ALL SELECT 'maximum_request_failures', count(*) <= 0, 0, count(*), '' FROM s""",
)
def agg10_gates(spark, sf_dir):
    return E.gates(E.case_scores(_checks(spark, sf_dir)), 0.5, 0.2, 0).withColumn("failed_cases", F.array_join("failed_cases", ","))


@query("agg3_engine_counters", "SELECT CASE WHEN event_type = 'click' THEN 'browser' ELSE 'http' END AS engine, count(*) AS pages, count(*) FILTER (WHERE event_id % 4 = 0) AS fallbacks FROM events GROUP BY 1")
def agg3_engine_counters(spark, sf_dir):
    p = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "click", F.lit("browser")).otherwise(F.col("event_type")).alias("provider"), F.when(F.col("event_id") % 4 == 0, F.lit("failed")).alias("fallback_reason"))
    return E.engine_counters(p)


@query("agg4_request_counters", "SELECT count(*) AS requests, count(*) FILTER (WHERE 200 + event_id % 400 >= 400) AS failures, sum(CAST(floor(value) AS BIGINT))::BIGINT AS latency_ms FROM events")
def agg4_request_counters(spark, sf_dir):
    return E.request_counters(table(spark, sf_dir, "events").select((200 + F.col("event_id") % 400).alias("status"), F.floor("value").cast("bigint").alias("elapsed_ms")))


@query("snk3_prometheus", "SELECT '# TYPE events_' || event_type || ' counter' || chr(10) || 'events_' || event_type || ' ' || count(*) AS text FROM events GROUP BY event_type")
def snk3_prometheus(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("value"))
    return E.prometheus(m.select(F.concat(F.lit("events_"), "event_type").alias("name"), F.lit("counter").alias("kind"), "value"))


@query("win4_rolling_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '59.999999 seconds' PRECEDING AND CURRENT ROW) AS in_window FROM events")
def win4_rolling_count(spark, sf_dir):
    return workflows.rolling_count(table(spark, sf_dir, "events"), "user_id").select("event_id", "in_window")


#: One request at a time: a list of what was let in, kept for as long as it can count.
LIMITER = """WITH RECURSIVE e AS (SELECT event_id, user_id AS k, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT k, 0::BIGINT AS i, []::BIGINT[] AS let_in, NULL::BIGINT AS event_id, '' AS decision, 0::BIGINT AS retry_after FROM (SELECT DISTINCT k FROM e)
 UNION ALL SELECT k, i, CASE WHEN decision = 'ok' THEN list_append(near, t) ELSE near END, event_id, decision, CASE WHEN decision = 'rate' THEN greatest(1, 60 - (t - list_min(minute)) // 1000000) ELSE 0 END
 FROM (SELECT *, CASE WHEN len(near) >= 2 THEN 'concurrency' WHEN len(minute) >= 1 THEN 'rate' ELSE 'ok' END AS decision
  FROM (SELECT *, list_filter(near, lambda x: t - x < 60000000) AS minute FROM (SELECT r.k, e.i, e.t, e.event_id, list_filter(r.let_in, lambda x: x + 1800000000 > e.t) AS near FROM r JOIN e ON e.k = r.k AND e.i = r.i + 1))))
SELECT event_id, decision, retry_after FROM r WHERE i > 0"""


@query("win4_limiter", LIMITER)
def win4_limiter(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), "ts", (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("active_until"))
    return workflows.limiter(e, per_minute=1, concurrency=2).select("event_id", "decision", "retry_after")


@query("win6_engine_choice", """SELECT user_id, arg_max(event_type, rk) AS engine, max(s) AS score FROM (SELECT user_id, event_type, s, row_number() OVER (PARTITION BY user_id ORDER BY s NULLS FIRST, event_id DESC) AS rk FROM (SELECT *, CASE WHEN event_id % 5 > 0 THEN value END AS s FROM events)) WHERE s IS NOT NULL GROUP BY user_id""")
def win6_engine_choice(spark, sf_dir):
    c = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("engine"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 5 > 0, F.col("value")).alias("score"), F.when(F.col("event_id") % 5 == 0, F.lit("timeout")).alias("error"))
    return E.chosen_engine(c, "user_id").where("engine is not null").select("user_id", "engine", "score")


#: Replies of every shape; {t} is a type of event, {n} a number.
REPLIES = (
    '{"data": {"title": "page {t}", "metadata": {"title": "{t}", "provider": "http", "rendered": false}, "rendered": true, "status": 2{n}}, "title": "reply", "status": 500}',
    '{"data": {"title": "{t}", "metadata": {"title": "", "provider": null}, "provider": "browser", "rendered": true}, "status": 3{n}}',
    '{"data": {"metadata": 7, "status": 0}, "title": "{t}", "provider": "tls", "rendered": true, "status": 4{n}}',
    '{"data": "text", "title": "{t}", "metadata": {"provider": "cache", "rendered": true}, "status": 5{n}}',
    '{"title": "", "metadata": {}, "rendered": false}',
    "[1]",
    "not json",
)


@query(
    "jsn6_payload",
    """SELECT event_id, CASE k WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE event_type END AS title, CASE k WHEN 0 THEN 'http' WHEN 1 THEN 'browser' WHEN 2 THEN 'tls' WHEN 3 THEN 'cache' END AS provider,
 CASE WHEN k IN (0, 4) THEN false WHEN k IN (1, 3) THEN true END AS rendered, CASE WHEN k < 4 THEN (k + 2) * 100 + 10 + event_id % 90 END AS status FROM (SELECT *, event_id % 7 AS k FROM events)""",
)
def jsn6_payload(spark, sf_dir):
    n = F.col("event_id")
    reply = F.element_at(F.array(*[F.lit(r) for r in REPLIES]), (n % 7 + 1).cast("int"))
    body = F.replace(F.replace(reply, F.lit("{t}"), F.col("event_type")), F.lit("{n}"), (10 + n % 90).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", E.payload(body).alias("p")).select("event_id", "p.title", "p.provider", "p.rendered", F.col("p.status").cast("bigint").alias("status"))


@query("set3_key_union", """SELECT event_id, array_to_string(list_filter(['/' || event_type, '/both/x', CASE WHEN event_id % 2 = 0 THEN '/n' END, CASE WHEN event_id % 3 > 0 THEN '/same' END, '/zz'], lambda x: x IS NOT NULL), ' ') AS paths FROM (SELECT event_id, '!' || event_type AS event_type FROM events)""")
def set3_key_union(spark, sf_dir):
    n = F.col("event_id")
    # Keys of either side; 1 and 1.0 differ, as do [1] and [true].
    kind = F.concat(F.lit('"!'), "event_type", F.lit('"'))
    before = F.concat(F.lit("{"), kind, F.lit(': 1, "both": {"x": 1, "y": [2]}, "n": '), F.when(n % 2 == 0, F.lit("1")).otherwise(F.lit("1.0")), F.lit(', "same": [1, {"q": null}]}'))
    after = F.concat(F.lit('{"zz": "", "both": {"y": [2], "x": 2}, "n": 1.0, "same": ['), F.when(n % 3 == 0, F.lit("1")).otherwise(F.lit("true")), F.lit(', {"q": null}]}'))
    d = workflows.json_changes(before, after)
    return table(spark, sf_dir, "events").select(n, d.alias("d")).select("event_id", F.array_join(F.transform("d", lambda x: x["path"]), " ").alias("paths"))


@query("agg12_first_seen", "SELECT user_id, event_type AS url, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) - 1 AS ord FROM events GROUP BY user_id, event_type")
def agg12_first_seen(spark, sf_dir):
    from ..operators.jobs import batch_seed

    asked = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])
    r = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(asked.alias("urls"))
    return batch_seed(r).select(F.col("crawl_id").alias("user_id"), "url", F.col("ord").cast("bigint").alias("ord"))


@query("agg13_job_health", "SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_id % 3 = 1) AS failed, count(*) FILTER (WHERE event_id % 3 = 2) AS completed, count(*) FILTER (WHERE event_id % 3 = 0) AS processing FROM events GROUP BY user_id")
def agg13_job_health(spark, sf_dir):
    from ..operators.jobs import counts

    state = F.element_at(F.array(F.lit("active"), F.lit("failed"), F.lit("completed")), (F.col("event_id") % 3 + 1).cast("int"))
    c = counts(table(spark, sf_dir, "events").select(F.col("user_id").alias("crawl_id"), state.alias("status")))
    return c.select(F.col("crawl_id").alias("user_id"), "total", "failed", "completed", (F.col("total") - F.col("failed") - F.col("completed")).alias("processing"))
