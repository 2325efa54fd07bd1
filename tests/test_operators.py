"""Jobs, crawl expansion, monitors, limits, evaluation."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspark.operators import evaluation, frontier, jobs, search, tables, workflows

T0 = datetime(2026, 1, 1, 12)
TASK = "id long, crawl_id long, url string, status string, attempts int, next_attempt_at timestamp, lease_expires_at timestamp, created_at timestamp, started_at timestamp, finished_at timestamp, result string, error_code string, error_message string, dedup_key string, depth int"
JOB = "id long, url string, job_type string, status string, page_limit int, max_depth int, max_retries int, delay_ms long, max_concurrency int, cancel_requested boolean, created_at timestamp, last_task_started_at timestamp, finished_at timestamp, expires_at timestamp"


def task(i, status, attempts=0, due=0, lease=None, finished=None, error=None, crawl=1):
    at = lambda s: None if s is None else T0 + timedelta(seconds=s)
    return (i, crawl, f"u{i}", status, attempts, at(due), at(lease), T0, None, at(finished), None, error, None, f"k{i}", 0)


def job(i=1, status="scraping", limit=10, retries=1, delay=0, slots=2, cancel=False, last=None, expires=None):
    at = lambda s: None if s is None else T0 + timedelta(seconds=s)
    return (i, "u", "crawl", status, limit, 2, retries, delay, slots, cancel, T0, at(last), None, at(expires))


@pytest.fixture(autouse=True)
def now(spark):
    """A column can only be made where there's a session."""
    global NOW
    NOW = F.lit(T0)


def test_pages_of_results(spark):
    t = spark.createDataFrame([task(1, "completed", finished=3), task(2, "failed", finished=1), task(3, "completed"), task(4, "queued")], TASK)
    first = jobs.results(t, 0, 2).orderBy("position").collect()
    assert [(r["id"], r["next"]) for r in first] == [(2, 2), (1, 2)]
    assert [(r["id"], r["next"]) for r in jobs.results(t, 2, 2).collect()] == [(3, None)]
    assert jobs.counts(t).first()[1:] == (4, 2, 1)


def test_claim_heeds_throttle_slots_and_leases(spark):
    t = spark.createDataFrame([task(1, "queued", due=-5), task(2, "queued", due=-9), task(3, "active", 7, lease=-1, due=-1), task(4, "queued", due=9)], TASK)
    claim = lambda j: [tuple(r[:1]) for r in jobs.claim(spark.createDataFrame([j], JOB), t, NOW).collect()]
    assert claim(job()) == [(2,)]
    assert claim(job(delay=2000, last=-1)) == [] and claim(job(delay=2000, last=-2)) == [(2,)]
    assert claim(job(cancel=True)) == [] and claim(job(status="completed")) == []
    busy = spark.createDataFrame([task(1, "queued", due=-5), task(2, "active", lease=60)], TASK)
    assert jobs.claim(spark.createDataFrame([job(slots=1)], JOB), busy, NOW).count() == 0


def test_failures_are_tried_again_then_fail(spark):
    t = spark.createDataFrame([task(1, "active", 1, error="fetch_failed"), task(2, "active", 2, error="fetch_failed"), task(3, "active", 1, error="blocked")], TASK)
    got = {r["id"]: (r["status"], r["finished_at"] is None) for r in jobs.after_failure(spark.createDataFrame([job(retries=1)], JOB), t, NOW).collect()}
    assert got == {1: ("queued", True), 2: ("failed", False), 3: ("failed", False)}
    assert [r[0] for r in spark.createDataFrame([(n,) for n in (1, 2, 7, 9)], "n int").select(jobs.retry_delay(F.col("n"))).collect()] == [5, 10, 300, 300]


def test_completion_cancel_expiry(spark):
    j = spark.createDataFrame([job(1), job(2), job(3, "completed", expires=-1), job(4, "queued", expires=-1)], JOB)
    t = spark.createDataFrame([task(1, "failed"), task(2, "queued", crawl=2), task(3, "completed", crawl=3)], TASK)
    assert sorted(r["id"] for r in jobs.drained(j, t).collect()) == [1, 4]
    left = jobs.unexpired(j, NOW)
    assert sorted(r["id"] for r in left.collect()) == [1, 2, 4] and jobs.cascade(left, t, "crawl_id").count() == 2
    off = {r["id"]: r["status"] for r in jobs.cancelled(j, j.select("id"), NOW).collect()}
    assert off == {1: "cancelled", 2: "cancelled", 3: "completed", 4: "cancelled"}


def test_idempotency(spark):
    e = spark.createDataFrame([("k", 2), ("k", 1), ("l", 3)], "key string, at int")
    assert sorted((r["at"], r["accepted"]) for r in jobs.first_wins(e, ["key"], ["at"]).collect()) == [(1, True), (2, False), (3, True)]


def test_crawl_by_breadth(spark):
    page = lambda u, *links: (f"https://a.com{u}", [f"https://a.com{x}" for x in links])
    pages = spark.createDataFrame([page("/", "/b", "/c", "/b/", "https://x"), page("/b", "/d", "/"), page("/c", "/e"), page("/d", "/f")], "url string, links array<string>")
    seed = lambda depth, limit: spark.createDataFrame([(1, "https://a.com/", limit, depth)], "id long, url string, page_limit int, max_depth int")
    urls = lambda depth, limit, **o: [(r["url"][13:], r["depth"]) for r in frontier.crawl(pages, seed(depth, limit), **o).orderBy("ord").collect()]
    assert urls(2, 10) == [("/", 0), ("/b", 1), ("/c", 1)] + [x for x in urls(2, 10) if x[1] == 2]
    assert urls(2, 10, entire_domain=True) == [("/", 0), ("/b", 1), ("/c", 1), ("/d", 2), ("/e", 2)]
    assert urls(3, 4, entire_domain=True) == [("/", 0), ("/b", 1), ("/c", 1), ("/d", 2)]
    assert urls(3, 9, entire_domain=True, exclude=["^/c"]) == [("/", 0), ("/b", 1), ("/d", 2), ("/f", 3)]


def one_by_one(links, rules, start, limit, deepest, below):
    """A crawl that works off its tasks one after the other."""
    tasks = [(start, 0, rules(start))]
    for url, depth, ok in tasks:
        if depth >= deepest or not ok:
            continue
        own = [x for x in dict.fromkeys(links.get(url, [])[:limit]) if not below or x[13:].startswith(url[13:])] or [url]
        for link in own[:limit]:
            if link not in [t[0] for t in tasks] and len(tasks) < limit:
                tasks.append((link, depth + 1, rules(link)))
    return tasks


@pytest.mark.parametrize("below", [False, True])
def test_crawl_goes_as_a_queue_does(spark, below):
    """Order of discovery to any depth, page limits, robots and the scope of the current page."""
    rng = random.Random(3 + below)
    names = [""] + [f"{a}{b}" for a in "abc" for b in ["", *"1234"]] + [f"{a}1/{b}" for a in "abc" for b in range(6)]
    site = [f"https://a.com/{n}" for n in names]
    links = {u: [rng.choice(site) for _ in range(rng.randint(0, 6))] for u in site[:-4]}
    pages = spark.createDataFrame(list(links.items()), "url string, links array<string>").repartition(3)
    jobs = [(n, rng.choice(site[:9]), rng.choice([1, 3, 7, 12, 30]), rng.choice([0, 1, 2, 5, 5])) for n in range(30)]
    files = spark.createDataFrame([("https://a.com/robots.txt", "User-agent: *\nDisallow: /b3\nDisallow: /a1/\nAllow: /a1/2$\nDisallow: /c*4\n")], "url string, body string")
    refused = lambda u: (f := u[14:]).startswith("b3") or (f + "/").startswith("a1/") or (f.startswith("c") and "4" in f)
    got = frontier.crawl(pages, spark.createDataFrame(jobs, "id long, url string, page_limit int, max_depth int"), entire_domain=not below, robots=files).collect()
    for n, start, limit, deepest in jobs:
        own = sorted((r for r in got if r["crawl_id"] == n), key=lambda r: r["ord"])
        want = one_by_one(links, lambda u: not refused(u), start, limit, deepest, below)
        assert [(r["url"], r["depth"], r["error"] is None) for r in own] == want
        assert [r["ord"] for r in own] == list(range(1, len(want) + 1))


def test_what_a_round_writes_hangs_on_its_new_rows(spark):
    """Adding to a set writes a bitmap of fixed size; asking gives exactly what isn't in it."""
    seen, size = tables.SeenSet(["a", "b"]), []
    for n in range(4):
        rows = tables.written(spark.range(n * 2000, n * 2000 + 3000).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 500 > 0, F.col("id").cast("string")).alias("b")), "rows")
        new = {(r["a"], r["b"]) for r in seen.new(rows).collect()}
        want = {(i % 7, str(i) if i % 500 else None) for i in range(n * 2000, n * 2000 + 3000)} - {(i % 7, str(i) if i % 500 else None) for m in range(n) for i in range(m * 2000, m * 2000 + 3000)}
        assert new == want
        seen.add(rows)
        size.append(seen.bits.agg(F.sum(F.length("_bits"))).first()[0])
    assert max(size) <= tables.BITS // 8


def test_numbers_of_a_hot_key(spark):
    """A key with most of the rows lies in several ranges, and its numbers are those of one window."""
    rows = spark.range(5000).select(F.when(F.col("id") % 5 > 0, F.lit("hot")).when(F.col("id") % 10 > 0, (F.col("id") % 40).cast("string")).alias("k"), F.pmod(F.hash("id"), F.lit(900)).alias("o"), "id")
    got = tables.numbered(rows, ["k"], [F.col("o").desc(), F.col("id")], "n")
    w = Window.partitionBy("k").orderBy(F.desc("o"), "id")
    assert sorted(tuple(r) for r in got.select("id", "n").collect()) == sorted(tuple(r) for r in rows.select("id", F.row_number().over(w)).collect())
    where = tables.written(rows.repartitionByRange(4, F.col("k"), F.col("o").desc(), F.col("id")).select("k", F.spark_partition_id().alias("p")), "where")
    assert where.where("k = 'hot'").select("p").distinct().count() > 1


def test_monitor_diffs(spark):
    c = spark.createDataFrame([(1, 1, 1, "alpha\nbeta", '{"title": "a", "n": [1]}'), (1, 2, 2, "alpha\ngamma", '{"title": "b", "n": [1]}'), (1, 3, 3, "alpha\ngamma", '{"title": "b", "n": [1]}')], "monitor_id int, finished_at int, id int, text string, json string")
    got = workflows.check_diffs(c).orderBy("id").collect()
    assert [[x["path"] for x in r["json_diff"]] for r in got] == [["/n", "/title"], ["/title"], []]
    assert got[1]["text_diff"].endswith("-beta\n+gamma") and [r["changed"] for r in got] == [True, True, False]


def test_limiter_forgets_what_it_rejects(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    r = spark.createDataFrame([("k", at(0), at(1)), ("k", at(5), at(6)), ("k", at(30), at(31)), ("k", at(59), at(60)), ("k", at(60), at(61)), ("l", at(0), at(50)), ("l", at(1), at(50))], "key string, ts timestamp, active_until timestamp")
    got = workflows.limiter(r, per_minute=2, concurrency=1).orderBy("key", "ts").collect()
    assert [(x["decision"], x["retry_after"]) for x in got] == [("ok", 0), ("ok", 0), ("rate", 30), ("rate", 1), ("ok", 0), ("ok", 0), ("concurrency", 0)]


def test_summary_percentiles_and_gates(spark):
    s = spark.createDataFrame([("p", "c", True, True, 1.0, 100, None), ("p", "c", True, True, 0.9, 200, None), ("p", "c", False, False, 0.5, 300, "x")], "provider string, case string, success boolean, quality_passed boolean, quality_score double, elapsed_ms long, error string")
    r = evaluation.summary(s, ["provider"]).first()
    assert (r["p50_elapsed_ms"], r["p95_elapsed_ms"], r["success_rate"], r["average_quality_score"], r["successful_pages_per_minute"]) == (200, 300, 0.6667, 0.8, 200.0)
    assert evaluation.rollup(s).count() == 2
    checks = spark.createDataFrame([("ok", "request_succeeded", True), ("weak", "request_succeeded", True), ("weak", "x", False)], "name string, check string, passed boolean")
    got = {x["gate"]: (x["passed"], x["actual"], x["failed_cases"]) for x in evaluation.gates(evaluation.case_scores(checks), 0.7, 0.6, 0).collect()}
    assert got == {"minimum_overall_score": (True, 0.75, []), "minimum_case_score": (False, 1.0, ["weak"]), "maximum_request_failures": (True, 0.0, [])}


def test_engine_choice(spark):
    c = spark.createDataFrame([("u", "browser", 0, 0.5, None), ("u", "http", 1, 0.5, None), ("v", "browser", 0, None, "down"), ("v", "http", 1, 0.1, None), ("w", "browser", 0, None, "a"), ("w", "http", 1, None, "b")], "url string, engine string, ord int, score double, error string")
    got = {r["url"]: (r["engine"], r["fallback_reason"], r["error"]) for r in evaluation.chosen_engine(c).collect()}
    assert got == {"u": ("browser", None, None), "v": ("http", "down", None), "w": (None, None, "a; b")}


def test_sessions_and_cache(spark):
    row = spark.range(1).select(workflows.session_expired(NOW, F.lit(T0 - timedelta(seconds=11)), F.lit(T0 - timedelta(seconds=11)), F.lit(60), F.lit(10)).alias("a"), workflows.session_expired(NOW, NOW, NOW, F.lit(60), F.lit(10)).alias("b"), workflows.handoff_valid(NOW, F.lit(T0 - timedelta(hours=4))).alias("c")).first()
    assert tuple(row) == (True, False, True)
    cache = spark.createDataFrame([("k", "page", T0 - timedelta(seconds=50), T0 + timedelta(days=1), None)], "cache_key string, page string, fetched_at timestamp, expires_at timestamp, screenshot string")
    ask = spark.createDataFrame([("k", 60, False), ("k", 40, False), ("k", 60, True), ("z", 60, False)], "cache_key string, max_age_s int, screenshot boolean")
    assert sorted(r["hit"] for r in workflows.cache_lookup(ask, cache, NOW).collect()) == [False, False, False, True]


def test_whole_concatenation_cuts_nothing(spark):
    from loomspark import plans

    sf = "/root/testdata/sf0.001"
    rows = sorted((r["source"], r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("source", "doc_id", "text").collect())
    want = {}
    for source, doc_id, t in rows:
        want.setdefault(source, []).append(f"# Source: {source}/{doc_id}\n\n{t}")
    want = {k: "\n\n---\n\n".join(v) for k, v in want.items()}
    assert max(map(len, want.values())) > 24_000
    got = {}
    for r in plans.QUERIES["str9_whole_concatenation"](spark, sf).orderBy("ord", "tie").collect():
        got[r["source"]] = got.get(r["source"], "") + r["section"]
    assert got == want


def test_sections_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(k, o, u, "m") for k in ("a", None) for o, u in ((2, "x"), (1, "z"), (1, "y"), (1, "y"), (None, "w"))] + [("n", None, "v", "m")], "k string, ord int, url string, markdown string")
    got = {}
    for r in search.sections(df, "k").orderBy(F.asc_nulls_last("ord"), "tie").collect():
        got[r["k"]] = got.get(r["k"], "") + r["section"]
    of = lambda *urls: "\n\n---\n\n".join(f"# Source: {u}\n\nm" for u in urls)
    assert got == {"a": of(*"yyzxw"), None: of(*"yyzxw"), "n": of("v")}


def test_limiter_in_segments_decides_as_one_fold(spark):
    """A key with most requests is cut where nothing counts any more, and decisions stay the same."""
    rng, rows = random.Random(12), []
    for key, n, gap in (("hot", 900, 400), ("busy", 200, 20), (None, 30, 90)):
        now = 0.0
        for _ in range(n):
            now += rng.expovariate(1) * (gap if rng.random() < 0.2 else 3)
            at = T0 + timedelta(seconds=round(now, 3))
            rows.append((key, at, at + timedelta(seconds=rng.choice([1, 30, 200])) if rng.random() < 0.9 else None, len(rows)))
    df = spark.createDataFrame(rows, "key string, ts timestamp, active_until timestamp, n int").repartition(3)
    ask = dict(per_minute=4, concurrency=3)
    small, whole = (sorted(map(tuple, workflows.limiter(df, span_s=s, **ask).select("n", "decision", "retry_after").collect())) for s in (60, 10**9))
    assert small == whole and {d for _, d, _ in small} == {"ok", "rate", "concurrency"}
    micros = lambda c: F.unix_micros(c)
    spans = workflows.segments(df.select(F.col("key").alias("_key"), micros("ts").alias("_at"), micros("active_until").alias("_until"), F.floor(micros("ts") / 60_000_000).alias("_span")))
    assert spans.where("_k = 'hot'").select("_segment").distinct().count() > 20


def test_quantiles_by_selection(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, rng.randint(-5, 5), rng.randint(0, 10**9), 7])) for k in ("a", "b", None) for _ in range(rng.randint(1, 400))] + [("one", 3), ("none", None)]
    cells = spark.createDataFrame(rows, "k string, v bigint").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    got = {r["k"]: r for r in evaluation.quantiles(cells, ["k"], "v", "n", (1, 50, 95, 99, 100)).collect()}
    for k in {r[0] for r in rows} - {"none"}:
        own = sorted(v for x, v in rows if x == k and v is not None)
        for p in (1, 50, 95, 99, 100):
            assert got[k][f"p{p}"] == own[max(0, -(-p * len(own) // 100) - 1)], (k, p)
    assert "none" not in got


def test_claims_of_tasks_that_share_an_id_hang_on_no_order(spark):
    t = "timestamp'1995-06-01'"
    j = spark.sql(f"SELECT 1L AS id, false AS cancel_requested, 'queued' AS status, {t} AS last_task_started_at, 0L AS delay_ms, 1 AS max_concurrency")
    rows = spark.range(8).selectExpr("7L AS id", "1L AS crawl_id", "'u' AS url", "1 AS depth", "'queued' AS status", "cast((id * 3 + 2) % 8 as int) AS attempts", f"{t} AS next_attempt_at", f"{t} AS created_at", f"{t} AS lease_expires_at", f"{t} AS started_at")
    claimed = [jobs.claim(j, rows.coalesce(1).orderBy(o), F.expr("timestamp'1995-06-15'")).first()["attempts"] for o in (F.asc("attempts"), F.desc("attempts"))]
    assert claimed == [1, 1]
