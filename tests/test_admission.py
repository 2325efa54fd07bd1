"""Admission rules, errors, shapes, limits and redirects: every branch, with nulls."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomspark.functions import urls
from loomspark.operators import evaluation, jobs, search, validation, workflows
from loomspark.sources import feeds

T0 = datetime(2026, 1, 1, 12)


def one(spark, make, schema, row):
    return spark.createDataFrame([row], schema).select(make().alias("x")).first()["x"]


@pytest.mark.parametrize(
    "name, kind, good, bad",
    [
        ("max_concurrency", "long", [1, 2**31 - 1], [0, 2**31]),
        ("proxy", "string", ["auto", "basic", "stealth", "enhanced"], ["http://p:1", ""]),
        ("sitemap", "string", ["skip", "include", "only"], ["all"]),
        ("timeout", "long", [1_000, 300_000], [999, 300_001]),
        ("delay", "double", [0.001, 60.0], [0.0, 60.1, -1.0, float("nan")]),
        ("idempotency_key", "string", ["7c9e6679-7425-40de-944b-e07fc1f90ae7", "7C9E6679742540DE944BE07FC1F90AE7", "{7c9e6679-7425-40de-944b-e07fc1f90ae7}", "urn:uuid:7c9e6679-7425-40de-944b-e07fc1f90ae7"], ["x", "7c9e6679-7425-40de944be07fc1f90ae7", ""]),
        ("remove_base64_images", "boolean", [True], [False]),
        ("fast_mode", "boolean", [False], [True]),
        ("block_ads", "boolean", [True], [False]),
        ("store_in_cache", "boolean", [True], [False]),
        ("mobile", "boolean", [False], [True]),
        ("max_age", "long", [14_400_000], [0, 1]),
        ("zero_data_retention", "boolean", [False], [True]),
    ],
)
def test_options(spark, name, kind, good, bad):
    rows = spark.createDataFrame([(v,) for v in [None, *good, *bad]], f"v {kind}").select("v", validation.scrape_problems({name: F.col("v")}).alias("p")).collect()
    assert [r["p"] for r in rows] == [[]] * (1 + len(good)) + [[name]] * len(bad)


def test_unknown_options_are_errors(spark):
    with pytest.raises(ValueError):
        validation.scrape_problems({"colour": F.lit(1)})


def test_actions_that_are_no_list(spark):
    df = spark.createDataFrame([(None,), ("",), ("[]",), ("nonsense",)], "a string")
    assert [r[0] for r in df.select(validation.action_problem(F.col("a"), F.lit(1_000), F.lit(None).cast("long"))).collect()] == [None] * 4
    assert df.select(validation.action_problem(F.lit("[]"), F.lit(1_000), F.lit(1_001))).first()[0] == "action waits exceed the request timeout"


@pytest.mark.parametrize("formats", [["markdown", "json"], [{"type": "screenshot", "fullPage": True}], [{"type": "question", "question": "who?"}], [{"type": "attributes", "selectors": [{"selector": "a", "attribute": "href"}]}], []])
def test_formats(formats):
    assert [n for n, _ in validation.format_options(formats)] == [f if isinstance(f, str) else f["type"] for f in formats]


@pytest.mark.parametrize("formats", [["MARKDOWN"], [3], [{"kind": "json"}], [{"type": "screenshot", "x": 1}], [{"type": "screenshot", "viewport": {"width": 0, "height": 5}}], [{"type": "screenshot", "fullPage": 1}], [{"type": "highlights"}], [{"type": "attributes", "selectors": []}], ["screenshot", {"type": "screenshot"}]])
def test_wrong_formats(formats):
    with pytest.raises(ValueError):
        validation.format_options(formats)


def test_admission_of_monitors_and_agents(spark):
    blank = spark.createDataFrame([(None,), ("",), (" \t\n",), ("x" * 201,), ("é" * 101,), ("ok",)], "n string")
    assert [r[0] for r in blank.select(validation.monitor_problems(F.col("n"), F.lit(60), F.lit("a.org"))).collect()] == [["name"]] * 5 + [[]]
    assert blank.select(validation.monitor_problems(F.lit("n"), F.lit(59), F.lit("http://10.0.0.1"), F.lit("wrong"))).first()[0] == ["schedule", "url", "webhook"]
    assert [r[0] for r in blank.select(validation.agent_problems(F.col("n"), F.lit(None).cast("array<string>"), F.lit(1))).collect()][:3] == [["prompt"]] * 3
    assert blank.select(validation.agent_problems(F.lit("p"), F.array(F.lit("a.org"), F.lit("")), F.lit(1))).first()[0] == ["credits", "source"]


def test_every_error_has_its_code(spark):
    kinds = [k for k, *_ in search.ERRORS]
    got = {r["kind"]: r for r in search.with_error(spark.createDataFrame([(k, "why") for k in [*kinds, "?", None]], "kind string, d string"), detail="d").collect()}
    assert len(got) == len(kinds) + 2
    assert {k: (got[k]["status"], got[k]["code"]) for k in ("conflict", "storage_unavailable", "storage_failed", "invalid_crawl", "llm_provider", "llm_key", "llm_response")} == {
        "conflict": (409, "idempotency_key_already_used"),
        "storage_unavailable": (503, "crawl_storage_unavailable"),
        "storage_failed": (500, "crawl_storage_failed"),
        "invalid_crawl": (400, "invalid_crawl_request"),
        "llm_provider": (400, "unsupported_llm_provider"),
        "llm_key": (400, "missing_llm_api_key"),
        "llm_response": (502, "llm_response_invalid"),
    }
    assert {k for k in got if got[k]["retryable"]} == {"fetch_failed", "render_failed", "storage_unavailable", "storage_failed", "llm_failed", "workflow"}
    assert got["?"]["body"] == got[None]["body"] == '{"detail":"why"}' and got["invalid_request"]["body"] == '{"success":false,"error":"why"}'
    assert got["fetch_failed"]["body"] == '{"detail":{"code":"fetch_failed","message":"fetch_failed: why","retryable":true}}'


def test_changes_tell_kinds_apart(spark):
    df = spark.createDataFrame([("1", "1.0"), ("[1]", "[true]"), ('{"a": [{"b": 1}]}', '{"a": [{"b": 1}]}'), ('{"a": 0}', '{"a": false}'), ("null", None), ('{"a": null}', "{}")], "a string, b string")
    got = [[x["path"] for x in r[0]] for r in df.select(workflows.json_changes(F.col("a"), F.col("b"))).collect()]
    assert got == [["/"], ["/"], [], ["/a"], [], []]


def test_limiter_with_null_keys_and_ties(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [(None, at(0), 1), (None, at(0), 2), (None, at(5), 3), (7, at(0), 4), (7, at(60), 5), (7, None, 6), (8, at(1), 7)]
    df = spark.createDataFrame(rows, "key int, ts timestamp, n int").withColumn("active_until", F.lit(None).cast("timestamp"))
    got = {r["n"]: r for r in workflows.limiter(df, per_minute=1).collect()}
    assert [got[n]["decision"] for n in (3, 4, 5, 6, 7)] == ["rate", "ok", "ok", "rate", "ok"]
    assert sorted(got[n]["decision"] for n in (1, 2)) == ["ok", "rate"] and got[3]["retry_after"] == 55
    assert {type(got[n]["key"]) for n in (4, 5)} == {int} and got[1]["key"] is None
    again = {r["n"]: r["decision"] for r in workflows.limiter(df.repartition(5), per_minute=1).collect()}
    assert again == {n: r["decision"] for n, r in got.items()}


def test_redirects_end(spark):
    hop = lambda i: f"https://a.org/{i}"
    pages = spark.createDataFrame([(hop(i), 301, f"/{i + 1}", None) for i in range(12)] + [(hop(12), 200, None, "end"), (hop(50), 302, "http://localhost/", None), (hop(51), 302, None, "x")], "url string, status int, location string, html string")
    got = {r["url"]: (r["final_url"], r["html"], r["error"], r["message"]) for r in feeds.fetched(pages, spark.createDataFrame([(u,) for u in (hop(0), hop(2), hop(12), hop(50), hop(51), hop(99), "", "http://10.0.0.1/")], "url string")).collect()}
    assert got[hop(0)] == (hop(10), None, "fetch_failed", "too many redirects") and got[hop(2)] == (hop(12), "end", None, None) and got[hop(12)][1] == "end"
    assert got[hop(50)][2:] == ("blocked_by_policy", "Localhost URLs are not allowed") and got[hop(51)][3] == "HTTP 302" and got[hop(99)][3] == "no such page"
    assert got[""][2] == "invalid_url" and got["http://10.0.0.1/"][2] == "blocked_by_policy" and len(got) == 8


def test_report_keeps_its_order(spark, tmp_path):
    df = spark.createDataFrame([(i, f"a|b\n{i}") for i in range(300)], "n int, t string").repartition(5)
    feeds.report(df, str(tmp_path), ["n"])
    lines = [line for f in sorted((tmp_path / "summary").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines[:3] == ["| n | t |", "| --- | --- |", "| 0 | a\\|b 0 |"] and [int(x.split(" | ")[0][2:]) for x in lines[2:]] == list(range(300))
    assert spark.read.json(str(tmp_path / "report")).first()["rows"] == 300 and spark.read.json(str(tmp_path / "samples")).count() == 300


def test_gates_name_the_first_failed_cases(spark):
    scores = spark.createDataFrame([(f"c{i:03}", i / 100, True) for i in range(100)], "name string, score double, succeeded boolean")
    got = {r["gate"]: r for r in evaluation.gates(scores, 0.1, 0.5, 0, names=3).collect()}
    assert got["minimum_case_score"]["failed_cases"] == ["c000", "c001", "c002"] and got["minimum_case_score"]["actual"] == 50
    assert [r["passed"] for r in evaluation.gates(scores.limit(0), 0.0, 0.5, 0).collect()] == [True, True, True]


def test_uploads(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    uploads = spark.createDataFrame([(1, T0, "x"), (2, T0, None)], "id int, created_at timestamp, data string")
    uses = spark.createDataFrame([(1, at(15), 1), (1, at(14), 2), (1, at(14), 3), (2, at(1), 4), (3, at(1), 5), (None, at(1), 6)], "upload_id int, used_at timestamp, use_id int")
    assert {r["use_id"]: r["error"] for r in jobs.uploads_used(uploads, uses).collect()} == {1: "expired", 2: None, 3: "consumed", 4: "incomplete", 5: "unknown", 6: "unknown"}


def test_engines_by_capacity(spark):
    rows = [("p", 0, "http://a/", 2), ("p", 1, "http://b", None), ("p", 2, "http://c", 5), ("p", 3, "http://d", 2), ("p", 4, " ", 9), (None, 0, "http://e", 0)]
    got = [(r["url"], r["rank"]) for r in search.ranked_engines(spark.createDataFrame(rows, "pool string, ord int, url string, available_pages int")).where("pool = 'p'").orderBy("rank").collect()]
    assert [u for u, _ in got] == ["http://c", "http://a", "http://d", "http://b"]


def test_ip6_of_nulls(spark):
    assert spark.createDataFrame([(None,), ("",)], "a string").select(urls.public_ip(F.col("a"))).distinct().collect() == [(None,)]


def test_envelope_pages(spark):
    tasks = spark.createDataFrame([(i, 1, "completed" if i % 2 else "failed", T0 + timedelta(seconds=i), '{"n": %d}' % i if i % 2 else None) for i in range(1, 6)], "id long, crawl_id long, status string, finished_at timestamp, result string")
    jobs_ = spark.createDataFrame([(1, "u", "queued", T0), (2, "v", "completed", None)], "id long, url string, status string, expires_at timestamp")
    got = {r["id"]: r for r in jobs.envelope(jobs_, tasks, "batch/scrape", 0, 3).collect()}
    assert got[1]["body"] == '{"success":true,"id":"1","status":"scraping","total":5,"completed":3,"creditsUsed":3,"expiresAt":"2026-01-01T12:00:00Z","data":[{"n":1},{"n":3}],"next":"/v2/batch/scrape/1?skip=3&limit=3"}'
    assert got[2]["data"] == [] and got[2]["next"] is None and '"expiresAt":null' in got[2]["body"]
