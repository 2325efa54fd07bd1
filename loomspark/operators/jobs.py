"""Crawl jobs and tasks: admission, claiming, finishing, status, expiry.

State changes are expressed as projections over snapshots: a function takes the tables as they
are and returns them as they would be. Row locks have no counterpart in a batch.

jobs: id, url, job_type, status, page_limit, max_depth, max_retries, delay_ms, max_concurrency,
cancel_requested, created_at, started_at, last_task_started_at, finished_at, expires_at.
tasks: id, crawl_id, url, dedup_key, depth, status, attempts, next_attempt_at, lease_expires_at,
created_at, started_at, finished_at, result, error_code, error_message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import numbered

# Fixed values of the queue.
LEASE_SECONDS = 90
RETRYABLE = ("fetch_failed", "render_failed", "empty_content")
ACTIVE_JOB, OPEN_TASK, ENDED_JOB = ("queued", "scraping"), ("queued", "active"), ("completed", "cancelled")


def seconds(n: Column | int) -> Column:
    return F.make_dt_interval(secs=F.lit(n) if isinstance(n, int) else n.cast("decimal(18,6)"))


def retry_delay(attempts: Column) -> Column:
    """DAT2: 5 seconds, doubled by each attempt, 300 at most."""
    return F.least(F.lit(300), 5 * F.pow(F.lit(2), F.greatest(F.least(attempts - 1, F.lit(6)), F.lit(0)))).cast("bigint")


def retention(now: Column, days: Column | int = 7) -> Column:
    """DAT1."""
    return now + F.make_dt_interval(days=F.lit(days) if isinstance(days, int) else days)


def delay_ms(delay: Column) -> Column:
    """DAT4: seconds above 0, up to 60, as whole milliseconds; null if invalid."""
    return F.when((delay > 0) & (delay <= 60), F.ceil(delay * 1000).cast("bigint"))


def whole_seconds(ms: Column) -> Column:
    """DAT5."""
    return F.greatest(F.lit(1), F.ceil(ms / 1000)).cast("bigint")


def rfc3339(ts: Column) -> Column:
    """DAT6, in UTC sessions."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def counts(tasks: DataFrame) -> DataFrame:
    """AGG1, per job."""
    return tasks.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))


def queue_depth(tasks: DataFrame) -> DataFrame:
    """AGG2."""
    return tasks.agg(F.count_if(F.col("status").isin(*OPEN_TASK)).alias("depth"))


def status(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """CRW9 without the page of results: jobs with their counts; 0 without tasks."""
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "completed", "failed")]
    return jobs.join(counts(tasks).withColumnRenamed("crawl_id", "id"), "id", "left").select("id", "url", "status", *zero)


def envelope(jobs: DataFrame, tasks: DataFrame, resource: str = "crawl", offset: int = 0, limit: int = 100) -> DataFrame:
    """JSN3: a job's status as it is sent: id, success, status (under its outer name), total,
    completed, credits_used (the pages completed), expires_at, data (the documents of this page of
    results, at most 100) and next, the path of a page after it; and all of it as JSON in body."""
    limit = max(1, min(100, limit))
    page = results(tasks, offset, limit)
    data = F.transform(F.array_sort(F.collect_list(F.when(F.col("result").isNotNull(), F.struct("position", "result")))), lambda x: x["result"])
    page = page.groupBy(F.col("crawl_id").alias("id")).agg(data.alias("_data"), F.max("next").alias("_next"))
    found = status(jobs, tasks).join(jobs.select("id", "expires_at"), "id").join(page, "id", "left")
    named = F.when(F.col("status").isin("queued", "running"), F.lit("scraping")).otherwise(F.col("status"))
    path = F.when(F.col("_next").isNotNull(), F.concat(F.lit(f"/v2/{resource}/"), F.col("id").cast("string"), F.lit("?skip="), F.col("_next").cast("string"), F.lit(f"&limit={limit}")))
    empty = F.array().cast("array<string>")
    out = found.select("id", F.lit(True).alias("success"), named.alias("status"), "total", "completed", F.col("completed").alias("credits_used"), "expires_at", F.coalesce("_data", empty).alias("data"), path.alias("next"))
    documents = F.transform("data", lambda d: F.coalesce(F.try_parse_json(d), F.parse_json(F.lit("null"))))
    body = F.struct("success", F.col("id").cast("string").alias("id"), "status", "total", "completed", F.col("credits_used").alias("creditsUsed"), rfc3339(F.col("expires_at")).alias("expiresAt"), documents.alias("data"), "next")
    return out.withColumn("body", F.to_json(body, {"ignoreNullFields": "false"}))


def results(tasks: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    """SRT1 for every job at once: the page [offset, offset + limit) of its ended tasks in order
    of finishing, nulls last, ids as tie-break; next is the offset of a page after it, if any."""
    limit = max(1, min(100, limit))
    ended = all_results(tasks)
    total = ended.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("_total"))
    page = ended.where(f"position >= {offset} and position < {offset + limit}")
    return page.join(total, "crawl_id").withColumn("next", F.when(F.col("_total") > offset + limit, F.lit(offset + limit))).drop("_total")


def all_results(tasks: DataFrame) -> DataFrame:
    """LIM3: what a client has that asks for page after page until there is no next: every ended
    task of each job, in their order, as ``position``; a table needs no paging."""
    ended = tasks.where(F.col("status").isin("completed", "failed"))
    order = [F.col("finished_at").asc_nulls_last(), F.col("id")]
    return numbered(ended, ["crawl_id"], order, "position").withColumn("position", F.col("position") - 1)


def errors(tasks: DataFrame) -> DataFrame:
    """CRW10, SRT2."""
    failed = tasks.where("status = 'failed'")
    return failed.select("crawl_id", "url", F.coalesce("error_code", F.lit("crawl_failed")).alias("code"), F.coalesce("error_message", F.lit("Crawl task failed")).alias("message"), "finished_at")


def listed_errors(tasks: DataFrame) -> DataFrame:
    """SRT2: failed tasks of each job as a client lists them: by their end, nulls last, then id;
    ``position`` from 1. A job's list may be long: see ``tables.numbered``."""
    failed = tasks.where("status = 'failed'").select("crawl_id", "id", "url", "finished_at")
    return numbered(failed, ["crawl_id"], [F.col("finished_at").asc_nulls_last(), F.col("id")], "position")


def listed_crawls(jobs: DataFrame) -> DataFrame:
    """SRT2: active crawls in the order of their creation, ``position`` from 1 in the whole list."""
    return numbered(active_crawls(jobs).withColumn("_all", F.lit(1)), ["_all"], [F.col("created_at"), F.col("id")], "position").drop("_all")


def active_crawls(jobs: DataFrame) -> DataFrame:
    """CRW11, SRT2."""
    return jobs.where((F.col("job_type") == "crawl") & F.col("status").isin(*ACTIVE_JOB) & ~F.col("cancel_requested")).orderBy("created_at", "id")


def claimable(jobs: DataFrame, tasks: DataFrame, now: Column) -> DataFrame:
    """JON1, JON2, WIN5, DAT3: tasks due now of jobs that run, aren't throttled and have a free
    slot; stale leases are due again, however often they were tried."""
    live = tasks.where((F.col("status") == "active") & (F.col("lease_expires_at") >= now)).groupBy("crawl_id").agg(F.count(F.lit(1)).alias("_busy"))
    free = jobs.where(~F.col("cancel_requested") & F.col("status").isin(*ACTIVE_JOB)).where(
        F.col("last_task_started_at").isNull() | (F.col("last_task_started_at") + seconds(F.col("delay_ms") / 1000) <= now)
    )
    free = free.join(live, free["id"] == live["crawl_id"], "left").where(F.coalesce("_busy", F.lit(0)) < F.col("max_concurrency")).select(F.col("id").alias("crawl_id"), "max_concurrency")
    due = tasks.where(((F.col("status") == "queued") & (F.col("next_attempt_at") <= now)) | ((F.col("status") == "active") & (F.col("lease_expires_at") < now)))
    return due.join(free, "crawl_id")


def claim(jobs: DataFrame, tasks: DataFrame, now: Column) -> DataFrame:
    """CRW5, JON11, WIN3: for each job, the task that would be claimed next: first by due time,
    then creation, then id (of rows that share one, by attempts and depth, so that nothing hangs
    on their order); with its attempts and lease after the claim."""
    due = claimable(jobs, tasks, now)
    first = due.groupBy("crawl_id").agg(F.min_by(F.struct(*[c for c in due.columns if c != "crawl_id"]), F.struct("next_attempt_at", "created_at", "id", "attempts", "depth")).alias("_f")).select("crawl_id", "_f.*")
    return first.select("id", "crawl_id", "url", "depth", (F.col("attempts") + 1).alias("attempts"), (now + seconds(LEASE_SECONDS)).alias("lease_expires_at"), F.coalesce("started_at", now).alias("started_at"))


def after_failure(jobs: DataFrame, tasks: DataFrame, now: Column) -> DataFrame:
    """CRW7, JON3: active tasks that carry an error_code as they stand after it: queued again
    after the delay if the error, the job and the attempts allow it, else failed."""
    j = jobs.select(F.col("id").alias("crawl_id"), "cancel_requested", "max_retries")
    again = F.col("error_code").isin(*RETRYABLE) & ~F.col("cancel_requested") & (F.col("attempts") <= F.col("max_retries"))
    return tasks.where("status = 'active' and error_code is not null").join(j, "crawl_id").select(
        "id",
        "crawl_id",
        "attempts",
        F.when(again, F.lit("queued")).otherwise(F.lit("failed")).alias("status"),
        F.when(again, now + seconds(retry_delay(F.col("attempts")))).otherwise(F.col("next_attempt_at")).alias("next_attempt_at"),
        F.when(~again, now).alias("finished_at"),
    )


def after_success(tasks: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """CRW6: tasks whose id is in ``done`` (id, result) and that are active are completed."""
    d = done.groupBy("id").agg(F.min("result").alias("_result"), F.lit(True).alias("_done"))
    hit = F.coalesce("_done", F.lit(False)) & (F.col("status") == "active")
    return tasks.join(d, "id", "left").withColumns(
        {
            "result": F.when(hit, F.col("_result")).otherwise(F.col("result")),
            "finished_at": F.when(hit, now).otherwise(F.col("finished_at")),
            "lease_expires_at": F.when(~hit, F.col("lease_expires_at")),
            "status": F.when(hit, F.lit("completed")).otherwise(F.col("status")),
        }
    ).drop("_result", "_done")


def drained(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """CRW8, JON4: running jobs without a task queued or active; failed ones don't matter."""
    return jobs.where(F.col("status").isin(*ACTIVE_JOB)).join(tasks.where(F.col("status").isin(*OPEN_TASK)).select(F.col("crawl_id").alias("id")), "id", "left_anti")


def existing(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """JON5."""
    return ids.join(jobs.select("id"), "id", "left_semi")


def cancelled(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """CRW12: only jobs queued or scraping; the first time of finishing stays."""
    asked = ids.select("id").distinct().withColumn("_asked", F.lit(True))
    hit = F.coalesce("_asked", F.lit(False)) & F.col("status").isin(*ACTIVE_JOB)
    return jobs.join(asked, "id", "left").withColumns(
        {"finished_at": F.when(hit, F.coalesce("finished_at", now)).otherwise(F.col("finished_at")), "cancel_requested": F.col("cancel_requested") | hit, "status": F.when(hit, F.lit("cancelled")).otherwise(F.col("status"))}
    ).drop("_asked")


def unexpired(jobs: DataFrame, now: Column) -> DataFrame:
    """FIL9, CRW15: jobs that the clean-up leaves."""
    return jobs.where(~(F.coalesce(F.col("expires_at") <= now, F.lit(False)) & F.col("status").isin(*ENDED_JOB)))


def cascade(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """JON9: children of parents that are still there."""
    return children.join(parents.select(F.col("id").alias(key)), key, "left_semi")


def enqueued(requests: DataFrame, now: Column, days: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """CRW1: requests (id, url, options as columns of the jobs table, any of which may be missing) to
    (jobs, tasks, refused): a queued job and its task of depth 0 for each that is admitted; the
    others with their problems. Of requests repeated with one id the first (by URL) counts."""
    from ..functions import urls
    from .validation import problems

    defaults = {"page_limit": F.lit(10), "max_depth": F.lit(2), "max_retries": F.lit(2), "delay_ms": F.lit(0).cast("bigint"), "max_concurrency": F.lit(10), "sitemap": F.lit("include"), "job_type": F.lit("crawl")}
    have = {c: F.coalesce(F.col(c), d) if c in requests.columns else d for c, d in defaults.items()}
    rows = requests.withColumns(have).withColumn("_a", urls.admitted(F.col("url")))
    rows = rows.withColumn(
        "problems",
        problems(
            (F.col("_a")["error"].isNotNull(), "url"),
            (F.col("page_limit") < 1, "page_limit"),
            (F.col("max_depth") < 0, "max_depth"),
            (F.col("max_retries") < 0, "max_retries"),
            (~F.col("delay_ms").between(0, 60_000), "delay"),
            (F.col("max_concurrency") < 1, "max_concurrency"),
            (~F.col("sitemap").isin("skip", "include", "only"), "sitemap"),
        ),
    )
    ok = first_wins(rows.where(F.size("problems") == 0), ["id"], ["url"]).where("accepted")
    none = F.lit(None).cast("timestamp")
    jobs = ok.select("id", F.col("_a")["url"].alias("url"), "job_type", F.lit("queued").alias("status"), *[c for c in defaults if c != "job_type"], F.lit(False).alias("cancel_requested"), now.alias("created_at"), none.alias("started_at"), none.alias("last_task_started_at"), none.alias("finished_at"), retention(now, days).alias("expires_at"))
    tasks = jobs.select(F.col("id").alias("crawl_id"), "url", urls.similarity_key(F.col("url")).alias("dedup_key"), F.lit(0).alias("depth"), F.lit("queued").alias("status"), F.lit(0).alias("attempts"), F.col("created_at").alias("next_attempt_at"), "created_at")
    return jobs, tasks, rows.where(F.size("problems") > 0).select("id", F.col("url"), "problems")


def uploads_used(uploads: DataFrame, uses: DataFrame, minutes: int = 15) -> DataFrame:
    """SRC21: uses (upload_id, used_at, use_id) of uploads (id, created_at, data) with ``error``: the
    first use of a complete upload within its minutes is let through (null), the others are
    ``unknown``, ``expired``, ``incomplete`` or ``consumed``. A use that is refused consumes nothing."""
    u = uploads.select(F.col("id").alias("upload_id"), F.col("created_at").alias("_since"), F.col("data").isNotNull().alias("_whole"))
    early = F.when(F.col("_since").isNull(), F.lit("unknown")).when(F.col("used_at") >= F.col("_since") + F.make_dt_interval(mins=F.lit(minutes)), F.lit("expired")).when(~F.col("_whole"), F.lit("incomplete"))
    judged = uses.join(u, "upload_id", "left").withColumn("_early", early)
    w = Window.partitionBy("upload_id", F.col("_early").isNull()).orderBy("used_at", "use_id")
    return judged.withColumn("error", F.coalesce("_early", F.when(F.row_number().over(w) > 1, F.lit("consumed")))).drop("_since", "_whole", "_early")


def first_wins(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """CRW13, CRW14, JON7, SET4: the first row of each key is accepted, others conflict."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return events.withColumn("accepted", F.row_number().over(w) == 1)


def admit(existing_tasks: DataFrame, found: DataFrame, jobs: DataFrame) -> DataFrame:
    """AGG11, JON7: found (crawl_id, url, dedup_key, depth, ord) that are new by url and key, first
    of each, while the job's tasks of any state stay below its page limit."""
    new = found.join(existing_tasks.select("crawl_id", "url"), ["crawl_id", "url"], "left_anti").join(existing_tasks.select("crawl_id", "dedup_key"), ["crawl_id", "dedup_key"], "left_anti")
    for key in ("url", "dedup_key"):
        # Aggregated before the shuffle, so a key may repeat as often as it likes.
        new = new.groupBy("crawl_id", key).agg(F.min_by(F.struct(*[c for c in found.columns if c not in ("crawl_id", key)]), F.struct("ord", "url")).alias("_f")).select("crawl_id", key, "_f.*")
    have = existing_tasks.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("_have"))
    limit = jobs.select(F.col("id").alias("crawl_id"), "page_limit").join(have, "crawl_id", "left")
    new = numbered(new, ["crawl_id"], [F.col("ord"), F.col("url")], "_at").join(limit, "crawl_id")
    return new.where(F.col("_at") + F.coalesce("_have", F.lit(0)) <= F.col("page_limit")).select(*found.columns)


def batch_seed(requests: DataFrame, urls_col: str = "urls", most: int = 1000) -> DataFrame:
    """CRW2, AGG12: first-seen URLs of each request, 1 to 1,000 of them, as tasks of depth 0."""
    urls = F.array_distinct(F.filter(F.col(urls_col), lambda u: u.isNotNull()))
    ok = F.size(urls).between(1, most)
    return requests.where(ok).select(F.col("id").alias("crawl_id"), F.posexplode(urls).alias("ord", "url"), F.lit(0).alias("depth"))
