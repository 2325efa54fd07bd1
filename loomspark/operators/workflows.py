"""Monitors, agents, sessions, limits and the snapshot cache."""

from __future__ import annotations

import heapq
import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as X
from .jobs import seconds

# Monitors.


def with_previous(checks: DataFrame) -> DataFrame:
    """WIN1, JON6: completed checks (monitor_id, finished_at, id, text, json) with the text and
    JSON of the completed one before, ``''`` and ``{}`` for the first. Where there's a column
    ``status``, checks of another status neither come out nor count."""
    if "status" in checks.columns:
        checks = checks.where("status = 'completed'")
    w = Window.partitionBy("monitor_id").orderBy("finished_at", "id")
    return checks.withColumns({"before_text": F.coalesce(F.lag("text").over(w), F.lit("")), "before_json": F.coalesce(F.lag("json").over(w), F.lit("{}"))})


def _alike(a: object, b: object) -> bool:
    """Equal in value and kind, also inside arrays: 1, 1.0 and true are three values."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if type(x) is not type(y):
            return False
        if isinstance(x, list):
            if len(x) != len(y):
                return False
            todo += zip(x, y, strict=True)
        elif isinstance(x, dict):
            if x.keys() != y.keys():
                return False
            todo += [(v, y[k]) for k, v in x.items()]
        elif x != y:
            return False
    return True


def _changes(before: object, after: object) -> list[dict]:
    """JSN1, with an explicit stack."""
    out, todo = [], [("", before, after)]
    while todo:
        path, a, b = todo.pop()
        if isinstance(a, dict) and isinstance(b, dict):
            todo += [(f"{path}/{k}", a.get(k), b.get(k)) for k in sorted({*a, *b}, reverse=True)]
        elif not _alike(a, b):
            out.append({"path": path or "/", "before": json.dumps(a), "after": json.dumps(b)})
    return out


def json_changes(before: Column, after: Column) -> Column:
    """JSN1: array of (path, before, after) of two JSON texts; what isn't JSON is null. Objects are
    compared key by key, sorted; arrays as wholes; a missing key is null."""
    kind = pa.list_(pa.struct([("path", pa.string()), ("before", pa.string()), ("after", pa.string())]))

    def read(s: str | None) -> object:
        try:
            return None if s is None else json.loads(s)
        except ValueError:
            return None

    @F.arrow_udf("array<struct<path: string, before: string, after: string>>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([_changes(read(x), read(y)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], kind)

    return run(before, after)


def check_diffs(checks: DataFrame) -> DataFrame:
    """MON2."""
    d = with_previous(checks).withColumns({"text_diff": X.line_diff(F.col("before_text"), F.col("text")), "json_diff": json_changes(F.col("before_json"), F.col("json"))})
    return d.withColumn("changed", (F.col("text_diff") != "") | (F.size("json_diff") > 0))


def due(monitors: DataFrame, now: Column) -> DataFrame:
    """MON1: monitors that are due, with their next run counted from now."""
    return monitors.where(F.col("enabled") & (F.col("next_run_at") <= now)).withColumn("next_run_at", now + seconds(F.col("schedule_seconds")))


def updated(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """MON3: each column of changes that isn't null replaces the row's."""
    c = changes.select(key, *[F.col(x).alias(f"_{x}") for x in changes.columns if x != key])
    return rows.join(c, key, "left").select(*[F.coalesce(f"_{x}", x).alias(x) if f"_{x}" in c.columns else F.col(x) for x in rows.columns])


def latest(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """WIN2, MON5, SRC5: the newest n rows of each key, order columns descending."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def owned(rows: DataFrame, credential: Column) -> DataFrame:
    """FIL10: rows whose ``owner_key`` is that of the credential; without one, those of nobody."""
    return rows.where(F.col("owner_key") == X.owner_key(credential))


def run_checks(monitors: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """MON5: requests (monitor_id, check_id, credential) to queued checks (id, monitor_id, status,
    created_at), for monitors (id, owner_key) of that owner only."""
    m = monitors.select(F.col("id").alias("monitor_id"), "owner_key")
    own = requests.join(m, "monitor_id").where(F.col("owner_key") == X.owner_key(F.col("credential")))
    return own.select(F.col("check_id").alias("id"), "monitor_id", F.lit("queued").alias("status"), now.alias("created_at"))


def check_history(monitors: DataFrame, checks: DataFrame, credential: Column, n: int = 100) -> DataFrame:
    """MON5: the owner's checks, newest first, the last n of each monitor, with their position."""
    own = checks.join(owned(monitors, credential).select(F.col("id").alias("monitor_id")), "monitor_id", "left_semi")
    w = Window.partitionBy("monitor_id").orderBy(F.desc("created_at"), F.desc("id"))
    return own.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


# Agents.


def agent_answers(pages: DataFrame, budget: Column, chars: int = 1200) -> DataFrame:
    """AGT1: pages (agent_id, ord, markdown or null on error): the first ``budget`` sources of each
    agent count as used, errors too; the answer joins the beginnings of those that came."""
    w = Window.partitionBy("agent_id").orderBy("ord")
    used = pages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= budget)
    parts = F.array_sort(F.collect_list(F.when(F.col("markdown").isNotNull(), F.struct("ord", F.substring("markdown", 1, chars).alias("t")))))
    return used.groupBy("agent_id").agg(F.count(F.lit(1)).alias("credits_used"), F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("answer"))


def agent_cancelled(status: Column) -> Column:
    """AGT2: what is queued is cancelled at once, what runs at its next page."""
    return F.when(status == "queued", F.lit("cancelled")).otherwise(status)


# Sessions.


def session_expired(now: Column, created_at: Column, last_activity: Column, ttl: Column, activity_ttl: Column) -> Column:
    """DAT7: either time is up, both inclusive."""
    return (now >= created_at + seconds(ttl)) | F.coalesce(now >= last_activity + seconds(activity_ttl), F.lit(False))


def handoff_valid(now: Column, created_at: Column) -> Column:
    """DAT8."""
    return now <= created_at + F.make_dt_interval(hours=F.lit(4))


def handoffs(scrapes: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """SES2: requests (scrape_id, request_id, credential) for a browser session on a scrape
    (request_id, final_url, rendered, created_at): initial_url and owner_key of the session, or
    ``not_found`` where the scrape isn't there, wasn't rendered or is older than four hours."""
    known = scrapes.where("rendered").select(F.col("request_id").alias("scrape_id"), F.col("final_url").alias("_url"), F.col("created_at").alias("_since"))
    met = requests.join(known, "scrape_id", "left")
    ok = F.col("_since").isNotNull() & F.coalesce(handoff_valid(now, F.col("_since")), F.lit(False))
    return met.select("request_id", F.when(ok, F.col("_url")).alias("initial_url"), F.when(ok, X.owner_key(F.col("credential"))).alias("owner_key"), F.when(~ok, F.lit("not_found")).alias("error"))


def render_jobs(events: DataFrame) -> DataFrame:
    """JOB1: events (job_id, ord, event, result, error) to the jobs that are there: (job_id, state,
    result, error). ``enqueued`` begins a job (anew if its id was used), ``finished`` and ``failed`` end
    it, ``deleted`` takes it away; what ends a job that was deleted brings it back, as it is written
    under its id. Of a job's events the last decides."""
    last = events.groupBy("job_id").agg(F.max_by(F.struct("event", "result", "error"), "ord").alias("_e")).where("_e.event <> 'deleted'")
    state = F.when(F.col("_e.event") == "enqueued", F.lit("processing")).when(F.col("_e.event") == "failed", F.lit("failed")).otherwise(F.lit("completed"))
    return last.select("job_id", state.alias("state"), F.when(state == "completed", F.col("_e.result")).alias("result"), F.when(state == "failed", F.col("_e.error")).alias("error"))


# The snapshot cache.


def cache_key(options: dict[str, Column]) -> Column:
    """SRC6: over the canonical JSON of the fetch options, keys sorted, nulls kept."""
    body = F.to_json(F.struct(*[options[k].alias(k) for k in sorted(options)]), {"ignoreNullFields": "false"})
    return F.concat(F.lit("scrape:"), F.sha2(body, 256))


def cache_lookup(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """SRC4: requests (cache_key, max_age_s, screenshot) with ``hit`` and the page of the snapshot
    that is young enough, not expired and has a screenshot if one is asked for."""
    c = cache.select("cache_key", F.col("page").alias("_page"), F.col("fetched_at").alias("_at"), F.col("expires_at").alias("_until"), F.col("screenshot").alias("_shot"))
    ok = (F.col("_at") >= now - seconds(F.col("max_age_s"))) & (F.col("_until") > now) & (~F.col("screenshot") | F.col("_shot").isNotNull())
    hit = F.coalesce(ok, F.lit(False))
    return requests.join(c, "cache_key", "left").withColumns({"hit": hit, "page": F.when(hit, F.col("_page"))}).drop("_page", "_at", "_until", "_shot")


def cache_upsert(cache: DataFrame, fresh: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """SRC5: the latest snapshot of each key."""
    new = fresh.withColumns({"fetched_at": now, "expires_at": now + F.make_dt_interval(days=F.lit(days))})
    both = cache.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, "cache_key", ["_new", "fetched_at"], 1).drop("_new")


# Limits.


def rolling_count(requests: DataFrame, key: str = "key", ts: str = "ts", window_s: int = 60) -> DataFrame:
    """WIN4, JON8 in its relational form: requests of the key in the last ``window_s`` seconds,
    itself included, all counted whether or not they'd have been let in."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-(window_s * 1_000_000 - 1), 0)
    return requests.withColumn("in_window", F.count(F.lit(1)).over(w))


class Limits:
    """The limiter's state of one key: when requests were let in within a minute, and until when
    those that run are active. Times are microseconds."""

    def __init__(self, per_minute: int, concurrency: int, recent: Iterable[int] = (), active: Iterable[int] = ()) -> None:
        self.per_minute, self.concurrency = per_minute, concurrency
        self.recent, self.active = deque(recent), list(active)
        heapq.heapify(self.active)

    def decide(self, now: int, until: int | None = None) -> tuple[str, int]:
        """(``ok``, ``concurrency`` or ``rate``, seconds after which to try again). What is rejected
        leaves no trace; concurrency is judged first; a request counts for less than 60 seconds."""
        while self.recent and now - self.recent[0] >= 60_000_000:
            self.recent.popleft()
        while self.active and self.active[0] <= now:
            heapq.heappop(self.active)
        if len(self.active) >= self.concurrency:
            return "concurrency", 0
        if len(self.recent) >= self.per_minute:
            return "rate", max(1, 60 - (now - self.recent[0]) // 1_000_000)
        self.recent.append(now)
        if until is not None:
            heapq.heappush(self.active, until)
        return "ok", 0


def segments(rows: DataFrame) -> DataFrame:
    """(_k, _s, _segment) of rows (_key, _span: number of a span of time, _at, _until): spans of a
    key with the segment that each belongs to, named by its first span.

    A span begins a segment if nothing before it can count any more: no request within a minute
    before its first one, and nothing active then, whatever was let in. A limiter's state is empty
    there, so segments are folded apart. Spans are summed before they meet; a window holds one row
    a span of a key."""
    spans = rows.groupBy(F.col("_key").alias("_k"), F.col("_span").alias("_s")).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.max("_until").alias("_ends"))
    by = Window.partitionBy("_k").orderBy("_s")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    empty = (F.col("_first") - F.max("_last").over(before) >= 60_000_000) & F.coalesce(F.max("_ends").over(before) <= F.col("_first"), F.lit(True))
    spans = spans.withColumn("_new", F.coalesce(empty, F.lit(True)))
    return spans.withColumn("_segment", F.max(F.when(F.col("_new"), F.col("_s"))).over(by.rowsBetween(Window.unboundedPreceding, 0))).select("_k", "_s", "_segment")


def limiter(requests: DataFrame, per_minute: int = 120, concurrency: int = 16, key: str = "key", ts: str = "ts", until: str = "active_until", span_s: int = 600) -> DataFrame:
    """WIN4 exactly: ``requests`` with a decision for each: ``ok``, ``concurrency`` or ``rate``, and
    the seconds after which to try again (``retry_after``). Rejected requests leave no trace, so each
    decision hangs on the ones before: a fold per key, whose state is what was let in within a
    minute or is active.

    A key's requests are cut into segments (see ``segments``), so that one with most of the rows is
    many tasks' work. Rows are sorted by segment and time inside partitions and folded as a stream, so
    none is held in memory as a whole. Requests of one instant go by the hash of their other columns, so that a
    rerun decides alike. A null key is a key like others; rows with a null time come first in it
    and are rejected as ``rate`` without a trace; a null end is never active.
    """
    names = list(requests.columns)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    plain = [c for c in names if requests.schema[c].dataType.typeName() not in ("map", "variant")]
    # Keys are compared by a rank-free image of theirs that has no null and no loss of kind.
    image = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    rows = requests.select(F.struct(*names).alias("_row"), image.alias("_key"), micros(ts).alias("_at"), micros(until).alias("_until"), F.xxhash64(*plain).alias("_tie"))
    rows = rows.withColumn("_span", F.floor(F.col("_at") / (span_s * 1_000_000)).cast("bigint"))
    cuts = segments(rows)
    rows = rows.join(cuts, (F.col("_key") == F.col("_k")) & F.col("_span").eqNullSafe(F.col("_s"))).drop("_k", "_s", "_span")
    rows = rows.repartition("_key", "_segment").sortWithinPartitions("_key", "_segment", "_at", "_tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            decisions, waits = [], []
            for k, segment, at, end in zip(*[batch.column(c).to_pylist() for c in ("_key", "_segment", "_at", "_until")], strict=True):
                if state is None or (k, segment) != current:
                    current, state = (k, segment), Limits(per_minute, concurrency)
                decision, wait = ("rate", 1) if at is None else state.decide(at, end)
                decisions.append(decision)
                waits.append(wait)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(decisions, pa.string()), pa.array(waits, pa.int64())], ["_row", "decision", "retry_after"])

    out = rows.mapInArrow(run, StructType().add("_row", rows.schema["_row"].dataType).add("decision", "string").add("retry_after", "long"))
    return out.select("_row.*", "decision", "retry_after")
