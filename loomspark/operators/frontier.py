"""CRW3, CRW4: breadth-first expansion of a crawl over a table of pages.

One round per depth: the tasks of a depth join the pages' links, which are filtered, deduplicated
against all tasks so far and among themselves, numbered in the order of their discovery, cut at
the job's page limit, judged by robots rules, and written as the tasks of the next depth. What a
round writes grows with its new links only: tasks so far are a ``SeenSet`` of the written depths.
Only counts reach the driver.

Links are discovered as if tasks were worked off one after the other: in the order of their parents,
then as they stand on the page. A job's links may be a third of all; numbers come from ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..sources import robots as R
from .tables import SeenSet, numbered, written

EXCLUDED = "URL is excluded by includePaths or excludePaths"
REFUSED = "robots.txt disallows URL"


def crawl(
    pages: DataFrame, jobs: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), full_url: bool = False, similar: bool = True, ignore_query: bool = False, sitemaps: DataFrame | None = None, sitemap: str = "include",
    robots: DataFrame | None = None, agent: str = "LoomBot", **scope: bool,
) -> DataFrame:
    """(crawl_id, url, dedup_key, depth, ord, error) of every task of every job; ord: from 1 in the
    order of discovery.

    pages: url, links (array<string>, absolute). jobs: id, url, page_limit, max_depth and, if they
    have it, job_type, of which only ``crawl`` expands. sitemaps: url (that of the sitemap),
    locations (array<string>). robots: url (that of the file), body. The scope of a link is judged
    from the page it stands on, not from the start URL. A task's page is that with its URL, else
    the least of those with its key.

    Each page gives what ``urls.site_map`` does with the job's page limit. The sitemap of a site
    counts at depth 0 only, by the mode (skip, include, only); with ``only``, deeper pages give
    nothing. A task that the patterns or a robots file refuse is a task and counts, but has an
    error and gives no links.
    """
    key = lambda c: urls.similarity_key(c, similar)
    rules = None if robots is None else written(R.index(robots, agent), "rules")

    def judged(tasks: DataFrame, seeds: bool) -> DataFrame:
        error = F.when(~urls.allowed_by_patterns(F.col("url"), include, exclude, full_url), EXCLUDED) if seeds and (include or exclude) else F.lit(None).cast("string")
        if rules is None:
            return tasks.withColumn("error", error)
        found = R.judged(tasks, rules, F.col("url"), "_allowed")
        return found.withColumn("error", F.coalesce(error, F.when(~F.col("_allowed"), REFUSED))).drop("_allowed")

    columns = ["crawl_id", "url", "dedup_key", "depth", "ord", "error"]
    seeds = jobs.select(F.col("id").alias("crawl_id"), "url", key(F.col("url")).alias("dedup_key"), F.lit(0).alias("depth"), F.lit(1).cast("bigint").alias("ord"))
    depths = [written(judged(seeds, True).select(*columns), "tasks")]
    seen = SeenSet(["crawl_id", "dedup_key"])
    seen.add(depths[0])
    grows = jobs.where("job_type = 'crawl'") if "job_type" in jobs.columns else jobs
    grows = written(grows.select(F.col("id").alias("crawl_id"), F.col("page_limit").alias("_limit"), F.col("max_depth").alias("_deepest"), F.lit(1).cast("bigint").alias("_have")), "jobs")
    at = written(pages.select(key(F.col("url")).alias("_key"), F.col("url").alias("_page"), "links"), "links")
    deepest = min(grows.agg(F.max("_deepest")).first()[0] or 0, 1 if sitemap == "only" else 1 << 30)
    for depth in range(deepest):
        grows = grows.where((F.col("_have") < F.col("_limit")) & (F.col("_deepest") > depth))
        found = _links(depths[-1].where("error is null"), grows, at, sitemaps if depth == 0 else None, sitemap if depth == 0 else "skip", ignore_query, scope)
        found = found.where(urls.allowed_by_patterns(F.col("url"), include, exclude, full_url))
        # Of links with one key the first discovered.
        found = found.select("crawl_id", "_from", "_i", "url", key(F.col("url")).alias("dedup_key"))
        found = found.groupBy("crawl_id", "dedup_key").agg(F.min(F.struct("_from", "_i", "url")).alias("_l")).select("crawl_id", "dedup_key", "_l.*")
        new = numbered(seen.new(written(found, "found")), ["crawl_id"], [F.col("_from"), F.col("_i")], "_n")
        new = new.join(grows, "crawl_id").withColumn("ord", F.col("_have") + F.col("_n")).where("ord <= _limit")
        tasks = new.select("crawl_id", "url", "dedup_key", F.lit(depth + 1).alias("depth"), "ord")
        depths.append(written(judged(tasks, False).select(*columns), "tasks"))
        if depths[-1].isEmpty():
            break
        seen.add(depths[-1])
        more = depths[-1].groupBy("crawl_id").agg(F.count(F.lit(1)).alias("_more"))
        # A job that found nothing has no task at this depth, and so nothing to expand.
        grows = written(grows.join(more, "crawl_id").select("crawl_id", "_limit", "_deepest", (F.col("_have") + F.col("_more")).alias("_have")), "jobs")
    out = depths[0]
    for d in depths[1:]:
        out = out.unionByName(d)
    return out


def _links(tasks: DataFrame, grows: DataFrame, at: DataFrame, sitemaps: DataFrame | None, mode: str, ignore_query: bool, scope: dict[str, bool]) -> DataFrame:
    """(crawl_id, _from, _i, url): links of the pages of ``tasks``, in order."""
    met = tasks.join(grows.select("crawl_id", "_limit"), "crawl_id").join(at, F.col("dedup_key") == F.col("_key"), "left")
    own = F.min_by("links", F.struct(F.col("_page") != F.col("url"), "_page")).alias("links")
    met = met.groupBy("crawl_id", "url", "ord", "_limit").agg(own)
    locations: Column = F.lit(None).cast("array<string>")
    if sitemaps is not None:
        s = sitemaps.select(F.col("url").alias("_at"), F.col("locations").alias("_locations"))
        met, locations = met.withColumn("_at", urls.sitemap_url(F.col("url"))).join(s, "_at", "left"), F.col("_locations")
    mapped = urls.site_map(locations, F.col("links"), F.col("url"), limit=F.col("_limit"), mode=mode, ignore_query=ignore_query, **scope)
    return met.select("crawl_id", F.col("ord").alias("_from"), F.posexplode(mapped["links"]).alias("_i", "url"))
