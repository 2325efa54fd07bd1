"""Queries that crawl the given pages: robots files, order of discovery, page limits, scope."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import html, urls
from ..operators import frontier
from ..operators.tables import written
from ..sources import robots
from . import query, table
from .pages import FRAGMENT, HOST, LINKS, PATH, QUERY, SCHEME

# A robots file for each site, which holds rules of the language of its first page.
SITE = f"{SCHEME} || '://' || {HOST}"
LANGUAGE = "regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]*)', 1)"
LINES = ("# a file for each site", "User-agent: OtherBot", "Disallow: /", "", "user-agent: loombot", "User-Agent: x", "Disallow: /{l}/ # all", "Allow: /{l}/1", "Disallow: /*.html$", "disallow: /*page=2", "Disallow:", "", "User-agent: *", "Disallow: /")


def _files(pages):
    site = F.regexp_extract("url", "^([A-Za-z]+://[^/?#]*)", 1)
    language = F.min_by(F.regexp_extract("url", "^[a-z]+://[^/]*/([^/?#]*)", 1), "page_id")
    body = F.concat_ws("\n", *[F.replace(F.lit(x), F.lit("{l}"), F.col("l")) for x in LINES])
    return pages.groupBy(site.alias("site")).agg(language.alias("l")).select(F.concat("site", F.lit("/robots.txt")).alias("url"), body.alias("body"))


@query(
    "fil16_robots_gate",
    rf"""
WITH s AS (SELECT {SITE} AS site, arg_min({LANGUAGE}, page_id) AS l FROM pages GROUP BY 1),
p AS (SELECT page_id, l, {PATH} AS path, {QUERY} AS q FROM pages JOIN s ON s.site = {SITE}),
t AS (SELECT page_id, l, unnest([path || q, CASE WHEN NOT ends_with(path, '/') THEN path || '/' || q END]) AS t FROM p),
d AS (SELECT page_id, CASE WHEN t IS NULL THEN true WHEN regexp_matches(t, '^/.*page=2') THEN false WHEN ends_with(t, '.html') THEN false
  WHEN starts_with(t, '/' || l || '/1') THEN true ELSE NOT starts_with(t, '/' || l || '/') END AS ok FROM t)
SELECT page_id, bool_and(ok) AS allowed FROM d GROUP BY 1""",
)
def fil16_robots_gate(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = written(robots.index(_files(pages), "LoomBot/1.0"), "rules")
    return robots.judged(pages, rules, F.col("url")).select("page_id", "allowed")


def _of(sql: str, name: str) -> str:
    """A piece of SQL over ``url``, over another name."""
    return sql.replace("(url,", f"({name},")


def _key(u: str) -> str:
    """The similarity key in SQL."""
    path = _of(PATH, u)
    return f"'http://' || regexp_replace({_of(HOST, u)}, '^www\\.', '') || CASE WHEN length({path}) > 1 THEN coalesce(nullif(rtrim(regexp_replace({path}, '/index\\.(html|php)$', '/'), '/'), ''), '/') ELSE {path} END || {_of(QUERY, u)} || {_of(FRAGMENT, u)}"


def _queue(links: str, jobs: str, ok: Callable[[str], str], kept: Callable[[str, str], str] = lambda u, b: "true") -> str:
    """SQL that works off each job's tasks one after the other. links: page_key, links. jobs: id,
    url, page_limit, max_depth. ok: whether a URL u may be fetched; kept: whether a link u of the
    page at b is in scope."""
    task = lambda u, depth: f"{{'url': {u}, 'key': {_key(u)}, 'depth': {depth}, 'ok': {ok(u)}}}"
    return rf"""
WITH RECURSIVE {links}, {jobs},
w AS (SELECT id, page_limit, max_depth, 1 AS pos, [{task('url', '0::BIGINT')}] AS q FROM jobs
 UNION ALL SELECT id, page_limit, max_depth, pos + 1, list_concat(q, list_transform(list_filter(own, lambda x, i: list_position(list_transform(q, lambda y: y.key), x.key) IS NULL AND list_position(list_transform(own, lambda y: y.key), x.key) = i), lambda x: x))[:page_limit]
 FROM (SELECT w.*, list_transform((CASE WHEN len(found) > 0 THEN found ELSE [q[pos].url] END)[:page_limit], lambda u: {task('u', 'q[pos].depth + 1')}) AS own
  FROM (SELECT w.*, list_filter(CASE WHEN q[pos].ok AND q[pos].depth < max_depth THEN coalesce(l.links[:page_limit], []) ELSE [] END, lambda u: {kept('u', 'q[pos].url')}) AS found FROM w LEFT JOIN l ON l.page_key = w.q[w.pos].key WHERE w.pos <= len(w.q)) w) w),
z AS (SELECT id, q, unnest(range(1, len(q) + 1)) AS ord FROM (SELECT id, arg_max(q, pos) AS q FROM w GROUP BY 1))
SELECT id AS crawl_id, q[ord].url AS url, q[ord].depth::INTEGER AS depth, ord::BIGINT AS ord, q[ord].ok AS fetched FROM z"""


RULES = "User-agent: *\nDisallow: /de/\nAllow: /de/1\nDisallow: /*.html$\n"
_DECIDED = "(NOT ends_with({t}, '.html') AND (NOT starts_with({t}, '/de/') OR starts_with({t}, '/de/1')))"


def _fetched(u: str) -> str:
    path, q = _of(PATH, u), _of(QUERY, u)
    slashed = f"({path} || '/' || {q})"
    return f"({_of(SCHEME, u)} = 'http' OR ({_DECIDED.format(t=f'({path} || {q})')} AND (ends_with({path}, '/') OR {_DECIDED.format(t=slashed)})))"


@query(
    "crw3_pages",
    _queue(
        f"""{LINKS.strip()},
l AS (SELECT {_key('url')} AS page_key, list_concat(list_filter([n1, n2], lambda x: x IS NOT NULL), links) AS links
  FROM (SELECT page_id, url, links, regexp_replace(lead(url) OVER w, '#.*$', '') AS n1, regexp_replace(lead(url, 2) OVER w, '#.*$', '') AS n2 FROM links WINDOW w AS (PARTITION BY {HOST} ORDER BY page_id)))""",
        f"jobs AS (SELECT min(page_id) AS id, arg_min(url, page_id) AS url, 3 + min(page_id) % 12 AS page_limit, min(page_id) % 6 AS max_depth FROM pages GROUP BY {HOST})",
        _fetched,
    ),
)
def crw3_pages(spark, sf_dir):
    """A crawl from the first page of each host, over its anchors and the next two pages of the host,
    with page limits; sites under https have a robots file."""
    pages = html.extracted(table(spark, sf_dir, "pages"), ["anchors"])
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    w = Window.partitionBy(host).orderBy("page_id")
    linked = pages.select("page_id", "url", F.concat(F.array_compact(F.array(F.lead("url").over(w), F.lead("url", 2).over(w))), "anchors").alias("links"))
    first = table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.min("page_id").alias("id"), F.min_by("url", "page_id").alias("url"))
    jobs = first.select("id", "url", (3 + F.col("id") % 12).alias("page_limit"), (F.col("id") % 6).alias("max_depth"))
    files = first.select(F.concat(F.lit("https://"), "host", F.lit("/robots.txt")).alias("url"), F.lit(RULES).alias("body"))
    tasks = frontier.crawl(linked, jobs, entire_domain=True, robots=files)
    return tasks.select("crawl_id", "url", "depth", "ord", F.col("error").isNull().alias("fetched"))


# A small tree below every page, so that a link's scope hangs on the page it stands on.
TREE = ("", "/1", "/2", "/1/1", "/1/2", "/2/1", "/1/1/1")
_BASE = f"{SCHEME} || '://' || {HOST} || rtrim({PATH}, '/')"


@query(
    "crw4_scope",
    _queue(
        f"""b AS (SELECT page_id, {_BASE} || '/p' || page_id AS base FROM pages),
t AS (SELECT page_id, base, unnest({list(TREE)}) AS s FROM b),
l AS (SELECT {_key('(base || s)')} AS page_key, list_transform(['/1', '/2', '', s || '/1', s || '/2', s || 'x'], lambda x: base || x) AS links FROM t)""",
        "jobs AS (SELECT page_id AS id, base || ['', '/1', '/2'][page_id % 3 + 1] AS url, 2 + page_id % 7 AS page_limit, page_id % 5 AS max_depth FROM b)",
        lambda u: "true",
        lambda u, b: f"starts_with({_of(PATH, u)}, {_of(PATH, b)})",
    ),
)
def crw4_scope(spark, sf_dir):
    """A link counts if its path begins with that of the page it stands on, which isn't the start's."""
    u = F.col("url")
    base = F.concat(F.lower(F.regexp_extract(u, "^([A-Za-z]+://[^/?#]*)", 1)), F.regexp_replace(urls.path(u), "/+$", ""), F.lit("/p"), F.col("page_id").cast("string"))
    b = table(spark, sf_dir, "pages").select("page_id", base.alias("base"))
    t = b.withColumn("s", F.explode(F.array(*[F.lit(s) for s in TREE])))
    at = lambda *x: F.concat("base", *x)
    linked = t.select(at("s").alias("url"), F.array(at(F.lit("/1")), at(F.lit("/2")), at(F.lit("")), at("s", F.lit("/1")), at("s", F.lit("/2")), at("s", F.lit("x"))).alias("links"))
    n = F.col("page_id")
    start = F.element_at(F.array(*[F.lit(x) for x in ("", "/1", "/2")]), (n % 3 + 1).cast("int"))
    jobs = b.select(n.alias("id"), at(start).alias("url"), (2 + n % 7).alias("page_limit"), (n % 5).alias("max_depth"))
    tasks = frontier.crawl(linked, jobs)
    return tasks.select("crawl_id", "url", "depth", "ord", F.col("error").isNull().alias("fetched"))
