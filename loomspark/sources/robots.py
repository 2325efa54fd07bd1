"""SRC8, FIL16, ROB1 to ROB3: robots.txt rules.

For tables of URLs, ``index`` makes a table of the rules that hold for an agent: the literal beginning
of each pattern, cut at its last slash, is its key. A URL has as many keys as its path has
slashes, so ``judged`` joins by (file, key) and meets few of a site's rules; the rest of a
pattern is tried piece by piece, and the longest that fits decides.

``allowed`` is for a file that stands beside its URL in a row: parsed once per distinct text of a
batch; the groups that fit the agent give a list of (length, allow, pattern), tried longest first.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls


@lru_cache(maxsize=256)
def rules(body: str, agent: str) -> tuple[tuple[int, bool, str], ...]:
    """Rules for an agent: those of all groups whose best agent name has the greatest length."""
    agent = agent.translate(_LOWER)
    groups: list[tuple[list[str], list[tuple[bool, str]]]] = []
    ruled = True  # whether the last group has had a rule, so that an agent line begins another
    for line in body.splitlines():
        field, colon, value = line.split("#", 1)[0].strip().partition(":")
        field, value = field.strip().translate(_LOWER), value.strip()
        if colon and field == "user-agent":
            if ruled:
                groups.append(([], []))
                ruled = False
            groups[-1][0].append(value.translate(_LOWER))
        elif colon and field in ("allow", "disallow") and groups:
            ruled = True
            if value:
                groups[-1][1].append((field == "allow", value))
    fit = lambda n: 0 if n == "*" else len(n.encode()) if n in agent else -1
    best = max((fit(n) for g in groups for n in g[0]), default=-1)
    if best < 0:
        return ()
    chosen = [r for g in groups if any(fit(n) == best for n in g[0]) for r in g[1]]
    return tuple(sorted(((len((p[:-1] if p.endswith("$") else p).replace("*", "")), allow, p) for allow, p in chosen), reverse=True))


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fits(pattern: str, path: str) -> bool:
    """ROB2: pieces between stars are found leftmost, one after the other, without going back."""
    end = pattern.endswith("$")
    first, *rest = (pattern[:-1] if end else pattern).split("*")
    if not path.startswith(first):
        return False
    at = len(first)
    for piece in rest:
        if piece:
            found = path.find(piece, at)
            if found < 0:
                return False
            at = found + len(piece)
    return not end or at == len(path)


def allows(body: str, path: str, agent: str) -> bool:
    """The longest fitting rule decides, Allow before Disallow; without one all is allowed."""
    return next((allow for _, allow, p in rules(body, agent) if fits(p, path)), True)


def allowed(body: Column, url: Column, agent: str) -> Column:
    """FIL16, ROB3: whether the agent may fetch the URL, and, if its path doesn't end with a slash,
    also the URL with one. A null file (unreadable, not found) allows all."""

    @F.arrow_udf("boolean")
    def run(bodies: pa.Array, paths: pa.Array, queries: pa.Array) -> pa.Array:
        out = []
        for body, path, query in zip(bodies.to_pylist(), paths.to_pylist(), queries.to_pylist(), strict=True):
            if body is None or path is None:
                out.append(None if path is None else True)
                continue
            tail = "" if query is None else f"?{query}"
            ok = allows(body, path + tail, agent)
            out.append(ok and (path.endswith("/") or allows(body, f"{path}/{tail}", agent)))
        return pa.array(out, pa.bool_())

    return run(body, urls.path(url), urls.query(url))


def index(files: DataFrame, agent: str) -> DataFrame:
    """(site, key, allow, pieces, anchored, length): the rules for an agent of files (url, body);
    site: the file's URL. Files without a rule for the agent have no row, which allows all.

    Lines of a file are numbered and put into groups: agent lines that follow a rule begin one. The
    windows hold one file's lines."""
    agent = agent.translate(_LOWER)
    blank = r"^\s+|\s+$"
    lines = files.where("body is not null").select(F.col("url").alias("site"), F.posexplode(F.split("body", r"\r\n|\n")).alias("at", "line")).distinct()
    lines = lines.withColumn("line", F.substring_index("line", "#", 1)).where("contains(line, ':')")
    ascii_lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    field = ascii_lower(F.regexp_replace(F.substring_index("line", ":", 1), blank, ""))
    value = F.regexp_replace(F.substr("line", F.instr("line", ":") + 1), blank, "")
    lines = lines.select("site", "at", field.alias("field"), value.alias("value")).where(F.col("field").isin("user-agent", "allow", "disallow"))
    by = Window.partitionBy("site").orderBy("at")
    is_agent = F.col("field") == "user-agent"
    begins = is_agent & (F.coalesce(F.lag("field").over(by), F.lit("")) != "user-agent")
    # Rules before the first agent line are of group 0, which no agent names.
    lines = lines.withColumn("begins", begins.cast("int")).withColumn("group", F.sum("begins").over(by))
    name = ascii_lower(F.col("value"))
    fit = F.when(name == "*", 0).when(F.contains(F.lit(agent), name), F.octet_length(name))
    agents = lines.where(is_agent).select("site", "group", fit.alias("fit")).where("fit is not null")
    best = agents.withColumn("best", F.max("fit").over(Window.partitionBy("site"))).where("fit = best").select("site", "group").distinct()
    rules = lines.where(~is_agent & (F.col("value") != "")).join(best, ["site", "group"])
    bare = F.regexp_replace("value", r"\$$", "")
    pieces = F.split(bare, r"\*")
    first = F.element_at(pieces, 1)
    key = F.regexp_extract(first, "^(.*)/", 1)
    rules = rules.select("site", key.alias("key"), (F.col("field") == "allow").alias("allow"), pieces.alias("pieces"), F.endswith(F.col("value"), F.lit("$")).alias("anchored"), F.length(F.replace(bare, F.lit("*"), F.lit(""))).alias("length"))
    return rules.distinct()


def fits_pieces(pieces: Column, anchored: Column, target: Column) -> Column:
    """ROB2 as a Column: pieces between stars are found leftmost, one after the other."""
    begun = F.startswith(target, F.element_at(pieces, 1))
    find = lambda at, p: F.when(p == "", at).when(at > 0, F.coalesce(F.nullif(F.call_function("locate", p, target, at), F.lit(0)) + F.length(p), F.lit(0))).otherwise(0)
    end = F.aggregate(F.slice(pieces, 2, F.size(pieces)), F.length(F.element_at(pieces, 1)) + 1, find)
    return begun & (end > 0) & (~anchored | (end == F.length(target) + 1))


def judged(rows: DataFrame, rules: DataFrame, url: Column, into: str = "allowed") -> DataFrame:
    """``rows`` with whether the agent of ``rules`` (a written ``index``) may fetch the URL, and, if its
    path doesn't end with a slash, also the URL with one; null for what isn't a URL.

    Different targets are judged once; a site's URLs and rules meet by (file, key) only."""
    path, query = urls.path(url), urls.query(url)
    tail = F.coalesce(F.concat(F.lit("?"), query), F.lit(""))
    rows = rows.withColumns({"_site": urls.robots_url(url), "_path": path, "_tail": tail})
    targets = rows.where("_site is not null").select("_site", "_path", "_tail").distinct()
    both = F.array(F.concat("_path", "_tail"), F.when(~F.endswith("_path", F.lit("/")), F.concat("_path", F.lit("/"), "_tail")))
    targets = targets.withColumn("target", F.explode(F.array_compact(both)))
    parts = F.split("target", "/")
    keys = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    asked = targets.select(F.col("_site").alias("site"), "_path", "_tail", "target", F.explode(F.array_distinct(keys)).alias("key"))
    met = asked.join(rules, ["site", "key"]).where(fits_pieces(F.col("pieces"), F.col("anchored"), F.col("target")))
    decided = met.groupBy("site", "_path", "_tail", "target").agg(F.max(F.struct("length", "allow"))["allow"].alias("ok"))
    refused = decided.where("not ok").select(F.col("site").alias("_site"), "_path", "_tail").distinct().withColumn("_refused", F.lit(True))
    found = rows.join(refused, ["_site", "_path", "_tail"], "left")
    kept = [c for c in rows.columns if c not in ("_site", "_path", "_tail")]
    return found.select(*kept, F.when(F.col("_site").isNotNull(), F.col("_refused").isNull()).alias(into))
