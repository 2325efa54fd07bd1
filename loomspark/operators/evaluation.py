"""Benchmark and quality reports: percentiles, rollups, gates, costs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rate(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.when(whole > 0, F.bround(part / whole, digits)).otherwise(F.lit(0.0))


def quantiles(cells: DataFrame, keys: Sequence[str], value: str, weight: str, ps: Sequence[int]) -> DataFrame:
    """AGG5 by selection: for each key the nearest-rank percentiles (p50, ...) of whole numbers, from
    cells (keys, value, weight: how many samples have it). Null values don't count.

    Two passes of sums: over ranges of values, each as wide as the square root of the key's span,
    to find the range that holds a rank; then over the values of that range. No list of values is
    held, and a window holds a square root of the span at most."""
    cells = cells.where(F.col(value).isNotNull())
    spans = cells.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum(weight).alias("_n"))
    spans = spans.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_lo", "_n", F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("_hi") - F.col("_lo") + 1))).cast("bigint").alias("_step"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    ranged = cells.join(spans, reduce(and_, same)).select(*keys, F.col(value).alias("_v"), F.col(weight).alias("_w"), "_n", F.floor((F.col(value) - F.col("_lo")) / F.col("_step")).alias("_range"))
    upto = Window.partitionBy(*keys).orderBy("_range")
    sums = ranged.groupBy(*keys, "_range", "_n").agg(F.sum("_w").alias("_c")).withColumn("_upto", F.sum("_c").over(upto))
    rank = lambda n: F.greatest(F.lit(1), F.ceil(F.col("p") / 100.0 * n)).cast("bigint")
    asked = sums.withColumn("p", F.explode(F.array(*[F.lit(p) for p in ps]))).withColumn("_rank", rank(F.col("_n")) - F.col("_upto") + F.col("_c"))
    asked = asked.where("_rank between 1 and _c").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), "p", "_rank")
    inside = Window.partitionBy(*keys, "p").orderBy("_v")
    met = ranged.join(asked, reduce(and_, [*same, F.col("_range") == F.col("_r")])).withColumn("_upto", F.sum("_w").over(inside))
    met = met.where("_rank between _upto - _w + 1 and _upto")
    return met.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, F.col("_v"))).alias(f"p{p}") for p in ps])


def _cells(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums of the samples alike in keys and elapsed_ms: all that a summary takes."""
    return samples.groupBy(*keys, "elapsed_ms").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("ok"), F.count_if("quality_passed").alias("passed"), F.sum("quality_score").alias("score"), F.count("quality_score").alias("scored"), F.count("error").alias("errors"))


def _summed(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    n, ok, passed = F.sum("n"), F.sum("ok"), F.sum("passed")
    ps = (50, 95, 99)
    out = cells.groupBy(*keys).agg(
        n.alias("sample_count"),
        ok.alias("success_count"),
        _rate(ok, n).alias("success_rate"),
        passed.alias("quality_pass_count"),
        _rate(passed, n).alias("quality_pass_rate"),
        F.bround(F.sum("score") / F.nullif(F.sum("scored"), F.lit(0)), 4).alias("average_quality_score"),
        _rate(ok * 60000, F.sum(F.col("elapsed_ms") * F.col("n")), 2).alias("successful_pages_per_minute"),
        F.sum("errors").alias("error_count"),
    )
    own = quantiles(cells, keys, "elapsed_ms", "n", ps).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(f"p{p}").cast("bigint").alias(f"p{p}_elapsed_ms") for p in ps])
    joined = out.join(own, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]), "left")
    return joined.select(*keys, "sample_count", "success_count", "success_rate", "quality_pass_count", "quality_pass_rate", "average_quality_score", *[f"p{p}_elapsed_ms" for p in ps], "successful_pages_per_minute", "error_count")


def summary(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AGG6: samples (success, quality_passed boolean; quality_score; elapsed_ms, whole; error) by
    keys. Pages per minute are taken over the sum of elapsed_ms, the time of a run one at a time."""
    return _summed(_cells(samples, keys), keys)


def rollup(samples: DataFrame) -> DataFrame:
    """AGG7: by (provider, case) and by provider; ``case`` is null on the upper level. Samples are
    counted once by (provider, case, elapsed_ms), and both levels are sums of these counts, so
    percentiles of the upper level come from the samples, not from the lower level."""
    cells = _cells(samples, ["provider", "case"])
    upper = cells.groupBy("provider", "elapsed_ms").agg(*[F.sum(c).alias(c) for c in ("n", "ok", "passed", "score", "scored", "errors")])
    return _summed(cells, ["provider", "case"]).unionByName(_summed(upper, ["provider"]).withColumn("case", F.lit(None).cast("string")))


def cost_per_1000(total: Column, successes: Column, price: Column) -> Column:
    """AGG8: null without a price or a success."""
    return F.when(price.isNotNull() & (successes > 0), F.bround(total * price / successes, 4))


def case_scores(checks: DataFrame) -> DataFrame:
    """AGG9: checks (name, check, passed) to the share passed of each case."""
    return checks.groupBy("name").agg(F.bround(F.avg(F.col("passed").cast("int")), 4).alias("score"), F.count_if("passed").alias("passed_checks"), F.count(F.lit(1)).alias("total_checks"), F.max(F.when(F.col("check") == "request_succeeded", F.col("passed"))).alias("succeeded"))


def gates(scores: DataFrame, least_overall: float, least_case: float, most_failures: int, names: int = 1_000) -> DataFrame:
    """AGG10: a row for each gate: name, passed, expected, actual, failed_cases: the names of those
    that failed, the first ``names`` of them in order; ``actual`` counts all."""
    bad = F.col("score") < least_case
    one = scores.agg(F.avg("score").alias("o"), F.count_if(bad).alias("n"), F.count_if(~F.coalesce("succeeded", F.lit(False))).alias("r"))
    # Least names are picked in each partition before they meet.
    worst = scores.where(bad).select("name").orderBy("name").limit(names).agg(F.array_sort(F.collect_list("name")).alias("f"))
    none = F.array().cast("array<string>")
    row = lambda name, ok, want, got, failed: F.struct(F.lit(name).alias("gate"), ok.alias("passed"), F.lit(float(want)).alias("expected"), got.cast("double").alias("actual"), failed.alias("failed_cases"))
    overall = F.coalesce("o", F.lit(0.0))
    # One row on either side.
    return one.crossJoin(F.broadcast(worst)).select(
        F.inline(
            F.array(
                row("minimum_overall_score", overall >= least_overall, least_overall, F.bround(overall, 4), none),
                row("minimum_case_score", F.col("n") == 0, least_case, F.col("n"), F.col("f")),
                row("maximum_request_failures", F.col("r") <= most_failures, most_failures, F.col("r"), none),
            )
        )
    )


def engine_counters(pages: DataFrame) -> DataFrame:
    """AGG3: pages (provider, fallback_reason) by engine; an unknown one counts as http."""
    engine = F.when(F.col("provider").isin("browser", "tls_client"), F.col("provider")).otherwise(F.lit("http"))
    return pages.groupBy(engine.alias("engine")).agg(F.count(F.lit(1)).alias("pages"), F.count("fallback_reason").alias("fallbacks"))


def request_counters(requests: DataFrame) -> DataFrame:
    """AGG4: requests (status, elapsed_ms)."""
    return requests.agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") >= 400).alias("failures"), F.sum("elapsed_ms").alias("latency_ms"))


def prometheus(metrics: DataFrame) -> DataFrame:
    """SNK3: (name, kind, value) as text of the exposition format, a row for each metric."""
    return metrics.select(F.format_string("# TYPE %s %s\n%s %d", "name", "kind", "name", F.col("value").cast("bigint")).alias("text"))


def payload(content: Column) -> Column:
    """JSN6: a provider's reply as (title, provider, rendered, status). Its page is the object
    ``data``, or the reply itself where that isn't one. Title and provider are those of the page's
    metadata, else the page's, else the reply's; status the page's, else the reply's; empty ones and
    0 count as missing. Rendered is that of the metadata, else the page's."""
    v = F.try_parse_json(content)
    get = lambda path, kind="string": F.try_variant_get(v, f"$.{path}", kind)
    inner = F.coalesce(F.schema_of_variant(get("data", "variant")).startswith("OBJECT"), F.lit(False))
    page = lambda path, kind="string": F.when(inner, get(f"data.{path}", kind)).otherwise(get(path, kind))
    named = lambda name: F.coalesce(F.nullif(page(f"metadata.{name}"), F.lit("")), F.nullif(page(name), F.lit("")), get(name))
    return F.struct(
        named("title").alias("title"),
        named("provider").alias("provider"),
        F.coalesce(page("metadata.rendered", "boolean"), page("rendered", "boolean")).alias("rendered"),
        F.coalesce(F.nullif(page("status", "int"), F.lit(0)), get("status", "int")).alias("status"),
    )


def chosen_engine(candidates: DataFrame, key: str = "url") -> DataFrame:
    """HTM19, WIN6, JON10: candidates (key, engine, ord, score, error) to one row for each key: the
    best score, ties to the lower ord; the trace of outcomes in ord; the first failure's reason.
    A null score is a failure; with failures only, engine is null and error joins their messages."""
    from pyspark.sql import Window

    ok = F.col("score").isNotNull()
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last("score"), "ord")
    r = candidates.withColumn("_win", (F.row_number().over(w) == 1) & ok)
    outcome = F.when(~ok, F.lit("failed")).when(F.col("_win"), F.lit("selected")).otherwise(F.lit("rejected"))
    trace = F.array_sort(F.collect_list(F.struct("ord", "engine", outcome.alias("outcome"), F.when(outcome == "rejected", F.lit("lower quality score")).when(~ok, F.col("error")).alias("reason"))))
    out = r.groupBy(key).agg(F.max(F.when(F.col("_win"), F.col("engine"))).alias("engine"), F.max(F.when(F.col("_win"), F.col("score"))).alias("score"), trace.alias("outcomes"))
    failed = F.filter("outcomes", lambda o: o["outcome"] == "failed")
    reasons = F.transform(failed, lambda o: o["reason"])
    return out.withColumns({"fallback_reason": F.when(F.col("engine").isNotNull(), F.try_element_at(reasons, F.lit(1))), "error": F.when(F.col("engine").isNull(), F.array_join(reasons, "; "))})
