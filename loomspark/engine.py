"""A facade over the operators: what a client of a scraping service asks for, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import html, quality, text, urls
from .operators import frontier, search, workflows


class Engine:
    """Runs over a table of pages (url, html and, if known, status) in the place of the network."""

    def __init__(self, spark: SparkSession, pages: DataFrame) -> None:
        self.spark = spark
        self.pages = pages if "status" in pages.columns else pages.withColumn("status", F.lit(200))

    def scrape(self, formats: Sequence[str] = ("markdown",), query: str = "", schema: dict | None = None, selectors: Sequence[tuple[str, str]] = ()) -> DataFrame:
        """url, status, title, language, quality, error and the wanted formats of every page."""
        parts = ["title", "language", "markdown"] + [f for f in ("links", "images") if f in formats]
        page = html.extracted(self.pages, parts)
        page = page.withColumn("quality", quality.quality_score(F.col("markdown"), F.col("html"), F.col("status"), F.col("title")))
        page = page.withColumn("error", F.when(text.trimmed(F.col("markdown")) == "", F.lit("empty_content")))
        more = [f for f in formats if f not in ("markdown", "links", "images")]
        page = search.enriched(page, more, query, schema, selectors)
        return page.select("url", "status", "title", "language", "quality", "error", *[f for f in formats if f in page.columns])

    def map(self, limit: int = 100, **options) -> DataFrame:
        """links and provider of every page as a start."""
        page = html.extracted(self.pages, ["anchors"])
        none = F.lit(None).cast("array<string>")
        return page.select("url", urls.site_map(none, F.col("anchors"), F.col("url"), limit=limit, **options).alias("m")).select("url", "m.*")

    def crawl(self, starts: DataFrame, page_limit: int = 10, max_depth: int = 2, **options) -> DataFrame:
        """Tasks of a crawl from each of starts (id, url)."""
        linked = html.extracted(self.pages, ["anchors"]).select("url", F.col("anchors").alias("links"))
        jobs = starts.select("id", "url").withColumns({"page_limit": F.lit(page_limit), "max_depth": F.lit(max_depth)})
        return frontier.crawl(linked, jobs, **options)

    def batch(self, wanted: DataFrame, **options) -> DataFrame:
        """scrape() of the pages in wanted (url)."""
        return Engine(self.spark, self.pages.join(wanted.select("url").distinct(), "url", "left_semi")).scrape(**options)

    def search(self, query: str, limit: int = 5, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
        """Pages whose text holds most different terms of the query, with highlights."""
        page = html.extracted(self.pages, ["title", "markdown"])
        hits = page.withColumn("overlap", text.term_overlap(F.col("markdown"), query)).where("overlap > 0")
        top = hits.where(urls.domain_allowed(F.col("url"), include, exclude)).orderBy(F.desc("overlap"), "url").limit(limit)
        return top.select("url", "title", "overlap", text.highlights(F.col("markdown"), query).alias("highlights"))

    def extract(self, schema: dict) -> DataFrame:
        """The fields of a schema for every page."""
        page = html.extracted(self.pages, ["title", "markdown"])
        return page.select("url", text.fields(schema, F.col("markdown"), F.col("title")).alias("data"))

    def monitor(self, checks: DataFrame) -> DataFrame:
        """Differences of each completed check from the one before."""
        return workflows.check_diffs(checks)
