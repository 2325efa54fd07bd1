"""The facade."""

from pyspark.sql import functions as F

from loomspark.engine import Engine


def test_engine(spark):
    page = lambda u, body: (f"https://a.com{u}", f"<title>T{u}</title><main>{body}</main>")
    pages = spark.createDataFrame([page("/", '<h1>Start</h1><p>rust text <a href="/b">b</a></p>'), page("/b", "<p>other text, mail x@y.z</p>"), ("https://a.com/c", "")], "url string, html string")
    e = Engine(spark, pages)
    got = {r["url"]: r for r in e.scrape(["markdown", "summary", "links"]).collect()}
    assert got["https://a.com/"]["links"] == ["https://a.com/b"] and got["https://a.com/c"]["error"] == "empty_content" and got["https://a.com/b"]["summary"] == "other text, mail x@y.z"
    assert e.map(entire_domain=True).where(F.col("url") == "https://a.com/").first()["links"] == ["https://a.com/b"]
    assert [r["url"] for r in e.crawl(pages.limit(1).select(F.lit(1).alias("id"), "url")).orderBy("depth").collect()] == ["https://a.com/", "https://a.com/b"]
    assert e.batch(pages.limit(1)).count() == 1
    assert [r["url"] for r in e.search("rust").collect()] == ["https://a.com/"]
    assert e.extract({"email": {}}).where("url like '%b'").first()["data"] == {"email": "x@y.z"}
