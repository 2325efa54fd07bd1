"""Text, search, quality."""

import random
import re

from pyspark.sql import functions as F

from loomspark.functions import quality, text
from loomspark.operators import postings, search


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_highlights_and_passages(spark):
    t = F.lit("First about Rust crates.\n\nNothing here\n\n  RUST again, and more  ")
    assert one(spark, text.highlights(t, "rust, of")) == ["First about Rust crates.", "RUST again, and more"]
    assert one(spark, text.highlights(t, "of to")) == []
    assert one(spark, text.best_passage(F.lit("# Rust rust\n\nrust one\n\nrust two\n\nx"), "Rust")) == "rust two"
    assert one(spark, text.best_passage(F.lit("a\n\nb"), "zzz")) == "b"
    assert one(spark, text.best_passage(F.lit(" # only "), "zzz")) == "# only"
    assert one(spark, text.summary(F.lit("# Head\n\n  Body text \n\nmore"))) == "Body text"


def test_fields(spark):
    t = F.lit("write to <sales@example.com>, or x@y.z")
    assert one(spark, text.field("contact_email", t, F.lit("T"))) == "sales@example.com"
    assert one(spark, text.field("company_email", t, F.lit("T"))) == "T"
    assert one(spark, text.field("company_email", t, F.lit(None).cast("string"))) == "sales@example.com"
    assert one(spark, text.field("price", t, F.lit("T"))) is None
    assert text.schema_fields('{"properties": {"a": {"description": "d"}, "b": {"type": "number"}, "c": {}}}') == {"a": "d", "b": "number", "c": "string"}
    assert text.schema_fields({"a": {"type": "x"}}) == {"a": "x"}


def test_lenient_json(spark):
    got = one(spark, text.scalar_fields(F.lit('Sure: {"a": "x", "b": null, "c": [1], "d": " ", "z": 1} done'), ["a", "b", "c", "d", "e"]))
    assert got == {"a": "x", "b": None, "c": "[1]", "d": None, "e": None}
    assert one(spark, text.scalar_fields(F.lit("none"), ["a"])) == {"a": None}


def test_hmac_vector(spark):
    body = F.lit("The quick brown fox jumps over the lazy dog")
    assert one(spark, text.hmac_sha256(body, "key")) == "sha256=f7bc83f430538424b13298e6aa6fb143ef4d59a14946175997479dbc2d1a3cd8"


def test_query_builder(spark):
    q = text.search_query(F.lit("spark"), [("github", ()), ("research", ("x.org",)), ("pdf", ())], ["a.org"], ["b.org"])
    assert one(spark, q) == "spark (site:github.com OR site:x.org OR site:a.org) -site:b.org filetype:pdf"
    assert one(spark, text.search_query(F.lit("spark"))) == "spark"


def test_line_diff(spark):
    assert one(spark, text.line_diff(F.lit("alpha\nbeta"), F.lit("alpha\ngamma"))) == "--- previous\n+++ current\n-beta\n+gamma"
    assert one(spark, text.line_diff(F.lit("a"), F.lit("a"))) == ""
    assert one(spark, text.line_diff(F.lit(""), F.lit("a"))) == "--- previous\n+++ current\n+a"


def test_quality(spark):
    long = F.lit("# Title\n\n" + "word " * 500)
    good = quality.quality_score(long, F.lit("<html>"), F.lit(200), F.lit("Title"))
    bad = quality.quality_score(F.lit("Just a moment"), F.lit("Verify you are HUMAN"), F.lit(200), F.lit(None).cast("string"))
    assert abs(one(spark, good) - 0.95) < 1e-9 and one(spark, bad) == 0.0


def test_base64_html_and_endpoint(spark):
    assert one(spark, text.decoded_base64(F.lit(" data:x;base64,aGk=")).cast("string")) == "hi"
    assert one(spark, text.decoded_base64(F.lit("***"))) is None
    assert one(spark, text.rendered_html(F.lit("a<b>\n\n 'c'"))) == "<p>a&lt;b&gt;</p>\n<p> &#x27;c&#x27;</p>"
    assert one(spark, text.completion_url(F.lit("https://x/v1/"))) == "https://x/v1/chat/completions"


def test_formats_and_enrichment(spark):
    pages = spark.createDataFrame([("https://e.com", '<img src="/a.png"><p data-k="1">x', "# T\n\nSome rust text", "T")], "url string, html string, markdown string, title string")
    assert search.formats(pages, ["RAW_HTML", "markdown", "links"]).columns == ["url", "rawHtml", "markdown", "links"]
    got = search.enriched(pages, ["images", "summary", "attributes", "highlights", "answer", "json"], "rust", {"title": {}}, [("p", "data-k")]).first()
    assert got["images"] == ["https://e.com/a.png"] and got["summary"] == "Some rust text" and got["attributes"][0]["values"] == ["1"] and got["json"] == {"title": "T"}
    assert "html" not in got.asDict() and got["answer"] == "Some rust text"


def test_nulls(spark):
    n = F.lit(None).cast("string")
    for c in (text.collapsed(n), text.highlights(n, "abc"), text.summary(n), text.best_passage(n, "abc"), text.first_email(n), text.decoded_base64(n), text.rendered_html(n)):
        assert one(spark, c) is None


def test_many_queries_find_what_each_finds(spark):
    """Every query over every document: overlap and passage as trying all of them gives."""
    rng = random.Random(9)
    parts = ["the", "ther", "Über", "ÜBER", "x", "ab", "abc", "中文字", "aaaa", "he t"]
    said = lambda n: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))
    docs = [(i, "\n\n".join(rng.choice(["", "# ", " "]) + said(rng.randint(0, 4)) for _ in range(rng.randint(0, 5)))) for i in range(40)] + [(100, None), (101, ""), (None, "the")]
    queries = [(i, said(rng.randint(0, 3))) for i in range(30)] + [(100, None), (101, "zz, the! the_abc"), (102, "nowhere")]
    d, q = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(queries, "query_id long, query string")
    got = {(r["query_id"], r["id"]): (r["overlap"], r["passage"]) for r in postings.best_passages(d, q).collect()}
    want = {}
    for n, query in queries:
        terms = {t.lower() for t in re.findall(r"[^\W_]+", query or "") if len(t) >= 3}
        for i, body in docs:
            best = (0, "")
            for p in [x.strip() for x in (body or "").split("\n\n")]:
                if p and not p.startswith("#") and (k := sum(t in p.lower() for t in terms)) and k >= best[0]:
                    best = (k, p)
            if best[0] and i is not None:
                want[n, i] = best
    assert got == want and len(want) > 100
    assert postings.best_passages(d.limit(0), q).count() == 0 and postings.best_passages(d, q.limit(0)).count() == 0


def test_terms_are_found_inside_words_whatever_they_hold(spark):
    """Against all pairs: terms at any place of a word, of any length, with marks and signs."""
    words = ["international", "nation", "Internationale", "nátion", "ΟΔΟΣ", "İstanbul", "𝐀𝐁𝐂𝐃", "snake_nation_case", "abc", "xabcx", "ABCDEFGHIJ", "zabcdefghijz", "abcdefghxj"]
    d = spark.createDataFrame([(i, f"- {w}, x\n\n{w}{words[i - 1]}.") for i, w in enumerate(words)], "id bigint, text string")
    q = spark.createDataFrame([(i, w) for i, w in enumerate([*words, "nation abc", "fghij case", "ab"])], "query_id bigint, query string")
    got = {(r["query_id"], r["id"]): (r["overlap"], r["pos"], r["passage"]) for r in postings.best_passages(d, q).collect()}
    asked = postings.terms(q, "query_id", "query").select("query_id", "term")
    held = d.select("id", F.posexplode(text.passages(F.col("text"))).alias("pos", "passage"))
    pairs = asked.crossJoin(held).where(F.contains(F.lower("passage"), F.col("term"))).groupBy("query_id", "id", "pos", "passage").count()
    want = pairs.groupBy("query_id", "id").agg(F.max(F.struct("count", "pos", "passage")).alias("b")).collect()
    assert got == {(r["query_id"], r["id"]): tuple(r["b"]) for r in want} and len(got) > 40


def test_postings_list_words_that_hold_a_term_alone(spark, monkeypatch):
    """Frequent letters in common make no candidates: work grows with hits."""
    listed = {}

    def counted(df, name, to=postings.written):
        out = to(df, name)
        listed[name] = out.count()
        return out

    monkeypatch.setattr(postings, "written", counted)
    d = spark.createDataFrame([(i, f"thethethe{i:04d} theethere") for i in range(300)], "id bigint, text string")
    q = spark.createDataFrame([(i, f"thethethe{i:04d}") for i in range(0, 300, 30)], "query_id bigint, query string")
    assert postings.best_passages(d, q).count() == 10
    assert listed["postings"] == 10 and listed["hits"] == 10
