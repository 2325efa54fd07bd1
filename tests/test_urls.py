"""URL algebra: canonical form, similarity, scope, policies."""

import pytest
from pyspark.sql import functions as F

from loomspark.functions import dom, urls


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "link, ignore, expected",
    [
        ("https://Example.com/docs?a=1#part", False, "https://example.com/docs?a=1"),
        ("https://example.com/#/route", False, "https://example.com/#/route"),
        ("https://example.com/a#!/r", False, "https://example.com/a#!/r"),
        ("https://example.com/docs?a=1#part", True, "https://example.com/docs"),
        ("https://example.com", False, "https://example.com/"),
        ("http://example.com:80/a b", False, "http://example.com/a%20b"),
        ("http://example.com:8080/für", False, "http://example.com:8080/f%C3%BCr"),
        ("http://example.com/a/./b/../c/..", False, "http://example.com/a/"),
        ("mailto:a@b.c", False, None),
        ("nonsense", False, None),
    ],
)
def test_canonical(spark, link, ignore, expected):
    assert one(spark, urls.canonical(F.col("u"), ignore), u=link) == expected


def test_similar_aliases_share_a_key_and_queries_do_not(spark):
    aliases = ["https://www.example.com/docs/", "http://example.com/docs", "https://example.com/docs/index.html", "http://www.example.com/docs/index.php"]
    rows = spark.createDataFrame([(u,) for u in [*aliases, "https://example.com/docs?page=2"]], "u string")
    keys = [r[0] for r in rows.select(urls.similarity_key(F.col("u"))).collect()]
    assert len(set(keys[:4])) == 1 and keys[4] != keys[0]
    assert one(spark, urls.similarity_key(F.col("u"), False), u=aliases[0]) == aliases[0]


def test_scope_widens_by_option(spark):
    links = ["https://example.com/docs/a", "https://blog.example.com/post", "https://other.org/", "https://example.com/about", "https://example.com/docs/a#x", "javascript:x"]
    scoped = lambda **o: one(spark, urls.scoped_links(F.col("l"), F.lit("https://www.example.com/docs/"), **o), l=links)
    assert scoped() == ["https://example.com/docs/a"]
    assert scoped(entire_domain=True, include_subdomains=True) == ["https://example.com/docs/a", "https://blog.example.com/post", "https://example.com/about"]
    assert scoped(allow_external=True) == ["https://example.com/docs/a", "https://blog.example.com/post", "https://other.org/"]
    assert scoped(search="POST", entire_domain=True, include_subdomains=True) == ["https://blog.example.com/post"]


def test_path_prefix_is_plain(spark):
    assert one(spark, urls.in_scope(F.lit("https://a.com/docs2"), F.lit("https://a.com/docs")))


def test_site_map_cuts_before_the_filter(spark):
    base = F.lit("https://a.com/")
    m = urls.site_map(F.array(F.lit("https://b.com/1"), F.lit("https://b.com/2")), F.array(F.lit("https://a.com/x")), base, limit=1)
    got = one(spark, m)
    assert (got["links"], got["provider"]) == (["https://a.com/x"], "sitemap+html_links")
    assert one(spark, urls.site_map(F.array(F.lit("https://b.com/1")), F.array(F.lit("https://a.com/x")), base, mode="only"))["links"] == ["https://a.com/"]
    with pytest.raises(ValueError):
        urls.site_map(F.array(), F.array(), base, mode="maybe")


def test_patterns(spark):
    allowed = lambda u, *a, **k: one(spark, urls.allowed_by_patterns(F.col("u"), *a, **k), u=u)
    assert allowed("https://a.com/docs/x", ["^/docs"], [])
    assert not allowed("https://a.com/docs/private", ["^/docs"], ["private"])
    assert allowed("https://a.com/x?q=1", [r"\?q="], [], full_url=True)
    assert not allowed("::", [], [])
    for bad in ("(", "(?=x)", r"(a)\1"):
        with pytest.raises(ValueError):
            urls.valid_patterns([bad])


@pytest.mark.parametrize("ip, public", [("127.0.0.1", False), ("10.0.0.1", False), ("172.31.0.1", False), ("192.168.1.1", False), ("169.254.1.1", False), ("100.64.0.1", False), ("198.18.0.1", False), ("0.0.0.0", False), ("255.255.255.255", False), ("8.8.8.8", True), ("1.2.3", None), ("999.1.1.1", None)])
def test_public_ipv4(spark, ip, public):
    assert one(spark, urls.public_ipv4(F.col("ip")), ip=ip) is public


@pytest.mark.parametrize("url, kept, error", [("example.com", "https://example.com", None), (" http://A.b/ ", "http://A.b/", None), ("ftp://a.b", "https://ftp://a.b", None), ("", None, "invalid_url"), ("http://localhost:3", None, "blocked_by_policy"), ("http://x.localhost/", None, "blocked_by_policy"), ("http://10.1.2.3/", None, "blocked_by_policy")])
def test_admission(spark, url, kept, error):
    assert tuple(one(spark, urls.admitted(F.col("u")), u=url))[:2] == (kept, error)


def test_domains_and_categories(spark):
    assert one(spark, urls.domain_allowed(F.lit("https://docs.Rust-lang.org/x"), ["www.rust-lang.org"]))
    assert not one(spark, urls.domain_allowed(F.lit("https://notrust-lang.org/x"), ["rust-lang.org"]))
    kinds = [("pdf", ()), ("github", ()), ("research", ())]
    of = lambda u: one(spark, urls.category(F.lit(u), kinds))
    assert (of("https://github.com/a.PDF"), of("https://gist.github.com/a"), of("https://notarxiv.org/a"), of("https://a.com")) == ("pdf", "github", "research", None)


def test_unwrapping(spark):
    of = lambda u: one(spark, urls.unwrapped(F.lit(u)))
    assert of("https://duckduckgo.com/l/?uddg=https%3A%2F%2Fa.com%2F%3Fx%3D1&rut=2") == "https://a.com/?x=1"
    assert of("//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.com") == "//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.com"
    assert of("https://a.com/?uddg=x") == "https://a.com/?uddg=x"


@pytest.mark.parametrize("link, expected", [("?q=é", "http://a.com/x/y?q=%C3%A9"), ("//B.com", "http://b.com/"), ("../z", "http://a.com/z"), ("mailto:a@b", None), ("HTTP://A.com:80/", "http://a.com/"), ("/f g", "http://a.com/f%20g"), ("http://[bad", None)])
def test_join(link, expected):
    assert dom.join("http://a.com/x/y", link) == expected


def test_nulls(spark):
    df = spark.createDataFrame([(None,)], "u string")
    found = df.select(urls.canonical(F.col("u")), urls.similarity_key(F.col("u")), urls.host(F.col("u")), urls.public_ipv4(F.col("u")), urls.admitted(F.col("u"))["error"]).first()
    assert tuple(found) == (None, None, None, None, "invalid_url")
