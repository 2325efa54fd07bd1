"""Canonical hosts: number forms, percent, Bootstring against Python's codec, ports, admission."""

import random

import pytest
from pyspark.sql import functions as F

from loomspark.functions import dom, hosts, urls

FORMS = {
    "a.org": "a.org", "A.ORG": "a.org", "a..b": "a..b", "x.": "x.", "a_b.org": "a_b.org", "2130706433": "127.0.0.1", "127.1": "127.0.0.1", "0x7f.1": "127.0.0.1", "0177.0.0.1": "127.0.0.1", "127.0.0.1.": "127.0.0.1", "%31%32%37.0.0.1": "127.0.0.1",
    "0x": "0.0.0.0", "0X7F000001": "127.0.0.1", "1.2.3": "1.2.0.3", "4294967295": "255.255.255.255", "4294967296": None, "1.2.65536": None, "1.2.3.4.5": None, "256.1.1.1": None, "09": None, "a.0x1": None, "a.1": None, "1..2": None, "00000000000000000000000000001": "0.0.0.1",
    "４２": "0.0.0.42", "ａ．org": "a.org", "BÜcher.example": "xn--bcher-kva.example", "xn--bcher-kva.example": "xn--bcher-kva.example", "%C3%BC.org": "xn--tda.org", "a­b.org": "ab.org", "日本。jp": "xn--wgv71a.jp",
    "a%20b": None, "%zz": None, "%ff": None, "a%2fb": None, "a|b": None, "a^b": None, "a+b.org": "a+b.org",
    "[::1]": "[::1]", "[0:0:0:0:0:0:0:1]": "[::1]", "[2001:DB8:0:0:1:0:0:1]": "[2001:db8::1:0:0:1]", "[1:0:0:2:0:0:0:3]": "[1:0:0:2::3]", "[1:2:3:4:5:6:7:0]": "[1:2:3:4:5:6:7:0]", "[::]": "[::]", "[1::2::3]": None, "[::ffff:1.2.3.4]": "[::ffff:102:304]",
}


def test_forms(spark):
    rows = spark.createDataFrame([(h,) for h in FORMS], "h string")
    u = F.concat(F.lit("http://"), "h", F.lit("/x"))
    got = {r["h"]: (r["host"], r["c"]) for r in rows.select("h", urls.host(u).alias("host"), urls.canonical(u).alias("c")).collect()}
    assert {h: x[0] for h, x in got.items()} == FORMS
    assert all(c == (None if h is None else f"http://{h}/x") for h, c in got.values())


def test_links_are_joined_to_the_same_hosts():
    for raw, want in FORMS.items():
        got = dom.join("http://base.org/", f"http://{raw}/x")
        # Python's own splitting refuses some of them sooner.
        assert got == (None if want is None else f"http://{want}/x"), raw


def test_bootstring_equals_the_codec(spark):
    rng = random.Random(1)
    signs = "abcxyz019-éüßжщ中文日本\U0001f642\U0001f600α"
    labels = {"".join(rng.choice(signs) for _ in range(rng.randint(1, 24))) for _ in range(300)}
    labels = sorted(x for x in labels if not x.isascii())
    rows = spark.createDataFrame([(x,) for x in labels], "x string")
    for r in rows.select("x", hosts.bootstring(F.col("x")).alias("b")).collect():
        assert r["b"] == r["x"].encode("punycode").decode(), r["x"]


@pytest.mark.parametrize("port, want", [("", ""), (":", ""), (":80", ""), (":0080", ""), (":8080", ":8080"), (":65535", ":65535"), (":0", ":0"), (":00", ":0"), (":65536", None), (":99999", None), (":100000", None), (":8x", None)])
def test_ports(spark, port, want):
    got = spark.range(1).select(urls.canonical(F.lit(f"http://a.org{port}/p"))).first()[0]
    assert got == (None if want is None else f"http://a.org{want}/p")


def test_admission_sees_the_canonical_host(spark):
    blocked = ["2130706433", "127.1", "0x7f.1", "0177.0.0.1", "127.0.0.1.", "%31%32%37.0.0.1", "LocalHost", "%6cocalhost", "a.localhost", "3232235521"]
    bad = ["a.org:99999", "4294967296", "a b", "%zz", "1.2.3.4.5"]
    fine = ["8.8.8.8", "134744072", "bücher.example", "a.org:65535", "[::1]"]
    rows = spark.createDataFrame([(h,) for h in [*blocked, *bad, *fine]], "h string")
    got = {r["h"]: r["a"] for r in rows.select("h", urls.admitted(F.concat(F.lit("http://"), "h", F.lit("/"))).alias("a")).collect()}
    assert {h: got[h]["error"] for h in blocked} == dict.fromkeys(blocked, "blocked_by_policy")
    assert {h: got[h]["error"] for h in bad} == dict.fromkeys(bad, "invalid_url")
    assert {h: (got[h]["url"], got[h]["error"]) for h in fine} == {h: (f"http://{h}/", None) for h in fine}


def test_keys_of_one_host_are_equal(spark):
    rows = spark.createDataFrame([(u,) for u in ("http://Bücher.example/a", "https://www.xn--bcher-kva.example:443/a/", "http://b%C3%BCcher.example/a")], "u string")
    assert {r[0] for r in rows.select(urls.similarity_key(F.col("u"))).collect()} == {"http://xn--bcher-kva.example/a"}
