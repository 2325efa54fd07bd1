"""Robots, feeds, documents, streams, and the entry module."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from loomspark import streaming
from loomspark.sources import documents, feeds, robots


@pytest.mark.parametrize(
    "body, path, agent, allowed",
    [
        ("User-agent: *\nDisallow: /private", "/private/x", "Bot", False),
        ("User-agent: *\nDisallow: /private\nAllow: /private/ok", "/private/ok", "Bot", True),
        ("User-agent: *\nDisallow: /\n\nUser-agent: bot\nAllow: /", "/x", "MyBot/2", True),
        ("User-agent: a\nUser-agent: bot\nDisallow: /x # no", "/x", "bot", False),
        ("User-agent: *\nDisallow: /*.pdf$", "/a.pdf", "b", False),
        ("User-agent: *\nDisallow: /*.pdf$", "/a.pdf?x=1", "b", True),
        ("User-agent: *\nDisallow:", "/x", "b", True),
        ("Disallow: /", "/x", "b", True),
        ("User-agent: *\nDisallow: /a\nAllow: /a", "/a", "b", True),
    ],
)
def test_robots(body, path, agent, allowed):
    assert robots.allows(body, path, agent) is allowed


def test_robots_checks_the_path_with_a_slash_too(spark):
    df = spark.createDataFrame([("User-agent: *\nDisallow: /docs/", "https://a.com/docs"), (None, "https://a.com/docs"), ("x", None)], "body string, url string")
    assert [r[0] for r in df.select(robots.allowed(F.col("body"), F.col("url"), "b")).collect()] == [False, True, None]


def test_feeds(spark):
    df = spark.createDataFrame([(1, '<rss><item><title>A &amp; B</title><link>https://a</link><description>x\n y</description></item><item><title>no link</title></item></rss>', '<div class="result"><a class="result__a" href="https://duckduckgo.com/l/?uddg=https%3A%2F%2Fz">T</a><a class="result__snippet">S</a></div><div class="result">none</div>', "<a class=iusc m='{\"murl\":\"https://i/1.png\",\"t\":\"cat\"}'></a><a class=iusc m='{}'></a>")], "id int, rss string, web string, img string")
    assert [tuple(r) for r in feeds.news(df, 5, "rss").select("title", "url", "description").collect()] == [("A & B", "https://a", "x y")]
    assert [tuple(r) for r in feeds.web_results(df, 5, "web").select("url", "title", "description").collect()] == [("https://z", "T", "S")]
    assert [r["url"] for r in df.select(feeds.image_results(F.col("img")).alias("x")).first()["x"]] == ["https://i/1.png"]
    assert df.select(feeds.sitemap_locations(F.lit("<loc>a&amp;b</loc><loc>c</loc>"), 5)).first()[0] == ["a&b", "c"]


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_documents(spark):
    w = 'xmlns:w="http://w"'
    docx = _zip({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Text</w:t></w:r></w:p></w:body></w:document>'})
    xlsx = _zip({"xl/workbook.xml": '<workbook xmlns:r="http://r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><x Id="r1" Target="worksheets/s.xml"/></R>', "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>", "xl/worksheets/s.xml": '<w><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2"><v>1</v></c><c r="C2"><v>3</v></c></row></sheetData></w>'})
    odt = _zip({"content.xml": '<d xmlns:t="u"><t:p>para</t:p><t:h t:outline-level="2">head</t:h></d>'})
    rows = [("a.docx", docx), ("b.XLSX", xlsx), ("c.odt", odt), ("d.rtf", rb"{\rtf1{\fonttbl x;}Hi \b bold\b0\par two \'e9}"), ("e.htm", b"<script>x</script><h2>H</h2><p>P <b>q</b></p>"), ("f.pdf", b"x"), ("g", b"x"), ("h.docx", b"broken"), ("i.rtf", None)]
    got = {r["filename"]: (r["markdown"], r["error"]) for r in documents.parsed(spark.createDataFrame(rows, "filename string, data binary")).collect()}
    assert got["a.docx"][0] == "## Head\n\nText\n\n| c1 |\n| --- |"
    assert got["b.XLSX"][0] == "## S\n\n| name |  |  |\n| --- | --- | --- |\n| 1 |  | 3 |"
    assert got["c.odt"][0] == "## head\n\npara" and got["d.rtf"][0] == "Hi bold\n\ntwo é" and got["e.htm"][0] == "## H\n\nP **q**"
    assert all(got[k][0] is None and got[k][1] for k in ("f.pdf", "g", "h.docx", "i.rtf"))


def test_html_documents_keep_links_marks_lists_and_tables():
    page = b"""<head><title>t</title></head><body>lead <i>in</i><h1>Top <em>x</em></h1><p>One <b> bold </b>and <a href="/u">a <code>link</code></a>,<br>next <img src="i.png" alt="pic"></p>
    <ul><li>a <b>b</b><ul><li>c</li><li>d</li></ul></li><li><p>e</p><p>f</p></li></ul><ol><li>x</li><li>y</li></ol><blockquote><p>said</p><p>twice</p></blockquote><pre>l1
 l2</pre><hr><table><tr><th>k</th><td><b>v</b></td></tr><tr><td>1</td></tr></table><div>tail<script>no()</script></div></body>"""
    assert documents.html_document(page).split("\n\n") == [
        "lead *in*",
        "# Top *x*",
        "One **bold** and [a `link`](/u),  \nnext ![pic](i.png)",
        "* a **b**\n  * c\n  * d\n* e",
        "  f",
        "1. x\n2. y",
        "> said\n>\n> twice",
        "```\nl1\n l2\n```",
        "---",
        "| k | **v** |\n| --- | --- |\n| 1 |  |",
        "tail",
    ]


def test_pdf_pages_use_recognised_text_where_there_is_little(spark):
    p = spark.createDataFrame([(1, 2, "second page with enough text", "no"), (1, 1, "x", "scan")], "id int, page int, text string, ocr_text string")
    of = lambda mode: documents.pdf_pages(p, mode).first()["text"]
    assert (of("auto"), of("ocr"), of("text")) == ("scan\n\nsecond page with enough text", "scan\n\nno", "x\n\nsecond page with enough text")


def test_streams(spark, tmp_path):
    e = spark.createDataFrame([(i % 3, f"2026-01-01 10:0{i}:00", float(i)) for i in range(6)], "k int, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: streaming.file_stream(spark, str(tmp_path / "in"))

    def drained(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    assert drained(streaming.progress(stream(), "k"), "seen").count() == 3
    assert drained(streaming.windowed(stream(), "k"), "hours", "complete").agg(F.sum("n")).first()[0] == 6
    assert drained(streaming.limited(stream(), 1, "k"), "let_in").where("allowed").count() == 6
    got = []
    q = streaming.at_most_once(stream(), str(tmp_path / "loop"), lambda b, i: got.append((i, b.count())))
    q.awaitTermination(120)
    assert got == [(0, 6)]


def _replayed(spark, folder, name, batches, schema, make, mode="append"):
    """Each batch is a file and a micro-batch of its own; the query is started anew for each, so
    that state comes back from the checkpoint."""
    into = folder / name
    out = []
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(*r[:-1], f"2026-01-01 {r[-1]}") for r in rows], schema).withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(str(into / "in"))
        got = []
        q = make(streaming.file_stream(spark, str(into / "in"))).writeStream.outputMode(mode).foreachBatch(lambda b, _, got=got: got.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(into / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        out.append(sorted(got, key=str))
    return out


def test_feed_over_several_batches_and_restarts(spark, tmp_path):
    page = lambda job, request, at, last=False: (job, request, last, at)
    got = _replayed(
        spark,
        tmp_path,
        "feed",
        [
            [page("a", "r2", "10:00:02"), page("a", "r1", "10:00:01"), page("b", "x", "10:00:01", True)],
            [page("a", "r2", "10:00:02"), page("a", "r3", "10:00:05"), page("b", "late", "10:00:06")],
            [page("a", "r4", "10:00:07"), page("a", None, "10:00:08", True)],
            [page("a", "r5", "10:00:09"), page("c", None, "10:00:09")],
        ],
        "job_id string, request_id string, terminal boolean, ts string",
        streaming.feed,
    )
    short = [[(r[0], r[1], r[2]) for r in b] for b in got]
    assert short == [
        [("a", "catchup", ["r1", "r2"]), ("b", "catchup", ["x"]), ("b", "done", [])],
        [("a", "document", ["r3"])],
        [("a", "document", ["r4"]), ("a", "done", [])],
        [("c", "catchup", [])],
    ]


def test_limiter_stream_keeps_state_and_forgets_idle_keys(spark, tmp_path):
    got = _replayed(
        spark,
        tmp_path,
        "limited",
        [
            [("k", "10:00:30"), ("k", "10:00:00"), ("k", "10:00:59"), (None, "10:00:00"), (None, "10:00:01"), (None, "10:00:02")],
            [("k", "10:01:00"), ("k", "10:01:01"), ("l", "10:01:01")],
            [("z", "11:00:00")],
            [("k", "10:01:30"), ("z", "11:00:01"), ("z", "11:00:02")],  # the first is later than the watermark
        ],
        "key string, ts string",
        lambda s: streaming.limited(s, 2, late="10 minutes"),
    )
    short = [sorted((r[0] or "", f"{r[1]:%H:%M:%S}", r[2]) for r in b) for b in got]
    assert short == [
        [("", "10:00:00", True), ("", "10:00:01", True), ("", "10:00:02", False), ("k", "10:00:00", True), ("k", "10:00:30", True), ("k", "10:00:59", False)],
        [("k", "10:01:00", True), ("k", "10:01:01", False), ("l", "10:01:01", True)],
        [("z", "11:00:00", True)],
        [("z", "11:00:01", True), ("z", "11:00:02", False)],
    ]


def test_task_timers_fire_by_event_time(spark, tmp_path):
    got = _replayed(
        spark,
        tmp_path,
        "timers",
        [
            [("t", "claimed", "10:00:00"), ("t", "renewed", "10:01:00"), ("u", "claimed", "10:00:00"), ("u", "failed", "10:00:10"), ("v", "claimed", "10:00:00"), ("v", "finished", "10:00:20")],
            [("w", "claimed", "10:30:00")],  # the watermark passes the others' timers
            [("t", "claimed", "10:31:00"), ("t", "failed", "10:31:30"), ("t", "claimed", "10:31:39"), ("t", "claimed", "10:31:41"), ("w", "finished", "10:31:00")],
            [("x", "claimed", "12:00:00")],
        ],
        "task_id string, event string, ts string",
        streaming.task_timers,
    )
    short = [sorted((r[0], r[1], f"{r[2]:%H:%M:%S}", r[3]) for r in b) for b in got]
    assert short == [
        [],
        [("t", "lease_expired", "10:02:30", 1), ("u", "retry_due", "10:00:15", 1)],
        [("t", "retry_due", "10:31:40", 2)],  # a claim before that doesn't count
        [("t", "lease_expired", "10:33:11", 3)],
    ]


def test_sessions_end_by_gap_or_by_age(spark, tmp_path):
    minutes = [f"10:{m:02d}:00" for m in range(0, 60, 10)]
    got = _replayed(
        spark,
        tmp_path,
        "sessions",
        [[("a", minutes[0]), ("b", minutes[0])], [("a", m) for m in minutes[1:]], [("c", "13:00:00")]],
        "key string, ts string",
        lambda s: streaming.sessions(s, "key", gap_s=900, ttl_s=1800, late="1 hour"),
    )
    short = [sorted((r[0], f"{r[1]:%H:%M}", f"{r[2]:%H:%M}", r[3], r[4]) for r in b) for b in got]
    assert short[0] == [] and short[1] == [("a", "10:00", "10:30", "ttl", 3)]
    assert short[2] == [("a", "10:30", "11:00", "ttl", 3), ("b", "10:00", "10:15", "idle", 1)]


def test_worker_replaces_the_result_of_a_batch_tried_again(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda state: streaming.worker(streaming.file_stream(spark, str(tmp_path / "in")), str(tmp_path / state), str(tmp_path / "out"), lambda b: b.withColumn("x", F.col("id") * 2)).awaitTermination(120)
    run("state")
    run("state")  # nothing is left to do
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
    run("lost")  # without its memory it does all again, into the same places
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("x")).first()[0] == 2 * sum(range(30))


def test_entry_has_a_query_for_each_sql(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns == ["page_id", "host", "title", "language", "markdown_chars", "quality"] and df.count() == 20


def test_entry_can_be_read_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=root, check=True, timeout=120)


def test_rules_as_a_table_decide_as_the_walk_does(spark):
    """Every file, path and agent: the join by (file, key) gives what trying all rules gives."""
    rng = random.Random(8)
    pieces = ["/", "a", "b/", "/a", "*", "$", "é", "?q", "/b*", ".html", "/a/b", "%20", "//"]
    lines = ["", "# x", "User-agent: *", "user-agent: Loom", "User-Agent : bot # y", "User-agent:", "User-agent: other", "Allow:", "nonsense", "Sitemap: https://x/", " disallow :/a"]
    line = lambda: rng.choice(lines) if rng.random() < 0.4 else f"{rng.choice(['Allow', 'Disallow', 'DISALLOW'])}: {''.join(rng.choice(pieces) for _ in range(rng.randint(1, 4)))}"
    bodies = [rng.choice(["\n", "\r\n"]).join(line() for _ in range(rng.randint(0, 14))) for _ in range(60)] + [None, ""]
    files = [(f"https://h{i}.org/robots.txt", b) for i, b in enumerate(bodies)]
    paths = ["/", "/a", "/a/", "/a/b", "/a/b/c.html", "/b/a.html?q=1", "/?q", "/%20a", "//a", "/a//b", "/b%C3%A9", "/ab"]
    rows = spark.createDataFrame([(f"https://h{i}.org{p}", b) for i, b in enumerate(bodies) for p in paths] + [("nonsense", "x"), ("https://none.org/a", None), (None, None)], "url string, body string")
    for agent in ("LoomBot/1.0", "other", "x"):
        rules = robots.index(spark.createDataFrame(files, "url string, body string"), agent)
        got = robots.judged(rows, rules, F.col("url")).select("url", "body", "allowed", robots.allowed(F.col("body"), F.col("url"), agent).alias("walked")).collect()
        assert len(got) == rows.count()
        assert [r for r in got if r["allowed"] != r["walked"] and r["url"] != "nonsense"] == []
        assert {r["allowed"] for r in got} == {True, False, None}


def test_sessions_wait_for_the_watermark_where_asked(spark, tmp_path):
    """What a later row shows doesn't come out before the watermark; a late row takes its place."""
    batches = [[("a", "10:00:00"), ("a", "10:40:00")], [("a", "10:10:00"), ("b", "11:20:00")], [("b", "11:50:00"), ("c", "11:50:00")], [("d", "13:00:00")]]
    got = _replayed(spark, tmp_path, "settled", batches, "key string, ts string", lambda s: streaming.sessions(s, "key", gap_s=900, ttl_s=7200, late="1 hour", early=False))
    short = [sorted((r[0], f"{r[1]:%H:%M}", f"{r[2]:%H:%M}", r[3], r[4]) for r in b) for b in got]
    assert sum(short, []) == [("a", "10:00", "10:25", "idle", 2), ("a", "10:40", "10:55", "idle", 1), ("b", "11:20", "11:35", "idle", 1)]
    assert short[:2] == [[], []]


def test_timers_wait_for_the_watermark_where_asked(spark, tmp_path):
    """A lease that a later claim overtakes fires after the watermark; attempts outlive a rest."""
    batches = [[("t", "claimed", "10:00:00"), ("t", "claimed", "10:05:00")], [("t", "renewed", "10:01:00"), ("u", "claimed", "10:04:00")], [("u", "finished", "13:00:00")], [("u", "claimed", "14:30:00")], [("t", "claimed", "16:00:00"), ("u", "claimed", "16:30:00")], [("v", "claimed", "17:00:00")]]
    got = _replayed(spark, tmp_path, "settled", batches, "task_id string, event string, ts string", lambda s: streaming.task_timers(s, early=False))
    short = [sorted((r[0], r[1], f"{r[2]:%H:%M:%S}", r[3]) for r in b) for b in got]
    assert short[:2] == [[], []]
    assert [x for x in sum(short, []) if x[0] == "t"] == [("t", "lease_expired", "10:02:30", 1), ("t", "lease_expired", "10:06:30", 2), ("t", "lease_expired", "16:01:30", 3)]
