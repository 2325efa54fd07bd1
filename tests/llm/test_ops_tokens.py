"""BPE, shards, nearest neighbours, main text; and the queries and pipeline over a small table."""

import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import ann, bpe, main_text, queries, sstable

tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts():
    rng = random.Random(9)
    signs = "abcdefghij'.,!?0123ÀÉéèßçñΣσςİıǅﬁ中文日本🙂👍́‍\x85\x1c\x1d\t\n ½²³Ⅷ٣"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(600)]
    texts += ["".join(rng.choice("aeinrstlo") for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    return texts + ["", " ", "don't DON'T we'll x's", "a" * 300, "!" * 70, "<|startoftext|>hi<|endoftext|><|ENDOFTEXT|>", "<|endoftext|>", "x <|endoftext|>\ny"]


def test_bpe_equals_the_library(library):
    coder = bpe.WordBpe(queries.tokenizer_path())
    texts = odd_texts()
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids, decoded = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
        assert decoded == coder.decode(ids) == library.decode(want.ids, skip_special_tokens=False)
    assert coder.encode(None) == (b"", "")


def test_shard_encoder_equals_the_library(library):
    coder = sstable.Encoder(queries.tokenizer_path())
    marks = [chr(c) for c in range(0x300, 0x36F)]
    letters = [chr(c) for c in [*range(0x41, 0x5B), *range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)] if chr(c).lower() != chr(c)]
    texts = ["H\u0331aw", "J\u030can", "T\u0308a W\u030a Y\u030a", "\u03aa\u0301 \u0391\u0342", "\u212a \u212b E\u0301COLE", "\u00c9COLE \u00dcber Stra\u1e9eE", *odd_texts()]
    texts += [" ".join(f"{x}{m}aw" for m in marks) for x in letters]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == want


def test_every_token_of_the_vocabulary_is_its_own_encoding(library):
    coder = bpe.WordBpe(queries.tokenizer_path())
    words = [t[:-4] for t in coder.tokens.values() if t.endswith("</w>") and t[:-4].isascii() and t[:-4].isalpha()]
    for w in words[::7]:
        assert np.frombuffer(coder.encode(w)[0], "<u4").tolist() == library.encode(w, add_special_tokens=False).ids


def test_bpe_column(spark):
    df = spark.createDataFrame([(1, "Hello world"), (1, None), (None, "")], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = bpe.encode(df, queries.tokenizer_path()).collect()
    assert [len(r["ids"]) for r in got] == [2, 0, 0] and got[0]["decoded"] == "hello</w> world</w>"
    assert bpe.encode(df.limit(0), queries.tokenizer_path(), digest=True).count() == 0


def test_shard_round_trip():
    rng = random.Random(10)
    rows = [(None, [1])] + sorted((rng.randint(-(1 << 62), 1 << 62), [rng.randint(0, 1 << 32 - 1) for _ in range(rng.randint(0, 40))]) for _ in range(500))
    rows += [((1 << 63) - 1, [7])] * 3
    out = io.BytesIO()
    w = sstable.Writer(out, block_size=200)
    pack = lambda ids: np.array(ids, "<u4").tobytes()
    for key, ids in rows:
        w.add(key, pack(ids))
    w.close()
    r = sstable.Reader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert list(r) == [(k, pack(x)) for k, x in rows] and len(r.places) > 10
    assert r.get(None) == [pack([1])] and r.get((1 << 63) - 1) == [pack([7])] * 3
    for key, ids in rows[1:60]:
        assert pack(ids) in r.get(key)
    assert sum(bool(r.get(k)) for k in range(1000)) == 0
    with pytest.raises(ValueError):
        w.add(3, b"")
    damaged = bytearray(out.getvalue())
    damaged[10] ^= 1
    with pytest.raises(ValueError):
        list(sstable.Reader(io.BytesIO(bytes(damaged)), len(damaged)))


def test_shards_of_a_table(spark, library):
    rng = random.Random(11)
    texts = odd_texts()[:80] + [None]
    rows = [(rng.randint(-50, 50) if i else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("x"))
    manifest = sstable.write(df, queries.tokenizer_path(), shard_rows=20)
    got = sstable.read(manifest, digest=True).orderBy("start").collect()
    want = sorted((-999 if i is None else i, zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes())) for i, t in rows)
    assert sorted((-999 if r["doc_id"] is None else r["doc_id"], r["ids_crc32"]) for r in got) == want
    keys = [-999 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert keys == sorted(keys) and manifest.count() > 1
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert sstable.read(sstable.write(df.limit(0), queries.tokenizer_path())).count() == 0


def test_shard_encoder_forgets_and_remembers(library, monkeypatch):
    monkeypatch.setattr(sstable.Encoder, "REMEMBERED", 40)
    coder = sstable.Encoder(queries.tokenizer_path(), end_id=1)
    rng = random.Random(15)
    words = ["".join(rng.choice("abcdeéüß") for _ in range(rng.randint(1, 6))) for _ in range(300)] + ["x" * 90, "don't", "i'll", "''s", "a's1", "</w>", "w>", "½x²", "ªº", "×÷", "\u00ad", "naïve—x", "日本x"]
    for _ in range(30):
        texts = [rng.choice([" ", "  ", "\t", "\r\n", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(8)] + [None]
        want = [e.ids + [1] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [np.frombuffer(x[1:], "<u2").tolist() for x in coder.values(texts)] == want
    assert max(map(len, coder.known)) <= coder.LONG


def test_lookup_opens_few_shards_and_blocks(spark, library):
    rows = [(7 * i, f"word{i} " * 400) for i in range(300)] + [(70, "again"), (None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = sstable.write(df, queries.tokenizer_path(), shard_rows=60)
    asked = [70, 71, 7 * 299, None, -5, 10**12, 70, 7 * 150]
    found = sstable.lookup(manifest, asked).collect()
    want = sorted((-1 if i is None else i, library.encode(t, add_special_tokens=False).ids + [1]) for i, t in rows if i in asked)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids"]) for r in found) == want
    assert all(1 <= r["blocks"] <= 2 for r in found)
    assert sstable.lookup(manifest, []).count() == 0
    assert sstable.lookup(sstable.write(df.limit(0), queries.tokenizer_path()), asked).count() == 0


def test_a_row_repeated_many_times_fills_several_shards(spark):
    rows = [(5, "same text")] * 300 + [(i, f"text {i}") for i in range(40)] + [(None, "none")] * 100
    manifest = sstable.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), queries.tokenizer_path(), shard_rows=40)
    sizes = [r["entries"] for r in manifest.collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 120 and len(sizes) >= 6
    got = sstable.read(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 100 + sorted(i for i, _ in rows if i is not None)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))
    assert sstable.lookup(manifest, [5]).count() == 301 and sstable.lookup(manifest, [None, 39]).count() == 101


def test_reader_reads_one_block_for_a_key():
    out = io.BytesIO()
    w = sstable.Writer(out, block_size=100)
    for i in range(1000):
        w.add(2 * i, np.arange(9, dtype="<u4").tobytes())
    w.close()
    r = sstable.Reader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert len(r.places) > 100
    for i in range(0, 2000, 77):
        before = r.blocks_read
        assert len(r.get(i)) == (i % 2 == 0) and r.blocks_read - before <= 2
    missing = r.blocks_read
    assert not any(r.get(i) for i in range(1, 2001, 2)) and r.blocks_read - missing < 100  # the filter answers


def brute(ids, v, asked, k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for q in asked:
        s = (u * u[ids.index(q)]).sum(axis=1)
        out[q] = [(ids[j], s[j]) for j in sorted(range(len(ids)), key=lambda j: (-s[j], ids[j])) if ids[j] != q][:k]
    return out


def test_neighbours_are_exact_where_all_are_reranked(spark):
    rng = np.random.default_rng(12)
    v = rng.normal(size=(300, 7))
    v[50:140] = v[50]  # a vector that a third of the rows hold
    ids = list(range(0, 600, 2))
    rows = [(i, [float(x) for x in r]) for i, r in zip(ids, v, strict=True)]
    bad = [(1001, None), (1003, [0.0] * 7), (1005, [float("nan")] + [1.0] * 6), (1007, [float("inf")] + [1.0] * 6), (1009, [1.0]), (1011, [None] + [1.0] * 6), (None, [1.0] * 7)]
    df = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<double>").withColumn("q", F.lit(1)).withColumn("v", F.lit(1))
    asked = [i for i in ids if i % 50 == 0]
    got = {}
    for r in ann.neighbours(df, df.where("vec_id % 50 = 0"), rerank=300, block_rows=64, block_queries=4, chunk=32).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    want = brute(ids, v, asked, 5)
    assert set(got) == set(asked)
    for q in asked:
        assert [g[0] for g in got[q]] == [w[0] for w in want[q]] and [g[2] for g in got[q]] == [1, 2, 3, 4, 5]
        assert max(abs(g[1] - w[1]) for g, w in zip(got[q], want[q], strict=True)) < 1e-12
    assert ann.neighbours(df.limit(0), df.limit(0)).count() == 0
    assert ann.neighbours(df.where("vec_id < 4"), df.where("vec_id = 0")).count() == 1


def test_scan_by_bytes_adds_the_centres_scores():
    rng = np.random.default_rng(16)
    for dims in (7, 8, 10):
        x = rng.normal(size=(200, dims))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        model = ann.fit(x)
        codes, a = model.codes(x), x[:9]
        want = model.parts(a).reshape(9, -1) @ model.centres[np.arange(codes.shape[1])[None, :], codes].reshape(200, -1).T
        bytes_ = ann.packed(codes)
        assert bytes_.shape == (-(-codes.shape[1] // 2), 200) and bytes_.dtype == np.uint8
        assert np.allclose(ann.scanned(model.byte_tables(a), bytes_, chunk=64), want, atol=1e-5)


def test_neighbours_have_the_length_of_the_query(spark):
    rng = np.random.default_rng(17)
    rows = [(i, rng.normal(size=3 if i % 3 else 6).tolist()) for i in range(120)] + [(500, [1.0, -0.0, 0.0]), (501, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.neighbours(df, df.where("vec_id % 50 = 0"), block_rows=16).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for d in (3, 6):
        ids = [i for i, v in rows if len(v) == d]
        want = brute(ids, np.array([v for _, v in rows if len(v) == d]), [i for i in ids if i % 50 == 0], 5)
        assert {q: got[q] for q in want} == {q: [i for i, _ in w] for q, w in want.items()}


def test_neighbours_among_near_equal_vectors(spark):
    rng = np.random.default_rng(14)
    v = rng.normal(size=(3000, 16))
    group = rng.permutation(3000)[:1000]  # a third of the rows: one vector with a little noise
    v[group] = v[group[0]] + 0.01 * rng.normal(size=(1000, 16))
    ids = list(range(3000))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
    asked = [i for i in ids if i % 50 == 0]
    got = {}
    for r in ann.neighbours(df, df.where("vec_id % 50 = 0")).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [i for i, _ in w] for q, w in brute(ids, v, asked, 5).items()}


def test_quantiser_prefers_small_parallel_residuals():
    rng = np.random.default_rng(13)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    parallel = {}
    for eta in (1.0, 6.0):
        q = ann.fit(x, eta)
        code = q.codes(x)
        back = q.centres[np.arange(code.shape[1])[None, :], code].reshape(len(x), -1)[:, :16]
        parallel[eta] = (((x - back) * x).sum(axis=1) ** 2).mean()
        assert code.max() < 16
        assert np.allclose(q.table(x[:3])[:, :16], (q.parts(x[:3])[:, :1] @ q.centres[0].T)[:, 0], atol=1e-6)
    assert parallel[6.0] < 0.5 * parallel[1.0]


@pytest.mark.parametrize("folder", ["0.001", "0.01", "0.1"])
def test_recall_on_the_test_tables(spark, folder):
    folder = SF.replace("0.001", folder)
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, v = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    want = brute(ids, v, [i for i in ids if i % 50 == 0], 5)
    found = queries.op7_ann(spark, folder).collect()
    assert all(abs(r["score"] - want[r["query_id"]][r["rank"] - 1][1]) < 1e-9 for r in found)
    hits = sum(r["vec_id"] in {w[0] for w in want[r["query_id"]]} for r in found)
    assert len(found) == 5 * len(want) and hits >= 0.99 * len(found)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="site"><a href=/>Home</a></header><nav><ul><li><a>x</a></ul></nav>
<div id="wrap"><div class="post"><header><h1>Head&amp;line</h1></header><p>One para, with commas, and length to be sure it counts.<p>Short &lt; sweet.<!-- no --><ul><li>item <b>one</b><li>item two</ul>
<blockquote>Quoted</blockquote><table><tr><td>cell a<td>cell b</table><pre>x  =
 1</pre></div><div class="sidebar"><p>Side, side, side, and a lot of text to be longer than others.</p></div><div id="comments"><p>Reader says, a very long comment, that goes on, and on, and on.</p></div></div>
<form><p>Sign up, please, now, and get all of it</p></form><div class="cookie-notice">We use cookies</div><script>var a = "<p>x</p>";</script><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert main_text.extract(PAGE).split("\n") == ["Head&line", "One para, with commas, and length to be sure it counts.", "Short < sweet.", "item one", "item two", "Quoted", "cell a", "cell b", "x = 1"]
    assert [main_text.extract(p) for p in (None, "", "<p>", "plain &eacute;", "<nav>menu</nav>", "<p>a<br>b")] == ["", "", "", "plain é", "", "a b"]
    assert main_text.extract("<div>" * 5000 + "deep text that is long enough to count") == "deep text that is long enough to count"
    assert main_text.extract("<article><p>" + "long text, " * 50000 + "</p></article>").count("long") == 50000


def test_main_text_siblings():
    para = "A paragraph of the story, with commas, and enough words to give its parent points."
    page = f"<body><h1>Title</h1><div class=x><p>{para}</p><p>{para}</p><p>{para}</p></div><div class=x><p>{para}</p></div><div><a href=1>only links, many of them, all here and there</a></div></body>"
    assert main_text.extract(page).split("\n") == ["Title", para, para, para, para]


def test_main_text_attributes_are_whole_names():
    para = "A paragraph of the story, with commas, and enough words to give its parent points."
    for page in (
        f'<body style="overflow-x:hidden"><p>{para}</p></body>',
        f'<body><div id=content style="overflow:hidden"><p>{para}</p></div></body>',
        f'<body><article data-id="search" title="a hidden class=menu"><p>{para}</p></article></body>',
        f"<body><div title='id=\"search\" hidden' data-role=menu><p>{para}</p></div></body>",
    ):
        assert main_text.extract(page) == para
    links = '<a href="/hidden-gems.html">One</a> <a href="/p?id=search">two</a> <a href=/guide/hidden-costs>three</a>'
    assert main_text.extract(f"<article><p>{para} {links}</p></article>") == f"{para} One two three"
    gone = "".join(f"<div {a}><p>{para} Not this.</p></div>" for a in ("hidden", "HIDDEN=''", 'aria-hidden="true"', "class=sidebar", 'title="x"id="comments"', "role = 'search'"))
    assert main_text.extract(f"<body><div aria-hidden=false><p>{para}</p>{gone}</div></body>") == para


def test_main_text_in_a_form():
    para = "A paragraph of the story, with commas, and enough words to give its parent points."
    controls = '<label>Name of the reader</label><input name=q><select><option>One</select><button>Send it</button>'
    wide = f'<body><form id="aspnetForm" class="search">{{}}</form><footer>Foot</footer></body>'
    assert main_text.extract(wide.format(f"<h1>Title</h1><div><p>{para}</p>{controls}<p>{para}</p></div>")).split("\n") == ["Title", para, para]
    assert main_text.extract(wide.format(f"{controls}<article><h1>Title</h1><p>Short.</p></article>")).split("\n") == ["Title", "Short."]
    assert main_text.extract(wide.format(f"{controls}{para}<br>{para}")) == f"{para} {para}"
    inner = f'<form class="search"><p>Search in all of our articles, please</p>{controls}</form>'
    assert main_text.extract(wide.format(f"{inner}<div><p>{para}</p><p>{para}</p></div>")).split("\n") == [para, para]
    sign = "<form><p>Sign up for our letter, and get all of the news, once a week.</p><input></form>"
    assert main_text.extract(f"<article><p>{para}</p>{sign}<p>{para}</p>{inner}</article>").split("\n") == [para, para]
    assert main_text.extract(f"<body><div><p>{para}</p></div><form hidden><article><p>{para} No.</p></article></form></body>") == para
    assert main_text.extract("<form>" * 5000 + f"<p>{para}") == para


def test_main_text_names_of_the_text_itself():
    para = "A paragraph of the story, with commas, and enough words to give its parent points."
    heads = [f'<h2 id="{x}">{x}</h2>' for x in ("related-work", "social-impact", "search", "informed-consent")] + ['<h3 id="comment-syntax">comment-syntax</h3>']
    body = f'<p>{para}</p>' + "".join(heads) + f'<div class="section-header"><h2>Part</h2></div><p class="ad-hoc">{para}</p><ul><li class="menu-item">Soup</li></ul><p>Call <code><span class="token comment">sharing()</span></code></p>'
    want = [para, "related-work", "social-impact", "search", "informed-consent", "comment-syntax", "Part", para, "Soup", "Call sharing()"]
    boxes = "".join(f"<div {a}><p>{para} Not this.</p></div>" for a in ("class=comment-list", 'id="comments"', "role=navigation", 'class="x ad-container"', "class=shareButtons", "class=cookie-notice", "class=sidebar")) + f'<p class="advertisement">{para} Nor this.</p>'
    for page in (f"<article>{body}{boxes}</article>", f"<main>{boxes}<div>{body}</div></main>", f'<body><div class="post">{body}{boxes}</div><div class="site-sidebar"><p>{para} No.</p></div></body>'):
        assert main_text.extract(page).split("\n") == want
    # Outside an article one word is enough, as before.
    assert main_text.extract(f'<body class="post"><div><p>{para}</p><div class="widget-search-area"><p>{para} No.</p></div></div></body>') == para


def test_main_text_boxes_by_whole_names():
    para = "A paragraph of the story, with commas, and enough words to give its parent points."
    gone = "".join(f'<{t} class="{c}"><p>{para} Not this, {c}.</p><p>{para}</p></{t}>' for t, c in [("article", "comment"), ("article", "comment even"), ("div", "post-comments"), ("div", "comment-body"), ("div", "main-nav"), ("div", "cookie-text"), ("section", "cookie-policy-banner"), ("div", "site-footer-widgets sidebar-content")])
    held = "".join(f'<div class="{c}"><h2>{c}</h2><p>{para}</p></div>' for c in ("search-results-study", "notice-of-meeting", "share-of-votes"))
    want = ["Title", para, *[x for c in ("search-results-study", "notice-of-meeting", "share-of-votes") for x in (c, para)], para]
    body = f"<h1>Title</h1><p>{para}</p>{gone}{held}<p>{para}</p>"
    for page in (f"<article>{body}</article>", f"<main>{body}</main>{gone}", f'<div class="content-sidebar-wrap"><main>{body}</main><aside>{para}</aside></div>', f'<div id="nav-content"><article>{body}</article></div>'):
        assert main_text.extract(page).split("\n") == want, page


def test_main_text_of_several_articles():
    para = "A paragraph of the story, with commas, and enough words to give its parent points."
    one = lambda k: f"<article><h2>Part {k}</h2><p>{para} {k}</p><p>{para}</p></article>"
    page = f"<body><main>{one(1)}{one(2)}<article class=comment><p>{para} Reader.</p></article>{one(3)}</main></body>"
    assert main_text.extract(page).split("\n") == [x for k in (1, 2, 3) for x in (f"Part {k}", f"{para} {k}", para)]


@pytest.mark.parametrize("start, end", [("<div>", ""), ("<div class=sidebar><h1>t</h1>", ""), ("<div class='x share-y'>", "</div>"), ("<b>", "</i>"), ("<b><div>", "</b>"), ("<ul><li>", "</p>"), ("<li>", "<p>"), ("<table><tr><td>", "</section>"), ("<p>", ""), ("<form>", "</form>"), ("<span><p>", "</span>")])
def test_main_text_of_deep_pages_takes_linear_time(start, end):
    import time

    para = "A paragraph of the story, with commas, and enough words to give its parent points."
    took = []
    for n in (5_000, 50_000):
        began = time.process_time()
        main_text.extract(start * n + f"<p>{para}</p>" + end * n)
        took.append(time.process_time() - began)
    assert took[1] < 40 * max(took[0], 0.05)


def test_main_text_column(spark):
    df = spark.createDataFrame([(1, None, "u"), (1, "<p>x", None)], "page_id long, html string, url string").withColumn("text", F.lit(3))
    got = main_text.main_text(df, carry={"url": F.col("url")}).collect()
    assert [tuple(r) for r in got] == [(1, "u", "", 0), (1, None, "x", 1)]
    assert main_text.main_text(df.limit(0)).count() == 0


def test_queries_and_their_names():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and set(queries.oracle_sql()) <= set(names)


def test_pipeline_stages(spark):
    """Each stage keeps the rows that a plain recomputation of its decision keeps."""
    import re

    import corpus_pipeline as p

    from .test_ops_text import brute_components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    languages, toxic = queries.langid_model(spark, SF), queries.toxicity_model(spark, SF)
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")

    def exact(rows):
        first = {}
        for i, t in rows:
            first.setdefault(norm(t), i)
        return [i for i, t in rows if first[norm(t)] == i]

    def near(rows):
        _, comps = brute_components([t for _, t in rows], 80)
        return [rows[k][0] for k in range(len(rows)) if comps[k] == k]

    def spoken(rows):
        lang, score = languages.predict([t for _, t in rows])
        return [i for (i, _), name, s in zip(rows, lang, score, strict=True) if name != "und" and s > 0]

    kept_by = {"language_id": spoken, "toxicity": lambda rows: [i for (i, _), s in zip(rows, toxic.score([t for _, t in rows], {})[0], strict=True) if s < 0.5], "exact_dedup": exact, "near_dedup": near}
    assert [name for name, _ in p.STAGES] == [*kept_by, "packing"]
    for name, stage in p.STAGES[:-1]:
        kept = queries_written(stage(spark, docs, SF), name)
        assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
        rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
        want = kept_by[name](rows)
        assert sorted(r["doc_id"] for r in kept.collect()) == want and len(want) > 0.6 * len(rows), name
        docs = kept
    packed = p.pack(spark, docs, SF)
    assert packed.count() == docs.count()


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in every column, repeats, ties, empty and very long texts, clashing column names; and
    no rows at all."""
    import corpus_pipeline as p

    text = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and length(text) > 400").select("text").first()[0]
    rows = [(None, text), (None, None), (1, None), (2, ""), (3, " \n"), (4, text), (4, text), (4, text + " more"), (5, text.upper()), (6, "x " * 300_000), (7, "1 2 3"), (7, text[::-1])]
    docs = spark.createDataFrame([(i, t, None, None, None, "c", 1, True) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, _id string, score int, _maybe boolean")
    left = {}
    for name, stage in p.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and kept.schema == docs.schema
        left[name] = sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect())
        assert stage(spark, docs.limit(0), SF).count() == 0
    all_rows = sorted((str(i), t or "") for i, t in rows)
    assert left["language_id"] == [r for r in all_rows if any(c.isalpha() for c in r[1])]
    assert left["exact_dedup"] == sorted([("1", ""), ("3", " \n"), ("4", text), ("4", text + " more"), ("5", text.upper()), ("6", "x " * 300_000), ("7", "1 2 3"), ("7", text[::-1])])
    # Rows without an id are linked with nothing; 4, its longer version and 5 are one document.
    assert [i for i, _ in left["near_dedup"]] == ["1", "2", "3", "4", "6", "7", "None", "None"]
    packed = p.pack(spark, docs, SF)
    assert packed.count() == len(rows) and p.pack(spark, docs.limit(0), SF).count() == 0


def queries_written(df, name):
    from loomspark.llm.common import written

    return written(df, name)


AROUND = '<html><body><nav><a href="/">Home</a> <a href="/x">More</a></nav>{}<footer>Imprint, all rights</footer></body></html>'
LONG = "This is a long sentence of the article, with commas, and enough words to be taken for prose by anyone."


@pytest.mark.parametrize(
    "box",
    [
        '<section class="responses"><div><p>Nice one, thank you for this, I liked it a lot, really.</p></div></section>',
        '<div class="replies"><p>I do not agree with this at all, and I will say why, at length, here.</p></div>',
        '<ol class="reply-list"><li>Ann: I think so too, and so does my neighbour, who reads this.</li></ol>',
        '<section id="discussion"><div>Bob wrote that he had seen it before, and that it was better then.</div></section>',
        '<div class="q1"><div><b>Ann</b> <time>today</time><p>A remark, rather long, as remarks go, on this article.</p><a href="#r">Reply</a></div><div><b>Bo</b><p>Another remark, also long, and with commas, too.</p><button>Reply</button></div></div>',
        '<div role="dialog"><p>Please subscribe to our letter, it is free, and comes each week.</p></div>',
        '<div role="alert">We use a new layout, tell us what you think, please, and thank you.</div>',
        '<div class="gdpr"><p>We store data on your device, for several purposes, with partners.</p></div>',
        '<div style="color:red; display: none"><p>Nobody sees this text, as it is hidden, but it is long, very long.</p></div>',
        '<p style="visibility:hidden">Nobody sees this text either, hidden as it is, though it takes room.</p>',
    ],
)
def test_main_text_leaves_out_comments_and_notices(box):
    for article in (f"<article><h1>Head</h1><p>{LONG}</p><p>{LONG} Again.</p></article>{{}}", f"<div><h1>Head</h1><p>{LONG}</p><p>{LONG} Again.</p></div>{{}}", f"<article><h1>Head</h1><p>{LONG}</p><p>{LONG} Again.</p>{{}}</article>"):
        if "discussion" in box and article.endswith("{}</article>"):
            continue  # a paper's section has that name too
        assert main_text.extract(AROUND.format(article.format(box))) == f"Head\n{LONG}\n{LONG} Again."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<div><section><h2>One</h2><p>{LONG}</p></section><section><h2>Two</h2><p>{LONG}</p></section><section><p>Three, short.</p></section></div>", f"One\n{LONG}\nTwo\n{LONG}\nThree, short."),
        (f"<div><p class=lead>In short</p><div><p>{LONG}</p><p>{LONG}</p></div><ul><li>first point</li><li>second</li></ul></div>", f"In short\n{LONG}\n{LONG}\nfirst point\nsecond"),
        (f"<div><div><p>{LONG}</p><p>{LONG}</p></div><pre>x = 1</pre></div>", f"{LONG}\n{LONG}\nx = 1"),
        (f"<div><div><p>{LONG}</p><p>{LONG}</p></div><table><tr><td>a</td><td>b</td></tr></table></div>", f"{LONG}\n{LONG}\na\nb"),
        (f'<div><div><p>{LONG}</p><p>{LONG}</p></div><ul><li><a href="/1">other page</a></li><li><a href="/2">one more</a></li></ul></div>', f"{LONG}\n{LONG}"),
        (f"<article><h1>Paper</h1><section id=discussion><h2>Discussion</h2><p>{LONG}</p></section></article>", f"Paper\nDiscussion\n{LONG}"),
        (f'<article><p>{LONG}</p><p>{LONG}</p><p>Write to us. <a href="/m">Reply</a></p></article>', f"{LONG}\n{LONG}\nWrite to us. Reply"),
    ],
)
def test_main_text_keeps_all_of_the_article(page, want):
    assert main_text.extract(AROUND.format(page)) == want


def test_few_vectors_are_reranked():
    """The answer is exact, and what the codes can't rule out is a small share, at any length."""
    rng = np.random.default_rng(5)
    for dims, n in ((64, 12_000), (768, 1_365)):
        x = rng.normal(size=(n, dims))
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        block = ann.Block(ann.fit(x[:1_000], rounds=3), [[i] for i in range(n)], x)
        asked = x[:40]
        for i, found in enumerate(block.nearest(asked, 6, 16, 512)):
            want = np.lexsort((np.arange(n), -(x @ x[i])))[:6]
            assert [f[0][0] for f in found] == want.tolist()
        print(dims, block.reckoned / 40 / n)
        assert block.reckoned < 0.05 * 40 * n
