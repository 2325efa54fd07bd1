"""Byte-level BPE against the public library, whole and through chunks."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import byte_bpe, queries

tiktoken = pytest.importorskip("tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.ByteBpe(queries.ranks_path())


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def odd_texts(n=400):
    rng = random.Random(5)
    signs = "abcdest'.,!?012 \n\t\r\x85\x1c 　ÀéßΣ中日本🙂👍́‍½²٣՘\U0001df2b\U0003d000"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(n)]
    texts += ["".join(rng.choice("aeinrst lo") for _ in range(rng.randint(1, 400))) for _ in range(n)]
    return texts + ["", " ", "\n\n \n x", "don't DON'T we'll 'll", "''s", "a" * 3000, " " * 3000, "!" * 1000 + "'ll", "1" * 900, "é" * 700, "<|endoftext|>", "x" * 200 + "'" * 200 + "re" + " " * 100 + "y", "ab " * 500]


def digests(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def test_pattern_is_that_of_the_file():
    import public_tokenizers

    assert byte_bpe.PATTERN == public_tokenizers.PATTERN


def test_encoder_equals_the_library(coder, library):
    for text in odd_texts():
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text
        assert coder.decode(ids) == text.encode()
        assert coder.digests(text) == digests(library, text)
    assert coder.encode(None) == b""


def test_every_character_class_is_that_of_the_library(coder, library):
    for code in [*range(0x3000), *range(0xA000, 0xD800, 3), *range(0xE000, 0x20000, 2), *range(0x20000, 0x40000, 61)]:
        text = f"a{chr(code)} {chr(code)}1"
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode_ordinary(text), hex(code)


def test_merges_take_the_least_rank_leftmost_first():
    ranks = {b"a": 0, b"b": 1, b"ab": 5, b"ba": 4, b"aba": 2, b"aa": 3, b"aaaa": 6}

    def slow(piece):
        parts = [bytes([x]) for x in piece]
        while len(parts) > 1:
            best = min(((ranks.get(parts[i] + parts[i + 1], 99), i) for i in range(len(parts) - 1)))
            if best[0] == 99:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [ranks[p] for p in parts]

    rng, merge = random.Random(1), byte_bpe.Merges(ranks)
    for n in range(2000):
        piece = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30)))
        merge.SHORT = n % 2 * 96
        assert merge(piece) == ([ranks[piece]] if piece in ranks else slow(piece))


@pytest.mark.parametrize(("chunk", "overlap"), [(16, 6), (64, 16), (100, 100)])
def test_chunks_give_what_whole_texts_give(spark, library, chunk, overlap):
    texts = odd_texts(120)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    out = byte_bpe.encode(rows, queries.ranks_path(), digest=True, chunk=chunk, overlap=overlap).collect()
    assert len(out) == len(texts)
    for r in out:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == digests(library, texts[r["doc_id"]]), texts[r["doc_id"]]


def test_pieces_are_whole_and_cut_at_boundaries(spark, coder):
    texts = {f"k{i}": t for i, t in enumerate(odd_texts(60)) if len(t) > 40}
    rows = spark.createDataFrame([*texts.items(), *list(texts.items())[:9]], "key string, text string")
    held = byte_bpe.with_marks(byte_bpe.chunks_of(rows, 24, 12), queries.ranks_path(), byte_bpe.PATTERN, 24, 12)
    ranges = byte_bpe.stitched(held.select("key", "k", "head", "tail", "sure"), 24).collect()
    alone = 0
    for key, text in texts.items():
        own = sorted((r for r in ranges if r["key"] == key), key=lambda r: r["k"])
        assert [r["k"] for r in own] == list(range(-(-len(text) // 24)))
        ends = {0, *[m.end() for m in coder.pattern.finditer(byte_bpe.judged(text))]}
        at = 0
        for r in own:
            assert 24 * r["k"] + r["lo"] == at
            assert (r["piece"] == r["k"]) <= (at in ends)
            at = len(text) if r["hi"] is None else 24 * r["k"] + r["hi"]
            alone += r["alone"]
        assert at == len(text)
    assert alone > len(texts)


def test_edges(spark, library):
    long = "word " * 100
    rows = [(None, "a b", 1, "x"), (1, None, 2, "x"), (1, None, 2, "x"), (2, "", 3, "x"), (3, long, 4, "x"), (3, long, 4, "x"), (None, long, 5, "x"), (3, long + "!", 6, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int, key string")
    out = byte_bpe.encode(df, queries.ranks_path(), chunk=64, overlap=16)
    assert out.columns == ["doc_id", "ids", "decoded"]
    got = sorted((r["doc_id"] or -1, bytes(r["decoded"]).decode()) for r in out.collect())
    assert got == sorted((r[0] or -1, r[1] or "") for r in rows)
    assert all(r["ids"] == library.encode_ordinary(bytes(r["decoded"]).decode()) for r in out.collect())
    assert byte_bpe.encode(df.limit(0), queries.ranks_path()).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode(df, queries.ranks_path(), chunk=8, overlap=4)


def test_decode_column(spark, library):
    ids = library.encode_ordinary("naïve 中文 text")
    df = spark.createDataFrame([(1, ids, "a"), (2, [], "b"), (3, None, None)], "id int, ids array<int>, bytes string")
    got = {r["id"]: r["bytes"] for r in byte_bpe.decode(df, queries.ranks_path()).collect()}
    assert bytes(got[1]).decode() == "naïve 中文 text" and bytes(got[2]) == b"" and got[3] is None


def test_query_equals_the_library(spark, library):
    out = {r["doc_id"]: r for r in queries.op13_byte_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("text")).collect()
    assert len(out) == len(docs)
    for d in docs:
        r = out[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == digests(library, d["text"])
