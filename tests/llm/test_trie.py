"""The conversation trie against a brute-force version."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from loomspark.llm import queries, trie

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, share):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x, key=lambda k: (k[0], k[1], k[2].encode(), k[3].encode()))] for c, x in own.items()}
    told = dict(own)
    if share:
        for c in own:
            h = zlib.crc32(str(c).encode()) % 6
            base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
            told[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, said in told.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    kids, below = defaultdict(int), defaultdict(lambda: [0, 0])
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            below[p[:d]][0] += kids[p] == 0
            below[p[:d]][1] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(told[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def got(df):
    return sorted(tuple(r[n] for n in NAMES) for r in df.collect())


def conversations(seed, n, most):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-30, 260), n):
        for turn in range(rng.choice([1, 1, 2, 3, 5, most])):
            rows.append((c, rng.choice([turn, turn, None, 0]), rng.choice(["u", "a", None]), rng.choice(["x", "yy", "", None, "Ü𝄞"])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("share", [False, True])
def test_equals_brute_force(spark, share, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 4)
    monkeypatch.setattr(trie, "BATCH", 2)
    monkeypatch.setattr(trie, "ENDS", 7)
    rows = conversations(1 + share, 60, 19)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(trie.trie(df, share=share)) == brute(rows, share)


def test_towers_of_snapshots_and_copies(spark):
    """Each conversation is one turn longer than the last: chains hang on chains; and a third of all
    conversations say the same."""
    rows = [(c, t, "u", f"t{t}") for c in range(20) for t in range(c)]
    rows += [(100 + c, t, "u", f"t{t}") for c in range(15) for t in range(5)]
    rows += [(200, t, "u", "long") for t in range(1500)] + [(201, t, "u", "long") for t in range(1400)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, False)
    assert got(trie.trie(df)) == want
    top = [r for r in want if r[1] == 0]
    assert top[0][0] == 1 and top[0][3] == len({r[0] for r in rows})


def test_edges(spark):
    rows = [(None, 1, "u", "x", 1, "k"), (5, None, None, None, 2, "k"), (5, 1, "u", "b", 3, "k"), (5, 1, "u", "b", 3, "k"), (7, 2, "", "", 4, "k"), (105, 1, "u", "b", 3, "k")]
    df = spark.createDataFrame(rows, SCHEMA + ", depth int, owner string")
    assert got(trie.trie(df, share=True)) == brute(rows, True)
    # Without rows, and with none that takes part.
    assert trie.trie(df.where("conv_id is null"), share=True).collect() == []


def test_texts_of_nodes(spark):
    rows = [(1, 1, "u", "hello"), (1, 2, "a", "there"), (2, 1, "u", "hello"), (2, 2, "a", "you")]
    out = {(r["conv_id"], r["depth"]): (r["role"], r["text"]) for r in trie.trie(spark.createDataFrame(rows, SCHEMA), texts=True).collect()}
    assert out == {(1, 0): (None, None), (1, 1): ("u", "hello"), (1, 2): ("a", "there"), (2, 2): ("a", "you")}


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op11_prefix_trie(spark, SF)) == brute(rows, True)
