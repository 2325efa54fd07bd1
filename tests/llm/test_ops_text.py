"""Exact dedup, near dedup, packing, chat, language ID and toxicity against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import chat, exact_dedup, langid, near_dedup, packing, toxicity
from loomspark.llm.setsketch import SetSketch
from loomspark.llm.shingles import shingle_sets

DOCS = "doc_id long, text string, lang string, source string"


def docs_of(spark, texts, start=0):
    """With more columns, whose names clash with those that operators use inside."""
    rows = [(i if isinstance(i, int) else None, t, "en", "s") for i, t in (texts if texts and isinstance(texts[0], tuple) else enumerate(texts, start))]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("_id", "n", "kept", "score", "keep_id", "bucket", "_t", "comp", "a")})


EDGE = [None, "", " ", "a", "a", "a\n b", "a  b", "A b", "word " * 3000, "é ß 𝄞", "\x00\x1c", "…"]


def test_exact_dedup_matches_brute_force(spark):
    rng = random.Random(1)
    texts = EDGE + ["".join(rng.choice("ab \t\n") for _ in range(rng.randint(0, 5))) for _ in range(200)] + ["x" * 400 + s for s in ("a", "b", "a")]
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[norm(t)].append(i)
    import hashlib

    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(docs_of(spark, texts), digest=True).collect()}
    assert got == want


def test_exact_dedup_edges(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "z"), (2, "b")]
    got = sorted(map(str, (tuple(r) for r in exact_dedup.exact_dedup(docs_of(spark, rows)).collect())))
    assert got == sorted(map(str, [(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (None, None, 1, True), (2, 2, 1, True)]))
    assert exact_dedup.exact_dedup(docs_of(spark, rows).limit(0)).count() == 0
    left = exact_dedup.deduplicated(docs_of(spark, [(3, "a"), (2, "a "), (1, "b")]))
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3] and "source" in left.columns


def kept_rows(df):
    return sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect())


def test_exact_deduplicated_keeps_rows_not_ids(spark):
    rows = [(1, "a"), (0, "a"), (1, "b"), (5, "z"), (5, "z"), (None, "a"), (None, "q"), (None, "q"), (7, "z  z"), (6, "z\nz"), (8, None), (9, "")]
    left = exact_dedup.deduplicated(docs_of(spark, rows))
    assert left.columns == docs_of(spark, rows).columns
    assert kept_rows(left) == sorted([("0", "a"), ("1", "b"), ("5", "z"), ("None", "q"), ("6", "z\nz"), ("8", "None")])
    assert exact_dedup.deduplicated(docs_of(spark, rows).limit(0)).count() == 0
    # The same rows in another order and other partitions give the same rows.
    assert kept_rows(exact_dedup.deduplicated(docs_of(spark, rows[::-1]).repartition(3))) == kept_rows(left)


def test_exact_deduplicated_matches_brute_force(spark):
    rng = random.Random(21)
    rows = [(rng.choice([None, *range(40)]), rng.choice(["a", "b ", "b", "b\t", "c", "c  d", "c d", "", None, *[f"t{i}" for i in range(30)]])) for _ in range(250)]
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    want = sorted((str(min((i for i in g if i is not None), default=None)), t) for t, g in groups.items())
    got = exact_dedup.deduplicated(docs_of(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), norm(r["text"])) for r in got) == want


def brute_components(texts, threshold, width=5):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(lower))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    comp = list(range(len(texts)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                comp[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


def test_near_dedup_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)  # several blocks to a bucket
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = list(EDGE)
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy).upper() if rng.random() < 0.1 else " \n".join(copy))
    sizes, comps = brute_components(texts, 85)
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dedup.near_duplicates(docs_of(spark, texts), threshold=85).collect()}
    assert got == {i: (sizes[i], comps[i], comps[i] == i) for i in range(len(texts))}


def test_near_dedup_edges(spark):
    text = " ".join(f"w{i}" for i in range(60))
    got = near_dedup.near_duplicates(docs_of(spark, [(5, text), (5, text), (None, text), (2, text + " more")])).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(5, 56, 2, False), (5, 56, 2, False), (None, 56, None, True), (2, 57, 2, True)]))
    assert near_dedup.near_duplicates(docs_of(spark, [(1, "")]).limit(0)).count() == 0


def brute_near(rows, threshold=85):
    """(component of each row, whether its id is that), where rows of one id are one document."""
    sizes, comps = brute_components([t for _, t in rows], threshold)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first = {}
    for k, (i, _) in enumerate(rows):
        if i is None:
            continue
        joined = [j for j in range(len(rows)) if rows[j][0] is not None and sizes[j] and sizes[k] and comps[j] == comps[k]]
        for j in [*joined, *([first.setdefault(i, k)] if sizes[k] else [])]:
            a, b = find(j), find(k)
            root[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    return sizes, [None if i is None else i if not sizes[k] else min(x for x in least[find(k)] if x is not None) for k, (i, _) in enumerate(rows)]


def test_near_dedup_of_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (7, a + " x"), (8, b + " x"), (9, "other words of no one else"), (9, "other words of no one else"), (9, a.replace("a", "c")), (10, a.replace("a", "c") + " x"), (None, b), (5, ""), (12, None)]
    got = sorted(map(str, (tuple(r) for r in near_dedup.near_duplicates(docs_of(spark, rows), threshold=85).collect())))
    sizes, comps = brute_near(rows)
    assert got == sorted(str((i, sizes[k], comps[k], i == comps[k])) for k, (i, _) in enumerate(rows))
    assert comps[:8] == [5, 5, 5, 5, 9, 9, 9, 9]
    left = near_dedup.deduplicated(docs_of(spark, rows), threshold=85)
    ids = [r["doc_id"] for r in left.collect()]
    assert sorted(map(str, ids)) == sorted(["5", "9", "12", "None"]) and left.columns == docs_of(spark, rows).columns
    assert kept_rows(near_dedup.deduplicated(docs_of(spark, rows[::-1]).repartition(3), threshold=85)) == kept_rows(left)
    assert near_dedup.deduplicated(docs_of(spark, rows).limit(0)).count() == 0


def test_near_dedup_of_repeated_ids_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(22)
    bases = [[f"w{rng.randrange(300)}" for _ in range(rng.randint(4, 70))] for _ in range(12)]
    rows = []
    for _ in range(150):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 9])):
            words[rng.randrange(len(words))] = f"w{rng.randrange(300)}"
        rows.append((rng.choice([None, *range(90)]), " ".join(words)))
    sizes, comps = brute_near(rows)
    got = sorted(map(str, (tuple(r) for r in near_dedup.near_duplicates(docs_of(spark, rows), threshold=85).collect())))
    assert got == sorted(str((i, sizes[k], comps[k], i == comps[k])) for k, (i, _) in enumerate(rows))


def test_setsketch():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    s = SetSketch(m=800)
    parts = [x[:2000], x[1000:], x]
    regs = s.registers(np.concatenate(parts), np.array([0, 2000, 4000, 7000]))
    assert (s.merge(regs[0], regs[1]) == regs[2]).all()
    est = s.estimate(regs[:1], regs[1:2], np.array([2000]), np.array([2000]))[0]
    assert abs(est - 1 / 3) < 0.06
    one = s.registers(np.concatenate((x[:1], x[:1])), np.array([0, 1, 2]))
    assert (one[0] == one[1]).all() and one.min() > 0


def test_shingles_of_few_words():
    hashes, offsets = shingle_sets([None, "", "a b", "A  b", "a b c d e", "a b c d e a b c d e"])
    assert np.diff(offsets).tolist() == [0, 0, 1, 1, 1, 5] and hashes[0] == hashes[1]


def best_padding(lengths, counts, buckets):
    """Every choice of boundaries."""
    from itertools import combinations

    n, best = len(lengths), None
    for k in range(min(buckets, n)):
        for cut in combinations(range(n - 1), k):
            ends, total, at = [*cut, n - 1], 0, 0
            for e in ends:
                total += sum(counts[i] * (lengths[e] - lengths[i]) for i in range(at, e + 1))
                at = e + 1
            best = total if best is None else min(best, total)
    return best


def test_boundaries_are_optimal():
    rng = random.Random(4)
    for _ in range(60):
        lengths = sorted(rng.sample(range(60), rng.randint(1, 9)))
        counts = [rng.randint(1, 9) for _ in lengths]
        k = rng.randint(1, 5)
        ends = packing.boundaries(np.array(lengths), np.array(counts), k)
        padding = sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts, strict=True))
        assert len(ends) <= k and ends[-1] == lengths[-1] and padding == best_padding(lengths, counts, k)
    assert packing.boundaries(np.array([]), np.array([]), 3) == []


def test_boundaries_of_many_lengths():
    rng = np.random.default_rng(23)
    lengths = np.cumsum(rng.integers(1, 9, 400))
    counts = rng.integers(1, 50, 400)
    f = np.full(401, np.inf)  # the plain recurrence, every split of every level
    f[0] = 0
    docs = np.concatenate(([0], np.cumsum(counts)))
    for _ in range(7):
        f = np.array([0, *[min(f[i] + lengths[j - 1] * (docs[j] - docs[i]) for i in range(j)) for j in range(1, 401)]])
    ends = packing.boundaries(lengths, counts, 7)
    at = np.searchsorted(ends, lengths)
    assert (np.array(ends)[at] * counts).sum() == f[400]


def test_packing(spark):
    rng = random.Random(5)
    texts = [None, "", *[" ".join("w" for _ in range(rng.choice([1, 2, 3, 9, 10, 50, 7000]))) for _ in range(120)]]
    rows = packing.pack(docs_of(spark, texts), budget=100, buckets=4, shard_rows=20, shards=5).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    assert all(r["n_tokens"] == len((texts[r["doc_id"]] or "").split()) and r["padding"] == r["bucket_len"] - r["n_tokens"] >= 0 for r in rows)
    batches = defaultdict(list)
    for r in rows:
        batches[r["bucket"], r["batch"]].append(r)
    for (bucket, _), own in batches.items():
        assert len({r["bucket_len"] for r in own}) == 1 and sorted(r["slot"] for r in own) == list(range(len(own)))
        assert len(own) == 1 or len(own) * own[0]["bucket_len"] <= 100
    full = lambda r: max(1, 100 // max(1, r["bucket_len"]))
    for bucket in {b for b, _ in batches}:
        sizes = [len(own) for (b, _), own in sorted(batches.items()) if b == bucket]
        assert all(s == full(batches[bucket, 0][0]) for s in sizes[:-1])
    assert packing.pack(docs_of(spark, texts).limit(0)).count() == 0
    assert packing.pack(docs_of(spark, [(None, "a"), (1, "a"), (1, "a")])).count() == 3


def test_packing_deals_out_one_repeated_row(spark):
    df = docs_of(spark, [(1, "a b")] * 900 + [(2, "a b c")] * 100)
    rows = packing.pack(df, budget=30, buckets=2, shard_rows=50).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["bucket_len"]) for r in rows) == [(1, 2, 2)] * 900 + [(2, 3, 3)] * 100
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in rows}) == 1000


@pytest.mark.parametrize("chunk", [2, 256])
def test_chat(spark, chunk):
    rng = random.Random(6)
    convs = {}
    for i in range(60):
        base = convs[rng.randrange(i)] if i and rng.random() < 0.6 else [(rng.choice("ua"), rng.choice(["hi", "<|x", "", None])) for _ in range(rng.randint(1, 3))]
        convs[i] = base[: rng.randint(1, len(base))] + [(rng.choice("ua"), rng.choice("pqr")) for _ in range(rng.randint(0, 3))]
    rows = [(i, 10 * t, r, x) for i, c in convs.items() for t, (r, x) in enumerate(c)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows + rows[:5], "conv_id long, turn long, role string, text string").withColumn("h1", F.lit(1)).withColumn("_conv", F.lit("x"))
    got = {r["conv_id"]: (r["n_turns"], r["copies"], r["chat"]) for r in chat.render(df, chunk=chunk).collect()}
    clean = lambda s: (s or "").replace("<|", "< |")
    want = {}
    for i, c in convs.items():
        same = [k for k, d in convs.items() if d == c]
        if min(same) == i and not any(len(d) > len(c) and d[: len(c)] == c for d in convs.values()):
            want[i] = (len(c), len(same), "".join(f"<|im_start|>{clean(r)}\n{clean(x)}<|im_end|>\n" for r, x in c))
    assert got == want
    assert chat.render(df.limit(0)).count() == 0
    blank = [(7, None, r, x) for r in ("u", "a", None) for x in ("abcde", "abcd", "abcdf", "b", "", None, "zz", "é")]
    rng.shuffle(blank)
    one = chat.render(spark.createDataFrame(blank, "conv_id long, turn long, role string, text string"), chunk=chunk).collect()
    order = sorted(blank, key=lambda r: (r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
    assert [(r["conv_id"], r["n_turns"], r["chat"]) for r in one] == [(7, 24, "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for _, _, r, x in order))]
    nulls = spark.createDataFrame([(None, 1, "u", "a"), (None, None, "u", None), (2, 1, None, None)], "conv_id long, turn long, role string, text string")
    assert chat.render(nulls).count() == 2


def test_language_id(spark):
    rng = random.Random(7)
    words = {"en": ["the", "and", "thing", "with", "house", "water"], "de": ["der", "und", "nicht", "haus", "wasser", "über"], "fr": ["le", "et", "maison", "eau", "où", "très"]}
    make = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(30))
    rows = [(i, make(lang), lang) for i, lang in enumerate(list(words) * 40)]
    train = spark.createDataFrame(rows + [(900, None, "en"), (901, "x", None)], "doc_id long, text string, lang string")
    model = langid.fit(train, dims=512)
    assert model.languages == ["de", "en", "fr"]
    test = docs_of(spark, [make(lang) for lang in list(words) * 10] + [None, "", "123 !?", "É"])
    got = sorted(langid.identify(test, model).collect())
    assert [r["lang_pred"] for r in got[:30]] == list(words) * 10
    assert [(r["lang_pred"], r["score"]) for r in got[30:33]] == [("und", 0.0)] * 3 and got[33]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify(test.limit(0), model).count() == 0
    none = langid.fit(train.limit(0))
    assert {r["lang_pred"] for r in langid.identify(test, none).collect()} == {"und"}


def test_bundles_follow_the_definition():
    table = langid._vectors(64, 1)
    got, some = langid.bundles(["Ab1", "1 2"], 64, 1)
    slots = [32, ord("a"), ord("b"), 32]
    want = sum(np.roll(table[slots[i]], 2).astype(int) * np.roll(table[slots[i + 1]], 1) * table[slots[i + 2]] for i in range(2))
    assert (got[0] == want).all() and some.tolist() == [True, False] and not got[1].any()


def test_long_texts_are_bundled_in_segments(monkeypatch):
    rng = random.Random(24)
    texts = ["".join(rng.choice("abc é1.") for _ in range(n)) for n in (5, 900, 0, 1, 333, 40)] + [None, "1"]
    whole, some = langid.bundles(texts, 64, 1)
    monkeypatch.setattr(langid, "_SEGMENT", 7)
    monkeypatch.setattr(langid, "_GRAMS", 5)
    parts, again = langid.bundles(texts, 64, 1)
    assert (whole == parts).all() and (some == again).all()


def test_language_id_by_brute_force(spark):
    """Prototypes, cosines and the choice, recomputed with plain loops over letters and trigrams."""
    rng = random.Random(25)
    make = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    rows = [(i, make("abcde  " if i % 2 else "cdefg é", rng.randint(1, 60)), "xy"[i % 2]) for i in range(60)]
    dims, table = 32, langid._vectors(32, 7)

    def bundle(text):
        letters = re.sub(r"[\W\d_]+", " ", f" {text.lower()} ")
        out = np.zeros(dims)
        if letters.strip():
            for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
                out += np.roll(table[ord(a) % 4096], 2).astype(int) * np.roll(table[ord(b) % 4096], 1) * table[ord(c) % 4096]
        return out

    unit = lambda v: v / (np.linalg.norm(v) or 1)
    protos = {lang: unit(sum(unit(bundle(t)) for _, t, own in rows if own == lang)) for lang in "xy"}
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), dims=dims)
    assert all(np.allclose(model.prototypes[i], protos[lang], atol=1e-5) for i, lang in enumerate("xy"))
    texts = [make("abcdefg é9", rng.randint(1, 30)) for _ in range(80)]
    got = {r["doc_id"]: r for r in langid.identify(docs_of(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        v = unit(bundle(t))
        cos = {lang: float(v @ p) for lang, p in protos.items()}
        if not any(c.isalpha() for c in t):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
        elif abs(cos["x"] - cos["y"]) > 1e-5:
            assert got[i]["lang_pred"] == max(cos, key=cos.get) and abs(got[i]["score"] - max(0, max(cos.values()))) < 1e-5


def test_toxicity_scores_by_brute_force(spark):
    """The noisy-or and the offending spans, from the weights, sentence by sentence."""
    import math

    rng = random.Random(26)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    weights = {f: rng.uniform(0, 4) for w in words[:15] for f in toxicity._slots(w)}
    model = toxicity.Model(weights, -5.0)
    texts = [rng.choice(["", ". ", "!", "\n"]).join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) + rng.choice([".", "?", " ", "|x;"]) for _ in range(rng.randint(0, 6))) for _ in range(120)] + EDGE
    got = {r["doc_id"]: r for r in toxicity.score(docs_of(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        clean, spans, at = 1.0, [], 0
        for part in re.split(r"([.!?;|\r\n]+)", t or ""):
            if part and not re.fullmatch(r"[.!?;|\r\n]+", part):
                own = set(re.findall(r"[^\W\d_]+", part.lower()))
                z = model.bias + sum(weights.get(f, 0.0) for w in own for f in toxicity._slots(w))
                p = 1 / (1 + math.exp(-z))
                clean *= 1 - p
                if z >= 0:
                    spans.append((at, at + len(part), p))
            at += len(part)
        assert abs(got[i]["score"] - (1 - clean)) < 1e-9
        assert [(s["start"], s["end"]) for s in got[i]["offending"]] == [s[:2] for s in spans]
        assert all(abs(s["score"] - w[2]) < 1e-9 for s, w in zip(got[i]["offending"], spans, strict=True))


def test_toxicity_learns_along_the_gradient():
    """One step of training moves each weight as the numerical slope of the likelihood of the
    document labels, through the noisy-or, says."""
    import pyarrow as pa

    rng = random.Random(27)
    bags = [[sorted(rng.sample(range(6), rng.randint(1, 4))) for _ in range(rng.randint(1, 4))] for _ in range(12)]
    y = [int(i < 5) for i in range(12)]
    table = pa.table({"slots": pa.array([[x for s in b for x in s] for b in bags], pa.list_(pa.int32())), "sizes": pa.array([[len(s) for s in b] for b in bags], pa.list_(pa.int32())), "y": pa.array(y, pa.int32())})

    def likelihood(w, bias):
        total = 0.0
        for b, label in zip(bags, y, strict=True):
            clean = np.prod([1 / (1 + np.exp(bias + sum(w[x] for x in s))) for s in b])
            total += (np.log(1 - clean) / sum(y) if label else np.log(clean) / (len(y) - sum(y))) / 2
        return total

    eps = 1e-5
    slope = [(likelihood(np.eye(6)[k] * eps, -7.0) - likelihood(-np.eye(6)[k] * eps, -7.0)) / (2 * eps) for k in range(6)]
    bias_slope = (likelihood(np.zeros(6), -7.0 + eps) - likelihood(np.zeros(6), -7.0 - eps)) / (2 * eps)
    model = toxicity._train(table, least_docs=1, rounds=1, shrink=0.0, step=0.2)
    toxic = {x for b, label in zip(bags, y, strict=True) if label for s in b for x in s}
    seen = {x: sum(any(x in s for s in b) for b, label in zip(bags, y, strict=True) if label) for x in toxic}
    known = [x for x in toxic if seen[x] >= min(1, max(toxicity.FLOOR, toxicity.SHARE * sum(y)))]
    for k in known:
        assert abs(model.weights.get(k, 0.0) - max(0.2 * slope[k] / (abs(slope[k]) + 1e-6), 0)) < 1e-3
    assert abs(model.bias - (-7.0 + 0.2 * bias_slope / (abs(bias_slope) + 1e-6))) < 1e-3


def test_toxicity_sample_is_bounded(spark):
    rows = [(i, "calm words here. " * 20 + ("idiot. " if i % 10 == 0 else ""), i % 10 == 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] * 2 + [(None, "x"), (9_999, "no label")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(0, 0), (5, None), (None, 1), (8_888, 1)], "doc_id long, toxic int")
    picked = toxicity.sampled(docs, labels, max_rows=100).collect()
    assert 60 <= len(picked) <= 140 and 30 <= sum(r["y"] for r in picked) <= 41  # by id, repeats once
    one = toxicity.fit(docs, labels, max_rows=100, max_chars=2_000)
    few = toxicity.fit(docs, labels, max_rows=100)
    assert toxicity.score(docs, few).where("score >= 0.5").select("doc_id").distinct().count() == 40 and isinstance(one, toxicity.Model)


def test_toxicity(spark):
    rng = random.Random(8)
    calm, rude = [f"calm{c}" for c in "abcdefghijklmnop"], ["idiot", "moron"]
    rows = []
    for i in range(300):
        sentences = [" ".join(rng.choice(calm) for _ in range(8)) for _ in range(6)]
        bad = i % 4 == 0
        if bad:
            sentences[rng.randrange(6)] += f" you {rng.choice(rude)}"
        rows.append((i, ". ".join(sentences), int(bad)))
    df = spark.createDataFrame(rows + [(900, "x", None), (901, None, 0)], "doc_id long, text string, toxic int")
    model = toxicity.fit(df.where("doc_id < 200 or doc_id >= 900"))
    test = df.where("doc_id >= 200 and doc_id < 900")
    got = {r["doc_id"]: r for r in toxicity.score(test, model).collect()}
    for i, t, y in rows[200:]:
        assert (got[i]["score"] >= 0.5) == bool(y)
        for s in got[i]["offending"]:
            assert any(w in t[s["start"] : s["end"]] for w in rude)
        assert bool(got[i]["offending"]) == bool(y)
    edge = toxicity.score(docs_of(spark, EDGE), model).collect()
    assert len(edge) == len(EDGE) and all(0 <= r["score"] < 0.5 for r in edge)
    assert toxicity.score(test.limit(0), model).count() == 0
    one_class = toxicity.fit(df.where("toxic = 0"))
    assert toxicity.score(test, one_class).where("score >= 0.5").count() == 0


def test_toxicity_where_toxic_labels_are_rare(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(300)]
    plain = lambda: " ".join(rng.choice(words) for _ in range(12)) + "."
    # 60 toxic rows of 3,000, four with each bad word: no more than a tenth of them in a uniform sample.
    bad = [f"zq{c}xwvy" for c in "abcdefghijklmno"]
    rows = [(i, f"{plain()} {plain()}" + (f" {rng.choice(words)} {bad[i // 50 % 15]} {rng.choice(words)}." if i % 50 == 0 else ""), int(i % 50 == 0)) for i in range(3000)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), max_rows=300)
    test = spark.createDataFrame([(i, f"{plain()} {w} {rng.choice(words)}.") for i, w in enumerate(bad)] + [(100 + i, plain()) for i in range(100)], "doc_id long, text string")
    found = {r["doc_id"] for r in toxicity.score(test, model).where("score >= 0.5").collect()}
    assert len([i for i in found if i < 100]) >= 14 and len([i for i in found if i >= 100]) <= 5


def test_toxicity_sample_is_not_filled_by_long_texts(spark):
    """Texts beyond the bound by themselves take no part, so they don't displace the others."""
    calm = "calm words stand here and there. "
    bad = [c * 3 + "zorg" for c in "abcdefghijkl"]
    rows = [(i, calm + (f"you {bad[i // 2 % 12]}." if i % 2 else "and so on."), i % 2) for i in range(200)]
    rows += [(1_000 + i, calm * 700, i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.score(df, toxicity.fit(df, max_chars=16_000)).where("score >= 0.5 and doc_id < 1000").collect()
    assert {r["doc_id"] for r in found} == {i for i, _, y in rows if y and i < 200}
    # Where all are longer, the shortest of each label is left.
    assert isinstance(toxicity.fit(df.where("doc_id >= 1000"), max_chars=1_000), toxicity.Model)


@pytest.mark.parametrize("text", ["a." * 400_000, "ab " * 700_000, "x\n" * 400_000])
def test_toxicity_of_a_long_text_needs_little_memory(text):
    import tracemalloc

    model = toxicity.Model(dict.fromkeys(toxicity._slots("ab"), 1.0), -20.0)
    tracemalloc.start()
    scores, found = model.score([text], {})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25_000_000 and 0 < scores[0] < 0.5 and not len(found[0])


def test_toxicity_in_parts_equals_the_whole(monkeypatch):
    rng = random.Random(28)
    words = ["ΟΔΟΣ", "Σ'Α", "İstanbul", "straße", "abcdefgh", "Abcdxyz", "x1y", "é", "ab"]
    weights = {f: rng.uniform(0, 3) for w in words for one in re.findall(r"[^\W\d_]+", w.lower()) for f in toxicity._slots(one)}
    model = toxicity.Model(weights, -6.0)
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "\xa0", "-", ". ", "\n"]) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    whole, spans = model.score(texts, {})
    monkeypatch.setattr(toxicity, "_SENTENCES", 2)
    monkeypatch.setattr(toxicity, "_PART", 7)
    got, own = model.score(texts, {})
    assert np.allclose(got, whole, atol=1e-12) and all(np.allclose(a, b) for a, b in zip(own, spans, strict=True)) and any(map(len, spans))
