"""The registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, byte_bpe, chat, exact_dedup, langid, main_text, near_dedup, negatives, packing, sstable, toxicity, trie
from .common import crc32_mod, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of all documents: a row for each."""
    return packing.pack(table(spark, sf_dir, "documents"))


def toxicity_model(spark: SparkSession, sf_dir: str, every: bool = False) -> toxicity.Model:
    """Trained on labelled documents; those held out take part only if ``every``."""
    labels = table(spark, sf_dir, "labels")
    if not every:
        labels = labels.where(crc32_mod("doc_id", 5) != 0)
    return toxicity.fit(table(spark, sf_dir, "documents"), labels)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document, by a model of labelled documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity_model(spark, sf_dir), carry={"held_out": crc32_mod("doc_id", 5) == 0})
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that are no prefix of another, as ChatML."""
    return chat.render(table(spark, sf_dir, "conversations"))


OP3_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (
  SELECT conv_id, count(*) AS n,
         list({'r': coalesce(role, chr(1)), 't': coalesce(text, chr(1))} ORDER BY turn, role, text) AS turns,
         string_agg('<|im_start|>' || replace(coalesce(role, ''), '<|', '< |') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS chat
  FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT k AS n, turns[:k] AS turns FROM (SELECT turns, unnest(range(1, n)) AS k FROM c)),
w AS (SELECT min(conv_id) AS conv_id, n, count(*) AS copies, turns, min(chat) AS chat FROM c GROUP BY n, turns)
SELECT conv_id, n AS n_turns, copies, chat FROM w
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n = w.n AND p.turns = w.turns)
"""


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles, component and kept of every document, linked at 0.85 or more."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), threshold=85)


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS root FROM n UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id, d.doc_id = coalesce(c.root, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = d.doc_id
"""


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays, for every document, by whole normalised texts."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest=True)


OP5_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""


def tokenizer_path() -> str:
    """The public tokenizer file on this machine; it is at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and the decoded text of every document."""
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), digest=True)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of all vectors to each whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.neighbours(vectors, vectors.where("vec_id % 50 = 0"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    found = main_text.main_text(table(spark, sf_dir, "pages"), carry={"url": F.col("url")})
    return found.select("page_id", "url", "text", "n_chars")


#: For the test tables, whose articles hold headings and paragraphs only.
OP8_SQL = r"""
WITH b AS (SELECT page_id, url, list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<br>', ' ', 'g'), '</?b>', '', 'g'), '</?(?:p|h1)>'),
  lambda x: trim(regexp_replace(replace(replace(x, '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS blocks FROM pages),
t AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""


def langid_model(spark: SparkSession, sf_dir: str) -> langid.Profiles:
    """Prototypes from the documents that aren't held out."""
    return langid.fit(table(spark, sf_dir, "documents").where(crc32_mod("doc_id", 3) != 1))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by profiles of documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid_model(spark, sf_dir), carry={"held_out": crc32_mod("doc_id", 3) == 1})
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op10_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to shards and read back from them."""
    manifest = sstable.write(table(spark, sf_dir, "documents"), tokenizer_path())
    return sstable.read(manifest, digest=True).drop("shard")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all conversations, rebuilt so that they share beginnings."""
    return trie.trie(table(spark, sf_dir, "conversations"), share=True)


#: crc32 bit by bit: a byte is mixed in, -1 shifts by one bit.
OP11_SQL = r"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'r': r, 't': t} ORDER BY i) AS q FROM o GROUP BY conv_id),
k AS (SELECT conv_id, q, xor(list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: list_concat([ascii(x)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 6 AS h FROM c),
s AS (SELECT k.conv_id, list_concat(coalesce(b.q[:k.h], []), k.q[k.h + 1:]) AS q FROM k LEFT JOIN k b ON b.conv_id = k.conv_id - k.conv_id % 100),
p AS (SELECT conv_id, len(q) AS n, unnest(range(0, len(q) + 1)) AS d, q FROM s),
v AS (SELECT q[:d] AS pre, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends FROM p GROUP BY 1, 2),
l AS (SELECT v.*, (n_convs - 1) * coalesce(length(pre[d].t), 0) AS cost, (SELECT count(*) FROM v x WHERE x.d = v.d + 1 AND x.pre[:v.d] = v.pre) AS kids FROM v),
a AS (SELECT pre[:u] AS pre, u AS d, kids, cost FROM (SELECT l.*, unnest(range(0, d + 1)) AS u FROM l)),
g AS (SELECT pre, d, count(*) FILTER (WHERE kids = 0) AS n_leaves, sum(cost) AS saved FROM a GROUP BY 1, 2)
SELECT l.conv_id, l.d AS depth, x.conv_id AS parent_conv_id, l.n_convs, l.kids AS n_children, g.n_leaves::BIGINT AS n_leaves, g.saved::BIGINT AS saved_tokens, l.ends AS ends_sha256
FROM l JOIN g ON g.pre = l.pre AND g.d = l.d LEFT JOIN v x ON x.d = l.d - 1 AND x.pre = l.pre[:l.d - 1]
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every positive of the vectors whose id is divisible by 100; the label of
    those divisible by 7 is moved on by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0)


OP12_SQL = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS y
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.y, b.y)::BIGINT AS s FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b))::INTEGER AS rank, s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.s <= 100 * s.s AND s.s <= p.s
QUALIFY rank <= 5
"""


def ranks_path() -> str:
    """The public rank file on this machine; it is at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the byte-level ids and the decoded bytes of every document."""
    return byte_bpe.encode(table(spark, sf_dir, "documents"), ranks_path(), digest=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_toxicity, op3_chat, op4_near_dedup, op5_exact_dedup, op6_bpe, op7_ann, op8_main_text, op9_langid, op10_sstable, op11_prefix_trie, op12_hard_negatives, op13_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": OP3_SQL, "op4_near_dedup": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op8_main_text": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op12_hard_negatives": OP12_SQL}
