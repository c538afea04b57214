"""The thin queries over the whole tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, langid, licences, merkle, packing, pii, topk, toxicity, trie, warc, wrappers
from .common import fold_of, read


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find_pii(docs, keep=["doc_id"]))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold_of(F.col("doc_id"), 3) == 1
    model = langid.fit(langid.training_texts(docs.where(~held), "text", "lang"))
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    return langid.identify(rows, model, keep=["doc_id", "held_out"])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold_of(F.col("doc_id"), 5) == 0
    labels = read(spark, sf_dir, "labels").where(~held)
    model = toxicity.fit(toxicity.labelled_sample(docs, labels))
    return toxicity.rate(docs.select("doc_id", "text", held.alias("held_out")), model, keep=["doc_id", "held_out"])


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return wrappers.extract(pages, wrappers.infer(pages), keep=["page_id", "url"])


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows, rows.where(F.col("vec_id") % 20 == 0))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    # Its own archive has no gap; one would be a lost page, and fails the query.
    whole = F.assert_true(F.col("gap_reason").isNull(), F.concat(F.lit("quarantined gap: "), "gap_reason")).isNull()
    return back.where(whole).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.cluster(read(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return trie.prefix_trie(trie.rebuilt(turns))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"), merkle.every_fifth(F.col("doc_id")))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], turns.schema)
    return chat.read_back(chat.expand(turns.unionByName(planted)), together=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_language": op2_language,
    "op3_toxicity": op3_toxicity,
    "op4_html": op4_html,
    "op5_topk": op5_topk,
    "op6_packing": op6_packing,
    "op7_warc": op7_warc,
    "op8_licences": op8_licences,
    "op9_jaccard": op9_jaccard,
    "op10_decontaminate": op10_decontaminate,
    "op11_trie": op11_trie,
    "op12_merkle": op12_merkle,
    "op13_chat": op13_chat,
}

OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), d AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM g) WHERE len(s) > 0 GROUP BY s),
x AS (SELECT rep, n, unnest(s) AS g FROM d),
p AS (
  SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(node, root) AS (SELECT rep, rep FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, CAST(coalesce(c.root, g.doc_id) AS BIGINT) AS component_id
FROM g LEFT JOIN d ON d.s = list_sort(g.s) LEFT JOIN c ON c.node = d.rep
"""

OP7_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

ORACLE_SQL: dict[str, str] = {
    "op5_topk": OP5_SQL, "op7_warc": OP7_SQL, "op9_jaccard": OP9_SQL, "op8_licences": licences.scan_sql(), "op11_trie": trie.TRIE_SQL, "op12_merkle": merkle.MANIFEST_SQL,
    "op13_chat": chat.CHAT_SQL,
}
