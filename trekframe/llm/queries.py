"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from trekframe.llm import conversation_repair, decontaminate, embedding_dedup, jaccard_join, language_id, license_scan, packing, quality, suffix_dedup, token_counts, toxicity, vector_codes, warc

WORD_BPE = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors against all, linked at a cosine of 0.95 or more."""
    return embedding_dedup.embedding_links(_table(spark, sf_dir, "embeddings"), threshold=0.95)


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS len FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.len * b.len) >= 0.95),
sym AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT vec_id AS node, vec_id AS label FROM n UNION SELECT sym.y, reach.label FROM reach JOIN sym ON sym.x = reach.node AND reach.label < sym.y),
comp AS (SELECT node, min(label) AS component_id FROM reach GROUP BY node),
deg AS (SELECT x, count(*) AS n_links FROM sym GROUP BY x)
SELECT v.vec_id, CAST(coalesce(deg.n_links, 0) AS BIGINT) AS n_links, coalesce(comp.component_id, v.vec_id) AS component_id,
  v.vec_id = coalesce(comp.component_id, v.vec_id) AS kept
FROM v LEFT JOIN deg ON deg.x = v.vec_id LEFT JOIN comp ON comp.node = v.vec_id
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every block of 1,000 characters of every document; a token across a boundary counts where most of it is."""
    docs = _table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", token_counts.block_sections("text", 1000).alias("blocks"))
    return token_counts.section_token_counts(docs, public_tokenizers.path(WORD_BPE), sections="blocks", rule="majority")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2,048 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), max_tokens=2048)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in all documents."""
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.5)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back, with digests and lengths taken from the payloads read."""
    back = warc.archive_round_trip(_table(spark, sf_dir, "pages"), min_bytes=0)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS last_id FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, 1 + 5 * CAST(i // 4 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last_id THEN last_id END AS refers_to
FROM p JOIN m USING (h)
"""


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents: five-word n-grams, similarity of 0.8 or more."""
    return jaccard_join.jaccard_links(_table(spark, sf_dir, "documents"), threshold=0.8, k=5)


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, ws, least(5, len(ws)) AS k FROM w WHERE len(ws) > 0),
pos AS (SELECT doc_id, ws, k, unnest(range(1, CAST(len(ws) - k + 2 AS BIGINT))) AS i FROM g),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + k - 1], ' ') AS s FROM pos),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 5 * c >= 4 * (nx.n + ny.n - c)),
sym AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS node, doc_id AS label FROM n UNION SELECT sym.y, reach.label FROM reach JOIN sym ON sym.x = reach.node AND reach.label < sym.y),
comp AS (SELECT node, min(label) AS component_id FROM reach GROUP BY node),
deg AS (SELECT x, count(*) AS n_links FROM sym GROUP BY x),
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY set_of) AS class_id FROM (SELECT doc_id, string_agg(s, '|' ORDER BY s) AS set_of FROM sh GROUP BY doc_id))
SELECT d.doc_id, coalesce(cls.class_id, d.doc_id) AS class_id, CAST(coalesce(deg.n_links, 0) AS BIGINT) AS n_links,
  coalesce(comp.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(comp.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN cls ON cls.doc_id = d.doc_id LEFT JOIN deg ON deg.x = d.doc_id LEFT JOIN comp ON comp.node = d.doc_id
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in any document, up to 15 % of its words edited."""
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that repeat 100 bytes standing earlier."""
    return suffix_dedup.repeat_report(_table(spark, sf_dir, "documents"), min_bytes=100)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    return language_id.predict_languages(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors by four parts, with codebooks trained on all of them."""
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every damaged conversation."""
    return conversation_repair.repair_conversations(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_license_scan": op4_license_scan,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_warc": op7_warc,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_decontamination": op9_decontamination,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_language_id": op11_language_id,
    "op12_vector_codes": op12_vector_codes,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": OP1_SQL,
    "op4_license_scan": license_scan.oracle_sql(),
    "op7_warc": OP7_SQL,
    "op8_jaccard_join": OP8_SQL,
    "op12_vector_codes": vector_codes.oracle_sql(),
    "op13_conversation_repair": conversation_repair.oracle_sql(),
}
