"""The queries of this package: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowtally.llm import context_tree, divergence, embed_dups, licences, mix, pack, quality_forest, quality_gam, shards, simhash, spelling, token_files, warc
from flowtally.llm.common import vocabulary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality_gam.scores(docs, quality_gam.fit(docs, labels))


def op2_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_rows(_table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_index(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_embedding_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dups.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_rule_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality_forest.judged(docs, labels)


def op6_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(_table(spark, sf_dir, "documents")).drop("copies")


def op7_differencing_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.packed(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_warc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_index(_table(spark, sf_dir, "pages"))


def op9_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op10_simhash_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_spelling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_divergence_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.scores(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality_gam, op2_rendezvous_shards, op3_token_files, op4_embedding_collisions, op5_rule_forest, op6_sainte_lague_mix, op7_differencing_pack, op8_warc_pages, op9_licence_sentences, op10_simhash_bytes, op11_spelling_trie, op12_divergence_cube, op13_context_tree)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op9_licence_sentences": licences.oracle_sql(),
        "op12_divergence_cube": divergence.oracle_sql(),
        "op4_embedding_collisions": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT m.vec_id, coalesce(n.n, 0) AS n_links, component_id, m.vec_id = component_id AS kept FROM m LEFT JOIN n ON m.vec_id = n.vec_id
""",
        "op8_warc_pages": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to
FROM f
""",
    }
