"""The registered queries of the corpus operators: each applies its operator
with production parameters to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dinerank.llm import (
    decontamination,
    filter_audit,
    language_id,
    manifest,
    near_dedup,
    packing,
    secrets,
    sharding,
    suffix_dedup,
    token_counts,
    topk_search,
    toxicity,
    vector_dedup,
)
from dinerank.llm.common import table


def fold(docs: DataFrame, n: int) -> Column:
    """crc32 of the id as text, modulo n (null ids: 0)."""
    return F.coalesce(F.pmod(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(n)), F.lit(0))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=200)


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, vectors["vec_id"] % 20 == 0, scale=64.0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.learned(docs, table(spark, sf_dir, "labels"), fold(docs, 4) != 2)
    return toxicity.score_texts(docs, net, threshold=0.3, keep=["doc_id"], extra={"held_out": fold(docs, 4) == 2}).select(
        "doc_id", "held_out", "score", "predicted")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.NearParams(words=5, percent=85, bands=40, rows=6))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    params = language_id.LanguageParams()
    sample = language_id.training_sample(docs, fold(docs, 3) != 1, params)
    model = language_id.fit([r["text"] for r in sample], [r["lang"] for r in sample], params)
    found = language_id.identify(docs, model, reject_below=0.0, keep={"held_out": fold(docs, 3) == 1})
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and leaked item."""
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id", "l.coverage", "l.tiles")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    counts = {f"n_{k}": secrets.count_of(F.col("base"), k) for k in ("assign", "access", "hex")}
    return found.select("doc_id", *[c.alias(n) for n, c in counts.items()],
                        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("found")).alias("spans"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=8)


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.link_vectors(table(spark, sf_dir, "embeddings"), vector_dedup.GridParams(cosine=0.95))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampered with: the texts of a third of the ids, their capitals made small."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0
    found = manifest.manifest(docs, tampered, {"text": manifest.lower_ascii(docs["text"])})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}
    return own | {"pipeline": pipeline}


#: The search's contract in full: floor of 64 times each component, integer
#: inner products, ties to the smaller id.
TOP_K_SQL = """
with v as (
  select vec_id, row_number() over () as r, list_transform(embedding, lambda x: floor(64 * x::double)) as e
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select * from v where vec_id % 20 = 0),
scored as (
  select q.r as query_row, q.vec_id as query_id, v.vec_id, list_inner_product(q.e, v.e)::bigint as score
  from q join v on q.r <> v.r),
ranked as (select *, row_number() over (partition by query_row order by score desc, vec_id) as rank from scored)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the operators whose contract SQL can express; tests/llm
    holds the others against brute force, libraries or held-out labels."""
    return {"op2_topk_search": TOP_K_SQL, "op12_filter_audit": filter_audit.audit_sql(), "op13_manifest": manifest.manifest_sql()}
