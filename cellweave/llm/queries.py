"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import alignment, bpe, lexical, licences, media, mixing, packing, quality, topk, wordpiece
from cellweave.llm.common import read
from cellweave.llm.simhash import near_duplicates
from cellweave.llm.substring import dedup_substrings

TOP_K_SQL = """
    WITH v AS (
      SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
      FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
    ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select(
        "document.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    bits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), bits.alias("fingerprint"), "component_id")


def op1_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed matrices; ids and positions as digests beside the lengths."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack_matrices(docs)
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("ids", "positions")]
    return packed.select("matrix_id", "n_rows", *digests, "lengths", "cu_seqlens", "doc_ids", "starts")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return wordpiece.count_tokens(docs).withColumnRenamed("id", "doc_id")


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(docs).withColumnRenamed("id", "doc_id")


def op6_byte_pair_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("ids", "decoded")]
    n = (F.octet_length("ids") / bpe.ID_BYTES).cast("long").alias("n_tokens")
    return coded.select(F.col("id").alias("doc_id"), n, *digests)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = media.payload_features(media.store_payloads(docs))
    sizes = [F.octet_length(c).cast("long").alias(f"{c}_bytes") for c in ("payload", "media")]
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("payload", "media")]
    return kept.select(F.col("id").alias("doc_id"), "n_bytes", sizes[0], digests[0], "tail_crc32", sizes[1], digests[1], "feature")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, *quality.fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("document.doc_id", quality.held_out("document.doc_id").alias("held_out"), "score", "predicted")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.search(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    return alignment.align(docs).withColumnRenamed("id", "doc_id").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_matrices": op1_token_matrices,
        "op2_token_counts": op2_token_counts,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_simhash_near_dedup": op4_simhash_near_dedup,
        "op5_licence_scan": op5_licence_scan,
        "op6_byte_pair_codec": op6_byte_pair_codec,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_media_payloads": op8_media_payloads,
        "op9_exact_top_k": op9_exact_top_k,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_lexical_search": op11_lexical_search,
        "op12_source_mix": op12_source_mix,
        "op13_tokenizer_alignment": op13_tokenizer_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_licence_scan": licences.oracle(), "op9_exact_top_k": TOP_K_SQL, "op11_lexical_search": lexical.ORACLE, "op12_source_mix": mixing.oracle()}
