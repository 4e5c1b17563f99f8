"""The operators' queries over the whole documents table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, byte_bpe, codes, debruijn, fingerprints, katz, line_rules, near_duplicates, packing, rule_ensemble, sharding, topk, transducer
from .shared import table


def op1_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op2_line_first_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.verdicts(table(spark, sf_dir, "documents"))


def op3_sparse_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = rule_ensemble.scored(docs, rule_ensemble.fit(docs, labels))
    held_out = F.coalesce(F.crc32(F.col("own.doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return found.select(F.col("own.doc_id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_de_bruijn_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.removed(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op6_consistent_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"), shards=16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op7_byte_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_multi_index_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(table(spark, sf_dir, "documents"), near_duplicates.Scheme(words=4, similarity=80))


def op9_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op10_transducer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transducer.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumn("over_limit", F.col("n_tokens") > 4096)


def op11_impact_ordered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.best(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op12_segment_mean_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(table(spark, sf_dir, "embeddings"))


def op13_postings_cogroup_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_katz_backoff,
        op2_line_first_cleaning,
        op3_sparse_rule_ensemble,
        op4_de_bruijn_compaction,
        op5_best_fit_packing,
        op6_consistent_hash_ring,
        op7_byte_bpe_codec,
        op8_multi_index_hamming,
        op9_canonical_digest,
        op10_transducer_token_counts,
        op11_impact_ordered_topk,
        op12_segment_mean_codes,
        op13_postings_cogroup_alignment,
    )
}

ORACLE_SQL: dict[str, str] = {"op2_line_first_cleaning": line_rules.sql(), "op4_de_bruijn_compaction": debruijn.sql(), "op11_impact_ordered_topk": topk.sql(), "op12_segment_mean_codes": codes.sql()}
