"""The registered queries of the text operators, each over the whole documents table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochwise.llm import (
    exact,
    jaccard,
    lattice,
    lines,
    merkle,
    neighbours,
    packing,
    pii,
    pseudo,
    quality,
    resampling,
    tokens,
    toxicity,
)
from epochwise.llm.common import documents


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir))


def op3_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_boilerplate(documents(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo.pseudo_likelihood(documents(spark, sf_dir))


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.encode_and_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir), n=3, threshold=(90, 100))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and draws of all documents towards the benchmark's texts; an empty table has no rows."""
    return resampling.resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, read back without newlines where 2 divides the id's CRC; a null id is never changed."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle.dataset_manifest(documents(spark, sf_dir), tampered)


def op13_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose id 20 divides, by inner product, among all other rows."""
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_exact_duplicates": op2_exact_duplicates,
    "op3_line_spread": op3_line_spread,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_pseudo_likelihood": op5_pseudo_likelihood,
    "op6_sentence_pieces": op6_sentence_pieces,
    "op7_personal_data": op7_personal_data,
    "op8_toxicity": op8_toxicity,
    "op9_quality_rules": op9_quality_rules,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_collision_neighbours": op13_collision_neighbours,
}
