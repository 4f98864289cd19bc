"""One registered query per training-data operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm import op1_multi_index, op2_packing, op3_neardup, op4_toxicity, op5_substrings, op6_mixing, op7_urls, op8_language, op9_repetition, op10_tokens
from tabsmith.llm import op11_tree_dedup, op12_whitening, op13_variants
from tabsmith.llm.common import table

TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    return op1_multi_index.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op2_packing_ffd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return op2_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), capacity=4096, end_id=2)


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document; one of each class stays."""
    return op3_neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op4_toxicity_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; fold 0 of 5 is held out of training."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = op4_toxicity.train(docs, labels.where(~op4_toxicity.folds()))
    return op4_toxicity.score(docs, model).select("doc_id", op4_toxicity.folds().alias("held_out"), "score", "predicted")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one holds."""
    return op5_substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op6_mixing_es(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document the mix of sources takes."""
    mixed = op6_mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.0, most=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL, judged by rules or else by the classifier."""
    judged = op7_urls.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_score")


def op8_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; fold 2 of 4 is held out of training."""
    docs = table(spark, sf_dir, "documents")
    model = op8_language.train(docs.where(~op8_language.folds()))
    seen = op8_language.identify(docs, model)
    return seen.select("doc_id", op8_language.folds().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op9_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and repetition of every document."""
    return op9_repetition.repetition(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and how much of it fits the limit."""
    counted = op10_tokens.prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), budgets=(TOKEN_LIMIT,))
    over = F.col("n_tokens") > TOKEN_LIMIT
    return counted.select("doc_id", "n_bytes", "n_tokens", over.alias("over_limit"), F.col(f"chars_within_{TOKEN_LIMIT}").alias("fitting_chars"))


def op11_tree_dedup_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document; the largest id stays."""
    return op11_tree_dedup.exact_duplicates(table(spark, sf_dir, "documents"), largest=True)


def op12_whitening_cholesky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitened components of every vector."""
    return op12_whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling form and root of every long word."""
    return op13_variants.spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_multi_index_search": op1_multi_index_search,
        "op2_packing_ffd": op2_packing_ffd,
        "op3_minhash_neardup": op3_minhash_neardup,
        "op4_toxicity_nb": op4_toxicity_nb,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_mixing_es": op6_mixing_es,
        "op7_url_filter": op7_url_filter,
        "op8_language_ppm": op8_language_ppm,
        "op9_suffix_repetition": op9_suffix_repetition,
        "op10_token_counts": op10_token_counts,
        "op11_tree_dedup_digests": op11_tree_dedup_digests,
        "op12_whitening_cholesky": op12_whitening_cholesky,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    sql = {"op6_mixing_es": op6_mixing.MIX_SQL, "op11_tree_dedup_digests": op11_tree_dedup.DEDUP_SQL, "op13_spelling_variants": op13_variants.VARIANTS_SQL}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
