"""A training corpus from `documents`: language, near copies, repeated passages, mix of sources, packed sequences.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before it kept, and returns a DataFrame;
between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabsmith.llm import op2_packing, op3_neardup, op5_substrings, op6_mixing, op8_language
from tabsmith.llm.common import stored, table

TOKENIZER = "word_bpe_49k.json"
#: Mixing weights of the sources in order of code points, by turns.
WEIGHTS = (5, 2, 1)
SEQUENCE_TOKENS, END_ID = 4096, 2
#: No SQL can express the compression model of the first stage.
ORACLE_SQL = None


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach; texts without letters or unlike all of them go."""
    return op8_language.keep_languages(docs, op8_language.train(docs.where(~op8_language.folds())))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the smallest id."""
    return op3_neardup.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of smaller id holds; documents left without words go."""
    return op5_substrings.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, up to three times."""
    return op6_mixing.mixed_documents(docs, weights=WEIGHTS, share=1.0, most=3)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return op2_packing.pack(docs, public_tokenizers.path(TOKENIZER), capacity=SEQUENCE_TOKENS, end_id=END_ID)


STAGES = [
    ("language identification", keep_known_languages),
    ("near-duplicate removal", drop_near_copies),
    ("substring removal", drop_repeated_passages),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if n == 0 else stored(docs), sf_dir)
    return docs
