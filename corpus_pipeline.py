"""Cleaning and packing of a document corpus, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, as it leaves them; the last one packs them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import jaccard, language, packing, substring
from colloquy.llm._scratch import Scratch

#: A document is rejected if its words' likeliest languages have a lower mean probability.
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those whose words are of no known language. Null texts go too."""
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(labelled.where(F.col("doc_id").isNotNull() & ~language.held_out(labelled["doc_id"])))
    return language.keep_known(docs, model, LEAST_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id: five words, similarity 0.8."""
    return jaccard.keep_one_of_each(docs, width=5, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that a document with a smaller id has too are cut out of the text."""
    return substring.without_word_windows(docs, window=50)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), max_len=2048)


STAGES = [("language_id", identify_language), ("ngram_jaccard_join", drop_near_copies), ("substring_dedup", drop_repeated_passages), ("best_fit_packing", pack_sequences)]

#: Language ID and tokenization have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's rows are written as Parquet and read by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs
