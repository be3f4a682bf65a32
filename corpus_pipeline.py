"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

toxicity drops documents that are predicted toxic; simhash keeps one document of each group of near copies;
decontaminate drops documents that hold a benchmark item; pii replaces personal data in the text; packing
returns the pieces of full windows with their token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import decontaminate, packing, pii, simhash, toxicity
from colloquy.llm.common import read_table, settled


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; null and empty texts stay."""
    return toxicity.reject(docs, read_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the least doc_id; null and empty texts are copies of each other.

    Rows without a doc_id all stay; equal rows are one.
    """
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within a tenth of its characters; an empty benchmark drops none."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in text replaced by its kind and n_chars made to fit; null stays null."""
    return pii.redact(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a window; a null or empty text is its end token alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_copies),
    ("decontaminate", drop_benchmark),
    ("pii", mask_personal),
    ("packing", pack_windows),
]

#: SQL can't express a trained classifier, fingerprints, a random field or a tokenizer: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again as the next stage's documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
