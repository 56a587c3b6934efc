"""Documents to packed training sequences in five stages.

Each stage is one operator of ``tidemark.llm`` over all that its predecessor
kept; its result is written as Parquet and reread as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, language_id, mixing, near_dedup, packing
from tidemark.llm.common import Scratch, table
from tidemark.llm.tokens import public_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no text, no letter, or a coin flip between languages."""
    return language_id.reject(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the document with the smallest id stays."""
    return exact_dedup.drop_exact_duplicates(docs, keep="min")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five-word shingles, similarity 0.8) the smallest id stays."""
    return near_dedup.drop_near_duplicates(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, dealt by the weights of domain, language and source; two epochs at most.

    A document that two epochs take is there twice.
    """
    return mixing.mix(docs, mixing.document_levels(), mixing.DOCUMENT_WEIGHTS, max_epochs=2, seed=17, annotate=False)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, placed in sequences."""
    return packing.pack(docs, public_path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL expresses neither the first nor the last stage; tests/llm holds the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    done: list[str] = []
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        scratch.drop(*done)  # the stage before has been read
        done = [name]
    return STAGES[-1][1](spark, docs, sf_dir)
