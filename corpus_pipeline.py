"""From raw documents to token counts: the stages of the corpus pipeline.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of `documents`; the
last one returns what it made of them. Whoever runs the stages writes each result and reads it again;
run() does so in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandscope.llm import bpe, decontaminate, exact_dedup, language, near_dedup
from strandscope.llm.queries import tokenizer_file
from strandscope.llm.tables import filtered, shared_folder, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model, learnt from the labelled ones, does not reject."""
    model = language.fit_language_model(docs)
    return filtered(docs, lambda texts: language.identify(texts, model).where("rejected"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (white space runs count as one space)."""
    return exact_dedup.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similarity 0.8 of five-word shingles."""
    return filtered(docs, lambda texts: near_dedup.near_components(texts, size=5, percent=80).where("not kept"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document that is left."""
    return bpe.bpe_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("bpe", tokenised),
]

#: Language identification is learnt and BPE is no SQL: tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
