"""Corpus pipeline: language, exact copies, near copies, source mix, token ids. Part of subpackage llm."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colsmith.llm import bpe, exact_dedup, language, mixing, ngram_join, store


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; null, letterless and rejected texts go."""
    model = language.fit_language_model(docs)
    told = language.identify(docs, model)
    return told.filter(f"not {told.columns[-1]}.rejected").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest doc_id."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the largest doc_id."""
    return ngram_join.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix in order of position; a document appears as often as its source's target takes it."""
    return mixing.curriculum(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text of the mix, with digests of the ids and of the bytes they decode to."""
    return bpe.encode_documents(docs)


STAGES = [("language", identify_language), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies), ("mix", mix_sources), ("encode", encode)]

#: Language, near copies and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = store.materialize(docs, name)
    return docs
