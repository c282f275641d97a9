"""Corpus pipeline: each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.

All stages but the last keep the columns of their input, whatever their names, and repeat repeated rows unless they are
near duplicates.  Empty tables give no rows; null, empty and very long texts are documents like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridbrook.llm.bpe_automaton import encode_decode
from gridbrook.llm.decontam import decontaminate
from gridbrook.llm.near_dup import keep_one
from gridbrook.llm.quality import keep_good
from gridbrook.llm.shared import save


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; all of them where labels lack one of the classes."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8 or more.

    The smallest id stays, ties to the smaller text; documents without words or without an id all stay.
    """
    return keep_one(docs, shingle_words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item of five words or more; those without an id are looked at too."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids and digests of the ids and of the text decoded from them; null and empty texts have no tokens."""
    return encode_decode(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe", tokens)]

#: SQL cannot express the classifier or the tokenizer; the stages are tested against brute force, the classifier step by step.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet and reread as the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = save(docs, f"stage-{name}")
    return docs
