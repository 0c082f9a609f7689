"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir), keeps or repeats whole documents with all their columns, and
its output is written as Parquet and read back as the next stage's input.

Defined cases, for every stage: null and empty texts fail the quality rules; rows without an id are documents of
their own; repeated rows stay until the near-duplicate stage, which keeps one; texts of any length are read whole;
empty tables give empty tables; further columns pass through, whatever their names but those that begin with `__`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilwork.llm.decontaminate import keep_clean
from veilwork.llm.mixing import mixed
from veilwork.llm.near_dup import distinct_texts
from veilwork.llm.quality import keep_good, train
from veilwork.llm.queries import vocabulary
from veilwork.llm.store import discard, scratch, table, written
from veilwork.llm.token_files import token_files
from veilwork.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier, which is trained on these documents' labels."""
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more); of rows with equal id and text, the least.

    Rows that share an id but not the text, and rows without an id, are documents of their own.
    """
    return distinct_texts(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark phrases."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"), window=13, share=20)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as the mix takes it."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' digest: doc_id, start, n_tokens, ids_crc32 for each document of the mix."""
    return token_files(docs, vocabulary(), end_id=2)


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token files", tokens)]

#: SQL cannot train the classifier or encode tokens; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Tables of earlier stages are deleted as soon as the next stage is written; the token files stay."""
    ship(spark)
    docs, done = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch() as keep:
            docs = keep(written(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        discard(*done)
        done = [docs]
    return docs
