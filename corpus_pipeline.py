"""A training corpus from the documents table: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evplace.llm import decontaminate, mixing, neardup, quality, token_files
from evplace.llm._shared import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier takes for low in quality, or toxic.

    Columns stay as they are, whatever their names. Null and empty texts, and texts of under three words, give its labellers nothing to go by, and are judged by the scorer's prior;
    repeated rows are judged alike; rows with a null doc_id are judged like others; an empty table stays empty.
    """
    return quality.kept_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document (the smallest id) of each group of near copies: five-word shingles, a similarity of 0.8.

    Null and empty texts are copies of nothing and stay. Rows that repeat an id are one document, and go or stay together. Rows without an id, or
    with one that is no whole number, cannot be told apart by it, and stay. Ties go to the smaller id. An empty table stays empty.
    """
    gone = neardup.near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, docs["doc_id"].try_cast("long") == gone["doc_id"], "left_anti")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item.

    Null and empty texts hold none and stay; repeated rows and ids, and rows without an id, are judged row by row; an empty table, or benchmark, leaves all as it is.
    """
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask.

    A null source is one of its own. Null and empty texts weigh nothing, and come as often as the rest of their block. Repeated rows are rows of their own; ties in the order
    go by the content. An empty table stays empty.
    """
    return mixing.mixed(docs, keys=False)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and where each document's ids are in them.

    Null and empty texts are the end id alone. Rows with one id are ordered by text; null ids come first. An empty table gives no rows.
    """
    import public_tokenizers

    return token_files.tokenized(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontaminate_stage),
    ("mixing", mix_stage),
    ("token_files", token_stage),
]

#: Training, minhashing and tokenizing are not for SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
