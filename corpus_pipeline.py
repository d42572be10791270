"""The corpus pipeline: from documents to packed sequences, in stages that each read what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, line_dedup, packing, simhash, substring_dedup, toxicity
from millrace.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold, as they are. The model learns from labels.toxic; null labels and ids are not learned
    from, null and empty texts get one score, repeated rows score alike, an empty table gives none."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs.select(*COLUMNS), model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without chunks of lines that occur before. Null texts stay null; a text of which nothing is left is empty."""
    return _documents(line_dedup.line_dedup(docs.select(*COLUMNS)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share 0.8 of their five-word shingles the document with the smallest id stays.

    Texts without words are one group; rows with a null id take no part and stay; rows that repeat id and text go or stay together."""
    return simhash.drop_near_duplicates(docs.select(*COLUMNS))


def drop_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words of windows that start in a document with a smaller id too. Rows with a null id stay whole."""
    return _documents(substring_dedup.substring_dedup(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; a null or empty text is its end token, repeated rows are packed each."""
    return packing.pack(docs, bpe.vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_duplicates),
    ("substring_dedup", drop_substrings),
    ("packing", pack),
]
#: Scores and near duplicates have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
