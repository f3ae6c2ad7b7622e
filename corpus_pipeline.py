"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, secret scans, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents, and no stage
reads others, whatever their names. Texts of any length are handled whole; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, linededup, ngramjoin, packing, secrets
from tidemark.llm.common import bounded_batches, cut, table
from tidemark.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars that of the text as it is now."""
    chars = F.length("text").cast("long")
    return df.select("doc_id", "text", "lang", "source", chars.alias("n_chars"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents; drop documents without a language (null text, empty, or no letter), label the others.

    Rows with null ids or labels are predicted like all others but not learned from; nothing is known of an empty table."""
    bounded_batches(spark)
    found = langid.identify(docs.select(COLUMNS), langid.sample(docs)).where("lang_pred <> 'und'")
    return _columns(found.withColumn("lang", F.col("lang_pred")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that match an earlier line; a document of which nothing is left goes.

    Rows with null ids are left alone; rows that repeat id and text are one document, and all of them stay or go."""
    return _columns(linededup.dedup_lines(docs.select(COLUMNS), drop_emptied=True))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least doc_id stays (of texts under one id that whose hash is least).

    Rows with null ids and texts without words stay; rows that repeat the one that stays, stay with it."""
    bounded_batches(spark)
    return _columns(ngramjoin.keep_one(docs.select(COLUMNS)))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask the secrets found; every document stays, null ids and repeated rows too."""
    return _columns(secrets.redact(docs.select(COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document, with its ids. Null ids and repeated rows are packed like all others."""
    bounded_batches(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: MinHash and the tokenizer can't be expressed in SQL; the tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
