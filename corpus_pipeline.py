"""A training-data pipeline of four stages over ``documents``.

Each stage works on what the one before has kept, takes effect, and (but for the last) returns the
columns of ``documents``. Its output is written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import line_dedup, near_dup, packing, quality
from tidewatch.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have no words and go; repeated rows are judged each, and
    only the columns of documents are carried."""
    return quality.judge(docs, COLUMNS).where("kept").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others repeat; n_chars follows the text. Texts may become empty; a null text
    becomes empty; rows that share a doc_id keep or lose a line together."""
    kept = line_dedup.dedup_lines(docs, ("doc_id", "lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each class; documents without doc_id cannot stand for a class and stay.

    Rows that share the doc_id which stays are one document: its different texts all stay, equal texts once, with the
    smallest of their other columns. Null and empty texts are copies of each other.
    """
    found = near_dup.classes(docs)
    chosen = found.where("doc_id = class_id").select("doc_id").distinct()
    rest = ("text", "lang", "source", "n_chars")
    kept = docs.join(chosen, "doc_id").groupBy("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.min(F.struct(*rest)).alias("r"))
    return kept.select("doc_id", "r.*").select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their sequence and place. A null or empty text is one piece of the end mark;
    repeated rows are packed each."""
    return packing.pack(docs, WORD_VOCABULARY)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express the near-duplicate and packing stages; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
