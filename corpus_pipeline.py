"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir) and gives a table that the next one reads again from Parquet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlark.llm.bagminhash import near_duplicates
from flowlark.llm.bpe import encode_decode
from flowlark.llm.decontaminate import clean_documents
from flowlark.llm.fertility import fertility, vocabulary_path
from flowlark.llm.substring import without_repeats
from flowlark.llm.text import small_batches
from flowlark.session import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(docs: DataFrame) -> DataFrame:
    """The columns of documents; other columns go."""
    return docs.select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fertility rules keep, unchanged, repeated rows each by itself.

    A null or empty text has fewer words than the rules ask for and goes; a null in another column stays as it is; columns
    beyond those of documents are left out; an empty table gives an empty one.
    """
    small_batches(spark)
    return documents(fertility(docs, keep=COLUMNS[2:], kept_only=True))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the least doc_id.

    Rows without a doc_id stay; of rows that repeat the least doc_id, one of the least texts stays.
    """
    small_batches(spark)
    kept = near_duplicates(docs).where("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    docs = documents(docs)
    found = docs.join(kept.hint("shuffle_hash"), "doc_id")
    single = found.where("rows = 1").select(*COLUMNS)
    again = found.where("rows > 1").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*")
    return single.unionByName(again).unionByName(docs.where("doc_id IS NULL"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the word windows that a smaller document holds.

    A text that loses nothing stays as it is, white space included; one that loses words keeps the
    others joined by a space; n_chars follows. A document of which nothing is left goes.
    """
    small_batches(spark)
    out = without_repeats(docs, texts=True, keep=COLUMNS[2:])
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    left = out.where("n_removed < n_words OR n_words = 0")
    return left.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept_text").cast("long")).alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item, unchanged.

    A null or empty text holds none and stays; rows that repeat a doc_id, or have none, are judged together by what any
    of them holds; other columns are left out; an empty table gives an empty one.
    """
    return documents(clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, one row for each row.

    A null text counts as empty: 0 tokens. Null doc_ids and repeated rows stay; other columns are left out.
    """
    small_batches(spark)
    return encode_decode(docs, vocabulary_path("word_bpe_49k.json"), ["ids_sha256", "decoded_sha256"], keep=["lang", "source"])


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]
#: The vocabularies of the first and last stage are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written in the shared folder and read again."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
