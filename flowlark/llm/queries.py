"""The queries of this subpackage over the supplied tables, and SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlark.llm import sql, suffix
from flowlark.llm.bagminhash import near_duplicates
from flowlark.llm.bpe import encode_decode
from flowlark.llm.chat import preference_format, preference_pairs
from flowlark.llm.decontaminate import contaminated
from flowlark.llm.embedding import near_vectors
from flowlark.llm.fertility import RANKS, fertility, vocabulary_path
from flowlark.llm.lm_score import lm_scores
from flowlark.llm.periodic import digested, periodic_runs, planted
from flowlark.llm.resample import importance_resample
from flowlark.llm.substring import without_repeats
from flowlark.llm.text import small_batches
from flowlark.llm.toxicity import toxicity
from flowlark.llm.warc import derived_records, responses_of_pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit of two public vocabularies to every document, with a verdict."""
    return fertility(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through a public vocabulary and back, as digests of ids and decoded text."""
    return encode_decode(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), ["ids_sha256", "decoded_sha256"])


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")


def op1_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs of all conversations, formatted; spans as text."""
    out = preference_format(preference_pairs(table(spark, sf_dir, "conversations")))
    return out.withColumns({c: spans_text(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


def op2_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    return derived_records(responses_of_pages(table(spark, sf_dir, "pages")))


def op3_bucket_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without byte strings that a smaller one holds."""
    return suffix.without_repeats(table(spark, sf_dir, "documents"))


def op4_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document, beside the word unigram base."""
    return lm_scores(table(spark, sf_dir, "documents"), vocabulary_path(RANKS))


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without word windows that a smaller one holds."""
    return without_repeats(table(spark, sf_dir, "documents"))


def op10_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and connected groups of all vectors."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, after one in ten is made to repeat itself; lists of runs as digests."""
    return digested(periodic_runs(planted(table(spark, sf_dir, "documents"))))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the texts of the benchmark."""
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {q.__name__: q for q in (op1_preference, op2_derivatives, op3_bucket_pointers, op4_attention, op5_bagminhash, op6_spaced_seeds, op7_super_kmers, op8_fertility, op9_bpe, op10_recurrent, op11_epsilon_grid, op12_periodic_runs, op13_importance_resampling)}
CHECKS: dict[str, str] = {"op1_preference": sql.OP1, "op2_derivatives": sql.OP2, "op3_bucket_pointers": sql.OP3, "op6_spaced_seeds": sql.OP6, "op7_super_kmers": sql.OP7, "op11_epsilon_grid": sql.OP11, "op12_periodic_runs": sql.OP12, "op13_importance_resampling": sql.OP13}
