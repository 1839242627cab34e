"""The registered queries against their SQL, and the pipeline's stages, on the smallest tables."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.compare import checker, differences
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return checker(FOLDER)


@pytest.mark.parametrize("name", ["op1_preference", "op2_derivatives", "op3_bucket_pointers", "op6_spaced_seeds", "op7_super_kmers"])
def test_against_sql(spark, con, name):
    assert differences(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", ["op4_attention", "op8_fertility", "op9_bpe", "op10_recurrent"])
def test_a_row_for_each_document(spark, name):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    assert sorted(r.doc_id for r in entry.queries()[name](spark, FOLDER).collect()) == ids


def test_near_duplicates_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in entry.queries()["op5_bagminhash"](spark, FOLDER).collect())
    assert got == brute.classes([tuple(r) for r in docs])


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    schema = docs.schema.simpleString()
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name != "encoding":
            assert docs.schema.simpleString() == schema
        if name in ("quality_rules", "near_dedup", "decontamination"):
            assert all(before[k] == r for k, r in after.items())
        if name == "near_dedup":
            classes = dict(brute.classes([(k, r.text) for k, r in before.items()]))
            assert set(after) == {k for k in before if classes[k] == k}
        if name == "substring_dedup":
            wanted = {x[0]: x for x in brute.without_words([(k, r.text) for k, r in before.items()])}
            assert set(after) == {k for k, x in wanted.items() if x[2] < x[1] or not x[1]}
            assert all(brute.sha(" ".join(brute.words(r.text)).encode()) == wanted[k][3] for k, r in after.items())
