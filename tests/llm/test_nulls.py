"""Null ids: no operator fails, no row is lost, other ids come through exactly."""

import pytest

import corpus_pipeline
from skirmish.llm import edit_fingerprints, embeddings, licenses, minhash, packing, pii, quality, substrings, token_counts, unigram

tokenizers = pytest.importorskip("public_tokenizers")
BPE, PIECES = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
BIG = 2**60 + 1
BASE = " ".join(f"w{i}" for i in range(80))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "plain text here"), (None, BASE), (2, BASE), (None, BASE), (None, None), (3, "a@b.co"), (BIG, BASE + " x")]
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (None, 0), (2, None), (3, 0)], "doc_id long, quality int")


def ids(df, name="doc_id"):
    return sorted((r[name] for r in df.collect()), key=lambda x: (x is None, x))


def test_all_rows_come_through(docs, labels):
    want = [1, 2, 3, BIG, None, None, None]
    made = [licenses.license_scan(docs), token_counts.count_tokens(docs, PIECES), unigram.round_trip(docs, PIECES), minhash.near_duplicates(docs), quality.classify(docs, labels), pii.find(docs), edit_fingerprints.edit_likeness(docs), substrings.substring_dedup(docs), packing.best_fit_packing(docs, BPE)]
    for df in made:
        assert ids(df) == want, df.columns


def test_near_duplicates_leave_null_ids_alone(spark, docs):
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, True), BIG: (2, False), None: (None, True)}
    assert ids(corpus_pipeline.no_near_copies(spark, docs, "")) == [1, 2, 3, None, None, None]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 0.0]), (BIG, [1.0, 0.01]), (None, None), (None, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = embeddings.near_vectors(df)
    assert ids(got, "vec_id") == [1, BIG, None, None, None]
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got.where("vec_id is not null").collect()} == {1: (2, 1), BIG: (2, 1)}
