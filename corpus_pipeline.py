"""A training corpus from raw documents: classify, drop near copies, cut repeats, redact, pack.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; between stages it is written as Parquet and read again.
All but the last give the columns of documents.

All stages bear null and empty texts, texts of any length, rows that repeat, null ids, other columns whatever their names, and
tables without rows, which give no rows. What each does with them is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm import minhash, packing, pii, quality, substrings
from skirmish.llm.common import marked, materialize, table
from skirmish.llm.queries import tokenizer


def sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts weigh nothing and are judged as what the model knows nothing of;
    repeated rows and rows without an id are judged like any other."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays; rows that repeat an id stay or go together. Texts without words are
    classes of their own, and rows without an id stay."""
    gone = materialize(minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct())
    # other columns may have any names
    near = marked(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id")), gone, "doc_id")
    stay = near.where("maybe").join(gone, "doc_id", "left_anti").select("row").unionByName(near.where("not maybe").select("row"))
    return stay.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller id has are cut out. No row goes, and a text that loses nothing, a null
    one among them, stays as it is; rows with one id do not cut each other, those without an id none."""
    return sized(substrings.remove_repeats(docs))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind. No row goes; null texts stay null."""
    return sized(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 1024: each row, repeated ones too, has its own; a null text is an empty one, one end token."""
    return packing.best_fit_packing(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", good_quality),
    ("minhash_dedup", no_near_copies),
    ("substring_dedup", no_repeats),
    ("pii", no_personal_data),
    ("packing", packed),
]

#: The stages fit models, hash and tokenize: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
