"""Queries of contracts and content hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts
from ..sources import read_tables
from .adapter import raw_matches, sql

#: Tables of whole numbers and plain names, by their columns.
HASHED = {"nation": ["n_name", "n_nationkey", "n_regionkey"], "region": ["r_name", "r_regionkey"], "labels": ["doc_id", "quality", "toxic"]}


def contract_report(spark, sf_dir):
    """How many raw matches break each contract, counted in one run over them."""
    checks = {
        "two_teams": F.col("team1") != F.col("team2"),
        "no_tie": F.col("score1") != F.col("score2"),
        "best_of_known": F.col("best_of").isin(1, 3, 5),
        "scores_positive": (F.col("score1") > 0) & (F.col("score2") > 0),
        "map_known": F.col("map_name").isin("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"),
    }
    got = contracts.counts(raw_matches(spark, sf_dir), checks)
    return spark.createDataFrame([(n, got["rows"], got[n]) for n in checks], "contract string, n_rows long, broken long")


REPORT = sql(
    """
SELECT contract, count(*) AS n_rows, count(*) FILTER (NOT ok) AS broken FROM (
  SELECT unnest(['two_teams', 'no_tie', 'best_of_known', 'scores_positive', 'map_known']) AS contract,
    unnest([team1 <> team2, score1 <> score2, best_of IN (1, 3, 5), score1 > 0 AND score2 > 0, map_name IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD')]) AS ok FROM raw) GROUP BY 1"""
)


def table_hashes(spark, sf_dir):
    """Content hashes of tables, whatever the order of their rows."""
    out = None
    for name in HASHED:
        (rows,) = read_tables(spark, sf_dir, name)
        rows = rows.select(*HASHED[name])
        one = contracts.table_hash(rows).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("rows", "n_rows")


def hash_sql(name: str, columns: list[str]) -> str:
    sums = ", ".join(f"sum(CAST('0x' || substr(h, {16 * k + 1}, 15) AS HUGEINT))" for k in range(4))
    fields = ", ".join(f"'{c}': {c}" for c in columns)
    return f"SELECT '{name}' AS name, count(*) AS n_rows, sha256(concat_ws(':', '{','.join(columns)}', count(*), {sums})) AS sha256 FROM (SELECT sha256(CAST(to_json({{{fields}}}) AS VARCHAR)) AS h FROM {name})"


def joined_labels(spark, sf_dir):
    """Documents with their label: many to one by contract, as many rows as documents."""
    docs, labels = read_tables(spark, sf_dir, "documents", "labels")
    both = contracts.join_many_to_one(docs.select("doc_id", "lang"), labels.select("doc_id", "quality"), ["doc_id"])
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.sum("quality").cast("long").alias("good"))


QUERIES = {
    "contract_report": (contract_report, REPORT),
    "table_hashes": (table_hashes, " UNION ALL ".join(hash_sql(*x) for x in HASHED.items())),
    "joined_labels": (joined_labels, "SELECT lang, count(*) AS n, count(quality) AS labelled, CAST(sum(quality) AS BIGINT) AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"),
}
