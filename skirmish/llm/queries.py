"""Queries of the operators in this folder: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_trees, edit_fingerprints, embeddings, licenses, minhash, packing, periods, pii, quality, substrings, token_counts, unigram, whitening
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: What op1's column ``spans`` lists, joined by commas.
OP1_SPANS = "label:first_word:last_word:edits"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = licenses.license_scan(table(spark, sf_dir, "documents"))
    each = F.transform("spans", lambda s: F.concat_ws(":", *[s[k] for k in OP1_SPANS.split(":")]))
    return made.withColumn("spans", F.concat_ws(",", each))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = unigram.round_trip(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return made.withColumn("decoded_sha256", F.sha2(F.encode("decoded", "UTF-8"), 256)).drop("decoded")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.find(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), "spans")


def op8_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints.likeness_and_classes(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = substrings.substring_dedup(table(spark, sf_dir, "documents"))
    spans = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])))
    return made.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"), spans.alias("spans"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of a tenth of the documents, by crc32 of the id, the words from place a on repeat the p words there."""
    words = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    h = F.crc32(F.col("doc_id").cast("string"))
    made = docs.select("doc_id", "text", h.alias("h"), F.expr("h div 10").alias("g")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    n = F.size("w")
    made = made.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", F.expr("1 + (size(w) - a) div (3 + g % 8)"))
    again = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return made.select("doc_id", F.when(F.col("a").isNotNull(), F.concat_ws(" ", again)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = periods.periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    best = [F.col("strongest")[k].alias(k) for k in ("start", "length", "period")]
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return made.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"), sha(listed).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_trees.score_texts(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_token_counts": op3_token_counts,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_minhash_dedup": op5_minhash_dedup,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_pii": op7_pii,
        "op8_edit_fingerprints": op8_edit_fingerprints,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_embedding_dedup": op10_embedding_dedup,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_lm_scoring": op13_lm_scoring,
        "pipeline": pipeline,
    }


#: Classes of near copies, by all pairs that share a shingle.
OP5 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10ffff}]+') AS ws FROM documents),
sh AS (SELECT doc_id, s, count(*) AS c FROM (SELECT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS s
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)) GROUP BY ALL),
size AS (SELECT doc_id, sum(c) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE shared / (x.n + y.n - shared) >= 0.8),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS v, a AS u FROM edges UNION SELECT r.v, e.b FROM reach r JOIN edges e ON e.a = r.u)
SELECT doc_id, coalesce(m, doc_id) AS class_id, coalesce(m, doc_id) = doc_id AS kept FROM documents LEFT JOIN (SELECT v, min(u) AS m FROM reach GROUP BY v) ON v = doc_id"""

#: Every window of 50 words by itself.
OP9 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
lo AS (SELECT k, min(doc_id) AS lo FROM win GROUP BY k),
each AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN lo USING (k) WHERE lo < doc_id),
gone AS (SELECT doc_id, list(p) AS ps FROM each GROUP BY 1),
runs AS (SELECT doc_id, min(p) - 1 AS s, max(p) AS e FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM each) GROUP BY doc_id, g),
spans AS (SELECT doc_id, string_agg(s || ':' || e, ',' ORDER BY s) AS spans FROM runs GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed, sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, j: NOT list_contains(ps, j)) END, ' ')) AS kept_sha256, coalesce(spans, '') AS spans
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN spans USING (doc_id)"""

#: All pairs of vectors.
OP10 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT DISTINCT a AS v, a AS u FROM edges UNION SELECT r.v, e.b FROM reach r JOIN edges e ON e.a = r.u)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(m, vec_id) AS component_id, coalesce(m, vec_id) = vec_id AS kept FROM embeddings
LEFT JOIN (SELECT a, count(*) AS n FROM edges GROUP BY a) ON a = vec_id LEFT JOIN (SELECT v AS w, min(u) AS m FROM reach GROUP BY v) ON w = vec_id"""


#: Repetitions by joining equal words of a text: stretches of neighbouring matches at one distance. The crc32 goes bit by bit.
OP11 = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
crc AS (SELECT doc_id, ws, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT + 256, 0, 0, 0, 0, 0, 0, 0, 0]))),
    lambda x, s: CASE WHEN s >= 256 THEN xor(x, s - 256) WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS h FROM t),
par AS (SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM crc),
per AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM par),
w AS (SELECT doc_id, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS ws FROM per),
each AS (SELECT doc_id, i, ws[i + 1] AS x, len(ws) AS n FROM (SELECT doc_id, ws, unnest(range(0, len(ws))) AS i FROM w)),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM each a JOIN each b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
often AS (SELECT doc_id, q FROM pairs GROUP BY ALL HAVING count(*) >= greatest(3 * q, 6 - q)),
isles AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pairs JOIN often USING (doc_id, q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM isles GROUP BY doc_id, q, g) WHERE length >= greatest(6, 4 * q) GROUP BY ALL),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS l FROM runs GROUP BY 1),
best AS (SELECT doc_id, start, length, period FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.doc_id = r.doc_id AND (o.length * r.period > r.length * o.period OR o.length * r.period = r.length * o.period AND (o.start, o.period) < (r.start, r.period)))),
gone AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS k FROM runs) GROUP BY 1)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(l, '')) AS runs_sha256,
sha256(array_to_string(CASE WHEN ks IS NULL THEN ws ELSE list_filter(ws, lambda x, j: NOT list_contains(ks, j - 1)) END, ' ')) AS collapsed_sha256
FROM w LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN gone USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the whole result; the others are tested against brute force, libraries and held-out rows."""
    return {"op5_minhash_dedup": OP5, "op9_substring_dedup": OP9, "op10_embedding_dedup": OP10, "op11_periodic_runs": OP11}
