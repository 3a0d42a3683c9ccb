"""The trees for personal data learn from every document, on the driver or in Spark alike."""

import numpy as np

from skirmish.llm import pii

FOLDER = "/root/testdata/sf0.01"


def test_every_candidate_counts(spark, monkeypatch):
    docs = pii.id_text(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    seen = []
    keep = pii.boost
    monkeypatch.setattr(pii, "boost", lambda x, y, w: seen.append((len(x), w.sum())) or keep(x, y, w))
    a = pii.fit(docs)
    half = "pmod(xxhash64(doc_id, text), 2)"
    rows = pii.examples(docs.selectExpr(f"{half} as half", "text")).where("half = 0")
    assert seen == [(rows.select(*pii.FEATURES, "label").distinct().count(), rows.count())]
    assert len(a.trees) == 12


def test_trees_of_rows_in_spark_equal_those_on_the_driver(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (200, len(pii.FEATURES)))
    y, n = ((x[:, 0] + x[:, 1] > 3) ^ (rng.random(200) < 0.1)).astype(int), rng.integers(1, 9, 200)
    rows = spark.createDataFrame([(*map(int, r), int(a), int(b)) for r, a, b in zip(x, y, n, strict=True)], ", ".join([*[f"{f} int" for f in pii.FEATURES], "label int", "n long"]))

    def same(s, t):
        return abs(s - t) < 1e-9 if not isinstance(s, tuple) else s[:2] == t[:2] and same(s[2], t[2]) and same(s[3], t[3])

    assert all(same(s, t) for s, t in zip(pii.boost(x, y, n, rounds=2), pii.boost_counted(rows, rounds=2), strict=True))
