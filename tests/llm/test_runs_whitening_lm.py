"""Operators 11 to 13 against plain versions of themselves."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skirmish.llm import context_trees, periods, queries, whitening
from tests.llm.cases import ODD, empty, table

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def plain_runs(words, exponent=4, shortest=6):
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(shortest, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4), st.integers(2, 5))
def test_runs_of_small_alphabets(texts, exponent):
    got = periods.runs_of(texts, exponent, 6)
    assert [[tuple(map(int, r)) for r in rs] for rs in got] == [plain_runs(t, exponent) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(4, 9), st.lists(st.integers(0, 3), max_size=20))
def test_runs_of_planted_powers(root, times, rest):
    text = rest + root * times + rest[::-1]
    assert [tuple(map(int, r)) for r in periods.runs_of([text], 4, 6)[0]] == plain_runs(text)


def test_extensions_ask_in_pieces(monkeypatch):
    monkeypatch.setattr(periods, "ASKED", 1)
    text = [0, 1] * 40 + [2] * 50 + [0, 1, 2] * 30
    assert [tuple(map(int, r)) for r in periods.runs_of([text, [5] * 300], 4, 6)[0]] == plain_runs(text)


def test_periodic_runs_bears_odd_texts(spark):
    got = periods.periodic_runs(table(spark, ODD))
    assert got.columns == ["doc_id", "n_words", "runs", "strongest", "collapsed"]
    rows = got.collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        words = ((ODD[r["doc_id"]] if r["doc_id"] < len(ODD) else "") or "").encode().split()
        words = [w.decode() for w in words]
        runs = plain_runs(words) if len(set(words)) > 1 or len(words) < 10 else [(0, len(words), 1)]
        assert r["n_words"] == len(words)
        assert [tuple(x) for x in r["runs"]] == runs
        assert r["collapsed"] == plain_collapsed(words, runs)
    assert periods.periodic_runs(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        periods.periodic_runs(empty(spark), exponent=1)


def test_a_long_text_of_runs_ends(spark):
    text = " ".join(["a b c"] * 30_000 + ["x"] * 50_000 + [f"w{i}" for i in range(60_000)])
    r = periods.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in r["runs"]] == [(0, 90_000, 3), (90_000, 50_000, 1)]
    assert tuple(r["strongest"]) == (90_000, 50_000, 1)


def test_op11_on_a_fixture(spark, tmp_path):
    texts = [None, "", " \n ", *(" ".join(f"w{(i * i + d) % 7}" for i in range(d)) for d in range(1, 150)), "tie a a a a a a b b b b b b", "x y " * 6]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    planted = 0
    for d, text in enumerate(texts):
        w = [x.decode() for x in (text or "").encode().split()]
        h = zlib.crc32(str(d).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(plain_collapsed(w, runs)))
        assert tuple(got[d])[1:] == want, d
    assert planted > 5


def plain_whitening(vectors, most=8):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n = len(x)
    s = [sum(map(int, c)) for c in x.T]
    deviation = [sum((n * int(v) - t) ** 2 for v, t in zip(row, s, strict=True)) for row in x]
    centred = np.array([[(n * int(v) - t) / n for v, t in zip(row, s, strict=True)] for row in x])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > 1e-10 * e[0]).sum()))
    return deviation, centred @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def same_whitening(rows, ids, vectors):
    deviation, white, share = plain_whitening(vectors)
    at = {v: i for i, v in enumerate(ids)}
    assert len(rows) == white.size
    got = np.zeros(white.shape)
    for r in rows:
        i, k = at[r["vec_id"]], r["component"] - 1
        got[i, k] = r["whitened"]
        assert r["n"] == len(ids) and r["deviation"] == deviation[i]
        assert abs(r["explained"] - share[k]) <= 1e-9 and r["identity_error"] < 1e-6
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got * sign - white).max() < 1e-6


@tables
def test_op12_on_all_vectors(spark):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    same_whitening(queries.op12_embedding_whitening(spark, SF).collect(), list(rows), list(rows.values()))


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(5)
    good = [[float(a), float(b), float(a + 0.5 * b), 3.0] for a, b in rng.normal(size=(40, 2)).round(3)]
    bad = [None, [], [1.0, None, 0.0, 0.0], [math.nan] * 4, [math.inf, 0.0, 0.0, 0.0], [1e30, 0.0, 0.0, 0.0], [1.0, 2.0]]
    rows = [(i, v, "x", 0) for i, v in enumerate([*good, *bad])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string, n int")
    same_whitening(whitening.whiten(df).collect(), range(40), good)
    again = whitening.whiten(df.unionByName(df.where("vec_id = 0")).withColumn("vec_id", F.expr("nullif(vec_id, 1)"))).collect()
    ranks = {r["component"] for r in again}
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in again if r["component"] == 1) == sorted([*((False, i) for i in range(40) if i != 1), (False, 0), (True, 0)])
    assert ranks == set(range(1, len(ranks) + 1)) and {r["n"] for r in again} == {41}


def test_whitening_without_variance(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert make([]) == [] and make([(1, [1.0, 2.0])]) == [] and make([(1, None)]) == []
    assert make([(i, [1.0, 2.0]) for i in range(5)]) == []


def test_whitening_of_wide_deviations(spark):
    rows = [(i, [float((-1) ** i * 2**30), float(i)]) for i in range(10)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["deviation"] for r in got} == {None} and {r["component"] for r in got} == {1}


class PlainTree:
    """Context-tree weighting by recursion over nodes in a dictionary, a tree for each of the 255 decisions."""

    def __init__(self, depth):
        self.depth, self.n = depth, defaultdict(lambda: [0, 0])

    def path(self, context, node):
        return [(context[len(context) - d :], node) for d in range(self.depth + 1)]

    def steps(self, text):
        raw = b"\xff" * self.depth + text + b"\xff"
        for i in range(self.depth, len(raw)):
            for k in range(8):
                yield raw[i - self.depth : i], (1 << k) | (raw[i] >> (8 - k)), raw[i] >> (7 - k) & 1

    def learn(self, text):
        for context, node, bit in self.steps(text):
            for at in self.path(context, node):
                self.n[at][bit] += 1

    @staticmethod
    def own(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weigh(self):
        kids = defaultdict(float)
        self.stop = {}
        for at in sorted(self.n, key=lambda x: -len(x[0])):
            own = self.own(*self.n[at])
            if len(at[0]) == self.depth:
                self.stop[at], all_ = 1.0, own
            else:
                all_ = np.logaddexp(own, kids[at]) - math.log(2)
                self.stop[at] = math.exp(own - math.log(2) - all_)
            if at[0]:
                kids[at[0][1:], at[1]] += all_
        return self

    def score(self, text):
        total = 0.0
        for context, node, bit in self.steps(text):
            p, left = 0.0, 1.0
            for at in self.path(context, node):
                if at not in self.n:  # nothing below was seen: one half
                    p += left * 0.5
                    left = 0.0
                    break
                n = self.n[at]
                p += left * self.stop[at] * (n[bit] + 0.5) / (sum(n) + 1)
                left *= 1 - self.stop[at]
            total += math.log10(p)
        return total


def check_lm(rows, docs, depth, held):
    lower = lambda t: (t or "").encode().lower()
    tree, tokens = PlainTree(depth), Counter()
    for d, t in docs:
        if not held(d):
            tree.learn(lower(t))
            tokens.update([*lower(t).split(), b" "])
    tree.weigh()
    n, v = sum(tokens.values()), len(tokens)
    texts = defaultdict(list)
    for d, t in docs:
        texts[d].append(t)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)) == sorted((d is None, d or 0) for d, _ in docs)
    for r in rows:
        t = lower(texts[r["doc_id"]][0])
        own = [*t.split(), b" "]
        assert r["held_out"] == held(r["doc_id"]) and r["n_tokens"] == len(own) and r["train_tokens"] == n
        assert r["n_known"] == sum(tokens[w] > 0 for w in own)
        assert abs(r["base_score"] - sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in own)) < 1e-6
        want = tree.score(t)
        assert abs(r["score"] - want) < 1e-6 * max(1, abs(want))
        assert abs(r["bits_per_byte"] + want * math.log2(10) / (len(t) + 1)) < 1e-6


def contract_held(d):
    return zlib.crc32(str("" if d is None else d).encode()) % 7 == 2


@pytest.mark.parametrize("depth", [1, 3, 6])
def test_context_trees_against_recursion(spark, depth):
    texts = ["The cat sat", "the CAT sat on the mat\tthe cat", "", None, "été über ÉTÉ", "aaaaaaaaaa", "zq never seen ÿ", "the cat"] * 3
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(d, t, 1.0) for d, t in docs], "doc_id long, text string, score double").repartition(3)
    check_lm(context_trees.score_texts(df, depth=depth).collect(), docs, depth, contract_held)


def test_a_tree_is_a_mixture_of_sequences(spark):
    """The weights are those of learning bit by bit: the root's weighted probability is the product of its predictions."""
    tree = PlainTree(2)
    text, total = b"abababbab abab", 0.0
    for i in range(len(text)):  # what the tree of the first decision predicts of the next bit, then learns it
        context, node, bit = b"\xff\xff"[: max(0, 2 - i)] + text[max(0, i - 2) : i], 1, text[i] >> 7 & 1
        tree.weigh()
        p, left = 0.0, 1.0
        for at in tree.path(context, node):
            n = tree.n[at] if at in tree.n else [0, 0]
            stop = tree.stop.get(at, 1.0 if len(at[0]) == 2 else 0.5)
            p += left * stop * (n[bit] + 0.5) / (sum(n) + 1)
            left *= 1 - stop
        total += math.log(p)
        for at in tree.path(context, node):
            tree.n[at][bit] += 1
    own = [PlainTree.own(*tree.n[b"", 1])]
    kids = 0.0
    for z in {at[0] for at in tree.n if len(at[0]) == 1}:
        deep = sum(PlainTree.own(*tree.n[at]) for at in tree.n if len(at[0]) == 2 and at[0][1:] == z)
        kids += np.logaddexp(PlainTree.own(*tree.n[z, 1]), deep) - math.log(2)
    assert abs(np.logaddexp(own[0], kids) - math.log(2) - total) < 1e-9


def test_lm_bears_odd_texts(spark):
    docs = [*enumerate([*ODD, None]), (0, ODD[0]), (None, "no id")]
    df = table(spark, ODD).select("doc_id", "text", "lang", "key", "score")
    df = df.unionByName(spark.createDataFrame([(None, "no id", "x", "x", 0.0)], df.schema))
    check_lm(context_trees.score_texts(df, depth=2).collect(), docs, 2, contract_held)
    assert context_trees.score_texts(empty(spark)).collect() == []


def test_lm_without_training_texts(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in context_trees.score_texts(df, held_out=F.col("doc_id") > 0).collect()}
    assert got[1]["base_score"] == 0.0 and abs(got[1]["score"] - 24 * math.log10(0.5)) < 1e-9
    assert got[2]["n_known"] == 0 and abs(got[2]["bits_per_byte"] - 8) < 1e-9


def test_log_gamma(spark):
    x = [0.5 + k / 2 for k in range(60)] + [1e3, 1e6 + 0.5, 1e12]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(context_trees.log_gamma(F.col("x"))).collect()]
    assert all(abs(g - math.lgamma(v)) < 1e-9 * max(1, abs(g)) for g, v in zip(got, x, strict=True))


@tables
def test_op13_gathers_from_all_training_texts(spark):
    got = queries.op13_lm_scoring(spark, SF).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    tokens = Counter(w for d, t in docs if not contract_held(d) for w in [*(t or "").encode().lower().split(), b" "])
    n, v = sum(tokens.values()), len(tokens)
    texts = dict(docs)
    assert len(got) == len(docs) and {r["train_tokens"] for r in got} == {n}
    for r in got:
        own = [*(texts[r["doc_id"]] or "").encode().lower().split(), b" "]
        assert r["n_known"] == sum(w in tokens for w in own)
        assert abs(r["base_score"] - sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in own)) < 1e-6
    unseen = [r for r in got if r["held_out"]]
    assert sum(r["bits_per_byte"] for r in unseen) / len(unseen) < 4


def test_lm_sends_no_growing_table_to_all(spark, monkeypatch):
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df)

    materialize = context_trees.materialize
    monkeypatch.setattr(context_trees, "materialize", noted)
    docs = table(spark, [f"a word and {i} more" for i in range(20)])
    plans.append(context_trees.score_texts(docs)._jdf.queryExecution().executedPlan().toString())
    # the nodes of the first two depths alone, however small all tables are here
    assert sum(p.count("SortMergeJoin") for p in plans) == 6
    assert [p.count("BroadcastHashJoin") for p in plans if "BroadcastHashJoin" in p] == [2]
