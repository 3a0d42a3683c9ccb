"""Near-duplicates, repeated passages, fingerprints and vectors against brute force."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skirmish.llm import edit_fingerprints, embeddings, minhash, substrings
from skirmish.llm.common import components, marked
from skirmish.llm.wordhash import Words

from .cases import ODD, empty, table


def bag(text, width=5):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
    return Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else Counter([tuple(w)] if w else [])


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def classes(links, nodes):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def near_copies(seed, groups=12, copies=8, words=120):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(words)] = f"z{rng.randrange(10**6)}"
            out.append(" ".join(w))
        out.append(" ".join(base).upper() + ".")
    return out + ["a b c", "a b c", "A, b. C"]


def test_signatures_are_unbiased():
    rng = random.Random(3)
    for a, b in [([rng.choice("xyz") for _ in range(400)], [rng.choice("xyzq") for _ in range(300)]), (list("abcde") * 200, list("abcde") * 130), (list("abcdef"), list("abcdeg"))]:
        words = Words([" ".join(a), " ".join(b)], True)
        s = minhash.signatures(*minhash.bags(*minhash.shingles(words)), 2, 8192)
        assert abs((s[0] == s[1]).mean() - similarity(bag(" ".join(a)), bag(" ".join(b)))) < 0.03


def test_near_duplicates(spark):
    texts = near_copies(7) + ODD
    got = {r["doc_id"]: r for r in minhash.near_duplicates(table(spark, texts)).collect()}
    bags = [bag(t) for t in texts] + [Counter()]
    links = [(i, j) for i in range(len(bags)) for j in range(i) if bags[i] and bags[j] and similarity(bags[i], bags[j]) >= 0.8]
    want = classes(links, range(len(bags)))
    assert {d: r["class_id"] for d, r in got.items()} == want
    assert all(r["kept"] == (r["class_id"] == d) for d, r in got.items())
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_blocks_find_links_that_leaders_miss(spark):
    """A chain of copies, each like its neighbours alone: one component."""
    words = [f"w{i}" for i in range(130)]
    chain = [" ".join(words[4 * k : 100 + 4 * k]) for k in range(8)]
    bags = [bag(t) for t in chain]
    assert similarity(bags[0], bags[1]) >= 0.8 > similarity(bags[0], bags[3])
    df = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    assert {r["class_id"] for r in minhash.near_duplicates(df).collect()} == {0}


def test_overlap_products():
    import pyarrow as pa

    items = [[1, 2, 3], [2, 3, 4], [9], [], [1, 2, 3]]
    hit = minhash.overlaps(pa.table({"items": pa.array(items, pa.list_(pa.int64()))}), 0.5, width=2)
    assert {(i, j) for i, j in zip(*np.nonzero(hit), strict=True) if i < j} == {(0, 1), (0, 4), (1, 4)}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = classes(links, {n for p in links for n in p})
    assert got == {n: c for n, c in want.items() if n in got} and {n for a, b in links if a != b for n in (a, b)} == set(got)


def removed(texts, window):
    first, out = {}, {}
    for d, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if first.setdefault(k, d) < d:
                gone[i : i + window] = [True] * window
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("window,seed", [(6, 3), (50, 20)])
def test_substrings(spark, window, seed):
    rng = random.Random(window)
    shared = [" ".join(rng.choice("abcdefgh") for _ in range(window + 15)) for _ in range(6)]
    texts = []
    for _ in range(80):
        parts = [" ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 40))) for _ in range(2)]
        texts.append(f"{parts[0]}\n{rng.choice(shared)[rng.randint(0, 12) :]}  {parts[1]}")
    texts += texts[:5] + ODD + ["word " * 120]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.substring_dedup(table(spark, texts), window, seed).collect()}
    want = removed([*texts, ""], window)
    assert got == want and sum(v[1] > 0 for v in want.values()) > 20
    assert substrings.substring_dedup(empty(spark)).count() == 0


def test_remove_repeats_keeps_columns(spark):
    long_ = " ".join(f"w{i}" for i in range(60))
    df = table(spark, [long_, "x  y " + long_, "  as it\nwas "]).selectExpr("*", "1 AS __id", "2 AS __found", "3 AS tie", "4 AS first", "5 AS row")
    made = substrings.remove_repeats(df)
    assert made.columns == df.columns
    got = {r["doc_id"]: r["text"] for r in made.collect()}
    assert got == {0: long_, 1: "x y", 2: "  as it\nwas ", 3: None}
    assert substrings.remove_repeats(df.limit(0)).collect() == []


def test_rows_that_share_an_id_are_judged_by_their_own_words(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(70)) for x in "ab")
    rows = [(1, a), (5, a), (5, b), (5, "c " + a), (5, b), (None, a), (None, b)]
    got = substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["kept_text"]) for r in got.collect()) == sorted([(1, a), (5, ""), (5, b), (5, b), (5, "c"), (0, a), (0, b)])


def test_a_passage_of_thousands_is_settled_whole(spark):
    """Places inside a shared passage give one interval each; only its ends are compared window by window."""
    passage = " ".join(f"p{i}" for i in range(300))
    texts = [f"{' '.join(f'l{d}x{i}' for i in range(60))} {passage} {' '.join(f'r{d}x{i}' for i in range(60))}" for d in range(60)]
    rows = substrings.tied(substrings.id_text(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    wanted = substrings.anchors(rows, 50, 20).select("doc_id", "tie", "anchors")
    found = substrings.extents(rows.join(wanted, ["doc_id", "tie"]), 50, 20)
    spans = substrings.extended(found, 50).where("end - start > 50").groupBy("doc_id").count().collect()
    assert len(spans) == 59 and min(r["count"] for r in spans) > 5
    got = substrings.substring_dedup(rows.select("doc_id", "text")).collect()
    assert {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in got} == {d: [(60, 360)] if d else [] for d in range(60)}


def test_edit_likeness(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([3, 50, 400, 2500]))) for _ in range(60)] + ODD
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in edit_fingerprints.edit_likeness(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    down = sorted(rows, reverse=True)
    better = 0
    for k, (d, t) in enumerate(down):
        n = down[(k + 1) % len(down)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + n[:half]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert r["fingerprint"] == edit_fingerprints.written(edit_fingerprints.embed([t])[0])
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        better += r["near_edited"] > r["near_next"] or len(t) < 4 or d < 30
    assert better > 0.9 * len(down)
    assert edit_fingerprints.edit_likeness(empty(spark)).count() == 0
    assert edit_fingerprints.edit_likeness(spark.createDataFrame([(5, "only")], "doc_id long, text string")).first()["n_chars"] == 4


def walk(text):
    """The embedding character by character, by plain loops: (level, samples)."""
    bits, nibble = edit_fingerprints.coins()
    n, level = len(text), 0
    while 3 * n >= edit_fingerprints.SAMPLES and 3 * n >> level >= edit_fingerprints.SAMPLES:
        level += 1
    at, step, out = 0, 0, []
    while at < n and step < 3 * n:
        cp = ord(text[at])
        c = (cp ^ (cp >> 8)) & 255
        if step % (1 << level) == 0:
            out.append(int(nibble[c]))
        at += int(bits[step % edit_fingerprints.PERIOD][c])
        step += 1
    return level, out


def test_embedding_is_the_plain_walk():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdé😀 ") for _ in range(n)) for n in (0, 1, 2, 5, 84, 85, 86, 170, 171, 500, 5000)] + [t for t in ODD if len(t) < 7000]
    for t, made in zip(texts, edit_fingerprints.embed(texts), strict=True):
        level, ahead, back = made
        assert (level, ahead.tolist()) == walk(t) and (level, back.tolist()) == walk(t[::-1]), t[:40]
        again = edit_fingerprints.read(edit_fingerprints.written(made))
        assert again[0] == level and (again[1] == ahead).all() and (again[2] == back).all()


def test_fingerprint_classes(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(900)) for _ in range(10)]
    texts = base + [b[:600] + "!" + b[602:] for b in base] + base[:2] + ["", ""]
    prints = edit_fingerprints.fingerprints(table(spark, texts, clash=False))
    prints = prints.selectExpr("*", "'x' AS class", "1 AS its_class_")
    got = {r["doc_id"]: r["class_id"] for r in edit_fingerprints.near_duplicates(prints).collect()}
    assert sum(got[i] == got[i + 10] == i for i in range(10)) >= 8 and got[20] == got[0] and got[22] == 22 and got[23] == 23
    assert len({got[i] for i in range(10)}) == 10
    odd = spark.createDataFrame([(1, None), (None, "0:12:21"), (None, "0:1:1"), (2, "0:1:1"), (2, "0:1:1"), (3, "0::")], "doc_id long, fingerprint string")
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in edit_fingerprints.near_duplicates(odd).collect()) == [(0, 0), (0, 2), (1, 1), (2, 2), (2, 2), (3, 3)]
    assert edit_fingerprints.near_duplicates(odd.limit(0)).count() == 0


def test_band_classes_are_those_of_all_pairs(spark):
    """Classes by bands against links of all pairs of fingerprints, edits at all places and lengths on both sides of a level."""
    rng = random.Random(12)
    texts = []
    for n in (60, 150, 168, 172, 340, 345, 900, 3000):
        for _ in range(6):
            t = "".join(rng.choice("abcdefghij ") for _ in range(n))
            cut = rng.randrange(n)
            texts += [t, t[:cut] + "#" + t[cut:], t[: n - n // 20], t[n // 20 :], t[:cut] + t[cut + 3 :]]
    prints = [edit_fingerprints.embed([t])[0] for t in texts]
    like = edit_fingerprints.likeness
    links = [(i, j) for i in range(len(prints)) for j in range(i) if like(prints[i], prints[j]) >= edit_fingerprints.THRESHOLD]
    bands, bits = edit_fingerprints.banding(10**6)
    keys = [set(k.tolist()) for k in edit_fingerprints.band_keys(prints, bands, bits)]
    hit = edit_fingerprints.all_alike(prints, edit_fingerprints.THRESHOLD)
    assert (np.argwhere(np.tril(hit, -1)) == np.array(sorted(links))).all()
    met = sum(bool(keys[i] & keys[j]) for i, j in links)
    assert len(links) > 80 and met >= 0.99 * len(links)
    got = {r["doc_id"]: r["class_id"] for r in edit_fingerprints.near_duplicates(edit_fingerprints.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    want = classes(links, range(len(texts)))
    assert sum(got[i] != want[i] for i in want) <= 2


def test_likeness_by_place_of_an_edit():
    """What the docstring says: each walk keeps its own side of an edit, so it costs the same early and late."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(1200)) for _ in range(200)]
    fresh = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(360)) for _ in range(200)]
    like = lambda a, b: [edit_fingerprints.likeness(x, y) for x, y in zip(edit_fingerprints.embed(a), edit_fingerprints.embed(b), strict=True)]
    late, early = like(texts, [t[:840] + f for t, f in zip(texts, fresh, strict=True)]), like(texts, [f + t[360:] for t, f in zip(texts, fresh, strict=True)])
    assert min(late) > 0.5 and min(early) > 0.5
    one = like(texts, [t[:600] + t[601:] for t in texts])
    assert np.mean(np.array(one) >= edit_fingerprints.THRESHOLD) > 0.95


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_recall_by_number_of_edits(spark):
    """Documents and copies of them with random edits share a class; unlike ones stay far below the threshold."""
    rng = random.Random(1)
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect() if r["text"] and 300 <= len(r["text"]) <= 8_000]
    docs = list(dict.fromkeys(docs))[:400]

    def edited(text, k):
        out = list(text)
        for _ in range(k):
            i, what = rng.randrange(len(out)), rng.randrange(3)
            out[i : i + (what < 2)] = [rng.choice("abcdefghijklmnop ")] if what else []
        return "".join(out)

    for k, least in ((1, 0.98), (3, 0.97), (10, 0.9)):
        rows = [(i, t) for i, t in enumerate(docs)] + [(1_000 + i, edited(t, k)) for i, t in enumerate(docs)]
        prints = edit_fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
        got = {r["doc_id"]: r["class_id"] for r in edit_fingerprints.near_duplicates(prints).collect()}
        assert np.mean([got[i] == got[1_000 + i] for i in range(len(docs))]) >= least, k
    prints = edit_fingerprints.embed(docs)
    unlike = [edit_fingerprints.likeness(prints[i], prints[j]) for i in range(len(docs)) for j in (i - 1, i - 31)]
    assert np.quantile(unlike, 0.99) < 0.3


def test_edit_likeness_of_repeated_rows(spark):
    """Rows that share an id, rows without one, columns with the names of the operator's own."""
    rows = [(None, "n1"), (5, "aaaa"), (5, "aaaa"), (5, "bbbb"), (9, "zzzzzz"), (None, None), (None, "n1")]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, part int, head string, tie int")
    got = edit_fingerprints.edit_likeness(df.repartition(3)).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (0, 2), (0, 2), (5, 4), (5, 4), (5, 4), (9, 6)]
    full = edit_fingerprints.likeness_and_classes(df)
    assert {(r["doc_id"], r["class_id"]) for r in full.collect() if r["doc_id"]} == {(5, 5), (9, 9)} and full.columns[-1] == "class_id"


def test_vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(30):
        c = rng.standard_normal(32)
        rows += [(c + rng.standard_normal(32) * s).astype(np.float32).tolist() for s in rng.choice([0.02, 0.15, 0.3], 20)]
    rows += [rows[0], rows[0], [0.0] * 32, None, [float("nan")] * 32, [1.0, None], [1.0, 0.0], [2.0, 0.0], [], [float("inf")] * 32]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int, filter int")
    got = {r["vec_id"]: r for r in embeddings.near_vectors(df, block=16).collect()}
    good = {i: np.array(v, float) for i, v in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(i, j) for i in good for j in good if j < i and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= 0.95]
    degree = Counter(x for p in links for x in p)
    found = sum(r["n_links"] for r in got.values())
    assert all(r["n_links"] <= degree[i] for i, r in got.items()) and found >= 0.98 * 2 * len(links)
    want = classes(links, range(len(rows)))
    assert sum(got[i]["component_id"] != want[i] for i in want) <= 2
    assert embeddings.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [10**4, 10**6, 10**8])
def test_recall_at_the_limit_holds_as_tables_grow(n):
    """Random pairs at a cosine of 0.9505 with the filters that a table of n vectors gets."""
    rng = np.random.default_rng(n)
    codes = embeddings.Codes(64, embeddings.code_size(n), embeddings.expected_filters(n))
    x, z = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, 500, 64)))
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.9505 * x + np.sqrt(1 - 0.9505**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    a, b = ({*zip(*(v.tolist() for v in codes.passed(u)), strict=True)} for u in (x, y))
    assert len({r for r, _ in a & b}) >= 0.99 * 500


def test_vectors_in_double_precision(spark):
    """Vectors that floats would not tell apart, on both sides of the limit."""
    c = 0.95
    rows = [(1, [1.0, 0.0]), (2, [c + 1e-12, (1 - (c + 1e-12) ** 2) ** 0.5]), (3, [c - 1e-12, -((1 - (c - 1e-12) ** 2) ** 0.5)])]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r["vec_id"]: r["n_links"] for r in got.collect()} == {1: 1, 2: 1, 3: 0}


def test_list_decoding_is_complete():
    rng = np.random.default_rng(1)
    codes = embeddings.Codes(16, 12, 10.0, least=3)
    x = rng.standard_normal((40, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, filt = codes.passed(x)
    y = x @ codes.turn
    score = (y[:, :8] @ codes.codes[0].T)[:, :, None] + (y[:, 8:] @ codes.codes[1].T)[:, None, :]
    flat = score.reshape(40, -1)
    limit = np.minimum(codes.threshold, np.sort(flat, axis=1)[:, -3])
    assert {(int(r), int(f)) for r, f in zip(row, filt, strict=True)} == {(r, f) for r in range(40) for f in np.flatnonzero(flat[r] >= limit[r])}


def test_hot_bucket_is_dealt_to_blocks(spark):
    df = spark.range(300).withColumn("vec_id", F.col("id")).select("vec_id", F.array(F.lit(1.0), (F.col("vec_id") * 0.0001)).cast("array<float>").alias("embedding"))
    got = embeddings.near_vectors(df, block=32).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(299, 0)}


def test_texts_without_a_partner_are_not_shuffled(spark):
    """Marks lose no key, also where many share a bit; the two dedups join only what is marked, whatever their other columns' type."""
    rows = spark.range(3000).selectExpr("cast(nullif(id, 7) as int) AS doc_id", "id AS maybe_not")
    some = spark.range(0, 3000, 30).selectExpr("id AS doc_id").unionByName(spark.range(5000, 5050).selectExpr("id AS doc_id"))
    for words, most in ((1, 3000), (1 << 17, 105)):
        got = marked(rows, some, "doc_id", words).collect()
        hit = {r["doc_id"] for r in got if r["maybe"]}
        assert len(got) == 3000 and set(range(0, 3000, 30)) <= hit and len(hit) <= most
    shared = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{shared} end{i}" if i < 2 else f"only text {i}") for i in range(50)], "doc_id int, text string")
    made = substrings.remove_repeats(docs)
    assert "Union" in made._jdf.queryExecution().executedPlan().toString()
    text = {r["doc_id"]: r["text"] for r in made.collect()}
    assert text == {0: f"{shared} end0", 1: "end1"} | {i: f"only text {i}" for i in range(2, 50)}
