"""Quality classifier, personal data and the pipeline."""

import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skirmish.llm import pii, quality
from skirmish.llm.queries import oracle_sql, queries

from .cases import ODD, empty, table

FOLDER = "/root/testdata/sf0.01"


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, t) if ok(m.group()))


def test_base_spans(spark):
    rng = random.Random(11)
    parts = ["a@b.c", "_d@e.f", "x@@y.z", ".", "1.2.3.4", ".5", "256.1.1.1", "4111 1111 1111 1111", "-", "12", "+1 (456) 555-2186", "+", "9", " ", "😀", "é", "4111111111111112", "99999999999999999999.1.1.1", "+12 3.4.5.6 78901234"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(500)] + ODD + ["4111 1111 1111 1111 " * 30, "a" * 20_000 + "@", "+1" + " " * 20_000]
    got = {r["doc_id"]: r for r in pii.find(table(spark, texts), pii.Model([], {})).collect()}
    for i, t in enumerate([*texts, ""]):
        want = base_spans(t)
        assert got[i]["base"] == got[i]["spans"] == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want), t[:80]
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(x[1] == n for x in want) for n in range(4)]
    assert pii.find(empty(spark)).count() == 0


def test_cards_of_single_digits(spark):
    """No two digits of these texts are neighbours."""
    rng = random.Random(13)
    texts = [" ".join("4111111111111111"), "-".join("4111111111111111"), " ".join("0" * 14), "pay " + " ".join("4111111111111112") + " now", "1 2-3", "1  2"]
    texts += ["x ".join("".join(rng.choice("0123456789") + rng.choice(" -") for _ in range(rng.randint(10, 22))) for _ in range(3)) for _ in range(200)]
    df = table(spark, texts)
    got = {r["doc_id"]: r for r in pii.find(df, pii.Model([], {})).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i]["base"] == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want), t
        assert got[i]["n_card"] == sum(k == 2 for _, k, _ in want)
    assert [got[i]["n_card"] for i in range(6)] == [1, 1, 1, 0, 0, 0] and sum(r["n_card"] for r in got.values()) > 20
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df, pii.Model([], {})).collect()}
    assert [clean[i] for i in range(4)] == ["[CARD]"] * 3 + [texts[3]]


def best_choice(base, added):
    """Of (start, rank, end, chance) those that stay: by plain dynamic programming over ends."""
    free = [i for i, c in enumerate(added) if not any(b[0] < c[2] and c[0] < b[2] for b in base)]
    free.sort(key=lambda i: (added[i][2], i))
    done = [(0.0, ())]  # after each of them: the best sum and the choice
    for k, i in enumerate(free):
        before = max(j for j in range(k + 1) if j == 0 or added[free[j - 1]][2] <= added[i][0])
        value = done[before][0] + added[i][3]
        done.append((value, (*done[before][1], i)) if value > done[-1][0] else done[-1])
    return [added[i][:3] for i in done[-1][1]]


def all_spans(t):
    """Base spans and, of the other candidates, the greatest number that overlap neither them nor each other."""
    base = base_spans(t)
    more = sorted((m.start(), pii.KINDS.index(k), m.end(), 0.5) for k, p in pii.MORE.items() for m in re.finditer(p, t))
    return sorted(base + best_choice(base, more))


def test_overlapping_candidates_are_settled_by_their_chances(spark):
    rng = random.Random(23)
    rows = []
    for i in range(400):
        base = sorted((s, 0, s + rng.randint(1, 4)) for s in rng.sample(range(60), rng.randint(0, 3)))
        added, at = [], 0
        for kind in range(rng.randint(0, 4)):  # matches of one pattern do not overlap
            at = 0
            while at < 60 and rng.random() < 0.8:
                at += rng.randint(0, 9)
                end = at + rng.randint(1, 12)
                added.append((at, kind, end, rng.choice([0.25, 0.5, 0.75, rng.random()])))
                at = end
        rows.append((i, base, sorted(added)))
    plain = "struct<start:int,rank:int,end:int>"
    df = spark.createDataFrame(rows, f"i int, base array<{plain}>, added array<struct<start:int,rank:int,end:int,chance:double>>")
    got = {r["i"]: [tuple(p)[:3] for p in r["picked"]] for r in pii.chosen(df).select("i", "picked").collect()}
    for i, base, added in rows:
        assert sorted(got[i]) == sorted(best_choice(base, added)), i
    assert any(len(got[i]) > 2 for i in got)


def test_a_text_of_a_hundred_thousand_spans(spark):
    began = time.time()
    n = 100_000
    mails = "".join(f"m{k}@é.co, x{k % 7}@y.org; " for k in range(n // 2)).replace("é", "e")
    chain = "1234 5678 9012 3456 " * 20_000 + "(555) 123-4567-" * 5_000
    df = spark.createDataFrame([(1, mails), (2, chain), (3, "é" * 9_000 + " a@b.co " + "é" * 9_000)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find(df, ALL).collect()}
    assert found[1]["n_email"] == n and found[1]["base"] == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base_spans(mails))
    text = {r["doc_id"]: r["text"] for r in pii.redact(df, pii.Model([], {})).collect()}
    assert text[1] == "[EMAIL], [EMAIL]; " * (n // 2)
    assert text[3] == "é" * 9_000 + " [EMAIL] " + "é" * 9_000
    at = 0
    for span in found[2]["spans"].split(","):
        kind, s, e = span.split(":")
        assert at <= int(s) < int(e)
        at = int(e)
    assert time.time() - began < 120


ALL = pii.Model([], dict.fromkeys(pii.KINDS, float("-inf")))


def test_added_spans_stand_where_they_match(spark):
    rng = random.Random(17)
    long_ = "a" * 300 + "1"
    texts = ["ref 1555-123-4567 and 555-123-4567 end", "x.abcdefgh12345678901 abcdefgh12345678901", f"{long_} b", "_" * 200 + "7", f"{'u' * 90} [at] {'v' * 80}{'.w' * 12}.org", "me (at) home [dot] org me(at)home.org", "me [at] home. Then"]
    parts = ["555-123-4567", "1", "(555) 123-4567", " ", "+", "-", "4111.1111.1111.1111", ".", "sk_live_abcdefghij123456", "_", "a [at] b.co", "ab", "(at)", "[dot] c", "é😀", "token = ", "0123456789abcdef0123"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(500)] + ODD
    got = {r["doc_id"]: r for r in pii.find(table(spark, texts), ALL).collect()}
    for i, t in enumerate([*texts, ""]):
        assert got[i]["spans"] == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in all_spans(t)), t[:80]
    assert got[0]["spans"] == "phone:22:34" and got[2]["spans"] == "secret:0:301" and got[4]["spans"].startswith("email:0:")
    clean = {r["doc_id"]: r["text"] for r in pii.redact(table(spark, texts[:1]), ALL).collect()}
    assert clean[0] == "ref 1555-123-4567 and [PHONE] end"


def test_trees_add_what_their_labels_do_not_say(spark):
    """The words and formats that label secrets are hidden from the trees: they accept one without a keyword by its look."""
    rng = random.Random(2)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [f"some words and token = {hexa(36)} here" for _ in range(400)] + [f"call +1 (456) 555-{n} or a{n}@mail.example.com" for n in range(1000, 1060)] + [f"plain internationalization2 text {n} v1.2.3" for n in range(60)] + [f"some words and then {hexa(36)} here" for _ in range(3)]
    df = table(spark, texts)
    model = pii.fit(pii.id_text(df))
    assert model.trees and "secret" in model.thresholds
    assert all(f not in pii.HELD["secret"] for t in model.trees for f in used(t, "secret"))
    rows = {r["doc_id"]: r for r in pii.find(df, model).collect()}
    found = [i for i in range(523) if "secret" in rows[i]["spans"]]
    assert sum(i < 400 for i in found) > 390 and {520, 521, 522} <= set(found) and not any(rows[i]["spans"] for i in range(460, 520))
    for r in rows.values():
        assert set(filter(None, r["base"].split(","))) <= set(filter(None, r["spans"].split(",")))
    clean = pii.redact(df, model)
    assert clean.columns == df.columns
    text = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert text[400] == "call [PHONE] or [EMAIL]" and text[500] == texts[500] and text[523] is None
    assert pii.redact(empty(spark)).count() == 0 and pii.redact(empty(spark)).columns == empty(spark).columns


def used(tree, kind):
    """The features that a tree asks for on the way of a kind's candidates (whose held features are all 0)."""
    if not isinstance(tree, tuple):
        return set()
    f = pii.FEATURES[tree[0]]
    if f == "kind":
        return used(tree[2] if pii.KINDS.index(kind) <= tree[1] else tree[3], kind)
    if f in pii.HELD[kind]:  # always 0: the left way
        return used(tree[2], kind)
    return {f} | used(tree[2], kind) | used(tree[3], kind)


def test_trees_in_sql_are_those_in_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 5, (300, len(pii.FEATURES)))
    y = ((x[:, 2] > 2) ^ (x[:, 3] > 1)).astype(float)
    trees = pii.boost(x, y, np.ones(300))
    want = sum(pii.tree_values(t, x) for t in trees)
    assert ((want > 0) == (y > 0)).mean() > 0.95
    df = spark.createDataFrame([(int(i), *map(int, r)) for i, r in enumerate(x)], ", ".join(["i int", *[f"{f} int" for f in pii.FEATURES]]))
    got = {r["i"]: r["s"] for r in df.select("i", pii.Model(trees, {}).score(F.struct(*pii.FEATURES)).alias("s")).collect()}
    assert all(abs(got[i] - want[i]) < 1e-9 for i in range(300))


def labelled(spark, n=400):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in "bcdfghklm" for b in ("an", "er", "ou", "is")]
    good = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 200))) + "." for _ in range(n)]
    bad = [" ".join(rng.choice(words).upper() + "!!" for _ in range(rng.randint(30, 200))) if k % 2 else "spam " * 90 for k in range(n // 4)]
    texts = good + bad + ODD
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, int(i < n)) for i in range(n + len(bad)) if i % 3], "doc_id long, quality int")
    return docs, labels, n, len(bad)


def test_classifier_on_held_out(spark):
    docs, labels, n, m = labelled(spark)
    rows = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    held = [i for i in range(n + m) if i % 3 == 0]
    assert sum(rows[i]["kept"] == (i < n) for i in held) >= 0.98 * len(held)
    assert all(rows[i]["kept"] for i in held if i < n)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["kept"]}


def plain_keys(texts, ids, roles, buckets):
    """Log weights and keys by dicts, text by text: counts of all and of target texts, their ratio, sums over n-grams."""
    import math

    def grams(t):
        w = re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+|[!-/:-@\[-`{-~]+", t)
        lone = lambda x: int(quality.features([x], buckets)[1][0])
        out = [lone(x) for x in w]
        equal, skip = (int(quality.mix(np.array([n], np.uint64))[0] % np.uint64(buckets)) for n in (1, 2))
        for x, y in zip(w, w[1:], strict=False):
            h = quality.Tokens([f"{x} {y}"]).hashes()
            out.append(equal if x == y else int(quality.mix(quality.mix(h[:1] * quality.GOLDEN + h[1:]))[0] % np.uint64(buckets)))
        return out + [skip for x, y in zip(w, w[2:], strict=False) if x == y]

    raw, target = {}, {}
    for t, r in zip(texts, roles, strict=True):
        for g in grams(t):
            raw[g] = raw.get(g, 0) + 1
            target[g] = target.get(g, 0) + (r == 1)
    share = sum(target.values()) / sum(raw.values())
    ratio = {}
    for g, n in raw.items():
        seen = target[g] + quality.SMOOTH * share
        x = math.log(seen / share / (n + quality.SMOOTH))
        ratio[g] = math.copysign(max(abs(x) - 1 / math.sqrt(seen), 0), x)
    weight = [sum(ratio[g] for g in grams(t)) for t in texts]
    return weight, [w + float(quality.gumbel([i])[0]) for w, i in zip(weight, ids, strict=True)]


@pytest.mark.parametrize("k", [0, 7, 60, 119, 500])
def test_kept_are_the_top_k_of_plain_counts(spark, k):
    rng = random.Random(k)
    texts = [" ".join(rng.choice(["ab", "cd!", "é", "x1", "...", "Zz", "w w"]) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 120, 2)], "doc_id long, quality int")
    role = {r["doc_id"]: r["role"] for r in quality.roles(labels, 10**6).collect()}
    weight, key = plain_keys(texts, range(120), [role.get(i, 0) for i in range(120)], quality.BUCKETS)
    got = {r["doc_id"]: r for r in quality.classify(docs, labels, k).collect()}
    assert all(abs(got[i]["log_weight"] - weight[i]) < 1e-6 and abs(got[i]["key"] - key[i]) < 1e-6 for i in range(120))
    assert {i for i, r in got.items() if r["kept"]} == set(sorted(range(120), key=lambda i: -key[i])[:k])


def test_k_is_the_number_of_good_ones_to_expect(spark):
    weight, good = np.array([0.0, 1, 2, 3, 4, 5, 6, 7]), np.array([0, 0, 1, 0, 1, 1, 0, 1], bool)
    chance = quality.Chance(weight, good)
    assert chance.of(np.array([-9, 0.4, 2, 3, 4.4, 6, 7, 99])).tolist() == [0, 0, 0.5, 0.5, 2 / 3, 2 / 3, 1, 1]
    df = spark.createDataFrame([(i, float(w)) for i, w in enumerate([-3, 0, 2, 2, 3, 5, 5, 5, 8, 9])], "doc_id long, log_weight double")
    assert quality.expected_good(df, chance) == round(3 * 0.5 + 3 * 2 / 3 + 2)
    assert quality.expected_good(df, quality.Chance(weight, np.ones(8, bool))) == 10


def test_classifier_without_labels(spark):
    docs = table(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(docs, none).where("not kept").isEmpty()
    assert quality.classify(empty(spark), none).count() == 0 and quality.keep_good(empty(spark), none).count() == 0


def test_resample_is_the_top_k(spark):
    rng = random.Random(3)
    keys = [rng.choice([rng.gauss(0, 5), 1.25, 7.5]) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(keys)), "doc_id long, key double")
    for k in (0, 1, 37, 1500, 3000, 5000):
        got = {r["doc_id"] for r in quality.resample(df, k, bins=16).collect()}
        assert got == {d for d, _ in sorted(enumerate(keys), key=lambda x: (-x[1], x[0]))[:k]}


def test_gumbel_keys_sample_by_weight():
    keys = np.stack([quality.scores(list(range(i * 3, i * 3 + 3)), ["a", "b", "c"], np.zeros(64))[2] for i in range(4000)])
    share = np.bincount(keys.argmax(axis=1), minlength=3) / 4000
    assert np.abs(share - 1 / 3).max() < 0.03


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_pipeline_stages(spark):
    """Each stage against what its operator has to do to its own input, by plain means."""
    from tests.llm.test_dedup import bag, removed, similarity

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        made = stage(spark, docs, FOLDER)
        if name == "packing":
            assert {r["doc_id"] for r in made.select("doc_id").distinct().collect()} == set(before)
            break
        assert made.columns == docs.columns
        made = made.cache()
        after = at[name] = {r["doc_id"]: r["text"] for r in made.collect()}
        assert made.where("n_chars <> length(text)").isEmpty()
        if name == "quality_classifier":
            # the largest k keys, noise and all, of 341 good and 58 bad labelled documents
            assert np.mean([(d in after) == (labels[d] == 1) for d in labels]) >= 0.98
        elif name == "minhash_dedup":
            gone = set(before) - set(after)
            bags = {d: bag(t) for d, t in before.items()}
            assert gone and all(any(e < d and similarity(bags[d], bags[e]) >= 0.8 for e in bags) for d in gone)
        elif name == "substring_dedup":
            ids = sorted(before)
            want = removed([before[d] for d in ids], 50)
            assert after == {d: (want[k][2] if want[k][1] else before[d]) for k, d in enumerate(ids)}
        elif name == "pii":
            assert all(not base_spans(t) for t in after.values())
            assert all(after[d] == t for d, t in before.items() if not re.search("[0-9@]", t))
        docs = made


def test_registry():
    names = list(queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)] + ["pipeline"]
    assert set(oracle_sql()) <= set(names) and [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_dedup", "substring_dedup", "pii", "packing"]


def staged(spark, docs, folder):
    """Ids that come out of each stage; all but the last keep the columns."""
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder)
        out[name] = made.cache()
        if name != "packing":
            assert made.columns == docs.columns
            docs = out[name]
    return out


def test_pipeline_of_nothing_and_of_repeated_rows(spark, tmp_path):
    """An empty table, repeated rows, null and odd texts, columns named like those that operators make."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "bcdfghklm" for b in ("an", "er", "ou", "is")]
    texts = [" ".join(rng.choice(words) for _ in range(60)) + f" mail a{i}@b.co" for i in range(40)] + [""] * 3 + [None]
    rows = [(i, t, "en", "s", len(t or ""), "k", 0.5, [1]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, *rows[:5], (None, texts[0], "en", "s", 1, "k", 0.5, [1])], "doc_id long, text string, lang string, source string, n_chars long, key string, score double, spans array<int>")
    folder = str(tmp_path)
    spark.createDataFrame([(i, int(i < 30)) for i in range(40) if i % 2], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    none = staged(spark, docs.limit(0), folder)
    assert all(df.count() == 0 for df in none.values())
    made = staged(spark, docs, folder)
    after = {n: sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda x: (x is None, x)) for n, df in made.items()}
    assert {*range(1, 30, 2)} <= set(after["quality_classifier"])
    assert set(after["packing"]) == set(after["pii"]) == set(after["substring_dedup"])
    assert made["pii"].where("text like '%@%'").isEmpty() and made["pii"].where("n_chars <> length(text)").isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, made["pii"], folder).count() == made["packing"].count()
