"""License scan, packing, token counts and piece encoding."""

import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from skirmish.llm import licenses, packing, token_counts, unigram
from skirmish.llm.queries import queries

from .cases import ODD, empty, table

tokenizers = pytest.importorskip("public_tokenizers")
BPE, PIECES = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.01"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def base_places(text):
    words = WORD.findall(lower(text))
    out = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return words, out


def test_license_base_places(spark):
    rng = random.Random(3)
    parts = ["MIT", "mit", "License", "license.", "APACHE", "apache", "general", "GENERAL-public", "public", "x", "été", "licence", "licens"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(200)] + ODD
    got = {r["doc_id"]: r for r in licenses.license_scan(table(spark, texts)).dropDuplicates(["doc_id"]).collect()}
    for i, t in enumerate([*texts, ""]):
        words, places = base_places(t)
        starts = [p for p, _ in places]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(starts, default=None), max(starts, default=None)), t
        assert r["base_labels"] == ",".join(sorted({v for _, v in places})) and 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def test_license_edits():
    known = licenses.notices()
    hits = licenses.search(licenses.normal("under the Apach License; Redistribution and use in source and binary form, with or without modificaton"), known)
    assert {(h[0].label, h[3]) for h in hits} >= {("apache", 1), ("bsd", 2)}
    assert not licenses.search(licenses.normal("the license of the apache chief"), known)


def unseeded(text, known):
    """Every notice tried on the whole text, without seeds and windows."""
    found = [h for x in known for h in licenses.occurrences(x, text, 0, len(text))]
    return sorted(found, key=lambda f: (f[1], f[2], f[0].phrase))


def test_license_finds_all_within_the_edits():
    rng = random.Random(9)
    known = licenses.notices()
    several = 0
    for n in range(400):
        parts = []
        for _ in range(rng.randint(1, 5)):
            x = rng.choice(known)
            s = list(x.phrase)
            for _ in range(rng.choice([0, 0, 1, x.k, x.k + 1])):
                i = rng.randrange(len(s))
                s[i : i + 1] = rng.choice([["a"], ["b", s[i]], []])
            parts += ["".join(s), rng.choice(["foo bar", "license", "", "mit", "public x"])]
        text = licenses.normal(" ".join(parts))
        got = licenses.search(text, known)
        assert got == unseeded(text, known), text
        several += len(got) > 2
    assert several > 100


def test_license_places_beside_exact_ones():
    known = licenses.notices()
    for text, want in [("mit licence mit license", ["mit licence", "mit license"]), ("mozilla public licence mozilla public license", ["mozilla public licence", "mozilla public license"]), ("omit license fees", []), ("mit license mit license mit licens", ["mit license", "mit license", "mit licens"])]:
        t = licenses.normal(text)
        assert [t[a:b] for x, a, b, _ in licenses.search(t, known) if x.label in ("mit", "mpl")] == want, text


def test_license_spans_in_the_query(spark):
    from skirmish.llm import queries

    made = licenses.license_scan(spark.createDataFrame([(1, "The MIT Licence, or: mit license."), (1, "The MIT Licence, or: mit license."), (2, None)], "doc_id long, text string"))
    rows = [r for r in made.collect() if r["doc_id"] == 1]
    assert len(rows) == 2 and [tuple(s) for s in rows[0]["spans"]] == [("mit", 1, 2, 1), ("mit", 4, 5, 0)] and rows[0]["n_base"] == 1
    assert queries.OP1_SPANS == "label:first_word:last_word:edits"
    assert licenses.license_scan(empty(spark)).count() == 0


def test_byte_bpe_ids():
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(BPE), packing.byte_bpe(BPE)
    for t in [*ODD, "a<|endoftext|>  b", "it's 12 o'clock…  ", " " * 6000 + "x", "z" * 6000]:
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_byte_bpe_ids_of_a_whole_table():
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(BPE), packing.byte_bpe(BPE)
    texts = [t or "" for t in pq.read_table(f"{FOLDER}/documents.parquet", columns=["text"]).column(0).to_pylist()]
    for t, e in zip(texts, slow.encode_batch(texts, add_special_tokens=False), strict=True):
        assert fast(t).tolist() == e.ids


def check_packed(rows, ids_of, capacity):
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, ids in ids_of.items():
        mine = sorted(docs[d], key=lambda r: r["piece"])
        assert [r["start"] for r in mine] == [sum(x["length"] for x in mine[:k]) for k in range(len(mine))]
        assert sum(r["length"] for r in mine) == len(ids) and (len(mine) == 1 or all(r["length"] == capacity for r in mine[1:]))
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].astype("<u4").tobytes())
    for places in bins.values():
        at = 0
        for off, n in sorted(places):
            assert off == at
            at += n
        assert at <= capacity
    return len(bins)


def test_packing(spark):
    rng = random.Random(1)
    texts = ["word " * rng.randint(1, 1500) for _ in range(300)] + ODD
    docs = table(spark, texts).limit(10**6).dropDuplicates(["doc_id"])
    rows = packing.best_fit_packing(docs, BPE).collect()
    encode = packing.byte_bpe(BPE)
    ids_of = {i: np.append(encode(t or ""), 2) for i, t in enumerate([*texts, None])}
    bins = check_packed(rows, ids_of, 1024)
    assert bins <= -(-sum(map(len, ids_of.values())) // 1024) * 1.03 + 1
    assert packing.best_fit_packing(empty(spark), BPE).count() == 0


def test_local_search_saves_bins():
    lengths = [6, 6, 6, 5, 5, 4, 4, 4, 8, 12, 10, 10]
    start = [[k] for k in range(len(lengths))]
    done = packing.local_search(start, lengths, 20, seed=1, effort=400)
    assert sorted(i for b in done for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 20 for b in done) and len(done) == 4


def test_token_counts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice(["a", "the", " ", "  ", "\n", "é", "▁", "\t", "x1"]) for _ in range(rng.randint(1, 60))) for _ in range(500)]
    rows = token_counts.count_tokens(table(spark, texts), PIECES, 100).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        t = texts[r["doc_id"]] if r["doc_id"] < len(texts) else ""
        n = len(sp.encode(t))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 100), t[:50]
    assert token_counts.count_tokens(empty(spark), PIECES).count() == 0


@pytest.fixture(scope="module")
def small_scores(tmp_path_factory):
    """The model as a unigram one whose scores a float can add exactly, for the library to segment with."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    with open(PIECES, "rb") as f:
        spec.ParseFromString(f.read())
    spec.trainer_spec.model_type = 1
    for p in spec.pieces:
        p.score = max(p.score, -31_800.0)
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(spec.SerializeToString())
    return str(path)


def test_viterbi_is_the_librarys(small_scores):
    import sentencepiece

    sp, m = sentencepiece.SentencePieceProcessor(model_file=small_scores), unigram.Model(small_scores)
    rng = random.Random(4)
    texts = [t[:100] for t in ODD if "▁" not in t] + ["".join(rng.choice("ab cdthe \né") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    for t in texts:
        assert m.encode(t) == sp.encode(t), t


def test_piece_round_trip(spark):
    texts = [t for t in ODD if "▁" not in t]
    ids = unigram.encode(table(spark, texts), PIECES)
    back = {r["doc_id"]: r["text"] for r in unigram.decode(ids, PIECES).collect()}
    assert back == dict(enumerate([*texts, ""]))
    made = {r["doc_id"]: r for r in unigram.round_trip(table(spark, texts), PIECES).collect()}
    known = {r["doc_id"]: r["ids"] for r in ids.collect()}
    assert all(made[d]["n_tokens"] == len(x) and made[d]["ids_crc32"] == unigram.crc32(x) for d, x in known.items())
    assert unigram.encode(empty(spark), PIECES).count() == 0


def fewest_pieces(text, pieces, byte_ids, longest):
    """Plain DP over a whole text: fewest pieces, then the greatest sum of scores, then the longer last piece. An unknown
    character counts as five pieces, as the model's does, and comes out as its bytes."""
    if not text:
        return []
    text = unigram.SPACE + text.replace(" ", unigram.SPACE)
    best = [(0, 0)] + [None] * len(text)
    last = [None] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for size in range(1, min(longest, end) + 1):
            i = pieces.get(text[end - size : end])
            if i is None:
                continue
            n, s = best[end - size]
            got = (n + 1, s - i[1])
            if best[end] is None or got <= best[end]:
                best[end], last[end] = got, (size, i[0])
        if best[end] is None:
            best[end], last[end] = (best[end - 1][0] + 5, best[end - 1][1]), (1, None)
    out, end = [], len(text)
    while end:
        size, i = last[end]
        out += [i] if i is not None else [byte_ids[b] for b in reversed(text[end - 1].encode())]
        end -= size
    return out[::-1]


def registered_pieces():
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    with open(PIECES, "rb") as f:
        spec.ParseFromString(f.read())
    normal = {p.piece: (i, max(p.score, -unigram.LAST_MERGE)) for i, p in enumerate(spec.pieces) if p.type == 1}
    return normal, {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == 6}


def test_registered_model_against_all_segmentations():
    pieces, byte_ids = registered_pieces()
    longest, m = max(map(len, pieces)), unigram.Model(PIECES)
    rng = random.Random(9)
    texts = [t[:400] for t in ODD] + ["".join(rng.choice("ab cdthe \né😀▁  the ing") for _ in range(rng.randint(1, 80))) for _ in range(400)]
    for t in texts:
        assert m.encode(t) == fewest_pieces(t, pieces, byte_ids, longest), t


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_op4_against_all_segmentations_of_documents(spark):
    pieces, byte_ids = registered_pieces()
    longest = max(map(len, pieces))
    got = {r["doc_id"]: r for r in queries()["op4_sentencepiece"](spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs[::5]:
        ids = fewest_pieces(r["text"] or "", pieces, byte_ids, longest)
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_crc32"]) == (len(ids), unigram.crc32(ids))


def test_a_text_of_megabytes(spark):
    text = "the cat sat on the mat, été. " * 60_000 + "x" * 300_000
    made = unigram.round_trip(spark.createDataFrame([(1, text)], "doc_id long, text string"), PIECES).first()
    assert made["decoded"] == text and made["n_tokens"] < len(text) / 2


def test_user_defined_pieces_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    with open(PIECES, "rb") as f:
        spec.ParseFromString(f.read())
    spec.pieces[300].type = 4
    path = tmp_path / "user.model"
    path.write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError, match="user-defined"):
        unigram.Model(str(path))
