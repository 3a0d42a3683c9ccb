"""Scores of texts by context-tree weighting over bytes, beside an add-one unigram model of their tokens.

Each byte is eight binary decisions. A decision (the bits of the byte before it) has a tree of contexts: no byte, the last
byte, the last two, up to ``depth``. A node estimates a bit by Krichevsky-Trofimov from the zeros and ones that training texts
have there, and weighs its own estimate against that of its children by half and half; so the probability of the training
bits is a mixture over all ways to prune the tree. What a node predicts then is the mixture over all depths on the path.

All of it is counts of (depth + 1)-grams of bytes, so the trees are tables: one aggregation a level gives the weights from the
leaves up, one equality join a level the predictions from the root down. Nothing is capped: the tables grow with the
corpus, and no task holds them whole. Texts are dealt to parts of bounded size; a part counts its distinct grams and words
once, and gets only what it needs of the model back, beside its texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, id_text, materialize, slices

#: Stands before a text, as often as contexts are deep, and once behind it. UTF-8 has no such byte.
EDGE = b"\xff"
#: The token that ends each text: no word has a space.
END = b" "
#: Bytes of text in a part, about; parts at least.
PART_BYTES, LEAST_PARTS = 48_000_000, 8
LN2 = math.log(2.0)


def lower_ascii(text: str) -> bytes:
    return text.encode().lower()  # of bytes: A-Z alone


class Grams:
    """The (depth + 1)-grams of texts that end at each of their bytes and at their end, packed in 64 bits, oldest byte first.
    ``first[d]:first[d + 1]`` are those of text d."""

    def __init__(self, texts: list[bytes], depth: int):
        pad = EDGE * depth
        raw = np.frombuffer(pad + pad.join(texts) + pad, np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        packed = np.zeros(len(raw) - depth, np.int64)
        for k in range(depth + 1):
            packed <<= 8
            packed |= raw[k : len(raw) - depth + k]
        # between two texts stand depth edges: the first ends the one, grams that end at the others are nobody's
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        begin = np.cumsum(np.concatenate(([0], sizes[:-1] + depth - 1)))
        self.packed = packed[np.repeat(begin - self.first[:-1], sizes) + np.arange(int(sizes.sum()))]


def add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[new], np.add.reduceat(c, new)


def counted(dealt: DataFrame, depth: int) -> DataFrame:
    """(part, gram, word, c): how often each distinct gram (word null) and token (gram null) of a part stands in its training
    texts; 0 where only texts that are held out have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: int | None = None
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        words: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            if not keys:
                return
            k, c = add_up(keys, counts)
            for i in range(0, len(k), 100_000):
                some = k[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), part), pa.int32()), pa.array(some), pa.nulls(len(some), pa.binary()), pa.array(c[i : i + 100_000])], names=["part", "gram", "word", "c"])
            w = list(words)
            for i in range(0, len(w), 20_000):
                some = w[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(some), pa.int32()), pa.nulls(len(some), pa.int64()), pa.array(some, pa.binary()), pa.array([words[x] for x in some], pa.int64())], names=["part", "gram", "word", "c"])
            keys.clear(), counts.clear(), words.clear()

        for batch in batches:
            for rows in slices(batch, 2_000_000):
                got = {n: rows.column(i).to_pylist() for i, n in enumerate(rows.schema.names)}
                edge = [0, *(i for i in range(1, rows.num_rows) if got["part"][i] != got["part"][i - 1]), rows.num_rows]
                for a, b in zip(edge, edge[1:], strict=False):
                    if got["part"][a] != part:
                        yield from flush()
                        part = got["part"][a]
                    for held in (False, True):
                        texts = [lower_ascii(t) for t, h in zip(got["text"][a:b], got["held_out"][a:b], strict=True) if h == held]
                        if not texts:
                            continue
                        k, c = np.unique(Grams(texts, depth).packed, return_counts=True)
                        keys.append(k)
                        counts.append(c * (not held))
                        for t in texts:
                            for w in (*t.split(), END):
                                words[w] += not held
                    if len(keys) > 1 and sum(map(len, keys)) > max(4_000_000, 2 * len(keys[0])):
                        k, c = add_up(keys, counts)
                        keys[:], counts[:] = [k], [c]
        yield from flush()

    return dealt.select("part", "held_out", "text").mapInArrow(run, "part int, gram long, word binary, c long")


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of x >= 0.5, by Stirling's series eight steps further on."""
    y = x + 8.0
    product = x
    for k in range(1, 8):
        product = product * (x + float(k))
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0))) + 1 / (1188 * F.pow(y, F.lit(9.0)))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(product)


def log_kt(a: Column, b: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of any one sequence of a zeros and b ones."""
    x, y = a.cast("double"), b.cast("double")
    return log_gamma(x + 0.5) + log_gamma(y + 0.5) - math.log(math.pi) - log_gamma(x + y + 1.0)


def log_add(x: Column, y: Column) -> Column:
    return F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y)))


def bits(gram: Column) -> Column:
    """The eight decisions of a gram's last byte: ``at``, its context bytes over the bits so far with a leading one; ``bit``."""
    symbol, context = gram.bitwiseAND(255), F.shiftright(gram, 8)
    each = [F.struct(F.shiftleft(context, 8).bitwiseOR(F.shiftright(symbol, 8 - k).bitwiseOR(1 << k)).alias("at"), F.shiftright(symbol, 7 - k).bitwiseAND(1).cast("int").alias("bit")) for k in range(8)]
    return F.explode(F.array(*each))


def trees(grams: DataFrame, depth: int) -> list[DataFrame]:
    """For each depth from 0 on the nodes that occur: at (low ``8 depth + 8`` bits), zeros a, ones b, ``stop``: the weight of the node's own
    estimate against its children's after training."""
    leaf = grams.select(bits(F.col("gram")).alias("x"), "c").groupBy(F.col("x.at").alias("at")).agg(F.sum(F.when(F.col("x.bit") == 0, F.col("c")).otherwise(0)).alias("a"), F.sum(F.when(F.col("x.bit") == 1, F.col("c")).otherwise(0)).alias("b"))
    level = materialize(leaf.withColumn("all", log_kt(F.col("a"), F.col("b"))).withColumn("stop", F.lit(1.0)))
    out = [level]
    for d in range(depth - 1, -1, -1):
        up = level.groupBy(F.col("at").bitwiseAND((1 << (8 * d + 8)) - 1).alias("at")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("all").alias("kids"))
        up = up.withColumn("own", log_kt(F.col("a"), F.col("b"))).withColumn("all", log_add(F.col("own"), F.col("kids")) - LN2)
        level = materialize(up.select("at", "a", "b", "all", F.exp(F.col("own") - LN2 - F.col("all")).alias("stop")))
        out.append(level)
    return out[::-1]


def predictions(levels: list[DataFrame], depth: int) -> DataFrame:
    """(at, p): at each deepest node the probability of a one, mixed over all depths on its path."""
    one = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1.0)
    path = levels[0].select("at", (F.col("stop") * one).alias("mixed"), (1 - F.col("stop")).alias("left"))
    for d in range(1, depth + 1):
        above = path.select(F.col("at").alias("up"), F.col("mixed").alias("m"), F.col("left").alias("l"))
        here = levels[d].withColumn("up", F.col("at").bitwiseAND((1 << (8 * d)) - 1))
        # contexts of up to one byte have some 65,000 nodes at most, whatever the corpus
        path = here.join(F.broadcast(above) if d <= 2 else shuffled(above), "up").select("at", (F.col("m") + F.col("l") * F.col("stop") * one).alias("mixed"), (F.col("l") * (1 - F.col("stop"))).alias("left"))
    return path.select("at", F.col("mixed").alias("p"))


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that both sides are shuffled for. Spark takes a table for as large as its compressed files, also behind an explode, and
    would send one that grows with the corpus to the driver and to all executors."""
    return df.hint("merge")


def gram_scores(grams: DataFrame, depth: int) -> DataFrame:
    """(gram, score): log10 of the probability of each gram's last byte after the others."""
    levels = trees(grams, depth)
    made = grams.select("gram", bits(F.col("gram")).alias("x")).select("gram", "x.at", "x.bit").join(shuffled(predictions(levels, depth)), "at")
    out = materialize(made.groupBy("gram").agg(F.sum(F.log10(F.when(F.col("bit") == 1, F.col("p")).otherwise(1 - F.col("p")))).alias("score")))
    drop(*levels)
    return out


def packed(rows: DataFrame, kind: int, key: str, value: str) -> DataFrame:
    """Rows (part, key, value) as (part, kind, and the columns that ``key`` and ``value`` name as arrays), many in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            t = t.take(pc.sort_indices(t.column(0))).combine_chunks()
            held.clear()
            part = np.asarray(t.column(0))
            edge = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)])).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(edge), t.column(i).chunk(0)) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]], pa.int32()), *lists], names=["part", key, value])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= 500_000:
                yield from out()
        if held:
            yield from out()

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, f"part int, {key} array<{types[rows.columns[1]]}>, {value} array<{types[rows.columns[2]]}>").withColumn("kind", F.lit(kind))


def score_texts(docs: DataFrame, held_out: Column | None = None, depth: int = 5, part_bytes: int = PART_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    A-Z is lower-cased; tokens are words ``[^\\x20\\x09-\\x0D]+`` and one end. The rows for which ``held_out``, a condition on
    doc_id, does not hold are learned from, all of them; without one, ids whose crc32 as text is 2 modulo 7 are held out.
    ``score``: log10 of the model's probability of the text's bytes and its end, contexts of up to ``depth`` (1 to 6) bytes,
    before the text its beginning. ``bits_per_byte``: the same as a code length, over the bytes and the end.
    ``base_score``: sum of log10((c + 1) / (N + V + 1)) over the tokens, c their count, N all and V distinct ones in the training texts;
    ``n_known``: tokens with c > 0; ``train_tokens``: N.

    A null or empty text is one end. A null id counts as an empty one and is learned from. Without any training text c, N and V
    are 0 and every bit has probability 1/2. Rows that repeat are learned from and returned as often as they stand; a very
    long text is part of one task; an empty table gives no rows; other columns of ``docs`` are not read.
    """
    if not 1 <= depth <= 6:
        raise ValueError("depth must be 1 to 6")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) == 2 if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = id_text(docs, id_col, text_col).withColumn("held_out", held)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST_PARTS, -(-size // part_bytes))
    # equal rows stay together at most as often as they stand; the hash of id and text spreads hot sources and copies
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int"))
    seen = materialize(counted(dealt.repartitionById(parts, "part").sortWithinPartitions("part"), depth))
    grams = materialize(seen.where("gram is not null").groupBy("gram").agg(F.sum("c").alias("c")))
    scores = gram_scores(grams, depth)
    tokens = materialize(seen.where("word is not null").groupBy("word").agg(F.sum("c").alias("c")))
    n, v = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    mine = seen.where("gram is not null").select("part", "gram").join(shuffled(scores), "gram").select("part", "gram", "score")
    words = seen.where("word is not null").select("part", "word").join(shuffled(tokens), "word").select("part", "word", "c")
    models = packed(mine, 0, "grams", "scores").unionByName(packed(words, 1, "words", "counts"), allowMissingColumns=True)
    both = models.unionByName(dealt.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    names = ["part", "kind", "grams", "scores", "words", "counts", "doc_id", "held_out", "text"]
    both = both.select(*names).repartitionById(parts, "part").sortWithinPartitions("part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        part: int | None = None
        keys: list[np.ndarray] = []
        values: list[np.ndarray] = []
        counts: dict[bytes, int] = {}
        index = score = None
        for batch in batches:
            col = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
            many, kinds = np.asarray(col["part"]), np.asarray(col["kind"])
            edge = np.concatenate(([0], np.flatnonzero((many[1:] != many[:-1]) | (kinds[1:] != kinds[:-1])) + 1, [len(many)]))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if many[a] != part:
                    part, keys, values, counts, index = many[a], [], [], {}, None
                cut = {k: c.slice(a, b - a) for k, c in col.items()}
                if kinds[a] == 0:
                    keys.append(np.asarray(cut["grams"].flatten()))
                    values.append(np.asarray(cut["scores"].flatten()))
                elif kinds[a] == 1:
                    counts.update(zip(cut["words"].flatten().to_pylist(), cut["counts"].flatten().to_pylist(), strict=True))
                else:
                    if index is None:
                        index, score = pd.Index(np.concatenate(keys)), np.concatenate(values)
                        keys, values = [], []
                    for some in slices(pa.RecordBatch.from_arrays([cut[k] for k in ("doc_id", "held_out", "text")], names=["doc_id", "held_out", "text"]), 1_000_000):
                        texts = [lower_ascii(t) for t in some.column(2).to_pylist()]
                        g = Grams(texts, depth)
                        at = index.get_indexer(g.packed)
                        if (at < 0).any():
                            raise RuntimeError("a gram of a part is missing from its model")
                        total = np.add.reduceat(score[at], g.first[:-1])
                        each = [np.array([counts[w] for w in (*t.split(), END)], np.int64) for t in texts]
                        yield pa.RecordBatch.from_arrays(
                            [
                                some.column(0),
                                some.column(1),
                                pa.array([len(c) for c in each], pa.int64()),
                                pa.array([int((c > 0).sum()) for c in each], pa.int64()),
                                pa.array(np.full(len(texts), n), pa.int64()),
                                pa.array([float(np.log10((c + 1) / (n + v + 1)).sum()) for c in each]),
                                pa.array(total),
                                pa.array(-total * math.log2(10) / np.diff(g.first)),
                            ],
                            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
                        )

    return both.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
