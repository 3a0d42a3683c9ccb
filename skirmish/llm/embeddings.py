"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector passes it when their inner product exceeds a threshold. The directions are a product
code: the rotated space is cut into two halves, each with its own random code, and every pair of code words is a
direction. List decoding finds all directions that a vector exceeds without trying each: the scores of both halves are
sorted, and pairs are taken from the top while their sum exceeds the threshold. Vectors meet in the filters they share
and are verified by their cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cross_only, drop, group_components, in_block_pairs, map_groups, materialize

COSINE = 0.95
BLOCK = 512


def expected_filters(vectors: int) -> float:
    """How many filters a vector passes on average. As filters grow finer with the table, pairs at the limit share fewer of
    them; four for each power of ten keep the recall at a cosine of 0.95 above 0.99 up to 10**9 vectors of 64 dimensions
    (measured: tests, README)."""
    return max(12.0, 4 * float(np.log10(max(vectors, 1))))


class Codes:
    """The filters for one dimension: a random rotation, a code of ``size`` directions for each half, the threshold.

    The threshold is that which a random unit vector exceeds in about ``expected`` of the size**2 filters.
    """

    def __init__(self, dim: int, size: int, expected: float, least: int | None = None):
        from statistics import NormalDist

        rng = np.random.default_rng([dim, size])
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.half = max(1, dim // 2)
        self.size, self.least = size, round(expected) if least is None else least
        self.codes = []
        for width in (self.half, dim - self.half):
            c = rng.standard_normal((size, width))
            self.codes.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12) * np.sqrt(max(width, 1)))
        self.threshold = NormalDist().inv_cdf(1 - min(0.5, expected / size**2)) if dim > 1 else -np.inf

    def passed(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that unit vectors exceed, and of the ``least`` best ones of each whatever the score."""
        x = unit @ self.turn
        a, b = x[:, : self.half] @ self.codes[0].T, x[:, self.half :] @ self.codes[1].T
        ia, ib = np.argsort(-a, axis=1), np.argsort(-b, axis=1)
        a, b = np.take_along_axis(a, ia, 1), np.take_along_axis(b, ib, 1)
        k = min(self.least, self.size**2)
        # the k best sums are among the places (p, q) that at most k places dominate
        near = [(p, q) for p in range(min(k, self.size)) for q in range(min(k // (p + 1), self.size))]
        kth = np.sort(np.stack([a[:, p] + b[:, q] for p, q in near], 1), axis=1)[:, -k]
        least = np.minimum(self.threshold, kth)
        rows, filters = [], []
        live = np.arange(len(x))
        for p in range(self.size):
            live = live[a[live, p] + b[live, 0] >= least[live]]
            if not len(live):
                break
            now = live
            for q in range(self.size):
                now = now[a[now, p] + b[now, q] >= least[now]]
                if not len(now):
                    break
                rows.append(now)
                filters.append(ia[now, p] * self.size + ib[now, q])
        return np.concatenate(rows), np.concatenate(filters)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def code_size(vectors: int) -> int:
    """A power of two that keeps the mean number of vectors in a filter about the same at every size of the table."""
    return int(max(8, 2 ** round(np.log2(max(vectors, 1) ** 0.5 / 2))))


def filtered(reps: DataFrame, size: int, expected: float) -> DataFrame:
    """(dim, filter, id, weight, filters, vector): a row for each filter that a vector passes; filters holds them all."""
    kinds: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column("dim"))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                codes = kinds.get(dim) or kinds.setdefault(dim, Codes(int(dim), size, expected))
                rows_at_once = max(16, 2_000_000 // size)  # scores of all code words at once: bounded at every code size
                for start in range(0, part.num_rows, rows_at_once):
                    some = part.slice(start, rows_at_once)
                    x = matrix(some.column("vector"), int(dim))
                    row, filt = codes.passed(x / np.linalg.norm(x, axis=1, keepdims=True))
                    order = np.lexsort((filt, row))
                    row, filt = row[order], filt[order]
                    ends = np.searchsorted(row, np.arange(some.num_rows + 1))
                    lists = pa.array([filt[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.list_(pa.int64()))
                    take = pa.array(row)
                    yield pa.RecordBatch.from_pydict(
                        {"dim": some.column("dim").take(take), "filter": filt, "id": some.column("id").take(take), "weight": some.column("weight").take(take), "filters": lists.take(take), "vector": some.column("vector").take(take)}
                    )

    return reps.mapInArrow(run, f"dim int, filter long, id long, weight long, filters array<long>, vector {dict(reps.dtypes)['vector']}")


def first_met(hit: np.ndarray, filt: int, lists: list[np.ndarray]) -> np.ndarray:
    """The links of a group whose vectors have no smaller filter in common, so that each pair counts once."""
    if hit.any():
        early = [f[f < filt] for f in lists]
        names, at = np.unique(np.concatenate(early), return_inverse=True)
        if len(names):
            has = np.zeros((len(hit), len(names)), np.float32)
            has[np.repeat(np.arange(len(hit)), [len(e) for e in early]), at] = 1
            hit &= has @ has.T < 0.5
    return hit


def vector_links(rows: DataFrame, cosine: float, block: int) -> DataFrame:
    """(id, n, to): for a vector in a group, the weight of its new links there and the smallest id reached in the group.

    The vectors of a filter are dealt to blocks of about ``block``, and each pair of blocks is a group of its own: a
    filter that many vectors pass is spread over many tasks, and every pair of its vectors is compared all the same.
    """

    def linked(table: pa.Table) -> dict | None:
        x = matrix(table.column("vector").combine_chunks(), table.column("dim")[0].as_py())
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        lists = table.column("filters").combine_chunks()
        parts = np.split(np.array(lists.flatten()), np.cumsum(np.array(lists.value_lengths()))[:-1])
        hit = first_met(cross_only(x @ x.T >= cosine, table), table.column("filter")[0].as_py(), parts)
        some = np.flatnonzero(hit.any(axis=1))
        if not len(some):
            return None
        hit, ids = hit[np.ix_(some, some)], np.array(table.column("id"))[some]
        return {"id": ids, "n": hit @ np.array(table.column("weight"))[some], "to": group_components(hit, ids)}

    return map_groups(in_block_pairs(rows, ["dim", "filter"], block), ["dim", "filter"], linked, "id long, n long, to long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, expected: float | None = None, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    ``expected``: see expected_filters(). n_links counts the other vectors linked directly (cosine of ``cosine`` or more), component_id is the smallest vec_id
    that links reach. Equal vectors meet first, in a groupBy, and count with their number; vectors of different lengths
    never link. Null, empty and zero vectors and those with null or non-finite components link with nothing. Rows that
    repeat a vec_id and its vector count as copies of each other, as do rows with a null vec_id (kept null there). A cosine of
    exactly ``cosine`` links. Vectors of any length are read whole; other columns of ``vectors`` are not read. An empty table gives no rows.
    """
    x = F.col("vector")
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"))
    rows = rows.withColumn("key", F.when(good, F.sha2(F.concat_ws(",", F.transform(x, lambda v: (v + F.lit(0.0).cast(kind[6:-1])).cast("string"))), 256)))
    keyed = materialize(rows)
    reps = materialize(keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")))
    one = keyed.select(F.col("vec_id").alias("id"), "key", "vector").join(reps, ["id", "key"]).dropDuplicates(["id", "key"])
    n = reps.count()
    filters = materialize(filtered(one.select(F.size("vector").alias("dim"), "id", "weight", "vector"), code_size(n), expected or expected_filters(n)))
    links = materialize(vector_links(filters, cosine, block))
    drop(filters)
    counted = links.groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(links.select(F.col("id").alias("a"), F.col("to").alias("b")))
    of_key = reps.join(counted, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
    of_key = of_key.select("key", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = keyed.select("vec_id", "key").join(of_key, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
