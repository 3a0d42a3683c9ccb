"""Small helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import drop
from ..scratch import kept as materialize

__all__ = ["drop", "materialize"]

#: Words of marked(), 64 bits each: 1 MB.
MARK_WORDS = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names: other columns of ``docs`` cannot clash. A null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def map_texts(df: DataFrame, fn: Callable[[list], Iterator[dict] | dict], schema: str, max_bytes: int = 4_000_000) -> DataFrame:
    """``fn`` maps a dict of column lists (about ``max_bytes`` of text, one row at least) to a dict of output columns."""
    out = df.sparkSession.createDataFrame([], schema).schema
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in batches:
            for part in slices(batch, max_bytes):
                made = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(made[n], type=arrow.field(n).type, from_pandas=False) for n in names], schema=arrow)

    return df.mapInArrow(run, out)


def slices(batch: pa.RecordBatch, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about ``max_bytes``; a longer row stands alone."""
    rows = batch.num_rows
    if rows == 0:
        return
    i = batch.schema.get_field_index("text")
    if i < 0:
        yield batch
        return
    sizes = [len(x or "") for x in batch.column(i).to_pylist()]
    start = held = 0
    for k, n in enumerate(sizes):
        if held and held + n > max_bytes:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n + 64
    yield batch.slice(start)


def apart(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with its whole-number keys computed anew. An aggregate joined back on its own keys would share their shuffle
    with the other side, and Spark cannot split a hot key there; after this, both sides have shuffles of their own."""
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0).cast(df.schema[k].dataType)) for k in keys})


def marked(rows: DataFrame, some: DataFrame, key: str, words: int = MARK_WORDS) -> DataFrame:
    """``rows`` with ``maybe``: false only where ``some`` has no row of that whole-number key. So rows with long texts need not be shuffled to
    learn that they have no partner; the others are to be joined as ever.

    A bit stands for the keys of one hash: 64 bits a word and ``words`` words at most, whatever ``some`` has, so the broadcast is bounded.
    With more keys more bits are set and more rows are joined, none is lost.
    """
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(64 * words))
    word, bit = (lambda c: F.floor(place(c) / 64)), (lambda c: (place(c) % 64).cast("int"))
    bits = some.groupBy(word(F.col(key)).alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col(key)))).alias("__bits"))
    made = rows.withColumn("__word", word(F.col(key))).join(F.broadcast(bits), "__word", "left")
    return made.withColumn("maybe", F.coalesce(F.getbit("__bits", bit(F.col(key))) == 1, F.lit(False))).select(*rows.columns, "maybe")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, component), component the smallest node.

    Alternates the two star contractions until nothing changes; every round is a few joins and min() aggregations,
    which Spark combines before the shuffle. Nodes without links do not appear. No cross products, nothing collected.
    """
    edges = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(apart(low, "u"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(apart(low2, "u"), "u").select(F.col("v").alias("x"), F.col("u"), F.col("m"))
        small = small.select(F.explode(F.array(F.struct(F.col("x").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        before, edges = edges, materialize(small.select("e.u", "e.v").where("u <> v").distinct())
        drop(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def in_block_pairs(rows: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Deals the rows of each key to groups in which every two of its rows meet at least once.

    Rows fall into blocks of about ``block`` by their id; a group is a pair of blocks (u, v), ``mine`` a row's own. A key
    with few rows is one group; a hot one is spread over many tasks, none with more than about two blocks. 
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1")
    cut = rows.join(apart(sizes, *keys), keys).withColumn("__blocks", F.ceil(F.col("__n") / block).cast("int"))
    cut = cut.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("__blocks")).cast("int")).drop("__n")
    cut = cut.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    cut = cut.withColumns({"u": F.least("mine", "__other"), "v": F.greatest("mine", "__other")}).drop("__blocks", "__other")
    return cut


def in_unlike_pairs(rows: DataFrame, key: str, block: int) -> DataFrame:
    """Deals rows (key, id, component, top) to groups in which every two rows of a key that differ in their component meet at least once.

    ``top`` is one component of the key, its largest. Its rows need not meet each other: they are cut into blocks, and each block meets the
    blocks of the others. So a large component with a few strays comes out about once, not once for each of its blocks. The others meet
    each other as in in_block_pairs(). Groups of the first kind have v < 0.
    """
    large = F.col("component") == F.col("top")
    sizes = rows.groupBy(key).agg(F.ceil(F.count_if(large) / block).cast("int").alias("__large"), F.ceil(F.count_if(~large) / block).cast("int").alias("__rest")).where("__rest > 0")
    cut = rows.join(apart(sizes, key), key).withColumns({"__own": F.pmod(F.xxhash64("id"), F.when(large, F.col("__large")).otherwise(F.col("__rest"))).cast("int"), "__large_side": large})
    cut = cut.withColumn("__other", F.explode(F.sequence(F.lit(0), F.when(large, F.col("__rest")).otherwise(F.col("__large")) - 1)))
    u, v = F.when(F.col("__large_side"), F.col("__own")).otherwise(F.col("__other")), -1 - F.when(F.col("__large_side"), F.col("__other")).otherwise(F.col("__own"))
    cross = cut.select(key, "id", "component", F.when(F.col("__large_side"), u).otherwise(v).alias("mine"), u.alias("u"), v.alias("v"))
    return cross.unionByName(in_block_pairs(rows.where(~large).select(key, "id", "component"), [key], block).select(*cross.columns))


def map_groups(dealt: DataFrame, keys: list[str], fn: Callable[[pa.Table], dict | None], schema: str) -> DataFrame:
    """``fn`` maps each group of in_block_pairs(), a table of two rows at least, to a dict of columns or None."""
    names = [*keys, "u", "v"]
    dealt = dealt.repartition(*names).sortWithinPartitions(*names)
    out = dealt.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        held: pa.Table | None = None

        def groups(table: pa.Table, last: bool) -> Iterator[dict]:
            """All groups that end in ``table``; the rows of its last one, which may go on, are held back."""
            nonlocal held
            key = np.stack([np.array(table.column(k)).astype(np.int64) for k in names], 1)
            edge = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]))
            stop = len(edge) - (1 if last else 2)
            for a, b in zip(edge[:stop], edge[1 : stop + 1], strict=True):
                if b - a > 1 and (made := fn(table.slice(a, b - a))):
                    yield made
            held = None if last else table.slice(edge[stop])

        def packed(made: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([m[f.name] for m in made]), f.type) for f in arrow], schema=arrow)

        for batch in batches:
            new = pa.Table.from_batches([batch])
            if made := list(groups(new if held is None else pa.concat_tables([held, new]), False)):
                yield packed(made)
        if held is not None and (made := list(groups(held, True))):
            yield packed(made)

    return dealt.mapInArrow(run, out)


def group_components(hit: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that links reach within a group."""
    low = ids.copy()
    some = np.flatnonzero(hit.any(axis=1))
    while True:
        new = low.copy()
        for i in some:
            new[i] = min(low[i], low[hit[i]].min())
        if (new == low).all():
            return low
        low = new


def cross_only(hit: np.ndarray, table: pa.Table) -> np.ndarray:
    """Of a group's links those between its two blocks, or all of them in a group of one block; none of a row with itself."""
    np.fill_diagonal(hit, False)
    if table.column("u")[0] != table.column("v")[0]:
        mine = np.array(table.column("mine"))
        hit &= mine[:, None] != mine[None, :]
    return hit


def links_in_buckets(buckets: DataFrame, items_of: Callable[[DataFrame], DataFrame], pair: Column, hits: Callable[[pa.Table], np.ndarray], block: int = 512) -> DataFrame:
    """Links (a, b) whose components are those of all links between members of a bucket (bucket, id).

    ``items_of`` gets the ids that have a partner (doc_id) and gives (id, items); ``pair`` says from columns x and y, two
    rows' items, whether they link; ``hits`` does the same for all rows of a group at once. No member is paired with all
    others as rows: first each is checked against the smallest of its buckets' leaders (a bucket's smallest id), then against
    those of the others that it does not share a component with by then. That settles all buckets whose
    members then share a component. In the others, those outside the largest component ask one more member of it; then the members
    (less the leader, whose links are known) of unlike components are compared in blocks inside tasks, so no link is missed, and each
    component comes out with the smallest one that it reaches there.
    """
    heads = buckets.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last")
    members = materialize(buckets.join(apart(heads.drop("last"), "bucket"), "bucket").distinct())
    items = materialize(items_of(members.select(F.col("id").alias("doc_id")).distinct()))
    asks = materialize(members.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct())

    def linked_pairs(asked: DataFrame, *carried: str) -> DataFrame:
        both = asked.join(items.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(items.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
        return materialize(both.where(pair).select("a", "b", *carried))

    least = materialize(asks.groupBy("a").agg(F.min("b").alias("b")))
    links = linked_pairs(least)
    early = materialize(components(links))
    of = lambda k: early.select(F.col("node").alias(k), F.col("component").alias(f"of_{k}"))
    others = asks.join(least, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left").withColumns({k: F.coalesce(k, k[-1]) for k in ("of_a", "of_b")})
    # what links across components joins these, not their members
    across = linked_pairs(others.where("of_a <> of_b"), "of_a", "of_b")
    joined = materialize(components(across.select("of_a", "of_b").distinct(), "of_a", "of_b"))
    over = joined.select(F.col("node").alias("component"), F.col("component").alias("top"))
    label = early.join(over, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    label = materialize(label.unionByName(joined.join(early, "node", "left_anti")))
    drop(asks, least, links, early, across, joined)
    mine = label.select(F.col("node").alias("id"), F.col("component").alias("x"))
    theirs = label.select(F.col("node").alias("leader"), F.col("component").alias("y"))
    rest = members.where("id <> leader").join(mine, "id", "left").join(theirs, "leader", "left")
    rest = rest.select("bucket", "id", F.coalesce("x", "id").alias("component"), (F.coalesce("x", "id") != F.coalesce("y", "leader")).alias("apart"))
    # buckets with the same members need one comparison
    open_ = rest.groupBy("bucket").agg(F.max("apart").alias("apart"), F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum")).where("apart and n > 1")
    open_ = open_.groupBy("n", "sum").agg(F.min("bucket").alias("bucket")).select("bucket")
    left = materialize(rest.select("bucket", "id", "component").join(open_, "bucket"))
    # the others of a bucket ask one member of its largest component, another one in each bucket: near copies that the leader is a bit
    # too far from join here, and their buckets with them
    sizes = left.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.min_by("id", F.xxhash64("id", "bucket")).alias("pick"))
    largest = sizes.groupBy("bucket").agg(F.max_by(F.struct("component", "pick"), F.struct("n", -F.col("component"))).alias("most")).select("bucket", F.col("most.component").alias("top"), F.col("most.pick").alias("pick"))
    ranked = materialize(left.join(apart(largest, "bucket"), "bucket"))
    again = linked_pairs(ranked.where("component <> top").select(F.col("id").alias("a"), F.col("pick").alias("b"), F.col("component").alias("of_a"), F.col("top").alias("of_b")).distinct(), "of_a", "of_b")
    late = materialize(components(again.select("of_a", "of_b").distinct(), "of_a", "of_b"))
    newer = lambda k: late.select(F.col("node").alias(k), F.col("component").alias(f"__{k}"))
    now = ranked.drop("pick").join(newer("component"), "component", "left").join(newer("top"), "top", "left")
    now = materialize(now.select("bucket", "id", F.coalesce("__component", "component").alias("component"), F.coalesce("__top", "top").alias("top")))
    dealt = in_unlike_pairs(now, "bucket", block).join(items, "id")

    def linked(table: pa.Table) -> dict | None:
        hit = cross_only(hits(table), table)
        some = np.flatnonzero(hit.any(axis=1))
        if not len(some):
            return None
        # of links inside a component nothing comes out: copies that are one already do not leave a row for each group
        own = np.array(table.column("component"))[some]
        new = np.stack([own, group_components(hit[np.ix_(some, some)], own)], 1)
        new = np.unique(new[new[:, 0] != new[:, 1]], axis=0)
        return {"a": new[:, 0], "b": new[:, 1]} if len(new) else None

    more = map_groups(dealt, ["bucket"], linked, "a long, b long")
    stars = label.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    joined_late = late.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    out = materialize(stars.unionByName(joined_late).unionByName(more).distinct())
    drop(members, items, label, left, ranked, again, late, now)
    return out
