"""Running totals, last entries and carried values of keys that may be hot.

A window over all rows of a key is one task's work; a key with a third of all rows would wait for one machine. Here time
is cut into cells of about equal numbers of rows, and each (key, cell) is a task's work of its own: what lies in the cell
comes from a window inside it, what lies before it from a state for each (key, cell), a few numbers or entries, which are
carried along the cells of a key. Rows of one moment always share a cell, so "strictly before" stays exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..scratch import kept

#: Rows of all keys together that a cell of time has, about; what a hot key can put into one task.
CELL_ROWS = 1_000_000
#: Cells at most: their bounds are numbers on the driver.
MOST_CELLS = 4096
CELL = "__cell"


def cuts(rows: DataFrame, time: str = "t", keys: Sequence[str] | None = None, size: int | None = None) -> list[float]:
    """The moments at which cells of ``size`` rows begin, none for a table of one cell. With ``keys`` also none if no key has more rows
    than that: then a plain window is nobody's whole work. Results do not depend on where they lie."""
    size = size or CELL_ROWS
    if keys is None:
        n = most = rows.count()
    else:
        n, most = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    cells = min(MOST_CELLS, -(-n // size))
    if cells < 2 or most <= size:
        return []
    at = rows.agg(F.percentile_approx(time, [k / cells for k in range(1, cells)], 4 * MOST_CELLS)).first()[0]
    return sorted({float(v) for v in at or []})


def in_cells(rows: DataFrame, at: Sequence[float], time: str = "t") -> DataFrame:
    """``rows`` with the number of the cell in CELL; null times have one of their own."""
    if not at:
        return rows.withColumn(CELL, F.lit(0.0))
    splits = [float("-inf"), *at, float("inf")]
    made = Bucketizer(splits=splits, inputCol="__time", outputCol=CELL, handleInvalid="keep").transform(rows.withColumn("__time", F.col(time).cast("double")))
    return made.drop("__time")


def held(rows: DataFrame, at: Sequence[float], time: str = "t") -> DataFrame:
    """in_cells(), written first where there are cells: their rows are read for themselves and again for the states before them."""
    cells = in_cells(rows, at, time)
    return kept(cells) if at else cells


def _within(keys: Sequence[str], at: Sequence[float]) -> WindowSpec:
    """What a window runs in: a key, or its cell where there are cells."""
    return Window.partitionBy(*keys, *([CELL] if at or not keys else []))


def joined(rows: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys and cell in which nulls are equal, as in windows. ``state`` has one row for each."""
    on = [*keys, CELL]
    there = state.withColumnsRenamed({k: f"__s_{i}" for i, k in enumerate(on)})
    cond = None
    for i, k in enumerate(on):
        one = rows[k].eqNullSafe(there[f"__s_{i}"])
        cond = one if cond is None else cond & one
    return rows.join(there, cond, "left").drop(*[f"__s_{i}" for i in range(len(on))])


def added(a: Column, b: Column) -> Column:
    """The sum of two sums; null only if both are (there was nothing to add)."""
    return F.coalesce(a + b, a, b)


def prior(rows: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], greatest: Mapping[str, Column] | None = None, time: str = "t", at: Sequence[float] | None = None) -> DataFrame:
    """``rows`` with, for each name in ``sums`` and ``greatest``, the sum or the greatest of a column over the key's rows strictly
    before the row's moment; null where there is none. Null values do not count. ``at``: cuts(), if they are known."""
    greatest = greatest or {}
    at = cuts(rows, time, keys) if at is None else at
    inputs = {f"__in_{k}": v for k, v in {**sums, **greatest}.items()}
    cells = held(rows.withColumns(inputs), at, time)
    w = _within(keys, at).orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    own = cells.withColumns({k: F.sum(f"__in_{k}").over(w) for k in sums} | {k: F.max(f"__in_{k}").over(w) for k in greatest}).drop(*inputs)
    if not at:
        return own.drop(CELL)
    totals = cells.groupBy(*keys, CELL).agg(*[F.sum(f"__in_{k}").alias(f"__in_{k}") for k in sums], *[F.max(f"__in_{k}").alias(f"__in_{k}") for k in greatest])
    v = Window.partitionBy(*keys).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    state = totals.select(*keys, CELL, *[F.sum(f"__in_{k}").over(v).alias(f"__in_{k}") for k in sums], *[F.max(f"__in_{k}").over(v).alias(f"__in_{k}") for k in greatest])
    both = joined(own, state, keys)
    done = {k: added(F.col(k), F.col(f"__in_{k}")) for k in sums} | {k: F.greatest(k, f"__in_{k}") for k in greatest}
    return both.withColumns(done).drop(*inputs, CELL)


def counted_since(rows: DataFrame, keys: Sequence[str], since: int, name: str, time: str = "t", at: Sequence[float] | None = None) -> DataFrame:
    """``rows`` with ``name``: how many rows of the key lie in [moment - since, moment)."""
    at = cuts(rows, time, keys) if at is None else at
    if not at:
        w = Window.partitionBy(*keys).orderBy(time).rangeBetween(-since, -1)
        return rows.withColumn(name, F.count("*").over(w))
    rows = kept(rows)
    # what lies before the moment less what lies before the moment it looks back to, both from one prefix pass over moments
    moments = rows.groupBy(*keys, time).agg(F.count("*").alias("__c"))
    asked = moments.select(*keys, (F.col(time) - since).alias(time), F.col(time).alias("__for"), F.lit(0).cast("long").alias("__c"), F.lit(-1).alias("__sign"))
    both = moments.select(*keys, time, F.col(time).alias("__for"), "__c", F.lit(1).alias("__sign")).unionByName(asked)
    made = prior(both, keys, {"__n": F.col("__c")}, time=time, at=at)
    made = made.groupBy(*keys, F.col("__for").alias(time)).agg(F.sum(F.col("__sign") * F.coalesce("__n", F.lit(0))).alias(name))
    return joined(in_cells(rows, at, time), in_cells(made, at, time), [*keys, time]).drop(CELL)


def tails(batches: DataFrame, keys: Sequence[str], most: int, time: str = "t", at: Sequence[float] = ()) -> DataFrame:
    """(keys, time, recent) for batches (keys, time, batch: array of entries in order, perhaps empty): the last ``most`` entries
    strictly before each moment, oldest first, or fewer if there are fewer.

    No list is longer than ``most`` batches of ``most`` entries, however long a history is; batches without entries only ask.
    """
    kind = batches.schema["batch"].dataType.simpleString()
    none = F.array().cast(kind)
    last = lambda c: F.slice(c, F.greatest(F.size(c) - most + 1, F.lit(1)), most)
    cells = held(batches.withColumn("batch", F.when(F.size("batch") > 0, last(F.col("batch")))), at, time)
    inner = _within(keys, at).orderBy(time)
    if not at:
        # one window over all: places count the batches with entries, twice, so those without come after the batch they follow
        place = 2 * F.count("batch").over(inner.rowsBetween(Window.unboundedPreceding, 0)) + F.col("batch").isNull().cast("int")
        near = Window.partitionBy(*keys).orderBy("__place").rangeBetween(-2 * most, -1)
        return cells.withColumn("__place", place).select(*keys, time, last(F.flatten(F.collect_list("batch").over(near))).alias("recent"))
    # a running list over batches with entries only: those without pass it on
    some = cells.where("batch is not null")
    some = some.withColumn("upto", last(F.flatten(F.collect_list("batch").over(inner.rowsBetween(1 - most, 0)))))
    asks = cells.where("batch is null").withColumn("upto", F.lit(None).cast(kind))
    own = some.unionByName(asks).withColumn("recent", F.last("upto", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, -1)))
    ends = some.groupBy(*keys, CELL).agg(F.max_by("upto", time).alias("end"))
    # states of all cells in which something asks, so that cells without entries get what lies before them too
    every = cells.select(*keys, CELL).distinct()
    v = Window.partitionBy(*keys).orderBy(CELL)
    full = joined(every, ends, keys)
    filled = full.where("end is not null").withColumn("upto", last(F.flatten(F.collect_list("end").over(v.rowsBetween(1 - most, 0)))))
    filled = filled.unionByName(full.where("end is null").withColumn("upto", F.lit(None).cast(kind)))
    state = filled.select(*keys, CELL, F.last("upto", ignorenulls=True).over(v.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    both = joined(own, state, keys)
    return both.select(*keys, time, last(F.concat(F.coalesce("__before", none), F.coalesce("recent", none))).alias("recent"))


def carried(rows: DataFrame, keys: Sequence[str], entry: str, order: Sequence[Column | str], time: str = "t", at: Sequence[float] = ()) -> DataFrame:
    """``rows`` with ``last``: the last value of ``entry`` that is not null, up to and with each row in the order of time, then ``order``."""
    cells = held(rows, at, time)
    w = _within(keys, at).orderBy(time, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = cells.withColumn("last", F.last(entry, ignorenulls=True).over(w))
    if not at:
        return own.drop(CELL)
    some = F.struct(*[F.col(time), *[o if isinstance(o, Column) else F.col(o) for o in order]])
    ends = cells.groupBy(*keys, CELL).agg(F.max_by(F.col(entry), F.when(F.col(entry).isNotNull(), some)).alias("end"))
    v = Window.partitionBy(*keys).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    state = ends.select(*keys, CELL, F.last("end", ignorenulls=True).over(v).alias("__before"))
    return joined(own, state, keys).withColumn("last", F.coalesce("last", "__before")).drop(CELL, "__before")


def previous(rows: DataFrame, keys: Sequence[str], columns: Mapping[str, str], order: Sequence[str], time: str = "t", at: Sequence[float] = ()) -> DataFrame:
    """``rows`` with, for each (name, column), the column's value in the key's row before, in the order of time, then ``order``."""
    cells = held(rows, at, time)
    w = _within(keys, at).orderBy(time, *order)
    own = cells.withColumns({n: F.lag(c).over(w) for n, c in columns.items()} | {"__first": F.row_number().over(w) == 1})
    if not at:
        return own.drop(CELL, "__first")
    place = F.struct(time, *order)
    ends = cells.groupBy(*keys, CELL).agg(*[F.max_by(c, place).alias(f"__end_{n}") for n, c in columns.items()])
    v = Window.partitionBy(*keys).orderBy(CELL)
    state = ends.select(*keys, CELL, *[F.lag(f"__end_{n}").over(v).alias(f"__end_{n}") for n in columns])
    both = joined(own, state, keys)
    return both.withColumns({n: F.when(F.col("__first"), F.col(f"__end_{n}")).otherwise(F.col(n)) for n in columns}).drop(CELL, "__first", *[f"__end_{n}" for n in columns])


def running(rows: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], order: Sequence[str], time: str = "t", at: Sequence[float] = ()) -> DataFrame:
    """``rows`` with, for each name in ``sums``, the sum of a column up to and with the row, in the order of time, then ``order``."""
    inputs = {f"__in_{k}": v for k, v in sums.items()}
    cells = held(rows.withColumns(inputs), at, time)
    w = _within(keys, at).orderBy(time, *order).rowsBetween(Window.unboundedPreceding, 0)
    own = cells.withColumns({k: F.sum(f"__in_{k}").over(w) for k in sums}).drop(*inputs)
    if not at:
        return own.drop(CELL)
    v = Window.partitionBy(*keys).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    state = cells.groupBy(*keys, CELL).agg(*[F.sum(c).alias(c) for c in inputs]).select(*keys, CELL, *[F.sum(c).over(v).alias(c) for c in inputs])
    return joined(own, state, keys).withColumns({k: added(F.col(k), F.col(f"__in_{k}")) for k in sums}).drop(CELL, *inputs)
