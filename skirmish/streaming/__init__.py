"""The same semantics on Structured Streaming, whatever the order in which rows arrive.

A micro-batch is many files and one distributed job: it reads the states it needs, then writes what it adds, each into a folder
of its own number, so a batch that is run again writes the same once more. Nothing is dropped for being late. Late rows are put
aside and counted, and what they change is computed again from the last snapshot before them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import prefix, resume
from ..scratch import delete, drop, exists, kept, shared_dir

#: About so many rows a micro-batch when a table is fed as a stream, and files a micro-batch.
MICRO_BATCH, FILES = 1_000_000, 8


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by type in tumbling windows of event time, by Spark's own state: an event that comes twice counts once, one
    that comes later than ``late`` is not counted. WindowTotals counts those too."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


class Sink:
    """What micro-batches have in common: observations with keys and a time, of which each counts once."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], time: str):
        self.spark, self.path, self.keys, self.time = spark, path, list(keys), time
        #: Of tables that this object has written: Spark need not open files to learn them.
        self.schemas: dict[str, T.StructType] = {}

    def table(self, name: str, before: int | None = None) -> DataFrame | None:
        """All rows of a table, or those of the batches before one; None if there are none."""
        at = f"{self.path}/{name}"
        if not exists(self.spark, at):
            return None
        known = self.schemas.get(name)
        rows = (self.spark.read if known is None else self.spark.read.schema(known)).parquet(at)
        return rows if before is None else rows.where(F.col("batch") < before)

    def put(self, df: DataFrame, name: str, batch: int, *by: str) -> DataFrame:
        """Writes what a batch adds to a table, in place of what an earlier try of the same batch wrote."""
        at = f"{self.path}/{name}/batch={batch}"
        df.write.mode("overwrite").partitionBy(*by).parquet(at)
        self.schemas[name] = T.StructType([*(f for f in df.schema if f.name not in by), T.StructField("batch", T.IntegerType()), *(df.schema[b] for b in by)])
        return self.spark.read.schema(df.schema).parquet(at)

    def at_once(self, *writers: Callable[[], object]) -> None:
        """Runs what writes tables that do not read each other side by side."""
        own = inheritable_thread_target(self.spark)
        with ThreadPoolExecutor(len(writers)) as pool:
            for f in [pool.submit(own(w)) for w in writers]:
                f.result()

    def new(self, rows: DataFrame, batch: int, *counts: Column) -> tuple[DataFrame, dict]:
        """The observations of a batch that no batch before it has had, as a written table, and ``counts`` of them. What was seen is read only where its
        files' times overlap the batch's: a copy has its original's time."""
        rows = rows.dropDuplicates(self.keys)
        seen = self.table("seen", batch)
        if seen is not None:
            span = rows.agg(F.min(self.time).alias("low"), F.max(self.time).alias("high")).first()
            seen = seen.where(F.col(self.time).between(span["low"], span["high"])).select(*self.keys)
            rows = rows.join(seen, self.keys, "left_anti")
        if not counts:
            return self.put(rows, "seen", batch), {}
        counted = Observation()
        return self.put(rows.observe(counted, *counts), "seen", batch), counted.get

    def __call__(self, rows: DataFrame, batch: int) -> None:
        raise TypeError("a sink says what a batch adds")

    def run(self, stream: DataFrame) -> Sink:
        """Takes all that the stream's source has; progress lies beside the tables, so a later run goes on from there."""
        query = stream.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.path}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
        return self


class PriorCounts(Sink):
    """Matches and wins of a team strictly before each observation (match_id, side, team, t, win).

    Tables: ``seen``, all observations; ``frontier``, the greatest time after each batch; ``state``, the totals of each team at
    that frontier, as parts to be added up; ``late``, observations at or before the frontier of their arrival; ``out``, counts, of which
    the latest batch's holds.
    """

    COLUMNS = ["match_id", "side", "team", "t", "win"]

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, ["match_id", "side"], "t")
        #: What the table of frontiers holds, once it has been read.
        self.fronts: dict[int, int] | None = None

    def frontiers(self, before: int) -> list[tuple[int, int]]:
        """(t, batch) of the batches that moved the frontier: a number each."""
        if self.fronts is None:
            got = self.table("frontier")
            self.fronts = {r["batch"]: r["t"] for r in got.collect()} if got is not None else {}
        return sorted((t, b) for b, t in self.fronts.items() if b < before)

    def snapshot(self, upto: int | None, before: int) -> DataFrame:
        """The totals of all teams at the frontier of batch ``upto``, late rows of the batches before ``before`` among them."""
        state = self.table("state", before)
        if upto is None or state is None:
            return self.spark.createDataFrame([], "team long, n long, wins long, last_t long")
        rows = state.where(F.col("upto") == upto)
        return rows.groupBy("team").agg(F.sum("n").alias("n"), F.sum("wins").alias("wins"), F.max("last_t").alias("last_t"))

    def __call__(self, rows: DataFrame, batch: int) -> None:
        fronts = self.frontiers(batch)
        front = fronts[-1][0] if fronts else None
        late = F.lit(False) if front is None else F.col("t") <= front
        new, what = self.new(rows.select(*self.COLUMNS), batch, F.count_if(~late).alias("on"), F.count_if(late).alias("late"), F.min(F.when(late, F.col("t"))).alias("first"), F.max("t").alias("last"))
        parts, states, writers = [], [], []
        # on-time rows of a batch stand behind its late ones, which the state before it does not have
        held = self.snapshot(fronts[-1][1] if fronts else None, batch)
        if what["late"]:
            behind = self.put(new.where(late), "late", batch)
            # the last snapshot before all of them; what came after it, of their teams alone, is counted again from there
            older = [f for f in fronts if f[0] < what["first"]]
            since = older[-1] if older else None
            redo = self.table("seen", batch + 1).select(*self.COLUMNS).join(behind.select("team").distinct(), "team", "left_semi")
            redo = redo.where(F.col("t") > since[0]) if since else redo
            counted = Observation()
            redo = kept(redo.where(F.col("t") <= front).observe(counted, F.count(F.lit(1)).alias("n")))
            parts.append(resume.counts_from(self.snapshot(since[1] if since else None, batch), redo, "team", at=self.cells(redo, counted.get["n"])))
            # the snapshots after them get them too
            gets = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.lit(b).alias("upto")) for t, b in fronts if t >= what["first"]])
            each = behind.withColumn("s", F.explode(F.filter(gets, lambda f: f["t"] >= F.col("t")))).withColumn("upto", F.col("s.upto"))
            states.append(resume.totals(each, "upto", "team").select("team", "n", "wins", "last_t", "upto"))
            held = resume.merged(held, resume.totals(behind, "team"), "team")
        if what["on"]:
            fresh = new.where(~late)
            parts.append(resume.counts_from(held, fresh, "team", at=self.cells(fresh, what["on"])))
            states.append(resume.merged(held, resume.totals(fresh, "team"), "team").withColumn("upto", F.lit(batch)))
            self.fronts[batch] = last = int(what["last"])
            writers.append(lambda: self.put(self.spark.range(1).select(F.lit(last).cast("long").alias("t")), "frontier", batch))
        else:
            self.fronts.pop(batch, None)
        if parts:
            out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            writers.append(lambda: self.put(out.select("match_id", "side", "team", "t", "n_before", "wins_before"), "out", batch))
            state = states[0] if len(states) == 1 else states[0].unionByName(states[1])
            writers.append(lambda: self.put(state, "state", batch, "upto"))
            self.at_once(*writers)
        if what["late"]:
            drop(redo)

    def cells(self, rows: DataFrame, n: int) -> list[float]:
        """prefix.cuts() of rows whose number is known: no key of a few has more than a cell."""
        return [] if n <= prefix.CELL_ROWS else prefix.cuts(rows, keys=["team"])

    def result(self) -> DataFrame:
        """(match_id, side, n_before, wins_before) of all observations so far."""
        out = self.table("out")
        if out is None:
            return self.spark.createDataFrame([], "match_id long, side int, n_before long, wins_before long")
        newest = out.groupBy("match_id", "side").agg(F.max_by(F.struct("n_before", "wins_before"), "batch").alias("c"))
        return newest.select("match_id", "side", "c.n_before", "c.wins_before")

    def late(self) -> DataFrame:
        """Late observations and the batch they came with."""
        got = self.table("late")
        return got if got is not None else self.spark.createDataFrame([], "match_id long, side int, team long, t long, win int, batch int")


class WindowTotals(Sink):
    """Counts and sums by type in tumbling windows of event time. Parts of a window add up, so late events need no replay."""

    def __init__(self, spark: SparkSession, path: str, length: str = "1 hour"):
        super().__init__(spark, path, ["event_id"], "ts")
        self.length = length

    def __call__(self, rows: DataFrame, batch: int) -> None:
        new, _ = self.new(rows.select("event_id", "event_type", "value", "ts"), batch)
        totals = new.groupBy(F.window("ts", self.length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        self.put(totals.select(F.col("w.start").alias("start"), "event_type", "n", "total"), "out", batch)

    def result(self) -> DataFrame:
        """(start, event_type, n, total)."""
        return self.table("out").groupBy("start", "event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def fed(rows: DataFrame, sink: type[Sink], arrival: str) -> DataFrame:
    """What a sink makes of a table that arrives as a stream in the order of a column, in at least four micro-batches of
    FILES files. The stream's folder is gone when this returns."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = kept(rows)
    batches = max(4, -(-rows.count() // MICRO_BATCH))
    rows.repartitionByRange(batches * FILES, arrival).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(f"{path}/in")
    out = kept(sink(spark, f"{path}/tables").run(stream).result())
    delete(spark, path)
    delete(spark, rows._kept_at)
    return out


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what its source has and gives what it wrote; sink and progress lie in the shared folder."""
    spark: SparkSession = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/progress").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    delete(spark, f"{path}/progress")
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
