"""Structured Streaming: windowed counts of events, and a change feed applied batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators.changelog import SortedRuns
from siltstone.operators.incremental import PartitionedIncrement
from siltstone.session import scratch


def read_files(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of the parquet files of a folder or a single file, with its schema."""
    head, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{head}/[{name[0]}]{name[1:]}")


def windowed(events: DataFrame, ts: str, keys: list[str], size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by event-time window, with rows up to ``late`` late."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), "n")


def drain(df: DataFrame, each: Callable[[DataFrame, int], None], root: str | None = None, mode: str = "append") -> StreamingQuery:
    """Runs the stream over all that is there now, in micro-batches. Its checkpoint lies in ``root``, so that a later call goes on
    where this one stopped; without it, in the shared folder for this call only."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/stream" if root else scratch(df.sparkSession, "stream")).foreachBatch(each).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def to_table(df: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of a drained stream as a table; a batch that is run again replaces what it wrote."""
    root = scratch(df.sparkSession, "table")

    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(root if mode == "complete" else f"{root}/batch={n}")

    drain(df, each, mode=mode)
    out = df.sparkSession.read.parquet(root)
    return out.drop("batch") if mode != "complete" else out


def apply_changes(changes: DataFrame, store: SortedRuns) -> SortedRuns:
    """Appends every micro-batch of a change feed to the store as a sorted run; empty batches add none, and one that the stream runs
    again is not added twice. The checkpoint lies in the store, so a later call goes on where this one stopped."""

    def each(batch: DataFrame, n: int) -> None:
        if not batch.isEmpty():
            store.append(batch, f"batch{n}")

    drain(changes, each, store.root)
    return store


def process_increments(changes: DataFrame, store: PartitionedIncrement, handle: Callable[[DataFrame, str], None]) -> None:
    """Hands the changes that no earlier batch has taken to ``handle(rows, run id)``, batch by batch.

    A batch is acknowledged after ``handle`` returns: if it breaks off, the same rows come again under the same id, by which
    a consumer that writes tells what it has already written. A batch that the stream runs again takes nothing twice."""

    def deliver() -> None:
        for run, rows in store.waiting().items():
            handle(rows, run)
            store.acknowledge([run])

    def each(batch: DataFrame, n: int) -> None:
        if not batch.isEmpty():
            store.run(batch, run_id=f"batch{n}", appended=True, acknowledge=False)
        deliver()

    deliver()
    drain(changes, each, store.root)
