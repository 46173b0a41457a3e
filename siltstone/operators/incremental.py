"""Processing only new or changed records.

The feed is split by a hash of the record's key (here: the file's path) into buckets, which are replaced as a whole, and
each of them into cells of a few keys, which are compared. A cell's fingerprint is its row count and two additive sums of row
hashes, so that it is built by partial aggregation in one scan, does not depend on row order, and that of an appended
batch is added to what was there. A run compares the fingerprints with those of the last successful run (as tables, nothing
of them reaches the driver), recomputes only cells which differ, and writes the buckets of these by dynamic
partition overwrite below its own id. A state that other runs left without fingerprints seeds them: those of the rows that it covers.

A run is committed by one rename of a manifest, which names for each bucket the run that holds it, and the runs whose result
nobody has acknowledged yet. Broken off before the rename, a run has changed nothing, and the next one does its work; broken
off after it, the next run hands out its result first. So over all attempts every change is handed out once; a consumer that may
break off itself acknowledges when it is done, and is given the same run again, under the same id, until it does.

Defined results: rows without seq are no changes; a null path is the path "" (it has no state, so it stays pending in
``pending``); a null arrival counts as earlier than any state; copies of a seq are one change with the earliest
arrival; repeated state rows: the one updated last holds (ties: the higher last_seq); state rows without a readable
time count as oldest; empty tables give empty results; columns that are not named in the docstrings are ignored.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.paths import change_kind, clean_path, utc_ntz
from siltstone.session import Folder, materialize, pick, salted_join, scratch

LOW = 0xFFFFFFFF
TAKEN = "bucket int, seq long, path string, arrival timestamp_ntz, kind string, new_hash string, new_size long"
STATE = "bucket int, path string, last_seq long, updated timestamp_ntz, hash string, size long"
PRINTS = "bucket int, cell long, n long, low long, high long"


def fingerprints(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, n, low, high): row count and sums of the low and high halves of the row hashes. Nulls are hashed as such."""
    h = F.xxhash64(*[c for name in columns for c in (F.col(name).isNull(), F.col(name))])
    return (
        df.select(*keys, h.alias("h"))
        .groupBy(*keys)
        .agg(F.count("*").alias("n"), F.sum(F.col("h").bitwiseAND(F.lit(LOW))).alias("low"), F.sum(F.shiftright("h", 32)).alias("high"))
    )


class Broken(RuntimeError):
    """Raised where a test breaks a run off."""


class PartitionedIncrement:
    """Incremental runs over a change feed, kept in ``root``: a manifest, and below each run's id what that run wrote.

    Buckets and cells are fixed when a store first sees a feed: ``rows_per_bucket`` and ``rows_per_cell`` rows each (or
    ``buckets``). A key of more than ``rows_per_task`` rows is spread over several tasks, with its state row repeated for each."""

    FEED = ["seq", "path", "arrival", "kind", "new_hash", "new_size"]

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int | None = None, rows_per_bucket: int = 4_000_000, rows_per_cell: int = 16, rows_per_task: int = 500_000):
        self.spark, self.rows_per_bucket, self.rows_per_cell, self.rows_per_task = spark, rows_per_bucket, rows_per_cell, rows_per_task
        self.root, self.wanted = root or scratch(spark, "increment"), buckets
        self.folder = Folder(spark, self.root)
        self.manifest = self.folder.newest("manifest") or {"buckets": 0, "cells": 0, "state": {}, "fingerprints": {}, "waiting": []}

    # -- layout ---------------------------------------------------------------------------------------------------
    def _layout(self, changes: DataFrame) -> None:
        if not self.manifest["buckets"]:
            n = changes.count()  # for a table in columns a matter of its footers
            buckets = self.wanted or max(8, -(-n // self.rows_per_bucket))
            self.manifest |= {"buckets": buckets, "cells": max(buckets, n // self.rows_per_cell)}

    def _cell(self, path):
        return F.pmod(F.xxhash64(path), F.lit(self.manifest["cells"]))

    def _place(self, path) -> list:
        cell = self._cell(path)
        return [F.pmod(cell, F.lit(self.manifest["buckets"])).cast("int").alias("bucket"), cell.alias("cell")]

    # -- tables ---------------------------------------------------------------------------------------------------
    def _read(self, name: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        """What holds now of a table, by the manifest; only the given buckets."""
        at = self.manifest[name]
        paths = [f"{self.root}/{name}/run={r}/bucket={b}" for b, r in at.items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", f"{self.root}/{name}").schema(schema + ", run string").parquet(*paths).drop("run")

    def _write(self, df: DataFrame, name: str, run: str, salt: str) -> dict[str, str]:
        """Writes buckets below the run's id; whatever a broken attempt of the same run left in them is replaced. A bucket is
        written by as many tasks as its rows need. Returns {bucket: run}."""
        salts = max(1, -(-self.rows_per_bucket // self.rows_per_task))
        out = df.withColumn("run", F.lit(run)).repartition("bucket", F.pmod(F.xxhash64(salt), F.lit(salts)))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "bucket").parquet(f"{self.root}/{name}")
        return {b.removeprefix("bucket="): run for b in self.folder.names(f"{name}/run={run}") if b.startswith("bucket=")}

    def valid_state(self, state: DataFrame) -> DataFrame:
        """One row per path of ``rel_path, hash, size, last_seq, updated_ts``: the one updated last."""
        state = pick(state, "rel_path", "hash", "size", "last_seq", "updated_ts")
        updated = utc_ntz(F.col("updated_ts"), dict(state.dtypes)["updated_ts"])
        row = F.struct(F.col("last_seq").cast("long").alias("last_seq"), updated.alias("updated"), F.col("hash"), F.col("size").cast("long").alias("size"))
        order = F.struct(F.coalesce(updated, F.lit("0001-01-01").cast("timestamp_ntz")), F.coalesce(F.col("last_seq"), F.lit(-1)))
        return (
            state.select(F.coalesce(clean_path(F.col("rel_path")), F.lit("")).alias("path"), row.alias("row"), order.alias("ord"))
            .groupBy("path")
            .agg(F.max_by("row", "ord").alias("row"))
            .select(*self._place(F.col("path")), "path", "row.*")
        )

    def feed(self, changes: DataFrame) -> DataFrame:
        self._layout(changes)
        changes = pick(changes, *[c for c in dict.fromkeys(changes.columns) if c in ("seq", "rel_path", "recorded_at", "change_type", "new_hash", "new_size")])
        types = dict(changes.dtypes)
        path = F.coalesce(clean_path(F.col("rel_path")), F.lit(""))
        # every column is derived from what the feed has; absent ones become null, and unused ones are pruned from the scan
        opt = lambda c, kind: (F.col(c) if c in types else F.lit(None)).cast(kind)
        return (
            changes.where(F.col("seq").isNotNull())
            .select(
                F.col("seq").cast("long").alias("seq"), path.alias("path"), utc_ntz(F.col("recorded_at"), types["recorded_at"]).alias("arrival"),
                change_kind(opt("change_type", "string")).alias("kind"), opt("new_hash", "string").alias("new_hash"), opt("new_size", "long").alias("new_size"),
            )
            .select(*self._place(F.col("path")), "*")
        )

    # -- what has changed -----------------------------------------------------------------------------------------
    def _parts(self, prints: DataFrame) -> DataFrame:
        """(cell, parts) of the cells too large for one task: at most one per ``rows_per_task`` rows of the feed."""
        return F.broadcast(prints.where(F.col("n") > self.rows_per_task).select("cell", F.ceil(F.col("n") / self.rows_per_task).alias("parts")))

    def _against(self, rows: DataFrame, state: DataFrame, prints: DataFrame, how: str) -> DataFrame:
        """Changes joined with the state of their path; hot cells are split by seq."""
        parts = self._parts(prints)
        one = F.lit(1).cast("long")
        left = rows.join(parts, "cell", "left").withColumn("part", F.pmod(F.xxhash64("seq"), F.coalesce("parts", one))).drop("parts")
        right = state.join(parts, "cell", "left").select("path", "last_seq", "updated", F.lit(True).alias("known"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", one) - 1)).alias("part"))
        return left.join(right, ["path", "part"], how)

    def seed(self, feed: DataFrame, state: DataFrame, prints: DataFrame, columns: list[str]) -> DataFrame:
        """The fingerprints of what a given state covers, as the runs that left it would have written them."""
        covered = self._against(feed, state, prints, "inner").where((F.col("seq") <= F.col("last_seq")) & ~F.coalesce(F.col("arrival") > F.col("updated"), F.lit(False)))
        return fingerprints(covered, ["bucket", "cell"], columns)

    @staticmethod
    def changed_cells(new: DataFrame, old: DataFrame) -> DataFrame:
        """(bucket, cell, n, low, high) of the cells whose fingerprint isn't that of the last successful run."""
        before = old.select("bucket", "cell", F.col("n").alias("n0"), F.col("low").alias("low0"), F.col("high").alias("high0"))
        same = (F.col("n") == F.col("n0")) & (F.col("low") == F.col("low0")) & (F.col("high") == F.col("high0"))
        return new.join(before, ["bucket", "cell"], "left").where(~F.coalesce(same, F.lit(False))).select("bucket", "cell", "n", "low", "high")

    def pending(self, feed: DataFrame, state: DataFrame, changed: DataFrame, full: bool = False) -> DataFrame:
        """Changes of the changed cells which the state doesn't cover: (bucket, seq, path, arrival[, kind, new_hash, new_size])."""
        body = F.struct("kind", "new_hash", "new_size")
        aggs = [F.min(c).alias(c) for c in ("path", "bucket", "cell", "arrival")] + ([F.max(body).alias("body")] if full else [])
        # rows of unchanged cells go no further; the others are spread by seq, as one cell may be hot
        one = salted_join(feed, changed.select("cell"), "cell", "seq", "left_semi").groupBy("seq").agg(*aggs)
        out = self._against(one, state, changed, "left").where(
            F.col("known").isNull() | F.coalesce(F.col("seq") > F.col("last_seq"), F.lit(True)) | F.coalesce(F.col("arrival") > F.col("updated"), F.lit(False))
        )
        return out.select("bucket", "seq", "path", "arrival", *(["body.kind", "body.new_hash", "body.new_size"] if full else []))

    def plan(self, changes: DataFrame, state: DataFrame) -> DataFrame:
        """The pending changes against a state that other runs left: its fingerprints are seeded, and only cells which differ from
        them are looked into. Commits nothing."""
        columns, feed = ["seq", "path", "arrival"], self.feed(changes)
        valid = self.valid_state(state)
        prints = materialize(fingerprints(feed, ["bucket", "cell"], columns), "prints")
        changed = materialize(self.changed_cells(prints, self.seed(feed, valid, prints, columns)), "changed")
        return self.pending(feed, valid, changed)

    # -- a run ----------------------------------------------------------------------------------------------------
    def _commit(self, **parts) -> None:
        new = self.manifest | parts
        self.folder.put("manifest", new)
        self.manifest = new

    def run(self, changes: DataFrame, first_state: DataFrame | None = None, run_id: str | None = None, appended: bool = False, acknowledge: bool = True, fail_after: str | None = None) -> DataFrame:
        """One whole run: returns the changes that this run took, and those of earlier runs which nobody got.

        ``first_state`` is read only where the store has no state yet. ``appended``: ``changes`` are only what has come since the
        last run, so that their fingerprints are added to those known. A ``run_id`` that was committed before takes nothing
        again. ``fail_after`` ('taken', 'half', 'state', 'fingerprints' or 'commit') breaks the run off there, for tests."""
        run = "r" + (run_id or uuid.uuid4().hex)

        def stop(at: str) -> None:
            if fail_after == at:
                raise Broken(at)

        waiting = list(self.manifest["waiting"])
        if run in waiting or self.folder.newest(f"done/{run}") is not None:
            return self._hand_out(waiting, acknowledge)
        feed = self.feed(changes)
        prints = materialize(fingerprints(feed, ["bucket", "cell"], self.FEED), "prints")
        if not self.manifest["state"] and first_state is not None:
            first = materialize(self.valid_state(first_state), "first")
            known = self._write(first.drop("cell"), "state", run + "_first", "path")
            seeded = self._write(self.seed(feed, first, prints, self.FEED), "fingerprints", run + "_first", "cell")
            self._commit(state=known, fingerprints=seeded)
        old = self._read("fingerprints", PRINTS)
        changed = materialize(prints if appended else self.changed_cells(prints, old), "changed")
        buckets = [r["bucket"] for r in changed.select("bucket").distinct().collect()]  # as many as there are folders
        if not buckets:
            return self._hand_out(waiting, acknowledge)
        state = self._read("state", STATE, buckets).withColumn("cell", self._cell(F.col("path")))
        taken = f"{self.root}/taken/{run}"
        self.pending(feed, state, changed, full=True).write.mode("overwrite").parquet(taken)
        out = self._taken(run)
        stop("taken")
        news = out.groupBy("bucket", "path").agg(F.max_by(F.struct("kind", "new_hash", "new_size", "seq"), "seq").alias("top"), F.max("arrival").alias("seen"))
        dead = F.col("top.kind") == "deleted"
        newer = F.col("top.seq").isNotNull() & F.coalesce(F.col("top.seq") > F.col("last_seq"), F.lit(True))
        merged = state.drop("cell").join(news, ["bucket", "path"], "full").select(
            "bucket", "path",
            F.greatest("last_seq", "top.seq").alias("last_seq"), F.greatest("updated", "seen").alias("updated"),
            F.when(newer, F.when(dead, None).otherwise(F.col("top.new_hash"))).otherwise(F.col("hash")).alias("hash"),
            F.when(newer, F.when(dead, None).otherwise(F.col("top.new_size"))).otherwise(F.col("size")).alias("size"),
        )
        if fail_after == "half":
            self._write(merged.where("bucket % 2 = 0"), "state", run, "path")
            stop("half")
        new_state = self._write(merged, "state", run, "path")
        stop("state")
        mine = prints.join(changed.select("bucket").distinct(), "bucket", "left_semi")  # whole buckets are replaced
        both = mine.select("*", F.lit(1).alias("new")).unionByName(self._read("fingerprints", PRINTS, buckets).select("*", F.lit(0).alias("new")))
        if appended:
            both = both.groupBy("bucket", "cell").agg(*[F.sum(c).alias(c) for c in ("n", "low", "high")])
        else:
            both = both.groupBy("bucket", "cell").agg(F.max_by(F.struct("n", "low", "high"), "new").alias("p")).select("bucket", "cell", "p.*")
        new_prints = self._write(both, "fingerprints", run, "cell")
        stop("fingerprints")
        before = self.manifest
        self._commit(state=before["state"] | new_state, fingerprints=before["fingerprints"] | new_prints, waiting=[*waiting, run])
        stop("commit")
        for name in ("state", "fingerprints"):  # nobody reads the replaced buckets any more
            for b, r in before[name].items():
                if b in (new_state if name == "state" else new_prints):
                    self.folder.delete(f"{name}/run={r}/bucket={b}")
        return self._hand_out([*waiting, run], acknowledge)

    def _taken(self, run: str) -> DataFrame:
        return self.spark.read.schema(TAKEN).parquet(f"{self.root}/taken/{run}")

    def _hand_out(self, runs: list[str], acknowledge: bool) -> DataFrame:
        out = self.spark.createDataFrame([], TAKEN)
        for r in runs:
            out = out.unionByName(self._taken(r))
        if acknowledge:
            self.acknowledge([r[1:] for r in runs], keep=True)
        return out

    def waiting(self) -> dict[str, DataFrame]:
        """{run id: its changes} of the committed runs that nobody has acknowledged."""
        return {r[1:]: self._taken(r) for r in self.manifest["waiting"]}

    def acknowledge(self, run_ids: list[str], keep: bool = False) -> None:
        """The changes of these runs have been dealt with. With ``keep`` their rows stay readable."""
        gone = [f"r{r}" for r in run_ids if f"r{r}" in self.manifest["waiting"]]
        if gone:
            for r in gone:
                self.folder.put(f"done/{r}", {})  # before the manifest, so that its changes are never taken again
            self._commit(waiting=[r for r in self.manifest["waiting"] if r not in gone])
            for r in gone if not keep else ():
                self.folder.delete(f"taken/{r}")

    def state(self) -> DataFrame:
        return self._read("state", STATE).drop("bucket")
