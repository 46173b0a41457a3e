"""Applying a stream of inserts, updates and deletes: a log-structured merge store.

``append`` turns a batch of changes into one sorted run: the newest change per key of that batch, tombstones included,
bucketed by key and sorted by key and sequence. ``merge`` reads all runs as one k-way merge: the runs have the same
buckets, so that k-1 full outer merge joins on the key need no exchange, and of each key the change with the highest
sequence holds wherever it came from; keys whose newest change is a deletion stay hidden.

Runs have levels: appended ones are at level 0, and once a level has ``fan_in`` runs, these are merged to one of the next, so that a
change is written again once per level and not at every compaction. Tombstones stay, unless ``compact`` is told that no older
change can still arrive; only a compaction of all runs may drop them.

The store is a folder. Its manifest lists the runs and is replaced by one rename, so an append or a compaction is there as a whole or
not at all, and a store that is opened again goes on with what was committed. Runs that a compaction replaced are deleted
with the next change of the manifest but one, so that readers who have begun can finish; what a broken attempt left behind is
deleted when the store is opened.

Defined results: rows without a sequence are no changes; copies of a sequence count once (of copies that differ, the one
with the largest kind and hash); a null path is the path ""; unknown or null kinds count as modifications; a change to an
unknown key counts like a creation; an empty feed gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.paths import change_kind, clean_path
from siltstone.session import Folder, pick, scratch

RUN = "path string, seq long, dead boolean, new_hash string"


class SortedRuns:
    """Runs of changes in a shared folder. ``buckets`` is the same for all runs and fixed for the life of a store; not given, it
    is the session's number of shuffle partitions when the store is made. A store is opened again by its ``root``."""

    FEED = ("seq", "rel_path", "change_type", "new_hash")

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int | None = None, fan_in: int = 6):
        self.spark, self.fan_in = spark, fan_in
        self.root = root or scratch(spark, "runs")
        self.folder = Folder(spark, self.root)
        self.manifest = self.folder.newest("manifest") or {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "runs": [], "replaced": [], "batches": []}
        known = {r["name"] for r in self.manifest["runs"]} | set(self.manifest["replaced"])
        for name in self.folder.names("runs"):
            if name not in known:
                self.folder.delete(f"runs/{name}")

    @property
    def buckets(self) -> int:
        return self.manifest["buckets"]

    @property
    def runs(self) -> list[dict]:
        """name, level and, of runs that were written together, the slice."""
        return self.manifest["runs"]

    @staticmethod
    def newest(changes: DataFrame, *by: str) -> DataFrame:
        """Per key (and ``by``) the newest change; combined before the shuffle, so one key in a third of the rows does no harm."""
        top = F.struct(F.col("seq").cast("long").alias("seq"), (change_kind(F.col("change_type")) == "deleted").alias("dead"), F.col("new_hash"))
        rows = changes.where(F.col("seq").isNotNull()).select(*by, F.coalesce(clean_path(F.col("rel_path")), F.lit("")).alias("path"), top.alias("top"))
        return rows.groupBy(*by, "path").agg(F.max("top").alias("top")).select(*by, "path", "top.*")

    def _commit(self, runs: list[dict], **parts) -> None:
        gone = sorted({r["name"] for r in self.runs} - {r["name"] for r in runs})
        old = self.manifest["replaced"]
        new = self.manifest | parts | {"runs": runs, "replaced": gone}
        self.folder.put("manifest", new)
        self.manifest = new
        for name in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.folder.delete(f"runs/{name}")

    def _table(self, name: str, sliced: bool) -> str:
        """The run as a bucketed table of the session's catalogue, declared where this session doesn't know it yet."""
        if not self.spark.catalog.tableExists(name):
            part = "PARTITIONED BY (run)" if sliced else ""
            self.spark.sql(f"CREATE TABLE {name} ({RUN}{', run int' if sliced else ''}) USING parquet {part} CLUSTERED BY (path) SORTED BY (path, seq) INTO {self.buckets} BUCKETS LOCATION '{self.root}/runs/{name}'")
            if sliced:
                self.spark.sql(f"MSCK REPAIR TABLE {name}")
        return name

    def _write(self, newest: DataFrame, sliced: bool = False) -> str:
        name = f"run_{uuid.uuid4().hex}"
        w = newest.repartition(self.buckets, "path").write.option("path", f"{self.root}/runs/{name}")
        (w.partitionBy("run") if sliced else w).bucketBy(self.buckets, "path").sortBy("path", "seq").saveAsTable(name)
        return name

    def append(self, changes: DataFrame, batch: str | None = None) -> None:
        """Adds one run from one batch of the feed. A ``batch`` that was appended before is not added again."""
        if batch is not None and batch in self.manifest["batches"]:
            return
        name = self._write(self.newest(pick(changes, *self.FEED)))
        batches = [*self.manifest["batches"], batch][-1000:] if batch is not None else self.manifest["batches"]
        self._commit([*self.runs, {"name": name, "level": 0}], batches=batches)
        self._settle()

    def append_slices(self, changes: DataFrame, arrival: str, slices: int) -> None:
        """Adds ``slices`` runs at once, one per equal span of arrival time, in a single scan of the feed."""
        changes = pick(changes, *self.FEED, arrival)
        t = F.unix_micros(F.col(arrival).cast("timestamp"))
        lo, hi = changes.agg(F.min(t), F.max(t)).first()
        width = max(1, ((hi or 0) - (lo or 0)) // slices + 1)
        run = F.coalesce(F.floor((t - F.lit(lo or 0)) / F.lit(width)), F.lit(0)).cast("int")
        name = self._write(self.newest(changes.withColumn("run", run), "run"), sliced=True)
        self._commit([*self.runs, *({"name": name, "level": 0, "slice": k} for k in range(slices))])
        self._settle()

    def _run(self, r: dict) -> DataFrame:
        df = self.spark.table(self._table(r["name"], "slice" in r))
        return (df.where(F.col("run") == r["slice"]) if "slice" in r else df).select("path", F.struct("seq", "dead", "new_hash").alias("top"))

    def merge(self, runs: list[dict] | None = None) -> DataFrame:
        """(path, seq, dead, new_hash): the newest change per key over all (or the given) runs, tombstones included."""
        runs = self.runs if runs is None else runs
        if not runs:
            return self.spark.createDataFrame([], RUN)
        out = self._run(runs[0])
        for r in runs[1:]:
            new = self._run(r).withColumnRenamed("top", "next")
            out = out.hint("merge").join(new, "path", "full").select("path", F.greatest("top", "next").alias("top"))
        return out.select("path", "top.*")

    def alive(self) -> DataFrame:
        """(rel_path, seq, new_hash) of the keys alive after all changes."""
        return self.merge().where(~F.col("dead")).select(F.col("path").alias("rel_path"), "seq", "new_hash")

    def _settle(self) -> None:
        """Merges every level that is full into the next."""
        level = 0
        while level <= max((r["level"] for r in self.runs), default=0):
            mine = [r for r in self.runs if r["level"] == level]
            if len(mine) >= self.fan_in:
                name = self._write(self.merge(mine))
                self._commit([r for r in self.runs if r["level"] != level] + [{"name": name, "level": level + 1}])
            level += 1

    def compact(self, drop_tombstones: bool = False) -> None:
        """One run in place of all. Tombstones may go only where no change older than them can still arrive."""
        out = self.merge()
        name = self._write(out.where(~F.col("dead")) if drop_tombstones else out)
        self._commit([{"name": name, "level": max((r["level"] for r in self.runs), default=0)}])
