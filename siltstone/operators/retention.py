"""Change snapshots, bounded rings, upserts and retention plans as joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change_type, old_hash, new_hash): created, deleted and modified keys between two snapshots; equal ones are left out."""
    o = old.select(key, F.col(digest).alias("old_hash"), F.lit(True).alias("__o"))
    n = new.select(key, F.col(digest).alias("new_hash"), F.lit(True).alias("__n"))
    kind = F.when(F.col("__o").isNull(), "created").when(F.col("__n").isNull(), "deleted").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "modified")
    return o.join(n, key, "full").withColumn("change_type", kind).where("change_type is not null").select(key, "change_type", "old_hash", "new_hash")


def ring(events: DataFrame, seq: str, capacity: int) -> DataFrame:
    """What a ring of ``capacity`` slots holds after all events: slot (seq - 1) mod capacity, the newest event of each."""
    cols = [c for c in events.columns]
    return events.withColumn("slot", F.pmod(F.col(seq) - 1, F.lit(capacity)).cast("int")).groupBy("slot").agg(F.max_by(F.struct(*cols), seq).alias("e")).select("slot", "e.*")


def upsert(base: DataFrame, news: DataFrame, key: str, order: str) -> DataFrame:
    """Latest row per key of both (of equal ``order`` the news)."""
    both = base.withColumn("__new", F.lit(0)).unionByName(news.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    row = F.struct(*[c for c in both.columns if c not in (key, "__new")])
    return both.groupBy(key).agg(F.max_by(row, F.struct(order, "__new")).alias("r")).select(key, "r.*")


def patch(events: DataFrame, results: DataFrame, key: str, column: str) -> DataFrame:
    """Events with ``column`` set from results by key; a result whose event is gone changes nothing."""
    r = results.groupBy(key).agg(F.max(column).alias("__r"))
    return events.join(r, key, "left").withColumn(column, F.coalesce("__r", column)).drop("__r")


def retention_plan(databases: DataFrame, sets: DataFrame, now: float, max_age: float, set_max_age: float, debris_age: float, max_bytes: int) -> DataFrame:
    """(storage_key, created_at, action, reason): what a retention pass would remove.

    databases (storage_key, active_at, bytes), sets (storage_key, created_at, bytes, complete). Idle databases are evicted,
    with their sets. Incomplete sets go after ``debris_age``. Of each database that stays the newest complete set is
    protected; other sets go by age, then oldest first until the total fits ``max_bytes``."""
    idle = F.lit(now) - F.col("active_at") > max_age
    evicted = databases.where(idle).select("storage_key", F.lit(None).cast("double").alias("created_at"), F.lit("evict").alias("action"), F.lit("idle").alias("reason"))
    live = databases.where(~idle)
    s = sets.join(evicted.select("storage_key"), "storage_key", "left_anti").join(live.select("storage_key", F.lit(True).alias("live")), "storage_key", "left")
    newest = F.max(F.when(F.col("complete") & F.col("live"), F.col("created_at"))).over(Window.partitionBy("storage_key"))
    s = s.withColumn("kept", F.coalesce(F.col("complete") & F.col("live") & (F.col("created_at") == newest), F.lit(False)))
    age = F.lit(now) - F.col("created_at")
    s = s.withColumn("reason", F.when(~F.col("complete") & (age >= debris_age), "incomplete").when(~F.col("kept") & (age > set_max_age), "age"))
    left = s.where("reason is null")
    total = (live.agg(F.sum("bytes")).first()[0] or 0) + (left.agg(F.sum("bytes")).first()[0] or 0)
    # a set goes while what is left before it is still too much: a running total over the prunable ones, oldest first
    by = Window.partitionBy("month").orderBy("created_at", "storage_key").rowsBetween(Window.unboundedPreceding, -1)
    free = left.where(~F.col("kept")).withColumn("month", F.floor(F.col("created_at") / (30 * 86400)))
    months = free.groupBy("month").agg(F.sum("bytes").alias("b"))  # few rows, ordered in one window; the sets within their month
    base = months.withColumn("base", F.coalesce(F.sum("b").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("month", "base")
    space = free.join(F.broadcast(base), "month").withColumn("gone", F.col("base") + F.coalesce(F.sum("bytes").over(by), F.lit(0))).where(F.lit(total) - F.col("gone") > max_bytes).withColumn("reason", F.lit("space"))
    pruned = s.where("reason is not null").unionByName(space.select(s.columns)).select("storage_key", "created_at", F.lit("prune").alias("action"), "reason")
    return evicted.unionByName(pruned)
