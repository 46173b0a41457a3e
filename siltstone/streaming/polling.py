"""Polling a tree of files: snapshots, and the changes between two of them with their lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.linediff import line_changes
from siltstone.sources.files import relative_path

HASHED, CACHED = 8 << 20, 1 << 20  # bytes up to which a file is hashed, and its text is kept


def snapshot(spark: SparkSession, root: str, exclude: str | None = None, hashed: int = HASHED, cached: int = CACHED) -> DataFrame:
    """(rel_path, size, mtime, hash, is_binary, text): the files below ``root``. Contents are opened up to ``hashed`` bytes only; a larger
    file is told by its size and time. Binary is what has a zero byte; texts are kept up to ``cached`` bytes. Excluded files aren't opened."""
    base = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = relative_path(root)
    base = base.where(~rel.rlike(exclude)) if exclude else base
    plain = [rel.alias("rel_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]
    small = base.where(F.col("length") <= hashed).select(*plain, F.sha2("content", 256).alias("hash"), "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["is_binary"] = [b"\0" in c for c in b["content"]]
            b["text"] = [None if z or len(c) > cached else bytes(c).decode("utf-8", "replace") for c, z in zip(b["content"], b["is_binary"])]
            yield b[["rel_path", "size", "mtime", "hash", "is_binary", "text"]]

    schema = "rel_path string, size long, mtime timestamp, hash string, is_binary boolean, text string"
    large = base.where(F.col("length") > hashed).select(*plain)
    sign = F.concat_ws(":", F.lit("sig"), "size", F.unix_micros("mtime").cast("string"))
    return small.mapInPandas(decode, schema).unionByName(large.select("*", sign.alias("hash"), F.lit(True).alias("is_binary"), F.lit(None).cast("string").alias("text")))


def changes_between(old: DataFrame, new: DataFrame) -> DataFrame:
    """(rel_path, change_type, old_hash, new_hash, lines_added, lines_removed, snippet): what differs by hash; only these texts are compared
    line by line, and binary or large files have no lines."""
    o = old.select("rel_path", F.col("hash").alias("old_hash"), F.col("text").alias("o"))
    n = new.select("rel_path", F.col("hash").alias("new_hash"), F.col("text").alias("n"))
    x = o.join(n, "rel_path", "full").where(~F.col("old_hash").eqNullSafe(F.col("new_hash")))
    kind = F.when(F.col("old_hash").isNull(), "created").when(F.col("new_hash").isNull(), "deleted").otherwise("modified")
    heads = x.select("rel_path", kind.alias("change_type"), "old_hash", "new_hash")
    text = line_changes(x.where("o is not null").select("rel_path", F.col("o").alias("text")), x.where("n is not null").select("rel_path", F.col("n").alias("text")), "rel_path", "text")
    return heads.join(text.drop("change_type"), "rel_path", "left").select(*heads.columns, F.coalesce("lines_added", F.lit(0)).alias("lines_added"), F.coalesce("lines_removed", F.lit(0)).alias("lines_removed"), "snippet")
