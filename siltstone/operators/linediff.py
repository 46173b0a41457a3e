"""Line differences between two states of texts, and a durable log of changes kept apart by repository."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.scalars import scrub
from siltstone.session import Folder

SNIPPET = 4000


def compare_lines(old: str | None, new: str | None) -> tuple[int, int, str]:
    """(lines added, lines removed, unified snippet): matched by the longest common runs of lines; a null text has no lines."""
    a, b = (old or "").splitlines(), (new or "").splitlines()
    added = removed = 0
    out: list[str] = []
    for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag != "equal":
            removed += j - i
            added += m - k
            out += [f"@@ {i + 1},{j - i} {k + 1},{m - k} @@", *("-" + x for x in a[i:j]), *("+" + x for x in b[k:m])]
    return added, removed, "\n".join(out)


def line_changes(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """(key, change_type, lines_added, lines_removed, snippet): keys that came, went or changed, with their lines; snippets are scrubbed
    of secrets and mail addresses and cut at ``SNIPPET`` characters. Equal texts are left out before any Python runs."""
    o = old.select(key, F.col(text).alias("__o"), F.lit(True).alias("__a"))
    n = new.select(key, F.col(text).alias("__n"), F.lit(True).alias("__b"))
    kind = F.when(F.col("__a").isNull(), "created").when(F.col("__b").isNull(), "deleted").when(~F.col("__o").eqNullSafe(F.col("__n")), "modified")
    x = o.join(n, key, "full").withColumn("change_type", kind).where("change_type is not null").select(key, "change_type", "__o", "__n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, c, *compare_lines(o, n)) for k, c, o, n in zip(b[key], b["change_type"], b["__o"], b["__n"])]
            yield pd.DataFrame(rows, columns=[key, "change_type", "lines_added", "lines_removed", "snippet"])

    out = x.mapInPandas(run, f"{key} {dict(x.dtypes)[key]}, change_type string, lines_added int, lines_removed int, snippet string")
    return out.withColumn("snippet", scrub(F.col("snippet"), SNIPPET))


class ChangeLog:
    """Append-only log in a folder, one part per repository; a batch that was appended before is not appended again."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.folder = spark, root, Folder(spark, root)

    def append(self, changes: DataFrame, repository: str, batch: str) -> None:
        """The batch's rows stand below its own name, so that a broken append is replaced by the next attempt and a repeated one too."""
        changes.withColumn("repo", F.coalesce(F.col(repository).cast("string"), F.lit(""))).withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo", "batch").parquet(f"{self.root}/log")

    def read(self, repo: str | None = None) -> DataFrame:
        """All changes, or those of one repository: the others' files aren't opened."""
        x = self.spark.read.option("basePath", f"{self.root}/log").parquet(f"{self.root}/log")
        return x.where(F.col("repo") == repo) if repo is not None else x

    def recent(self, repo: str, order: str, most: int = 100) -> DataFrame:
        return self.read(repo).orderBy(F.desc(order)).limit(most)
