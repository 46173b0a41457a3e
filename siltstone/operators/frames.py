"""Small relational operators: portable stores, ignoring and replacing inserts, lookups by kind, roll-ups, health of chunks, samples."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.session import Folder

NAME = re.compile(r"^[A-Za-z_]\w*$")


def insert_ignore(base: DataFrame, news: DataFrame, key: str) -> DataFrame:
    """Rows of ``news`` are added where their key isn't there yet; of several with one key, the least row. A null key never clashes."""
    cols = [c for c in base.columns if c != key]
    fresh = news.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*cols)).alias("r")).select(key, "r.*").join(base.select(key), key, "left_anti")
    return base.unionByName(fresh.select(base.columns)).unionByName(news.where(F.col(key).isNull()).select(base.columns))


def insert_replace(base: DataFrame, news: DataFrame, key: str) -> DataFrame:
    """Rows of ``news`` take the place of those with their key; of several with one key, the largest row holds."""
    cols = [c for c in base.columns if c != key]
    last = news.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*cols)).alias("r")).select(key, "r.*")
    return base.join(last.select(key), key, "left_anti").unionByName(last.select(base.columns))


class Store:
    """Named tables in a folder, written by all tasks: the same calls whatever file system lies below."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.folder = spark, root, Folder(spark, root)

    def _check(self, name: str) -> str:
        if not NAME.match(name):
            raise ValueError(f"no table name: {name}")
        return name

    def ensure_table(self, name: str, schema: str) -> None:
        if not self.folder.exists(self._check(name)):
            self.spark.createDataFrame([], schema).write.parquet(f"{self.root}/{name}")

    def insert_many(self, name: str, rows: DataFrame) -> None:
        old = self.table(name)
        rows.select(*[F.col(f.name).cast(f.dataType) for f in old.schema]).write.mode("append").parquet(f"{self.root}/{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self._check(name)}")

    def names(self) -> list[str]:
        return [n for n in self.folder.names() if NAME.match(n)]

    def execute(self, sql: str, args: dict | None = None) -> DataFrame:
        """A statement over the store's tables, named in braces: SELECT … FROM {name}."""
        return self.spark.sql(sql, args=args, **{n: self.table(n) for n in re.findall(r"\{(\w+)\}", sql)})


def count_where(table: DataFrame, where: str | None = None, args: dict | None = None) -> int:
    """How many rows; ``where`` is one condition on the table's own columns with :names for its values."""
    if where is None:
        return table.count()
    if re.search(r";|--|/\*", where):
        raise ValueError("one condition only")
    return table.sparkSession.sql("SELECT count(*) FROM {t} WHERE " + where, args=args, t=table).first()[0]


def lookup_by_kind(links: DataFrame, kind: str, ident: str, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """A polymorphic lookup: every row of ``links`` meets the table of its kind by its id, the others not at all; one inner join per kind.

    ``tables``: kind to (table, its id); what they have in common besides the id is taken over."""
    common = sorted(set.intersection(*[set(t.columns) - {k} for t, k in tables.values()]))
    out = None
    for name, (table, key) in tables.items():
        one = links.where(F.col(kind) == name).join(table.select(F.col(key).alias(ident), *common), ident)
        out = one if out is None else out.unionByName(one)
    return out


def relink(entities: DataFrame, path: str, files: DataFrame, target: str, ident: str) -> DataFrame:
    """Entities with the id that the census gives the file of their path; null where the census doesn't have it. Of several ids of a
    path the least holds."""
    ids = files.where(F.col(target).isNotNull()).groupBy(F.col(target).alias(path)).agg(F.min(ident).alias("__id"))
    return entities.drop(ident).join(ids, path, "left").withColumnRenamed("__id", ident)


def plain_name(name: Column) -> Column:
    """A table's name as foreign keys are resolved by it: without quotes and schema, in lower case."""
    return F.lower(F.regexp_extract(F.regexp_replace(name, r"[\"`\[\]']", ""), r"([^.]*)$", 1))


def resolve_targets(keys: DataFrame, reference: str, tables: DataFrame, name: str, ident: str) -> DataFrame:
    """Foreign keys with the id of the table they point to, by plain name; the least id of several, null of none."""
    ids = tables.groupBy(plain_name(F.col(name)).alias("__n")).agg(F.min(ident).alias("target_id"))
    return keys.withColumn("__n", plain_name(F.col(reference))).join(ids, "__n", "left").drop("__n")


def position_percentile(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, name of each share): the value at place int(p * (n - 1)) of a key's values in order; keys are to have few values each."""
    v = F.sort_array(F.collect_list(value))
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(v.alias("v")).select(key, *[F.get("v", F.floor(p * (F.size("v") - 1)).cast("int")).alias(n) for n, p in shares.items()])


def kpis(records: DataFrame, rates: list[str], latency: str, cost: str, *by: str) -> DataFrame:
    """Rates over the records that have the key, nearest-rank percentiles of latency, and totals of cost."""
    exact = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {latency})")
    return records.groupBy(*by).agg(
        F.count("*").alias("records"), *[F.avg(F.col(r).cast("double")).alias(f"{r}_rate") for r in rates],
        exact(0.5).alias("latency_p50"), exact(0.95).alias("latency_p95"), exact(0.99).alias("latency_p99"), F.avg(latency).alias("latency_mean"), F.sum(cost).alias("cost_total"), F.avg(cost).alias("cost_mean"),
    )


LAYER = r"^((?:[A-Za-z_]\w*\.)*[A-Za-z_]\w*\.\d+)(?=\.)"


def layers(tensors: DataFrame, name: str, elements: str, size: str) -> DataFrame:
    """(layer, tensors, parameters, bytes): tensors rolled up to the numbered layer they belong to, or to the first part of their name."""
    at = F.regexp_extract(name, LAYER, 1)
    layer = F.when(at != "", at).otherwise(F.regexp_extract(name, r"^([^.]*)", 1))
    return tensors.groupBy(layer.alias("layer")).agg(F.count("*").alias("tensors"), F.sum(elements).alias("parameters"), F.sum(size).alias("bytes"))


def chunk_health(chunks: DataFrame, seq: str, size: str, *by: str) -> DataFrame:
    """Number of chunks, first and last, how many are missing between them, repeated ones, and their total size."""
    g = chunks.groupBy(*by).agg(F.count("*").alias("chunks"), F.min(seq).alias("first"), F.max(seq).alias("last"), F.count_distinct(seq).alias("d"), F.sum(size).alias("total"))
    return g.select(*by, "chunks", "first", "last", (F.col("last") - F.col("first") + 1 - F.col("d")).alias("missing"), (F.col("chunks") - F.col("d")).alias("repeated"), "total")


def samples(df: DataFrame, most: int = 5, width: int = 64) -> DataFrame:
    """(column_name, ordinal, sample): the ``most`` least distinct values of every column as text, ``width`` characters each. Values are
    combined per column before they are moved, so no column is collected anywhere."""
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.substring(F.col(c).cast("string"), 1, width).alias("sample")) for c in df.columns]))).where("sample is not null").distinct()
    top = pairs.groupBy("column_name", F.pmod(F.xxhash64("sample"), F.lit(64)).alias("p")).agg(F.slice(F.array_sort(F.collect_set("sample")), 1, most).alias("s"))
    top = top.groupBy("column_name").agg(F.slice(F.array_sort(F.flatten(F.collect_list("s"))), 1, most).alias("s"))
    return top.select("column_name", F.posexplode("s").alias("at", "sample")).select("column_name", (F.col("at") + 1).alias("ordinal"), "sample")


def walk_orders(paths: DataFrame, path: str) -> DataFrame:
    """paths with depth and their parts: ordered by (parts) they come depth first, by (depth, parts) breadth first."""
    parts = F.split(path, "/")
    return paths.withColumn("parts", parts).withColumn("depth", F.size(parts) - 1)


def csv_shape(text: Column) -> dict[str, Column]:
    """Separator (the most frequent of the first line; a comma if there is none), rows with the header, and width of the first row.
    Separators in double quotes part nothing."""
    body = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"\n+$", "")
    first = F.regexp_replace(F.substring_index(body, "\n", 1), r'"[^"]*"', "")
    n = {s: F.regexp_count(first, F.lit(re.escape(s))) for s in (",", "\t", ";", "|")}
    best = F.array_max(F.array(*n.values()))
    sep = None
    for s, c in n.items():
        sep = F.when(c == best, s) if sep is None else sep.when(c == best, s)
    return {"separator": sep, "rows": F.when(F.length(body) == 0, 0).otherwise(F.regexp_count(body, F.lit("\n")) + 1), "columns": F.when(F.length(body) == 0, 0).otherwise(best + 1)}


def slug(name: Column) -> Column:
    """Lower-case letters, digits and single hyphens; 'project' where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "project").otherwise(s)


def fingerprint(*parts: Column) -> Column:
    """The first sixteen hexadecimal digits of the SHA-256 of the parts, parted by zero bytes; a null part is an empty one."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def storage_key(name: Column, *parts: Column) -> Column:
    return F.concat_ws("-", slug(name), fingerprint(*parts))


@F.pandas_udf(T.LongType())
def _digest56(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else int.from_bytes(hashlib.blake2b(x.encode(), digest_size=7).digest(), "big"))


RESERVED = 1_000_000_000_000


def extension_ids(files: DataFrame, extension: str, catalog: DataFrame) -> DataFrame:
    """files with extension_id: that of the catalogue (extension_id, extension_name) for '.' and the lower-case extension, else a number of
    seven hashed bytes above ``RESERVED``, the same in every run. Distinct extensions are hashed, not rows."""
    key = F.concat(F.lit("."), F.regexp_replace(F.lower(F.coalesce(F.col(extension), F.lit(""))), r"^\.+", ""))
    known = catalog.groupBy(F.lower("extension_name").alias("__key")).agg(F.min("extension_id").alias("__id"))
    keys = files.select(key.alias("__key")).distinct().join(known, "__key", "left").select("__key", F.coalesce("__id", F.lit(RESERVED) + _digest56("__key")).alias("extension_id"))
    return files.withColumn("__key", key).join(keys, "__key").drop("__key")


def zone_slot(offset_minutes: Column, names: DataFrame, fixed: str = "UTC") -> tuple[Column, DataFrame]:
    """(the label of an offset as UTC±hh:mm, the rows of ``names`` (zone, offset_minutes) by offset): of several zones of an offset the
    fixed one is preferred, then the first by name."""
    sign, n = F.when(offset_minutes < 0, "-").otherwise("+"), F.abs(offset_minutes)
    label = F.concat(F.lit(fixed), sign, F.lpad(F.floor(n / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((n % 60).cast("string"), 2, "0"))
    rank = F.struct((~F.col("zone").startswith(fixed)).alias("a"), F.col("zone").alias("b"))
    return label, names.groupBy("offset_minutes").agg(F.min_by("zone", rank).alias("zone"))


def changed_only(files: DataFrame, changes: DataFrame, key: str, analyse) -> DataFrame:
    """``analyse`` on the files that a batch of changes names, once each, however often they changed; the others aren't read."""
    return analyse(files.join(changes.select(key).distinct(), key, "left_semi"))
