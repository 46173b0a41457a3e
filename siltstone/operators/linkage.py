"""Joins by parts of paths: longest suffix, progressive prefix and import linkage, as equi-joins on exploded keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def suffixes(path: Column, sep: str = "/") -> Column:
    """All suffixes of a path at its separators, the whole path first."""
    parts = F.split(path, sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, 10_000), sep))


def prefixes(path: Column, sep: str = "/") -> Column:
    """All prefixes at the separators, the whole path first."""
    parts = F.split(path, F.concat(F.lit("["), F.lit(sep), F.lit("]")))
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), sep))


def longest_suffix_join(left: DataFrame, path: str, right: DataFrame, target: str, ident: str) -> DataFrame:
    """``left`` with (ident, matched_by): the right row whose path is the longest suffix of the left one, else the one
    whose base name no other right row has; ties by the smaller ident; null where there is neither."""
    r = right.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("__key")).agg(F.min(ident).alias("__id"))
    keys = left.select(path).distinct().where(F.col(path).isNotNull()).select(path, F.explode(suffixes(F.col(path))).alias("__key"))
    best = keys.join(r, "__key").groupBy(path).agg(F.max_by("__id", F.length("__key")).alias("__suffix"))
    base = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    single = r.groupBy(base(F.col("__key")).alias("__base")).agg(F.count("*").alias("__n"), F.min("__id").alias("__name")).where("__n = 1")
    out = left.join(best, path, "left").withColumn("__base", base(F.col(path))).join(single, "__base", "left")
    by = F.when(F.col("__suffix").isNotNull(), "suffix").when(F.col("__name").isNotNull(), "name")
    return out.withColumn(ident, F.coalesce("__suffix", "__name")).withColumn("matched_by", by).drop("__suffix", "__base", "__n", "__name")


def progressive_prefix_join(left: DataFrame, path: str, right: DataFrame, target: str, ident: str, sep: str = "/") -> DataFrame:
    """``left`` with (ident, cut): the right row whose path is left over after dropping as few trailing parts as possible."""
    r = right.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("__key")).agg(F.min(ident).alias("__id"))
    keys = left.select(path).distinct().where(F.col(path).isNotNull()).select(path, F.posexplode(prefixes(F.col(path), sep)).alias("__cut", "__key"))
    best = keys.join(r, "__key").groupBy(path).agg(F.min_by(F.struct("__id", "__cut"), "__cut").alias("__b"))
    return left.join(best, path, "left").withColumn(ident, F.col("__b.__id")).withColumn("cut", F.col("__b.__cut")).drop("__b")


def link_imports(imports: DataFrame, symbols: DataFrame, modules: DataFrame, entities: DataFrame) -> DataFrame:
    """(import_id, by_file, to_file, is_external, entity_ids): the linkage of imports.

    imports (import_id, source), symbols (import_id, file_id: who imports; the first file holds), modules (file_id, module),
    entities (import_id, kind, entity_id: what an import brings, variables, functions and classes in that order)."""
    who = symbols.groupBy("import_id").agg(F.min("file_id").alias("by_file"))
    dotted = imports.withColumn("__path", F.regexp_replace("source", r"^\.+", ""))
    tails = modules.select("file_id", F.explode(suffixes(F.regexp_replace("module", r"\.", "/"))).alias("module")).withColumn("module", F.regexp_replace("module", "/", "."))
    to = progressive_prefix_join(dotted.select("import_id", "__path"), "__path", tails, "module", "file_id", ".").select("import_id", F.col("file_id").alias("to_file"))
    rank = F.when(F.col("kind") == "variable", 0).when(F.col("kind") == "function", 1).otherwise(2)
    ids = entities.groupBy("import_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.col("entity_id").alias("e")))), lambda x: x["e"]).alias("entity_ids"))
    out = imports.join(who, "import_id", "left").join(to, "import_id", "left").join(ids, "import_id", "left")
    return out.select("import_id", "by_file", "to_file", F.col("to_file").isNull().alias("is_external"), F.coalesce("entity_ids", F.array().cast("array<long>")).alias("entity_ids"))


def reconcile_ids(parts: dict[str, DataFrame], ident: str) -> DataFrame:
    """(part, old_id, new_id): the ids of several analyzers moved into disjoint ranges, part by part in name order."""
    tops = None
    for name, df in parts.items():
        one = df.agg(F.lit(name).alias("part"), F.coalesce(F.max(ident), F.lit(0)).cast("long").alias("top"))
        tops = one if tops is None else tops.unionByName(one)
    base = tops.withColumn("base", F.coalesce(F.sum("top").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")  # a row per part
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("part"), F.col(ident).cast("long").alias("old_id"))
        out = one if out is None else out.unionByName(one)
    return out.join(F.broadcast(base), "part").select("part", "old_id", (F.col("old_id") + F.col("base")).alias("new_id"))
