"""Whole catalogues as SQL scripts, copies that are counted, views that are installed once, and registries with places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.catalog import Catalog, sql_dump

BEGIN, END = "-- views: begin", "-- views: end"


def script(catalog: Catalog, names: list[str], dialect: str = "sqlite", title: str = "dump") -> DataFrame:
    """(place, statement): header, drops in reverse order, and for each table its definition and its rows; then the views and the footer.

    The rows of all tables are made by all tasks; ``place`` gives the order in which the statements stand, (table, statement)."""
    quote = "`" if dialect == "mysql" else '"'
    head = {"sqlite": ["PRAGMA foreign_keys = OFF;", "BEGIN TRANSACTION;"], "pgsql": ["BEGIN;", "SET client_encoding = 'UTF8';"], "mysql": ["SET FOREIGN_KEY_CHECKS = 0;", "START TRANSACTION;"]}[dialect]
    foot = {"sqlite": ["COMMIT;", "PRAGMA foreign_keys = ON;"], "pgsql": ["COMMIT;"], "mysql": ["COMMIT;", "SET FOREIGN_KEY_CHECKS = 1;"]}[dialect]
    fixed = [(0, i, s) for i, s in enumerate([f"-- {title}", *head, *(f"DROP TABLE IF EXISTS {quote}{n}{quote};" for n in reversed(names))])]
    rows = None
    for k, n in enumerate(names, 1):
        create, inserts = sql_dump(catalog.table(n), n, dialect)
        fixed.append((2 * k - 1, 0, create))
        one = inserts.select(F.lit(2 * k).alias("part"), F.lit(0).alias("at"), "statement")
        rows = one if rows is None else rows.unionByName(one)
    last = 2 * len(names) + 1
    views = [f"CREATE VIEW {quote}{v}{quote} AS {catalog.views[v].sql()};" for v in catalog.selectable() if set(catalog.views[v].tables) <= set(names)]
    fixed += [(last, i, s) for i, s in enumerate([BEGIN, *views, END, *foot])]
    frame = catalog.spark.createDataFrame(fixed, "part int, at int, statement string")
    return frame if rows is None else frame.unionByName(rows)


def with_views(text: str, views: list[str]) -> str:
    """A script with its views between the two marks; where there are some already they are replaced, so that doing it twice changes nothing."""
    body = "\n".join([BEGIN, *views, END])
    a, b = text.find(BEGIN), text.find(END)
    return text[:a] + body + text[b + len(END) :] if 0 <= a < b else text.rstrip("\n") + "\n" + body + "\n"


def install(spark: SparkSession, catalog: Catalog) -> list[str]:
    """The catalogue's tables and views under their names in the session; doing it again replaces them."""
    for n in catalog.tables:
        catalog.table(n).createOrReplaceTempView(n)
    for v in catalog.selectable():
        catalog.view(v).createOrReplaceTempView(v)
    return [*sorted(catalog.tables), *catalog.selectable()]


def copy_counted(source: DataFrame, path: str, columns: list[str] | None = None) -> int:
    """Copies a table, or some of its columns, and counts what came out; a difference is an error."""
    out = source.select(*columns) if columns else source
    out.write.mode("overwrite").parquet(path)
    n, m = source.count(), source.sparkSession.read.parquet(path).count()
    if n != m:
        raise RuntimeError(f"{m} of {n} rows were copied")
    return m


def lookup(table: DataFrame, order: str, most: int | None = None, **keys) -> DataFrame:
    """The rows with these keys, the newest first; ties by all columns, so that the order is always the same."""
    out = table
    for k, v in keys.items():
        out = out.where(F.col(k).eqNullSafe(F.lit(v)))
    out = out.orderBy(F.desc_nulls_last(order), *[c for c in table.columns if c != order])
    return out.limit(most) if most is not None else out


def location_map(tokens: DataFrame, key: str, first: int = 20) -> DataFrame:
    """(token_kind, token, locations): for every token the places in its ``first`` files by key, as JSON {file: [[line, start, end], …]}.

    A token may stand in every file, so files are ranked by a top-k that is combined before the shuffle, never by a window over the token."""
    per = tokens.groupBy("token_kind", "token", key).agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64(key), F.lit(64))
    top = per.groupBy("token_kind", "token", part.alias("p")).agg(F.slice(F.array_sort(F.collect_set(key)), 1, first).alias("k"))
    top = top.groupBy("token_kind", "token").agg(F.slice(F.array_sort(F.flatten(F.collect_list("k"))), 1, first).alias("k")).select("token_kind", "token", F.explode("k").alias(key))
    places = tokens.join(top, ["token_kind", "token", key]).groupBy("token_kind", "token", key).agg(F.array_sort(F.collect_list(F.array("line", "start_col", "end_col"))).alias("at"))
    return places.groupBy("token_kind", "token").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string"), "at"))))).alias("locations"))


def kendall_pairs(df: DataFrame, item: str, ranks: list[str]) -> DataFrame:
    """(left_column, right_column, pairs, tau): rank correlation of every two columns over the items of one ranking, which are few: pairs
    i < j are formed inside an array of them. Ties count for neither side."""
    rows = df.agg(F.sort_array(F.collect_list(F.struct(item, *ranks))).alias("r"))  # one ranking
    out = None
    for i, a in enumerate(ranks):
        for b in ranks[i + 1 :]:
            sign = lambda x, y, a=a, b=b: F.signum((x[a] - y[a]).cast("double")) * F.signum((x[b] - y[b]).cast("double"))
            agree = F.flatten(F.transform("r", lambda x, k: F.transform(F.slice("r", F.lit(1), k), lambda y: sign(x, y))))
            one = rows.select(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.size(agree).alias("pairs"), F.round(F.try_divide(F.aggregate(agree, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))), F.size(agree)), 6).alias("tau"))
            out = one if out is None else out.unionByName(one)
    return out
