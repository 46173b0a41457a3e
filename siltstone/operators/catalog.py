"""The view catalogue and the read-only query surface.

A view is declared once, as sources, joins, a filter, keys, aggregates and a total order; it is compiled to a DataFrame
for Spark, and to SQL for description, export and checking. A view exists where all its base tables do. Nothing here runs
on the driver but the plan: rows leave it only by the calls that are meant to hand rows out, each with its limit.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _pairs(text: str) -> list[tuple[str, str]]:
    """'a, n=count(*), b=t.c' to [(alias, expression)]; commas inside brackets don't part."""
    out, depth, cur = [], 0, ""
    for c in text + ",":
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            cur = cur.strip()
            if cur:
                m = re.match(r"(\w+)\s*=\s*(?!=)(.+)", cur, re.S)
                out.append((m[1], m[2].strip()) if m else (cur.split(".")[-1], cur))
            cur = ""
        else:
            cur += c
    return out


@dataclass(frozen=True)
class View:
    """``joins``: (table, condition, how); ``keys``: what is shown or grouped by; ``group``: other grouping expressions than
    the shown ones; ``aggs``: aggregates (none: a projection); ``order``: columns, '-' for descending, always total."""

    name: str
    table: str
    keys: str = ""
    aggs: str = ""
    joins: tuple[tuple[str, str, str], ...] = ()
    where: str = ""
    group: str = ""
    order: str = ""
    limit: int = 0

    @property
    def tables(self) -> tuple[str, ...]:
        return (self.table, *(j[0] for j in self.joins))

    def frame(self, tables: dict[str, DataFrame]) -> DataFrame:
        df = tables[self.table].alias(self.table)
        for t, on, how in self.joins:
            df = df.join(tables[t].alias(t), F.expr(on), how)
        if self.where:
            df = df.where(self.where)
        keys, aggs = _pairs(self.keys), _pairs(self.aggs)
        if aggs:
            by = [F.expr(e).alias(f"__{i}") for i, (_, e) in enumerate(_pairs(self.group) or keys)]
            df = df.groupBy(*by).agg(*[F.expr(e).alias(a) for a, e in aggs])
            shown = [F.expr(re.sub(rf"\b{re.escape(g)}\b", f"__{i}", e)).alias(a) if self.group else F.col(f"__{i}").alias(a) for i, ((a, e), g) in enumerate(zip(keys, [g for _, g in _pairs(self.group) or keys]))]
            df = df.select(*shown, *[a for a, _ in aggs])
        else:
            df = df.select(*[F.expr(e).alias(a) for a, e in keys])
        if self.order:
            df = df.orderBy(*[F.col(c[1:]).desc_nulls_last() if c[0] == "-" else F.col(c).asc_nulls_last() for c in self.order.replace(" ", "").split(",")])
        return df.limit(self.limit) if self.limit else df

    def sql(self) -> str:
        keys, aggs = _pairs(self.keys), _pairs(self.aggs)
        out = f"SELECT {', '.join(f'{e} AS {a}' for a, e in keys + aggs)} FROM {self.table}"
        for t, on, how in self.joins:
            out += f" {how.upper()} JOIN {t} ON {on}"
        if self.where:
            out += f" WHERE {self.where}"
        if aggs and keys:
            out += " GROUP BY " + ", ".join(e for _, e in _pairs(self.group) or keys)
        if self.order:
            out += " ORDER BY " + ", ".join((c[1:] + " DESC" if c[0] == "-" else c + " ASC") + " NULLS LAST" for c in self.order.replace(" ", "").split(","))
        return out + (f" LIMIT {self.limit}" if self.limit else "")


WRITES = re.compile(r"Insert|Create|Drop|Alter|Delete|Update|Merge|Truncate|Replace|Command|Overwrite|SetCatalog|AddJar|Cache|Refresh|Load|Analyze", re.I)


class NotReadOnly(ValueError):
    pass


@dataclass
class Catalog:
    """Named tables and views of one result set. Tables are DataFrames or functions that make them when first asked."""

    spark: SparkSession
    tables: dict[str, DataFrame | Callable[[], DataFrame]]
    views: dict[str, View] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        t = self.tables[name]
        if callable(t):
            t = self.tables[name] = t()
        return t

    def selectable(self) -> list[str]:
        """Views all of whose base tables are present."""
        return sorted(n for n, v in self.views.items() if all(t in self.tables for t in v.tables))

    def view(self, name: str) -> DataFrame:
        if name not in self.views:
            raise KeyError(f"no view {name}")
        v = self.views[name]
        return v.frame({t: self.table(t) for t in v.tables})

    def read_all(self, names: list[str] | None = None, limit: int = 50, workers: int = 8) -> dict[str, dict[str, Any]]:
        """Several views at once, each with its rows or its own error."""

        def one(name: str) -> dict[str, Any]:
            try:
                return self.result(self.view(name), limit)
            except (PySparkException, KeyError) as e:
                return {"error": str(e).split("\n")[0]}

        names = names or self.selectable()
        with ThreadPoolExecutor(workers) as pool:
            return dict(zip(names, pool.map(one, names)))

    def guard(self, sql: str) -> str:
        """The statement, if it is one that only reads: its whole parsed plan is searched, as WITH may hide an INSERT."""
        text = sql.strip().rstrip(";").strip()
        if not re.match(r"(?is)^(?:select|with|values|from|table)\b", text):
            raise NotReadOnly("only SELECT and WITH statements")
        try:
            tree = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text).treeString()
        except Exception as e:  # noqa: BLE001
            raise NotReadOnly(f"not a single readable statement: {str(e).splitlines()[0]}") from None
        for line in tree.splitlines():
            node = re.sub(r"^[\s:+\-|'!]*", "", line).split(" ")[0].split("(")[0]
            if WRITES.search(node):
                raise NotReadOnly(f"the statement writes: {node}")
        return text

    def query(self, sql: str, args: list | dict | None = None) -> DataFrame:
        """A read-only statement; {name} stands for a table or view of the catalogue, ? and :name for ``args``."""
        text = self.guard(re.sub(r"\{(\w+)\}", r"\1", sql))
        names = {n for n in re.findall(r"\b\w+\b", text) if n in self.tables or n in self.views}
        frames = {n: self.table(n) if n in self.tables else self.view(n) for n in names}
        for n, df in frames.items():
            text = re.sub(rf"(?i)(\b(?:from|join)\s+){n}\b", rf"\1{{{n}}}", text)
        return self.spark.sql(text, args=args, **{n: frames[n] for n in re.findall(r"\{(\w+)\}", text)})

    @staticmethod
    def result(df: DataFrame, limit: int = 100) -> dict[str, Any]:
        """Columns, rows, their number, and whether there were more than ``limit`` (0 or less: all)."""
        rows = (df.limit(limit + 1) if limit > 0 else df).collect()
        cut = limit > 0 and len(rows) > limit
        return {"columns": df.columns, "rows": [tuple(r) for r in (rows[:limit] if cut else rows)], "row_count": min(len(rows), limit) if limit > 0 else len(rows), "truncated": cut}

    def scalar(self, sql: str, default: Any = None, args: list | dict | None = None) -> Any:
        r = self.query(sql, args).first()
        return default if r is None else r[0]

    def iterate(self, sql: str, batch: int = 500, args: list | dict | None = None) -> Iterator[list]:
        if batch <= 0:
            raise ValueError("batch must be positive")
        part: list = []
        for r in self.query(sql, args).toLocalIterator():
            part.append(r)
            if len(part) == batch:
                yield part
                part = []
        if part:
            yield part

    def counts(self) -> DataFrame:
        """(name, rows) of all tables."""
        out = None
        for n in sorted(self.tables):
            one = self.table(n).agg(F.lit(n).alias("name"), F.count("*").alias("rows"))
            out = one if out is None else out.unionByName(one)
        return out

    def describe(self) -> DataFrame:
        """(name, kind, position, column, type, sql): tables and the views that exist."""
        rows = []
        for n in sorted(self.tables):
            rows += [(n, "table", i, c, t, None) for i, (c, t) in enumerate(self.table(n).dtypes, 1)]
        for n in self.selectable():
            rows += [(n, "view", i, c, t, self.views[n].sql()) for i, (c, t) in enumerate(self.view(n).dtypes, 1)]
        return self.spark.createDataFrame(rows, "name string, kind string, position int, column string, type string, sql string")

    def unify(self, others: dict[str, Catalog]) -> Catalog:
        """One catalogue of several, with names prefix__name; views read the prefixed tables."""
        out = Catalog(self.spark, dict(self.tables), dict(self.views))
        for p, c in others.items():
            for n in c.tables:
                out.tables[f"{p}__{n}"] = lambda c=c, n=n: c.table(n)
            for n in c.selectable():
                v = c.views[n]
                swap = lambda s, v=v, p=p: re.sub(r"\b(" + "|".join(map(re.escape, v.tables)) + r")\b(?=\.)", rf"{p}__\1", s)
                out.views[f"{p}__{n}"] = View(f"{p}__{n}", f"{p}__{v.table}", swap(v.keys), swap(v.aggs), tuple((f"{p}__{t}", swap(on), how) for t, on, how in v.joins), swap(v.where), swap(v.group), v.order, v.limit)
        return out


def export(df: DataFrame, path: str, kind: str) -> None:
    """To csv (with header), json or jsonl, parquet or orc, written by all tasks at once."""
    w = df.write.mode("overwrite")
    {"csv": lambda: w.option("header", True).csv(path), "json": lambda: w.json(path), "jsonl": lambda: w.json(path), "parquet": lambda: w.parquet(path), "orc": lambda: w.orc(path)}[kind]()


# Column types of SQL dialects by Spark's.
SQL_TYPES = {
    "sqlite": {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "string": "TEXT", "*": "TEXT"},
    "pgsql": {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "SMALLINT", "boolean": "BOOLEAN", "double": "DOUBLE PRECISION", "float": "REAL", "string": "TEXT", "*": "JSONB"},
    "mysql": {"bigint": "BIGINT", "int": "INT", "smallint": "SMALLINT", "tinyint": "TINYINT", "boolean": "TINYINT(1)", "double": "DOUBLE", "float": "FLOAT", "string": "TEXT", "*": "JSON"},
}


def sql_dump(df: DataFrame, name: str, dialect: str = "sqlite") -> tuple[str, DataFrame]:
    """(the CREATE statement, a DataFrame of INSERT statements): the statements are made by all tasks and can be written as text."""
    kinds, quote = SQL_TYPES[dialect], "`" if dialect == "mysql" else '"'

    def kind(t: str) -> str:
        return t.upper() if t.startswith("decimal") else "TIMESTAMP" if t.startswith("timestamp") else kinds.get(t, kinds["*"])

    def literal(c: str, t: str):
        text = lambda x: F.concat(F.lit("'"), F.regexp_replace(x, "'", "''"), F.lit("'"))
        if t == "boolean":
            v = F.when(F.col(c), "TRUE").otherwise("FALSE") if dialect == "pgsql" else F.col(c).cast("int").cast("string")
        elif t in ("bigint", "int", "smallint", "tinyint", "double", "float") or t.startswith("decimal"):
            v = F.col(c).cast("string")
        else:
            v = text(F.col(c).cast("string") if t in ("string", "date") or t.startswith("timestamp") else F.to_json(c))
        return F.when(F.col(c).isNull(), "NULL").otherwise(v)

    cols = ", ".join(f"{quote}{c}{quote}" for c in df.columns)
    create = f"CREATE TABLE {quote}{name}{quote} (" + ", ".join(f"{quote}{c}{quote} {kind(t)}" for c, t in df.dtypes) + ");"
    row = F.concat_ws(", ", *[literal(c, t) for c, t in df.dtypes])
    return create, df.select(F.concat(F.lit(f"INSERT INTO {quote}{name}{quote} ({cols}) VALUES ("), row, F.lit(");")).alias("statement"))
