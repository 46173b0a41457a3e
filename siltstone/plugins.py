"""Extension points: parsers by name and by ending, and the engine's functions and parsers for SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from siltstone.operators import structure as X
from siltstone.operators.enrich import check_digit_holds, masked
from siltstone.operators.matching import longest_common


class Registry:
    """Parsers (text to rows) with their schema, by name. A name is given once; another parser under it is refused, the same one again isn't."""

    def __init__(self) -> None:
        self.parsers: dict[str, tuple[Callable[[str], list[tuple]], str]] = {}
        self.endings: dict[str, str] = {}

    def add(self, name: str, parser: Callable[[str], list[tuple]], schema: str, *endings: str) -> None:
        if name in self.parsers and self.parsers[name][0] is not parser:
            raise ValueError(f"there is a parser {name} already")
        for e in endings:
            if self.endings.get(e, name) != name:
                raise ValueError(f"{e} belongs to {self.endings[e]}")
        self.parsers[name] = (parser, schema)
        self.endings.update(dict.fromkeys(endings, name))

    def for_ending(self, ending: str) -> tuple[Callable[[str], list[tuple]], str] | None:
        return self.parsers.get(self.endings.get(ending.lower(), ""))

    def run(self, df, key: str, text: str, name: str):
        """The rows of one parser over a table of texts: a component on its own."""
        parser, schema = self.parsers[name]
        return X.extract(df, key, text, parser, schema)


def standard() -> Registry:
    r = Registry()
    r.add("python_symbols", X.python_symbols, X.SYMBOLS, ".py", ".pyi")
    r.add("pattern_symbols", X.pattern_symbols, X.SYMBOLS, ".js", ".ts", ".java", ".go", ".c", ".h", ".rb", ".rs", ".php")
    r.add("ddl_objects", X.ddl_objects, X.DDL, ".sql", ".ddl")
    r.add("settings", X.settings, X.SETTINGS, ".json", ".toml", ".ini", ".env", ".yaml", ".yml")
    r.add("properties", X.properties, X.SETTINGS, ".properties")
    r.add("hcl", X.hcl, X.SETTINGS, ".hcl", ".tf")
    r.add("xml_settings", X.xml_settings, X.SETTINGS, ".xml")
    r.add("log_records", X.log_records, X.LOGS, ".log")
    r.add("elements", X.elements, X.ELEMENTS, ".html", ".htm")
    return r


def table_function(parser: Callable[[str], list[tuple]], schema: str):
    """A parser as a table function of SQL: SELECT … FROM texts, LATERAL name(text). A text it can't read gives no rows."""

    class Parse:
        def eval(self, text: str):
            try:
                yield from parser(text) if text is not None else ()
            except (ValueError, SyntaxError, RecursionError, KeyError, TypeError):
                return

    return udtf(Parse, returnType=schema)


def register(spark: SparkSession, registry: Registry | None = None) -> list[str]:
    """Makes the parsers and a few functions known to SQL; returns their names. Built-in expressions need no registration."""
    r = registry or standard()
    for name, (parser, schema) in r.parsers.items():
        spark.udtf.register(name, table_function(parser, schema))
    spark.udf.register("check_digit_holds", lambda v: None if v is None else check_digit_holds(v), T.BooleanType())
    spark.udf.register("masked", lambda v: None if v is None else masked(v), T.StringType())
    spark.udf.register("longest_common", longest_common, T.LongType())
    return [*r.parsers, "check_digit_holds", "masked", "longest_common"]
