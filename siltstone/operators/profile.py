"""Column profiles, type inference and correlations, each in one or two passes however many columns there are."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
CATEGORIES = 20  # at most so many values make a string column categorical


def _clean(df: DataFrame, c: str, kind: str):
    """NaN counts as missing."""
    return F.when(~F.isnan(c), F.col(c)) if kind in ("float", "double") else F.col(c)


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, data_type, n, nulls, non_nulls, distinct_values, minimum, maximum, mean, std, is_unique, inferred_type).

    Numbers come from one aggregation over all columns; distinct values from (column, value) pairs counted in two steps, so
    that no value is hot and none is collected. Standard deviation is that of a sample, and 0 for a single value."""
    kinds = {c: k for c, k in df.dtypes if columns is None or c in columns}
    num = [c for c, k in kinds.items() if k in NUMBERS or k.startswith("decimal")]
    val = {c: _clean(df, c, k) for c, k in kinds.items()}
    stats = df.agg(
        F.count("*").alias("n"),
        *[f for i, c in enumerate(kinds) for f in (F.count(val[c]).alias(f"c{i}"), F.min(val[c]).cast("string").alias(f"lo{i}"), F.max(val[c]).cast("string").alias(f"hi{i}"))],
        *[f for i, c in enumerate(kinds) if c in num for f in (F.avg(val[c]).cast("double").alias(f"m{i}"), F.when(F.count(val[c]) == 1, 0.0).otherwise(F.stddev_samp(val[c].cast("double"))).alias(f"s{i}"))],
    )
    none = F.lit(None).cast("double")
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"), F.lit(k).alias("data_type"), F.col("n"), (F.col("n") - F.col(f"c{i}")).alias("nulls"), F.col(f"c{i}").alias("non_nulls"),
            F.col(f"lo{i}").alias("minimum"), F.col(f"hi{i}").alias("maximum"), (F.col(f"m{i}") if c in num else none).alias("mean"), (F.col(f"s{i}") if c in num else none).alias("std"),
        )
        for i, (c, k) in enumerate(kinds.items())
    ])
    flat = stats.select(F.inline(rows))
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), val[c].cast("string").alias("value")) for c in kinds])))
    distinct = pairs.where("value is not null").groupBy("column_name", "value").agg(F.lit(1).alias("one")).groupBy("column_name").agg(F.count("*").alias("distinct_values"))
    d = F.coalesce("distinct_values", F.lit(0))
    k = F.col("data_type")
    kind = (
        F.when(F.col("non_nulls") == 0, "unknown").when(k == "boolean", "boolean").when(k.isin("tinyint", "smallint", "int", "bigint"), "integer")
        .when(k.isin("float", "double") | k.startswith("decimal"), "float").when(k.startswith("timestamp") | (k == "date"), "datetime")
        .when(k == "string", F.when((d <= CATEGORIES) & (d < F.col("non_nulls")), "categorical").otherwise("string")).otherwise("unknown")
    )
    return flat.join(distinct, "column_name", "left").select(
        "column_name", "data_type", "n", "nulls", "non_nulls", d.alias("distinct_values"), "minimum", "maximum", "mean", "std",
        ((d == F.col("non_nulls")) & (F.col("non_nulls") == F.col("n")) & (F.col("n") > 0)).alias("is_unique"), kind.alias("inferred_type"),
    )


# Fixed value: of how many columns correlations are asked for at most.
CORRELATED = 60


def pearson_pairs(df: DataFrame, columns: list[str] | None = None, least: float = 0.3, most: int = 500) -> DataFrame:
    """(left_column, right_column, r): pairs of numeric columns with |r| of ``least`` or more, over the rows where both are
    present; the ``most`` strongest, of the first ``CORRELATED`` numeric columns. One aggregation for blocks of 400 pairs."""
    kinds = dict(df.dtypes)
    cols = [c for c in (columns or df.columns) if kinds[c] in NUMBERS or kinds[c].startswith("decimal")][:CORRELATED]
    pairs = list(combinations(cols, 2))
    v = {c: _clean(df, c, kinds[c]).cast("double") for c in cols}

    def corr(a: str, b: str):
        x, y = F.when(v[b].isNotNull(), v[a]), F.when(v[a].isNotNull(), v[b])
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))  # a constant column has no correlation

    flat = None
    for at in range(0, max(1, len(pairs)), 400):  # as many expressions as one aggregation bears
        part = pairs[at : at + 400]
        rows = F.array(*[F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.round(F.nanvl(f"r{i}", F.lit(None).cast("double")), 6).alias("r")) for i, (a, b) in enumerate(part)])
        one = df.agg(F.count("*").alias("n"), *[corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(part)])
        one = one.select(F.inline(rows if part else F.array().cast("array<struct<left_column: string, right_column: string, r: double>>")))
        flat = one if flat is None else flat.unionByName(one)
    return flat.where(F.abs("r") >= least).orderBy(F.abs("r").desc(), "left_column", "right_column").limit(most)
