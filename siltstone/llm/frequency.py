"""Frequency of every distinct value, term or n-gram, by suffix sorting.

Every position of a record's term sequence gives one suffix, cut at ``sigma`` terms. Suffixes are routed by their first
term (and a salt of the record, so that one term in a third of all rows is spread over many tasks), sorted in reverse
lexicographic order within their partition, and read once by a stack: an n-gram is complete when a suffix arrives which
doesn't start with it, and hands its count and its set of records to the next shorter one. A last small aggregation adds
the salts up; records are salted by themselves, so their sets are disjoint and the counts are exact.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.session import pick


@F.pandas_udf(T.StringType())
def _nfc_lower(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", unicodedata.normalize("NFC", x.strip()).lower()))


def nfc_lower(col: str | Column) -> Column:
    """Without outer blanks, in NFC and lower case. Spark has no normalization, so this one runs in Python by Arrow batches."""
    return _nfc_lower(col)


def _changes(a: pa.Array) -> np.ndarray:
    """For each row but the first: does it differ from the row before it? A null equals a null."""
    x, y = a.slice(1), a.slice(0, len(a) - 1)
    ne = pc.fill_null(pc.not_equal(x, y), False)
    return np.asarray(pc.or_(ne, pc.not_equal(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False), dtype=bool)


def stack_counts(batches: Iterator[pa.RecordBatch], sigma: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (t0..t{sigma-1}, rec, occ...) to (gram: list of terms, occurrences, records). Equal rows count once.

    Rows come sorted by all terms descending, then rec, then occ, so that runs of equal suffixes are cut with array
    operations and the stack moves once per distinct suffix and not once per row."""
    terms: list = []  # the open n-gram
    counts: list[int] = []  # by its length
    sets: list[list[np.ndarray]] = []  # records by its length; of the full length only while it is open
    out: tuple[list, list, list] = ([], [], [])
    before: pa.RecordBatch | None = None  # last row

    def close(keep: int) -> None:
        while len(terms) > keep:
            recs = sets.pop()
            recs = np.unique(np.concatenate(recs)) if len(recs) > 1 else recs[0]
            n = counts.pop()
            out[0].append(list(terms))
            out[1].append(n)
            out[2].append(len(recs))
            terms.pop()
            if terms:
                counts[-1] += n
                sets[-1].append(recs)

    def flush() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(out[0], pa.list_(pa.string())), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["gram", "occurrences", "records"])
        for x in out:
            x.clear()
        return b

    for b in batches:
        if not b.num_rows:
            continue
        if before is not None:
            b = pa.Table.from_batches([before, b]).combine_chunks().to_batches()[0]
        n = b.num_rows
        new_gram = np.zeros(n - 1, dtype=bool)
        for k in range(sigma):
            new_gram |= _changes(b.column(k))
        new_rec = new_gram | _changes(b.column(sigma))
        fresh = new_rec.copy()
        for k in range(sigma + 1, b.num_columns):
            fresh |= _changes(b.column(k))
        first = before is None
        starts = np.flatnonzero(new_gram) + 1
        starts = np.concatenate(([0], starts))
        ends = np.concatenate((starts[1:], [n]))
        fresh_sum = np.concatenate(([0, int(first)], int(first) + np.cumsum(fresh)))  # fresh rows before row i
        rec = b.column(sigma).to_numpy(zero_copy_only=False)
        rec_new = np.concatenate(([first], new_rec))
        cols = [b.column(k).take(pa.array(starts)).to_pylist() for k in range(sigma)]
        for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
            if i or first:
                gram = [t for t in (c[i] for c in cols) if t is not None]
                keep = 0
                while keep < min(len(terms), len(gram)) and terms[keep] == gram[keep]:
                    keep += 1
                if keep == len(gram) and keep < len(terms):  # a shorter suffix after the longer ones
                    close(keep)
                elif keep < len(gram):
                    close(keep)
                    for t in gram[keep:]:
                        terms.append(t)
                        counts.append(0)
                        sets.append([])
            counts[-1] += int(fresh_sum[e] - fresh_sum[s])
            recs = rec[s:e][rec_new[s:e]]
            if len(recs) or not sets[-1]:
                sets[-1].append(recs)
                if len(sets[-1]) > 64:  # keeps a long run over many batches small
                    sets[-1] = [np.unique(np.concatenate(sets[-1]))]
        before = b.slice(n - 1, 1)
        if len(out[0]) >= 20_000:
            yield flush()
    close(0)
    yield flush()


def suffix_counts(suffixes: DataFrame, sigma: int, occ: list[str], salts: int | None = None) -> DataFrame:
    """(gram array<string>, occurrences, records) of every n-gram up to ``sigma`` terms.

    ``suffixes`` has t0..t{sigma-1} (null beyond the suffix; t0 never null), rec (long: the record) and the columns
    ``occ`` which with rec identify an occurrence. ``salts`` parts per first term, by record;
    as many as shuffle partitions if not given, so that a term in most rows still uses them all."""
    names = [f"t{k}" for k in range(sigma)]
    parts = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        suffixes.select(*names, "rec", *occ)
        .repartition(parts, F.col("t0"), F.pmod(F.xxhash64("rec"), F.lit(salts or parts)))
        .sortWithinPartitions(*[F.col(c).desc_nulls_last() for c in names], "rec", *occ)
    )
    part = rows.mapInArrow(lambda it: stack_counts(it, sigma), "gram array<string>, occurrences long, records long")
    return part.groupBy("gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def ngram_counts(df: DataFrame, record: str, terms: str, sigma: int = 3, salts: int | None = None) -> DataFrame:
    """Counts of all n-grams of 1..sigma terms in the array column ``terms`` over all records.

    A null record or array gives nothing; null terms end no n-gram but are left out; repeated rows of one record at
    the same place count once; an empty table gives an empty result."""
    a = pick(df, record, terms).where(F.col(record).isNotNull()).select(F.xxhash64(record).alias("rec"), F.array_compact(terms).alias("a"))
    s = a.select("rec", "a", F.explode(F.sequence(F.lit(0), F.size("a") - 1)).alias("at")) if sigma else a
    s = s.where(F.size("a") > 0)
    s = s.select("rec", "at", *[F.get("a", F.col("at") + k).alias(f"t{k}") for k in range(sigma)])
    return suffix_counts(s, sigma, ["at"], salts)


def token_registry(locations: DataFrame, kinds: tuple[str, ...] = ("word", "string"), salts: int | None = None) -> DataFrame:
    """A fresh registry (token_kind, token, occurrence_count, file_count) from token_locations.

    Words are compared without outer blanks, in NFC and lower case; other kinds as they are. An occurrence is a distinct
    (location_key, token_kind, line, start_col, end_col); a file is a distinct location_key, kept as a 64-bit hash. Rows
    without a token, kind or location_key are left out, null positions are a position of their own, repeated rows count
    once, and an empty table gives an empty registry. This is ``suffix_counts`` with suffixes of one term."""
    locations = pick(locations, "token", "token_kind", "location_key", "line", "start_col", "end_col")
    rows = locations.where(F.col("token_kind").isin(*kinds) & F.col("token").isNotNull() & F.col("location_key").isNotNull())
    base = rows.select(
        F.col("token_kind").alias("kind"), "token", F.xxhash64("location_key").alias("rec"),
        F.coalesce(F.shiftleft(F.col("line").cast("long"), 32).bitwiseOR(F.col("start_col").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(-1).cast("long")).alias("o1"),
        F.coalesce(F.col("end_col"), F.lit(-1)).alias("o2"),
    )
    plain = ~F.col("token").rlike(r"[^\x00-\x7F]")
    # only tokens beyond ASCII need Unicode normalization, which Spark has no function for; the others stay in the JVM
    ascii_rows = base.where(plain).withColumn("token", F.when(F.col("kind") == "word", F.lower(F.regexp_replace("token", r"^\s+|\s+$", ""))).otherwise(F.col("token")))
    other = base.where(~plain).withColumn("token", F.when(F.col("kind") == "word", nfc_lower("token")).otherwise(F.col("token")))
    s = ascii_rows.unionByName(other).select(F.concat("kind", F.lit("\u0001"), "token").alias("t0"), "rec", "o1", "o2")
    gram = F.split(F.col("gram")[0], "\u0001", 2)
    return suffix_counts(s, 1, ["o1", "o2"], salts).select(
        gram[0].alias("token_kind"), gram[1].alias("token"), F.col("occurrences").alias("occurrence_count"), F.col("records").alias("file_count")
    )


def term_marks(locations: DataFrame, rare_below: int = 3, common_above: float = 0.25, salts: int | None = None) -> DataFrame:
    """(token, mark, occurrence_count, file_count) of the words in fewer than ``rare_below`` or more than the share
    ``common_above`` of all distinct location_key."""
    total = pick(locations, "location_key").agg(F.count_distinct(F.xxhash64("location_key")).alias("n")).first()["n"]  # one number
    r = token_registry(locations, ("word",), salts)
    mark = F.when(F.col("file_count") < rare_below, "rare").when(F.col("file_count") > common_above * total, "common")
    return r.withColumn("mark", mark).where(F.col("mark").isNotNull()).select("token", "mark", "occurrence_count", "file_count")


