"""Column functions on file paths and change feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_path(path: Column) -> Column:
    """Path with single forward slashes, no "." segments, no outer blanks and no slash at its end."""
    p = F.regexp_replace(F.trim(path), r"[\\/]+", "/")
    p = F.regexp_replace(p, r"(^|/)(?:\./)+", "$1")
    return F.regexp_replace(p, r"(?<=.)(?:/\.)?/?$", "")


def change_kind(change_type: Column) -> Column:
    """'deleted', 'created' or 'modified' from any spelling; what is neither of the first two is a modification."""
    t = F.lower(F.trim(change_type))
    return F.when(t.startswith("delet") | t.startswith("remov"), "deleted").when(t.startswith("creat") | t.startswith("add"), "created").otherwise("modified")


def utc_ntz(col: Column, dtype: str) -> Column:
    """A naive UTC timestamp from a naive timestamp, a timestamp or an ISO string with a zone."""
    if dtype == "timestamp_ntz":
        return col
    if dtype == "string":
        col = F.try_to_timestamp(F.trim(col))
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), col.cast("timestamp_ntz"))
