"""Metrics by family of content: formats by first bytes, binary files, JSON, CSV, XML, Markdown and settings, as rows of name and value.

Defined results: null contents and texts have no rows; a metric that can't be had for a text is left out, never guessed; empty texts
have their counts, all zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import scalars as S
from siltstone.operators.frames import csv_shape

# First bytes (in hex) of file formats, where they stand, the format, and whether it runs; tried in this order.
SIGNATURES = (
    (0, "89504E470D0A1A0A", "png", 0), (0, "FFD8FF", "jpeg", 0), (0, "474946383761", "gif", 0), (0, "474946383961", "gif", 0), (0, "424D", "bmp", 0), (0, "49492A00", "tiff", 0), (0, "4D4D002A", "tiff", 0), (0, "52494646", "riff", 0),
    (0, "4F676753", "ogg", 0), (0, "664C6143", "flac", 0), (0, "494433", "mp3", 0), (0, "25504446", "pdf", 0), (0, "25215053", "postscript", 0), (0, "504B0304", "zip", 0), (0, "504B0506", "zip", 0), (0, "1F8B", "gzip", 0),
    (0, "425A68", "bzip2", 0), (0, "FD377A585A00", "xz", 0), (0, "377ABCAF271C", "7z", 0), (0, "526172211A07", "rar", 0), (0, "53514C69746520666F726D6174203300", "sqlite", 0), (0, "7F454C46", "elf", 1), (0, "4D5A", "pe", 1),
    (0, "CAFEBABE", "java_class_or_macho_fat", 1), (0, "FEEDFACE", "mach_o", 1), (0, "FEEDFACF", "mach_o", 1), (0, "CFFAEDFE", "mach_o", 1), (4, "66747970", "mp4_family", 0),
)
PACKED, PACKED_FROM = 7.5, 4096  # entropy above which, and bytes from which, contents count as packed or encrypted


def detect(content: Column) -> tuple[Column, Column]:
    """(format, does it run) by first bytes; '' and false for none of the known."""
    label = runs = None
    for at, prefix, name, exe in SIGNATURES:
        hit = F.hex(F.substring(content, at + 1, len(prefix) // 2)) == prefix
        label = F.when(hit, name) if label is None else label.when(hit, name)
        runs = F.when(hit, bool(exe)) if runs is None else runs.when(hit, bool(exe))
    return label.otherwise(""), runs.otherwise(False)


def byte_entropy(content: Column) -> Column:
    """Bits per byte of a content, from the counts of its hexadecimal pairs."""
    pairs = F.regexp_extract_all(F.hex(content), F.lit(".."), F.lit(0))
    n = F.size(pairs)
    digits = [f"{i:02X}" for i in range(256)]
    counts = F.aggregate(pairs, F.map_from_arrays(F.array(*map(F.lit, digits)), F.array_repeat(F.lit(0), 256)), lambda m, p: F.map_zip_with(m, F.create_map(p, F.lit(1)), lambda _, a, b: a + F.coalesce(b, F.lit(0))))
    share = lambda c: c / F.greatest(n, F.lit(1))
    return F.round(F.aggregate(F.map_values(counts), F.lit(0.0), lambda acc, c: acc - F.when(c > 0, share(c) * F.log2(share(c))).otherwise(0.0)), 4)


def binary_metrics(files: DataFrame, key: str, content: str, entropy: str) -> DataFrame:
    """(key, byte_size, magic_format, is_executable, entropy, is_packed) of contents whose entropy was measured before."""
    label, runs = detect(F.col(content))
    size = F.octet_length(content)
    packed = (F.col(entropy) >= PACKED) & (size > PACKED_FROM)
    return files.where(F.col(content).isNotNull()).select(key, size.alias("byte_size"), label.alias("magic_format"), runs.alias("is_executable"), F.col(entropy).alias("entropy"), packed.alias("is_packed"))


def settings_counts(text: Column) -> dict[str, Column]:
    """Sections in square brackets, and lines that set something with '=' or ':'."""
    count = lambda rx: F.regexp_count(text, F.lit(rx)).cast("double")
    return {"sections": count(r"(?m)^[ \t]*\[[^\]\n]+\]"), "keys": count(r"(?m)^[ \t]*[\w.\-\"']+[ \t]*[=:]")}


def outline(text: Column) -> dict[str, Column]:
    """Layout of Markdown with its table of contents: whether one is headed as such, and links to places in the text itself."""
    count = lambda rx: F.regexp_count(text, F.lit(rx)).cast("double")
    own = {k: v.cast("double") for k, v in S.layout_counts(text).items()}
    return own | {"toc": text.rlike(r"(?im)^#{1,6}\s*(?:table of contents|contents)\s*$|\[\[?toc\]?\]").cast("double"), "inner_links": count(r"\]\(#[^)\n]*\)")}


def family_metrics(texts: DataFrame, key: str, text: str, family: str, kind: str) -> DataFrame:
    """(key, content_family, metric, value): what is counted in a text by its kind: json, csv, xml, markdown or settings; other kinds have
    nothing of their own. One pass: a metric is computed for texts of its kind only."""
    t = F.col(text)
    j, c, m = S.json_metrics(t), csv_shape(t), S.markup_counts(t)
    battery = {
        "json": {"is_valid": j["valid"], "top_keys": j["keys"], "depth": j["depth"], "arrays": j["arrays"], "objects": j["objects"]}, "csv": {"rows": c["rows"], "columns": c["columns"]},
        "xml": {k: m[k] for k in ("tags", "distinct_tags", "depth")}, "markdown": outline(t), "settings": settings_counts(t),
    }
    rows = [F.when(F.col(kind) == k, F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value"))) for k, ms in battery.items() for n, v in ms.items()]
    out = texts.where(t.isNotNull()).select(key, F.col(family).alias("content_family"), F.inline(F.array_compact(F.array(*rows))))
    return out.where(F.col("value").isNotNull())
