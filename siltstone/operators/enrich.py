"""Enrichment of files and documents: families, security flags, documented symbols, summaries, fields and their grounding.

Defined results: null texts have no flags, fields, symbols or summaries; values are cut and masked before they leave a function;
repeated rows of a key are rows of their own unless a docstring says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import scalars as S
from siltstone.operators.concordance import constructs
from siltstone.operators.findings import parse_date, parse_money, summary
from siltstone.session import pick, spread

# Names, categories, severities and formats of what a security scan looks for.
SECURITY = (
    ("private_key_header", "secret", "critical", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----"),
    ("aws_access_key_id", "secret", "critical", r"\bAKIA[0-9A-Z]{16}\b"),
    ("google_api_key", "secret", "high", r"\bAIza[0-9A-Za-z_\-]{35}\b"),
    ("slack_token", "secret", "high", r"\bxox[baprs]-[0-9A-Za-z\-]{10,}\b"),
    ("jwt", "secret", "medium", r"\beyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+"),
    ("generic_secret_assignment", "secret", "high", r"(?i)\b(?:api[_-]?key|secret|token|passwd|password|pwd|access[_-]?key|client[_-]?secret|auth[_-]?token)\b\s*[:=]\s*['\"]?[A-Za-z0-9_\-/+=.]{8,}['\"]?"),
    ("url_with_credentials", "secret", "high", r"\b[a-z][a-z0-9+.\-]*://[^/\s:@]+:[^/\s:@]+@[^\s/]+"),
    ("email", "pii", "low", S.EMAIL),
    ("phone", "pii", "low", r"(?<!\d)\+?\d[\d\s().\-]{9,}\d(?!\d)"),
    ("credit_card", "pii", "high", r"\b(?:\d[ \-]?){13,16}\b"),
    ("ssn", "pii", "high", r"\b\d{3}-\d{2}-\d{4}\b"),
)


def check_digit_holds(value: str) -> bool:
    digits = [int(c) for c in value if c.isdigit()][::-1]
    twice = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)]
    return 13 <= len(digits) <= 19 and sum(twice) % 10 == 0


def masked(value: str, keep: int = 4) -> str:
    """The first ``keep`` characters, and a star for each of up to twelve more; short values are stars only."""
    v = value.strip()
    return "*" * len(v) if len(v) <= keep else v[:keep] + "*" * min(12, len(v) - keep)


def security_flags(texts: DataFrame, key: str = "file_id", text: str = "text", most: int | None = None) -> DataFrame:
    """(key, category, pattern_name, severity, line, evidence): what a text shows of secrets and personal data, masked.

    Patterns are taken in their order, and with ``most`` only the first so many findings of a text are kept."""
    compiled = [(n, c, s, re.compile(rx)) for n, c, s, rx in SECURITY]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b[key], b[text]):
                mine: list[tuple] = []
                for n, c, s, rx in compiled:
                    at = line = 0
                    for m in rx.finditer(t):
                        if n == "credit_card" and not check_digit_holds(m.group()):
                            continue
                        line += t.count("\n", at, m.start())
                        at = m.start()
                        mine.append((k, c, n, s, line + 1, masked(m.group())))
                out += mine if most is None else mine[:most]
            yield pd.DataFrame(out, columns=[key, "category", "pattern_name", "severity", "line", "evidence"])

    d = pick(texts, key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    return spread(d, key).mapInPandas(run, f"{key} {dict(d.dtypes)[key]}, category string, pattern_name string, severity string, line int, evidence string")


DEFINING = ("function", "class", "method", "interface", "struct", "enum", "fn", "func", "def", "type", "trait", "module", "struct_enum")


def symbol_docs(texts: DataFrame, key: str = "file_id", text: str = "text", extension: str = "extension") -> DataFrame:
    """(key, symbol_kind, line, has_doc): functions and types of sources, each with its own kind of symbol, and whether a comment stands
    right above it (a line that begins with #, //, * or --)."""
    found = constructs(texts, key, text, extension).where((F.col("kind") == "definition") & F.col("construct_name").isin(*DEFINING)).select(key, F.col("construct_name").alias("symbol_kind"), "line").distinct()
    # every line with a comment, by the line it stands above
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("at", "body")).where(F.col("body").rlike(r"^\s*(?:#|//|\*|--)")).select(key, (F.col("at") + 2).alias("line"), F.lit(1).alias("doc")).distinct()
    return found.join(lines, [key, "line"], "left").select(key, "symbol_kind", "line", F.coalesce("doc", F.lit(0)).alias("has_doc"))


# Words that tell nothing about a text.
STOP_WORDS = tuple("a an and are as at be but by for from has have if in into is it its no not of on or such that the their then there these they this to was we were which will with you your".split())


def term_counts(texts: DataFrame, key: str, text: str, most: int = 20, shortest: int = 3) -> DataFrame:
    """(key, rank, term, n): the ``most`` frequent terms of every text; counted by rows, so that long texts take no more than their length."""
    w = texts.select(key, F.explode(S.words(F.col(text))).alias("term")).where((F.length("term") >= shortest) & ~F.col("term").isin(*STOP_WORDS))
    top = w.groupBy(key, "term").agg(F.count("*").alias("n")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("term"), F.col("n")))).alias("top"))  # of one text
    return top.select(key, F.posexplode(F.slice("top", 1, most)).alias("at", "x")).select(key, (F.col("at") + 1).alias("rank"), "x.term", "x.n")


def summaries(texts: DataFrame, key: str, text: str, family: Column) -> DataFrame:
    """(key, content_family, method, summary, purpose, tags): a text's first lines that say something, its five most frequent terms of
    four letters and more, and what it is for by its family and the first of these."""
    d = texts.where(F.col(text).isNotNull())
    tags = term_counts(d, key, text, 5, 4).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t")).select(key, F.transform("t", lambda x: x["term"]).alias("tags"))
    own = d.select(key, family.alias("content_family"), F.lit("extractive").alias("method"), summary(F.col(text)).alias("summary"))
    out = own.join(tags, key, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return out.select(key, "content_family", "method", "summary", F.concat_ws(" on ", "content_family", F.get("tags", F.lit(0))).alias("purpose"), "tags")


def text_metrics(text: Column) -> dict[str, Column]:
    """Generic metrics of a text; lines as Python's splitlines has them: ended by line feeds, carriage returns and the other separators,
    and no empty one at the end."""
    ends = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
    ls = F.split(F.regexp_replace(text, rf"(?:{ends})\z", ""), ends)
    ls = F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(ls)
    n = F.size(ls)
    lens = F.transform(ls, F.length)
    count = lambda f: F.size(F.filter(ls, f))
    share = lambda x: F.when(n > 0, F.round(x / n, 4)).otherwise(0.0)
    return {
        "byte_size": F.octet_length(text), "line_count": n, "char_count": F.length(text), "blank_line_ratio": share(count(lambda x: F.trim(x) == "")), "max_line_len": F.coalesce(F.array_max(lens), F.lit(0)),
        "avg_line_len": share(F.aggregate(lens, F.lit(0), lambda a, x: a + x)), "long_line_count": count(lambda x: F.length(x) > 120), "trailing_ws_lines": count(lambda x: x.rlike(r"[ \t]$")),
        "tab_indent_lines": count(lambda x: x.startswith("\t")), "space_indent_lines": count(lambda x: x.startswith(" ")), "todo_count": F.regexp_count(text, F.lit(r"\b(?:TODO|FIXME|XXX|HACK)\b")),
        "has_bom": text.startswith("\ufeff").cast("int"), "ends_with_newline": text.endswith("\n").cast("int"), "non_ascii_ratio": F.when(F.length(text) > 0, F.round(F.regexp_count(text, F.lit(r"[^\x00-\x7f]")) / F.length(text), 4)).otherwise(0.0),
    }


# what a document is, by the first of these that it shows
DOCUMENT_TYPES = (("log", r"(?m)^\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d"), ("changelog", r"(?i)\bchange ?log\b|\bfixed in\b|\bversion \d"), ("thread", r"(?m)^>|(?i)\bwrote:|^re:"), ("markup", r"(?m)^#{1,6} "), ("code", r"```|(?m)^    \S"), ("notes", r"(?m)^\s*[-*] "))
FIELDS = ("email", "url", "date_iso", "money", "percent", "ipv4")


def classify(text: Column) -> Column:
    out = None
    for name, rx in DOCUMENT_TYPES:
        out = F.when(text.rlike(rx), name) if out is None else out.when(text.rlike(rx), name)
    return out.otherwise("prose")


def fields(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, field_name, raw_value, normalized_value, confidence, needs_review): values found in documents; one that can be read as what
    it is has a confidence of 0.9, others of 0.5, and these are to be reviewed."""
    e = documents.select(key, F.inline(S.entities(F.col(text)))).where(F.col("category").isin(*FIELDS))
    v = F.col("value")
    normal = (
        F.when(F.col("category") == "date_iso", F.date_format(parse_date(v), "yyyy-MM-dd")).when(F.col("category") == "money", parse_money(F.regexp_replace(v, r"[^\d.,$\- ]", "")).cast("string"))
        .when(F.col("category") == "url", F.nullif(S.url_domain(v), F.lit(""))).otherwise(F.lower(v))
    )
    sure = F.when(normal.isNotNull(), 0.9).otherwise(0.5)
    return e.select(key, F.col("category").alias("field_name"), v.alias("raw_value"), normal.alias("normalized_value"), sure.alias("confidence"), (sure < 0.6).cast("int").alias("needs_review"))


REPAIRS = (("line_ends", "\r\n", "\n"), ("soft_hyphens", "\u00ad", ""), ("zero_bytes", "\u0000", ""), ("tabs", "\t", "    "), ("trailing_blanks", r" +(?=\n|$)", ""))


def repair(documents: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(documents with repaired texts, events (key, iteration, action, outcome)): the bounded loop of repairs, one after the other; each
    is an iteration that says whether it changed the text."""
    d, events = documents.select(key, text), []
    cols = [F.col(text)]
    for _, rx, to in REPAIRS:
        cols.append(F.regexp_replace(cols[-1], rx, to))
    steps = F.array(*[F.struct(F.lit(i).alias("iteration"), F.lit(n).alias("action"), F.when(cols[i - 1] == cols[i], "unchanged").otherwise("repaired").alias("outcome")) for i, (n, _, _) in enumerate(REPAIRS, 1)])
    events = d.where(F.col(text).isNotNull()).select(key, F.inline(steps))
    return d.select(key, cols[-1].alias(text)), events


def checks(documents: DataFrame, key: str, text: str, language: str, size: str) -> DataFrame:
    """(key, check_type, status, severity): what is missing or contradicts itself in a document."""
    t, blank = F.col(text), F.coalesce(F.trim(F.col(text)) == "", F.lit(True))
    rules = [("missing_text", blank, "high"), ("missing_language", F.col(language).isNull(), "low"), ("size_contradicts", ~F.coalesce(F.col(size) == F.length(t), F.lit(False)), "medium"), ("mixed_line_ends", F.coalesce(t.rlike(r"\r\n") & t.rlike(r"(?:^|[^\r])\n"), F.lit(False)), "low")]
    return documents.select(key, F.inline(F.array(*[F.struct(F.lit(n).alias("check_type"), F.when(bad, "fail").otherwise("pass").alias("status"), F.lit(s).alias("severity")) for n, bad, s in rules])))
