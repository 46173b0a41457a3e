"""Quality findings, short summaries, scripts, and values in free form, as columns over texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.scalars import sentiment

# Thresholds of the quality rules, and the formats in which dates are tried, in this order.
LONG_LINE, HUGE = 120, 1_000_000
DATES = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "yyyy/MM/dd")
# Unicode scripts by family, in the order in which equal counts are decided.
SCRIPTS = {"Latin": "IsLatin", "Cyrillic": "IsCyrillic", "Greek": "IsGreek", "Arabic": "IsArabic", "Hebrew": "IsHebrew", "CJK": "IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul", "Devanagari": "IsDevanagari"}


def quality_findings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rule, severity, n): six rules on the lines of every text; a text without a finding has no row."""
    t = F.regexp_replace(F.col(text), "\r\n?", "\n")
    ls = F.split(t, "\n")
    n = lambda f: F.size(F.filter(ls, f))
    tabs, blanks = n(lambda x: x.startswith("\t")), n(lambda x: x.startswith(" "))
    # fixed values: the names and severities of the rules
    rules = [
        ("long_lines", "info", n(lambda x: F.length(x) > LONG_LINE)),
        ("trailing_whitespace", "info", n(lambda x: x.rlike(r"[ \t]+$"))),
        ("mixed_indentation", "warning", F.when((tabs > 0) & (blanks > 0), tabs + blanks).otherwise(0)),
        ("oversized_file", "warning", F.when(F.octet_length(text) > HUGE, F.octet_length(text)).otherwise(0)),
        ("missing_trailing_newline", "info", F.when((F.length(t) > 0) & ~t.endswith("\n"), 1).otherwise(0)),
        ("todo_markers", "info", F.regexp_count(t, F.lit(r"\b(?:TODO|FIXME|XXX|HACK)\b"))),
    ]
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), c.cast("long").alias("n")) for r, s, c in rules])
    return texts.where(F.col(text).isNotNull()).select(key, F.inline(rows)).where("n > 0")


def summary(text: Column) -> Column:
    """The first three lines that say something, without comment marks and imports; 280 characters at most."""
    ls = F.transform(F.split(text, r"\r\n?|\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[#/*<!\-;% ]+", "")))
    return F.substring(F.array_join(F.slice(F.filter(ls, lambda x: (x != "") & ~x.rlike(r"^(?:import|from|package|using) ")), 1, 3), " "), 1, 280)


def dominant_script(text: Column) -> Column:
    """The script of most letters; 'unknown' without letters of a known one."""
    counts = F.array(*[F.regexp_count(text, F.lit(f"[\\p{{{p}}}]")) for p in SCRIPTS.values()])
    best = F.array_max(counts)
    return F.when(best > 0, F.element_at(F.array(*map(F.lit, SCRIPTS)), F.array_position(counts, best).cast("int"))).otherwise("unknown")


def parse_money(value: Column) -> Column:
    """The first amount in a value: groups of digits with commas or blanks between them, or digits; a sign before, a fraction behind."""
    digits = F.regexp_extract(value, r"([+-]?)\s*[$€£¥]?\s*(\d{1,3}(?:[, ]\d{3})+|\d+)((?:\.\d+)?)", 0)
    return F.regexp_replace(digits, r"[$€£¥,\s]", "").try_cast("double")


def parse_date(value: Column) -> Column:
    """The first of eight formats that fits, then ISO with a time."""
    v = F.trim(value)
    return F.coalesce(*[F.try_to_timestamp(v, F.lit(f)) for f in DATES], F.try_to_timestamp(v))


def validate(df: DataFrame, key: str, rules: list[dict]) -> DataFrame:
    """(key, field, rule): every rule that a row breaks, in one pass.

    A rule is {'field', 'rule', ...} with rule one of required, type ('value': a Spark type), format ('value': date, money, mail),
    enum ('value': list), regex ('value'), reference ('value': an array column), sum ('value': fields that must add up to
    the field within 0.02), before ('value': a field whose date must not be earlier), range ('low', 'high'). Only
    'required' looks at missing values; the others leave them alone."""
    tests = []
    for r in rules:
        c, kind, v = F.col(r["field"]), r["rule"], r.get("value")
        text = c.cast("string")
        if kind == "required":
            bad = c.isNull() | (F.trim(text) == "")
        elif kind == "type":
            bad = c.isNotNull() & text.try_cast(v).isNull()
        elif kind == "format":
            ok = {"date": lambda: parse_date(text).isNotNull(), "money": lambda: parse_money(text).isNotNull(), "mail": lambda: text.rlike(r"^[\w.+-]+@[\w-]+\.[\w.-]+$")}[v]()
            bad = c.isNotNull() & ~ok
        elif kind == "enum":
            bad = ~c.isin(*v)
        elif kind == "regex":
            bad = ~text.rlike(v)
        elif kind == "reference":
            bad = ~F.array_contains(F.col(v), c)
        elif kind == "sum":
            bad = F.abs(parse_money(text) - sum((F.coalesce(parse_money(F.col(f).cast("string")), F.lit(0.0)) for f in v), F.lit(0.0))) > 0.02
        elif kind == "before":
            bad = parse_date(text) > parse_date(F.col(v).cast("string"))
        elif kind == "range":
            n = parse_money(text)
            bad = (n < r.get("low", float("-inf"))) | (n > r.get("high", float("inf")))
        else:
            raise ValueError(f"no rule {kind}")
        tests.append(F.when(bad, F.struct(F.lit(r["field"]).alias("field"), F.lit(kind).alias("rule"))))
    return df.select(key, F.inline(F.array_compact(F.array(*tests))))


def attach_moods(sessions: DataFrame, prompts: DataFrame) -> DataFrame:
    """sessions (project, ts, session_id) with (label, confidence) of the first prompt (project, ts, text) after each, if it
    comes before the next session; sessions without one stay 'pending'."""
    s = sessions.select("project", "ts", "session_id", F.lit(0).alias("o"), F.lit(None).cast("string").alias("text"))
    p = prompts.select("project", "ts", F.lit(None).cast(dict(sessions.dtypes)["session_id"]).alias("session_id"), F.lit(1).alias("o"), "text")
    w = Window.partitionBy("project").orderBy("ts", "o")
    nxt = s.unionByName(p).withColumn("next_text", F.lead("text").over(w)).withColumn("next_o", F.lead("o").over(w)).where("o = 0")
    label, sure = sentiment(F.col("next_text"))
    has = F.col("next_o") == 1
    return nxt.select("project", "ts", "session_id", F.when(has, label).otherwise("pending").alias("label"), F.when(has, sure).alias("confidence"))
