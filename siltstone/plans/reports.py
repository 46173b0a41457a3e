"""Reports over the tables that the repository's own operators fill, and their SQL, which was written on its own and reads the same
parquet tables. Each stands for one of the views of concordance, documents, dynamic layer, evaluation, enrichment and monitor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import scalars as S
from siltstone.operators import concordance as C
from siltstone.operators import enrich as E
from siltstone.operators import matching as M
from siltstone.operators.findings import quality_findings
from siltstone.session import table

QUERIES: dict = {}
ORACLE: dict = {}


def view(name: str, sql: str | None = None):
    def add(f):
        QUERIES[f"view_{name}"] = f
        if sql:
            ORACLE[f"view_{name}"] = sql
        return f

    return add


# -- tables ---------------------------------------------------------------------------------------------------------------
def sources(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, file_name, extension, location_key, text): texts with what is known of their files; one row per text."""
    f = table(spark, d, "file_details").where("file_id is not null").groupBy("file_id").agg(F.max("file_name").alias("file_name"), F.max("file_extension_id").alias("extension_id"))
    x = table(spark, d, "file_extensions").select("extension_id", F.col("extension_name").alias("extension"))
    k = table(spark, d, "token_locations").groupBy(F.expr("try_cast(substring_index(location_key, ':', -1) as bigint)").alias("file_id")).agg(F.min("location_key").alias("location_key"))
    return table(spark, d, "file_texts").join(f, "file_id", "left").join(x, "extension_id", "left").join(k, "file_id", "left").select("file_id", "file_name", "extension", "location_key", "text")


def names_of(s: DataFrame) -> DataFrame:
    return s.select("file_id", "file_name", "location_key", C.content_family(F.col("extension")).alias("content_family"))


def token_rows(spark, d) -> DataFrame:
    return C.concordance(table(spark, d, "file_texts"))


def grep_matches(spark, d) -> DataFrame:
    s = sources(spark, d)
    p = table(spark, d, "grep_pattern_catalog").select("pattern_id", "pattern_name", "category", "is_sensitive", "regex")
    pats = [(r["pattern_id"], r["regex"]) for r in p.collect()]  # a catalogue of fixed size
    return C.pattern_matches(s, pats).join(F.broadcast(p.drop("regex")), "pattern_id").join(names_of(s), "file_id")


def language_constructs(spark, d) -> DataFrame:
    s = sources(spark, d)
    return C.constructs(s).join(names_of(s).select("file_id", "location_key"), "file_id")


def pattern_counts(m: DataFrame, *keys: str) -> DataFrame:
    return m.groupBy("location_key", "file_id", *keys).agg(F.count("*").alias("match_count"))


# -- SQL of the tables ------------------------------------------------------------------------------------------------------
_FAMILY = "CASE " + " ".join(f"WHEN ext IN ({', '.join(repr(x) for x in names.split())}) THEN '{family}'" for family, names in C.FAMILIES.items() if names) + " ELSE 'misc' END"
_SRC = f"""src AS (SELECT file_id, file_name, ext, location_key, text, {_FAMILY} AS content_family FROM (SELECT t.file_id, f.file_name, ltrim(lower(extension_name), '.') AS ext, k.location_key, t.text FROM file_texts t
  LEFT JOIN (SELECT file_id, max(file_name) AS file_name, max(file_extension_id) AS e FROM file_details GROUP BY 1) f ON f.file_id = t.file_id LEFT JOIN file_extensions x ON x.extension_id = f.e
  LEFT JOIN (SELECT try_cast(split_part(location_key, ':', 2) AS bigint) AS file_id, min(location_key) AS location_key FROM token_locations GROUP BY 1) k ON k.file_id = t.file_id)),
line AS (SELECT file_id, location_key, content_family, ext, rtrim(unnest(string_split(text, chr(10))), chr(13)) AS body, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM src)"""
_TOK = """word AS (SELECT file_id, left(lower(unnest(regexp_extract_all(body, '[\\p{L}\\p{M}\\p{N}_]+'))), 120) AS token, 'word' AS token_kind FROM line),
tok AS (SELECT * FROM word UNION ALL SELECT file_id, token, 'string' FROM (SELECT file_id, unnest(regexp_extract_all(body, '"[^"]*"|''[^'']*''')) AS q, q[2:-2] AS token FROM line) WHERE token <> '')"""
_GREP = """hit AS (SELECT file_id, location_key, content_family, pattern_id, pattern_name, category, is_sensitive, line, regexp_extract_all(body, regex) AS ms, string_split_regex(body, regex) AS ps FROM line JOIN grep_pattern_catalog ON regexp_matches(body, regex)),
g AS (SELECT * EXCLUDE (ms, ps), left(ms[k], 240) AS match_text, list_sum(list_transform(ps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k-1], lambda x: length(x))), 0) AS start_col, length(ms[k]) AS n FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM hit) WHERE ms[k] <> '')"""
_LANG = (
    "lang(language, ext) AS (VALUES " + ", ".join(f"('{lang}', '{x}')" for lang, xs in C.LANGUAGES.items() for x in xs.split()) + "), con(language, construct_name, kind, rx) AS (VALUES "
    + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in c[1:]) + ")" for c in C.CATALOGUE) + "), l AS (SELECT line.*, language, construct_name, kind, unnest(regexp_extract_all(body, rx)) AS m FROM line JOIN lang USING (ext) JOIN con USING (language) WHERE regexp_matches(body, rx)), c AS (SELECT * FROM l WHERE m <> '')"
)


# -- concordance ------------------------------------------------------------------------------------------------------------
@view("token_frequency", f"WITH {_SRC}, {_TOK} SELECT token, token_kind, count(*) AS occurrence_count, count(DISTINCT file_id) AS file_count FROM tok WHERE token_kind = 'word' GROUP BY 1, 2")
def token_frequency(spark, d):
    return C.registry(token_rows(spark, d).where("token_kind = 'word'")).select("token", "token_kind", "occurrence_count", "file_count").orderBy(F.desc("occurrence_count"), "token")


@view("char_frequency", "SELECT ch AS character, count(*) AS occurrence_count, count(DISTINCT file_id) AS file_count FROM (SELECT file_id, unnest(string_split(text, '')) AS ch FROM file_texts) WHERE NOT regexp_matches(ch, '^[\\s\\p{Z}\\x{85}\\x{1c}-\\x{1f}]$') AND ch <> '' GROUP BY 1")
def char_frequency(spark, d):
    c = C.characters(table(spark, d, "file_texts"))
    return c.groupBy("character").agg(F.sum("n").alias("occurrence_count"), F.count("*").alias("file_count")).orderBy(F.desc("occurrence_count"), "character")


@view("token_file_spread", f"WITH {_SRC}, {_TOK} SELECT token, token_kind, count(DISTINCT file_id) AS file_count, count(*) AS occurrence_count FROM tok GROUP BY 1, 2 HAVING count(DISTINCT file_id) > 1")
def token_file_spread(spark, d):
    return C.registry(token_rows(spark, d)).where("file_count > 1").select("token", "token_kind", "file_count", "occurrence_count").orderBy(F.desc("file_count"), F.desc("occurrence_count"), "token", "token_kind")


_LOCATIONS = f"WITH {_SRC}, {_TOK}, r AS (SELECT location_key, src.file_id, content_family, n AS occurrence_count FROM src JOIN (SELECT file_id, count(*) AS n FROM tok GROUP BY 1) USING (file_id))"


def locations(spark, d) -> DataFrame:
    return C.locations_of(token_rows(spark, d), sources(spark, d).select("file_id", "location_key", "extension"))


@view("location_summary", f"{_LOCATIONS} SELECT * FROM r")
def location_summary(spark, d):
    return locations(spark, d).orderBy(F.desc("occurrence_count"), "file_id")


@view("files_by_family", f"{_LOCATIONS} SELECT coalesce(content_family, 'other') AS content_family, count(*) AS file_count, sum(occurrence_count) AS occurrence_count FROM r GROUP BY 1")
def files_by_family(spark, d):
    family = F.coalesce("content_family", F.lit("other")).alias("content_family")
    return locations(spark, d).groupBy(family).agg(F.count("*").alias("file_count"), F.sum("occurrence_count").alias("occurrence_count")).orderBy(F.desc("file_count"), F.desc("occurrence_count"), "content_family")


@view("grep_by_pattern", f"WITH {_SRC}, {_GREP} SELECT pattern_name, category, is_sensitive, count(*) AS match_count, count(DISTINCT location_key) AS file_count FROM g GROUP BY 1, 2, 3")
def grep_by_pattern(spark, d):
    return grep_matches(spark, d).groupBy("pattern_name", "category", "is_sensitive").agg(F.count("*").alias("match_count"), F.count_distinct("location_key").alias("file_count")).orderBy(F.desc("match_count"), "pattern_name")


@view("grep_by_category", f"WITH {_SRC}, {_GREP} SELECT category, count(*) AS match_count, count(DISTINCT location_key) AS file_count, count(DISTINCT pattern_name) AS pattern_count FROM g GROUP BY 1")
def grep_by_category(spark, d):
    m = grep_matches(spark, d)
    return m.groupBy("category").agg(F.count("*").alias("match_count"), F.count_distinct("location_key").alias("file_count"), F.count_distinct("pattern_name").alias("pattern_count")).orderBy(F.desc("match_count"), "category")


@view("grep_secrets", f"WITH {_SRC}, {_GREP} SELECT location_key, file_id, content_family, pattern_name, line::int AS line, start_col::int AS start_col, (start_col + n)::int AS end_col, match_text FROM g WHERE is_sensitive = 1")
def grep_secrets(spark, d):
    return grep_matches(spark, d).where("is_sensitive = 1").select("location_key", "file_id", "content_family", "pattern_name", "line", "start_col", "end_col", "match_text").orderBy("location_key", "line", "start_col", "pattern_name", "file_id")


@view("grep_files_at_risk", f"WITH {_SRC}, {_GREP} SELECT location_key, file_id, content_family, count(*) AS secret_hits, count(DISTINCT pattern_name) AS secret_patterns FROM g WHERE is_sensitive = 1 GROUP BY 1, 2, 3")
def grep_files_at_risk(spark, d):
    m = grep_matches(spark, d).where("is_sensitive = 1")
    return m.groupBy("location_key", "file_id", "content_family").agg(F.count("*").alias("secret_hits"), F.count_distinct("pattern_name").alias("secret_patterns")).orderBy(F.desc("secret_hits"), "file_id")


@view("grep_file_detail", f"WITH {_SRC}, {_GREP} SELECT location_key, file_id, content_family, category, pattern_name, count(*) AS match_count FROM g GROUP BY 1, 2, 3, 4, 5")
def grep_file_detail(spark, d):
    return pattern_counts(grep_matches(spark, d), "content_family", "category", "pattern_name").orderBy("location_key", "category", "pattern_name", "file_id")


@view("lang_by_construct", f"WITH {_SRC}, {_LANG} SELECT language, construct_name, kind, count(*) AS match_count, count(DISTINCT location_key) AS file_count FROM c GROUP BY 1, 2, 3")
def lang_by_construct(spark, d):
    return language_constructs(spark, d).groupBy("language", "construct_name", "kind").agg(F.count("*").alias("match_count"), F.count_distinct("location_key").alias("file_count")).orderBy(F.desc("match_count"), "language", "construct_name")


@view("lang_by_language", f"WITH {_SRC}, {_LANG} SELECT language, count(*) AS construct_count, count(DISTINCT location_key) AS file_count, count(DISTINCT construct_name) AS construct_types FROM c GROUP BY 1")
def lang_by_language(spark, d):
    c = language_constructs(spark, d)
    return c.groupBy("language").agg(F.count("*").alias("construct_count"), F.count_distinct("location_key").alias("file_count"), F.count_distinct("construct_name").alias("construct_types")).orderBy(F.desc("construct_count"), "language")


@view("lang_by_kind", f"WITH {_SRC}, {_LANG} SELECT language, kind, count(*) AS match_count, count(DISTINCT location_key) AS file_count FROM c GROUP BY 1, 2")
def lang_by_kind(spark, d):
    return language_constructs(spark, d).groupBy("language", "kind").agg(F.count("*").alias("match_count"), F.count_distinct("location_key").alias("file_count")).orderBy(F.desc("match_count"), "language", "kind")


@view("file_language", f"WITH {_SRC}, {_LANG} SELECT location_key, file_id, language, count(*) AS construct_total, count(DISTINCT construct_name) AS construct_types FROM c GROUP BY 1, 2, 3")
def file_language(spark, d):
    c = pattern_counts(language_constructs(spark, d), "language", "construct_name")
    return c.groupBy("location_key", "file_id", "language").agg(F.sum("match_count").alias("construct_total"), F.count_distinct("construct_name").alias("construct_types")).orderBy(F.desc("construct_total"), "file_id", "language")


@view("lang_file_detail", f"WITH {_SRC}, {_LANG} SELECT location_key, file_id, language, kind, construct_name, count(*) AS match_count FROM c GROUP BY 1, 2, 3, 4, 5")
def lang_file_detail(spark, d):
    return pattern_counts(language_constructs(spark, d), "language", "kind", "construct_name").orderBy("location_key", "kind", "construct_name", "file_id")


# -- documents --------------------------------------------------------------------------------------------------------------
def documents(spark, d) -> DataFrame:
    """Documents with the name of the file they tell of: few name one, and file_id is null in the others, so these keep out of the join."""
    names = table(spark, d, "file_details").where("file_id is not null").groupBy("file_id").agg(F.max("file_name").alias("file_name"))
    x = table(spark, d, "documents").withColumnRenamed("doc_id", "document_id")
    return x.where("file_id is not null").join(names, "file_id", "left").unionByName(x.where("file_id is null").withColumn("file_name", F.lit(None).cast("string")))


_DOC = "doc AS (SELECT doc_id AS document_id, file_name, text, lang, n_chars FROM documents d LEFT JOIN (SELECT file_id, max(file_name) AS file_name FROM file_details GROUP BY 1) f ON f.file_id = d.file_id)"
_URL = "(?i)\\bhttps?://[^\\s<>\"'')]+"


@view("active_content_risk", f"WITH {_DOC}, m AS (SELECT document_id, file_name, regexp_matches(text, '(?i)<script|javascript:|/JavaScript')::int AS has_javascript, regexp_matches(text, '/OpenAction|(?i)\\bonload\\s*=')::int AS has_openaction, regexp_matches(text, 'vbaProject|AutoOpen|Auto_Open')::int AS macro_present, len(regexp_extract_all(text, '{_URL}')) AS url_count, regexp_matches(text, '/Encrypt\\b|BEGIN PGP MESSAGE')::int AS encrypted FROM doc) SELECT * FROM m WHERE has_javascript = 1 OR has_openaction = 1 OR macro_present = 1")
def active_content_risk(spark, d):
    t = F.col("text")
    flag = lambda rx: t.rlike(rx).cast("int")
    m = documents(spark, d).select(
        "document_id", "file_name", flag(r"(?i)<script|javascript:|/JavaScript").alias("has_javascript"), flag(r"/OpenAction|(?i)\bonload\s*=").alias("has_openaction"), flag(r"vbaProject|AutoOpen|Auto_Open").alias("macro_present"),
        F.regexp_count(t, F.lit(S.ENTITIES["url"])).cast("long").alias("url_count"), flag(r"/Encrypt\b|BEGIN PGP MESSAGE").alias("encrypted"),
    )
    return m.where("has_javascript = 1 OR has_openaction = 1 OR macro_present = 1")


_READ = f"""{_DOC}, w AS (SELECT document_id, file_name, regexp_extract_all(lower(text), '\\p{{L}}[\\p{{L}}\\p{{M}}]*(?:[''’\\-]\\p{{L}}[\\p{{L}}\\p{{M}}]*)*') AS w, greatest(len(list_filter(string_split_regex(regexp_replace(trim(text, ' '), '([.!?…]["”’'')\\]]*)\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ') <> '')), 1) AS ns FROM doc WHERE text IS NOT NULL),
y AS (SELECT *, list_transform(w, lambda x: (CASE WHEN regexp_replace(x, '[^a-z]', '', 'g') = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(regexp_replace(x, '[^a-z]', '', 'g'), '[aeiouy]+')) - CASE WHEN x LIKE '%e' AND ends_with(regexp_replace(x, '[^a-z]', '', 'g'), 'e') AND len(regexp_extract_all(regexp_replace(x, '[^a-z]', '', 'g'), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) END)) AS syl FROM w),
q AS (SELECT document_id, file_name, len(w) AS n, ns, coalesce(list_sum(syl), 0) AS sy, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS ch, len(list_filter(syl, lambda x: x >= 3)) AS cx FROM y)"""


def readability_of(spark, d) -> DataFrame:
    """(document_id, file_name, formula, score): six formulas of every document, over words with letters only."""
    w, s = S.letter_words(F.col("text")), S.sentences(F.col("text"))
    x = documents(spark, d).where("text is not null").select("document_id", "file_name", w.alias("w"), F.greatest(F.size(s), F.lit(1)).alias("ns"))
    syl = F.transform("w", S.syllables)
    x = x.select("document_id", "file_name", "ns", F.size("w").alias("n"), F.aggregate(syl, F.lit(0), lambda a, v: a + v).alias("sy"), F.aggregate("w", F.lit(0), lambda a, v: a + F.length(v)).alias("ch"), F.size(F.filter(syl, lambda v: v >= 3)).alias("cx"))
    r = S.readability(*[F.col(c) for c in ("n", "ns", "sy", "ch", "cx")])
    return x.select("document_id", "file_name", F.inline(F.array(*[F.struct(F.lit(k).alias("formula"), v.alias("score")) for k, v in r.items()])))


@view("readability", f"""WITH {_READ}, z AS (SELECT *, n = 0 AS none FROM q), s AS (SELECT document_id, file_name, 'flesch_reading_ease' AS formula, CASE WHEN none THEN 0 ELSE 206.835 - 1.015 * (n / ns) - 84.6 * (sy / n) END AS v FROM z UNION ALL SELECT document_id, file_name, 'flesch_kincaid_grade', CASE WHEN none THEN 0 ELSE 0.39 * (n / ns) + 11.8 * (sy / n) - 15.59 END FROM z
UNION ALL SELECT document_id, file_name, 'gunning_fog', CASE WHEN none THEN 0 ELSE 0.4 * (n / ns + 100.0 * cx / n) END FROM z UNION ALL SELECT document_id, file_name, 'smog', CASE WHEN none THEN 0 ELSE 1.0430 * sqrt(cx * (30.0 / ns)) + 3.1291 END FROM z
UNION ALL SELECT document_id, file_name, 'coleman_liau', CASE WHEN none THEN 0 ELSE 0.0588 * (ch / n) * 100 - 0.296 * ns / n * 100 - 15.8 END FROM z UNION ALL SELECT document_id, file_name, 'automated_readability_index', CASE WHEN none THEN 0 ELSE 4.71 * (ch / n) + 0.5 * (n / ns) - 21.43 END FROM z) SELECT document_id, file_name, formula, round(v, 2) AS score FROM s""")
def readability(spark, d):
    return readability_of(spark, d)


def entity_rows(spark, d) -> DataFrame:
    """(document_id, category, value, valid): entities of documents; valid is 1 where a check or a reading of the value agrees."""
    return E.fields(documents(spark, d), "document_id", "text").select("document_id", F.col("field_name").alias("category"), F.col("raw_value").alias("value"), (1 - F.col("needs_review")).alias("valid"))


def _entity_sql() -> str:
    q = lambda rx: rx.replace("'", "''")
    parts = [f"SELECT document_id, '{c}' AS category, unnest(list_distinct(regexp_extract_all(text, '{q(S.ENTITIES[c])}'))) AS v FROM doc" for c in E.FIELDS]
    return f"{_DOC}, ent AS ({' UNION ALL '.join(parts)})"


@view("entity_counts", f"WITH {_entity_sql()} SELECT document_id, category, count(*) AS n, sum(CASE WHEN category = 'date_iso' THEN (try_cast(v AS date) IS NOT NULL)::int ELSE 1 END) AS n_valid FROM ent GROUP BY 1, 2")
def entity_counts(spark, d):
    return entity_rows(spark, d).groupBy("document_id", "category").agg(F.count("*").alias("n"), F.sum("valid").alias("n_valid"))


def chunks(spark, d, size: int = 256, step: int = 224) -> DataFrame:
    """(document_id, ordinal, token_count, starts_mid_sentence): windows of ``size`` tokens every ``step``; one starts in the middle of a
    sentence if the token before it ends none."""
    words = F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f\x0b]+"), F.lit(0))
    x = documents(spark, d).select("document_id", words.alias("w")).where(F.size("w") > 0)
    x = x.select("document_id", "w", F.posexplode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))).alias("ordinal", "start"))
    mid = F.when(F.col("start") == 0, 0).otherwise((~F.get("w", F.col("start") - 1).rlike(r"[.!?]$")).cast("int"))
    return x.select("document_id", "ordinal", F.least(F.lit(size), F.size("w") - F.col("start")).alias("token_count"), mid.alias("starts_mid_sentence"))


@view("chunk_stats", f"""WITH {_DOC}, w AS (SELECT document_id, regexp_extract_all(text, '[^\\s]+') AS w FROM doc), c AS (SELECT document_id, w, unnest(range(0, len(w), 224)) AS s FROM w WHERE len(w) > 0)
SELECT document_id, count(*) AS chunk_count, round(avg(least(256, len(w) - s)), 6) AS avg_tokens, min(least(256, len(w) - s))::int AS min_tokens, max(least(256, len(w) - s))::int AS max_tokens, sum(CASE WHEN s > 0 AND NOT regexp_matches(w[s], '[.!?]$') THEN 1 ELSE 0 END) AS mid_sentence_starts FROM c GROUP BY 1""")
def chunk_stats(spark, d):
    n = F.col("token_count")
    return chunks(spark, d).groupBy("document_id").agg(F.count("*").alias("chunk_count"), F.round(F.avg(n), 6).alias("avg_tokens"), F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"), F.sum("starts_mid_sentence").alias("mid_sentence_starts"))


# what is measured of a document, by section, and whether this engine computes it
METRICS = {
    "A1 container": ("byte_size:1 magic_format:1 archive_members:1 page_count:0"), "A2 active content": "has_javascript:1 has_openaction:1 macro_present:1 url_count:1 encrypted:1 embedded_files:0", "A3 metadata": "title:0 author:0 created_at:1 modified_at:1",
    "A4 geometry": "page_width:0 page_height:0 rotation:0", "A5 text layer": "char_count:1 word_count:1 replacement_ratio:1 non_ascii_ratio:1 script:1", "A8 layout": "headings:1 list_items:1 table_rows:1 fences:1", "A9 tables": "html_tables:1 markdown_tables:1 merged_cells:0",
    "A10 forms": "form_count:1 field_count:1", "A11 entities": "email:1 url:1 date:1 money:1 percent:1 ipv4:1", "A12 lexical": "flesch:1 fog:1 smog:1 distinct_words:1 top_terms:1", "A14 forensics": "entropy:1 sha256:1 signature_mismatch:1", "A15 chunks": "chunk_count:1 mid_sentence_starts:1",
}
_METRIC_ROWS = [(s.split(" ")[0], s.split(" ", 1)[1], m.split(":")[0], int(m.split(":")[1])) for s, ms in METRICS.items() for m in ms.split()]
# parts of the dynamic layer, the evaluation and the enrichment: section, title, part, does it need a model, is it computed here
PARTS = {
    "dynamic": (("B1", "classification", "type by rules:0:1 type by model:1:0"), ("B2", "layout repair", "line ends:0:1 soft hyphens:0:1 blanks:0:1"), ("B3", "fields", "patterns:0:1 model:1:0"), ("B5", "reasoning", "missing values:0:1 contradictions:0:1 model:1:0"), ("B6", "loop", "bounded repair:0:1"), ("B7", "grounding", "evidence:0:1 self consistency:1:0")),
    "evaluation": (("C1", "text", "cer:0:1 wer:0:1 bleu:0:1 meteor:0:1 chrf:0:1 rouge:0:1"), ("C2", "structure", "tables:0:1 formulas:0:1 boxes:0:1 reading order:0:1"), ("C3", "answers", "faithfulness:1:1 relevancy:1:1 recall:0:1"), ("C4", "personal data", "strict:0:1 partial:0:1"), ("C5", "calibration", "ece:0:1 aurc:0:1"), ("C6", "operation", "drift:0:1 kpis:0:1")),
    "mcp": (("M1", "metrics", "text:0:1 binary:0:1 family:0:1"), ("M2", "quality", "six rules:0:1"), ("M3", "security", "eleven patterns:0:1"), ("M4", "summaries", "extractive:0:1 model:1:0"), ("M5", "symbols", "documentation:0:1")),
}


def parts(spark, layer: str) -> DataFrame:
    rows = [(s, t, p.strip(), int(m), int(c)) for s, t, ps in PARTS[layer] for p, m, c in (x.rsplit(":", 2) for x in _split(ps))]
    return spark.createDataFrame(rows, "section_id string, section_title string, component string, requires_agent int, computed int")


def _split(ps: str) -> list[str]:
    out, cur = [], []
    for w in ps.split(" "):
        cur.append(w)
        if ":" in w:
            out.append(" ".join(cur))
            cur = []
    return out


def _parts_sql(layer: str, what: str) -> str:
    rows = ", ".join(f"('{s}', '{t}', {int(x.rsplit(':', 2)[1])}, {int(x.rsplit(':', 2)[2])})" for s, t, ps in PARTS[layer] for x in _split(ps))
    return f"WITH p(section_id, section_title, agent, computed) AS (VALUES {rows}) SELECT section_id, section_title, count(*) AS components, {what} FROM p GROUP BY 1, 2"


@view("metric_coverage", "WITH m(section_id, section_title, metric, computed) AS (VALUES " + ", ".join(str(r) for r in _METRIC_ROWS) + ") SELECT section_id, section_title, count(*) AS metrics, sum(computed) AS computed FROM m GROUP BY 1, 2")
def metric_coverage(spark, d):
    m = spark.createDataFrame(_METRIC_ROWS, "section_id string, section_title string, metric string, computed int")
    return m.groupBy("section_id", "section_title").agg(F.count("*").alias("metrics"), F.sum("computed").alias("computed")).orderBy("section_id")


# -- dynamic layer ----------------------------------------------------------------------------------------------------------
_TYPE = "CASE " + " ".join("WHEN regexp_matches(text, '" + rx.replace("(?m)", "(?m)").replace("'", "''") + f"') THEN '{n}'" for n, rx in E.DOCUMENT_TYPES) + " WHEN text IS NULL THEN 'prose' ELSE 'prose' END"


def dynamic_documents(spark, d) -> DataFrame:
    return documents(spark, d).select("document_id", "file_name", E.classify(F.col("text")).alias("doc_type"))


@view("dynamic_review_queue", f"WITH {_entity_sql()}, t AS (SELECT document_id, file_name, {_TYPE} AS doc_type FROM doc) SELECT t.document_id, file_name, doc_type, category AS field_name, v AS raw_value, 0.5 AS confidence, 'pattern' AS extraction_method, v AS evidence_span FROM ent JOIN t USING (document_id) WHERE category = 'date_iso' AND try_cast(v AS date) IS NULL")
def dynamic_review_queue(spark, d):
    f = E.fields(documents(spark, d), "document_id", "text").where("needs_review = 1")
    return f.join(dynamic_documents(spark, d), "document_id", "left").select("document_id", "file_name", "doc_type", "field_name", "raw_value", "confidence", F.lit("pattern").alias("extraction_method"), F.col("raw_value").alias("evidence_span"))


@view("dynamic_grounding", f"""WITH {_entity_sql()}, t AS (SELECT document_id, file_name, {_TYPE} AS doc_type, text FROM doc), f AS (SELECT document_id, count(*) AS n, sum((contains(text, v))::int) AS cited, sum(CASE WHEN category = 'date_iso' AND try_cast(v AS date) IS NULL THEN 0 ELSE 1 END) AS ok FROM ent JOIN t USING (document_id) GROUP BY 1)
SELECT document_id, file_name, doc_type, round(cited / n, 6) AS citation_coverage, round(cited / n, 6) AS evidence_span_match, round(1 - cited / n, 6) AS unsupported_claim_rate, round(cited / n, 6) AS faithfulness, 1.0::double AS self_consistency_agreement, round(ok / n, 6) AS validator_pass_rate FROM f JOIN t USING (document_id)""")
def dynamic_grounding(spark, d):
    docs = documents(spark, d)
    f = E.fields(docs, "document_id", "text").join(docs.select("document_id", "text"), "document_id")
    share = lambda c: F.round(F.sum(c.cast("int")) / F.count("*"), 6)
    cited = F.col("text").contains(F.col("raw_value"))
    g = f.groupBy("document_id").agg(share(cited).alias("citation_coverage"), share(F.col("needs_review") == 0).alias("validator_pass_rate"))
    out = g.join(dynamic_documents(spark, d), "document_id", "left")
    c = F.col("citation_coverage")
    return out.select("document_id", "file_name", "doc_type", c, c.alias("evidence_span_match"), F.round(1 - c, 6).alias("unsupported_claim_rate"), c.alias("faithfulness"), F.lit(1.0).alias("self_consistency_agreement"), "validator_pass_rate")


@view("dynamic_reasoning_issues", f"""WITH {_DOC}, c AS (SELECT document_id, file_name, 'missing_text' AS check_type, 'high' AS severity FROM doc WHERE coalesce(trim(text, ' '), '') = '' UNION ALL SELECT document_id, file_name, 'missing_language', 'low' FROM doc WHERE lang IS NULL
UNION ALL SELECT document_id, file_name, 'size_contradicts', 'medium' FROM doc WHERE n_chars IS DISTINCT FROM length(text) OR text IS NULL UNION ALL SELECT document_id, file_name, 'mixed_line_ends', 'low' FROM doc WHERE regexp_matches(text, '\\r\\n') AND regexp_matches(text, '(?:^|[^\\r])\\n')) SELECT * FROM c""")
def dynamic_reasoning_issues(spark, d):
    docs = documents(spark, d)
    c = E.checks(docs, "document_id", "text", "lang", "n_chars").where("status = 'fail'")
    return c.join(docs.select("document_id", "file_name"), "document_id", "left").select("document_id", "file_name", "check_type", "severity")


@view("dynamic_loop_activity", "SELECT doc_id AS document_id, unnest(['line_ends', 'soft_hyphens', 'zero_bytes', 'tabs', 'trailing_blanks']) AS action, 1::bigint AS n, unnest([1, 2, 3, 4, 5]) AS max_iteration FROM documents WHERE text IS NOT NULL")
def dynamic_loop_activity(spark, d):
    _, events = E.repair(documents(spark, d), "document_id", "text")
    return events.groupBy("document_id", "action").agg(F.count("*").alias("n"), F.max("iteration").alias("max_iteration"))


@view("dynamic_repairs", "SELECT 'line_ends' AS action, count(*) AS documents FROM documents WHERE contains(text, chr(13) || chr(10)) UNION ALL SELECT 'tabs', count(*) FROM documents WHERE contains(text, chr(9)) HAVING count(*) > 0 UNION ALL SELECT 'soft_hyphens', count(*) FROM documents WHERE contains(text, chr(173)) HAVING count(*) > 0 UNION ALL SELECT 'trailing_blanks', count(*) FROM documents WHERE regexp_matches(replace(text, chr(13) || chr(10), chr(10)), ' +(?:\\n|$)') OR regexp_matches(text, chr(9) || '(?:\\r?\\n|$)') HAVING count(*) > 0")
def dynamic_repairs(spark, d):
    """How many documents each repair changes."""
    _, events = E.repair(documents(spark, d), "document_id", "text")
    return events.where("outcome = 'repaired'").groupBy("action").agg(F.count("*").alias("documents"))


_CALLS = "provider string, model string, transport string, task string, status string, error string, prompt_tokens long, completion_tokens long, latency_ms double"
_RULES = [("rules", "builtin", "in_process", 1)]


def provider_usage(spark, calls: DataFrame | None = None, judge: bool = False) -> DataFrame:
    """Providers with what they were asked for: without a network there is the tier of rules only, and calls are none."""
    p = spark.createDataFrame(_RULES, "name string, kind string, transport string, reachable int")
    c = (calls if calls is not None else spark.createDataFrame([], _CALLS)).select(F.col("provider").alias("name"), "status", "prompt_tokens", "completion_tokens", F.lit(1).alias("call"))
    keys = ["name", "kind", "transport", "reachable"]
    if judge:
        p, keys = p.withColumn("is_judge", F.lit(1)), [*keys, "is_judge"]
    zero = lambda x: F.sum(F.coalesce(x, F.lit(0))).cast("long")
    return p.join(c, "name", "left").groupBy(*keys).agg(F.count("call").alias("calls"), F.sum(F.when(F.col("status") == "ok", 1).otherwise(0)).alias("ok_calls"), zero(F.col("prompt_tokens")).alias("prompt_tokens"), zero(F.col("completion_tokens")).alias("completion_tokens"))


_USAGE = "SELECT 'rules' AS name, 'builtin' AS kind, 'in_process' AS transport, 1 AS reachable, {judge} 0::bigint AS calls, 0::bigint AS ok_calls, 0::bigint AS prompt_tokens, 0::bigint AS completion_tokens"


@view("dynamic_provider_usage", _USAGE.format(judge=""))
def dynamic_provider_usage(spark, d):
    return provider_usage(spark)


@view("dynamic_component_coverage", _parts_sql("dynamic", "sum(agent) AS agent_backed"))
def dynamic_component_coverage(spark, d):
    return parts(spark, "dynamic").groupBy("section_id", "section_title").agg(F.count("*").alias("components"), F.sum("requires_agent").alias("agent_backed")).orderBy("section_id")


# -- evaluation -------------------------------------------------------------------------------------------------------------
@view("evaluation_rag_scorecard")
def evaluation_rag_scorecard(spark, d):
    items = table(spark, d, "eval_items").select(F.col("item_id").alias("case_id"), "suite", F.regexp_extract("text", r"([^.]*)$", 1).alias("question"), F.regexp_extract("text", r"^([^.]*\.)", 1).alias("answer"), F.array("text").alias("contexts"), F.col("text").alias("reference"))
    s = M.answer_scores(items).join(items.select("case_id", "suite"), "case_id")
    return s.select(F.col("case_id").alias("case_ref"), F.col("suite").alias("document"), "faithfulness", "answer_relevancy", "context_precision", "context_recall", "factual_correctness", F.col("score").alias("ragas_score"), F.lit("heuristic").alias("judge_method")).orderBy("ragas_score", "case_ref")


# What counts as the truth of each type, as a test of a whole word between blanks.
GOLD = {"email": r"^[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}$", "url": r"^https?://[\w./?=&%#~:-]+$", "date_iso": r"^\d{4}-\d{2}-\d{2}$"}


@view("evaluation_pii_by_type", "WITH w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(text, '\\s+')) AS v FROM documents), gold AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS t, v FROM w WHERE regexp_matches(v, '{rx}')" for k, rx in GOLD.items()) + "), pred AS (" + " UNION ALL ".join(f"SELECT DISTINCT doc_id, '{k}' AS t, unnest(regexp_extract_all(text, '" + S.ENTITIES[k].replace("'", "''") + "')) AS v FROM documents" for k in GOLD) + """),
c AS (SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, coalesce(g.t, p.t) AS t, count(g.v) AS ng, count(p.v) AS np, count(CASE WHEN g.v = p.v THEN 1 END) AS tp FROM gold g FULL JOIN pred p ON g.doc_id = p.doc_id AND g.t = p.t AND g.v = p.v GROUP BY 1, 2),
s AS (SELECT t, ng, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS p, CASE WHEN ng > 0 THEN tp / ng ELSE 1 END AS r FROM c)
SELECT t AS pii_type, 'strict' AS mode, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1, round(avg(CASE WHEN p + r > 0 THEN 5 * p * r / (4 * p + r) ELSE 0 END), 6) AS f2, sum(ng)::bigint AS support FROM s GROUP BY 1""")
def evaluation_pii_by_type(spark, d):
    """How well the entity patterns find values that stand as words of their own, per document and type, then averaged."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    w = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", r"[ \t\n\r\f\x0b]+"))).alias("v"))
    gold = w.select("doc_id", "v", F.explode(F.array_compact(F.array(*[F.when(F.col("v").rlike(rx), k) for k, rx in GOLD.items()]))).alias("t")).withColumn("g", F.lit(1))
    pred = docs.select("doc_id", F.inline(S.entities(F.col("text")))).where(F.col("category").isin(*GOLD)).select("doc_id", F.col("value").alias("v"), F.col("category").alias("t"), F.lit(1).alias("p"))
    c = gold.join(pred, ["doc_id", "t", "v"], "full").groupBy("doc_id", "t").agg(F.count("g").alias("ng"), F.count("p").alias("np"), F.count(F.col("g") + F.col("p")).alias("tp"))
    p, r = F.when(F.col("np") > 0, F.try_divide("tp", "np")).otherwise(0.0), F.when(F.col("ng") > 0, F.try_divide("tp", "ng")).otherwise(1.0)
    s = c.select("t", "ng", p.alias("p"), r.alias("r"))
    f = lambda b: F.coalesce(F.try_divide((1 + b) * F.col("p") * F.col("r"), b * F.col("p") + F.col("r")), F.lit(0.0))
    mean = lambda x: F.round(F.avg(x), 6)
    return s.groupBy(F.col("t").alias("pii_type")).agg(F.first(F.lit("strict")).alias("mode"), mean("p").alias("precision"), mean("r").alias("recall"), mean(f(1)).alias("f1"), mean(f(4)).alias("f2"), F.sum("ng").alias("support"))


@view("evaluation_judge_usage", _USAGE.format(judge="1 AS is_judge,"))
def evaluation_judge_usage(spark, d):
    return provider_usage(spark, judge=True)


@view("evaluation_component_coverage", _parts_sql("evaluation", "sum(agent) AS judge_backed"))
def evaluation_component_coverage(spark, d):
    return parts(spark, "evaluation").groupBy("section_id", "section_title").agg(F.count("*").alias("components"), F.sum("requires_agent").alias("judge_backed")).orderBy("section_id")


# -- enrichment -------------------------------------------------------------------------------------------------------------
def security(spark, d) -> DataFrame:
    return E.security_flags(table(spark, d, "file_texts"))


def _security_sql() -> str:
    q = lambda rx: rx.replace("(?<!\\d)", "").replace("(?!\\d)", "").replace("'", "''")  # noqa: E731  a run of digits and marks starts at its first digit anyway
    luhn = "list_sum(list_transform(list_reverse(string_split(regexp_replace(v, '\\D', '', 'g'), '')), lambda c, i: CASE WHEN i % 2 = 0 THEN (c::int * 2) - CASE WHEN c::int > 4 THEN 9 ELSE 0 END ELSE c::int END)) % 10 = 0 AND length(regexp_replace(v, '\\D', '', 'g')) BETWEEN 13 AND 19"
    rows = " UNION ALL ".join(f"SELECT file_id, '{c}' AS category, '{n}' AS pattern_name, '{s}' AS severity, unnest(regexp_extract_all(text, '{q(rx)}')) AS v FROM src" for n, c, s, rx in E.SECURITY)
    return f"{_SRC}, flag AS (SELECT * FROM ({rows}) WHERE pattern_name <> 'credit_card' OR ({luhn}))"


_SEC = _security_sql()


@view("mcp_security_by_pattern", f"WITH {_SEC} SELECT category, pattern_name, severity, count(*) AS hits, count(DISTINCT file_id) AS files FROM flag GROUP BY 1, 2, 3")
def mcp_security_by_pattern(spark, d):
    return security(spark, d).groupBy("category", "pattern_name", "severity").agg(F.count("*").alias("hits"), F.count_distinct("file_id").alias("files")).orderBy(F.desc("hits"), "pattern_name")


@view("mcp_files_at_risk", f"WITH {_SEC} SELECT s.file_id, s.file_name, s.content_family, count(*) AS flags, sum(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END) AS critical, sum(CASE WHEN severity = 'high' THEN 1 ELSE 0 END) AS high FROM src s JOIN flag USING (file_id) GROUP BY 1, 2, 3")
def mcp_files_at_risk(spark, d):
    n = lambda s: F.sum(F.when(F.col("severity") == s, 1).otherwise(0)).alias(s)
    x = security(spark, d).groupBy("file_id").agg(F.count("*").alias("flags"), n("critical"), n("high"))
    return x.join(names_of(sources(spark, d)).drop("location_key"), "file_id").select("file_id", "file_name", "content_family", "flags", "critical", "high").orderBy(F.desc("critical"), F.desc("high"), F.desc("flags"), "file_id")


_QUAL = """t AS (SELECT file_id, text, replace(text, chr(13) || chr(10), chr(10)) AS x FROM file_texts), q0 AS (SELECT file_id, x, text, string_split(x, chr(10)) AS ls FROM t),
q1 AS (SELECT file_id, x, text, len(list_filter(ls, lambda y: length(y) > 120)) AS a, len(list_filter(ls, lambda y: regexp_matches(y, '[ \\t]+$'))) AS b, len(list_filter(ls, lambda y: starts_with(y, chr(9)))) AS tb, len(list_filter(ls, lambda y: starts_with(y, ' '))) AS sp FROM q0),
qual AS (SELECT file_id, 'long_lines' AS rule, 'info' AS severity FROM q1 WHERE a > 0 UNION ALL SELECT file_id, 'trailing_whitespace', 'info' FROM q1 WHERE b > 0 UNION ALL SELECT file_id, 'mixed_indentation', 'warning' FROM q1 WHERE tb > 0 AND sp > 0 UNION ALL SELECT file_id, 'oversized_file', 'warning' FROM q1 WHERE strlen(text) > 1000000
UNION ALL SELECT file_id, 'missing_trailing_newline', 'info' FROM q1 WHERE length(x) > 0 AND NOT ends_with(x, chr(10)) UNION ALL SELECT file_id, 'todo_markers', 'info' FROM q1 WHERE regexp_matches(x, '\\b(?:TODO|FIXME|XXX|HACK)\\b'))"""


@view("mcp_quality_by_rule", f"WITH {_QUAL} SELECT rule, severity, count(*) AS hits, count(DISTINCT file_id) AS files FROM qual GROUP BY 1, 2")
def mcp_quality_by_rule(spark, d):
    return quality_findings(table(spark, d, "file_texts"), "file_id", "text").groupBy("rule", "severity").agg(F.count("*").alias("hits"), F.count_distinct("file_id").alias("files")).orderBy(F.desc("hits"), "rule")


def mcp_files(spark, d) -> DataFrame:
    """Every file with its metrics, its family and how many findings and flags it has."""
    s = sources(spark, d)
    t = F.col("text")
    m = s.where("text is not null").select("file_id", "file_name", C.content_family(F.col("extension")).alias("content_family"), F.lit(1).alias("is_text"), *[c.alias(n) for n, c in E.text_metrics(t).items()])
    q = quality_findings(table(spark, d, "file_texts"), "file_id", "text").groupBy("file_id").agg(F.count("*").alias("quality_findings"))
    f = security(spark, d).groupBy("file_id").agg(F.count("*").alias("security_flags"))
    return m.join(q, "file_id", "left").join(f, "file_id", "left").fillna(0, ["quality_findings", "security_flags"])


@view("mcp_family_summary", f"WITH {_SEC}, {_QUAL} SELECT content_family, count(*) AS files, count(*) AS text_files, sum(strlen(s.text)) AS total_bytes, sum(coalesce(nq, 0)) AS quality_findings, sum(coalesce(nf, 0)) AS security_flags FROM src s LEFT JOIN (SELECT file_id, count(*) AS nq FROM qual GROUP BY 1) USING (file_id) LEFT JOIN (SELECT file_id, count(*) AS nf FROM flag GROUP BY 1) USING (file_id) WHERE s.text IS NOT NULL GROUP BY 1")
def mcp_family_summary(spark, d):
    return mcp_files(spark, d).groupBy("content_family").agg(F.count("*").alias("files"), F.sum("is_text").alias("text_files"), F.sum("byte_size").alias("total_bytes"), F.sum("quality_findings").alias("quality_findings"), F.sum("security_flags").alias("security_flags")).orderBy(F.desc("files"), "content_family")


_DEFINING = ", ".join(repr(x) for x in E.DEFINING)


@view("mcp_doc_coverage", f"WITH {_SRC}, {_LANG}, sym AS (SELECT DISTINCT file_id, construct_name, line FROM c WHERE kind = 'definition' AND construct_name IN ({_DEFINING})), above AS (SELECT DISTINCT file_id, line + 1 AS line FROM line WHERE regexp_matches(body, '^\\s*(?:#|//|\\*|--)')) SELECT file_id, count(*) AS symbols, sum((above.line IS NOT NULL)::int) AS documented, sum((above.line IS NULL)::int) AS undocumented FROM sym LEFT JOIN above USING (file_id, line) GROUP BY 1")
def mcp_doc_coverage(spark, d):
    s = E.symbol_docs(sources(spark, d))
    return s.groupBy("file_id").agg(F.count("*").alias("symbols"), F.sum("has_doc").alias("documented"), (F.count("*") - F.sum("has_doc")).alias("undocumented")).orderBy(F.desc("undocumented"), "file_id")


def summary_rows(spark, d) -> DataFrame:
    return E.summaries(sources(spark, d), "file_id", "text", C.content_family(F.col("extension")))


@view("mcp_summary_provenance", "SELECT 'extractive' AS method, count(*) AS summaries FROM file_texts WHERE text IS NOT NULL")
def mcp_summary_provenance(spark, d):
    return summary_rows(spark, d).groupBy("method").agg(F.count("*").alias("summaries")).orderBy(F.desc("summaries"), "method")


@view("mcp_summary_tags", f"""WITH {_SRC}, w AS (SELECT file_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}[\\p{{L}}\\p{{M}}]*(?:[''’\\-]\\p{{L}}[\\p{{L}}\\p{{M}}]*)*|\\p{{Nd}}[\\p{{Nd}},.]*\\p{{Nd}}|\\p{{Nd}}')) AS term FROM src), k AS (SELECT file_id, term, count(*) AS n, row_number() OVER (PARTITION BY file_id ORDER BY count(*) DESC, term) AS rn FROM w WHERE length(term) >= 4 AND term NOT IN ({', '.join(repr(x) for x in E.STOP_WORDS)}) GROUP BY 1, 2)
SELECT src.file_id, content_family, string_agg(term, ' ' ORDER BY rn) AS tags, concat_ws(' on ', content_family, min(CASE WHEN rn = 1 THEN term END)) AS purpose FROM src LEFT JOIN (SELECT * FROM k WHERE rn <= 5) k USING (file_id) WHERE text IS NOT NULL GROUP BY 1, 2""")
def mcp_summary_tags(spark, d):
    return summary_rows(spark, d).select("file_id", "content_family", F.nullif(F.array_join("tags", " "), F.lit("")).alias("tags"), "purpose")


@view("mcp_provider_usage", _USAGE.format(judge=""))
def mcp_provider_usage(spark, d):
    return provider_usage(spark)


@view("mcp_component_coverage", _parts_sql("mcp", "sum(agent) AS agent_backed, sum(computed) AS computed"))
def mcp_component_coverage(spark, d):
    return parts(spark, "mcp").groupBy("section_id", "section_title").agg(F.count("*").alias("components"), F.sum("requires_agent").alias("agent_backed"), F.sum("computed").alias("computed")).orderBy("section_id")


# -- monitor ----------------------------------------------------------------------------------------------------------------
_RECENT = "seq, batch_id, ts, change_type, analyzer_class, rel_path, old_size, new_size, lines_added, lines_removed, update_status, is_binary"


@view("recent_changes", f"SELECT {_RECENT} FROM change_events")
def recent_changes(spark, d):
    return table(spark, d, "change_events").select(*_RECENT.split(", ")).orderBy(F.desc("seq"), *_RECENT.split(", ")[1:])


@view("change_type_summary", "SELECT change_type, count(*) AS events, sum(lines_added) AS lines_added, sum(lines_removed) AS lines_removed FROM change_events GROUP BY 1")
def change_type_summary(spark, d):
    return table(spark, d, "change_events").groupBy("change_type").agg(F.count("*").alias("events"), F.sum("lines_added").alias("lines_added"), F.sum("lines_removed").alias("lines_removed"))


@view("changes_by_analyzer", "SELECT coalesce(analyzer_class, '(unrouted)') AS analyzer_class, n AS events FROM (SELECT analyzer_class, count(*) AS n FROM change_events GROUP BY analyzer_class)")
def changes_by_analyzer(spark, d):
    g = table(spark, d, "change_events").groupBy("analyzer_class").agg(F.count("*").alias("events"))
    return g.select(F.coalesce("analyzer_class", F.lit("(unrouted)")).alias("analyzer_class"), "events").orderBy(F.desc("events"), "analyzer_class")


_KINDS = "CASE WHEN lower(trim(change_type)) LIKE 'delet%' OR lower(trim(change_type)) LIKE 'remov%' THEN 'deleted' WHEN lower(trim(change_type)) LIKE 'creat%' OR lower(trim(change_type)) LIKE 'add%' THEN 'created' ELSE 'modified' END"


@view("recent_batches", f"""WITH e AS (SELECT batch_id, seq, min(ts) AS ts, min({_KINDS}) AS k FROM change_events GROUP BY 1, 2) SELECT batch_id, min(ts) AS ts, sum((k = 'created')::int) AS created, sum((k = 'modified')::int) AS modified, sum((k = 'deleted')::int) AS deleted, count(*) AS total,
NULL::double AS scan_ms, NULL::double AS update_ms, NULL::int AS workers, NULL::varchar AS engine FROM e GROUP BY 1""")
def recent_batches(spark, d):
    """Batches rebuilt from the feed; what only the run that made a batch knew (times, workers, engine) is null."""
    from siltstone.functions.paths import change_kind

    e = table(spark, d, "change_events").select("batch_id", "seq", "ts", change_kind(F.col("change_type")).alias("k")).groupBy("batch_id", "seq").agg(F.min("ts").alias("ts"), F.min("k").alias("k"))
    n = lambda k: F.sum((F.col("k") == k).cast("int")).alias(k)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("scan_ms", "double"), ("update_ms", "double"), ("workers", "int"), ("engine", "string"))]
    return e.groupBy("batch_id").agg(F.min("ts").alias("ts"), n("created"), n("modified"), n("deleted"), F.count("*").alias("total")).select("*", *none).orderBy(F.desc("batch_id"))


# -- unified ----------------------------------------------------------------------------------------------------------------
@view("unified_sources")
def unified_sources(spark, d):
    """Tables and views of a unified catalogue by the catalogue they come from."""
    from siltstone.plans.views import catalog

    c = catalog(spark, d)
    rows = [("core", "table") for _ in c.tables] + [("core", "view") for _ in c.selectable()] + [("reports", "view") for _ in QUERIES]
    x = spark.createDataFrame(rows, "source string, kind string")
    n = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(k + "s")
    return x.groupBy("source").agg(n("table"), n("view")).orderBy("source")


# -- one row per document -----------------------------------------------------------------------------------------------------
def _joined(*names: str) -> str:
    return " ".join(f"LEFT JOIN ({ORACLE['view_' + n]}) {n} ON {n}.document_id = d.doc_id" for n in names)


@view("document_metrics", f"SELECT d.doc_id AS document_id, coalesce(chunk_stats.chunk_count, 0) AS chunk_count, coalesce(e.n, 0) AS entity_count, r.score AS flesch_reading_ease, coalesce(i.n, 0) AS issues FROM documents d {_joined('chunk_stats')} LEFT JOIN (SELECT document_id, sum(n)::bigint AS n FROM ({ORACLE['view_entity_counts']}) GROUP BY 1) e ON e.document_id = d.doc_id LEFT JOIN (SELECT * FROM ({ORACLE['view_readability']}) WHERE formula = 'flesch_reading_ease') r ON r.document_id = d.doc_id LEFT JOIN (SELECT document_id, count(*) AS n FROM ({ORACLE['view_dynamic_reasoning_issues']}) GROUP BY 1) i ON i.document_id = d.doc_id")
def document_metrics(spark, d):
    """The assembled row of each document: chunks, entities, readability and open issues."""
    x = documents(spark, d).select("document_id")
    c = chunk_stats(spark, d).select("document_id", "chunk_count")
    e = entity_rows(spark, d).groupBy("document_id").agg(F.count("*").alias("entity_count"))
    r = readability_of(spark, d).where("formula = 'flesch_reading_ease'").select("document_id", F.col("score").alias("flesch_reading_ease"))
    i = dynamic_reasoning_issues(spark, d).groupBy("document_id").agg(F.count("*").alias("issues"))
    for part in (c, e, r, i):
        x = x.join(part, "document_id", "left")
    return x.fillna(0, ["chunk_count", "entity_count", "issues"])
