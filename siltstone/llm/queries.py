"""Queries p2_ and p5_ to p9_ on the project's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import scalars as S
from siltstone.llm.credentials import find_credentials, mask_credentials
from siltstone.llm.frequency import ngram_counts, term_marks, token_registry
from siltstone.llm.handwritten import not_handwritten
from siltstone.llm.leakage import find_leaks, leak_spans
from siltstone.llm.mixing import Mix
from siltstone.llm.residue import find_residue
from siltstone.session import materialize, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return term_marks(table(spark, d, "token_locations")).select("token", "mark")


def p2_registry(spark: SparkSession, d: str) -> DataFrame:
    return token_registry(table(spark, d, "token_locations"))


def p2_document_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """How many n-grams of each length up to three the documents hold, and how often the most frequent one occurs."""
    docs = table(spark, d, "documents").select("doc_id", S.words(F.col("text")).alias("terms"))
    grams = ngram_counts(docs, "doc_id", "terms", 3)
    return grams.groupBy(F.size("gram").alias("n")).agg(F.count("*").alias("grams"), F.sum("occurrences").alias("occurrences"), F.max("occurrences").alias("top_occurrences"), F.max("records").alias("top_records"))


def _unwritten(spark: SparkSession, d: str) -> DataFrame:
    return not_handwritten(*[table(spark, d, t) for t in ("file_details", "file_texts", "folder_details", "file_extensions", "file_folder_lineage")])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _unwritten(spark, d).select("file_id").distinct()


def p5_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How many files each kind of evidence tells."""
    return _unwritten(spark, d).select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return find_credentials(table(spark, d, "file_texts")).select("file_id", "line").distinct()


def p6_masked(spark: SparkSession, d: str) -> DataFrame:
    """The texts with their credentials masked and all else unchanged."""
    return mask_credentials(table(spark, d, "file_texts")).select("file_id", F.col("masked").alias("text"))


def p6_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Rows of token_locations on lines that hold credentials, by kind of token."""
    lines = find_credentials(table(spark, d, "file_texts")).select("file_id", "line").distinct()
    # the part of location_key after the colon is the file's id; file_id itself is sometimes null
    file_id = F.coalesce("file_id", F.expr("try_cast(substring_index(location_key, ':', -1) as bigint)")).alias("file_id")
    t = table(spark, d, "token_locations").select(file_id, "line", "token_kind")
    return t.join(lines, ["file_id", "line"], "left_semi").groupBy("token_kind").agg(F.count("*").alias("rows"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    """What is to be cut out of each document."""
    docs = table(spark, d, "documents")
    return leak_spans(docs, materialize(find_leaks(docs, table(spark, d, "eval_items")), "leaks"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return Mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).shortfalls().select("source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the mix and how often each is used."""
    return Mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).selection()


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached, against those that were asked for."""
    return Mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).shares()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_residue(table(spark, d, "documents"), table(spark, d, "file_details")).select("doc_id").distinct()


def p9_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each kind of residue stands in."""
    r = find_residue(table(spark, d, "documents"), table(spark, d, "file_details"))
    return r.select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_registry, p2_document_ngrams, p5_found, p5_kinds, p6_found, p6_masked, p6_tokens, p7_found, p7_spans, p8_found, p8_mix, p8_shares, p9_found, p9_kinds)}

_WORD = "CASE WHEN token_kind = 'word' THEN lower(nfc_normalize(regexp_replace(token, '^\\s+|\\s+$', '', 'g'))) ELSE token END"
_OCC = f"SELECT DISTINCT token_kind, {_WORD} AS token, location_key, line, start_col, end_col FROM token_locations"

# sizes by pieces of text in place of tokens: any measure of size gives the same sources
ORACLE = {
    "p2_found": f"""WITH o AS ({_OCC}), r AS (SELECT token, count(DISTINCT location_key) AS n FROM o WHERE token_kind = 'word' AND token IS NOT NULL GROUP BY token),
m AS (SELECT count(DISTINCT location_key) AS n FROM token_locations)
SELECT token, CASE WHEN r.n < 3 THEN 'rare' ELSE 'common' END AS mark FROM r, m WHERE r.n < 3 OR r.n > 0.25 * m.n""",
    "p2_registry": f"WITH o AS ({_OCC}) SELECT token_kind, token, count(*) AS occurrence_count, count(DISTINCT location_key) AS file_count FROM o WHERE token IS NOT NULL AND token_kind IN ('word', 'string') GROUP BY 1, 2",
    "p2_document_ngrams": """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}]+(?:[''’\\-][\\p{L}\\p{M}]+)*|\\p{Nd}[\\p{Nd},.]*\\p{Nd}|\\p{Nd}') AS a FROM documents),
s AS (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM w),
g AS (SELECT 1 AS n, doc_id, a[i:i] AS g FROM s UNION ALL SELECT 2, doc_id, a[i:i+1] FROM s WHERE i + 1 <= len(a) UNION ALL SELECT 3, doc_id, a[i:i+2] FROM s WHERE i + 2 <= len(a)),
k AS (SELECT n, g, count(*) AS occ, count(DISTINCT doc_id) AS recs FROM g GROUP BY 1, 2)
SELECT n::int AS n, count(*) AS grams, sum(occ)::bigint AS occurrences, max(occ) AS top_occurrences, max(recs) AS top_records FROM k GROUP BY n""",
    "p8_found": """WITH s AS (SELECT lower(trim(source)) AS source, sum(len(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+|[0-9]+|[^\\sA-Za-zÀ-ÿ0-9]+'))) AS size FROM documents GROUP BY 1),
t AS (SELECT lower(trim(source)) AS source, sum(target_share) AS share, max(max_repeats) AS most FROM mix_targets GROUP BY 1)
SELECT t.source FROM t LEFT JOIN s USING (source) WHERE coalesce(s.size, 0) * t.most < t.share * (SELECT sum(size) FROM s)""",
}
