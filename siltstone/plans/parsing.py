"""Queries over structure extraction, streams, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import findings as N
from siltstone.operators import matching as M
from siltstone.operators import structure as X
from siltstone.operators.catalog import export
from siltstone.operators.changelog import SortedRuns
from siltstone.operators.evaluate import aurc, expected_calibration_error, pair_metrics
from siltstone.plans.data import ORACLE as DATA_ORACLE
from siltstone.plans.views import catalog
from siltstone.session import scratch, spread, table
from siltstone.sources.files import byte_entropy, ordered_ids, read
from siltstone.sources.formats import analyzer_of
from siltstone.streaming import changes as C

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _sources(spark, d, *suffixes) -> DataFrame:
    f = table(spark, d, "file_details").select("file_id", "file_name", "file_extension_id").distinct()
    e = table(spark, d, "file_extensions").where(F.col("extension_name").isin(*suffixes)) if suffixes else table(spark, d, "file_extensions")
    return table(spark, d, "file_texts").join(f, "file_id").join(e, F.expr("file_extension_id = extension_id")).select("file_id", "file_name", "extension_name", "text")


@query("""SELECT CASE WHEN x = '.sql' THEN 'schema' WHEN x = '.json' THEN 'data' WHEN x IN ('.yaml', '.ini', '.env') THEN 'config' WHEN x = '.md' THEN 'markup' WHEN x = '.sh' THEN 'shell' WHEN x IN ('.py', '.js', '.ts', '.java', '.go', '.c', '.h', '.rb', '.css') THEN 'code' ELSE 'misc' END AS route, count(*) AS files
FROM (SELECT DISTINCT file_id, extension_name AS x FROM file_details JOIN file_extensions ON file_extension_id = extension_id) GROUP BY 1""")
def routing(spark, d):
    f = table(spark, d, "file_details").select("file_id", "file_extension_id").distinct().join(table(spark, d, "file_extensions"), F.expr("file_extension_id = extension_id"))
    return f.groupBy(analyzer_of(F.concat(F.lit("name"), "extension_name")).alias("route")).agg(F.count("*").alias("files"))


@query()
def code_symbols(spark, d):
    s = X.extract(_sources(spark, d, ".py", ".js", ".ts", ".java", ".go", ".c", ".h", ".rb"), "file_id", "text", X.pattern_symbols, X.SYMBOLS)
    return s.groupBy("kind").agg(F.count("*").alias("symbols"), F.count_distinct("file_id").alias("files"))


@query()
def python_symbols(spark, d):
    return X.extract(_sources(spark, d, ".py"), "file_id", "text", X.python_symbols, X.SYMBOLS).groupBy("kind").agg(F.count("*").alias("symbols"))


@query()
def schema_objects(spark, d):
    return X.extract(_sources(spark, d, ".sql"), "file_id", "text", X.ddl_objects, X.DDL).groupBy("object_kind").agg(F.count("*").alias("objects"))


@query()
def config_settings(spark, d):
    return X.extract(_sources(spark, d, ".json", ".yaml", ".ini", ".env"), "file_id", "text", X.settings, X.SETTINGS).groupBy("syntax", "value_type").agg(F.count("*").alias("settings"))


@query("SELECT m AS level, count(*) AS records FROM (SELECT regexp_extract(rtrim(l, chr(13)), '^\\[?(?:(?:\\d{4}-\\d\\d-\\d\\d[T ])?\\d\\d:\\d\\d:\\d\\d[^\\s\\]]*)\\]?\\s+\\[?(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL)\\]?:?\\s+', 1) AS m FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)) WHERE m <> '' GROUP BY 1")
def log_levels(spark, d):
    return X.extract(table(spark, d, "documents"), "doc_id", "text", X.log_records, X.LOGS).groupBy("level").agg(F.count("*").alias("records"))


@query()
def markup_elements(spark, d):
    return X.element_rollup(X.extract(table(spark, d, "documents").where(F.col("text").contains("<")), "doc_id", "text", X.elements, X.ELEMENTS))


@query("""WITH b AS (SELECT file_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM file_texts), c AS (SELECT file_id, x, count(*) AS n FROM b GROUP BY 1, 2), t AS (SELECT file_id, sum(n) AS t FROM c GROUP BY 1)
SELECT file_id, round(coalesce(e, 0.0), 4) AS entropy FROM (SELECT DISTINCT file_id FROM file_texts) LEFT JOIN (SELECT file_id, -sum(n / t * log2(n / t)) AS e FROM c JOIN t USING (file_id) GROUP BY 1) USING (file_id)""")
def text_entropy(spark, d):
    def run(batches):
        for b in batches:
            b["entropy"] = [byte_entropy(x.encode()) if x else 0.0 for x in b["text"]]
            yield b[["file_id", "entropy"]]

    return spread(table(spark, d, "file_texts").select("file_id", "text"), "file_id").mapInPandas(run, "file_id long, entropy double")


@query("SELECT row_number() OVER (ORDER BY rel_path) AS n, rel_path FROM (SELECT DISTINCT rel_path FROM file_state)")
def path_order_ids(spark, d):
    return ordered_ids(table(spark, d, "file_state").select("rel_path").distinct(), "rel_path", "n").select("n", "rel_path")


@query("SELECT date_trunc('hour', ts)::timestamp AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, d):
    return C.to_table(C.windowed(C.read_files(spark, f"{d}/events.parquet"), "ts", ["event_type"]))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, k""")
def sessionized(spark, d):
    return C.sessions(table(spark, d, "events"), "ts", "user_id")


@query(DATA_ORACLE["p4_found"])
def stream_current_files(spark, d):
    """The change feed as a stream, applied to the store by micro-batches."""
    return C.apply_changes(C.read_files(spark, f"{d}/change_events.parquet"), SortedRuns(spark)).alive()


@query("SELECT k AS format, count(*) AS rows, sum(n_nationkey) AS keys FROM nation, (VALUES ('csv'), ('jsonl'), ('orc'), ('parquet')) AS f(k) GROUP BY 1")
def export_formats(spark, d):
    out = None
    for kind in ("csv", "jsonl", "orc", "parquet"):
        path = f"{scratch(spark, 'export')}.{kind}"
        export(table(spark, d, "nation"), path, kind)
        one = read(spark, path).agg(F.lit(kind).alias("format"), F.count("*").alias("rows"), F.sum(F.col("n_nationkey").cast("long")).alias("keys"))
        out = one if out is None else out.unionByName(one)
    return out


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings folder_details file_details file_folder_lineage token_locations token_registry grep_pattern_catalog change_events file_state file_texts file_extensions eval_items mix_targets".split()


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM {n}" for n in _TABLES))
def table_counts(spark, d):
    """The rows of every table of the folder, in one union of counts that footers answer."""
    c = catalog(spark, d)
    c.tables = {k: c.tables[k] for k in _TABLES}
    return c.counts()


@query("""SELECT CASE WHEN regexp_matches(text, '(?i)\\bENGINE\\s*=\\s*\\w+|\\bAUTO_INCREMENT\\b') THEN 'mysql' WHEN regexp_matches(text, '(?i)\\b(?:BIG|SMALL)?SERIAL\\b|\\$\\$|::\\w+|\\bJSONB\\b|\\bRETURNING\\b') THEN 'postgresql' WHEN regexp_matches(text, '(?i)\\bIDENTITY\\s*\\(|\\bNVARCHAR\\b') THEN 'sqlserver' WHEN regexp_matches(text, '(?i)\\bVARCHAR2\\b|\\bNUMBER\\s*\\(') THEN 'oracle' WHEN regexp_matches(text, '(?i)\\bAUTOINCREMENT\\b|\\bPRAGMA\\b') THEN 'sqlite'
WHEN regexp_matches(text, '(?i)\\bCREATE\\s+(?:OR\\s+REPLACE\\s+)?(?:TABLE|VIEW|INDEX)\\b') THEN 'sql' END AS engine, count(*) AS files FROM file_texts t JOIN (SELECT file_id, max(file_extension_id) AS e FROM file_details GROUP BY 1) f USING (file_id) JOIN file_extensions ON extension_id = e WHERE extension_name = '.sql' GROUP BY 1""")
def schema_engines(spark, d):
    s = _sources(spark, d, ".sql").dropDuplicates(["file_id"])
    return s.groupBy(X.engine_of(F.col("text")).alias("engine")).agg(F.count("*").alias("files"))


@query("SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 3 GROUP BY 1")
def sql_surface(spark, d):
    return catalog(spark, d).query("SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > :least GROUP BY r_name", {"least": 3})


@query()
def pair_scores(spark, d):
    """Text metrics between every document and the next one of its source."""
    docs = table(spark, d, "documents").select("doc_id", F.lower(F.trim("source")).alias("s"), "text").where("s is not null")
    ids = docs.select("s", F.floor(F.col("doc_id") / 64).alias("block"), "doc_id")
    # the next within a block of 64 ids, so that no source is ordered in one task; the last of a block goes with the first
    # of the next block that its source has, by one row of ids per block
    within = ids.select(F.col("doc_id").alias("id"), F.lead("doc_id").over(Window.partitionBy("s", "block").orderBy("doc_id")).alias("next"))
    blocks = ids.groupBy("s", "block").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    across = blocks.select(F.col("last").alias("id"), F.lead("first").over(Window.partitionBy("s").orderBy("block")).alias("next"))
    links = within.unionByName(across).where("next is not null")
    pred, gold = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("pred")), docs.select(F.col("doc_id").alias("next"), F.col("text").alias("gold"))
    pairs = links.join(pred, "id").join(gold, "next").select("id", "pred", "gold").where("gold is not null")
    return pair_metrics(pairs)


@query("""WITH x AS (SELECT (value - lo) / (hi - lo) AS c, event_type = 'purchase' AS ok FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)), g AS (SELECT count(*) AS n, avg(c) AS conf, avg(CASE WHEN ok THEN 1.0 ELSE 0 END) AS acc FROM x GROUP BY least(greatest(ceil(c * 10)::int, 1), 10))
SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM g""")
def calibration_error(spark, d):
    e = table(spark, d, "events")
    lo, hi = e.agg(F.min("value"), F.max("value")).first()
    x = e.select(((F.col("value") - lo) / (hi - lo)).alias("confidence"), (F.col("event_type") == "purchase").alias("correct"))
    return expected_calibration_error(x).select(F.round("ece", 6).alias("ece"))


@query("""WITH x AS (SELECT floor(value)::int AS c, event_type = 'purchase' AS ok FROM events), g AS (SELECT c, count(*) AS n, sum(CASE WHEN ok THEN 0 ELSE 1 END) AS bad FROM x GROUP BY c),
k AS (SELECT c, sum(n) OVER w / (SELECT count(*) FROM x) AS cov, sum(bad) OVER w / sum(n) OVER w AS risk FROM g WINDOW w AS (ORDER BY c DESC)), l AS (SELECT cov, risk, lag(cov) OVER (ORDER BY cov) AS c0, lag(risk) OVER (ORDER BY cov) AS r0 FROM k)
SELECT round(sum((cov - c0) * (risk + r0) / 2), 6) AS aurc FROM l""")
def risk_area(spark, d):
    x = table(spark, d, "events").select(F.floor("value").cast("int").alias("confidence"), (F.col("event_type") == "purchase").alias("correct"))
    return aurc(x).select(F.round("aurc", 6).alias("aurc"))


@query("""WITH t AS (SELECT file_id, replace(text, chr(13) || chr(10), chr(10)) AS x, text FROM file_texts), l AS (SELECT file_id, x, text, string_split(x, chr(10)) AS ls FROM t),
c AS (SELECT file_id, len(list_filter(ls, lambda y: length(y) > 120)) AS a, len(list_filter(ls, lambda y: regexp_matches(y, '[ \\t]+$'))) AS b, len(list_filter(ls, lambda y: starts_with(y, chr(9)))) AS tb, len(list_filter(ls, lambda y: starts_with(y, ' '))) AS sp,
CASE WHEN length(x) > 0 AND NOT ends_with(x, chr(10)) THEN 1 ELSE 0 END AS nl, len(regexp_extract_all(x, '\\b(?:TODO|FIXME|XXX|HACK)\\b')) AS td FROM l),
r AS (SELECT file_id, 'long_lines' AS rule, 'info' AS severity, a AS n FROM c UNION ALL SELECT file_id, 'trailing_whitespace', 'info', b FROM c UNION ALL SELECT file_id, 'mixed_indentation', 'warning', CASE WHEN tb > 0 AND sp > 0 THEN tb + sp ELSE 0 END FROM c
UNION ALL SELECT file_id, 'missing_trailing_newline', 'info', nl FROM c UNION ALL SELECT file_id, 'todo_markers', 'info', td FROM c) SELECT * FROM r WHERE n > 0""")
def quality_findings(spark, d):
    return N.quality_findings(table(spark, d, "file_texts"), "file_id", "text")


_RANGES = {"Latin": "Latin", "Cyrillic": "Cyrillic", "Greek": "Greek", "Arabic": "Arabic", "Hebrew": "Hebrew", "CJK": "Han}\\p{Hiragana}\\p{Katakana}\\p{Hangul", "Devanagari": "Devanagari"}
_SCRIPTS = ", ".join(f"len(regexp_extract_all(text, '[\\p{{{r}}}]'))" for r in _RANGES.values())


@query(f"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\\r\\n?|\\n'), lambda x: trim(regexp_replace(trim(x, ' '), '^[#/*<!\\-;% ]+', ''), ' ')), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:import|from|package|using) ')) AS ls, [{_SCRIPTS}] AS n FROM documents)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN left(array_to_string(ls[1:3], ' '), 280) END AS summary, CASE WHEN list_max(n) > 0 THEN [{', '.join(repr(k) for k in _RANGES)}][list_position(n, list_max(n))] ELSE 'unknown' END AS script FROM l""")
def summaries(spark, d):
    """Extractive summary and script of every document."""
    return table(spark, d, "documents").select("doc_id", N.summary(F.col("text")).alias("summary"), N.dominant_script(F.col("text")).alias("script"))


_TYPES = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'))"
_BAG = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')"


def _coverage(a: str, b: str) -> str:
    x, y = _TYPES.format(a), _TYPES.format(b)
    return f"CASE WHEN len({x}) = 0 THEN 1.0 ELSE len(list_intersect({x}, {y})) / len({x}) END"


def _f1(a: str, b: str) -> str:
    x, y = _BAG.format(a), _BAG.format(b)
    hit = f"coalesce(list_sum(list_transform(list_distinct({x}), lambda v: least(len(list_filter({x}, lambda q: q = v)), len(list_filter({y}, lambda q: q = v))))), 0)"
    return f"CASE WHEN len({x}) = 0 AND len({y}) = 0 THEN 1.0 ELSE 2 * {hit} / (len({x}) + len({y})) END"


@query(f"""WITH i AS (SELECT item_id AS case_id, text AS ref, regexp_extract(text, '([^.]*)$', 1) AS question, regexp_extract(text, '^([^.]*\\.)', 1) AS answer FROM eval_items),
c AS (SELECT *, list_filter(string_split_regex(regexp_replace(trim(answer, ' '), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ') <> '') AS claims, coalesce(nullif(ref, ''), answer) AS target FROM i),
s AS (SELECT case_id, CASE WHEN len(claims) = 0 THEN 1.0 ELSE len(list_filter(claims, lambda c: {_coverage('c', 'ref')} >= 0.6)) / len(claims) END AS faithfulness, {_f1('answer', 'question')} AS answer_relevancy, ({_coverage('target', 'ref')} >= 0.3)::int::double AS context_precision, {_coverage('ref', 'ref')} AS context_recall, {_f1('answer', 'ref')} AS factual_correctness FROM c)
SELECT case_id, round(faithfulness, 6) AS faithfulness, round(answer_relevancy, 6) AS answer_relevancy, round(context_precision, 6) AS context_precision, round(context_recall, 6) AS context_recall, round(factual_correctness, 6) AS factual_correctness, round((faithfulness + answer_relevancy + context_precision + context_recall + factual_correctness) / 5, 6) AS score FROM s""")
def answer_scores(spark, d):
    """Word statistics of evaluation items as questions, with a document's lines as contexts."""
    items = table(spark, d, "eval_items").select(F.col("item_id").alias("case_id"), F.regexp_extract("text", r"([^.]*)$", 1).alias("question"), "text", F.array("text").alias("contexts"))
    cases = items.select("case_id", "question", F.regexp_extract("text", r"^([^.]*\.)", 1).alias("answer"), "contexts", F.col("text").alias("reference"))
    x = M.answer_scores(cases)
    return x.select("case_id", *[F.round(c, 6).alias(c) for c in x.columns[1:]])
