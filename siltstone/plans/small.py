"""Queries over the small relational operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.paths import clean_path
from siltstone.operators import concordance as C
from siltstone.operators import enrich as E
from siltstone.operators import frames as R
from siltstone.operators.linediff import ChangeLog, line_changes
from siltstone.plans.data import _CLEAN
from siltstone.plans.reports import _SRC, sources
from siltstone.session import scratch, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_STATE = "SELECT rel_path, max(hash) AS hash, max(size) AS size FROM file_state WHERE rel_path IS NOT NULL GROUP BY 1"
_NEWS = f"SELECT coalesce({_CLEAN}, '') AS rel_path, new_hash AS hash, new_size AS size FROM change_events"


def _news(spark, d):
    old = table(spark, d, "file_state").where("rel_path is not null").groupBy("rel_path").agg(F.max("hash").alias("hash"), F.max("size").alias("size"))
    news = table(spark, d, "change_events").select(F.coalesce(clean_path(F.col("rel_path")), F.lit("")).alias("rel_path"), F.col("new_hash").alias("hash"), F.col("new_size").alias("size"))
    return old, news


_LEAST = "arg_min({hash: hash, size: size}, (hash IS NOT NULL, hash, size IS NOT NULL, size)) AS r"


@query(f"WITH o AS ({_STATE}), n AS ({_NEWS}), f AS (SELECT rel_path, hash, size, row_number() OVER (PARTITION BY rel_path ORDER BY hash NULLS FIRST, size NULLS FIRST) AS rn FROM n WHERE rel_path NOT IN (SELECT rel_path FROM o)) SELECT * FROM o UNION ALL SELECT rel_path, hash, size FROM f WHERE rn = 1")
def insert_ignore(spark, d):
    return R.insert_ignore(*_news(spark, d), "rel_path")


@query(f"WITH o AS ({_STATE}), n AS ({_NEWS}), f AS (SELECT rel_path, hash, size, row_number() OVER (PARTITION BY rel_path ORDER BY hash DESC NULLS LAST, size DESC NULLS LAST) AS rn FROM n) SELECT * FROM o WHERE rel_path NOT IN (SELECT rel_path FROM n) UNION ALL SELECT rel_path, hash, size FROM f WHERE rn = 1")
def insert_replace(spark, d):
    return R.insert_replace(*_news(spark, d), "rel_path")


@query("SELECT event_id, event_type, coalesce(c.c_name, s.s_name) AS name FROM events LEFT JOIN customer c ON event_type = 'purchase' AND c_custkey = user_id LEFT JOIN supplier s ON event_type = 'click' AND s_suppkey = user_id WHERE coalesce(c.c_name, s.s_name) IS NOT NULL")
def polymorphic_lookup(spark, d):
    """Purchases meet customers and clicks suppliers, by the same column."""
    links = table(spark, d, "events").select("event_id", "event_type", F.col("user_id").alias("id"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    return R.lookup_by_kind(links, "event_type", "id", {"purchase": (c, "c_custkey"), "click": (s, "s_suppkey")}).select("event_id", "event_type", "name")


@query(f"WITH ids AS (SELECT rel_path AS p, min(last_seq) AS file_ref FROM file_state WHERE rel_path IS NOT NULL GROUP BY 1), e AS (SELECT DISTINCT seq, coalesce({_CLEAN}, '') AS path FROM change_events) SELECT seq, path, file_ref FROM e LEFT JOIN ids ON p = path")
def relinked_changes(spark, d):
    e = table(spark, d, "change_events").select("seq", F.coalesce(clean_path(F.col("rel_path")), F.lit("")).alias("path")).distinct().withColumn("file_ref", F.lit(None).cast("long"))
    files = table(spark, d, "file_state").select("rel_path", F.col("last_seq").alias("file_ref"))
    return R.relink(e, "path", files, "rel_path", "file_ref").select("seq", "path", "file_ref")


@query("SELECT c_custkey AS key_id, n_nationkey AS target_id FROM customer LEFT JOIN nation ON n_name = (SELECT n_name FROM nation x WHERE x.n_nationkey = c_nationkey)")
def resolved_targets(spark, d):
    """References written with quotes and a schema find their table by its plain name."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    keys = table(spark, d, "customer").join(n, F.expr("c_nationkey = n_nationkey")).select(F.col("c_custkey").alias("key_id"), F.concat(F.lit('public."'), F.col("n_name"), F.lit('"')).alias("ref"))
    return R.resolve_targets(keys, "ref", n, "n_name", "n_nationkey").select("key_id", "target_id")


@query("SELECT event_type, v[floor(0.5 * (len(v) - 1))::int + 1] AS p50, v[floor(0.9 * (len(v) - 1))::int + 1] AS p90 FROM (SELECT event_type, list_sort(list(user_id)) AS v FROM events WHERE user_id IS NOT NULL GROUP BY 1)")
def position_percentiles(spark, d):
    return R.position_percentile(table(spark, d, "events"), "event_type", "user_id", {"p50": 0.5, "p90": 0.9})


@query("""SELECT o_orderpriority, count(*) AS records, round(avg((o_orderstatus = 'F')::int), 6) AS done_rate, round(avg(CASE WHEN o_orderstatus <> 'P' THEN (o_orderstatus = 'O')::int END), 6) AS open_rate, quantile_disc(o_totalprice, 0.5)::double AS latency_p50, quantile_disc(o_totalprice, 0.95)::double AS latency_p95, quantile_disc(o_totalprice, 0.99)::double AS latency_p99,
round(avg(o_totalprice)::double, 4) AS latency_mean, sum(o_custkey)::bigint AS cost_total, round(avg(o_custkey), 6) AS cost_mean FROM orders GROUP BY 1""")
def kpi_report(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", (F.col("o_orderstatus") == "F").alias("done"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "O").alias("open"), F.col("o_totalprice").cast("double").alias("price"), "o_custkey")
    k = R.kpis(o, ["done", "open"], "price", "o_custkey", "o_orderpriority")
    return k.withColumns({"done_rate": F.round("done_rate", 6), "open_rate": F.round("open_rate", 6), "latency_mean": F.round("latency_mean", 4), "cost_mean": F.round("cost_mean", 6)})


@query("SELECT 'encoder.layer.' || p_size AS layer, count(*) AS tensors, sum(p_partkey)::bigint AS parameters, sum(p_partkey * 4)::bigint AS bytes FROM part WHERE p_size % 2 = 0 GROUP BY 1 UNION ALL SELECT 'embeddings', count(*), sum(p_partkey)::bigint, sum(p_partkey * 4)::bigint FROM part WHERE p_size % 2 = 1 HAVING count(*) > 0")
def model_layers(spark, d):
    name = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("encoder.layer."), "p_size", F.lit(".weight"))).otherwise("embeddings.word")
    return R.layers(table(spark, d, "part").select(name.alias("name"), "p_partkey", (F.col("p_partkey") * 4).alias("b")), "name", "p_partkey", "b")


@query("SELECT batch_id, count(*) AS chunks, min(seq) AS first, max(seq) AS last, max(seq) - min(seq) + 1 - count(DISTINCT seq) AS missing, count(*) - count(DISTINCT seq) AS repeated, sum(new_size)::bigint AS total FROM change_events WHERE seq IS NOT NULL GROUP BY 1")
def batch_health(spark, d):
    return R.chunk_health(table(spark, d, "change_events").where("seq is not null"), "seq", "new_size", "batch_id")


@query("SELECT * FROM (SELECT 'n_name' AS column_name, row_number() OVER (ORDER BY s) AS ordinal, s AS sample FROM (SELECT DISTINCT left(n_name, 64) AS s FROM nation)) WHERE ordinal <= 5 UNION ALL SELECT * FROM (SELECT 'n_nationkey', row_number() OVER (ORDER BY s) AS o, s FROM (SELECT DISTINCT n_nationkey::varchar AS s FROM nation)) WHERE o <= 5 UNION ALL SELECT * FROM (SELECT 'n_regionkey', row_number() OVER (ORDER BY s) AS o, s FROM (SELECT DISTINCT n_regionkey::varchar AS s FROM nation)) WHERE o <= 5")
def column_samples(spark, d):
    return R.samples(table(spark, d, "nation"))


@query("WITH p AS (SELECT DISTINCT rel_path, string_split(rel_path, '/') AS parts FROM file_state) SELECT rel_path, len(parts) - 1 AS depth, row_number() OVER (ORDER BY parts) AS depth_first FROM p")
def depth_first_order(spark, d):
    from siltstone.sources.files import ordered_ids

    p = R.walk_orders(table(spark, d, "file_state").select("rel_path").distinct(), "rel_path")
    return ordered_ids(p, "parts", "depth_first").select("rel_path", "depth", "depth_first")


@query("WITH p AS (SELECT DISTINCT rel_path, string_split(rel_path, '/') AS parts FROM file_state) SELECT rel_path, row_number() OVER (ORDER BY len(parts), parts) AS breadth_first FROM p")
def breadth_first_order(spark, d):
    from siltstone.sources.files import ordered_ids

    p = R.walk_orders(table(spark, d, "file_state").select("rel_path").distinct(), "rel_path").withColumn("k", F.struct("depth", "parts"))
    return ordered_ids(p, "k", "breadth_first").select("rel_path", "breadth_first")


@query("""WITH t AS (SELECT doc_id, regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n+$', '') AS b FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, b, regexp_replace(string_split(b, chr(10))[1], '"[^"]*"', '', 'g') AS l FROM t),
n AS (SELECT doc_id, b, length(l) - length(replace(l, ',', '')) AS c, length(l) - length(replace(l, chr(9), '')) AS tb, length(l) - length(replace(l, ';', '')) AS sc, length(l) - length(replace(l, '|', '')) AS p FROM f)
SELECT doc_id, CASE greatest(c, tb, sc, p) WHEN c THEN ',' WHEN tb THEN chr(9) WHEN sc THEN ';' ELSE '|' END AS separator, CASE WHEN b = '' THEN 0 ELSE len(string_split(b, chr(10))) END AS rows, CASE WHEN b = '' THEN 0 ELSE greatest(c, tb, sc, p) + 1 END AS columns FROM n""")
def csv_shapes(spark, d):
    s = R.csv_shape(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", *[c.alias(n) for n, c in s.items()])


@query("SELECT s_suppkey, CASE WHEN sl = '' THEN 'project' ELSE sl END || '-' || left(sha256(coalesce(s_name, '') || chr(0) || coalesce(s_nationkey::varchar, '')), 16) AS storage_key FROM (SELECT *, regexp_replace(regexp_replace(lower(trim(s_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS sl FROM supplier)")
def storage_keys(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", R.storage_key(F.col("s_name"), F.col("s_name"), F.col("s_nationkey")).alias("storage_key"))


@query("SELECT count(*) AS files, count(DISTINCT e) AS extensions, sum((NOT known)::int) AS unknown FROM (SELECT DISTINCT file_id, coalesce(lower(extension_name), '.' || 'zz' || (file_id % 3)::varchar) AS e, extension_name IS NOT NULL AND file_id % 5 <> 0 AS known FROM (SELECT DISTINCT file_id, CASE WHEN file_id % 5 = 0 THEN NULL ELSE extension_name END AS extension_name FROM file_details LEFT JOIN file_extensions ON file_extension_id = extension_id))")
def extension_identities(spark, d):
    """Ids of extensions, every fifth file with one that the catalogue doesn't have."""
    x = table(spark, d, "file_extensions")
    f = table(spark, d, "file_details").join(x, F.expr("file_extension_id = extension_id"), "left").select("file_id", F.when(F.col("file_id") % 5 != 0, F.col("extension_name")).alias("e")).distinct()
    f = f.withColumn("e", F.coalesce("e", F.concat(F.lit("zz"), (F.col("file_id") % 3).cast("string"))))
    return R.extension_ids(f, "e", x).agg(F.count("*").alias("files"), F.count_distinct("extension_id").alias("extensions"), F.sum((F.col("extension_id") >= R.RESERVED).cast("int")).alias("unknown"))


@query("SELECT n_nationkey, 'UTC' || CASE WHEN m < 0 THEN '-' ELSE '+' END || lpad((abs(m) // 60)::varchar, 2, '0') || ':' || lpad((abs(m) % 60)::varchar, 2, '0') AS label FROM (SELECT n_nationkey, (n_nationkey - 12) * 45 AS m FROM nation)")
def zone_labels(spark, d):
    m = ((F.col("n_nationkey") - 12) * 45).cast("int")
    label, _ = R.zone_slot(m, spark.createDataFrame([("UTC", 0)], "zone string, offset_minutes int"))
    return table(spark, d, "nation").select("n_nationkey", label.alias("label"))


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 10 AND event_type = 'click' GROUP BY 1")
def counted_where(spark, d):
    n = R.count_where(table(spark, d, "events"), "value > :least AND event_type = :kind", {"least": 10, "kind": "click"})
    return spark.createDataFrame([("click", n)] if n else [], "event_type string, n long")


@query(f"WITH {_SRC}, w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}[\\p{{L}}\\p{{M}}]*(?:[''’\\-]\\p{{L}}[\\p{{L}}\\p{{M}}]*)*|\\p{{Nd}}[\\p{{Nd}},.]*\\p{{Nd}}|\\p{{Nd}}')) AS term FROM documents), k AS (SELECT doc_id, term, count(*) AS n FROM w WHERE length(term) >= 3 AND term NOT IN ({', '.join(repr(x) for x in E.STOP_WORDS)}) GROUP BY 1, 2) SELECT doc_id, rank::int AS rank, term, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM k) WHERE rank <= 20")
def document_terms(spark, d):
    """The twenty most frequent terms of every document."""
    return E.term_counts(table(spark, d, "documents"), "doc_id", "text")


@query(f"WITH {_SRC}, h AS (SELECT file_id, pattern_id, line, regexp_extract_all(body, regex) AS ms FROM line JOIN grep_pattern_catalog ON regexp_matches(body, regex)), g AS (SELECT file_id, pattern_id, line, unnest(ms) AS m FROM h) SELECT file_id, pattern_id, least(count(*), 3) AS kept, max(length(left(m, 240)))::int AS widest FROM (SELECT *, row_number() OVER (PARTITION BY file_id, pattern_id ORDER BY line) AS rn FROM g WHERE m <> '') WHERE rn <= 3 GROUP BY 1, 2")
def capped_matches(spark, d):
    """The first three matches of each pattern in each file: the cap is what this operator is asked for."""
    pats = [(r["pattern_id"], r["regex"]) for r in table(spark, d, "grep_pattern_catalog").select("pattern_id", "regex").collect()]
    m = C.pattern_matches(table(spark, d, "file_texts"), pats, most=3)
    return m.groupBy("file_id", "pattern_id").agg(F.count("*").alias("kept"), F.max(F.length("match_text")).alias("widest"))


@query(f"WITH {_SRC} SELECT content_family, count(*) AS files, sum(strlen(text)) AS bytes, sum(len(string_split(text, chr(10))) - ends_with(text, chr(10))::int - (text = '')::int) AS lines, sum((ends_with(text, chr(10)))::int) AS closed FROM src WHERE text IS NOT NULL AND NOT regexp_matches(text, '[\\x0b\\x0c\\x1c-\\x1e]|\\r[^\\n]|\\r$') GROUP BY 1")
def generic_metrics(spark, d):
    """Text metrics by family, over texts whose lines end with line feeds only, so that another way of counting must agree."""
    s = sources(spark, d).where(F.col("text").isNotNull() & ~F.col("text").rlike(r"[\x0b\x0c\x1c-\x1e]|\r[^\n]|\r$"))
    m = E.text_metrics(F.col("text"))
    x = s.select(C.content_family(F.col("extension")).alias("content_family"), m["byte_size"].alias("b"), m["line_count"].alias("l"), m["ends_with_newline"].alias("e"))
    return x.groupBy("content_family").agg(F.count("*").alias("files"), F.sum("b").alias("bytes"), F.sum("l").alias("lines"), F.sum("e").alias("closed"))


_PAIR = "o AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || 'one more line' ELSE text END AS text FROM documents WHERE doc_id % 4 <> 0)"


@query(f"WITH {_PAIR} SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'created' WHEN n.doc_id IS NULL THEN 'deleted' ELSE 'modified' END AS change_type FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.text IS DISTINCT FROM n.text OR o.doc_id IS NULL OR n.doc_id IS NULL")
def changed_texts(spark, d):
    """What differs between two states of the documents; the lines are in ``line_differences``."""
    return line_differences(spark, d).select("doc_id", "change_type")


@query(f"""WITH {_PAIR}, c AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, o.text AS a, n.text AS b, o.doc_id IS NULL AS fresh, n.doc_id IS NULL AS gone FROM o FULL JOIN n ON o.doc_id = n.doc_id),
k AS (SELECT *, CASE WHEN coalesce(a, b) = '' THEN 0 ELSE len(string_split_regex(coalesce(a, b), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) - regexp_matches(coalesce(a, b), '[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]$')::int END AS n FROM c)
SELECT CASE WHEN fresh THEN 'created' ELSE 'deleted' END AS change_type, count(*) AS documents, sum(CASE WHEN fresh THEN n + (b LIKE '%' || chr(10) || 'one more line')::int * 0 ELSE 0 END)::bigint AS lines_added, sum(CASE WHEN gone THEN n ELSE 0 END)::bigint AS lines_removed FROM k WHERE fresh OR gone GROUP BY 1""")
def whole_text_changes(spark, d):
    """Lines of the texts that came and went."""
    x = line_differences(spark, d).where("change_type <> 'modified'")
    return x.groupBy("change_type").agg(F.count("*").alias("documents"), F.sum("lines_added").alias("lines_added"), F.sum("lines_removed").alias("lines_removed"))


@query()
def line_differences(spark, d):
    x = table(spark, d, "documents").select("doc_id", "text")
    new = x.where("doc_id % 4 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("\none more line"))).otherwise(F.col("text")))
    return line_changes(x.where("doc_id % 3 <> 0"), new, "doc_id", "text")


@query(f"SELECT string_split(coalesce({_CLEAN}, ''), '/')[1] AS repo, count(*) AS events, max(seq) AS last_seq FROM change_events GROUP BY 1")
def durable_log(spark, d):
    """The feed appended to a log by repository in two batches, one of them twice, and read again."""
    log = ChangeLog(spark, scratch(spark, "log"))
    e = table(spark, d, "change_events").withColumn("r", F.substring_index(F.coalesce(clean_path(F.col("rel_path")), F.lit("")), "/", 1))
    odd = F.pmod(F.coalesce("seq", F.lit(0)), F.lit(2)) == 1
    for part, name in ((e.where(odd), "odd"), (e.where(~odd), "even"), (e.where(odd), "odd")):
        log.append(part, "r", name)
    return log.read().groupBy("repo").agg(F.count("*").alias("events"), F.max("seq").alias("last_seq"))


@query(f"WITH c AS (SELECT DISTINCT string_split(coalesce({_CLEAN}, ''), '/')[-1] AS name FROM change_events WHERE seq % 7 = 0), f AS (SELECT file_id, max(file_name || coalesce(extension_name, '')) AS name FROM file_details LEFT JOIN file_extensions ON file_extension_id = extension_id GROUP BY 1) SELECT file_id, len(regexp_extract_all(text, '\\b(?:TODO|FIXME|XXX|HACK)\\b')) AS todo_count FROM file_texts JOIN f USING (file_id) WHERE name IN (SELECT name FROM c) AND text IS NOT NULL")
def reanalysed(spark, d):
    """Only the files that a batch of changes names are analysed again."""
    x = table(spark, d, "file_extensions").select(F.col("extension_id").alias("file_extension_id"), "extension_name")
    f = table(spark, d, "file_details").join(x, "file_extension_id", "left").groupBy("file_id").agg(F.max(F.concat("file_name", F.coalesce("extension_name", F.lit("")))).alias("name"))
    c = table(spark, d, "change_events").where("seq % 7 = 0").select(F.substring_index(F.coalesce(clean_path(F.col("rel_path")), F.lit("")), "/", -1).alias("name"))
    todo = E.text_metrics(F.col("text"))["todo_count"].cast("long").alias("todo_count")
    return R.changed_only(table(spark, d, "file_texts").join(f, "file_id"), c, "name", lambda g: g.where("text is not null").select("file_id", todo))
