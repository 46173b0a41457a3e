"""Queries over joins, aggregates, windows, profiles, scalar functions and set operations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import scalars as S
from siltstone.functions.paths import clean_path
from siltstone.operators import linkage, profile, retention
from siltstone.operators.concordance import lines
from siltstone.operators.hierarchy import hierarchy
from siltstone.plans.data import _CLEAN, _TREE, _folders
from siltstone.session import spread, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name)


# -- hierarchy and paths ----------------------------------------------------------------------------------------------
@query(f"{_TREE} SELECT depth::int AS depth, count(*) AS folders FROM t GROUP BY 1")
def folder_tree_depth(spark, d):
    return hierarchy(_folders(spark, d), paths=False).where("depth >= 0").groupBy("depth").agg(F.count("*").alias("folders"))


@query(f"""{_TREE}, f0 AS (SELECT DISTINCT file_id, file_name, raw_location_json FROM file_details WHERE raw_location_json IS NOT NULL),
f1 AS (SELECT file_id, file_name, list_last(regexp_extract_all(raw_location_json, '[0-9]+'))::bigint AS folder FROM f0)
SELECT file_id, path || '/' || file_name AS path FROM f1 JOIN t ON t.id = folder""")
def file_paths(spark, d):
    """Path reconstruction: a file's deepest folder, with that folder's full path."""
    f = t(spark, d, "file_details").where("raw_location_json is not null").select("file_id", "file_name", F.element_at(F.expr("regexp_extract_all(raw_location_json, '[0-9]+', 0)"), -1).cast("long").alias("id")).distinct()
    tree = hierarchy(_folders(spark, d)).where("depth >= 0").select("id", F.array_join("path_names", "/").alias("path"))
    return f.join(tree, "id").select("file_id", F.concat_ws("/", "path", "file_name").alias("path"))


@query("SELECT lineage_id, file_id, folder_id, depth_index FROM (SELECT *, count(*) OVER (PARTITION BY file_id, depth_index) AS n FROM file_folder_lineage) WHERE n > 1")
def lineage_repeats(spark, d):
    x = t(spark, d, "file_folder_lineage")
    twice = x.groupBy("file_id", "depth_index").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return x.join(twice, ["file_id", "depth_index"], "left_semi").select("lineage_id", "file_id", "folder_id", "depth_index")


@query("SELECT count(*) AS orphans FROM file_folder_lineage l WHERE NOT EXISTS (SELECT 1 FROM folder_details f WHERE f.folder_id = l.folder_id)")
def fk_orphans(spark, d):
    return t(spark, d, "file_folder_lineage").join(t(spark, d, "folder_details").select("folder_id"), "folder_id", "left_anti").agg(F.count("*").alias("orphans"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def fk_semi(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders").where("o_orderstatus = 'F'"), F.expr("c_custkey = o_custkey"), "left_semi").select("c_custkey")


_PATHS = f"left_ AS (SELECT DISTINCT abs_path FROM file_state WHERE abs_path IS NOT NULL), right_ AS (SELECT {_CLEAN} AS p, min(seq) AS id FROM change_events GROUP BY 1)"


@query(f"""WITH {_PATHS}, m AS (SELECT abs_path, arg_max(id, length(p)) AS suffix FROM left_ JOIN right_ ON abs_path = p OR ends_with(abs_path, '/' || p) GROUP BY abs_path),
b AS (SELECT regexp_extract(p, '([^/]*)$', 1) AS base, count(*) AS n, min(id) AS id FROM right_ GROUP BY 1)
SELECT l.abs_path, coalesce(m.suffix, b.id) AS seq, CASE WHEN m.suffix IS NOT NULL THEN 'suffix' WHEN b.id IS NOT NULL THEN 'name' END AS matched_by
FROM left_ l LEFT JOIN m ON m.abs_path = l.abs_path LEFT JOIN b ON b.base = regexp_extract(l.abs_path, '([^/]*)$', 1) AND b.n = 1""")
def longest_suffix_match(spark, d):
    left = t(spark, d, "file_state").where("abs_path is not null").select("abs_path").distinct()
    right = t(spark, d, "change_events").select(clean_path(F.col("rel_path")).alias("p"), "seq")
    return linkage.longest_suffix_join(left, "abs_path", right, "p", "seq")


@query("""WITH l AS (SELECT DISTINCT rel_path FROM file_state), f AS (SELECT folder_name AS p, min(folder_id) AS id FROM folder_details GROUP BY 1),
m AS (SELECT rel_path, arg_max(id, length(p)) AS folder_id, max(length(p)) AS len FROM l JOIN f ON rel_path = p OR starts_with(rel_path, p || '/') GROUP BY 1)
SELECT l.rel_path, m.folder_id, (len(string_split(l.rel_path, '/')) - len(string_split(l.rel_path[1:m.len], '/')))::int AS cut FROM l LEFT JOIN m USING (rel_path)""")
def prefix_lookup(spark, d):
    left = t(spark, d, "file_state").select("rel_path").distinct()
    return linkage.progressive_prefix_join(left, "rel_path", t(spark, d, "folder_details").select(F.col("folder_name").alias("p"), "folder_id"), "p", "folder_id")


@query("""WITH p AS (SELECT 'nation' AS part, n_nationkey::bigint AS id FROM nation UNION ALL SELECT 'part', p_partkey FROM part UNION ALL SELECT 'supplier', s_suppkey FROM supplier),
b AS (SELECT part, coalesce(sum(top) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS base FROM (SELECT part, max(id) AS top FROM p GROUP BY part))
SELECT part, id AS old_id, id + base AS new_id FROM p JOIN b USING (part)""")
def id_reconcile(spark, d):
    parts = {"nation": t(spark, d, "nation").select(F.col("n_nationkey").alias("id")), "part": t(spark, d, "part").select(F.col("p_partkey").alias("id")), "supplier": t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))}
    return linkage.reconcile_ids(parts, "id")


# -- joins and groups on the star schema --------------------------------------------------------------------------------
@query("SELECT n_name, o_orderpriority, count(*) AS orders, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2 ORDER BY orders DESC, n_name, o_orderpriority LIMIT 25")
def join_group_topk(spark, d):
    x = t(spark, d, "orders").join(t(spark, d, "customer"), F.expr("o_custkey = c_custkey")).join(t(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    return x.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total")).orderBy(F.desc("orders"), "n_name", "o_orderpriority").limit(25)


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def left_join_zero_count(spark, d):
    n = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))  # counted before the join, so hot customers meet no join
    return t(spark, d, "customer").join(n, F.expr("c_custkey = o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base, sum(l_extendedprice * (1 - l_discount)) AS sum_disc, avg(l_quantity) AS avg_qty, count(*) AS n FROM lineitem GROUP BY 1, 2")
def pricing_summary(spark, d):
    p = F.col("l_extendedprice")
    return t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(p).alias("sum_base"), F.sum(p * (1 - F.col("l_discount"))).alias("sum_disc"), F.avg("l_quantity").alias("avg_qty"), F.count("*").alias("n"))


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, count(*) AS n FROM lineitem GROUP BY 1")
def distinct_multi(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts"), F.count("*").alias("n"))


@query("SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS finished, sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS large FROM orders GROUP BY 1")
def conditional_sums(spark, d):
    return t(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_totalprice") > 100000).alias("large"))


@query("SELECT coalesce(lower(trim(source)), '(none)') AS source, count(*) AS documents, sum(n_chars) AS chars FROM documents GROUP BY source IS NULL, 1")
def coalesce_group(spark, d):
    s = F.lower(F.trim("source"))
    return t(spark, d, "documents").groupBy(F.coalesce(s, F.lit("(none)")).alias("source"), F.col("source").isNull().alias("none")).agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars")).drop("none")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (1, 2) HAVING count(*) > 10")
def cube_having(spark, d):
    return t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).where("n > 10")


@query("SELECT n_nationkey FROM nation INTERSECT SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def set_operations(spark, d):
    a, b, c = t(spark, d, "nation").select("n_nationkey"), t(spark, d, "customer").select("c_nationkey"), t(spark, d, "supplier").where("s_acctbal < 0").select("s_nationkey")
    return a.intersect(b).subtract(c)


@query("SELECT a.token, least(a.n, b.n) AS shared FROM (SELECT token, count(*) AS n FROM token_locations WHERE token_kind = 'word' GROUP BY 1) a JOIN (SELECT token, count(*) AS n FROM token_locations WHERE token_kind = 'string' GROUP BY 1) b USING (token)")
def multiset_overlap(spark, d):
    x = t(spark, d, "token_locations")
    n = lambda k, c: x.where(F.col("token_kind") == k).groupBy("token").agg(F.count("*").alias(c))
    return n("word", "a").join(n("string", "b"), "token").select("token", F.least("a", "b").alias("shared"))


# -- profiles -----------------------------------------------------------------------------------------------------------
def _profile_sql(name: str, numbers: list[str], others: list[str]) -> str:
    out = []
    for c in numbers + others:
        stats = f"avg({c})::double AS mean, CASE WHEN count({c}) = 1 THEN 0 ELSE stddev_samp({c}::double) END AS std" if c in numbers else "NULL::double AS mean, NULL::double AS std"
        out.append(f"SELECT '{c}' AS column_name, count(*) AS n, count(*) - count({c}) AS nulls, count({c}) AS non_nulls, count(DISTINCT {c}) AS distinct_values, {stats}, count(DISTINCT {c}) = count(*) AND count(*) > 0 AS is_unique FROM {name}")
    return " UNION ALL ".join(out)


def _profiled(name: str, numbers: list[str], others: list[str]):
    def run(spark, d):
        return profile.column_profile(t(spark, d, name), numbers + others).drop("data_type", "minimum", "maximum", "inferred_type")

    run.__name__ = f"column_profile_{name}"
    query(_profile_sql(name, numbers, others))(run)


for _n, _num, _oth in (
    ("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"], ["l_returnflag", "l_shipdate"]),
    ("orders", ["o_orderkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"]),
    ("customer", ["c_custkey", "c_acctbal"], ["c_name", "c_mktsegment"]),
    ("documents", ["doc_id", "n_chars"], ["lang", "source", "repo"]),
    ("change_events", ["seq", "old_size", "lines_added"], ["analyzer_class", "update_status"]),
):
    _profiled(_n, _num, _oth)


@query("""SELECT column_name, CASE WHEN t = 'BIGINT' OR t = 'INTEGER' THEN 'integer' WHEN t = 'DOUBLE' THEN 'float' WHEN t LIKE 'TIMESTAMP%' THEN 'datetime' WHEN d <= 20 AND d < n THEN 'categorical' ELSE 'string' END AS inferred_type FROM (
SELECT 'o_orderkey' AS column_name, any_value(typeof(o_orderkey)) AS t, count(DISTINCT o_orderkey) AS d, count(o_orderkey) AS n FROM orders UNION ALL SELECT 'o_orderstatus', any_value(typeof(o_orderstatus)), count(DISTINCT o_orderstatus), count(o_orderstatus) FROM orders
UNION ALL SELECT 'o_totalprice', any_value(typeof(o_totalprice)), count(DISTINCT o_totalprice), count(o_totalprice) FROM orders UNION ALL SELECT 'o_orderdate', any_value(typeof(o_orderdate)), count(DISTINCT o_orderdate), count(o_orderdate) FROM orders)""")
def type_inference(spark, d):
    return profile.column_profile(t(spark, d, "orders"), ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"]).select("column_name", "inferred_type")


@query("""WITH x AS (SELECT l_quantity AS a, l_extendedprice AS b, l_quantity * 2 + l_discount AS c, l_tax AS e FROM lineitem), r AS (SELECT 'a' AS l, 'b' AS r, corr(a, b) AS v FROM x UNION ALL SELECT 'a', 'c', corr(a, c) FROM x UNION ALL SELECT 'a', 'e', corr(a, e) FROM x
UNION ALL SELECT 'b', 'c', corr(b, c) FROM x UNION ALL SELECT 'b', 'e', corr(b, e) FROM x UNION ALL SELECT 'c', 'e', corr(c, e) FROM x) SELECT l AS left_column, r AS right_column, round(v, 6) AS r FROM r WHERE abs(v) >= 0.3""")
def pearson_pairs(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"), (F.col("l_quantity") * 2 + F.col("l_discount")).alias("c"), F.col("l_tax").alias("e"))
    return profile.pearson_pairs(x)


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def percentile_nearest_rank(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)").alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])


# -- scalar functions -----------------------------------------------------------------------------------------------------
@query("SELECT p_partkey, (('0x' || substr(sha1('word' || chr(0) || p_name), 1, 15))::bigint) AS hash_id FROM part")
def token_hash_id(spark, d):
    return t(spark, d, "part").select("p_partkey", S.token_hash(F.lit("word"), F.col("p_name")).alias("hash_id"))


_F = lambda n: f"(v >> {S.SHIFT[n]}) & {(1 << dict(S.TS64)[n]) - 1}"


@query(f"""SELECT file_id, (({_F('year')}))::int AS year, (({_F('month')}))::int AS month, (({_F('day')}))::int AS day, ((({_F('am_pm')})) * 12 + (({_F('hour12')})))::int AS hour, (({_F('minute')}))::int AS minute, (({_F('tz_id')}))::int AS tz_id
FROM (SELECT DISTINCT file_id, created_at_ts64 AS v FROM file_details WHERE created_at_ts64 >= 0)""")
def unpack_ts64(spark, d):
    f = lambda n: S.ts64_field(F.col("v"), n)
    x = t(spark, d, "file_details").where("created_at_ts64 >= 0").select("file_id", F.col("created_at_ts64").alias("v")).distinct()
    return x.select("file_id", f("year").alias("year"), f("month").alias("month"), f("day").alias("day"), (f("am_pm") * 12 + f("hour12")).alias("hour"), f("minute").alias("minute"), f("tz_id").alias("tz_id"))


@query(f"""SELECT event_id, ((CASE WHEN y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0) THEN 1::bigint ELSE 0 END << {S.SHIFT['leap_year']}) | ((h // 12) << {S.SHIFT['am_pm']}) | (256::bigint << {S.SHIFT['tz_id']}) | (y << {S.SHIFT['year']})
| (month(ts)::bigint << {S.SHIFT['month']}) | (day(ts)::bigint << {S.SHIFT['day']}) | ((h % 12) << {S.SHIFT['hour12']}) | (minute(ts)::bigint << {S.SHIFT['minute']}) | (second(ts)::bigint << {S.SHIFT['second']}) | (millisecond(ts)::bigint % 1000)) AS packed
FROM (SELECT event_id, ts, year(ts)::bigint AS y, hour(ts)::bigint AS h FROM events)""")
def pack_ts64(spark, d):
    return t(spark, d, "events").select("event_id", S.pack_ts64(F.col("ts")).alias("packed"))


@query("""SELECT doc_id, round(n / pow(1024.0, k), 2) AS value, CASE k WHEN 0 THEN 'Bytes' WHEN 1 THEN 'KB' WHEN 2 THEN 'MB' ELSE 'GB' END AS unit FROM (SELECT doc_id, n_chars * 700 AS n, CASE WHEN n_chars * 700 < 1024 THEN 0 WHEN n_chars * 700 < 1048576 THEN 1 WHEN n_chars * 700 < 1073741824 THEN 2 ELSE 3 END AS k FROM documents)""")
def scaled_size(spark, d):
    v, u = S.scale_size(F.col("n_chars") * 700)
    return t(spark, d, "documents").select("doc_id", v.alias("value"), u.alias("unit"))


@query(r"""SELECT DISTINCT file_id, regexp_extract(file_name, '^(\.?[^.]*)', 1) AS stem, regexp_extract(file_name, '^\.?[^.]+\.(.*)$', 1) AS extension, lower(regexp_extract(file_name, '[^.](\.[^.]+)$', 1)) AS suffix FROM file_details""")
def split_names(spark, d):
    a, b = S.split_name(F.col("file_name"))
    return t(spark, d, "file_details").select("file_id", a.alias("stem"), b.alias("extension"), S.last_suffix(F.col("file_name")).alias("suffix")).distinct()


@query("SELECT file_id, size * CASE lower(trim(units)) WHEN 'kb' THEN 1024 WHEN 'mb' THEN 1048576 WHEN 'gb' THEN 1073741824 ELSE 1 END AS bytes FROM (SELECT DISTINCT file_id, size, units FROM file_details)")
def size_bytes(spark, d):
    u = F.lower(F.trim("units"))
    k = F.when(u == "kb", 1024).when(u == "mb", 1048576).when(u == "gb", 1073741824).otherwise(1)
    return t(spark, d, "file_details").select("file_id", "size", "units").distinct().select("file_id", (F.col("size") * k).cast("double").alias("bytes"))


@query("SELECT hash_id, token[1:4] || repeat('*', least(12, greatest(0, length(token) - 4))) AS mask FROM token_registry WHERE token_kind = 'string'")
def evidence_masks(spark, d):
    return t(spark, d, "token_registry").where("token_kind = 'string'").select("hash_id", S.evidence_mask(F.col("token")).alias("mask"))


@query("SELECT pattern_id, lower(regexp_extract('https://user:pw@' || pattern_name || '.Example.org:8080/x?q=1', '^[A-Za-z][\\w+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)) AS domain FROM grep_pattern_catalog")
def url_domain(spark, d):
    u = F.concat(F.lit("https://user:pw@"), "pattern_name", F.lit(".Example.org:8080/x?q=1"))
    return t(spark, d, "grep_pattern_catalog").select("pattern_id", S.url_domain(u).alias("domain"))


@query("""WITH x AS (SELECT file_id, string_split(text, chr(10)) AS ls, text FROM file_texts) SELECT file_id, len(ls) AS line_count, len(list_filter(ls, lambda x: trim(rtrim(x, chr(13))) = '')) AS blank, list_max(list_transform(ls, lambda x: length(rtrim(x, chr(13))))) AS longest, len(regexp_extract_all(text, '\\b(?:TODO|FIXME)\\b')) AS todo FROM x""")
def line_metrics(spark, d):
    ls = F.split("text", "\n")
    bare = lambda x: F.regexp_replace(x, "\r+$", "")
    return t(spark, d, "file_texts").select("file_id", F.size(ls).alias("line_count"), F.size(F.filter(ls, lambda x: F.trim(bare(x)) == "")).alias("blank"), F.array_max(F.transform(ls, lambda x: F.length(bare(x)))).alias("longest"), F.regexp_count("text", F.lit(r"\b(?:TODO|FIXME)\b")).alias("todo"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN json_valid(props) THEN len(json_keys(props)) END AS keys, json_valid(props) AS valid,
CASE WHEN json_valid(props) THEN 1 + (len(json_keys(props)) > 0)::int END AS depth FROM events""")
def json_metrics(spark, d):
    m = S.json_metrics(F.col("props"))
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.when(m["valid"], m["keys"]).cast("long").alias("keys"), m["valid"].alias("valid"), F.when(m["valid"], m["depth"]).alias("depth"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(?m)^#{1,6}\\s+\\S')) AS headings, len(regexp_extract_all(text, '(?m)^\\s*(?:[-*+]|\\d+[.)])\\s+\\S')) AS list_items, len(regexp_extract_all(text, '(?m)^```')) // 2 AS fences FROM documents")
def markdown_counts(spark, d):
    c = S.layout_counts(F.col("text"))
    return t(spark, d, "documents").select("doc_id", c["headings"].alias("headings"), c["list_items"].alias("list_items"), c["fences"].cast("long").alias("fences"))


_CHECKED = "list_sum(list_transform(list_reverse(string_split(regexp_replace(v, '\\D', '', 'g'), '')), lambda c, i: CASE WHEN i % 2 = 0 THEN (c::int * 2) - CASE WHEN c::int > 4 THEN 9 ELSE 0 END ELSE c::int END)) % 10 = 0"


NO_SQL = ("iban", "isbn", "phone")  # DuckDB's patterns have no lookarounds, and their checks are long


def _entity_sql(key: str, source: str) -> str:
    """Distinct values of each text by category; cards by their check digit, and no account numbers, whose check SQL can't well express."""
    rows = " UNION ALL ".join(f"SELECT {key}, '{c}' AS category, unnest(list_distinct(regexp_extract_all(text, '{rx.replace(chr(39), chr(39) * 2)}'))) AS v FROM {source}" for c, rx in S.ENTITIES.items() if c not in NO_SQL)
    return f"e AS (SELECT * FROM ({rows}) WHERE category <> 'credit_card' OR ({_CHECKED}))"


@query(f"WITH {_entity_sql('doc_id', 'documents')} SELECT doc_id, category, count(*) AS n FROM e GROUP BY 1, 2")
def entity_counts(spark, d):
    e = t(spark, d, "documents").select("doc_id", F.inline(S.entities(F.col("text")))).where(~F.col("category").isin(*NO_SQL))
    return e.groupBy("doc_id", "category").agg(F.count("*").alias("n"))


@query(f"WITH {_entity_sql('file_id', 'file_texts')} SELECT category, count(*) AS n, count(DISTINCT file_id) AS files FROM e GROUP BY 1")
def entity_battery(spark, d):
    e = t(spark, d, "file_texts").select("file_id", F.inline(S.entities(F.col("text")))).where(~F.col("category").isin(*NO_SQL))
    return e.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("files"))


@query()
def checked_entities(spark, d):
    """Entities that SQL has no pattern or check for: account and book numbers, and telephone numbers."""
    e = t(spark, d, "file_texts").select("file_id", F.inline(S.entities(F.col("text")))).where(F.col("category").isin(*NO_SQL))
    return e.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("files"))


@query()
def redacted_texts(spark, d):
    x = t(spark, d, "file_texts").select("file_id", S.redact_emails(S.redact_secrets(F.col("text"))).alias("text"))
    return x.select("file_id", "text", F.regexp_count("text", F.lit(r"\[REDACTED:")).alias("places"))


_SYL = "regexp_replace(x, '[^a-z]', '', 'g')"
_RUNS = f"len(regexp_extract_all({_SYL}, '[aeiouy]+'))"


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{{L}}[\\p{{L}}\\p{{M}}]*(?:[''’\\-]\\p{{L}}[\\p{{L}}\\p{{M}}]*)*') AS w, greatest(len(list_filter(string_split_regex(regexp_replace(trim(text, ' '), '([.!?…]["”’'')\\]]*)\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ') <> '')), 1) AS n_sentences FROM documents),
y AS (SELECT *, list_transform(w, lambda x: CASE WHEN {_SYL} = '' THEN 0 ELSE greatest(1, {_RUNS} - CASE WHEN ends_with({_SYL}, 'e') AND {_RUNS} > 1 THEN 1 ELSE 0 END) END) AS s FROM w)
SELECT doc_id, n_sentences::int AS n_sentences, len(w)::int AS n_words, len(list_distinct(w))::int AS distinct_words, coalesce(list_sum(s), 0)::int AS n_syllables, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::int AS n_chars, len(list_filter(s, lambda x: x >= 3))::int AS n_complex FROM y""")
def lexical(spark, d):
    """Words, distinct words, sentences, syllables and letters of every document; the formulas are in ``view_readability``."""
    w, s = S.letter_words(F.col("text")), S.sentences(F.col("text"))
    x = spread(t(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", w.alias("w"), F.greatest(F.size(s), F.lit(1)).alias("n_sentences"))
    syl = F.transform("w", S.syllables)
    x = x.select("doc_id", "n_sentences", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("distinct_words"), F.aggregate(syl, F.lit(0), lambda a, v: a + v).alias("n_syllables"), F.aggregate("w", F.lit(0), lambda a, v: a + F.length(v)).alias("n_chars"), F.size(F.filter(syl, lambda v: v >= 3)).alias("n_complex"))
    return x


@query(r"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}]+(?:[''’\-][\p{L}\p{M}]+)*|\p{Nd}[\p{Nd},.]*\p{Nd}|\p{Nd}'))) AS token FROM documents) SELECT token, count(*) AS documents FROM w WHERE length(token) >= 3 GROUP BY 1 ORDER BY documents DESC, token LIMIT 20""")
def top_terms(spark, d):
    w = t(spark, d, "documents").select(F.explode(F.array_distinct(S.words(F.col("text")))).alias("token"))
    return w.where(F.length("token") >= 3).groupBy("token").agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "token").limit(20)


@query("""WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '[^\\s]+')) AS n FROM documents), c AS (SELECT doc_id, n, unnest(range(0, greatest(n, 1), 224)) AS start FROM w WHERE n > 0) SELECT doc_id, (start // 224)::int AS chunk_no, start::int AS start, least(256, n - start)::int AS tokens FROM c""")
def chunk_windows(spark, d):
    """Windows of 256 tokens every 224, the last one partial."""
    n = F.size(F.regexp_extract_all("text", F.lit(r"([^ \t\n\r\f\x0b]+)"), F.lit(1)))
    x = t(spark, d, "documents").select("doc_id", n.alias("n")).where("n > 0").select("doc_id", "n", F.posexplode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(224))).alias("chunk_no", "start"))
    return x.select("doc_id", "chunk_no", "start", F.least(F.lit(256), F.col("n") - F.col("start")).alias("tokens"))


_PHRASES = ", ".join(f"({i}, '{m}', '{p.replace(chr(39), chr(39) * 2)}', {w})" for i, (m, ps) in enumerate(S.MOODS.items(), 1) for p, w in ps.items())


@query(f"""WITH p(o, label, phrase, w) AS (VALUES {_PHRASES}), x AS (SELECT doc_id, lower(text) AS low, string_split_regex(lower(text), '\\W+') AS ws, trim(text, ' ') = '' AS blank FROM documents),
s AS (SELECT doc_id, blank, o, label, sum(CASE WHEN CASE WHEN regexp_matches(phrase, '^[a-z0-9]+$') THEN list_contains(ws, phrase) ELSE contains(low, phrase) END THEN w ELSE 0 END)::double AS score FROM x, p GROUP BY 1, 2, 3, 4),
b AS (SELECT doc_id, any_value(blank) AS blank, max(score) AS best, sum(score) AS total, arg_min(label, (-score, o)) AS label FROM s GROUP BY 1),
c AS (SELECT CASE WHEN coalesce(blank, true) OR best <= 0 THEN 'neutral' ELSE label END AS label, CASE WHEN coalesce(blank, true) THEN 0 WHEN best <= 0 THEN 0.2 ELSE round(0.4 * best / total + 0.6 * least(1.0, best / 4.0), 3) END AS sure FROM b)
SELECT label, count(*) AS documents, round(avg(sure), 6) AS confidence FROM c GROUP BY 1""")
def sentiment_labels(spark, d):
    label, sure = S.sentiment(F.col("text"))
    return t(spark, d, "documents").select(label.alias("label"), sure.alias("confidence")).groupBy("label").agg(F.count("*").alias("documents"), F.round(F.avg("confidence"), 6).alias("confidence"))


# -- windows, changes, retention --------------------------------------------------------------------------------------------
@query("SELECT slot, event_id, event_type FROM (SELECT *, ((event_id - 1) % 16 + 16)::int % 16 AS slot, row_number() OVER (PARTITION BY ((event_id - 1) % 16 + 16)::int % 16 ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def ring_buffer(spark, d):
    return retention.ring(t(spark, d, "events").select("event_id", "event_type"), "event_id", 16)


_SNAP = "o AS (SELECT doc_id AS id, md5(text) AS h FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN md5(text || '!') ELSE md5(text) END AS h FROM documents WHERE doc_id % 4 <> 0)"


@query(f"WITH {_SNAP} SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'created' WHEN n.id IS NULL THEN 'deleted' ELSE 'modified' END AS change_type, o.h AS old_hash, n.h AS new_hash FROM o FULL JOIN n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.h <> n.h")
def snapshot_diff(spark, d):
    x = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    old = x.where("id % 3 <> 0").select("id", F.md5("text").alias("h"))
    new = x.where("id % 4 <> 0").select("id", F.when(F.col("id") % 5 == 0, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text")).alias("h"))
    return retention.snapshot_diff(old, new, "id", "h")


@query(f"""SELECT path, hash, size, last_seq FROM (SELECT {_CLEAN} AS path, hash, size, last_seq, row_number() OVER (PARTITION BY {_CLEAN} ORDER BY last_seq DESC, updated_ts::timestamptz DESC, hash DESC NULLS LAST) AS rn FROM file_state) WHERE rn = 1""")
def newest_per_key(spark, d):
    x = t(spark, d, "file_state").select(clean_path(F.col("rel_path")).alias("path"), F.struct("last_seq", F.try_to_timestamp("updated_ts").alias("u"), "hash", "size").alias("r"))
    return x.groupBy("path").agg(F.max("r").alias("r")).select("path", "r.hash", "r.size", "r.last_seq")


@query("""WITH n AS (SELECT o_custkey AS k, o_totalprice AS v, o_orderkey AS o FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey AS k, o_totalprice AS v, o_orderkey AS o FROM orders WHERE o_orderkey % 2 = 1)
SELECT k, arg_max(v, o) AS v, max(o) AS o FROM (SELECT * FROM n UNION ALL SELECT * FROM b) GROUP BY k""")
def upsert_latest(spark, d):
    x = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("o"))
    return retention.upsert(x.where("o % 2 = 1"), x.where("o % 2 = 0"), "k", "o")


_RET = "db AS (SELECT c_custkey AS k, c_custkey % 400 * 86400.0 AS active_at, (c_custkey % 50 + 1) * 1000 AS bytes FROM customer), st AS (SELECT o_custkey AS k, (o_orderkey % 420 * 86400 + o_orderkey % 1009)::double AS made, (o_orderkey % 90 + 1) * 500 AS bytes, o_orderkey % 11 <> 0 AS complete FROM orders)"


@query(f"""WITH {_RET}, ev AS (SELECT k FROM db WHERE 420 * 86400.0 - active_at > 300 * 86400.0), live AS (SELECT * FROM db WHERE k NOT IN (SELECT k FROM ev)),
s0 AS (SELECT st.*, max(CASE WHEN complete AND k IN (SELECT k FROM live) THEN made END) OVER (PARTITION BY k) AS newest FROM st WHERE k NOT IN (SELECT k FROM ev)),
s1 AS (SELECT *, coalesce(complete AND k IN (SELECT k FROM live) AND made = newest, false) AS kept FROM s0),
s2 AS (SELECT *, CASE WHEN NOT complete AND 420 * 86400.0 - made >= 7 * 86400 THEN 'incomplete' WHEN NOT kept AND 420 * 86400.0 - made > 350 * 86400 THEN 'age' END AS reason FROM s1),
tot AS (SELECT (SELECT sum(bytes) FROM live) + (SELECT sum(bytes) FROM s2 WHERE reason IS NULL) AS n), tgt AS (SELECT (SELECT sum(bytes) FROM live) + (SELECT sum(bytes) FROM st) * 0.4 AS n),
f AS (SELECT k, made, coalesce(sum(bytes) OVER (ORDER BY made, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM s2 WHERE reason IS NULL AND NOT kept)
SELECT k AS storage_key, NULL::double AS created_at, 'evict' AS action, 'idle' AS reason FROM ev UNION ALL SELECT k, made, 'prune', reason FROM s2 WHERE reason IS NOT NULL
UNION ALL SELECT k, made, 'prune', 'space' FROM f WHERE (SELECT n FROM tot) - gone > (SELECT floor(n) FROM tgt)""")
def retention_plan(spark, d):
    db = t(spark, d, "customer").select(F.col("c_custkey").alias("storage_key"), (F.col("c_custkey") % 400 * 86400.0).alias("active_at"), ((F.col("c_custkey") % 50 + 1) * 1000).alias("bytes"))
    k = F.col("o_orderkey")
    st = t(spark, d, "orders").select(F.col("o_custkey").alias("storage_key"), (k % 420 * 86400 + k % 1009).cast("double").alias("created_at"), ((k % 90 + 1) * 500).alias("bytes"), (k % 11 != 0).alias("complete"))
    live = db.where(F.lit(420 * 86400.0) - F.col("active_at") <= 300 * 86400.0)
    budget = int((live.agg(F.sum("bytes")).first()[0] or 0) + (st.agg(F.sum("bytes")).first()[0] or 0) * 0.4)
    return retention.retention_plan(db, st, 420 * 86400.0, 300 * 86400.0, 350 * 86400.0, 7 * 86400.0, budget)


@query("""WITH b AS (SELECT least(floor((value - lo) / ((hi - lo) / 10.0)), 9)::int AS bin, event_id % 2 AS half FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)),
c AS (SELECT bin, sum(CASE WHEN half = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN half = 1 THEN 1 ELSE 0 END) AS b FROM b GROUP BY 1), s AS (SELECT bin, greatest(a / (SELECT sum(a) FROM c), 1e-6) AS p, greatest(b / (SELECT sum(b) FROM c), 1e-6) AS q FROM c)
SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM s""")
def psi_drift(spark, d):
    from siltstone.operators.evaluate import psi

    e = t(spark, d, "events")
    return psi(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "value").select(F.round("psi", 6).alias("psi"))


@query("""WITH x AS (SELECT (value - lo) / (hi - lo) AS c, event_type = 'purchase' AS ok FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)), b AS (SELECT least(greatest(ceil(c * 10)::int, 1), 10) AS bin, c, ok FROM x),
g AS (SELECT bin, count(*) AS n, avg(c) AS confidence, avg(CASE WHEN ok THEN 1.0 ELSE 0 END) AS accuracy FROM b GROUP BY 1) SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM g""")
def ece_bins(spark, d):
    from siltstone.operators.evaluate import calibration_bins

    e = t(spark, d, "events")
    lo, hi = e.agg(F.min("value"), F.max("value")).first()
    return calibration_bins(e.select(((F.col("value") - lo) / (hi - lo)).alias("confidence"), (F.col("event_type") == "purchase").alias("correct"))).select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


@query("""WITH x AS (SELECT floor(value)::int AS c, event_type = 'purchase' AS ok FROM events), g AS (SELECT c, count(*) AS n, sum(CASE WHEN ok THEN 0 ELSE 1 END) AS bad FROM x GROUP BY c)
SELECT c AS confidence, round(sum(n) OVER w / (SELECT count(*) FROM x), 6) AS coverage, round(sum(bad) OVER w / sum(n) OVER w, 6) AS risk FROM g WINDOW w AS (ORDER BY c DESC)""")
def risk_coverage(spark, d):
    from siltstone.operators.evaluate import risk_coverage as curve

    x = t(spark, d, "events").select(F.floor("value").cast("int").alias("confidence"), (F.col("event_type") == "purchase").alias("correct"))
    return curve(x).select("confidence", F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


@query("SELECT event_type, count(*) AS records, round(avg(CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 0.0 END), 6) AS success_rate, sum(value) AS cost FROM events GROUP BY 1")
def kpi_rollup(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("records"), F.round(F.avg((F.col("user_id") % 2 == 0).cast("double")), 6).alias("success_rate"), F.sum("value").alias("cost"))


@query("""WITH q AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS qid, e.vec_id AS did, q.label = e.label AS rel, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 9) AS s FROM q JOIN embeddings e ON e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, did) AS rk FROM s), n AS (SELECT qid, sum(rel::int) AS n FROM s GROUP BY 1),
m AS (SELECT qid, avg(CASE WHEN rel THEN 1.0 ELSE 0 END) AS p, sum(rel::int) AS hits, max(CASE WHEN rel THEN 1.0 / rk ELSE 0 END) AS rr, sum(CASE WHEN rel THEN 1 / log2(rk + 1) ELSE 0 END) AS dcg, count(*) AS k FROM r WHERE rk <= 10 GROUP BY qid)
SELECT qid, round(p, 6) AS precision_at_k, round(CASE WHEN n = 0 THEN 1 ELSE hits / n END, 6) AS recall_at_k, round(rr, 6) AS reciprocal_rank, round(dcg, 6) AS dcg, round(CASE WHEN n = 0 THEN 0 ELSE dcg / list_sum(list_transform(range(1, least(n, k)::bigint + 1), lambda i: 1 / log2(i + 1))) END, 6) AS ndcg_at_k FROM m JOIN n USING (qid)""")
def retrieval_metrics(spark, d):
    """Ten nearest rows of every twentieth against all; relevant are rows of the same label."""
    from siltstone.operators.evaluate import ranked_metrics, top_cosine

    e = t(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding", "label")
    top = top_cosine(q, e.select(F.col("vec_id").alias("did"), "embedding", F.col("label").alias("label2")), 10)
    n = e.groupBy("label").agg(F.count("*").alias("n"))
    relevant = q.join(n, "label").select("qid", (F.col("n") - 1).alias("n"))  # the row itself is no result
    return ranked_metrics(top.withColumn("relevant", F.col("label") == F.col("label2")), relevant)


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def hourly_counts(spark, d):
    return t(spark, d, "events").groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("SELECT count(*) AS line_rows, sum(length(body)) AS chars FROM (SELECT unnest(string_split(text, chr(10))) AS body FROM documents)")
def line_explode(spark, d):
    return lines(t(spark, d, "documents").withColumn("text", F.regexp_replace("text", "\r", "~")), "doc_id", "text").agg(F.count("*").alias("line_rows"), F.sum(F.length("body")).alias("chars"))


