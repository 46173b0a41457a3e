"""Queries p1_, p3_ and p4_: the general operators on the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.changelog import SortedRuns
from siltstone.operators.hierarchy import descendants_of_all, hierarchy, valid_rows
from siltstone.operators.incremental import PartitionedIncrement
from siltstone.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return PartitionedIncrement(spark).plan(table(spark, d, "change_events"), table(spark, d, "file_state")).select("seq")


def p1_next_state(spark: SparkSession, d: str) -> DataFrame:
    """The state that a whole run leaves, from which the next one goes on."""
    store = PartitionedIncrement(spark)
    store.run(table(spark, d, "change_events"), table(spark, d, "file_state"))
    return store.state().select(F.col("path").alias("rel_path"), "last_seq", "hash", "size")


def _folders(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "folder_details")
    return valid_rows(f.withColumn("name", F.regexp_extract(F.rtrim(F.col("folder_name")), r"([^/\\]*)[/\\]*$", 1)), "folder_id", "parent_folder_id", "name", "updated_at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    t = hierarchy(_folders(spark, d), paths=False)
    return t.select(F.col("id").alias("folder_id"), F.col("root").alias("root_folder_id"), "depth")


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path by the names as they are now, and the number of folders below and including each."""
    t = hierarchy(_folders(spark, d))
    return t.select(F.col("id").alias("folder_id"), F.array_join("path_names", "/").alias("path"), F.col("subtree").alias("folders_below"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every folder, as rows."""
    return descendants_of_all(_folders(spark, d)).select(F.col("ancestor").alias("folder_id"), F.col("descendant").alias("descendant_id"), "distance")


def p3_lineage_check(spark: SparkSession, d: str) -> DataFrame:
    """Rows of file_folder_lineage by whether their depth_index is the folder's depth in its tree."""
    tree = hierarchy(_folders(spark, d), paths=False).select(F.col("id").alias("folder_id"), "depth")
    x = table(spark, d, "file_folder_lineage").join(tree, "folder_id", "left")
    state = F.when(F.col("depth").isNull(), "no folder").when(F.col("depth") < 0, "circle").when(F.col("depth") == F.col("depth_index"), "agrees").otherwise("differs")
    return x.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    store = SortedRuns(spark)
    store.append_slices(table(spark, d, "change_events"), "recorded_at", 4)
    return store.alive()


def p4_compacted(spark: SparkSession, d: str) -> DataFrame:
    """Keys and tombstones of the store after compaction."""
    store = SortedRuns(spark)
    store.append_slices(table(spark, d, "change_events"), "recorded_at", 4)
    store.compact()
    return store.merge().groupBy("dead").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


QUERIES = {f.__name__: f for f in (p1_found, p1_next_state, p3_found, p3_paths, p3_descendants, p3_lineage_check, p4_found, p4_compacted)}

_CLEAN = "regexp_replace(regexp_replace(regexp_replace(trim(rel_path), '[\\\\/]+', '/', 'g'), '(^|/)(?:\\./)+', '\\1', 'g'), '(.)(?:/\\.)?/?$', '\\1')"
_KIND = "CASE WHEN lower(trim(change_type)) LIKE 'delet%' OR lower(trim(change_type)) LIKE 'remov%' THEN 'deleted' ELSE 'other' END"
_VALID_STATE = f"""state AS (SELECT coalesce({_CLEAN}, '') AS path, last_seq, hash, size, timezone('UTC', updated_ts::timestamptz) AS updated,
  row_number() OVER (PARTITION BY coalesce({_CLEAN}, '') ORDER BY updated_ts::timestamptz DESC, last_seq DESC) AS rn FROM file_state),
valid AS (SELECT * FROM state WHERE rn = 1)"""
_CHANGES = f"""changes AS (SELECT seq, min(coalesce({_CLEAN}, '')) AS path, min(recorded_at) AS arrival, max({{kind}}) AS kind, max(new_hash) AS new_hash, max(new_size) AS new_size
  FROM change_events WHERE seq IS NOT NULL GROUP BY seq)""".replace("{kind}", _KIND)
_PENDING = f"""WITH {_VALID_STATE}, {_CHANGES}, pending AS (SELECT c.* FROM changes c LEFT JOIN valid v ON c.path = v.path
  WHERE v.path IS NULL OR v.last_seq IS NULL OR c.seq > v.last_seq OR c.arrival > v.updated)"""
_TREE = """WITH RECURSIVE f AS (SELECT folder_id AS id, parent_folder_id AS parent, regexp_extract(rtrim(folder_name), '([^/\\\\]*)[/\\\\]*$', 1) AS name FROM (
  SELECT *, row_number() OVER (PARTITION BY folder_id ORDER BY updated_at DESC, parent_folder_id DESC NULLS LAST, folder_name DESC) AS rn FROM folder_details) WHERE rn = 1),
l AS (SELECT f.id, f.name, p.id AS up FROM f LEFT JOIN f p ON p.id = f.parent),
t AS (SELECT id, id AS root, 0 AS depth, name AS path, [id] AS ids FROM l WHERE up IS NULL
  UNION ALL SELECT l.id, t.root, t.depth + 1, t.path || '/' || l.name, list_append(t.ids, l.id) FROM t JOIN l ON l.up = t.id),
res AS (SELECT id, up FROM l WHERE id NOT IN (SELECT id FROM t)),
c AS (SELECT id, up AS x FROM res UNION SELECT c.id, res.up FROM c JOIN res ON res.id = c.x),
ring AS (SELECT id FROM c WHERE id = x),
low AS (SELECT c.id, min(c.x) AS root FROM c JOIN ring ON ring.id = c.x GROUP BY c.id)"""

ORACLE = {
    "p1_found": f"{_PENDING} SELECT seq FROM pending",
    "p1_next_state": f"""{_PENDING}, news AS (SELECT path, max(seq) AS seq, arg_max(kind, seq) AS kind, arg_max(coalesce(new_hash, '-'), seq) AS new_hash, arg_max(coalesce(new_size, -1), seq) AS new_size FROM pending GROUP BY path)
SELECT coalesce(v.path, n.path) AS rel_path, greatest(v.last_seq, n.seq) AS last_seq,
  CASE WHEN n.seq IS NOT NULL AND (v.last_seq IS NULL OR n.seq > v.last_seq) THEN CASE WHEN n.kind = 'deleted' THEN NULL ELSE nullif(n.new_hash, '-') END ELSE v.hash END AS hash,
  CASE WHEN n.seq IS NOT NULL AND (v.last_seq IS NULL OR n.seq > v.last_seq) THEN CASE WHEN n.kind = 'deleted' THEN NULL ELSE nullif(n.new_size, -1) END ELSE v.size END AS size
FROM valid v FULL JOIN news n ON v.path = n.path""",
    "p3_found": f"{_TREE} SELECT id AS folder_id, root AS root_folder_id, depth::int AS depth FROM t UNION ALL SELECT id, root, -1 FROM low",
    "p3_paths": f"""{_TREE}, below AS (SELECT a, count(*) AS n FROM (SELECT unnest(ids) AS a FROM t) GROUP BY a)
SELECT id AS folder_id, path, n AS folders_below FROM t JOIN below ON a = id
UNION ALL SELECT r.id, NULL, (SELECT count(DISTINCT x.id) FROM (SELECT id, x AS y FROM c UNION SELECT id, id FROM res) x WHERE x.y = r.id) FROM res r WHERE r.id NOT IN (SELECT id FROM ring)
UNION ALL SELECT id, NULL, NULL FROM ring""",
    # below circles: the walk up from each node, as far as it meets nobody twice
    "p3_descendants": f"""{_TREE}, walk AS (SELECT id, id AS x, 0 AS k, [id] AS seen FROM res
  UNION ALL SELECT w.id, r.up, w.k + 1, list_append(w.seen, r.up) FROM walk w JOIN res r ON r.id = w.x WHERE NOT list_contains(w.seen, r.up))
SELECT a AS folder_id, id AS descendant_id, (depth - k + 1)::int AS distance FROM (SELECT id, depth, unnest(ids) AS a, unnest(range(1, len(ids) + 1)) AS k FROM t)
UNION ALL SELECT x, id, k::int FROM walk""",
    "p3_lineage_check": f"""{_TREE}, d AS (SELECT id, depth FROM t UNION ALL SELECT id, -1 FROM low)
SELECT CASE WHEN depth IS NULL THEN 'no folder' WHEN depth < 0 THEN 'circle' WHEN depth = depth_index THEN 'agrees' ELSE 'differs' END AS state, count(*) AS n FROM file_folder_lineage LEFT JOIN d ON id = folder_id GROUP BY 1""",
    "p4_found": f"""SELECT path AS rel_path, seq, new_hash FROM (SELECT coalesce({_CLEAN}, '') AS path, seq, {_KIND} AS kind, new_hash,
  row_number() OVER (PARTITION BY coalesce({_CLEAN}, '') ORDER BY seq DESC, {_KIND} = 'deleted' DESC, new_hash DESC NULLS LAST) AS rn FROM change_events WHERE seq IS NOT NULL) WHERE rn = 1 AND kind <> 'deleted'""",
    "p4_compacted": f"""SELECT kind = 'deleted' AS dead, count(*) AS n, max(seq) AS last_seq FROM (SELECT seq, {_KIND} AS kind,
  row_number() OVER (PARTITION BY coalesce({_CLEAN}, '') ORDER BY seq DESC, {_KIND} = 'deleted' DESC, new_hash DESC NULLS LAST) AS rn FROM change_events WHERE seq IS NOT NULL) WHERE rn = 1 GROUP BY 1""",
}
