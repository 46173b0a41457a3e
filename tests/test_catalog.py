import pytest

from siltstone.operators.catalog import Catalog, NotReadOnly, View, export
from siltstone.sources.files import read


@pytest.fixture(scope="module")
def cat(spark):
    items = spark.createDataFrame([(k, f"item{k}", k % 5) for k in range(20)], "id long, name string, n int")
    views = [View("counts", "items", "n", "rows=count(*)", order="n"), View("gone", "nowhere", "x"), View("shown", "items", "shown=coalesce(label, '(none)')", "rows=count(*)", group="label", order="shown, -rows")]
    return Catalog(spark, {"items": items.selectExpr("*", "CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN '(none)' ELSE 'x' END AS label")}, {v.name: v for v in views})


def test_query_and_limits(cat):
    r = cat.result(cat.query("SELECT id FROM items WHERE n = :n ORDER BY id", {"n": 2}), 3)
    assert r == {"columns": ["id"], "rows": [(2,), (7,), (12,)], "row_count": 3, "truncated": True}
    assert cat.result(cat.query("SELECT * FROM items"), 0)["row_count"] == 20
    assert cat.scalar("SELECT 1 WHERE 0 = 1", default="none") == "none" and cat.scalar("SELECT count(*) FROM items") == 20
    assert [len(b) for b in cat.iterate("SELECT * FROM items", 8)] == [8, 8, 4]
    with pytest.raises(ValueError):
        next(cat.iterate("SELECT 1", 0))


@pytest.mark.parametrize(
    "sql",
    ["DELETE FROM items", "SELECT 1; SELECT 2", "INSERT INTO items VALUES (1)", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "DROP TABLE items", "CREATE TABLE t AS SELECT 1", "SET x = 1", "", "UPDATE items SET n = 1", "TRUNCATE TABLE items"],
)
def test_only_reads(cat, sql):
    with pytest.raises(NotReadOnly):
        cat.query(sql)


def test_views(cat):
    assert cat.selectable() == ["counts", "shown"]
    assert [tuple(r) for r in cat.view("counts").collect()] == [(k, 4) for k in range(5)]
    # a label of its own and a missing one stay two groups
    assert [tuple(r) for r in cat.view("shown").collect()] == [("(none)", 4), ("(none)", 4), ("x", 12)]
    all_ = cat.read_all(["counts", "gone", "other"])
    assert all_["counts"]["row_count"] == 5 and "error" in all_["gone"] and "error" in all_["other"]
    assert {r["name"]: r["rows"] for r in cat.counts().collect()} == {"items": 20}
    assert {(r["name"], r["column"]) for r in cat.describe().collect() if r["kind"] == "view"} == {("counts", "n"), ("counts", "rows"), ("shown", "shown"), ("shown", "rows")}


def test_unified(cat, spark):
    u = Catalog(spark, {}).unify({"a": cat, "b": cat})
    assert u.selectable() == ["a__counts", "a__shown", "b__counts", "b__shown"]
    assert u.view("b__counts").count() == 5


@pytest.mark.parametrize("kind", ["csv", "jsonl", "parquet", "orc"])
def test_export(cat, spark, tmp_path, kind):
    path = f"{tmp_path}/x.{kind}"
    export(cat.table("items"), path, kind)
    assert read(spark, path).count() == 20
