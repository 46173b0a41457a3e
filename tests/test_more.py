import itertools
import sqlite3

import pytest
from pyspark.sql import functions as F

from siltstone.functions import scalars as S
from siltstone.operators import erasure
from siltstone.operators.catalog import sql_dump
from siltstone.operators.findings import attach_moods, validate


def test_every_pattern_of_lost_shards():
    data = bytes(range(256)) * 3 + b"tail"
    shards = erasure.encode(data, 4, 3)
    for keep in itertools.combinations(range(7), 4):
        assert erasure.decode({i: shards[i] for i in keep}, 4, 3, len(data)) == data
    with pytest.raises(ValueError):
        erasure.decode({0: shards[0]}, 4, 3, len(data))
    assert erasure.decode({5: erasure.encode(b"", 1, 8)[5]}, 1, 8, 0) == b""


def test_scrub_and_markup(spark):
    t = spark.createDataFrame([("card 4111 1111 1111 1111 no 4111 1111 1111 1112 \u0000 a@b.org",), (None,), ("<div><p>x<br/></p></div><a>y</a><script>",)], "t string")
    r = [x[0] for x in t.select(S.scrub(F.col("t"))).collect()]
    assert r[0] == "card [REDACTED:cc] no 4111 1111 1111 1112  [REDACTED:email]" and r[1] is None
    m = S.markup_counts(F.col("t"))
    assert t.select(*[m[k] for k in ("tags", "distinct_tags", "scripts", "links", "depth")]).collect()[2][:] == (5, 5, 1, 1, 2)


def test_validation(spark):
    df = spark.createDataFrame([(1, "x", "10.00", "4", "6.01", "2024-01-05", "2024-01-01", ["x"]), (2, None, "abc", "1", "1", "no", None, ["y"]), (3, "q", "2", "1", "1", "2024-01-01", "2024-01-02", ["x"])], "id long, name string, total string, a string, b string, start string, stop string, known array<string>")
    rules = [
        {"field": "name", "rule": "required"}, {"field": "name", "rule": "enum", "value": ["x", "q"]}, {"field": "name", "rule": "reference", "value": "known"}, {"field": "total", "rule": "type", "value": "double"}, {"field": "total", "rule": "sum", "value": ["a", "b"]},
        {"field": "start", "rule": "format", "value": "date"}, {"field": "start", "rule": "before", "value": "stop"}, {"field": "total", "rule": "range", "low": 5}, {"field": "a", "rule": "regex", "value": r"^\d$"},
    ]
    got = {(r["id"], r["field"], r["rule"]) for r in validate(df, "id", rules).collect()}
    assert got == {(1, "start", "before"), (2, "name", "required"), (2, "total", "type"), (2, "start", "format"), (3, "name", "reference"), (3, "total", "range")}
    with pytest.raises(ValueError):
        validate(df, "id", [{"field": "a", "rule": "none"}])


def test_moods(spark):
    s = spark.createDataFrame([("p", 1, 10), ("p", 5, 11), ("q", 1, 12)], "project string, ts long, session_id long")
    p = spark.createDataFrame([("p", 2, "thanks, looks good"), ("p", 3, "wrong"), ("q", 0, "great")], "project string, ts long, text string")
    assert {r["session_id"]: r["label"] for r in attach_moods(s, p).collect()} == {10: "satisfied", 11: "pending", 12: "pending"}


def test_sql_dump_loads(spark):
    df = spark.createDataFrame([(1, "it's", True, 1.5, ["a"]), (2, None, None, None, None)], "id long, s string, b boolean, d double, a array<string>")
    create, inserts = sql_dump(df, "t")
    con = sqlite3.connect(":memory:")
    con.executescript(create + "\n".join(r[0] for r in inserts.collect()))
    assert con.execute("SELECT * FROM t ORDER BY id").fetchall() == [(1, "it's", 1, 1.5, '["a"]'), (2, None, None, None, None)]
    assert sql_dump(df, "t", "pgsql")[0] == 'CREATE TABLE "t" ("id" BIGINT, "s" TEXT, "b" BOOLEAN, "d" DOUBLE PRECISION, "a" JSONB);'


def test_more_parsers():
    from siltstone.operators import structure as X

    assert X.manifest('{"dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}}') == [("npm", "a", "^1", "dependencies"), ("npm", "b", "2", "devDependencies")]
    assert X.manifest("# c\nnumpy>=1.2 ; x\npkg\n") == [("pypi", "numpy", ">=1.2", "dependencies"), ("pypi", "pkg", None, "dependencies")]
    assert X.manifest('[project]\ndependencies = ["a[x]>=1"]\n') == [("pypi", "a[x]", ">=1", "dependencies")]
    assert X.notebook('{"cells": [{"cell_type": "code", "source": ["a\\n", "b"], "outputs": [1]}]}') == [("code", 2, 1)]
    assert X.patches("--- a/x\n+++ b/x\n@@ -1 +1,2 @@\n-a\n+b\n+c\n c\n") == [("a/x", "b/x", 1, 2, 1)]
    got = X.interface_objects("message A { required string n = 1; repeated B bs = 2; }\nenum E { X = 0; }\ntype T { id: ID!\n name: String }\nservice S { rpc Go (A) returns (B); }")
    assert [(r[0], r[1], r[2]) for r in got] == [("message", "A", None), ("field", "n", "A"), ("field", "bs", "A"), ("enum", "E", None), ("value", "X", "E"), ("type", "T", None), ("field", "id", "T"), ("field", "name", "T"), ("service", "S", None), ("method", "Go", "S")]
    assert [r[4] for r in got if r[0] == "field"] == [False, True, False, True]


def test_trees_formulas_and_grounding(spark):
    from siltstone.operators import matching as M

    t = lambda *c: ("x", list(c))
    assert M.tree_distance(("f", [("d", [("a", []), ("c", [("b", [])])]), ("e", [])]), ("f", [("c", [("d", [("a", []), ("b", [])])]), ("e", [])])) == 2.0
    assert M.tree_distance(t(t(), t()), t(t())) == 1.0 and M.tree_distance(t(), t()) == 0.0
    a = (("table", ""), [(("tr", ""), [(("td", "one"), []), (("td", "two"), [])])])
    b = (("table", ""), [(("tr", ""), [(("td", "one"), []), (("td", "tow"), [])])])
    assert M.table_similarity(a, a) == 1.0 and M.table_similarity(a, b, structure_only=True) == 1.0 and 0.8 < M.table_similarity(a, b) < 1.0
    assert M.formula_f1(r"\frac{a}{b}", r"\frac{a}{b}") == 1.0 and M.formula_f1("", "") == 1.0 and M.formula_f1("a", "b") == 0.0
    df = spark.createDataFrame([(1, "The cat sat. Dogs fly high.", "Here the  CAT sat. ok"), (2, None, None)], "case_id long, answer string, source string")
    assert {r["case_id"]: (r["claims"], r["grounded"], r["unsupported"], r["faithfulness"]) for r in M.grounding(df).collect()} == {1: (2, 1, 1, 0.5), 2: (0, 0, 0, 1.0)}
