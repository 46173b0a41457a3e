import pytest

from siltstone import plugins
from siltstone.operators import families as Y
from siltstone.operators import scripts as Z
from siltstone.operators.catalog import Catalog, View
from siltstone.operators.concordance import concordance


def test_signatures(spark):
    heads = {b"\x89PNG\r\n\x1a\n..": ("png", False), b"MZ\x90": ("pe", True), b"GIF89a": ("gif", False), b"\0\0\0\x18ftypmp42": ("mp4_family", False), b"plain": ("", False), b"": ("", False)}
    d = spark.createDataFrame([(bytearray(b),) for b in heads], "c binary")
    label, runs = Y.detect(d.c)
    assert [tuple(r) for r in d.select(label.alias("l"), runs.alias("r")).collect()] == list(heads.values()) and len(Y.SIGNATURES) == 28


def test_binary_metrics(spark):
    d = spark.createDataFrame([(1, bytearray(range(256)) * 20), (2, bytearray(b"a" * 5000)), (3, bytearray(b"ab")), (4, None)], "id long, content binary")
    d = d.withColumn("e", Y.byte_entropy(d.content))
    got = {r["id"]: (r["byte_size"], r["entropy"], r["is_packed"]) for r in Y.binary_metrics(d, "id", "content", "e").collect()}
    assert got == {1: (5120, 8.0, True), 2: (5000, 0.0, False), 3: (2, 1.0, False)}


def test_family_metrics(spark):
    rows = [(1, '{"a": [1, {"b": "]"}]}', "data", "json"), (2, "a,b\n1,2\n3,4\n", "data", "csv"), (3, "<a><b/><b>x</b></a>", "markup", "xml"), (4, "# Contents\n- [x](#y)\n\n## Y\n```\nz\n```\n", "markup", "markdown"), (5, "[s]\na = 1\nb: 2\n", "config", "settings"), (6, None, "data", "csv"), (7, "x", "text", "text"), (8, "{", "data", "json")]
    d = spark.createDataFrame(rows, "id long, text string, family string, kind string")
    got = {(r["id"], r["metric"]): r["value"] for r in Y.family_metrics(d, "id", "text", "family", "kind").collect()}
    assert got[(1, "is_valid")] == 1.0 and got[(1, "depth")] == 4.0 and got[(1, "arrays")] == 1.0 and got[(8, "is_valid")] == 0.0
    assert got[(2, "rows")] == 3.0 and got[(2, "columns")] == 2.0 and got[(3, "depth")] == 2.0 and got[(3, "distinct_tags")] == 2.0
    assert got[(4, "toc")] == 1.0 and got[(4, "inner_links")] == 1.0 and got[(4, "headings")] == 2.0 and got[(4, "fences")] == 1.0 and got[(5, "sections")] == 1.0 and got[(5, "keys")] == 2.0
    assert not [k for k in got if k[0] in (6, 7)]


def test_plugins(spark):
    r = plugins.standard()
    r.add("settings", *r.parsers["settings"])  # the same again
    with pytest.raises(ValueError):
        r.add("settings", lambda t: [], "a string")
    with pytest.raises(ValueError):
        r.add("other", lambda t: [(t,)], "a string", ".py")
    r.add("shout", lambda t: [(t.upper(),)], "loud string", ".shout")
    assert r.for_ending(".SHOUT")[1] == "loud string" and r.for_ending(".zzz") is None
    plugins.register(spark, r)
    spark.createDataFrame([(1, "a"), (2, None)], "id long, text string").createOrReplaceTempView("plug_texts")
    assert [tuple(x) for x in spark.sql("SELECT id, loud FROM plug_texts, LATERAL shout(text)").collect()] == [(1, "A")]
    assert spark.sql("SELECT check_digit_holds('4111 1111 1111 1111') AS a, masked('secret-value') AS b, longest_common('xaby', 'zabz') AS c").first().asDict() == {"a": True, "b": "secr********", "c": 2}
    d = spark.createDataFrame([(1, "CREATE TABLE a (x INT);"), (2, None)], "id long, text string")
    assert r.run(d, "id", "text", "ddl_objects").count() >= 1


def test_scripts_rebuild_the_tables(spark):
    import sqlite3

    c = Catalog(spark, {"t": spark.createDataFrame([(1, "it's"), (2, None)], "a long, b string"), "u": spark.createDataFrame([(5,)], "c int")}, {"v": View("v", "t", "t.a", order="a"), "w": View("w", "x", "x.a")})
    s = [r["statement"] for r in Z.script(c, ["t", "u"]).orderBy("part", "at", "statement").collect()]
    assert s[0] == "-- dump" and s.index('DROP TABLE IF EXISTS "u";') < s.index('DROP TABLE IF EXISTS "t";')
    con = sqlite3.connect(":memory:")
    con.executescript("\n".join(s))
    assert con.execute("SELECT a, b FROM t ORDER BY a").fetchall() == [(1, "it's"), (2, None)] and con.execute("SELECT * FROM v").fetchall() == [(1,), (2,)]
    once = Z.with_views("x;\n", ["CREATE VIEW a AS SELECT 1;"])
    assert Z.with_views(once, ["CREATE VIEW a AS SELECT 1;"]) == once and Z.with_views(once, []).count(Z.BEGIN) == 1
    Z.install(spark, c)
    assert Z.install(spark, c) == ["t", "u", "v"] and spark.table("v").count() == 2


def test_copies_and_lookups(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (3, "b", 9), (4, None, 1)], "id long, k string, t int")
    assert Z.copy_counted(d, f"file://{tmp_path}/c", ["id"]) == 4 and spark.read.parquet(f"file://{tmp_path}/c").columns == ["id"]
    assert [r["id"] for r in Z.lookup(d, "t", k="a").collect()] == [2, 1] and [r["id"] for r in Z.lookup(d, "t", 1, k=None).collect()] == [4]


def test_location_map(spark):
    import json

    d = spark.createDataFrame([(i, "x y" if i else "x x") for i in range(5)], "file_id long, text string")
    got = {r["token"]: json.loads(r["locations"]) for r in Z.location_map(concordance(d), "file_id", 2).collect()}
    assert got["x"] == {"0": [[1, 0, 1], [1, 2, 3]], "1": [[1, 0, 1]]} and list(got["y"]) == ["1", "2"]


def test_kendall_pairs(spark):
    d = spark.createDataFrame([(1, 1, 1, 4), (2, 2, 3, 3), (3, 3, 2, 2), (4, 4, 4, 1)], "i long, a int, b int, c int")
    got = {(r[0], r[1]): (r[2], r[3]) for r in Z.kendall_pairs(d, "i", ["a", "b", "c"]).collect()}
    assert got == {("a", "b"): (6, round(4 / 6, 6)), ("a", "c"): (6, -1.0), ("b", "c"): (6, round(-4 / 6, 6))}
