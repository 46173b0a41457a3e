import pytest

from siltstone.operators import matching as M
from siltstone.operators import structure as X
from siltstone.session import materialize
from siltstone.sources.files import census
from siltstone.streaming.polling import changes_between, snapshot


def write(root, files):
    for n, t in files.items():
        p = root / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(t if isinstance(t, bytes) else t.encode())


def test_changes_between_polls(spark, tmp_path):
    root = tmp_path / "repo"
    write(root, {"a.py": "x = 1\ny = 2\n", "b/c.txt": "one\n", "big.bin": b"\1" * 5000, "bin": b"a\0b", ".git/HEAD": "ref"})
    take = lambda: snapshot(spark, f"file://{root}", exclude=r"(^|/)\.git/", hashed=4000, cached=100)
    old = materialize(take(), "snapshot")  # written, as a second poll of the same plan would be answered by a cache
    s = {r["rel_path"]: (r["is_binary"], r["text"], r["hash"][:4]) for r in old.collect()}
    assert s["a.py"][:2] == (False, "x = 1\ny = 2\n") and s["bin"][:2] == (True, None) and s["big.bin"][2] == "sig:" and ".git/HEAD" not in s
    write(root, {"a.py": "x = 1\ny = 3\nz = 4\n", "new": "1\n2\n", "bin": b"a\0c", "long": "l\n" * 90})
    (root / "b/c.txt").unlink()
    got = {r["rel_path"]: (r["change_type"], r["lines_added"], r["lines_removed"]) for r in changes_between(old, take()).collect()}
    assert got == {"a.py": ("modified", 2, 1), "new": ("created", 2, 0), "bin": ("modified", 0, 0), "b/c.txt": ("deleted", 0, 1), "long": ("created", 0, 0)}


def test_census_signatures(spark, tmp_path):
    write(tmp_path, {"a.py": "1", "b.PY": "22", "Makefile": "x", "docs/a.md": "x", "node_modules/x.py": "x", "t/test_a.py": "x" * 50})
    names = lambda **kw: sorted(r["rel_path"] for r in census(spark, f"file://{tmp_path}", **kw).collect())
    assert names(only=[".py", "Makefile"]) == ["Makefile", "a.py", "b.PY", "t/test_a.py"]
    assert names(without=["docs/", "re:test_.*\\.py$"]) == ["Makefile", "a.py", "b.PY"]
    assert "node_modules/x.py" in names(pruned=())
    assert {r["rel_path"]: r["sha256"] is None for r in census(spark, f"file://{tmp_path}", only=[".py"], hashed=10).collect()} == {"a.py": False, "b.PY": False, "t/test_a.py": True}


def test_settings_of_more_syntaxes():
    assert X.properties("a.b = 1\n# no\n! no\nlong = x \\\n   y\nk v\n") == [("properties", "a.b", "1", X._typed("1"), 1), ("properties", "long", "x y", X._typed("x y"), 0), ("properties", "k", "v", X._typed("v"), 0)]
    got = {r[1]: r[2] for r in X.hcl('resource "aws_x" "main" {\n  name = "n" # c\n  tags = {\n    a = 1\n  }\n}\nregion = "eu"\n')}
    assert got == {"resource.aws_x.main.name": "n", "resource.aws_x.main.tags.a": "1", "region": "eu"}
    assert {r[1]: r[2] for r in X.xml_settings('<c x="1"><d>t</d></c>')} == {"c.@x": "1", "c.d": "t"}
    with pytest.raises(ValueError):
        X.xml_settings('<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>')


def test_engines_and_charts(spark):
    d = spark.createDataFrame([(1, "CREATE TABLE a (id SERIAL);"), (2, "CREATE TABLE a (x INT) ENGINE=InnoDB;"), (3, "create table a (x int);"), (4, "select 1"), (5, None)], "id long, text string")
    assert {r[0]: r[1] for r in d.select("id", X.engine_of(d.text)).collect()} == {1: "postgresql", 2: "mysql", 3: "sql", 4: None, 5: None}
    s = spark.createDataFrame([(1, "class", "A", None), (1, "function", "f-x", "A"), (1, "odd", "o", None)], "file_id long, kind string, name string, parent string")
    chart = X.flowcharts(s, "file_id").first()["chart"]
    assert chart.startswith("flowchart TD") and "  A --> f_x" in chart and "  types --> A" in chart and "  file --> others" in chart


def test_symbols_skip_long_strings():
    assert [r[1] for r in X.pattern_symbols('"""\ndef no():\n"""\ndef yes(a):\n  pass\n')] == ["yes"]


def test_case_scores(spark):
    cases = spark.createDataFrame([(1, "same", "a", "a"), (2, "same", None, "a"), (3, "none", "a", "a")], "case_id long, family string, pred string, gold string")
    got = sorted((r["case_id"], r["metric"], r["value"], r["error"]) for r in M.score_cases(cases, {"same": lambda p, g: {"equal": float(len(p) == len(g))}}).collect())
    assert got == [(1, "equal", 1.0, None), (2, None, None, "TypeError"), (3, None, None, "KeyError")]
    assert M.longest_common("xxabcdyy", "zabcdz") == 4 and M.longest_common(None, "a") == 0 and M.longest_common("ab", "cd") == 0
