import io
import json
import sqlite3
import struct
import tarfile
import zipfile

import numpy as np

from siltstone.operators import structure as X
from siltstone.sources import files as S

PY = '"""m"""\nimport os\nfrom a.b import c as d\n\nclass K(Base):\n    """doc"""\n    x: int = 1\n    async def f(self, a, *b):\n        return a\n\ny = 2\n'


def test_python(spark):
    df = spark.createDataFrame([(1, PY), (2, "def broken("), (3, None), (4, "")], "file_id long, text string")
    rows = X.extract(df, "file_id", "text", X.python_symbols, X.SYMBOLS).orderBy("ord").collect()
    assert [(r["kind"], r["name"], r["parent"]) for r in rows] == [("import", "os", None), ("import", "a.b.c", "d"), ("class", "K", None), ("variable", "x", "K"), ("function", "f", "K"), ("variable", "y", None)]
    assert [r["arguments"] for r in rows if r["name"] == "f"] == [3] and [r["is_async"] for r in rows if r["name"] == "f"] == [True]


def test_other_languages():
    got = [(r[0], r[1], r[2]) for r in X.pattern_symbols("/* class No {} */\nimport { a } from './b';\nexport class A {\n  public int go(int x, int y) {\n}\nfunc Free(a int) {\ntype T struct {\n")]
    assert got == [("import", "./b", None), ("class", "A", None), ("function", "go", "A"), ("function", "Free", None), ("class", "T", None)]


def test_ddl():
    sql = "-- c;\nCREATE TABLE a (id INT PRIMARY KEY, n VARCHAR(10) NOT NULL DEFAULT 'x;y', b_id INT REFERENCES b(id), CONSTRAINT u UNIQUE (n, id));\nCREATE UNIQUE INDEX i ON a (n); CREATE TRIGGER t BEFORE INSERT ON a EXECUTE f(); CREATE VIEW v AS SELECT 1"
    assert len(X.statements(sql)) == 4
    kinds = [(r[0], r[1]) for r in X.ddl_objects(sql)]
    assert kinds == [("table", "a"), ("column", "id"), ("primary key", "id"), ("column", "n"), ("column", "b_id"), ("foreign key", "b_id"), ("unique", "u"), ("index", "i"), ("trigger", "t"), ("view", "v")]


def test_settings():
    assert X.settings('{"a": {"b": [1, null]}, "c": true}') == [("json", "a.b[0]", 3, "1", "integer"), ("json", "a.b[1]", 3, None, "null"), ("json", "c", 1, "True", "boolean")]
    assert X.settings("[s]\nk = 1\n") == [("toml", "s.k", 2, "1", "integer")]
    assert X.settings("[s]\nk: on it\n") == [("ini", "s.k", 2, "on it", "string")]
    assert X.settings("export A=1\nB='x y'\n") == [("env", "A", 1, "1", "integer"), ("env", "B", 1, "x y", "string")]
    assert X.settings("a:\n  b: 2\n  c:\n    d: x\ne: 1.5\n") == [("yaml", "a.b", 2, "2", "integer"), ("yaml", "a.c.d", 3, "x", "string"), ("yaml", "e", 1, "1.5", "float")]


def test_logs_and_markup():
    assert X.log_records("2024-01-01 10:00:00 INFO a\n  more\nnoise\n[11:00:00] ERROR: b") == [("2024-01-01 10:00:00", "INFO", "a\nmore", 1), ("11:00:00", "ERROR", "b", 4)]
    assert X.elements("<div a=1><p>hi <b>x</b></p><br></div>") == [("div", 1, 1, 0), ("p", 2, 0, 2), ("b", 3, 0, 1), ("br", 2, 0, 0)]


def _zip(items):
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        for n, c in items:
            z.writestr(n, c)
    return f.getvalue()


def test_binary_formats(spark, tmp_path):
    f = io.BytesIO()
    np.save(f, np.zeros((2, 3), np.float32))
    assert S.npy(f.getvalue()) == [("array", "float32", [2, 3], 6, 24)]
    f = io.BytesIO()
    np.savez(f, a=np.zeros(4, np.int64))
    assert S.npz(f.getvalue()) == [("a", "int64", [4], 4, 32)]
    head = json.dumps({"__metadata__": {}, "w": {"dtype": "F16", "shape": [2, 2], "data_offsets": [0, 8]}}).encode()
    assert S.safetensors(struct.pack("<Q", len(head)) + head) == [("w", "F16", [2, 2], 4, 8)]
    inner = _zip([("x.txt", "hello")])
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w") as tar:
        i = tarfile.TarInfo("in.zip")
        i.size = len(inner)
        tar.addfile(i, io.BytesIO(inner))
    assert S.archive_members(t.getvalue()) == [("in.zip", len(inner), 0), ("in.zip!x.txt", 5, 1)]
    db = tmp_path / "a.db"
    con = sqlite3.connect(db)
    con.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, n TEXT)")
    con.execute("INSERT INTO t VALUES (1, 'x')")
    con.commit()
    con.close()
    assert S.sqlite_columns(db.read_bytes()) == [("t", "id", "INTEGER", True, 1), ("t", "n", "TEXT", False, 1)]
    (tmp_path / "bad.db").write_bytes(b"not a database at all")
    got = S.parse_files(spark, str(tmp_path), S.sqlite_columns, "table_name string, column string, type string, is_key boolean, rows long", "*.db").collect()
    assert [r["column"] for r in got] == ["id", "n"]
    assert S.media(b"GIF89a" + struct.pack("<HH", 5, 6)) == [("gif", 5, 6, None, None, None)]
    assert S.geo_bounds(b'{"type": "FeatureCollection", "features": [{"geometry": {"coordinates": [[1, 2], [3, -4]]}}]}') == [(1, 1, -4, 3, 2)]
    assert S.mesh_bounds(b"v 0 0 0\nv 1 2 3\nf 1 2 1\n") == [(2, 1, [0.0, 0.0, 0.0], [1.0, 2.0, 3.0])]
    assert S.sequences(b">a x\nGC\nAT\n>b\n") == [("a", 4, 0.5), ("b", 0, 0.0)]
    assert S.edge_list(b"# c\n1 2\n2 3\n1 2\n") == [(3, 2, 2 / 6)]
    assert S.forensics(b"") == [(0, 0.0, 0.0, 0, False)] and S.forensics(bytes(range(256)) * 32)[0][1] == 8.0


def test_census_and_delimited(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "mod.py").write_text(PY)
    (tmp_path / "README.md").write_text("# x")
    (tmp_path / "t.csv").write_text("a;b\n1;2\n3;4,5\n")
    c = S.census(spark, str(tmp_path), exclude=r"\.csv$")
    folders, files = S.folders_and_files(c)
    assert sorted((r["folder_id"], r["folder_name"], r["parent_folder_id"]) for r in folders.collect()) == [(1, "", None), (2, "pkg", 1)]
    assert sorted((r["file_id"], r["rel_path"], r["folder_id"]) for r in files.collect()) == [(1, "README.md", 1), (2, "pkg/mod.py", 2)]
    assert S.read(spark, str(tmp_path / "t.csv")).columns == ["a", "b"] and S.sniff("a\tb\nc\td\n") == "\t"
