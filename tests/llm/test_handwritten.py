from siltstone.llm.handwritten import Layout, layout, not_handwritten

HAND = "def load(ctx):\n    # keep the order\n    rows = ctx.read('a', 3)\n    return [x for x in rows if x.ok]\n\nclass Row:\n    pass\n"
MIN = "".join(f"function a{i}(b){{return b.c({i})}}var d=e[{i}];if(!f)throw g({i});" for i in range(30))


CASES = [
        ("a.py", ".py", [], HAND, None),
        ("generate_report.py", ".py", ["generators", "vendor_portal", "dist_stats"], HAND, None),
        ("minify.js", ".js", [], "// writes the header: DO NOT put blanks\n" + "function f(a) {\n  return a;\n}\n" * 5, None),
        ("a.min.js", ".js", [], HAND, "minified name"),
        ("a.js", ".js", [], MIN, "minified layout"),
        ("a.py", ".py", ["src", "Node_Modules"], HAND, "third-party folder"),
        ("a.go", ".go", ["gen"], HAND, "output folder"),
        ("a_pb2.py", ".py", [], HAND, "tool name"),
        ("a.go", ".go", [], "// Code generated by x from y.proto. DO NOT EDIT.\npackage a\n", "made by a tool"),
        ("a.java", ".java", [], "// Automatisch erzeugt durch x, nicht von Hand bearbeiten\nclass A {}\n", "made by a tool"),
        ("a.c", ".c", [], "/* libx 2.1  Copyright (c) X. Permission to copy is granted as set out */\nint a;\n", "copied in"),
        ("lib-3.5.4.css", ".css", [], ".a { margin: 1px; }\n", "versioned name"),
        ("a.js", ".js", [], "".join(f"  this.state{i} = t[{i * 7}]; this.next{i} = {i};\n" for i in range(12)), "uniform layout"),
        ("a.go", ".go", [], "var x = []byte{\n" + "  0xd9, 0x80, 0xfb, 0x63,\n" * 9 + "}\n", "data"),
        ("a.py", ".py", [], "T = [\n" + "".join(f'  "{chr(97 + i) * 60}",\n' for i in range(9)) + "]\n", "data"),
        ("a.json", ".json", [], '{\n "k": [1, 2],\n "m": "x",\n "n": 5\n}\n', None),
        ("rows.json", ".json", [], '{\n "lockfileVersion": 3,\n' + "".join(f' "p{i}": {{"version": "1.{i}", "integrity": "sha512-{i}abc"}},\n' for i in range(9)) + "}", "lock file"),
        (None, None, None, None, None), ("", "", [], "", None),
    # "--" and "#" that are no comments, and comments that are
        ("a.h", ".h", [], "/* see b */\n" + "".join(f'#include "some_long_name_{c}.h"\n' for c in "abcdefghijkl"[:3]) + "int f(int x);\nint g(int y);\n", None),
        ("a.c", ".c", [], "#include <a.h>\n#define DO_NOT_EDIT 1\nint f(int i) {\n  --i;\n  return i;\n}\n", None), ("a.sql", ".sql", [], "-- Code generated by x from y. Do not edit.\nSELECT 1;\n", "made by a tool"),
]


def test_evidence(spark):
    """Every case through the whole operator, each with folders of its own."""
    files, texts, folders, ext = [], [], [], {}
    for i, (name, e, dirs, text, _) in enumerate(CASES):
        ids = [1000 * (i + 1) + k for k in range(len(dirs or []))]
        folders += [(f, "repo/" + x, 1) for f, x in zip(ids, dirs or [])]
        files.append((i, name, ext.setdefault(e, len(ext)), str(ids), 1.0, "KB", 1))
        texts.append((i, text))
    f = spark.createDataFrame(files, "file_id long, file_name string, file_extension_id long, raw_location_json string, size double, units string, updated_at long")
    fo = spark.createDataFrame(folders, "folder_id long, folder_name string, updated_at long")
    ex = spark.createDataFrame([(v, k) for k, v in ext.items()], "extension_id long, extension_name string")
    li = spark.createDataFrame([], "file_id long, folder_id long")
    got = {r["file_id"]: r["kinds"] for r in not_handwritten(f, spark.createDataFrame(texts, "file_id long, text string"), fo, ex, li).collect()}
    for i, (*case, kind) in enumerate(CASES):
        assert (kind in got.get(i, [])) if kind else i not in got, case


def test_size(spark):
    """Size alone where there is no text, and together with a layout that nearly tells."""
    near = "T = [\n" + "".join(f'  "{chr(97 + k) * 30}", {chr(98 + k) * 16},\n' for k in range(9)) + "]\n"
    rows = [(1, "a.py", 600.0, "KB", None), (2, "b.py", 0.7, " mb ", ""), (3, "c.py", 100.0, "KB", None), (4, "d.md", 9.0, "MB", None), (5, "e.py", 9.0, "parsecs", None), (6, "f.py", None, "KB", None), (7, "g.py", 9e5, "Bytes", HAND), (8, "h.py", 5.0, "MB", near), (9, "i.py", 5.0, "KB", near)]
    f = spark.createDataFrame([(r[0], r[1], None, None, r[2], r[3], 1) for r in rows], "file_id long, file_name string, file_extension_id long, raw_location_json string, size double, units string, updated_at long")
    t = spark.createDataFrame([(r[0], r[4]) for r in rows], "file_id long, text string")
    none = [spark.createDataFrame([], s) for s in ("folder_id long, folder_name string, updated_at long", "extension_id long, extension_name string", "file_id long, folder_id long")]
    assert {r["file_id"]: r["kinds"] for r in not_handwritten(f, t, *none).collect()} == {1: ["data"], 2: ["data"], 8: ["data"]}


def test_canonical_layout():
    assert Layout("f(a,\n  b);g();if(x){y=1}\n// c\n").lines == ["f ( a , b ) ;", "g ( ) ;", "if ( x ) {", "y = 1 }"] or Layout("f(a,\n  b);g();if(x){y=1}\n// c\n").lines == ["f ( a , b ) ;", "g ( ) ;", "if ( x ) {", "y = 1", "}"]
    x = layout(MIN)
    assert x["expansion"] > 50 and x["kept"] == 0.0 and layout(HAND)["kept"] > 0.8


def test_very_long_text():
    assert layout("x = 1\n" * 200_000)["uniform"] > 0.9


def test_tables_with_nulls_repeats_and_other_columns(spark):
    files = spark.createDataFrame(
        [(1, "a.py", 1, "[7, 8]", 1, "z", 1.0, "KB"), (1, "a.py", 1, "[7, 8]", 2, "z", 1.0, "KB"), (2, "b.py", 1, None, 1, "z", 1.0, "KB"), (3, None, None, "x", 1, "z", 1.0, "KB"), (None, "c.min.js", 1, "[7]", 1, "z", 1.0, "KB"), (4, "d.py", 1, '["7"]', 1, "z", 1.0, "KB")],
        "file_id long, file_name string, file_extension_id long, raw_location_json string, updated_at long, text string, size double, units string",
    )
    texts = spark.createDataFrame([(1, HAND, "q"), (3, None, "q"), (None, HAND, "q")], "file_id long, text string, TEXT string")
    folders = spark.createDataFrame([(7, "repo", 1), (8, "repo/old", 1), (8, "repo/vendor", 2), (9, "repo/x/gen/", None)], "folder_id long, folder_name string, updated_at long")
    ext = spark.createDataFrame([(1, ".py")], "extension_id long, extension_name string")
    lineage = spark.createDataFrame([(2, 9), (4, 9), (None, 9)], "file_id long, folder_id long")
    got = {r["file_id"]: r["kinds"] for r in not_handwritten(files, texts, folders, ext, lineage).collect()}
    assert got == {1: ["third-party folder"], 2: ["output folder"]}
    assert not_handwritten(files.limit(0), texts, folders, ext, lineage).count() == 0
