import io
import pickle
import struct
import zipfile
import zlib

import pandas as pd
import pyarrow as pa
import pyarrow.feather as feather
import pyarrow.ipc as ipc
import pytest

from siltstone.sources import formats as X
from siltstone.sources.files import parse_files

TABLE = pd.DataFrame({"a": [1, 2, 3], "b": ["x", None, "z"]})


def packed(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in files.items():
            z.writestr(n, t)
    return out.getvalue()


def test_arrow_and_feather():
    t = pa.Table.from_pandas(TABLE)
    f, s, fe = io.BytesIO(), io.BytesIO(), io.BytesIO()
    with ipc.new_file(f, t.schema) as w:
        w.write_table(t)
    with ipc.new_stream(s, t.schema) as w:
        w.write_table(t)
    feather.write_feather(t, fe)
    for b in (f, s, fe):
        got = X.arrow_columns(b.getvalue())
        assert [(r[0], r[1], r[3], r[4]) for r in got] == [("a", 1, 3, 0), ("b", 2, 3, 1)]
    with pytest.raises(ValueError):
        X.arrow_columns(b"nothing of this kind")


def test_stata():
    b = io.BytesIO()
    pd.DataFrame({"a": [1.0, None], "b": ["x", "y"]}).to_stata(b, write_index=False)
    assert [(r[0], r[3], r[4]) for r in X.stata_columns(b.getvalue())] == [("a", 2, 1), ("b", 2, 0)]


def test_excel():
    n = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    book = packed({
        "xl/workbook.xml": f'<workbook {n} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {n}><si><t>name</t></si><si><r><t>si</t></r><r><t>ze</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {n}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>5</v></c><c r="D2"><f>A2*2</f><v>10</v></c></row></sheetData></worksheet>',
    })
    assert X.excel_sheets(book) == [("One", 2, 4, ["name", "size"], 1)]
    assert X.any_text(book)[0][1:] == ("converted", "xlsx")


class Evil:
    def __reduce__(self):
        import os

        return os.system, ("true",)


def test_pickles_are_read_without_loading():
    assert any(r[3] for r in X.pickle_calls(pickle.dumps(Evil()))) and not any(r[3] for r in X.pickle_calls(pickle.dumps({"a": [1, 2]})))


def test_executables():
    names = b"\0.text\0.names\0"
    head = struct.pack("<4sBBBB8xHHIQQQIHHHHHH", b"\x7fELF", 2, 1, 1, 0, 2, 62, 1, 0, 0, 64 + len(names), 0, 64, 0, 0, 64, 3, 2)
    sect = lambda name, addr, off, size: struct.pack("<IIQQQQIIQQ", name, 1, 0, addr, off, size, 0, 0, 0, 0)
    elf = head + names + sect(0, 0, 0, 0) + sect(1, 4096, 64, 10) + sect(7, 0, 64, len(names))
    assert X.executable_sections(elf)[1] == ("elf", "x86-64", 64, ".text", 4096, 10)
    pe = b"MZ" + b"\0" * 58 + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664, 1, 0, 0, 0, 2, 0) + struct.pack("<H", 0x20B) + b".text\0\0\0" + struct.pack("<II", 77, 4096) + b"\0" * 24
    assert X.executable_sections(pe) == [("pe", "x86-64", 64, ".text", 4096, 77)]
    assert X.executable_sections(b"\xca\xfe\xba\xbe" + struct.pack(">HHH", 0, 61, 30))[0][1:4:2] == ("java 17", "constants 29")
    assert X.executable_sections(b"\0asm\x01\0\0\0" + b"\x01\x02xx" + b"\x0a\x01y")[0][3:] == ("type", 10, 2)
    with pytest.raises(ValueError):
        X.executable_sections(b"plain text, no more")


def test_anything_to_text():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    assert X.any_text(packed({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>line</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>"})) == [("One line\nTwo", "converted", "docx")]
    assert X.any_text(packed({"a.xhtml": "<html><body><h1>T</h1><script>no()</script><p>x &amp; y</p></body></html>"}))[0] == ("T\n\nx & y", "converted", "epub")
    assert X.any_text(b"<!DOCTYPE html><html><style>a{}</style><p>Hi</p></html>") == [("Hi", "converted", "html")]
    assert X.any_text(rb"{\rtf1{\fonttbl{\f0 Arial;}}Caf\'e9 \u8364? \{x\}\par next}") == [("Café € {x}\nnext", "converted", "rtf")]
    stream = zlib.compress(b"BT /F1 12 Tf (Hello) Tj T* [(W) -20 (orld \\(1\\))] TJ ET")
    assert X.any_text(b"%PDF-1.4\n1 0 obj\n<< /Length 9 >>\nstream\n" + stream + b"\nendstream\nendobj") == [("Hello\nWorld (1)", "converted", "pdf")]
    assert X.any_text(b"") == [("", "empty", None)] and X.any_text(b"a\0b")[0][1] == "binary" and X.any_text("é".encode("latin-1")) == [("é", "decoded", "latin-1")]
    assert X.any_text(b"\xef\xbb\xbfx")[0] == ("x", "decoded", "utf-8-sig") and X.any_text(b"PK\x03\x04broken")[0][1] == "failed"


def test_names(spark):
    names = {"a.TAR.gz": (".tar.gz", "archive"), "x/y.d.ts": (".d.ts", "code"), "m.py": (".py", "code"), ".env": ("", "misc"), "q.csv.gz": (".csv.gz", "data"), "s.sql.gz": (".sql.gz", "archive"), "README": ("", "misc"), "a.b.yaml": (".yaml", "config"), "t.docx": (".docx", "document")}
    d = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r[0]: (r[1], r[2]) for r in d.select("n", X.suffix_of(d.n), X.analyzer_of(d.n)).collect()} == names
    assert len(X.ANALYZERS) == 12


def test_files_are_parsed_by_tasks(spark, tmp_path):
    (tmp_path / "a.html").write_text("<html><p>one</p></html>")
    (tmp_path / "b.bin").write_bytes(b"\0\1")
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["status"]) for r in parse_files(spark, f"file://{tmp_path}", X.any_text, X.TEXT).collect()}
    assert got == {"a.html": ("one", "converted"), "b.bin": ("", "binary")}
