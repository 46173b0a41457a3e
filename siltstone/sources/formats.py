"""Parsers of office, statistical and executable formats, and a reader that makes text of anything it can.

Each is a function from the bytes of a file to rows, to be run by ``files.parse_files``; a file that isn't of the format raises
and gives no rows. Nothing here needs more than the standard library, pandas and pyarrow."""

from __future__ import annotations

import io
import pickletools
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
import pyarrow.ipc as ipc
from pyspark.sql import Column
from pyspark.sql import functions as F

COLUMNS = "column_name string, ordinal int, data_type string, row_count long, nulls long"


def _profile(df: pd.DataFrame) -> list[tuple]:
    return [(str(c), i, str(df[c].dtype), len(df), int(df[c].isna().sum())) for i, c in enumerate(df.columns, 1)]


def arrow_columns(content: bytes) -> list[tuple]:
    """Columns of an Arrow file, a stream or a Feather file."""
    source = pa.BufferReader(content)
    try:
        t = ipc.open_file(source).read_all()
    except pa.ArrowInvalid:
        try:
            t = ipc.open_stream(pa.BufferReader(content)).read_all()
        except pa.ArrowInvalid as e:
            raise ValueError(str(e)) from None
    return [(n, i, str(t.schema.field(n).type), t.num_rows, t.column(n).null_count) for i, n in enumerate(t.column_names, 1)]


def stata_columns(content: bytes) -> list[tuple]:
    return _profile(pd.read_stata(io.BytesIO(content)))


def sas_columns(content: bytes) -> list[tuple]:
    """Of a transport file or a data set, told by its first bytes."""
    kind = "xport" if content.startswith(b"HEADER RECORD") else "sas7bdat"
    return _profile(pd.read_sas(io.BytesIO(content), format=kind))


SHEETS = "sheet string, rows long, columns long, header array<string>, formulas long"
_N = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column_number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n


def excel_sheets(content: bytes) -> list[tuple]:
    """Sheets of a workbook with their size, the texts of their first row and how many cells are computed."""
    z = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(_N + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(_N + "si")]
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ET.fromstring(z.read("xl/workbook.xml")).iter(_N + "sheet"):
        target = targets[s.get(_R + "id")].lstrip("/")
        sheet = ET.fromstring(z.read(target if target.startswith("xl/") else "xl/" + target))
        rows, wide, header, formulas = 0, 0, [], 0
        for row in sheet.iter(_N + "row"):
            rows += 1
            for k, c in enumerate(row.iter(_N + "c"), 1):
                wide = max(wide, _column_number(c.get("r") or "") or k)
                formulas += c.find(_N + "f") is not None
                v = c.find(_N + "v")
                text = (v.text or "") if v is not None else "".join(t.text or "" for t in c.iter(_N + "t"))
                if rows == 1:
                    header.append(shared[int(text)] if c.get("t") == "s" else text)
        out.append((s.get("name"), rows, wide, header, formulas))
    return out


PICKLE = "position long, opcode string, argument string, is_risky boolean"


def pickle_calls(content: bytes) -> list[tuple]:
    """What a pickle would import and call, without loading it."""
    rows, strings = [], []
    for op, arg, at in pickletools.genops(content):
        if isinstance(arg, str) and "UNICODE" in op.name:
            strings.append(arg)
        if op.name in ("GLOBAL", "STACK_GLOBAL", "REDUCE", "BUILD", "INST", "OBJ", "NEWOBJ"):
            what = str(arg) if op.name in ("GLOBAL", "INST") else ".".join(strings[-2:]) if op.name == "STACK_GLOBAL" else None
            rows.append((at, op.name, what, bool(what) and bool(re.match(r"(?:os|posix|nt|subprocess|builtins|__builtin__|sys|socket|shutil)\b", what.replace(" ", ".")))))
    return rows


SECTIONS = "kind string, machine string, bits int, name string, address long, size long"
# Numbers of machines in ELF and PE headers.
ELF_MACHINES = {3: "x86", 8: "mips", 20: "ppc", 21: "ppc64", 40: "arm", 62: "x86-64", 183: "aarch64", 243: "riscv"}
PE_MACHINES = {0x14C: "x86", 0x8664: "x86-64", 0x1C0: "arm", 0xAA64: "aarch64"}


def _elf(b: bytes) -> list[tuple]:
    wide, end = b[4] == 2, "<" if b[5] == 1 else ">"
    machine = struct.unpack_from(end + "H", b, 18)[0]
    at = struct.unpack_from(end + ("Q" if wide else "I"), b, 40 if wide else 32)[0]
    size, n, names = struct.unpack_from(end + "HHH", b, 58 if wide else 46)
    heads = [struct.unpack_from(end + ("IIQQQQ" if wide else "IIIIII"), b, at + k * size) for k in range(n)]
    base = heads[names][4] if n else 0
    label = lambda k: b[base + k : b.index(b"\0", base + k)].decode("latin-1")
    return [("elf", ELF_MACHINES.get(machine, str(machine)), 64 if wide else 32, label(h[0]), h[3], h[5]) for h in heads]


def _pe(b: bytes) -> list[tuple]:
    at = struct.unpack_from("<I", b, 60)[0]
    if b[at : at + 4] != b"PE\0\0":
        raise ValueError("no PE header")
    machine, n = struct.unpack_from("<HH", b, at + 4)
    optional = struct.unpack_from("<H", b, at + 20)[0]
    bits = 64 if struct.unpack_from("<H", b, at + 24)[0] == 0x20B else 32
    out = []
    for k in range(n):
        p = at + 24 + optional + 40 * k
        size, address = struct.unpack_from("<II", b, p + 8)
        out.append(("pe", PE_MACHINES.get(machine, str(machine)), bits, b[p : p + 8].rstrip(b"\0").decode("latin-1"), address, size))
    return out


def _class(b: bytes) -> list[tuple]:
    minor, major, n = struct.unpack_from(">HHH", b, 4)
    return [("class", f"java {major - 44}", 32, f"constants {n - 1}", minor, len(b))]


def _wasm(b: bytes) -> list[tuple]:
    names = "custom type import function table memory global export start element code data".split()
    out, at = [], 8
    while at < len(b):
        kind, at = b[at], at + 1
        size = shift = 0
        while True:
            size |= (b[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if not b[at - 1] & 128:
                break
        out.append(("wasm", "wasm", 32, names[kind] if kind < len(names) else str(kind), at, size))
        at += size
    return out


def executable_sections(content: bytes) -> list[tuple]:
    """Sections of ELF and PE files and of WebAssembly, the version of Java classes and of compiled Python."""
    if content[:4] == b"\x7fELF":
        return _elf(content)
    if content[:2] == b"MZ":
        return _pe(content)
    if content[:4] == b"\xca\xfe\xba\xbe":
        return _class(content)
    if content[:4] == b"\0asm":
        return _wasm(content)
    if len(content) >= 16 and content[2:4] == b"\r\n":
        return [("pyc", f"python magic {struct.unpack_from('<H', content)[0]}", 32, "code", 16, len(content) - 16)]
    raise ValueError("no executable that is known")


# -- anything to text -----------------------------------------------------------------------------------------------------
TEXT = "text string, status string, detail string"


class _Plain(HTMLParser):
    SKIP, BREAK = {"script", "style", "template"}, set("p div br li tr h1 h2 h3 h4 h5 h6 section article table ul ol pre blockquote".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.SKIP
        if tag in self.BREAK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in self.SKIP))
        if tag in self.BREAK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def _tidy(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", text)).strip()


def html_text(text: str) -> str:
    p = _Plain()
    p.feed(text)
    p.close()
    return _tidy("".join(p.out))


def rtf_text(text: str) -> str:
    """Text of an RTF document: groups of tables and pictures out, paragraphs as lines, escaped characters as they are."""
    out, skip, stack = [], False, []
    for m in re.finditer(r"\\'([0-9a-f]{2})|\\u(-?\d+)\s?\??|\\(\*)|\\([a-z]+)(-?\d+)? ?|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", text, re.I):
        code, uni, star, word, _, sign, brace, plain = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif star or word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer"):
            skip = True
        elif skip:
            continue
        elif code:
            out.append(bytes.fromhex(code).decode("cp1252", "replace"))
        elif uni:
            out.append(chr(int(uni) % 65536))
        elif word in ("par", "line", "row"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif sign:
            out.append(sign if sign in "\\{}" else " " if sign == "~" else "")
        elif plain:
            out.append(plain)
    return _tidy("".join(out))


def _xml_text(content: bytes, breaks: tuple[str, ...]) -> str:
    out: list[str] = []

    def walk(e) -> None:
        out.append(e.text or "")
        for c in e:
            walk(c)
            out.append(c.tail or "")
        if isinstance(e.tag, str) and e.tag.rsplit("}", 1)[-1] in breaks:
            out.append("\n")

    walk(ET.fromstring(content))
    return _tidy("".join(out))


def package_text(content: bytes) -> tuple[str, str]:
    """(text, what it is) of Office, OpenDocument and EPUB packages."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names = z.namelist()
    pick = lambda rx: sorted((n for n in names if re.fullmatch(rx, n)), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])
    if "word/document.xml" in names:
        return _xml_text(z.read("word/document.xml"), ("p", "br", "tr")), "docx"
    if slides := pick(r"ppt/slides/slide\d+\.xml"):
        return "\n\n".join(_xml_text(z.read(n), ("p",)) for n in slides), "pptx"
    if "xl/workbook.xml" in names:
        parts = [*pick(r"xl/sharedStrings\.xml"), *pick(r"xl/worksheets/sheet\d+\.xml")]
        return "\n".join(_xml_text(z.read(n), ("si", "row")) for n in parts), "xlsx"
    if "content.xml" in names:
        return _xml_text(z.read("content.xml"), ("p", "h", "table-row")), "opendocument"
    if pages := pick(r".*\.x?html?"):
        return "\n\n".join(html_text(z.read(n).decode("utf-8", "replace")) for n in pages), "epub"
    raise ValueError("no document package")


def pdf_text(content: bytes) -> str:
    """Text that the content streams of a PDF show, for fonts with plain character codes; streams that aren't deflated or open are left out."""
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", content, re.S):
        raw = m.group(1)
        try:
            raw = zlib.decompress(raw)
        except zlib.error:
            if b"BT" not in raw:
                continue
        for block in re.findall(rb"BT(.*?)ET", raw, re.S):
            for s, op in re.findall(rb"((?:\((?:\\.|[^\\()])*\)|\[(?:\((?:\\.|[^\\()])*\)|[^\]])*\])?)\s*(Tj|TJ|'|T\*|Td|TD)", block):
                if op in (b"T*", b"Td", b"TD", b"'"):
                    out.append("\n")
                for piece in re.findall(rb"\(((?:\\.|[^\\()])*)\)", s):
                    out.append(re.sub(rb"\\([nrtbf()\\])", lambda x: {b"n": b"\n", b"r": b"\n", b"t": b"\t"}.get(x[1], x[1]), piece).decode("latin-1"))
        out.append("\n")
    return _tidy("".join(out))


def any_text(content: bytes) -> list[tuple]:
    """(text, status, detail): converted where the bytes tell a format, decoded where they are text, else 'binary' without a text."""
    if not content:
        return [("", "empty", None)]
    try:
        if content[:4] == b"PK\x03\x04":
            text, kind = package_text(content)
            return [(text, "converted", kind)]
        if content[:5] == b"%PDF-":
            return [(pdf_text(content), "converted", "pdf")]
        if content[:5] == b"{\\rtf":
            return [(rtf_text(content.decode("latin-1")), "converted", "rtf")]
    except (ValueError, KeyError, zipfile.BadZipFile, ET.ParseError) as e:
        return [("", "failed", type(e).__name__)]
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return [(content.decode(name, "replace"), "decoded", name)]
    if b"\0" in content[:8192]:
        return [("", "binary", None)]
    try:
        text, name = content.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        text, name = content.decode("latin-1"), "latin-1"
    if re.match(r"\s*(?:<!doctype html|<html)\b", text, re.I):
        return [(html_text(text), "converted", "html")]
    return [(text, "decoded", name)]


# -- which parser for which name --------------------------------------------------------------------------------------------
PARSERS: dict[str, tuple[Callable[[bytes], list[tuple]], str]] = {
    ".arrow": (arrow_columns, COLUMNS), ".feather": (arrow_columns, COLUMNS), ".dta": (stata_columns, COLUMNS), ".sas7bdat": (sas_columns, COLUMNS), ".xpt": (sas_columns, COLUMNS), ".xlsx": (excel_sheets, SHEETS), ".xlsm": (excel_sheets, SHEETS),
    ".pkl": (pickle_calls, PICKLE), ".pickle": (pickle_calls, PICKLE), ".elf": (executable_sections, SECTIONS), ".so": (executable_sections, SECTIONS), ".exe": (executable_sections, SECTIONS), ".dll": (executable_sections, SECTIONS),
    ".class": (executable_sections, SECTIONS), ".wasm": (executable_sections, SECTIONS), ".pyc": (executable_sections, SECTIONS), ".docx": (any_text, TEXT), ".pptx": (any_text, TEXT), ".odt": (any_text, TEXT), ".epub": (any_text, TEXT), ".pdf": (any_text, TEXT), ".rtf": (any_text, TEXT),
}
# endings of two parts that count as one
COMPOUND = ("tar.gz", "tar.bz2", "tar.xz", "tar.zst", "nii.gz", "csv.gz", "json.gz", "jsonl.gz", "tsv.gz", "fasta.gz", "fastq.gz", "vcf.gz", "d.ts", "min.js", "min.css", "blade.php", "html.erb", "sql.gz")


def suffix_of(name: Column) -> Column:
    """The ending of a file name in lower case with its point: one of two parts where that is an ending of its own, none for a name
    that only begins with a point."""
    low = F.lower(F.regexp_extract(name, r"([^/\\]*)$", 1))
    two = F.regexp_extract(low, r"[^.](\.[^.]+\.[^.]+)$", 1)
    one = F.regexp_extract(low, r"[^.](\.[^.]+)$", 1)
    return F.when(two.isin(*["." + c for c in COMPOUND]), two).otherwise(one)


# The kinds of analysis and the endings they take, in the order in which they are asked.
ANALYZERS = (
    ("database", "sqlite sqlite3 db mdb accdb dbf duckdb"), ("archive", "zip tar gz tgz bz2 xz 7z rar jar war whl zst tar.gz tar.bz2 tar.xz tar.zst"), ("schema", "sql ddl proto thrift graphql gql avsc xsd prisma"), ("config", "yaml yml toml ini cfg conf env properties editorconfig hcl tf"),
    ("document", "pdf doc docx ppt pptx xls xlsx odt ods odp rtf epub"), ("data", "csv tsv json jsonl ndjson parquet orc avro arrow feather npy npz safetensors h5 hdf5 dta sas7bdat xpt sav pkl pickle nii.gz csv.gz json.gz jsonl.gz tsv.gz vcf.gz fasta fastq gexf graphml geojson"),
    ("markup", "md markdown rst html htm xml xhtml tex adoc svg"), ("shell", "sh bash zsh ksh fish bat cmd ps1 psm1"), ("binary", "exe dll so dylib o obj a lib class pyc wasm bin elf"), ("media", "png jpg jpeg gif bmp tiff webp ico mp3 wav flac ogg mp4 mkv mov avi webm obj stl ply"),
    ("code", "py pyi js jsx mjs cjs ts tsx d.ts java kt kts c h cpp cc cxx hpp cs go rs rb php swift scala r pl pm lua hs ex exs dart m mm css scss less vue svelte min.js min.css blade.php html.erb"), ("text", "txt log text me nfo"),
)


def analyzer_of(name: Column) -> Column:
    """Exactly one of the twelve kinds for every file name, by the whole ending first and its last part next; 'misc' for the rest."""
    whole = F.regexp_replace(suffix_of(name), r"^\.", "")
    last = F.regexp_extract(whole, r"([^.]*)$", 1)
    out = None
    for ending in (whole, last):
        for kind, names in ANALYZERS:
            hit = ending.isin(names.split())
            out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("misc")
