"""Structure out of text files: symbols, schemas, settings, log records and markup, one parser per kind of file.

A parser is a function from a file's text to rows; ``extract`` runs one over a table of texts by Arrow batches. A file a
parser can't read gives no rows, never a failure; null texts are left out."""

from __future__ import annotations

import ast
import configparser
import json
import re
import tomllib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Which kind of analysis a suffix belongs to; the first of several rules holds.
ROUTES = (
    ("schema", ".sql .ddl .proto .graphql .avsc .xsd"), ("config", ".json .yaml .yml .ini .cfg .conf .env .toml .properties"), ("markup", ".md .html .htm .xml .rst .svg"),
    ("data", ".csv .tsv .parquet .orc .jsonl .ndjson .npy .npz .safetensors .sqlite .db"), ("shell", ".sh .bash .ps1 .bat"), ("archive", ".zip .tar .gz .tgz .7z"),
    ("code", ".py .js .jsx .ts .tsx .java .go .c .h .cpp .rs .rb .php .cs .kt .scala .swift .css"), ("text", ".txt .log"),
)
LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".go": "go", ".c": "c", ".h": "c", ".rb": "ruby", ".rs": "rust", ".sh": "shell", ".sql": "sql", ".css": "css"}


def route(suffix):
    """The kind of analysis of a suffix as a Column; 'misc' without one."""
    out = F.lit("misc")
    for kind, names in reversed(ROUTES):
        out = F.when(F.lower(suffix).isin(*names.split()), kind).otherwise(out)
    return out


def extract(df: DataFrame, key: str, text: str, parser: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """(key, *schema): the rows of ``parser`` for every text, in their order by ``ord``."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text]):
                if t is None:
                    continue
                try:
                    rows += [(k, i, *r) for i, r in enumerate(parser(t))]
                except (ValueError, SyntaxError, RecursionError, KeyError, TypeError, configparser.Error):
                    continue
            yield pd.DataFrame(rows, columns=[key, "ord", *names], dtype=object)

    kind = dict(df.dtypes)[key]
    return df.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} {kind}, ord long, {schema}")


SYMBOLS = "kind string, name string, parent string, line int, is_async boolean, arguments int, has_doc boolean"


def python_symbols(text: str) -> list[tuple]:
    """Imports, classes, functions, arguments and assignments of a Python source by its syntax tree."""
    out: list[tuple] = []

    def visit(node: ast.AST, parent: str | None) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.Import):
                out.extend(("import", a.name, a.asname, x.lineno, False, 0, False) for a in x.names)
            elif isinstance(x, ast.ImportFrom):
                out.extend(("import", f"{'.' * x.level}{x.module or ''}.{a.name}", a.asname, x.lineno, False, 0, False) for a in x.names)
            elif isinstance(x, ast.ClassDef):
                out.append(("class", x.name, parent, x.lineno, False, len(x.bases), ast.get_docstring(x) is not None))
                visit(x, x.name)
                continue
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = x.args
                n = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
                out.append(("function", x.name, parent, x.lineno, isinstance(x, ast.AsyncFunctionDef), n, ast.get_docstring(x) is not None))
                visit(x, x.name)
                continue
            elif isinstance(x, (ast.Assign, ast.AnnAssign)):
                for t in x.targets if isinstance(x, ast.Assign) else [x.target]:
                    if isinstance(t, ast.Name):
                        out.append(("variable", t.id, parent, x.lineno, False, 0, False))
            visit(x, parent)

    visit(ast.parse(text), None)
    return out


DEFINITIONS = re.compile(
    r"""(?mx)^(?P<indent>[ \t]*)(?:
      (?:export\s+)?(?:async\s+)?(?:def|function|func|fn|sub)\s+(?P<function>[A-Za-z_]\w*)\s*\((?P<args>[^)]*)\)
      | (?:export\s+)?(?:public\s+|private\s+|abstract\s+|final\s+)*(?:class|interface|struct|trait|enum)\s+(?P<class>[A-Za-z_]\w*)
      | type\s+(?P<type>[A-Za-z_]\w*)\s+(?:struct|interface)
      | (?:public|private|protected|static)\s+(?:[\w<>\[\]]+\s+)+?(?P<method>[A-Za-z_]\w*)\s*\((?P<margs>[^)]*)\)
      | (?:import\s+(?:\{[^}]*\}\s+from\s+)?|from\s+|\#include\s+|require\s+|use\s+)['"<]?(?P<import>[\w./@-]+) )"""
)


def pattern_symbols(text: str) -> list[tuple]:
    """Definitions and imports of sources without a parser of their own, by their usual shapes; comments are cut out before."""
    # comments and texts over several lines leave their line feeds only; a comment of one line can't begin with a definition
    code = re.sub(r"/\*.*?\*/|\"{3}.*?\"{3}|'{3}.*?'{3}|`[^`]*`", lambda m: "\n" * m[0].count("\n"), text, flags=re.S)
    out = []
    parent: tuple[int, str] | None = None
    for m in DEFINITIONS.finditer(code):
        line, depth = code.count("\n", 0, m.start()) + 1, len(m["indent"].expandtabs(4))
        if parent and depth <= parent[0]:
            parent = None
        args = m["args"] if m["args"] is not None else m["margs"]
        n = len([a for a in (args or "").split(",") if a.strip()])
        if m["class"] or m["type"]:
            out.append(("class", m["class"] or m["type"], None, line, False, 0, False))
            parent = (depth, m["class"] or m["type"])
        elif m["import"]:
            out.append(("import", m["import"], None, line, False, 0, False))
        else:
            out.append(("function", m["function"] or m["method"], parent[1] if parent else None, line, "async" in m[0], n, False))
    return out


def statements(text: str) -> list[str]:
    """SQL statements of a script: cut at semicolons outside quotes, comments and dollar quotes; comments are taken out."""
    out, cur = [], []
    for m in re.finditer(r"--[^\n]*|/\*.*?\*/|'(?:''|[^'])*'|\"[^\"]*\"|(\$\w*\$).*?\1|;|[^-/'\"$;]+|.", text, re.S):
        s = m[0]
        if s == ";":
            out.append("".join(cur).strip())
            cur = []
        elif not s.startswith(("--", "/*")):
            cur.append(s)
    return [x for x in [*out, "".join(cur).strip()] if x]


DDL = "object_kind string, object_name string, parent string, detail string, is_nullable boolean"


def ddl_objects(text: str) -> list[tuple]:
    """Tables, columns, keys, indexes, views and triggers of a schema script."""
    out = []
    for s in statements(text):
        m = re.match(r"(?is)create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+|unique\s+)?(table|view|index|trigger|function|procedure|type)\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)\s*(.*)", s)
        if not m:
            continue
        kind, name, rest = m[1].lower(), m[2].strip('"`'), m[3]
        parent = (re.search(r"(?i)\bon\s+([\w.\"`]+)", rest) or [None, None])[1] if kind in ("index", "trigger") else None
        out.append((kind, name, parent, (re.search(r"(?i)\b(before|after|instead\s+of)\b", rest) or [None, None])[1] if kind == "trigger" else None, None))
        if kind != "table" or not rest.startswith("("):
            continue
        depth, part, parts = 0, "", []
        for c in rest[1:]:
            if c == ")" and not depth:
                break
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                parts.append(part)
                part = ""
            else:
                part += c
        for x in [*parts, part]:
            x = x.strip()
            k = re.match(r"(?i)(?:constraint\s+(\S+)\s+)?(primary\s+key|foreign\s+key|unique|check)\b\s*(.*)", x)
            if k:
                out.append((re.sub(r"\s+", " ", k[2].lower()), k[1], name, k[3].strip() or None, None))
            elif c := re.match(r"([\w\"`]+)\s+(\w+(?:\s*\([^)]*\))?)(.*)", x, re.S):
                out.append(("column", c[1].strip('"`'), name, c[2], "not null" not in c[3].lower() and "primary key" not in c[3].lower()))
                if ref := re.search(r"(?i)references\s+([\w.\"`]+)", c[3]):
                    out.append(("foreign key", c[1].strip('"`'), name, ref[1].strip('"`'), None))
                if re.search(r"(?i)primary\s+key", c[3]):
                    out.append(("primary key", c[1].strip('"`'), name, None, None))
    return out


SETTINGS = "syntax string, key_path string, depth int, value string, value_type string"


def _flat(value, path: str, depth: int) -> Iterator[tuple]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _flat(v, f"{path}.{k}" if path else str(k), depth + 1)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _flat(v, f"{path}[{i}]", depth + 1)
    else:
        yield path, depth, None if value is None else str(value), "null" if value is None else {bool: "boolean", int: "integer", float: "float"}.get(type(value), "string")


def _typed(v: str) -> str:
    v = v.strip().strip("\"'")
    return "boolean" if v.lower() in ("true", "false") else "integer" if re.fullmatch(r"[+-]?\d+", v) else "float" if re.fullmatch(r"[+-]?\d*\.\d+", v) else "null" if v.lower() in ("", "null", "~") else "string"


def settings(text: str) -> list[tuple]:
    """Key paths and values of a settings file in JSON, TOML, INI, indented or KEY=value form, tried in this order."""
    t = text.strip()
    try:
        if t[:1] in ("{", "["):
            return [("json", *r) for r in _flat(json.loads(t), "", 0)]
    except ValueError:
        pass
    try:
        if re.search(r"(?m)^\s*\[", t) or re.search(r"(?m)^\w+\s*=\s*[\"\[{\d]", t):
            return [("toml", *r) for r in _flat(tomllib.loads(t), "", 0)]
    except tomllib.TOMLDecodeError:
        pass
    if re.search(r"(?m)^\s*\[[^\]]+\]\s*$", t):
        p = configparser.ConfigParser(strict=False, interpolation=None, allow_no_value=True)
        p.read_string(t)
        return [("ini", f"{s}.{k}", 2, v, _typed(v or "")) for s in p.sections() for k, v in p.items(s)]
    out, stack = [], []
    for x in t.splitlines():
        if m := re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)=(.*)$", x):
            out.append(("env", m[1], 1, m[2].strip().strip("\"'"), _typed(m[2])))
        elif m := re.match(r"(\s*)(?:-\s+)?([\w.\"'-]+):(?:\s+(.*))?$", x):
            n = len(m[1])
            stack = [s for s in stack if s[0] < n]
            path = ".".join([*(s[1] for s in stack), m[2].strip("\"'")])
            v = (m[3] or "").split(" #")[0].strip()
            if v:
                out.append(("yaml", path, len(stack) + 1, v.strip("\"'"), _typed(v)))
            else:
                stack.append((n, m[2].strip("\"'")))
    return out


LOGS = "stamp string, level string, message string, line int"


def log_records(text: str) -> list[tuple]:
    """Log records: a stamp, a level and a message that may go on over lines."""
    out: list[list] = []
    for i, x in enumerate(text.split("\n"), 1):
        m = re.match(r"\[?((?:\d{4}-\d\d-\d\d[T ])?\d\d:\d\d:\d\d[^\s\]]*)\]?\s+\[?(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL)\]?:?\s+(.*)", x.rstrip("\r"))
        if m:
            out.append([m[1], m[2], m[3], i])
        elif out and x[:1] in " \t" and x.strip():
            out[-1][2] += "\n" + x.strip()
    return [tuple(r) for r in out]


ELEMENTS = "element string, depth int, attributes int, text_length int"


class _Elements(HTMLParser):
    EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__()
        self.out: list[list] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        self.out.append([tag, len(self.open) + 1, len(attrs), 0])
        if tag not in self.EMPTY:
            self.open.append(len(self.out) - 1)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.out[self.open[i]][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if self.open:
            self.out[self.open[-1]][3] += len(data.strip())


def elements(text: str) -> list[tuple]:
    """Elements of HTML or XML with their depth, attributes and own text."""
    p = _Elements()
    p.feed(text)
    return [tuple(x) for x in p.out]


def element_rollup(found: DataFrame) -> DataFrame:
    """(element, occurrences, min_depth, max_depth, attributes, text_length)"""
    return found.groupBy("element").agg(F.count("*").alias("occurrences"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"), F.sum("attributes").alias("attributes"), F.sum("text_length").alias("text_length"))


DEPENDENCIES = "ecosystem string, package string, constraint_text string, scope string"


def manifest(text: str) -> list[tuple]:
    """Dependencies of a package manifest: JSON with dependency objects, TOML projects, or a list of requirements."""
    t = text.strip()
    if t.startswith("{"):
        d = json.loads(t)
        return [("npm", n, str(v), k) for k in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies") for n, v in (d.get(k) or {}).items()]
    if re.search(r"(?m)^\[(?:project|tool|dependencies|package)", t):
        d = tomllib.loads(t)
        out = [("pypi", *_requirement(x), "dependencies") for x in d.get("project", {}).get("dependencies", [])]
        return out + [("cargo", n, v if isinstance(v, str) else str(v.get("version")), k) for k in ("dependencies", "dev-dependencies") for n, v in d.get(k, {}).items()]
    return [("pypi", *_requirement(x), "dependencies") for x in t.splitlines() if re.match(r"\s*[A-Za-z0-9]", x)]


def _requirement(x: str) -> tuple[str, str | None]:
    m = re.match(r"\s*([A-Za-z0-9][\w.-]*(?:\[[^\]]*\])?)\s*([^#;]*)", x)
    return (m[1], m[2].strip() or None) if m else (x.strip(), None)


CELLS = "cell_type string, line_count int, outputs int"


def notebook(text: str) -> list[tuple]:
    """Cells of a notebook."""
    cells = json.loads(text)["cells"]
    return [(c["cell_type"], len("".join(c["source"]).splitlines()), len(c.get("outputs", []))) for c in cells]


PATCHES = "old_path string, new_path string, hunks int, added int, removed int"


def patches(text: str) -> list[tuple]:
    """Files of a unified diff with their hunks and numbers of lines."""
    out: list[list] = []
    for x in text.splitlines():
        if x.startswith("--- "):
            out.append([x[4:].split("\t")[0], None, 0, 0, 0])
        elif out and x.startswith("+++ ") and out[-1][1] is None:
            out[-1][1] = x[4:].split("\t")[0]
        elif out and x.startswith("@@"):
            out[-1][2] += 1
        elif out and out[-1][2] and x[:1] in "+-":
            out[-1][3 if x[0] == "+" else 4] += 1
    return [tuple(r) for r in out]


def interface_objects(text: str) -> list[tuple]:
    """Types and fields of protocol-buffer, thrift and GraphQL definitions, as rows of ``DDL``."""
    t = re.sub(r"//[^\n]*|/\*.*?\*/|#[^\n]*", "", text, flags=re.S)
    out = []
    for m in re.finditer(r"\b(message|enum|service|struct|exception|union|type|input|interface)\s+(\w+)[^{;]*\{((?:[^{}]|\{[^{}]*\})*)\}", t):
        kind, name, body = m.groups()
        out.append((kind, name, None, None, None))
        for f in re.split(r"[;\n,]", body):
            f = f.strip()
            if p := re.match(r"(?:\d+:\s*)?(optional|required|repeated)?\s*([\w.<>]+)\s+(\w+)\s*=\s*\d+", f):
                out.append(("field", p[3], name, p[2], p[1] != "required"))
            elif p := re.match(r"(?:\d+:\s*)(optional|required)?\s*([\w.<>]+)\s+(\w+)$", f):
                out.append(("field", p[3], name, p[2], p[1] != "required"))
            elif p := re.match(r"(\w+)(?:\([^)]*\))?\s*:\s*([\w\[\]!]+)", f):
                out.append(("field", p[1], name, p[2], not p[2].endswith("!")))
            elif p := re.match(r"rpc\s+(\w+)\s*\(([^)]*)\)", f):
                out.append(("method", p[1], name, p[2].strip(), None))
            elif kind == "enum" and (p := re.match(r"([A-Z_]\w*)\b", f)):
                out.append(("value", p[1], name, None, None))
    return out


# what tells the engine that a schema was written for; the first that is found holds
ENGINES = (
    ("mysql", r"(?i)\bENGINE\s*=\s*\w+|\bAUTO_INCREMENT\b|`\w+`\s*\."), ("postgresql", r"(?i)\b(?:BIG|SMALL)?SERIAL\b|\$\$|::\w+|\bJSONB\b|\bRETURNING\b|\bLANGUAGE\s+plpgsql\b"), ("sqlserver", r"(?i)\bIDENTITY\s*\(|\bNVARCHAR\b|^\s*GO\s*$|\[dbo\]"),
    ("oracle", r"(?i)\bVARCHAR2\b|\bNUMBER\s*\(|\bSYSDATE\b"), ("sqlite", r"(?i)\bAUTOINCREMENT\b|\bPRAGMA\b|\bWITHOUT\s+ROWID\b"), ("hive", r"(?i)\bSTORED\s+AS\b|\bPARTITIONED\s+BY\b|\bTBLPROPERTIES\b"), ("bigquery", r"(?i)\bSTRUCT\s*<|\bOPTIONS\s*\("), ("snowflake", r"(?i)\bVARIANT\b|\bTRANSIENT\s+TABLE\b"), ("sql", r"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|VIEW|INDEX)\b"),
)


def engine_of(text):
    """The engine of a schema as a Column; null where it defines nothing."""
    out = None
    for name, rx in ENGINES:
        out = F.when(text.rlike("(?m)" + rx), name) if out is None else out.when(text.rlike("(?m)" + rx), name)
    return out


def properties(text: str) -> list[tuple]:
    """Settings of a properties file: keys up to '=', ':' or a blank; lines that end in a backslash go on."""
    out = []
    for line in re.sub(r"\\\r?\n[ \t]*", "", text).splitlines():
        if (m := re.match(r"\s*((?:\\.|[^\s=:#!\\])+)\s*(?:[=:]|\s)\s*(.*?)\s*$", line)) and line.strip()[:1] not in "#!":
            out.append(("properties", m[1], m[2], _typed(m[2]), m[1].count(".")))
    return out


def hcl(text: str) -> list[tuple]:
    """Settings of an HCL file: the path of blocks with their labels, and each argument in them."""
    out, path = [], []
    for line in re.sub(r"/\*.*?\*/", "", text, flags=re.S).splitlines():
        line = re.sub(r"(?:^|\s)(?:#|//).*$", "", line).strip()
        if line == "}" or line == "},":
            path = path[:-1]
        elif m := re.match(r'([\w-]+)((?:\s+(?:"[^"]*"|[\w-]+))*)\s*=?\s*\{$', line):
            path = [*path, ".".join([m[1], *re.findall(r"[\w./-]+", m[2])])]
        elif m := re.match(r"([\w.-]+)\s*=\s*(.+)$", line):
            out.append(("hcl", ".".join([*path, m[1]]), m[2].strip().strip('"'), _typed(m[2].strip().strip('"')), len(path)))
    return out


def xml_settings(text: str) -> list[tuple]:
    """Settings of an XML file: the path of every element with a text of its own, and of every attribute. Definitions of entities are refused."""
    import xml.etree.ElementTree as ET

    if re.search(r"<!(?:DOCTYPE|ENTITY)", text, re.I):
        raise ValueError("document type definitions aren't read")
    out: list[tuple] = []

    def walk(e, path: str, depth: int) -> None:
        here = f"{path}.{e.tag.rsplit('}', 1)[-1]}" if path else e.tag.rsplit("}", 1)[-1]
        out.extend(("xml", f"{here}.@{k.rsplit('}', 1)[-1]}", v, _typed(v), depth) for k, v in e.attrib.items())
        if (e.text or "").strip():
            out.append(("xml", here, e.text.strip(), _typed(e.text.strip()), depth))
        for c in e:
            walk(c, here, depth + 1)

    try:
        walk(ET.fromstring(text), "", 0)
    except ET.ParseError as err:
        raise ValueError(str(err)) from None
    return out


# The kinds that symbols of all languages are put into.
SYMBOL_KINDS = {"import": "imports", "class": "types", "interface": "types", "function": "functions", "method": "functions", "variable": "variables", "constant": "variables"}


def flowcharts(symbols: DataFrame, key: str) -> DataFrame:
    """(key, chart): per file a flow chart of its symbols (kind, name, parent) as text: the file, its kinds, and what belongs to what."""
    kind = F.create_map(*[F.lit(x) for kv in SYMBOL_KINDS.items() for x in kv])
    s = symbols.select(key, "name", F.coalesce(F.get(F.map_values(F.map_filter(kind, lambda k, _: k == F.col("kind"))), F.lit(0)), F.lit("others")).alias("kind"), F.col("parent"))
    safe = lambda c: F.regexp_replace(c, r"[^\w]", "_")
    edge = F.when(F.col("parent").isNotNull(), F.concat(F.lit("  "), safe("parent"), F.lit(" --> "), safe("name"))).otherwise(F.concat(F.lit("  "), F.col("kind"), F.lit(" --> "), safe("name")))
    lines = s.select(key, F.explode(F.array(edge, F.concat(F.lit("  file --> "), "kind"))).alias("line"))
    return lines.groupBy(key).agg(F.array_sort(F.collect_set("line")).alias("l")).select(key, F.concat(F.lit("flowchart TD\n"), F.array_join("l", "\n")).alias("chart"))  # of one file
