"""Concordance of texts: words, quoted literals and characters with their places, pattern matches and language constructs.

Places need offsets of matches, which the built-in expressions don't give, so texts are read once in Python by Arrow batches,
each in time linear in its length; everything that is counted afterwards stays in the JVM.

Defined results: null texts give nothing; lines are ended by line feeds, counted from 1, and a carriage return before one belongs to none of
the matches; columns are counted from 0, the end excluded; empty matches are none; rows of one file twice give its places twice;
other columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import pick, spread

WORD = re.compile(r"\w+")
LITERAL = re.compile(r"\"([^\"\n]*)\"|'([^'\n]*)'")
LONGEST_WORD = 120

# Content families by file extension, and of what has none of these by the class of its analyzer.
FAMILIES = {
    "media": "png jpg jpeg gif bmp tiff tif webp ico svg heic heif psd raw cr2 nef mp3 wav flac aac ogg oga m4a wma aiff opus mp4 m4v mkv mov avi wmv flv webm mpg mpeg",
    "archive": "zip tar gz tgz bz2 xz 7z rar jar war ear whl egg zst lz lzma cab iso dmg",
    "database": "db sqlite sqlite3 mdb accdb dbf frm myd",
    "binary": "exe dll so dylib o obj a lib class pyc pyo wasm bin dat elf ko pdb dex node",
    "code": "",
    "data": "json jsonl csv tsv ndjson parquet avro arrow",
    "config": "ini cfg conf toml yaml yml env properties editorconfig",
    "markup": "md markdown rst html htm xml xhtml tex adoc textile",
    "document": "pdf docx doc pptx ppt xlsx xls odt rtf epub",
    "text": "txt log text me nfo",
}
CLASSES = {"schema": "schema", "database": "database", "data": "data", "config": "config", "text": "text", "markup": "markup", "document": "document", "document_parser": "document", "archive": "archive", "binary": "binary", "misc": "misc"}


def content_family(extension: Column, analyzer: Column | None = None) -> Column:
    """The family of a file: unmistakable extensions first, then code by its analyzer, then the other extensions, the analyzer, 'misc'."""
    ext = F.regexp_replace(F.lower(F.coalesce(extension, F.lit(""))), r"^\.+", "")
    cls = F.lower(F.coalesce(analyzer, F.lit(""))) if analyzer is not None else F.lit("")
    out = None
    for family, names in FAMILIES.items():
        hit = cls == "code" if family == "code" else ext.isin(names.split())
        out = F.when(hit, family) if out is None else out.when(hit, family)
    for name, family in CLASSES.items():
        out = out.when(cls == name, family)
    return out.otherwise("misc")


def _lines(text: str) -> Iterator[tuple[int, str]]:
    for n, line in enumerate(text.split("\n"), 1):
        yield n, line.rstrip("\r")


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, body): lines of texts as rows, in the JVM. A null text has no lines, an empty one has one empty line."""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("at", "body")).select(key, (F.col("at") + 1).alias("line"), F.regexp_replace("body", "\r+$", "").alias("body"))


def _rows(found: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=columns)


def concordance(texts: DataFrame, key: str = "file_id", text: str = "text") -> DataFrame:
    """(key, token, token_kind, line, start_col, end_col): a row per word, in lower case and cut at ``LONGEST_WORD`` characters, and per
    quoted literal of a line, as it stands and without its quotes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, t in zip(b[key], b[text]):
                out = []
                for n, line in _lines(t):
                    out += [(k, m.group().lower()[:LONGEST_WORD], "word", n, m.start(), m.end()) for m in WORD.finditer(line)]
                    out += [(k, m.group()[1:-1], "string", n, m.start() + 1, m.end() - 1) for m in LITERAL.finditer(line) if m.end() - m.start() > 2]
                yield _rows(out, [key, "token", "token_kind", "line", "start_col", "end_col"])

    d = pick(texts, key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    return spread(d, key).mapInPandas(run, f"{key} {dict(d.dtypes)[key]}, token string, token_kind string, line int, start_col int, end_col int")


def characters(texts: DataFrame, key: str = "file_id", text: str = "text") -> DataFrame:
    """(key, character, n): how often each character that is no blank stands in each text."""
    marks = F.filter(F.split(F.col(text), ""), lambda c: (c != "") & ~c.rlike(r"(?U)^\s$"))
    return pick(texts, key, text).select(key, F.explode(marks).alias("character")).groupBy(key, "character").agg(F.count("*").alias("n"))


def registry(tokens: DataFrame, key: str = "file_id") -> DataFrame:
    """(token, token_kind, occurrence_count, file_count) of a concordance; combined per file before the files are counted, so that a
    token in a tenth of all rows is no hot key."""
    per = tokens.groupBy("token_kind", "token", key).agg(F.count("*").alias("n"))
    return per.groupBy("token_kind", "token").agg(F.sum("n").alias("occurrence_count"), F.count("*").alias("file_count"))


def locations_of(tokens: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """(location_key, file_id, content_family, occurrence_count): the registry of places. ``files`` has key, location_key and extension."""
    n = tokens.groupBy(key).agg(F.count("*").alias("occurrence_count"))
    return files.join(n, key).select("location_key", key, content_family(F.col("extension")).alias("content_family"), "occurrence_count")


def pattern_matches(texts: DataFrame, patterns: list[tuple[int, str]], key: str = "file_id", text: str = "text", most: int | None = None, width: int = 240, languages: tuple[str, dict[int, str]] | None = None) -> DataFrame:
    """(key, pattern_id, line, start_col, end_col, match_text): every match of every pattern, line by line, in one pass.

    ``match_text`` keeps ``width`` characters; ``most`` matches of a pattern are kept per text where that is wanted (all by default).
    ``languages``: (column with a text's language, {pattern: its language}) restricts patterns to texts of their language."""
    compiled = [(i, re.compile(rx), re.compile(rx, re.M)) for i, rx in patterns]
    column, of = languages or (None, {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, t, lang in zip(b[key], b[text], b[column] if column else [None] * len(b)):
                # a pattern that is nowhere in the text is on none of its lines
                here = [(i, rx) for i, rx, whole in compiled if (not column or of[i] == lang) and whole.search(t)]
                out, counts = [], dict.fromkeys((i for i, _ in here), 0)
                for n, line in _lines(t) if here else ():
                    for i, rx in here:
                        for m in rx.finditer(line):
                            if m.end() > m.start() and (most is None or counts[i] < most):
                                counts[i] += 1
                                out.append((k, i, n, m.start(), m.end(), m.group()[:width]))
                yield _rows(out, [key, "pattern_id", "line", "start_col", "end_col", "match_text"])

    d = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    d = d.select(key, text, column) if column else pick(d, key, text)
    return spread(d, key).mapInPandas(run, f"{key} {dict(d.dtypes)[key]}, pattern_id long, line int, start_col int, end_col int, match_text string")


# Languages by file extension.
LANGUAGES = {
    "python": "py pyw pyi pyx pxd pxi", "javascript": "js jsx cjs mjs jsbundle", "typescript": "ts tsx mts cts", "java": "java", "kotlin": "kt kts", "c": "c h", "cpp": "cpp cc cxx c++ hpp hh hxx ipp cppm ixx inl tpp",
    "csharp": "cs csx", "go": "go", "rust": "rs", "ruby": "rb rake gemspec", "php": "php", "swift": "swift", "scala": "scala sc", "shell": "sh bash zsh ksh bashrc zshrc profile", "sql": "sql", "r": "r", "perl": "pl pm perl t",
    "lua": "lua", "haskell": "hs lhs", "elixir": "ex exs", "dart": "dart", "objc": "m mm", "powershell": "ps1 psm1 psd1",
}
ID = r"[A-Za-z_]\w*"
VIS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|override|virtual|async|readonly|open|data)\s+)*"
# constructs by language: name, kind and what a line of it looks like
CONSTRUCTS = {
    "python": [("import", "import", rf"^\s*import\s+{ID}"), ("from_import", "import", r"^\s*from\s+\.*[\w.]*\s*import\b"), ("function", "definition", rf"^\s*(?:async\s+)?def\s+{ID}\s*\("), ("class", "definition", rf"^\s*class\s+{ID}"), ("decorator", "annotation", rf"^\s*@{ID}"), ("constant", "declaration", r"^[A-Z][A-Z0-9_]*\s*(?::[^=]+)?=(?:[^=]|$)"), ("global_decl", "declaration", rf"^\s*(?:global|nonlocal)\s+{ID}"), ("raise", "control", r"^\s*raise\b"), ("with_context", "control", r"^\s*(?:async\s+)?with\s.+:\s*$"), ("lambda", "definition", r"\blambda\b[^:]*:")],
    "javascript": [("import", "import", r"^\s*import\b[^(]*['\"]"), ("require", "import", r"\brequire\s*\(\s*['\"]"), ("export", "export", r"^\s*export\b"), ("function", "definition", rf"\bfunction\b\s*\*?\s*{ID}\s*\("), ("arrow_function", "definition", r"=>"), ("class", "definition", rf"\bclass\s+{ID}"), ("method", "definition", rf"^\s+(?:async\s+|static\s+|get\s+|set\s+)*{ID}\s*\([^)]*\)\s*\{{"), ("variable", "declaration", rf"\b(?:const|let|var)\s+(?:{ID}|\{{|\[)")],
    "typescript": [("import", "import", r"^\s*import\b[^(]*['\"]"), ("require", "import", r"\brequire\s*\(\s*['\"]"), ("export", "export", r"^\s*export\b"), ("interface", "definition", rf"\binterface\s+{ID}"), ("type_alias", "declaration", rf"\btype\s+{ID}[^=]*="), ("enum", "definition", rf"\benum\s+{ID}"), ("class", "definition", rf"\bclass\s+{ID}"), ("function", "definition", rf"\bfunction\b\s*\*?\s*{ID}\s*[(<]"), ("decorator", "annotation", rf"^\s*@{ID}"), ("namespace", "definition", rf"\b(?:namespace|module)\s+{ID}")],
    "java": [("package", "declaration", r"^\s*package\s+[\w.]+\s*;"), ("import", "import", r"^\s*import\s+(?:static\s+)?[\w.*]+\s*;"), ("class", "definition", rf"\b(?:class|record)\s+{ID}"), ("interface", "definition", rf"\binterface\s+{ID}"), ("enum", "definition", rf"\benum\s+{ID}"), ("annotation", "annotation", rf"^\s*@{ID}"), ("method", "definition", rf"^\s*{VIS}[\w<>\[\],.?]+\s+{ID}\s*\([^;]*\{{\s*$"), ("field", "declaration", rf"^\s*(?:private|protected|public)\s+(?:static\s+|final\s+)*[\w<>\[\],.]+\s+{ID}\s*(?:=|;)")],
    "kotlin": [("package", "declaration", r"^\s*package\s+[\w.]+"), ("import", "import", r"^\s*import\s+[\w.*]+"), ("function", "definition", r"\bfun\s+(?:<[^>]*>\s*)?[\w.]+\s*\("), ("class", "definition", rf"\b(?:class|object|interface)\s+{ID}"), ("property", "declaration", rf"\b(?:val|var)\s+{ID}"), ("annotation", "annotation", rf"^\s*@{ID}")],
    "c": [("include", "import", r"^\s*#\s*include\s*[<\"]"), ("define", "declaration", rf"^\s*#\s*define\s+{ID}"), ("preproc_cond", "control", r"^\s*#\s*(?:if|ifdef|ifndef|elif|else|endif)\b"), ("struct", "definition", rf"\b(?:struct|union|enum)\s+{ID}\s*\{{?\s*$"), ("typedef", "declaration", r"^\s*typedef\b"), ("function", "definition", rf"^(?:static\s+|inline\s+|extern\s+)*[\w*]+[\s*]+{ID}\s*\([^;]*\)\s*\{{?\s*$")],
    "cpp": [("include", "import", r"^\s*#\s*include\s*[<\"]"), ("define", "declaration", rf"^\s*#\s*define\s+{ID}"), ("using", "import", r"^\s*using\s+"), ("namespace", "definition", r"\bnamespace\b"), ("class", "definition", rf"\b(?:class|struct)\s+{ID}"), ("template", "definition", r"\btemplate\s*<"), ("function", "definition", rf"^[\w:<>,*&\s]+[\s*&]+[\w:~]+\s*\([^;]*\)\s*(?:const\s*)?\{{?\s*$")],
    "csharp": [("using", "import", r"^\s*using\s+[\w.=\s]+;"), ("namespace", "definition", r"^\s*namespace\s+[\w.]+"), ("class", "definition", rf"\b(?:class|struct|interface|record)\s+{ID}"), ("enum", "definition", rf"\benum\s+{ID}"), ("method", "definition", rf"^\s*{VIS}[\w<>\[\],.?]+\s+{ID}\s*\([^;]*\)\s*\{{?\s*$"), ("property", "declaration", rf"\b[\w<>\[\]?]+\s+{ID}\s*\{{\s*(?:get|set|init)"), ("attribute", "annotation", rf"^\s*\[{ID}")],
    "go": [("package", "declaration", rf"^\s*package\s+{ID}"), ("import", "import", r"^\s*import\b"), ("func", "definition", rf"^\s*func\s+(?:\([^)]*\)\s*)?{ID}\s*[(\[]"), ("type", "definition", rf"^\s*type\s+{ID}\s"), ("const", "declaration", r"^\s*const\b"), ("var", "declaration", r"^\s*var\b"), ("short_var", "declaration", rf"\b{ID}(?:\s*,\s*{ID})*\s*:=")],
    "rust": [("use", "import", r"^\s*(?:pub\s+)?use\s+"), ("mod", "definition", rf"^\s*(?:pub\s+)?mod\s+{ID}"), ("fn", "definition", rf"\bfn\s+{ID}"), ("struct_enum", "definition", rf"\b(?:struct|enum|union)\s+{ID}"), ("trait", "definition", rf"\btrait\s+{ID}"), ("impl", "definition", r"^\s*(?:unsafe\s+)?impl\b"), ("macro_def", "definition", rf"\bmacro_rules!\s*{ID}"), ("const_static", "declaration", rf"\b(?:const|static)\s+(?:mut\s+)?{ID}\s*:"), ("attribute", "annotation", r"^\s*#!?\["), ("let_binding", "declaration", r"\blet\s+")],
    "ruby": [("require", "import", r"^\s*require(?:_relative)?\b"), ("class", "definition", rf"^\s*class\s+{ID}"), ("module", "definition", rf"^\s*module\s+{ID}"), ("method", "definition", r"^\s*def\s+[\w.?!=]+"), ("attr", "declaration", r"^\s*attr_(?:reader|writer|accessor)\b"), ("constant", "declaration", r"^\s*[A-Z][A-Z0-9_]*\s*=(?:[^=]|$)"), ("mixin", "import", r"^\s*(?:include|extend|prepend)\s+[A-Z]")],
    "php": [("namespace", "definition", r"^\s*namespace\s+[\w\\]+"), ("use", "import", r"^\s*use\s+[\w\\]+"), ("class", "definition", rf"\b(?:class|interface|trait|enum)\s+{ID}"), ("function", "definition", rf"\bfunction\s+&?{ID}"), ("require_include", "import", r"\b(?:require|include)(?:_once)?\b"), ("variable", "declaration", r"^\s*\$\w+\s*="), ("const", "declaration", rf"\bconst\s+{ID}|\bdefine\s*\(")],
    "swift": [("import", "import", rf"^\s*import\s+{ID}"), ("func", "definition", rf"\bfunc\s+{ID}"), ("type", "definition", rf"\b(?:class|struct|enum|protocol|extension|actor)\s+{ID}"), ("property", "declaration", rf"\b(?:let|var)\s+{ID}"), ("attribute", "annotation", rf"^\s*@{ID}")],
    "scala": [("import", "import", r"^\s*import\s+"), ("package", "declaration", r"^\s*package\s+"), ("def", "definition", r"\bdef\s+\S+"), ("class", "definition", rf"\b(?:class|object|trait|enum)\s+{ID}"), ("val_var", "declaration", r"\b(?:val|var)\s+\S+"), ("type", "declaration", rf"\btype\s+{ID}")],
    "shell": [("shebang", "other", r"^#!"), ("function", "definition", r"^\s*(?:function\s+[\w-]+|[\w-]+\s*\(\)\s*\{?)"), ("variable", "declaration", rf"^\s*(?:export\s+|local\s+|readonly\s+)?{ID}="), ("source", "import", r"^\s*(?:source|\.)\s+\S"), ("control", "control", r"^\s*(?:if|then|elif|else|fi|for|while|until|do|done|case|esac)\b")],
    "sql": [("select", "query", r"(?i)\bselect\b"), ("insert", "query", r"(?i)\binsert\s+into\b"), ("update", "query", r"(?i)\bupdate\s+\S+\s+set\b"), ("delete", "query", r"(?i)\bdelete\s+from\b"), ("create", "definition", r"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+|unique\s+|materialized\s+)*(?:table|view|index|function|procedure|trigger|schema|database|type|sequence)\b"), ("alter", "definition", r"(?i)\balter\s+\w+"), ("drop", "definition", r"(?i)\bdrop\s+\w+"), ("join", "clause", r"(?i)\bjoin\b")],
    "r": [("library", "import", r"\b(?:library|require)\s*\("), ("function", "definition", r"(?:<-|=)\s*function\s*\("), ("assignment", "declaration", r"^\s*[\w.]+\s*<-"), ("source", "import", r"\bsource\s*\(")],
    "perl": [("use", "import", r"^\s*(?:use|require)\s+[\w:]+"), ("package", "definition", r"^\s*package\s+[\w:]+"), ("sub", "definition", rf"\bsub\s+{ID}"), ("my_var", "declaration", r"\b(?:my|our|local)\s+[$@%(]")],
    "lua": [("require", "import", r"\brequire\s*[('\"]"), ("function", "definition", r"\bfunction\b"), ("local", "declaration", rf"^\s*local\s+{ID}")],
    "haskell": [("import", "import", r"^import\s+"), ("module", "definition", r"^module\s+[A-Z]"), ("data_type", "definition", r"^(?:data|newtype|type)\s+[A-Z]"), ("class_instance", "definition", r"^(?:class|instance)\s+"), ("signature", "declaration", r"^[a-z_][\w']*\s*::")],
    "elixir": [("defmodule", "definition", r"^\s*defmodule\s+[A-Z]"), ("def", "definition", r"^\s*(?:def|defp|defmacro|defmacrop)\s+\w"), ("import_use", "import", r"^\s*(?:import|use|alias|require)\s+[A-Z]"), ("module_attr", "declaration", r"^\s*@[a-z_]\w*\s")],
    "dart": [("import", "import", r"^\s*(?:import|export|part)\s+['\"]"), ("class", "definition", rf"\b(?:class|mixin|enum|extension)\s+{ID}"), ("function", "definition", rf"^\s*(?:static\s+)?[\w<>?]+\s+{ID}\s*\([^;]*\)\s*(?:async\s*)?\{{\s*$"), ("variable", "declaration", rf"\b(?:final|var|const|late)\s+")],
    "objc": [("import", "import", r"^\s*[#@]\s*(?:import|include)\b"), ("interface", "definition", rf"^\s*@interface\s+{ID}"), ("implementation", "definition", rf"^\s*@implementation\s+{ID}"), ("protocol", "definition", rf"^\s*@protocol\s+{ID}"), ("method", "definition", r"^\s*[-+]\s*\([^)]*\)\s*\w+"), ("property", "declaration", r"^\s*@property\b")],
    "powershell": [("function", "definition", r"(?i)^\s*function\s+[\w:-]+"), ("param", "declaration", r"(?i)^\s*param\s*\("), ("import_module", "import", r"(?i)\bimport-module\b"), ("variable", "declaration", r"^\s*\$[\w:]+\s*=")],
}
CATALOGUE = [(i, lang, *c) for i, (lang, c) in enumerate(((lang, c) for lang, cs in CONSTRUCTS.items() for c in cs), 1)]  # (id, language, name, kind, pattern)


def language_of(extension: Column) -> Column:
    """The language of a file by its extension; null for none of the known ones."""
    ext = F.regexp_replace(F.lower(extension), r"^\.", "")
    out = None
    for lang, names in LANGUAGES.items():
        out = F.when(ext.isin(names.split()), lang) if out is None else out.when(ext.isin(names.split()), lang)
    return out


def constructs(texts: DataFrame, key: str = "file_id", text: str = "text", extension: str = "extension") -> DataFrame:
    """(key, language, construct_name, kind, line, start_col, end_col): every construct in the texts of its language."""
    d = texts.select(key, text, language_of(F.col(extension)).alias("language")).where("language is not null")
    found = pattern_matches(d, [(c[0], c[4]) for c in CATALOGUE], key, text, languages=("language", {c[0]: c[1] for c in CATALOGUE}))
    names = texts.sparkSession.createDataFrame([c[:4] for c in CATALOGUE], "pattern_id long, language string, construct_name string, kind string")
    return found.join(F.broadcast(names), "pattern_id").select(key, "language", "construct_name", "kind", "line", "start_col", "end_col")  # as many as constructs
