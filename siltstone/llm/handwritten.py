"""Generated, minified, vendored and data files among source files, so that only hand-written source remains.

Each text is lexed and written out again in a canonical layout (a statement a line, tokens apart by one blank), and the original
layout is compared with it:

* extreme expansion: far more canonical lines than the file has, on long lines: **minified**;
* perfect uniformity: nearly all canonical lines have one shape, and each stands on a line of its own: **generated**;
* literal dominance: nearly all tokens of a file with a source-code extension are literals: **data**.

Comments are read by wording (who made the file, may one edit it, where was it copied from), the file's name and folders
by the conventions of tools. Size tells where the text doesn't: half a megabyte of source (``HUGE``) is nothing that anybody
writes, so a source file of that size without a text is data, and one whose layout is nearly that of the three above is what it looks like.
Each kind of evidence counts alone or together.

Texts are judged where they are scanned, and only the kinds found in them are joined to the files.

Defined results: a null text, name, size or folder path gives no evidence of its kind, so a file of which nothing is known is
taken for hand-written; an empty text is no text; a size in an unknown unit is no size; repeated rows give one result each and are told
apart by their id, so they are reduced before; whole texts are read however long they are; other columns are kept out of the result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import pick, salted_join, spread

# Folder names by which package managers and build tools keep what nobody edits.
VENDOR_DIRS = frozenset(
    "3rdparty bower_components dep deps extern external externals godeps jspm_packages libs_external node_modules pods site-packages third-party third_party thirdparty vendor vendored vendors".split()
)
BUILT_DIRS = frozenset("__generated__ autogen autogenerated build_output codegen dist gen generated gen-src stubs-out".split())
# File names that tools give to their output.
LOCK_NAMES = frozenset("cargo.lock composer.lock gemfile.lock go.sum npm-shrinkwrap.json package-lock.json pipfile.lock pnpm-lock.yaml poetry.lock yarn.lock".split())
CODE_EXTENSIONS = frozenset(".c .cc .cpp .cs .go .h .hpp .java .js .jsx .kt .lua .m .php .pl .py .rb .rs .scala .sh .sql .swift .ts .tsx".split())

NAME_TOOL = re.compile(
    r"""(?x)
    (?: ^zz_generated[._] | _pb\d?(?:_grpc)?\.py$ | \.pb(?:\.\w+)?\.\w+$ | _grpc_pb\.\w+$
      | \.(?:g|gen|generated|codegen|autogen|designer)\.\w+$ | _autogen\.\w+$ | _generated\.\w+$ | (?:GrpcStub|OuterClass|Designer|Grpc)\.(?:java|cs|kt)$
      | \.(?:tab|yy)\.[ch]\w*$ | [._-]lock\.(?:json|ya?ml|toml)$ | \.lock(?:\.\w+)?$ )"""
)
NAME_MINIFIED = re.compile(r"[._-](?:min|prod|bundle|packed|compressed|umd|esm)(?:\.[0-9a-f]{6,})?\.(?:js|mjs|cjs|css|ts|py|rb|json)$|\.[0-9a-f]{8,}\.(?:js|css)$", re.I)
NAME_VERSIONED = re.compile(r"[-_.]v?\d+[._]\d+(?:[._]\d+)+(?:[-_.](?:min|bundle|prod))?\.\w+$", re.I)

# who made it: a statement on the file itself, not on files in general
MADE = re.compile(
    r"""(?xi)
    @generated\b(?!\s*(?:files?|code)\b) | \b(?:code|file|source)\s+(?:is\s+|was\s+)?(?:auto(?:matically)?[- ]?)?generated\s+(?:by|from|with|on)\b | do\s+not\s+(?:edit|modify)\b(?!\s+(?:files|generated))
    | ^\W*auto[- ]?generated\b | \b(?:this\s+)?(?:file|module)\s+(?:was|is|has\s+been)\s+(?:written|created|produced|built|emitted|generated)\s+(?:automatically|by\s+(?:a\s+)?(?:tool|machine))
    | \bchanges\s+(?:here\s+)?will\s+be\s+(?:lost|overwritten) | ^\W*machine[- ](?:output|generated|written)\b | ^\W*produced\s+by\s+\S+\s+v?\d | \bautomatisch\s+(?:erzeugt|generiert|erstellt)\b | \bnicht\s+von\s+hand\s+(?:bearbeiten|ändern)
    | \bg[ée]n[ée]r[ée]\s+automatiquement\b | \bne\s+pas\s+modifier\b | \bgenerado\s+autom[áa]ticamente\b | \bno\s+(?:editar|modificar)\b"""
)
COPIED = re.compile(
    r"""(?xi)
    @(?:license|licence|preserve)\s+\S+\s+v?\d+\.\d | \b(?:this\s+)?copy\s+of\s+\S+\s+v?\d[\w.]*\s+was\s+(?:imported|taken|vendored) | \bimported\s+from\s+upstream\b | \bvendored\s+(?:from|copy)\b
    | ^\W*lib\w+\s+v?\d+\.\d+\W.*\bcopyright\b | \bpermission\s+to\s+(?:copy|use)\s+is\s+granted\b | ^\W*\w+\s+v\d+\.\d+\.\d+\s*\|\s*\(c\).*\bcontributors\b | \breleased\s+under\s+the\s+\S+\s+licen[cs]e\b"""
)
PINNED = re.compile(r"\"(?:lockfileVersion|lockfile-version)\"\s*:|^\s*(?:lockfileVersion|lockfile-version)\b|\"?(?:integrity|checksum|resolved)\"?\s*[:=]?\s*\"?sha\d{3}-", re.M)
# comments of any language: "#" and "--" only where they can't be a directive, a selector or an operator
COMMENT = re.compile(
    r"""^\s*(?://+|/\*+!?|\*+(?=[\s/]|$)|\#+!?(?!\s*(?:include|define|if|ifdef|ifndef|else|elif|endif|pragma|undef|error|line|import|region|endregion)\b)(?![^\n]*[{,]\s*$)|--+(?=[\s\[]|$)|;+(?=\s)|<!--|\"\"\"|\'\'\')\s*(.*?)\s*(?:\*/|-->)?\s*$"""
)

LEXEME = re.compile(
    r"""(?x)
    (?P<comment>/\*.*?\*/|//[^\n]*|(?m:^\s*\#(?!\s*(?:include|define|if|ifdef|ifndef|else|elif|endif|pragma|undef|error|line|import)\b)(?![^\n]*[{,]\s*$)[^\n]*)|(?m:^\s*--(?=[\s\[]|$)[^\n]*)|<!--.*?-->)
    | (?P<directive>(?m:^[ \t]*\#\s*(?:include|import|line)\b[^\n]*))
    | (?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)
    | (?P<number>\#[0-9a-fA-F]{3,8}\b|0[xX][0-9a-fA-F]+|\d[\w.]*)
    | (?P<word>[^\W\d]\w*)
    | (?P<line>\n)
    | (?P<mark>[^\s\w])""",
    re.S,
)
VALUES = frozenset(("null", "true", "false", "None", "nil"))
HUGE = 512 * 1024


class Layout:
    """The canonical form of a text, line by line, with what it holds of literals."""

    def __init__(self, text: str):
        self.lines: list[str] = []  # canonical lines
        self.shapes: Counter = Counter()  # by the shape of a line: names keep, their numbers don't, literals are one sign each
        self.literals = self.tokens = self.chars = self.rows = self.literal_rows = 0
        line: list[str] = []
        shape: list[str] = []
        depth = row_literals = row_chars = 0

        def end() -> None:
            if line:
                self.lines.append(" ".join(line))
                self.shapes[" ".join(shape)] += 1
                line.clear()
                shape.clear()

        for m in LEXEME.finditer(text):
            kind, t = m.lastgroup, m.group()
            if kind == "comment":
                continue
            if kind == "line":
                if row_chars:
                    self.rows += 1
                    self.literal_rows += row_literals >= 0.7 * row_chars
                    row_literals = row_chars = 0
                if not depth:  # a bracket that is open goes on with the statement
                    end()
                continue
            line.append(t)
            if kind == "mark":
                shape.append(t)
                if t in "([":
                    depth += 1
                elif t in ")]":
                    depth = max(0, depth - 1)
                elif t in "{}" or (t == ";" and not depth):
                    end()
                continue
            size = len(t)
            self.tokens += 1
            self.chars += size
            row_chars += size
            if kind in ("string", "number") or t in VALUES:
                self.literals += size
                row_literals += size
            shape.append("0" if kind == "number" else DIGITS.sub("0", t))
        if row_chars:
            self.rows += 1
            self.literal_rows += row_literals >= 0.7 * row_chars
        end()


DIGITS = re.compile(r"\d+")
BLANKS = re.compile(r"\s+")


def layout(text: str) -> dict:
    """Lays the text out canonically and compares: expansion, uniformity, share of canonical lines on lines of their own, literals."""
    c = Layout(text)
    code = [x for x in text.splitlines() if x.strip() and not COMMENT.match(x)]
    own = Counter(BLANKS.sub("", x) for x in code)
    kept = sum(min(n, own[x]) for x, n in Counter(BLANKS.sub("", x) for x in c.lines).items())
    lines = len(c.lines)
    masked = Counter(DIGITS.sub("0", re.sub(r"0x[0-9a-f]+", "0", x.strip())) for x in code)
    same = max(max(c.shapes.values(), default=0) / lines if lines >= 6 else 0.0, max(masked.values(), default=0) / max(1, len(code)))
    return {
        "expansion": lines / max(1, len(code)),
        "longest": max(map(len, code), default=0),
        "blank": sum(map(str.isspace, text)) / max(1, len(text)),
        "uniform": same if len(code) >= 6 else 0.0,
        "kept": kept / max(1, lines),
        "literal": c.literals / max(1, c.chars) if c.tokens >= 8 else 0.0,
        "literal_rows": c.literal_rows / c.rows if c.rows >= 3 else 0.0,
    }


def comments(text: str) -> list[str]:
    """The bodies of all lines that are comments."""
    return [m.group(1) for x in text.splitlines() if (m := COMMENT.match(x))]


def text_kinds(text: str) -> list[str]:
    """The kinds of evidence in a text. 'data' holds for source files only, and what begins with 'nearly' for huge files only."""
    out = []
    for c in comments(text):
        if MADE.search(c):
            out.append("made by a tool")
        if COPIED.search(c):
            out.append("copied in")
    x = layout(text)
    if x["longest"] >= 200 and x["blank"] < 0.12 and x["expansion"] >= 2:
        out.append("minified layout" if x["expansion"] >= 3 else "nearly minified layout")
    if x["uniform"] >= 0.5:
        out.append("uniform layout" if x["uniform"] >= 0.7 else "nearly uniform layout")
    pins = len(PINNED.findall(text))
    if pins >= 4 and pins >= 0.5 * sum(1 for v in text.splitlines() if v.strip()):
        out.append("lock file")
    # by characters, and by lines, so that a few foreign lines in a table change nothing
    if x["literal"] >= 0.75 or (x["literal"] >= 0.5 and x["literal_rows"] >= 0.6):
        out.append("data")
    elif x["literal"] >= 0.6:
        out.append("nearly data")
    return list(dict.fromkeys(out))


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(f, k) for f, t in zip(b["file_id"], b["text"]) if (k := text_kinds(t))]
        yield pd.DataFrame(rows, columns=["file_id", "kinds"])


def size_of(size: Column, units: Column) -> Column:
    """Bytes, of a size with its unit in any spelling; 1 KB is 1024 bytes. Null for a unit that is none."""
    u = F.lower(F.regexp_replace(units, r"[\s.]+", ""))
    power = F.when(u.rlike("^(?:b|bytes?)$"), 0)
    for n, letter in enumerate("kmgtp", 1):
        power = power.when(u.rlike(f"^{letter}(?:i?b|bytes?)?$"), n)
    return size.cast("double") * F.pow(F.lit(1024.0), power)


def marked_folders(folders: DataFrame) -> DataFrame:
    """(folder_id, folder): folders whose own name is one of those of tools; of repeated rows the one updated last holds."""
    row = F.max_by("folder_name", F.struct("updated_at", "folder_name"))
    own = F.lower(F.regexp_extract(F.rtrim("name"), r"([^/\\]*)[/\\]*$", 1))
    names = folders.where("folder_id is not null").groupBy(F.col("folder_id").cast("long").alias("folder_id")).agg(row.alias("name"))
    return names.select("folder_id", own.alias("folder")).where(F.col("folder").isin(*sorted(VENDOR_DIRS | BUILT_DIRS)))


def not_handwritten(files: DataFrame, texts: DataFrame, folders: DataFrame, extensions: DataFrame, lineage: DataFrame) -> DataFrame:
    """(file_id, kinds): the files nobody wrote by hand in their repository, with the kinds of evidence.

    The folder path comes from raw_location_json in any of its notations, and from the lineage table where that is null."""
    files, texts = pick(files, "file_id", "file_name", "file_extension_id", "size", "units", "raw_location_json", "updated_at"), pick(texts, "file_id", "text")
    folders, extensions, lineage = pick(folders, "folder_id", "folder_name", "updated_at"), pick(extensions, "extension_id", "extension_name"), pick(lineage, "file_id", "folder_id")
    top = F.max_by(F.struct("file_name", "file_extension_id", "raw_location_json", "size", "units"), F.struct("updated_at", "file_name"))
    f = files.where("file_id is not null").groupBy(F.col("file_id").cast("long").alias("file_id")).agg(top.alias("r")).select("file_id", "r.*")
    ids = F.expr("regexp_extract_all(raw_location_json, '[0-9]+', 0)")
    told = f.where("raw_location_json is not null").select("file_id", F.explode(F.transform(ids, lambda x: x.cast("long"))).alias("folder_id"))
    missing = f.where("raw_location_json is null").select("file_id")
    told = told.unionByName(lineage.select(F.col("file_id").cast("long").alias("file_id"), F.col("folder_id").cast("long").alias("folder_id")).join(missing, "file_id", "left_semi"))
    # a root folder holds a large part of all rows; only folders that tell anything are gathered, a few per file
    marks = salted_join(told, marked_folders(folders), "folder_id", "file_id", "inner").groupBy("file_id").agg(F.collect_set("folder").alias("folders"))
    ext = extensions.groupBy(F.col("extension_id").alias("file_extension_id")).agg(F.max(F.lower(F.trim("extension_name"))).alias("extension"))
    body = spread(texts.where("file_id is not null and text is not null and text <> ''").select(F.col("file_id").cast("long").alias("file_id"), "text"), "file_id")
    kinds = body.mapInPandas(_judge, "file_id long, kinds array<string>").groupBy("file_id").agg(F.array_distinct(F.flatten(F.collect_list("kinds"))).alias("found"))
    there = texts.where("text is not null and text <> ''").select(F.col("file_id").cast("long").alias("file_id")).distinct().withColumn("there", F.lit(True))
    x = f.join(ext, "file_extension_id", "left").join(marks, "file_id", "left").join(kinds, "file_id", "left").join(there, "file_id", "left")
    name = F.trim("file_name")
    own = F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1)))
    code = F.coalesce(F.nullif("extension", F.lit("")), F.when(name.contains("."), own)).isin(*sorted(CODE_EXTENSIONS))
    huge = F.coalesce(size_of(F.col("size"), F.col("units")) >= HUGE, F.lit(False))
    dirs = F.coalesce("folders", F.array().cast("array<string>"))
    has = lambda names: F.arrays_overlap(dirs, F.array(*map(F.lit, sorted(names))))
    found = F.coalesce("found", F.array().cast("array<string>"))
    full = F.transform(F.filter(found, lambda k: huge | ~k.startswith("nearly ")), lambda k: F.regexp_replace(k, "^nearly ", ""))
    rules = [
        ("tool name", name.rlike(NAME_TOOL.pattern.strip()) | F.lower(name).isin(*sorted(LOCK_NAMES))),
        ("minified name", name.rlike("(?i)" + NAME_MINIFIED.pattern)), ("versioned name", name.rlike("(?i)" + NAME_VERSIONED.pattern)),
        ("third-party folder", has(VENDOR_DIRS)), ("output folder", has(BUILT_DIRS)), ("data", F.col("there").isNull() & huge & F.coalesce(code, F.lit(False))),
    ]
    told = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules]))
    out = F.array_distinct(F.concat(told, F.filter(full, lambda k: (k != "data") | F.coalesce(code, F.lit(False)))))
    return x.select("file_id", out.alias("kinds")).where(F.size("kinds") > 0)
