"""Credentials embedded in source code: finding their lines and masking them.

All literals of the collection, quoted or bare, are indexed by their hash with the files that own them. Candidates among them
are those which stand where a credential would (a telling name, call, header, address, command, connection string or
remark, a private-key block) or look like one (issued token formats). Candidates with more owners than a secret would have are
placeholders and fall out, unless their characters are such as nobody makes up; of the others those
with the structure of a usable secret are confirmed. Then every file is scanned again for the confirmed values by
an automaton, so that a secret is also found where nothing around it tells. Masked are the places of both. Confirmed values are taken in blocks of
``block`` values: what an executor holds stays bounded, and all values meet all files.

Defined results: null or empty texts have no lines; lines are ended by line feeds, a carriage return before one belongs
to no value; a secret that spans lines (a private key) counts at its first line; several on one line give one row; the
order of repeated rows doesn't matter; masking keeps every other character, line and quote as it is.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.session import materialize, pick, salted_join, spread

try:
    import ahocorasick
except ImportError:  # then one alternation per block, slower
    ahocorasick = None

# Formats of issued tokens.
ISSUED = re.compile(
    r"""(?x)(?<![A-Za-z0-9_])(?:
      A(?:KI|SI|GP|RO)A[0-9A-Z]{16} | gh[a-z]_[A-Za-z0-9]{30,40} | github_pat_\w{22,} | glpat-[\w-]{18,24} | xox[a-z]-[0-9A-Za-z-]{10,} | [rsp]k_live_\w{16,}
      | npm_\w{36} | pypi-[\w-]{30,} | eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,} | AIza[\w-]{30,40} | SG\.[\w-]{16,32}\.[\w-]{30,60} | ya29\.[\w-]{20,} | hf_[A-Za-z0-9]{30,} | dop_v1_[0-9a-f]{64} | sk-[A-Za-z0-9-]{20,}
    )(?![A-Za-z0-9_])"""
)
PEM = re.compile(r"-{5}BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-{5}")
PEM_BODY = re.compile(r"^[\s\"'+*#/\\n]*[A-Za-z0-9+/=]{32,}")

# names that tell, in several languages, as words of a name; a bare "token" or "key" doesn't tell enough
NAME = r"""(?:pass(?:word|wd|wort|phrase|code)?|pwd|passw|(?<![a-zA-Z])pw(?![a-zA-Z])|kenn?wort|mot_?de_?passe|contrase(?:ñ|n)a|clave|senha|wachtwoord|parola|has[lł]o|secret|credentials?
  |(?:api|access|auth|private|secret|encryption|signing|master|account|storage|shared|client|login)[_-]?keys?|(?:api|auth|access|refresh|bearer|session|secret|bot|oauth|deploy|client|personal|csrf)[_-]?token|auth)"""
NAMED = re.compile(
    r"""(?xi)(?<![A-Za-z])(?P<name>[\w.\-\[\]"']{0,40}?"""
    + NAME
    + r"""[\w\-]{0,16})["'\]]{0,3}\s*(?::=|=>|=|:)\s*(?P<value>(?:[a-zA-Z]{0,2}"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`[^`]*`|[^\s"'`;,]+[^\s"'`,]*)(?:\s*[+.]?\s*(?:"[^"]*"|'[^']*'))*)"""
)
HEADER = re.compile(r"""(?i)authorization["'\]]*\s*[:=,]\s*["']?\s*(?P<scheme>basic|bearer|token|apikey|digest)\s+(?P<value>[^\s"',;]{8,})""")
XHEADER = re.compile(r"""(?i)\bx-(?:api-key|auth-token|access-token|vault-token)["'\]]*\s*[:=,]\s*["']?(?P<value>[^\s"',;]{8,})""")
ADDRESS = re.compile(r"""\b[a-zA-Z][\w+.-]*://(?P<user>[^\s/:@'"]*):(?P<value>[^\s/@'"]+)@[\w.-]+""")
COMMAND = re.compile(r"""(?x)(?: \bcurl\b.*?\s(?:-u|--user)[\s=]+["']?[^\s:"']+:(?P<a>[^\s"']+) | \b(?:mysql|mysqldump|mysqladmin|mariadb)\b.*?\s-p(?P<b>[^\s"']{4,})
   | \bsshpass\s+-p\s*["']?(?P<c>[^\s"']+) | \b(?:docker|podman|helm|az)\b.*?\s(?:-p|--password)[\s=]+["']?(?P<d>[^\s"']+) | \bredis-cli\b.*?\s-a\s+["']?(?P<e>[^\s"']+) | \bwget\b.*--(?:http-)?password=["']?(?P<f>[^\s"']+) )""")
CONNECTION = re.compile(r"""(?i)(?:pwd|password|accountkey|sharedaccesskey)\s*=\s*(?P<value>[^;"'\s]+)""")
REMARK = re.compile(r"""(?i)\b(?:password|passwd|pass|pw|pwd|(?:login|access|api)\s+key|token|secret|kennwort|passwort|mot\s+de\s+passe|contraseña|clave|credentials?)\s+(?:was|is|are|war|ist|était|est|era|es)\s*:?\s+["'`]?(?P<value>[^\s"'`,;]{6,})""")
# a call whose name tells and that hands over literals; the last of them is the secret
CALL = re.compile(
    r"""(?xi)(?<![A-Za-z])(?P<name>\w{0,40}?(?:credentials?|passw(?:or)?d|passphrase|pwd|log_?in|sign_?in|auth(?:enticate|orize)?|secret|api_?key|access_?key)\w{0,16})\s*\((?=[^)]*["'])"""
)
CALL_ARGUMENT = re.compile(r"""\s*(?:[\w.]+\s*(?:=>|[=:])\s*)?(?P<value>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[\w.\[\]]*)\s*(?P<end>[,)])""")
ASKS = re.compile(r"(?i)^_*(?:get|fetch|read|load|look_?up|find|has|is|check|valid\w*|verify|prompt|ask|log|print|mask|redact|hash|delete|remove|require|need|test|describe|rotate)(?:_|[A-Z]|$)")
JOIN = re.compile(r"""["']\s*[+.]?\s*["']""")
REFERENCE = re.compile(
    r"""(?xi)^(?:\$\{?[a-z_]\w*\}?(?:[/:.-]|$) | %\w+%$ | \{[\w.\s-]*\}?$ | <[^>]*>?$ | @\w+$ | os\. | env\b | process\. | settings\b | config\b | getenv | System\. | self\. | this\. | ctx\b | vault: | secretKeyRef | (?:null|none|nil|true|false|undefined)$)
    | \$\(|\$\{|\{\{|%\( | \{[a-z_][\w.]*\} | \w\([^()]*\)$ | <[^<>]*>"""
)
# words of placeholders, standing for themselves or before what they stand for
DUMMY = re.compile(
    r"""(?xi)(?:^|[^a-z])(?:your|my|example|sample|dummy|fake|test|change[-_ ]?me|replace|placeholder|redacted|insert|todo|none|null|foo|bar|hunter2?)
      (?=[^a-z0-9]|$|\d{1,3}(?:[^a-z0-9]|$)|pass|pwd|secret|token|key|api|user|value|name|login|cred|here|db|app|account|bar|only|ing)"""
)
FILLED = re.compile(r"EXAMPLE|^(.)\1+$|X{6,}|x{6,}|\*{3,}|\.{3,}|0{8,}|1234567|abcdef0123")
# words of sentences, which no passphrase is made of
SAYS = re.compile(r"(?i)\b(?:the|an?|is|are|was|must|should|can|please|enter|type|your|you|for|to|of|in|with|and|or|not|no|at|least|characters?|required?|invalid|wrong|incorrect|missing|forgot\w*|reset|change|here|new|old|confirm|again|der|die|das|ein|le|la|el|bitte)\b")


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s))) if n else 0.0


PLAIN = re.compile(r"(?i)(?:user(?:name)?|pass(?:word|wd)?|pwd|secret|token|login|admin|root|test|guest|none|value|string)s?\d?")


def mixed(v: str) -> bool:
    """Characters of several classes as nobody writes them in words."""
    classes = sum(bool(re.search(p, v)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^\w]"))
    return classes >= 2 and bool(re.search(r"\d|[A-Z].*[^\w]|[^\w].*[A-Z]", v))


def usable(value: str, kind: str) -> bool:
    """Has the value the structure of a secret that works? Of some kinds of places the place alone nearly tells it. Blanks are
    allowed in quoted values of telling names: a passphrase is several words that make no sentence."""
    v = value.strip().strip("\"'`").strip()
    if len(v) < 6 or REFERENCE.search(v) or FILLED.search(v):
        return False
    if ISSUED.fullmatch(v):
        return True
    if DUMMY.search(v):
        return False
    if re.search(r"\s", v):
        words = v.split()
        return kind in ("named", "phrase") and not SAYS.search(v) and (len(words) >= 3 if kind == "phrase" else len(words) >= 2 and any(mixed(w) and len(w) >= 4 for w in words) and not re.search(r"[=(){}\[\]]", v))
    if re.fullmatch(r"[\d.,:/-]+", v) or re.fullmatch(r"[a-z]+://\S+|/?(?:[\w.-]+/)+[\w.-]+", v) and not re.search(r"[A-Z].*\d|\d.*[A-Z]", v):
        return False  # numbers, dates, addresses and paths
    if re.fullmatch(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", v, re.I):
        return False  # an id
    if PLAIN.fullmatch(v):
        return False
    if kind in ("address", "connection", "command", "header") and entropy(v) > 2:
        return True
    turns = len(re.findall(r"[a-z][A-Z]|[A-Z][a-z]", v))
    return mixed(v) or (len(v) >= 10 and turns >= 5 and entropy(v) > 3) or (len(v) >= 16 and entropy(v) > 3.6)


def unguessable(value: str) -> bool:
    """An issued format, or so many and so mixed characters that nobody made it up as a placeholder: such a value stays a secret
    in however many files it was copied."""
    classes = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^\w\s]"))
    worded = sum(len(w) for w in re.findall(r"[A-Za-z]?[a-z]{4,}|[A-Z]{5,}", value))
    if worded > 0.4 * len(value):
        return False
    return bool(ISSUED.fullmatch(value)) or (len(value) >= 12 and classes >= 3 and entropy(value) > 3.2) or (len(value) >= 24 and classes >= 2 and entropy(value) > 3.2)


def decoded(value: str) -> str | None:
    """user:password behind a base64 value, else None."""
    try:
        t = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return None
    return t if re.fullmatch(r"[^\s:]+:[^\s]{4,}", t) and t.isprintable() else None


# quoted or bare literals, for the index of all of them (a pattern of the JVM)
LITERAL = """"[^"\\n]{6,}"|'[^'\\n]{6,}'|`[^`\\n]{6,}`|[^\\s"'`,;=:(){}]{6,}"""

# a line without any of these holds nothing that the patterns above could find: every alternative of each of them needs one.
# A line that joins literals is always read, as the join may cut any of these words. tests/llm holds both against each other.
HINT = re.compile(
    r"""(?xi)pass|pwd|pw(?![a-z])|kenn?wort|clave|senha|wachtwoord|parola|has[lł]o|contrase|secret|credential|key|token|auth|log_?in|sign_?in|api|:// | curl|mysql|mariadb|docker|podman|helm|\baz\b|redis-cli|wget
    | A(?:KI|SI|GP|RO)A[0-9A-Z] | gh[a-z]_ | github_pat | glpat- | xox[a-z]- | _live_ | npm_ | pypi- | eyJ | AIza | SG\. | ya29 | hf_ | dop_v1 | sk- | ["']\s*[+.]?\s*["'] | -----BEGIN"""
)


def pieces(line: str, start: int, stop: int) -> list[tuple[int, int]]:
    """Where the part of the line stands, without what joins literals in it."""
    out, at = [], start
    for m in JOIN.finditer(line[start:stop]):
        out.append((at, start + m.start()))
        at = start + m.end()
    return [(a, b) for a, b in [*out, (at, stop)] if a < b]


def scan_line(line: str) -> list[tuple[str, str, list[tuple[int, int]]]]:
    """(kind, value, places) of what stands in the line like a credential; values as written, without quotes. A value that
    the source joins of several literals has a place for each of them."""
    out = []
    parts = pieces(line, 0, len(line))
    for m in ISSUED.finditer("".join(line[a:b] for a, b in parts)):
        at, places = 0, []
        for a, b in parts:  # from the joined line back to the line itself
            s, e = max(m.start(), at), min(m.end(), at + b - a)
            if s < e:
                places.append((a + s - at, a + e - at))
            at += b - a
        out.append(("issued", m.group(), places))
    for m in ADDRESS.finditer(line):
        out.append(("address", m.group("value"), [m.span("value")]))
    for m in HEADER.finditer(line):
        v = m.group("value")
        if m.group("scheme").lower() == "basic":
            if decoded(v):
                out.append(("header", v, [m.span("value")]))
        else:
            out.append(("header", v, [m.span("value")]))
    for m in XHEADER.finditer(line):
        out.append(("header", m.group("value"), [m.span("value")]))
    for m in COMMAND.finditer(line):
        out.append(("command", m.group(m.lastgroup), [m.span(m.lastgroup)]))
    if re.search(r"(?i)\b(?:server|host|data source|uid|user id|user|accountname|endpoint)\s*=", line):
        for m in CONNECTION.finditer(line):
            out.append(("connection", m.group("value"), [m.span("value")]))
    for m in NAMED.finditer(line):
        name, v = m.group("name"), m.group("value").rstrip(";,")
        if re.search(r"(?i)(?:_|^)(?:count|field|name|file|path|url|type|length|limit|id|ids|policy|hash|expir\w*|ttl|reset|prompt|label|column|index|size|min|max|regex|pattern|header|env|var)$", name.strip("\"'[]")):
            continue
        quoted = v[:1] in "\"'`"
        places = [(m.start("value"), m.start("value") + len(v))]
        if quoted:
            places = pieces(line, *places[0])
            v = JOIN.sub("", v)
            head, tail = len(v) - len(v.lstrip("\"'`")), len(v) - len(v.rstrip("\"'`"))
            v = v.strip("\"'`")
            if v:
                places[0] = (places[0][0] + head, places[0][1])
                places[-1] = (places[-1][0], places[-1][1] - tail)
                places = [(a, b) for a, b in places if a < b]
        if name.strip("\"'").lower().endswith("auth") and not decoded(v):
            continue
        if not quoted and re.search(r"[(\[]|^[A-Za-z_]\w*(?:\.[A-Za-z_]\w{0,24})+$", v):
            continue  # an expression
        out.append(("phrase" if re.search(r"(?i)phrase|mot_?de_?passe", name) else "named", v, places))
    for m in CALL.finditer(line):
        if ASKS.search(m.group("name")):
            continue
        at, given = m.end(), None
        while a := CALL_ARGUMENT.match(line, at):
            at = a.end()
            if a.group("value")[:1] in ("'", '"'):
                given = a
            if a.group("end") == ")":
                break
        if given and len(given.group("value")) > 2:
            s, e = given.span("value")
            out.append(("named", line[s + 1 : e - 1], [(s + 1, e - 1)]))
    for m in REMARK.finditer(line):
        v = m.group("value").rstrip(".")
        out.append(("remark", v, [(m.start("value"), m.start("value") + len(v))]))
    return [x for x in out if x[1]]


def placed(text: str, hints: bool = True) -> list[tuple[int, str, str, list[tuple[int, int]] | None]]:
    """(line, kind, value, places) of a text, places in characters of the whole text; a private key counts at its first line
    and has none, as its body is masked between its BEGIN and END. Without ``hints`` every line is read, for tests."""
    out = []
    lines = text.split("\n")
    begin, after = 0, 0
    for i, line in enumerate(lines):
        begin, after = after, after + len(line) + 1
        if hints and not HINT.search(line):
            continue
        line = line.rstrip("\r")
        if PEM.search(line):
            rest = PEM.split(line, 1)[1]
            if PEM_BODY.match(lines[i + 1]) if i + 1 < len(lines) else False:
                out.append((i + 1, "key block", lines[i + 1].strip(), None))
            elif len(re.findall(r"[A-Za-z0-9+/=]{32,}", rest)):
                out.append((i + 1, "key block", rest.strip(), None))
        for kind, v, places in scan_line(line):
            if usable(v, kind) or (kind in ("header", "named", "phrase") and decoded(v)):
                out.append((i + 1, kind, v, [(begin + s, begin + e) for s, e in places]))
    return out


def candidates(text: str) -> list[tuple[int, str, str]]:
    """(line, kind, value) of a text."""
    return [c[:3] for c in placed(text)]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(f, *c[:3], unguessable(c[2]), c[3] and [{"start": s, "stop": e} for s, e in c[3]]) for f, t in zip(b["file_id"], b["text"]) if t for c in placed(t)]
        yield pd.DataFrame(rows, columns=["file_id", "line", "kind", "value", "strong", "places"])


def _rescan(batches: Iterator[pd.DataFrame], secrets) -> Iterator[pd.DataFrame]:
    words = secrets.value
    if ahocorasick:
        auto = ahocorasick.Automaton()
        for w in words:
            auto.add_word(w, len(w))
        auto.make_automaton()
        find = lambda t: ((e - n + 1, e + 1) for e, n in auto.iter(t))
    else:
        rx = re.compile("|".join(map(re.escape, sorted(words, key=len, reverse=True))))
        find = lambda t: (m.span() for m in rx.finditer(t))
    for b in batches:
        rows = []
        for f, t in zip(b["file_id"], b["text"]):
            for s, e in find(t) if t else ():
                if (s and t[s - 1].isalnum() and t[s].isalnum()) or (e < len(t) and t[e].isalnum() and t[e - 1].isalnum()):
                    continue  # part of something longer
                rows.append((f, t.count("\n", 0, s) + 1, s, e, t[s:e]))
        yield pd.DataFrame(rows, columns=["file_id", "line", "start", "stop", "value"])


def _body(texts: DataFrame) -> DataFrame:
    return spread(pick(texts, "file_id", "text").where("file_id is not null and text is not null"), "file_id")


def telling_literals(texts: DataFrame) -> DataFrame:
    """(file_id, line, kind, value, strong, places) of all candidates."""
    return _body(texts).mapInPandas(_scan, "file_id long, line int, kind string, value string, strong boolean, places array<struct<start: int, stop: int>>")


def literal_index(texts: DataFrame) -> DataFrame:
    """(file_id, h): hashes of all literals of every file, quoted or bare, wherever they stand; one row each."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(LITERAL), F.lit(0)), lambda x: F.xxhash64(F.regexp_replace(x, "^[\"'`]|[\"'`]$", ""))))
    return pick(texts, "file_id", "text").where("file_id is not null and text is not null").select("file_id", F.explode(found).alias("h"))


def confirmed(index: DataFrame, texts: DataFrame, owner_share: float = 0.001, least_owners: int = 12) -> DataFrame:
    """(value, owners) of the candidates that are secrets. Owners are all files that hold the value as a literal anywhere; a value
    of more than ``least_owners`` files and more than ``owner_share`` of all files is a placeholder, unless nobody could have made it up."""
    values = index.groupBy("value").agg(F.max("strong").alias("strong")).withColumn("h", F.xxhash64("value"))
    # only literals that are candidates are counted; one literal may stand in most files, so its rows are spread
    plain = salted_join(literal_index(texts), values.select("h").distinct(), "h", "file_id", "left_semi").select("h", "file_id")
    owners = plain.unionByName(index.select(F.xxhash64("value").alias("h"), "file_id")).distinct().groupBy("h").agg(F.count("*").alias("owners"))
    limit = max(least_owners, owner_share * pick(texts, "file_id").where("file_id is not null").count())
    return values.join(owners, "h").where(F.col("strong") | (F.col("owners") <= limit)).select("value", "owners")


def find_credentials(texts: DataFrame, owner_share: float = 0.001, least_owners: int = 12, block: int = 200_000, index: DataFrame | None = None) -> DataFrame:
    """(file_id, line, start, stop): places of credentials; start and stop (0-based, end excluded) are null for key blocks."""
    spark = texts.sparkSession
    index = index if index is not None else materialize(telling_literals(texts), "literals")
    known = materialize(confirmed(index, texts, owner_share, least_owners).withColumn("block", F.pmod(F.xxhash64("value"), F.lit(max(1, -(-index.count() // block))))), "secrets")
    # a placeholder may hold a large part of the index, so its rows are spread
    told = salted_join(index, known.select("value"), "value", "file_id", "left_semi").select("file_id", "line", F.explode_outer("places").alias("at")).select("file_id", "line", "at.start", "at.stop")
    words_of = known.join(index.where("kind <> 'key block'").select("value").distinct(), "value", "left_semi")
    hit = T.StructType([T.StructField("file_id", T.LongType()), T.StructField("line", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("value", T.StringType())])
    out = told
    for b in [r[0] for r in words_of.select("block").distinct().collect()]:  # as many as there are blocks
        words = spark.sparkContext.broadcast([r[0] for r in words_of.where(F.col("block") == b).select("value").collect()])  # about `block` values
        out = out.unionByName(_body(texts).mapInPandas(lambda it, words=words: _rescan(it, words), hit).select("file_id", "line", "start", "stop"))
    return out


def mask_spans(text: str | None, spans: list | None) -> str | None:
    """The text with every secret replaced by stars of its length, so that lines, columns and quotes stay as they are."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s, e in sorted((x[0], x[1]) for x in spans):
        if e <= at:
            continue
        s = max(s, at)
        out += [text[at:s], "*" * (e - s)]
        at = e
    return "".join(out) + text[at:]


def mask_key_blocks(text: str) -> str:
    """Key bodies between their BEGIN and END lines, masked."""
    return re.sub(r"(-{5}BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-{5})(.*?)(-{5}END|\Z)", lambda m: m[1] + re.sub(r"[A-Za-z0-9+/=]{16,}", lambda w: "*" * len(w[0]), m[2]) + m[3], text, flags=re.S)


def mask_credentials(texts: DataFrame, owner_share: float = 0.001, least_owners: int = 12) -> DataFrame:
    """(file_id, text, masked): every text, with its credentials masked and all else unchanged."""
    index = materialize(telling_literals(texts), "literals")
    places = find_credentials(texts, owner_share, least_owners, index=index)
    spans = places.where("start is not null").groupBy("file_id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))  # of one file each

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            masked = []
            for t, s in zip(b["text"], b["spans"]):
                if t:
                    t = mask_key_blocks(mask_spans(t, [(x["start"], x["stop"]) for x in s] if s is not None else []))
                masked.append(t)
            yield pd.DataFrame({"file_id": b["file_id"], "text": b["text"], "masked": masked})

    schema = T.StructType([T.StructField("file_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("masked", T.StringType())])
    return pick(texts, "file_id", "text").join(spans, "file_id", "left").mapInPandas(run, schema)
