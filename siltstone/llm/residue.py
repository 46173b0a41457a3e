"""Template residue and error-page text: records in which something stands in place of content.

A record's own prose is what is left when code (fenced, indented, in back-ticks, in quotes) is taken away. In it,
detectors look for unfilled slots, filler, output of undefined values, failed page parts, error, refusal and check pages
and demands to turn scripts on. What they hit is a sentence or a line; it weighs 2 where it can hardly be content, else 1.

No detector flags by itself. The terms of each hit are compared with those of the record's address (source, repository and file
name as the slug), its title and the rest of its body: a hit that shares at most half of its terms with them is a mismatch and weighs 1 more.
A record is low in information, which weighs 1 more, if it has few distinct terms and its body shares none or one with title and address. The
skeleton of a hit (numbers and ids taken out) is counted over the whole collection and by host: one that comes back in
``copies`` records on ``hosts`` hosts is a stock response and weighs 1 more. A record with a hit of ``needed`` (3) or more is residue.
Stock or low-information text without any hit is never flagged: notes may be short and licences repeat.

Defined results: null and empty texts are no cases; repeated records each get their own result; null source, repository
or file count as one more host and give no address terms; texts are read whole, of any length and number of lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import materialize, pick, salted_join, spread

FENCE = re.compile(r"^(```|~~~).*?^\1[^\n]*$", re.M | re.S)
TICKS = re.compile(r"`[^`\n]*`")
QUOTED = re.compile(r"\"[^\"\n]{1,120}\"|“[^”\n]{1,120}”|„[^“\n]{1,120}“|«[^»\n]{1,120}»")
CODE_LINE = re.compile(r"^(?:\s{4,}\S|\s*(?:def|class|return|import|from|export|const|let|var|func|function|public|private|if|for|while|echo|sudo|cd|git|curl|docker)\b.*[=(){}\[\];:$]|\s*[\w.]+\s*(?:=|:=|\+=)\s*\S|\s*ctx \S|\s*[$>] |\s*[{}\[\]]\s*,?$|\s*[{\[]\s*\"|\s*\"[\w.-]+\"\s*:)")

# an identifier-like word or a short phrase between delimiters of template languages
INNER = r"[A-Za-z_][\w.\- ]{0,48}"
SLOT = re.compile(
    rf"""(?x)\{{\{{-?\s*{INNER}\s*(?:\|[^}}\n]*)?-?\}}\}} | \{{%-?\s*{INNER}\s*-?%\}} | <%=?-?\s*{INNER}\s*-?%> | @@\s*{INNER}\s*@@ | \#\{{\s*{INNER}\s*\}} | \$\{{\s*{INNER}\s*\}} | \[\[\s*{INNER}\s*\]\]
      | (?<![\w%])%[A-Za-z_][\w.]*(?:\ [\w.]+){{0,3}}%(?![\w%]) | (?<!\w)__[A-Za-z](?:[\w.\- ]*[A-Za-z0-9])?__(?!\w) | \$\$[A-Z_]{{3,}}\$\$ | ~~[A-Z_]{{3,}}~~"""
)
# in square, angle or curly brackets alone only what reads as an instruction or a field name
FIELDISH = r"(?:[a-z]+_[a-z_]+|[A-Z]+_[A-Z_]+|(?:insert|enter|add|put|type|your|choose|select|replace|fill|describe)\b[\w .\-]{0,40}|(?:INSERT|ENTER|ADD|YOUR|OWNER|PROJECT|NAME|TITLE|DATE|VERSION|AUTHOR|COMPANY|CONTACT)(?:[ _][A-Z]+)*|(?:maintainer|contact|version|owner|project|author|company|name|title|date|module|release|email|url|link|placeholder)(?:[._ ]\w+){0,2})"
BRACKET = re.compile(rf"(?<![\w`\]])\[{FIELDISH}\](?![(\w:\[])|(?<![\w`<])<{FIELDISH}>(?!\w*</)|(?<![\w`{{$#%])\{{{FIELDISH}\}}(?![}}\w])")
HTML_TAG = frozenset("a abbr address article aside b body br button cite code dd del details div dl dt em figure footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav object ol option p pre q s samp section select small span strong style sub summary sup table tbody td textarea tfoot th thead time title tr u ul var video".split())

# The words of the common Latin filler.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore magna aliqua enim minim veniam quis nostrud ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident culpa officia deserunt mollit anim laborum augue felis ligula luctus massa morbi nibh nullam porta quam sapien tortor vitae justo erat pellentesque vestibulum vivamus praesent donec mauris curabitur".split()
)

SCRIPT = r"(?:java\s*-?script|js|scripts?|scripting|client-side\s+(?:code|scripts?)|active\s+content|skripte?|javascripts?)"
STRONG = {
    "scripts": re.compile(
        rf"""(?xim)
        (?:please|bitte|veuillez|por\s+favor)\b[^.\n]{{0,40}}\b(?:enable|allow|activate|turn\s+on|switch\s+on|aktivieren|einschalten|activer|habilit\w+|activ\w+)\b[^.\n]{{0,20}}\b{SCRIPT}\b
        | ^\W*you\s+(?:need|have|must)\s+(?:to\s+)?(?:enable|allow|activate|turn\s+on|switch\s+on)\b[^.\n]{{0,20}}\b{SCRIPT}\b | \ba\s+besoin\s+d(?:e\s+|')(?:{SCRIPT})\b | \b(?:necesita|requiere)\s+(?:{SCRIPT})\b | \b(?:benötigt|braucht|erfordert)\s+(?:{SCRIPT})\b
        | ^\W*(?:you\s+(?:need|have|must)\s+(?:to\s+)?)?(?:enable|allow|activate|turn\s+on|switch\s+on|activez|habilite|active|aktivieren\s+sie)\b[^.\n]{{0,30}}\b{SCRIPT}\b[^.\n]{{0,60}}\b(?:to|so\s+that|in\s+order|before|and\s+(?:reload|refresh|try)|pour|para|um)\b
        | \b(?:page|site|viewer|app|application|browser)\b[^.\n]{{0,30}}\b(?:requires|needs|does\s+not\s+(?:work|run|support)|do\s+not\s+(?:work|run)|won't\s+work|cannot\s+(?:work|run))\b[^.\n]{{0,20}}\b{SCRIPT}\b
        | ^\W*{SCRIPT}\s+(?:seems?|appears?|is|are)\b[^.\n]{{0,20}}\b(?:switched\s+off|turned\s+off|disabled|off|blocked|required|not\s+enabled)\b | ^\W*ohne\s+{SCRIPT}\b[^.\n]{{0,40}}\b(?:nicht|kein)
        | ^\W*sans\s+{SCRIPT}\b | ^\W*sin\s+{SCRIPT}\b | <noscript | \b{SCRIPT}\s+(?:est|sont|está|están)\s+(?:désactivé|requis|desactivad|necesari)"""
    ),
    "undefined": re.compile(r"\[object Object\]|(?:^|\s)#undefined\b|\bNaN\s+(?:ms|seconds?|minutes?|files?|%)|:\s*(?:NaN|Invalid Date|undefined|\[object \w+\])\s*(?:\||$)|\bof undefined\b|^\W*(?:Report|Summary|Overview) (?:for|of) (?:undefined|null|None)\b|^\W*#(?:REF|NAME|VALUE|DIV/0|N/A)[!?]?(?:\s|$)|^(?:Hello|Hi|Dear|Hallo|Bonjour|Hola) (?:null|undefined|None)\b|(?:\w+: (?:null|undefined|NaN)\s*\|\s*){2,}", re.M),
    "failed part": re.compile(
        r"""(?xim)^\W*(?:TemplateSyntaxError|TemplateNotFound|TemplateDoesNotExist|UndefinedError|Liquid\s+(?:error|warning)|Twig\w*Error|Smarty\s+error)\b.*$ | ^\W*(?:Warning|Notice|Fatal\s+error|Parse\s+error|Deprecated)\s*:\s+(?:include|require|undefined|uncaught|call\s+to|cannot|mysql|syntax|array)\b.*$
        | ^\W*(?:could\s+not|cannot|can't|failed\s+to|unable\s+to|error)\s+(?:load|render|loading|rendering|include|including)\s+(?:the\s+)?(?:partial|template|include|widget|block|section|component|snippet|fragment|module|view)\b.*$
        | ^\W*\[?\s*missing\s+(?:translation|template|partial|include|content|block|text)\b.*$ | ^\W*!!.{1,80}(?:not\s+(?:set|found|defined)|missing)\s*!!\W*$ | ^\W*\[?(?:an\s+)?error\s+occurred\s+while\s+processing\s+this\s+directive | ^\W*translation\s+missing\b | ^\W*include\s+\S+\s+(?:failed|not\s+found)\W*$
        | ^\W*traceback\s+\(most\s+recent"""
    ),
    "check page": re.compile(
        r"""(?xim)\b(?:verify|confirm|prove)\s+(?:that\s+)?you\s+are\s+(?:a\s+)?(?:human|not\s+a\s+(?:robot|bot)) | \bchecking\s+(?:that\s+you\s+are|if\s+you\s+are|your\s+browser|you\s+are) | \bunusual\s+traffic\b | ^\W*(?:complete|solve)\s+the\s+(?:captcha|challenge|puzzle|check)\b
        | \b(?:tick|select|click|pick|choose|mark)\s+(?:all\s+|every\s+|each\s+)(?:the\s+)?(?:squares?|images?|pictures?|tiles?|boxes)\b | \bpress\s+and\s+hold\b.*\bhuman | \bare\s+you\s+a\s+(?:robot|human)\b | \battention\s+required\b | \bbestätigen\s+sie,?\s+dass\s+sie\s+(?:ein\s+mensch|kein\s+roboter) | \bvérifi\w+\s+que\s+vous\s+(?:êtes\s+humain|n'êtes\s+pas\s+un\s+robot) | \bverifi\w+\s+que\s+(?:es|eres|usted)\b.*\b(?:humano|robot)"""
    ),
}
CODE3 = r"(?:4\d\d|5\d\d)"
PHRASE = r"(?:not\s+found|forbidden|bad\s+(?:gateway|request)|service\s+(?:temporarily\s+)?unavailable|internal\s+server\s+error|gateway\s+time-?out|too\s+many\s+requests|unauthori[sz]ed|gone|access\s+denied|method\s+not\s+allowed|request\s+time-?out|payload\s+too\s+large)"
ERROR_LINE = re.compile(
    rf"""(?xi)^\W*(?:
      (?:http\s+(?:status|error)|error|fehler|erreur|status|code)\s*(?:code\s*)?[:#]?\s*{CODE3}\b.* | {CODE3}\s*[-:.|]?\s*{PHRASE}\b.* | {PHRASE}\W*(?:(?:[:!-]|(?<!gone)\.)\s.*)?$
      | (?:something\s+went\s+wrong|oops|sorry|whoops|uh[\s-]oh|we\s+hit\s+a\s+snag|an?\s+(?:unexpected\s+)?error\s+(?:has\s+)?occurred|that(?:'s|\s+is)\s+an\s+error|server\s+error|application\s+error)\b\W*(?:[:!.,-]\s*.*)?$
      | (?:we\s+)?could\s+not\s+(?:render|display|show|load|open|find)\s+(?:the\s+|this\s+)?(?:view|page|record|document|site|archive|file)\b.* | (?:you\s+have\s+(?:used\s+up|exceeded|reached)\s+your|rate\s+limit\s+exceeded|quota\s+exceeded|too\s+many\s+requests)\b.*
      | your\s+(?:session|login)\s+(?:has\s+)?(?:timed\s+out|expired)\b.* | your\s+(?:address|ip|account|access)\b.*\b(?:blocked|denied|suspended|banned)\b.* | (?:log|sign)\s+in\s+(?:again\s+)?to\s+(?:see|view|continue|read)\b.* | you\s+(?:do\s+not|don't)\s+have\s+(?:permission|access)\b.* | access\s+(?:to\s+\S+\s+)?(?:was\s+|is\s+)?denied\b.*
      | (?:this|the|that)\s+(?:page|row|record|site|document|file|service|entry|view|archive|\w+)\s+(?:was\s+removed\s+by|has\s+been\s+removed|could\s+not\s+be\s+(?:found|loaded|displayed|shown|read)|does\s+not\s+exist|is\s+(?:temporarily\s+)?(?:down|unavailable|not\s+available|offline|closed)|you\s+(?:asked|are\s+looking)\s+for)\b.* | (?:down|closed)\s+for\s+maintenance\b.*
      | (?:zugriff\s+(?:verweigert|gesperrt)|seite\s+(?:nicht\s+gefunden|konnte\s+nicht)|die\s+(?:seite|ansicht)\b.*\b(?:nicht\s+(?:gefunden|geladen|angezeigt|verfügbar))|accès\s+(?:refusé|interdit)|page\s+(?:introuvable|non\s+trouvée)|la\s+page\b.*\b(?:introuvable|pas\s+pu|n'a\s+pas|n'existe)|acceso\s+(?:denegado|prohibido)|página\s+no\s+encontrada|no\s+se\s+(?:pudo|puede|ha\s+podido)\s+(?:mostrar|cargar|encontrar)|etwas\s+ist\s+schief|une\s+erreur\b|algo\s+salió\s+mal|se\s+ha\s+producido\s+un\s+error)\b.*
      | (?:le\s+(?:service|site)|la\s+page)\b.{{0,30}}\b(?:indisponible|inaccessible)\b.* | (?:der\s+dienst|die\s+seite|der\s+server)\b.{{0,30}}\b(?:nicht\s+(?:verfügbar|erreichbar)|gestört|überlastet)\b.* | (?:el\s+(?:servicio|sitio)|la\s+página)\b.{{0,30}}\bno\s+(?:está\s+disponible|existe)\b.* | (?:the\s+)?(?:service|site|server)\s+is\s+(?:temporarily\s+|currently\s+)?(?:unavailable|down|overloaded|busy)\b.*
      | no\s+se\s+(?:encontró|pudo)\b.{{0,80}}p[áa]gina.* )$"""
)
STUB_LINE = re.compile(
    r"""(?xi)^\W*(?: todo | tbd | tba | n/?a | xxx(?:\W+xxx)* | \.{3,} | … | coming\s+soon | \(?\s*(?:text|content|description|details)\s+to\s+(?:follow|come|be\s+added)\s*\)? | under\s+construction | work\s+in\s+progress | placeholder(?:\s+text)? | (?:your\s+)?(?:text|content|description|title)\s+(?:goes\s+)?here
      | (?:this\s+is\s+(?:a\s+)?)?(?:sample|dummy|placeholder|example)\s+(?:paragraph|text|content|page)\b.{0,80} | (?:describe|summari[sz]e|explain|insert|write|add|enter|put|fill\s+in)\s+(?:the|your|a|an|this|some)?\s*[\w\s-]{0,60}\b(?:here|in\s+this\s+(?:section|paragraph|place|field))\b.{0,60} | replace\s+this\b.{0,60} | (?:the\s+)?(?:text|content|section|description)\b.{0,60}\bwill\s+(?:be\s+added|follow)\b.{0,30} | click\s+to\s+(?:edit|add)\b.{0,40}
      | hier\s+(?:steht|kommt|folgt)\b.{0,40}\btext\b.{0,20} | texte?\s+(?:folgt|à\s+venir) | texto\s+(?:pendiente|de\s+ejemplo) )\W*$"""
)
FURNITURE = re.compile(
    r"""(?xi)^\W*(?: (?:home|docs|search|privacy|imprint|help|cookie\s+settings|login|sign\s+in|menu|about|contact|terms)(?:\s*[|·•/>-]\s*[\w ]+)* | [\w.-]+/\d+(?:\.\d+)* | (?:reference|référence|referencia|referenz|request|ticket|case|error\s+id|id|ray\s+id|incident|trace)\W*[\w.:-]{4,40} | repository\s+browser | loading\W* | please\s+wait\W* | [=*_~-]{3,} | try\s+again\b.{0,40} | sign\s+in\s+again\b.{0,30} )\W*$"""
)


def prose_of(text: str) -> str:
    """The text without code and quotations; lines stay lines."""
    t = FENCE.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
    t = TICKS.sub(" ", t)
    lines = t.split("\n")
    return "\n".join("" if CODE_LINE.match(x) else x for x in lines)


def terms_of(text: str) -> set[str]:
    return {w for w in re.findall(r"[^\W\d_]{3,}", text.lower())}


# Small words by which prose of the four languages is told from made-up words.
SMALL = frozenset(
    "the a an of and to in is it for on as by with this that was are be or at not if but from one two no so we you they i das der die und ist nicht ein eine den dem von zu mit auf für im bis auch bitte le la les un une des et est dans pour que qui ne pas sur au du avant après el los las una y es en por para con se su al del sin antes tras".split()
)
SYLLABLES = re.compile(r"(?:(?:qu|[bcdfghjklmnpqrstvwxz])[aeiou])+[bcdfglmnprstxz]?")


def filler(line: str) -> bool:
    """A line of Latin filler, of made-up syllables, or of one or two words over and over."""
    w = re.findall(r"[^\W\d_]+", line.lower())
    if len(w) >= 5 and sum(x in SMALL for x in w) > 0.3 * len(w):
        return False  # prose
    if len(w) >= 5 and not re.search(r"[\d_`()=/:]", line) and line.rstrip()[-1:] in ".!?":
        made = sum(bool(SYLLABLES.fullmatch(x)) for x in w)
        if made >= 0.9 * len(w) and sum(x in SMALL for x in w) <= 0.3 * len(w) and len(set(w)) >= 0.6 * len(w):
            return True
    if len(w) >= 4:
        latin = sum(x in LATIN for x in w)
        if latin >= 0.8 * len(w):
            return True
        if len(w) >= 6 and len(set(w)) <= 2:
            return True
    return bool(re.match(r"(?i)^\W*lorem\s+ipsum\b", line))


# what a text must hold, in lower case, for a detector to be worth running; none of them can match without
NEEDS = {
    "scripts": ("script", "js", "client-side", "skript", "active"),
    "undefined": ("undefined", "nan", "[object", "invalid date", "null", "none", "#ref", "#name", "#value", "#div", "#n/a"),
    "failed part": ("template", "undefinederror", "liquid", "twig", "smarty", "warning", "notice", "error", "deprecated", "could not", "cannot", "can't", "failed", "unable", "missing", "!!", "include", "traceback"),
    "check page": ("you are", "unusual", "captcha", "challenge", "puzzle", "check", "squares", "images", "pictures", "tiles", "boxes", "human", "robot", "attention", "mensch", "humain", "humano"),
}
SLOT_MARKS = ("{", "<%", "@@", "[[", "%", "__", "$$", "~~")


HEADING = re.compile(r"#{1,6}\s|[=-]{3,}$")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[^\W\d_a-z])")


def unit_at(text: str, start: int, stop: int) -> tuple[int, int]:
    """The sentence or line around a place; of several lines, all of them."""
    a, b = text.rfind("\n", 0, start) + 1, text.find("\n", stop)
    b = len(text) if b < 0 else b
    for m in SENTENCE_END.finditer(text, a, b):
        if m.end() <= start:
            a = m.end()
        elif m.start() >= stop:
            b = m.start()
            break
    return a, b


def hits(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, weight, start, stop) of what the detectors hit, in places of ``prose_of(text)``."""
    low = text.lower()
    prose = prose_of(text)
    plain = QUOTED.sub(lambda m: " " * len(m.group()), prose)  # places stay the same
    out = []
    for kind, rx in STRONG.items():
        if any(x in low for x in NEEDS[kind]):
            body = prose if kind in ("scripts", "undefined") else plain
            out += [(kind, 2, *unit_at(prose, *m.span())) for m in rx.finditer(body)]
    if any(x in plain for x in SLOT_MARKS):
        out += [("slot", 2, *unit_at(prose, *m.span())) for m in SLOT.finditer(plain)]
    if "[" in plain or "<" in plain or "{" in plain:
        out += [("slot", 2, *unit_at(prose, *m.span())) for m in BRACKET.finditer(plain) if m.group()[1:-1].split(" ")[0].lower() not in HTML_TAG]
    lines, at, fresh = [], 0, True  # (line, place, does it begin a block)
    for x in plain.split("\n"):
        if x.strip():
            lines.append((x.strip(), at + len(x) - len(x.lstrip()), fresh))
        fresh = not x.strip()
        at += len(x) + 1
    body = [x for x in lines if not FURNITURE.match(x[0])]
    stubs = []
    for n, (x, a, fresh) in enumerate(body):
        if filler(x):
            out.append(("filler", 2, a, a + len(x)))
        if STUB_LINE.match(x):
            stubs.append((a, a + len(x)))
        # what a page of error says begins a block; a heading says it only as the record's first line
        if ERROR_LINE.match(x) and (n == 0 or not HEADING.match(x)):
            out.append(("error page", 2 if fresh or n == 0 else 1, a, a + len(x)))
    heads = sum(bool(HEADING.match(x[0])) for x in body)
    weight = 2 if stubs and len(stubs) + heads >= len(body) else 1  # nothing but headings and stubs
    out += [("stub", weight, a, b) for a, b in stubs]
    return out


def compared_hits(text: str) -> list[tuple]:
    """(kind, weight, terms, alien, few, shared, body, skeleton) of every hit of a record: how many terms it has, those found nowhere
    else in the record, whether the record has few terms at all, how many of its body are in its title, and which aren't (of few ones)."""
    found = hits(text)
    if not found:
        return []
    prose = prose_of(text)
    rest, at = [], 0
    for a, b in sorted({h[2:] for h in found}):
        rest.append(prose[at:a])
        at = max(at, b)
    other = terms_of(" ".join([*rest, prose[at:]]))
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    title, body = terms_of(lines[0]), terms_of("\n".join(lines[1:]))
    few = len(title | body) <= 30
    out = {}
    for kind, weight, a, b in found:
        own = terms_of(prose[a:b]) - SMALL
        out[(kind, weight, a, b)] = (kind, weight, len(own), sorted(own - other), few, len(body & title), sorted(body - title) if few else [], skeleton(prose[a:b]))
    return list(out.values())


def skeleton(text: str) -> str:
    """The text without what changes from copy to copy: numbers, ids, names with inner marks, blanks and case."""
    t = re.sub(r"\b[0-9a-f]*\d[0-9a-f.]*\b|\w*(?:[./_:-]\w+)+", "0", text.lower())
    return re.sub(r"\s+", " ", re.sub(r"0(?:[.\s]*0)*", "0", t)).strip()


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(*r, *h) for *r, text in zip(b["doc_id"], b["host"], b["repo"], b["file_id"], b["text"]) if text and text.strip() for h in compared_hits(text)]
        out = pd.DataFrame(rows, columns=["doc_id", "host", "repo", "file_id", "kind", "weight", "terms", "alien", "few", "shared", "body", "skeleton"])
        yield out.astype({"file_id": "Int64"})


FEATURES = "doc_id long, host string, repo string, file_id long, kind string, weight int, terms int, alien array<string>, few boolean, shared int, body array<string>, skeleton string"


def weighed_hits(documents: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(doc_id, host, kind, weight, key): hits with what the comparison with address, title and body adds to them."""
    docs = pick(documents, "doc_id", "text", "source", "repo", "file_id").where("doc_id is not null and text is not null").select("doc_id", "text", F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("host"), F.col("repo"), F.col("file_id").cast("long").alias("file_id"))
    h = materialize(spread(docs, "doc_id").mapInPandas(_features, FEATURES), "hits")
    if files is not None:  # only hits meet the names of files, no texts; those that name no file keep out, so that their null key isn't hot
        names = pick(files, "file_id", "file_name").where("file_id is not null").groupBy(F.col("file_id").cast("long").alias("file_id")).agg(F.max("file_name").alias("file_name"))
        h = salted_join(h.where("file_id is not null"), names, "file_id", "doc_id").unionByName(h.where("file_id is null").withColumn("file_name", F.lit(None).cast("string")))
    slug = F.concat_ws(" ", "host", "repo", *(["file_name"] if files is not None else []))
    address = F.array_distinct(F.regexp_extract_all(F.lower(F.translate(slug, "_", " ")), F.lit(r"\p{L}{3,}"), F.lit(0)))
    known = F.col("terms") - F.size("alien") + F.size(F.array_intersect("alien", address))
    mismatch = 2 * known <= F.col("terms")
    low = F.col("few") & (F.col("shared") + F.size(F.array_intersect("body", address)) <= 1)
    return h.select("doc_id", "host", "kind", (F.col("weight") + mismatch.cast("int") + low.cast("int")).alias("weight"), F.xxhash64("skeleton").alias("key"))


def find_residue(documents: DataFrame, files: DataFrame | None = None, copies: int = 4, hosts: int = 2, needed: int = 3) -> DataFrame:
    """(doc_id, kinds) of the records to drop, with the kinds of the hits that weigh enough. ``files`` (file_id, file_name) gives
    addresses their slugs."""
    h = weighed_hits(documents, files)
    # stock responses: counted by skeleton and host, combined before the shuffle; hits that weigh enough without need none
    sure = h.where(F.col("weight") >= needed).select("doc_id", "kind")
    stock = h.groupBy("key", "host").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("copies"), F.count("*").alias("hosts"))
    stock = stock.where((F.col("copies") >= copies) & (F.col("hosts") >= hosts)).select("key")
    # one stock response may be a large part of all hits, so its rows are spread
    backed = salted_join(h.where(F.col("weight") == needed - 1), stock, "key", "doc_id", "inner").select("doc_id", "kind")
    return sure.unionByName(backed).groupBy("doc_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
