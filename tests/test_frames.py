"""Small relational operators, line differences, logs, concordance and enrichment on small frames with nulls, ties and clashing names."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import concordance as C
from siltstone.operators import enrich as E
from siltstone.operators import frames as R
from siltstone.operators.linediff import ChangeLog, compare_lines, line_changes


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=str)


def test_inserts(spark):
    base = spark.createDataFrame([(1, "a"), (None, "z")], "k long, v string")
    news = spark.createDataFrame([(1, "b"), (2, "d"), (2, "c"), (None, "y")], "k long, v string")
    assert rows(R.insert_ignore(base, news, "k")) == rows(spark.createDataFrame([(1, "a"), (2, "c"), (None, "z"), (None, "y")], "k long, v string"))
    assert rows(R.insert_replace(base, news, "k")) == rows(spark.createDataFrame([(1, "b"), (2, "d"), (None, "z")], "k long, v string"))
    assert R.insert_ignore(base.limit(0), news.limit(0), "k").count() == 0


def test_store(spark, tmp_path):
    s = R.Store(spark, f"file://{tmp_path}/store")
    s.ensure_table("t", "a long, b string")
    s.ensure_table("t", "a long, b string")
    s.insert_many("t", spark.createDataFrame([("x", 1, "q")], "b string, a int, extra string"))
    s.insert_many("t", spark.createDataFrame([(None, None)], "b string, a int"))
    assert s.names() == ["t"] and rows(s.table("t"))[0] == (1, "x") and s.execute("SELECT count(*) AS n FROM {t} WHERE a = :v", {"v": 1}).first()[0] == 1
    with pytest.raises(ValueError):
        s.table("t; drop")
    with pytest.raises(ValueError):
        R.count_where(s.table("t"), "1 = 1; drop")
    assert R.count_where(s.table("t")) == 2 and R.count_where(s.table("t"), "b = :v", {"v": "x"}) == 1


def test_keys_and_names(spark):
    d = spark.createDataFrame([(" My Repo! ", "p"), ("---", None), (None, "p")], "name string, path string")
    got = [tuple(r) for r in d.select(R.slug(d.name).alias("s"), R.storage_key(d.name, d.path).alias("k")).collect()]
    assert got[0][0] == "my-repo" and got[0][1].startswith("my-repo-") and len(got[0][1]) == 8 + 16 and got[1][0] == "project" and got[2][0] is None
    f = spark.createDataFrame([(1, "PY"), (2, ".py"), (3, "weird"), (4, "WEIRD"), (5, None)], "file_id long, e string")
    ids = dict(rows(R.extension_ids(f, "e", spark.createDataFrame([(7, ".py")], "extension_id long, extension_name string")), "file_id", "extension_id"))
    assert ids[1] == ids[2] == 7 and ids[3] == ids[4] >= R.RESERVED and ids[5] != ids[3]
    z = spark.createDataFrame([("Europe/Oslo", 60), ("UTC+01:00", 60), ("Africa/Lagos", 60), ("Asia/Kabul", 270)], "zone string, offset_minutes int")
    label, best = R.zone_slot(z.offset_minutes, z)
    assert rows(best, "offset_minutes", "zone") == [(270, "Asia/Kabul"), (60, "UTC+01:00")] and z.select(label.alias("l")).distinct().count() == 2


def test_percentiles_layers_and_health(spark):
    v = spark.createDataFrame([("a", i) for i in range(10)] + [("b", None)], "k string, v int")
    assert rows(R.position_percentile(v, "k", "v", {"p": 0.5, "q": 0.99})) == [("a", 4, 8)]
    t = spark.createDataFrame([("model.layers.0.w", 2, 8), ("model.layers.0.b", 1, 4), ("head", 5, 20)], "name string, n long, b long")
    assert rows(R.layers(t, "name", "n", "b")) == [("head", 1, 5, 20), ("model.layers.0", 2, 3, 12)]
    c = spark.createDataFrame([(1, 5), (2, 5), (2, 5), (5, 1)], "seq long, n long")
    assert rows(R.chunk_health(c, "seq", "n")) == [(4, 1, 5, 2, 1, 16)]


def test_csv_shapes(spark):
    d = spark.createDataFrame([('a;"b;c";d\n1;2;3\n',), ("",), ("one",), ("a\tb\r\nc\td",)], "t string")
    s = R.csv_shape(d.t)
    assert [tuple(r) for r in d.select(*[c.alias(n) for n, c in s.items()]).collect()] == [(";", 2, 3), (",", 0, 0), (",", 1, 1), ("\t", 2, 2)]


def test_line_changes(spark):
    assert compare_lines("a\nb\nc", "a\nx\nc\nd") == (2, 1, "@@ 2,1 2,1 @@\n-b\n+x\n@@ 4,0 4,1 @@\n+d") and compare_lines(None, "a\n\nb")[:2] == (3, 0)
    old = spark.createDataFrame([(1, "a\npassword = hunter22x\n"), (2, "same"), (3, None), (5, "gone")], "id long, text string")
    new = spark.createDataFrame([(1, "a\npassword = Xk39dkkd\nmail bob@example.org\n"), (2, "same"), (3, None), (4, "new\nlines")], "id long, text string")
    got = {r["id"]: r for r in line_changes(old, new, "id", "text").collect()}
    assert {k: (r["change_type"], r["lines_added"], r["lines_removed"]) for k, r in got.items()} == {1: ("modified", 2, 1), 4: ("created", 2, 0), 5: ("deleted", 0, 1)}
    assert "hunter22x" not in got[1]["snippet"] and "bob@" not in got[1]["snippet"]


def test_log_appends_a_batch_once(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/log")
    a = spark.createDataFrame([("r1", 1), ("r2", 2), (None, 3)], "repo_name string, seq long")
    log.append(a, "repo_name", "b1")
    log.append(a, "repo_name", "b1")
    log.append(a.where("seq = 1").withColumn("seq", a.seq + 10), "repo_name", "b2")
    assert log.read().count() == 4 and [r["seq"] for r in log.recent("r1", "seq").collect()] == [11, 1]


def test_concordance(spark):
    d = spark.createDataFrame([(1, "Ab 'C d'\r\n\u00fcber x1"), (2, None), (None, "q"), (3, ""), (4, "w" * 500)], "file_id long, text string")
    got = rows(C.concordance(d), "file_id", "token_kind", "token", "line", "start_col", "end_col")
    assert got == sorted([(1, "word", "ab", 1, 0, 2), (1, "word", "c", 1, 4, 5), (1, "word", "d", 1, 6, 7), (1, "string", "C d", 1, 4, 7), (1, "word", "\u00fcber", 2, 0, 4), (1, "word", "x1", 2, 5, 7), (4, "word", "w" * 120, 1, 0, 500)], key=str)
    assert rows(C.registry(C.concordance(d.unionByName(d.where("file_id = 1").withColumn("file_id", d.file_id + 6)))).where("token = 'ab'")) == [("word", "ab", 2, 2)]
    m = C.pattern_matches(d, [(1, r"\w"), (2, r"x*")], most=2, width=1)
    assert rows(m.where("file_id = 1"), "pattern_id", "line", "start_col", "match_text") == [(1, 1, 0, "A"), (1, 1, 1, "b"), (2, 2, 5, "x")]
    assert C.pattern_matches(d.limit(0), [(1, "a")]).count() == 0


@pytest.mark.parametrize("language", sorted(C.CONSTRUCTS))
def test_every_construct_compiles_and_names_are_unique(language):
    import re

    names = [c[0] for c in C.CONSTRUCTS[language]]
    assert len(set(names)) == len(names) and language in C.LANGUAGES and all(re.compile(c[2]) for c in C.CONSTRUCTS[language])


def test_constructs(spark):
    d = spark.createDataFrame([(1, "import os\nclass A:\n    def f(self):\n        raise X\n", ".PY"), (2, "package a\nfunc (x *T) F() {\n y := 1\n}\n", ".go"), (3, "import os", ".xyz"), (4, "import os", None)], "file_id long, text string, extension string")
    got = rows(C.constructs(d), "file_id", "construct_name", "line")
    assert got == [(1, "class", 2), (1, "function", 3), (1, "import", 1), (1, "raise", 4), (2, "func", 2), (2, "package", 1), (2, "short_var", 3)]


def test_enrichment(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----"
    d = spark.createDataFrame([(1, f"a\n{key}\ncard 4111 1111 1111 1111 and 4111 1111 1111 1112\nx@y.org", ".py"), (2, None, ".py"), (3, "# says what\ndef f():\n  pass\n\ndef g():\n  pass\n", ".py")], "file_id long, text string, extension string")
    flags = rows(E.security_flags(d), "file_id", "pattern_name", "severity", "line", "evidence")
    assert (1, "private_key_header", "critical", 2, "----" + "*" * 12) in flags and (1, "email", "low", 4, "x@y." + "***") in flags and sum(f[1] == "credit_card" for f in flags) == 1
    assert E.security_flags(d, most=1).count() == 1
    assert rows(E.symbol_docs(d)) == [(3, "function", 2, 1), (3, "function", 5, 0)]
    m = E.text_metrics(d.text)
    got = {r["file_id"]: (r["n"], r["e"]) for r in d.select("file_id", m["line_count"].alias("n"), m["ends_with_newline"].alias("e")).collect()}
    assert got[1] == (4, 0) and got[3] == (6, 1)
    s = rows(E.summaries(d, "file_id", "text", C.content_family(d.extension)), "file_id", "method", "tags")
    assert [x[0] for x in s] == [1, 3] and s[1][2][0] in ("pass", "says", "what")


@pytest.mark.parametrize("ext,cls,family", [(".PNG", "data", "media"), ("py", "code", "code"), ("weird", "code", "code"), ("md", "data", "markup"), ("weird", None, "misc"), (None, "schema", "schema"), ("zip", "code", "archive")])
def test_families(spark, ext, cls, family):
    d = spark.createDataFrame([(ext, cls)], "e string, c string")
    assert d.select(C.content_family(d.e, d.c)).first()[0] == family


def test_entities_of_all_categories(spark):
    from siltstone.functions import scalars as S

    t = "Call +49 (30) 123-4567 on March 3, 2024. ISBN 978-3-16-148410-0, ISBN 978-3-16-148410-1, DE89370400440532013000, DE89370400440532013001, 2024-03-03, 5 %, 10.1000/xyz, a@b.org"
    d = spark.createDataFrame([(t,), (None,), ("",)], "t string")
    got = {}
    for r in d.select(F.inline(S.entities(d.t))).collect():
        got.setdefault(r["category"], []).append(r["value"].strip())
    assert got["iban"] == ["DE89370400440532013000"] and [v for v in got["isbn"] if "148410" in v] and all("410-1" not in v for v in got["isbn"])
    assert got["date_written"] == ["March 3, 2024"] and any("123-4567" in v for v in got["phone"]) and got["doi"] == ["10.1000/xyz"] and len(S.ENTITIES) == 16


def test_rouge_has_precision_and_recall():
    from siltstone.operators.evaluate import rouge_l_scores, rouge_scores

    assert rouge_scores("the cat", "the cat ran off") == (1.0, 0.5, 2 / 3) and rouge_l_scores("a x b y", "a b") == (0.5, 1.0, 2 / 3) and rouge_scores("", "x") == (0.0, 0.0, 0.0)
