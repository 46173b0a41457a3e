"""Profiles, linkage, retention, evaluation and streams on small fixtures."""

import math
import random

from siltstone.operators import evaluate as E
from siltstone.operators import linkage, profile, retention
from siltstone.operators.changelog import SortedRuns
from siltstone.operators.incremental import PartitionedIncrement
from siltstone.streaming import changes as C


def test_profile_of_dirty_columns(spark):
    df = spark.createDataFrame([(1, 1.0, "a", None, True), (2, float("nan"), "a", None, None), (None, 3.0, "b", None, False)], "i long, f double, s string, e string, b boolean")
    r = {x["column_name"]: x for x in profile.column_profile(df).collect()}
    assert (r["f"]["nulls"], r["f"]["mean"], r["f"]["inferred_type"]) == (1, 2.0, "float")
    assert (r["e"]["inferred_type"], r["s"]["inferred_type"], r["b"]["inferred_type"], r["i"]["is_unique"]) == ("unknown", "categorical", "boolean", False)
    one = {x["column_name"]: x for x in profile.column_profile(df.limit(1)).collect()}
    assert one["f"]["std"] == 0.0 and one["i"]["is_unique"]
    assert profile.column_profile(df.where("i > 5")).where("n <> 0").count() == 0


def test_correlation_skips_missing_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, None), (3.0, float("nan"), 5.0), (4.0, 8.0, 5.0)], "a double, b double, c double")
    assert [(r["left_column"], r["right_column"], r["r"]) for r in profile.pearson_pairs(df).collect()] == [("a", "b", 1.0)]


def test_linkage(spark):
    left = spark.createDataFrame([("/r/x/a.py",), ("/q/b.py",), ("/q/c.py",), (None,)], "p string")
    right = spark.createDataFrame([("a.py", 1), ("x/a.py", 2), ("y/b.py", 3), ("z/c.py", 4), ("w/c.py", 5)], "t string, id long")
    got = {r["p"]: (r["id"], r["matched_by"]) for r in linkage.longest_suffix_join(left, "p", right, "t", "id").collect()}
    assert got == {"/r/x/a.py": (2, "suffix"), "/q/b.py": (3, "name"), "/q/c.py": (None, None), None: (None, None)}
    imports = spark.createDataFrame([(1, "pkg.mod.f"), (2, "os"), (3, ".mod")], "import_id long, source string")
    symbols = spark.createDataFrame([(1, 10), (1, 9), (2, 9)], "import_id long, file_id long")
    modules = spark.createDataFrame([(5, "src.pkg.mod"), (6, "other.mod")], "file_id long, module string")
    ents = spark.createDataFrame([(1, "class", 3), (1, "function", 7), (1, "variable", 8)], "import_id long, kind string, entity_id long")
    got = {r["import_id"]: tuple(r)[1:] for r in linkage.link_imports(imports, symbols, modules, ents).collect()}
    assert got == {1: (9, 5, False, [8, 7, 3]), 2: (9, None, True, []), 3: (None, 5, False, [])}


def test_ring_patch_upsert(spark):
    ev = spark.createDataFrame([(k, f"f{k}", None) for k in range(1, 11)], "seq long, path string, result string")
    assert sorted(r["seq"] for r in retention.ring(ev, "seq", 4).collect()) == [7, 8, 9, 10]
    res = spark.createDataFrame([("f10", "ok"), ("f1", "late")], "path string, result string")
    assert {r["path"]: r["result"] for r in retention.patch(retention.ring(ev, "seq", 2), res, "path", "result").collect()} == {"f9": None, "f10": "ok"}
    a = spark.createDataFrame([(1, "old", 1), (2, "keep", 5)], "k long, v string, t long")
    b = spark.createDataFrame([(1, "new", 1), (2, "stale", 4), (3, "in", 0)], "k long, v string, t long")
    assert {r["k"]: r["v"] for r in retention.upsert(a, b, "k", "t").collect()} == {1: "new", 2: "keep", 3: "in"}


def test_text_metrics(spark):
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(0)
    for _ in range(40):
        a, b = ["".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2)]
        assert E.edit_distance(a, b) == lev(a, b)
    assert E.bleu("a b c d", "a b c d") == 1.0 and E.bleu("", "a") == 0.0
    assert math.isclose(E.rouge("the cat sat", "the cat ran"), 2 / 3) and math.isclose(E.rouge_l("a x b y", "a b"), 2 / 3)
    assert E.chrf("abc", "abc") == 1.0 and E.chrf("", "") == 1.0 and E.chrf("", "a") == 0.0
    assert math.isclose(E.meteor("a b c", "a b c"), 1 - 0.5 / 27) and E.meteor("x", "y") == 0.0
    assert E.anls("abcd", "abce") == 0.75 and E.anls("ab", "xyz") == 0.0
    df = spark.createDataFrame([(1, "a b", "a b"), (2, None, "x"), (3, "y", None)], "id long, pred string, gold string")
    got = {r["id"]: (r["cer"], r["wer"]) for r in E.pair_metrics(df).collect()}
    assert got == {1: (0.0, 0.0), 2: (1.0, 1.0), 3: (1.0, 1.0)}


def test_drift_bands(spark):
    a = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    assert E.psi(a, a, "v").first()["band"] == "stable"
    assert E.psi(a, a.selectExpr("v / 10 AS v"), "v").first()["band"] == "significant"


def test_streams(spark, tmp_path):
    rows = [(1, "a", "created", "h1", 1), (2, "b", "created", "h2", 1), (3, "a", "deleted", None, None), (4, "c", "created", "h4", 1)]
    for k in range(2):
        df = spark.createDataFrame(rows[2 * k : 2 * k + 2], "seq long, rel_path string, change_type string, new_hash string, new_size long").selectExpr("*", "timestamp_ntz'2025-01-01 00:00:00' AS recorded_at")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    feed = C.read_files(spark, f"{tmp_path}/feed", per_trigger=1)
    store = C.apply_changes(feed, SortedRuns(spark, buckets=2))
    assert len(store.runs) == 2 and {r["rel_path"] for r in store.alive().collect()} == {"b", "c"}
    taken = []
    C.process_increments(C.read_files(spark, f"{tmp_path}/feed", per_trigger=1), PartitionedIncrement(spark, buckets=2), lambda df, _: taken.extend(r["seq"] for r in df.collect()))
    assert sorted(taken) == [1, 2, 3, 4]
