import random
from collections import Counter, defaultdict

import pytest

from siltstone.llm.frequency import ngram_counts, term_marks, token_registry

SCHEMA = "token string, token_kind string, location_key string, line int, start_col int, end_col int, rec string, TOKEN string"


def loc(spark, rows):
    return spark.createDataFrame([(*r, "z", "q") for r in rows], SCHEMA)


@pytest.mark.parametrize("sigma", [1, 2, 4])
def test_ngrams_against_brute_force(spark, sigma):
    rng = random.Random(sigma)
    docs = [(i, [rng.choice("abc") for _ in range(rng.randrange(0, 12))]) for i in range(60)] + [(None, ["a"]), (70, None), (71, []), (72, ["a", None, "b"])]
    occ, recs = Counter(), defaultdict(set)
    for i, a in docs:
        if i is None or not a:
            continue
        a = [x for x in a if x is not None]
        for s in range(len(a)):
            for n in range(1, sigma + 1):
                if s + n <= len(a):
                    occ[tuple(a[s : s + n])] += 1
                    recs[tuple(a[s : s + n])].add(i)
    df = spark.createDataFrame([(i, a, 5) for i, a in docs], "doc long, terms array<string>, rec int")
    got = {tuple(r["gram"]): (r["occurrences"], r["records"]) for r in ngram_counts(df, "doc", "terms", sigma, salts=3).collect()}
    assert got == {g: (n, len(recs[g])) for g, n in occ.items()}


def test_small_batches_carry_the_stack(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        test_ngrams_against_brute_force(spark, 2)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_registry_rules(spark):
    rows = [
        ("Café", "word", "k1", 1, 1, 5), (" café ", "word", "k1", 1, 1, 5),  # one occurrence, two spellings
        ("CAFÉ", "word", "k2", None, 1, 5), ("Cafe", "word", "k1", 2, 1, 5), ("Cafe", "string", "k1", 2, 1, 5), ("Cafe ", "string", "k1", 2, 9, 5),
        (None, "word", "k1", 1, 1, 1), ("x", None, "k1", 1, 1, 1), ("x", "word", None, 1, 1, 1), ("", "word", "k3", 1, 1, 1),
    ]
    got = {(r["token_kind"], r["token"]): (r["occurrence_count"], r["file_count"]) for r in token_registry(loc(spark, rows)).collect()}
    assert got == {("word", "café"): (2, 2), ("word", "cafe"): (1, 1), ("string", "Cafe"): (1, 1), ("string", "Cafe "): (1, 1), ("word", ""): (1, 1)}


def test_marks(spark):
    rows = [("the", "word", f"k{i}", 1, 1, 3) for i in range(8)] + [("rare", "word", "k1", 1, 5, 8), ("rare", "word", "k1", 2, 5, 8)] + [("mid", "word", f"k{i}", 3, 1, 2) for i in range(3)] + [("s", "string", f"k{i}", 3, 1, 2) for i in range(12)]
    got = {(r["token"], r["mark"]) for r in term_marks(loc(spark, rows)).collect()}
    assert got == {("the", "common"), ("rare", "rare")}


def test_empty_and_very_long(spark):
    assert token_registry(loc(spark, [])).count() == 0
    assert term_marks(loc(spark, [])).count() == 0
    long = "x" * 200_000
    assert [tuple(r)[:2] for r in token_registry(loc(spark, [(long, "word", "k", 1, 1, 1)])).collect()] == [("word", long)]


def test_document_terms_are_words_of_any_script(spark, tmp_path):
    from collections import Counter

    from siltstone.llm.queries import QUERIES
    from siltstone.plans import registry

    texts = ["Für größe Für die Größe", "l'été où l'été est", "größe señor größe für", "x 1,234.5", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = [["für", "größe", "für", "die", "größe"], ["l'été", "où", "l'été", "est"], ["größe", "señor", "größe", "für"], ["x", "1,234.5"], []]
    want = set()
    for n in (1, 2, 3):
        grams = [[tuple(d[i : i + n]) for i in range(len(d) - n + 1)] for d in docs]
        occ, recs = Counter(g for d in grams for g in d), Counter(g for d in grams for g in set(d))
        want.add((n, len(occ), sum(occ.values()), max(occ.values()), max(recs.values())))
    got = QUERIES["p2_document_ngrams"](spark, str(tmp_path))
    assert {(r["n"], r["grams"], r["occurrences"], r["top_occurrences"], r["top_records"]) for r in got.collect()} == want
    top = {r["token"]: r["documents"] for r in registry.queries()["top_terms"](spark, str(tmp_path)).collect()}
    assert top == {"für": 2, "größe": 2, "die": 1, "l'été": 1, "est": 1, "señor": 1, "1,234.5": 1}
