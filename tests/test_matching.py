import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import findings as N
from siltstone.operators import matching as M


def test_assignment_against_brute_force():
    rng = np.random.default_rng(1)
    for n, m in [(3, 3), (2, 4), (4, 2), (1, 1), (5, 5)]:
        c = rng.random((n, m))
        got = sum(c[i, j] for i, j in M.assign(c))
        k = min(n, m)
        best = min(sum(c[i, j] for i, j in zip(a, b)) for a in itertools.combinations(range(n), k) for b in itertools.permutations(range(m), k))
        assert abs(got - best) < 1e-9


def test_boxes(spark):
    assert M.iou([0, 0, 2, 2], [1, 1, 3, 3]) == pytest.approx(1 / 7) and M.iou([0, 0, 0, 0], [0, 0, 0, 0]) == 0.0
    assert M.average_precision([], []) == 1.0 and M.average_precision([(1.0, [0, 0, 1, 1])], []) == 0.0 and M.average_precision([], [[0, 0, 1, 1]]) == 0.0
    g = [[0, 0, 1, 1], [5, 5, 6, 6]]
    assert M.average_precision([(0.9, [0, 0, 1, 1]), (0.8, [9, 9, 10, 10]), (0.7, [5, 5, 6, 6])], g) == pytest.approx(0.5 + 0.5 * 2 / 3)
    rows = [(1, "a", True, None, [0.0, 0.0, 1.0, 1.0]), (1, "a", False, 0.5, [0.0, 0.0, 1.0, 1.0]), (1, "b", False, 0.5, [0.0, 0.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "case_id long, label string, is_gold boolean, score double, box array<double>")
    assert {r["label"]: r["ap"] for r in M.detection_scores(df).collect()} == {"a": 1.0, "b": 0.0}


def test_order():
    assert M.kendall([0, 1, 2]) == 1.0 and M.kendall([2, 1, 0]) == 0.0 and M.kendall([]) == 1.0
    g = [(0, "first block"), (1, "second one"), (2, "third")]
    assert M.reading_order(g, g) == 1.0 and M.reading_order([], []) == 1.0 and M.reading_order(g, []) == 0.0
    assert M.reading_order([(2, "first block"), (1, "second one"), (0, "third")], g) == 0.5
    random.Random(0)


def test_spans(spark):
    rows = [
        (1, "email", True, 0, 5, "a", 0), (1, "email", True, 10, 15, "b", 1), (1, "email", False, 2, 6, "x", 0), (1, "email", False, 3, 5, "y", 1), (2, "email", True, None, None, "Q  z", 0), (2, "email", False, None, None, "q z", 0), (1, "phone", False, 0, 1, "p", 0),
    ]
    df = spark.createDataFrame(rows, "case_id long, kind string, is_gold boolean, start long, stop long, value string, ord int")
    got = {r["kind"]: (r["tp"], r["fp"], r["fn"]) for r in M.span_scores(df).collect()}
    assert got == {"email": (2, 1, 1), "phone": (0, 1, 0)}
    assert {r["kind"]: r["tp"] for r in M.span_scores(df, "type").collect()}["email"] == 3


def test_answers(spark):
    df = spark.createDataFrame([(1, "where is it", "It is here. Nothing else.", ["it is here", "unrelated"], "it is here"), (2, None, None, [], None)], "case_id long, question string, answer string, contexts array<string>, reference string")
    r = {x["case_id"]: x for x in M.answer_scores(df).collect()}
    assert (r[1]["faithfulness"], r[1]["context_precision"], r[1]["context_recall"]) == (0.5, 0.5, 1.0)
    assert r[1]["factual_correctness"] == pytest.approx(2 * 3 / 8) and r[2]["faithfulness"] == 1.0 and r[2]["context_precision"] == 0.0


def test_findings_and_free_values(spark):
    t = spark.createDataFrame([(1, "\tx \n  y\nTODO"), (2, ""), (3, None), (4, "ok\n")], "id long, text string")
    assert {(r["id"], r["rule"]) for r in N.quality_findings(t, "id", "text").collect()} == {(1, "mixed_indentation"), (1, "trailing_whitespace"), (1, "missing_trailing_newline"), (1, "todo_markers")}
    v = spark.createDataFrame([("# Title\nimport x\n\n// body", "Привет мир a", "$1,234.50 net", "March 5, 2024"), ("", "123", "none", "x")], "a string, b string, c string, d string")
    r = v.select(N.summary(F.col("a")), N.dominant_script(F.col("b")), N.parse_money(F.col("c")), F.to_date(N.parse_date(F.col("d"))).cast("string")).collect()
    assert [tuple(x) for x in r] == [("Title body", "Cyrillic", 1234.5, "2024-03-05"), ("", "unknown", None, None)]


def test_pair_scores_cross_blocks_of_ids(spark, tmp_path):
    from siltstone.plans import registry

    rows = [(1, "A", "x"), (5, " a", "y"), (70, "a", "y"), (71, "b", "p"), (200, "b", "p"), (900, "a", "z"), (901, None, "z"), (2, "c", "q")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["id"]: r["cer"] for r in registry.queries()["pair_scores"](spark, str(tmp_path)).collect()}
    assert got == {1: 1.0, 5: 0.0, 70: 1.0, 71: 0.0}


def test_batched_alignments_against_single_ones():
    from siltstone.operators import alignments as A
    from siltstone.operators import evaluate as V

    rng = random.Random(5)
    pairs = []
    for _ in range(150):
        kinds = rng.choice([1, 2, 5, 300, 3000])
        text = lambda: "".join(chr(rng.randrange(65, 65 + kinds)) for _ in range(rng.choice([0, 1, 5, 62, 63, 64, 126, 251, 252, 253])))  # noqa: B023, E731
        a = text()
        pairs.append((a, text() if rng.random() < 0.5 else a[: rng.randrange(len(a) + 1)] + text()[:5] + a[-30:]))
    coded = A.char_codes(pairs)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = list(itertools.accumulate(range(len(b)), lambda left, j: max(left, row[j + 1], row[j] + (x == b[j])), initial=0))
        return row[-1]

    distances, lengths = [V.edit_distance(a, b) for a, b in pairs], [common(a, b) for a, b in pairs]
    saved = A.WORDS, A.CELLS, A.FEW
    try:
        for A.WORDS, A.CELLS, A.FEW in ((8192, 1 << 22, 0), (9, 1 << 22, 0), (8192, 3000, 0), (8192, 1 << 22, 1e9), saved):
            assert A.edit_distances(coded) == distances and A.common_lengths(coded) == lengths
    finally:
        A.WORDS, A.CELLS, A.FEW = saved
    assert A.gram_hits(coded, 6, 999).tolist() == [[sum((V._grams(a, n) & V._grams(b, n)).values()) for n in range(1, 7)] for a, b in pairs]


def test_pair_metrics_equal_single_ones_in_time(spark):
    import time

    from siltstone.operators import evaluate as V

    odd = [("", ""), (None, "a"), ("a b", None), ("  A\tb\n", "a B"), (" x y ", "x y"), ("ΑΣ İx", "ας i̇x"), ("Same TEXT here", "same text here"), ("aaaa", "aa"), ("日本語 😀", "日本 😀語")]
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(["row", "Queue", "hash", "of", "a", "batch", "ring", "7"]) for _ in range(n))
    long = [(text(1200), text(1200)) for _ in range(400)]
    began = time.time()
    got = {r["id"]: r for r in V.pair_metrics(spark.createDataFrame([(i, *x) for i, x in enumerate(odd + long)], "id long, pred string, gold string")).collect()}
    took = time.time() - began
    assert len(got) == len(odd) + len(long)
    for i, (p, g) in enumerate(odd + long[:3]):
        p, g, r = p or "", g or "", got[i]
        words = V._squash(g).split()
        want = {"wer": V.edit_distance(V._squash(p).split(), words) / len(words) if words else float(bool(p.split())), "bleu": V.bleu(p, g), "meteor": V.meteor(p, g), "chrf": V.chrf(p, g)}
        for name, x in (("rouge1", V.rouge_scores(p, g, 1)), ("rouge2", V.rouge_scores(p, g, 2)), ("rouge_l", V.rouge_l_scores(p, g))):
            want |= dict(zip((f"{name}_precision", f"{name}_recall", f"{name}_f1"), x))
        assert {k: r[k] for k in want} == want, i
    assert got[6]["cer"] == pytest.approx(5 / 14) and [got[i]["anls"] for i in (0, 1, 3, 6, 7)] == [1.0, 0.0, 1.0, 1.0, 0.0]
    assert took < 30
