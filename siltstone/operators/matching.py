"""Metrics that match predictions to gold one to one: boxes, text groups and typed spans; a case is one group's batch.

Groups are single evaluation cases (and labels), which are bounded by what a page or a document holds."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.evaluate import edit_distance


def iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0.0, w) * max(0.0, h)
    area = lambda x: max(0.0, x[2] - x[0]) * max(0.0, x[3] - x[1])
    union = area(a) + area(b) - inter
    return inter / union if union > 0 else 0.0


def average_precision(pred: list[tuple[float, list]], gold: list[list], threshold: float = 0.5) -> float:
    """Area under the precision envelope; predictions (score, box) take the best free gold box, best score first."""
    if not gold:
        return 0.0 if pred else 1.0
    free, hits = list(range(len(gold))), []
    for _, box in sorted(pred, key=lambda p: -p[0]):
        best = max(free, key=lambda j: iou(box, gold[j]), default=None)
        hit = best is not None and iou(box, gold[best]) >= threshold and iou(box, gold[best]) > 0
        if hit:
            free.remove(best)
        hits.append(hit)
    tp = np.cumsum(hits) if hits else np.array([])
    precision = tp / np.arange(1, len(tp) + 1)
    envelope = np.maximum.accumulate(precision[::-1])[::-1]
    recall = np.concatenate(([0.0], tp / len(gold)))
    return float(np.sum(np.diff(recall) * envelope)) if len(tp) else 0.0


def detection_scores(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """boxes (case_id, label, is_gold, score, box) to (case_id, label, ap); the mean over labels is a case's mAP."""

    def one(key, x: pd.DataFrame) -> pd.DataFrame:
        g = x[x["is_gold"]]
        p = x[~x["is_gold"]]
        ap = average_precision(list(zip(p["score"].fillna(0.0), p["box"])), list(g["box"]), threshold)
        return pd.DataFrame({"case_id": [key[0]], "label": [key[1]], "ap": [ap]})

    return boxes.groupBy("case_id", "label").applyInPandas(one, "case_id long, label string, ap double")


def kendall(order: list[int]) -> float:
    """Agreement of an order with the natural one, between 0 and 1; 1 for fewer than two."""
    n = len(order)
    if n < 2:
        return 1.0
    x = np.asarray(order)
    up = np.sign(x[None, :] - x[:, None])[np.triu_indices(n, 1)]
    total = np.count_nonzero(up)
    return float((up.sum() / total + 1) / 2) if total else 1.0


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of least total cost, one to one, by shortest augmenting paths."""
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, via, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            slack = c[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better] = slack[better]
            via[1:][better] = j0
            j1 = int(np.argmin(np.where(used[1:], np.inf, least[1:]))) + 1
            d = least[j1]
            u[owner[used]] += d
            v[used] -= d
            least[~used] -= d
            j0 = j1
            if not owner[j0]:
                break
        while j0:
            owner[j0] = owner[via[j0]]
            j0 = via[j0]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if turned else (a, b) for a, b in pairs)


def _far(a: str, b: str) -> float:
    a, b = " ".join(a.split()), " ".join(b.split())
    return edit_distance(a, b) / max(len(a), len(b)) if a or b else 0.0


def reading_order(pred: list[tuple[int, str]], gold: list[tuple[int, str]]) -> float:
    """Groups (order, text) matched by content: coverage times the mean of content and order agreement."""
    if not pred or not gold:
        return float(not pred and not gold)
    cost = np.array([[_far(p[1], g[1]) for g in gold] for p in pred])
    pairs = assign(cost)
    content = float(np.mean([1 - cost[i, j] for i, j in pairs]))
    by_pred = sorted(range(len(pairs)), key=lambda k: pred[pairs[k][0]][0])
    rank = {k: r for r, k in enumerate(sorted(range(len(pairs)), key=lambda k: gold[pairs[k][1]][0]))}
    return round(len(pairs) / max(len(pred), len(gold)) * (0.5 * content + 0.5 * kendall([rank[k] for k in by_pred])), 6)


def span_scores(spans: DataFrame, mode: str = "partial", beta: float = 2.0) -> DataFrame:
    """spans (case_id, kind, is_gold, start, stop, value, ord) to (kind, tp, fp, fn, precision, recall, f1, f2) over all cases.

    Predictions, in the order ``ord``, take the first free gold span of their kind: any ('type'), the same ('exact') or an
    overlapping one ('partial'); without offsets equal values match."""

    def fits(p, g) -> bool:
        if mode == "type":
            return True
        if any(pd.isna(x) for x in (p.start, p.stop, g.start, g.stop)):
            return " ".join((p.value or "").lower().split()) == " ".join((g.value or "").lower().split())
        return (p.start, p.stop) == (g.start, g.stop) if mode == "exact" else max(p.start, g.start) < min(p.stop, g.stop)

    def one(key, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("ord")
        free = list(x[x["is_gold"]].itertuples(index=False))
        n, tp = len(free), 0
        pred = list(x[~x["is_gold"]].itertuples(index=False))
        for p in pred:
            k = next((k for k, g in enumerate(free) if fits(p, g)), None)
            if k is not None:
                free.pop(k)
                tp += 1
        return pd.DataFrame({"kind": [key[1]], "tp": [tp], "fp": [len(pred) - tp], "fn": [n - tp]})

    c = spans.groupBy("case_id", "kind").applyInPandas(one, "kind string, tp long, fp long, fn long").groupBy("kind").agg(*[F.sum(n).alias(n) for n in ("tp", "fp", "fn")])
    p = F.when(F.col("tp") + F.col("fp") > 0, F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))).otherwise(F.when(F.col("fn") == 0, 1.0).otherwise(0.0))
    r = F.when(F.col("tp") + F.col("fn") > 0, F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))).otherwise(1.0)
    f = lambda b: F.coalesce(F.try_divide((1 + b * b) * F.col("precision") * F.col("recall"), b * b * F.col("precision") + F.col("recall")), F.lit(0.0))
    return c.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f(1.0)).withColumn("f2", f(beta))


# -- answers from contexts, in the JVM ----------------------------------------------------------------------------------------
def _types(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1)))


def coverage(target: Column, source: Column) -> Column:
    """Share of the target's distinct words that the source has; 1 for a target without words."""
    t = _types(target)
    return F.when(F.size(t) == 0, 1.0).otherwise(F.size(F.array_intersect(t, _types(source))) / F.greatest(F.size(t), F.lit(1)))


def word_f1(a: Column, b: Column) -> Column:
    """F1 of two multisets of words."""
    w = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1))
    x, y = w(a), w(b)
    count = lambda arr, v: F.size(F.filter(arr, lambda q: q == v))
    hit = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, v: s + F.least(count(x, v), count(y, v)))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(F.coalesce(F.try_divide(2 * hit, F.size(x) + F.size(y)), F.lit(0.0)).cast("double"))


def answer_scores(cases: DataFrame) -> DataFrame:
    """cases (case_id, question, answer, contexts, reference) with faithfulness, answer_relevancy, context_precision,
    context_recall, factual_correctness and their mean: word statistics, no model."""
    ctx = F.array_join("contexts", "\n")
    claims = F.filter(F.split(F.trim(F.coalesce("answer", F.lit(""))), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    faithful = F.when(F.size(claims) == 0, 1.0).otherwise(F.size(F.filter(claims, lambda c: coverage(c, ctx) >= 0.6)) / F.greatest(F.size(claims), F.lit(1)))
    target = F.coalesce(F.nullif("reference", F.lit("")), "answer")
    n = F.size(F.coalesce("contexts", F.array().cast("array<string>")))
    useful = F.when(n == 0, 0.0).otherwise(F.size(F.filter("contexts", lambda c: coverage(target, c) >= 0.3)) / F.greatest(n, F.lit(1)))
    out = cases.select(
        "case_id", faithful.alias("faithfulness"), word_f1(F.col("answer"), F.col("question")).alias("answer_relevancy"), useful.alias("context_precision"),
        coverage(F.col("reference"), ctx).alias("context_recall"), word_f1(F.col("answer"), F.col("reference")).alias("factual_correctness"),
    )
    names = out.columns[1:]
    return out.withColumn("score", sum((F.col(c) for c in names), F.lit(0.0)) / len(names))


# -- trees and formulas -------------------------------------------------------------------------------------------------------
def tree_distance(a: tuple, b: tuple, cost=lambda x, y: float(x != y)) -> float:
    """Edit distance of two ordered trees (label, [children]) by key roots; insertions and deletions cost 1."""

    def post(t: tuple) -> tuple[list, list[int]]:
        labels, left = [], []

        def walk(n: tuple) -> int:
            first = [walk(c) for c in n[1]]
            labels.append(n[0])
            left.append(first[0] if first else len(labels) - 1)
            return left[-1]

        walk(t)
        return labels, left

    (la, fa), (lb, fb) = post(a), post(b)
    roots = lambda f: sorted({x: i for i, x in enumerate(f)}.values())
    dist = np.zeros((len(la), len(lb)))
    for i in roots(fa):
        for j in roots(fb):
            n, m = i - fa[i] + 2, j - fb[j] + 2
            d = np.zeros((n, m))
            d[:, 0], d[0, :] = np.arange(n), np.arange(m)
            for x in range(1, n):
                for y in range(1, m):
                    p, q = fa[i] + x - 1, fb[j] + y - 1
                    gap = min(d[x - 1, y], d[x, y - 1]) + 1
                    if fa[p] == fa[i] and fb[q] == fb[j]:
                        d[x, y] = min(gap, d[x - 1, y - 1] + cost(la[p], lb[q]))
                        dist[p, q] = d[x, y]
                    else:
                        d[x, y] = min(gap, d[fa[p] - fa[i], fb[q] - fb[j]] + dist[p, q])
    return float(dist[-1, -1])


def table_similarity(pred: tuple, gold: tuple, structure_only: bool = False) -> float:
    """1 - distance / size of the larger of two table trees, whose labels are (tag, text); texts differ by their edit distance."""
    size = lambda t: 1 + sum(size(c) for c in t[1])

    def cost(x, y) -> float:
        return 1.0 if x[0] != y[0] else 0.0 if structure_only else _far(x[1], y[1])

    return 1 - tree_distance(pred, gold, cost) / max(size(pred), size(gold))


def formula_f1(pred: str, gold: str) -> float:
    """F1 of the multisets of LaTeX tokens."""
    cut = lambda s: Counter(re.findall(r"\\[A-Za-z]+|\\.|\d+(?:\.\d+)?|\S", s))
    p, g = cut(pred), cut(gold)
    if not p and not g:
        return 1.0
    return 2 * sum((p & g).values()) / (sum(p.values()) + sum(g.values()))


def grounding(cases: DataFrame) -> DataFrame:
    """cases (case_id, answer, source) to (case_id, claims, grounded, unsupported, faithfulness): a claim is grounded if the
    source has its words in a row or 0.9 of them, unsupported below a half."""
    claims = F.filter(F.split(F.trim(F.coalesce("answer", F.lit(""))), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    flat = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    src = flat(F.coalesce("source", F.lit("")))
    score = F.transform(claims, lambda c: F.when(F.contains(src, flat(c)), 1.0).otherwise(coverage(c, F.col("source"))))
    x = cases.select("case_id", score.alias("s"))
    n = F.size("s")
    return x.select("case_id", n.alias("claims"), F.size(F.filter("s", lambda v: v >= 0.9)).alias("grounded"), F.size(F.filter("s", lambda v: v < 0.5)).alias("unsupported"), F.coalesce(F.try_divide(F.aggregate("s", F.lit(0.0), lambda a, v: a + v), n), F.lit(1.0)).alias("faithfulness"))


def longest_common(a: str | None, b: str | None) -> int:
    """Length of the longest piece that two texts share, by a row of run lengths."""
    if not a or not b:
        return 0
    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    if len(x) > len(y):
        x, y = y, x
    run, best = np.zeros(len(y) + 1, np.int64), 0
    for c in x:
        new = np.zeros_like(run)
        new[1:] = np.where(y == c, run[:-1] + 1, 0)
        best, run = max(best, int(new.max())), new
    return best


def score_cases(cases: DataFrame, scorers: dict[str, object]) -> DataFrame:
    """(case_id, family, metric, value, error): cases (case_id, family, pred, gold) scored by the scorer of their family, one function from
    (pred, gold) to {metric: value} each. A case that its scorer can't take has its error and no value; unknown families have theirs too."""

    def run(batches):
        for b in batches:
            rows = []
            for i, f, p, g in zip(b["case_id"], b["family"], b["pred"], b["gold"]):
                try:
                    rows += [(i, f, m, float(v), None) for m, v in scorers[f](p, g).items()]
                except Exception as e:  # noqa: BLE001  one case must not end the others
                    rows.append((i, f, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["case_id", "family", "metric", "value", "error"])

    d = cases.select("case_id", "family", "pred", "gold")
    return d.mapInPandas(run, f"case_id {dict(d.dtypes)['case_id']}, family string, metric string, value double, error string")
