import itertools
import os
import random

import pytest

from siltstone.llm.mixing import VOCABULARY, Mix, min_cost_flow, plan

needs = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


def test_flow_against_brute_force():
    rng = random.Random(2)
    for _ in range(30):
        arcs = [(0, 1, rng.randrange(4), 0), (0, 2, rng.randrange(4), 0), (0, 1, rng.randrange(3), 2), (1, 3, rng.randrange(4), 1), (2, 3, rng.randrange(4), 0), (1, 2, rng.randrange(3), 0), (3, 4, rng.randrange(6), 0)]
        best = max(
            (sum(f[i] for i in (0, 1, 2)), -sum(x * a[3] for x, a in zip(f, arcs)))
            for f in itertools.product(*[range(a[2] + 1) for a in arcs])
            if all(sum(x for x, a in zip(f, arcs) if a[1] == v) == sum(x for x, a in zip(f, arcs) if a[0] == v) for v in (1, 2, 3))
        )
        got = min_cost_flow(arcs, 0, 4, 5)
        assert (sum(got[i] for i in (0, 1, 2)), -sum(x * a[3] for x, a in zip(got, arcs))) == best


def test_plan_shares_overlapping_sources():
    flow, quota = plan({("a",): 10, ("a", "b"): 10, ("c",): 100}, {"a": (0.1, 1), "b": (0.1, 2), "c": (0.5, 1), "d": (0.2, 9)}, 120)
    assert quota == {"a": 12, "b": 12, "c": 60, "d": 24}
    assert flow[(("c",), "c")] == 60
    assert flow[(("a",), "a")] + flow.get((("a", "b"), "a"), 0) == 12 and flow[(("a", "b"), "b")] == 12


@needs
def test_mix(spark):
    rng = random.Random(1)
    docs = [(i, f"{'word ' * rng.randrange(5, 60)}", "Big " if i % 2 else "big", 1) for i in range(400)] + [(1000 + i, "some text here " * 10, "small", 1) for i in range(5)]
    docs += [(2000, None, "small", 1), (2001, "", "big", 1), (2002, "unlisted " * 50, "other", 1), (2003, "null source " * 20, None, 1), (2003, "null source " * 20, None, 1), (None, "x", "big", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens int")
    t = spark.createDataFrame([("BIG", 0.5, 2), ("small ", 0.4, 3), ("absent", 0.1, 5), (None, 0.3, 1), ("small", None, None)], "source string, target_share double, max_repeats int")
    m = Mix(d, t)
    assert {r["source"] for r in m.shortfalls().collect()} == {"small", "absent"}
    sel = m.selection().collect()
    assert all(r["copies"] <= {"big": 2, "small": 3}[r["source"]] for r in sel)
    assert {r["doc_id"]: r["copies"] for r in sel if r["source"] == "small"} == {1000 + i: 3 for i in range(5)}
    share = {r["source"]: r["reached_share"] for r in m.shares().collect()}
    assert abs(share["big"] - 0.5) < 0.01 and share["absent"] == 0
    again = {(r["doc_id"], r["copies"]) for r in Mix(d, t).selection().collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in sel}


@needs
def test_memberships_and_empty(spark):
    d = spark.createDataFrame([(i, "word " * 20, "a") for i in range(40)], "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    m = Mix(d, t, memberships=spark.createDataFrame([(i, "B ") for i in range(20, 40)], "doc_id long, source string"))
    assert m.shortfalls().count() == 0
    got = {r["source"]: r["reached_share"] for r in m.shares().collect()}
    assert abs(got["a"] - 0.5) < 0.05 and abs(got["b"] - 0.5) < 0.05
    e = Mix(d.limit(0), t)
    assert e.selection().count() == 0 and e.shortfalls().count() == 0
    assert Mix(d, t.limit(0)).selection().count() == 0
