import random

import pytest

from siltstone.operators.hierarchy import descendants, descendants_of_all, hierarchy, valid_rows


def brute(parent):
    out = {}
    for i in parent:
        path, x = [], i
        while x is not None and x not in path:
            path.append(x)
            x = parent.get(x)
            x = x if x in parent else None
        if x is None:
            out[i] = (path[-1], len(path) - 1, path[::-1])
        else:
            out[i] = (min(path[path.index(x) :]), -1, None)
    return out


def nodes(spark, parent):
    return spark.createDataFrame([(i, p, f"n{i}") for i, p in parent.items()], "id long, parent long, name string")


def check(spark, parent, **kw):
    got = {r["id"]: (r["root"], r["depth"], r["path_ids"]) for r in hierarchy(nodes(spark, parent), **kw).collect()}
    assert got == brute(parent)


TREE = {1: None, 2: 1, 3: 1, 4: 2, 5: 4, 6: 99, 7: 6, 10: 11, 11: 12, 12: 10, 13: 12, 14: 13, 20: 20, 21: 20, 30: 31, 31: 30}


@pytest.mark.parametrize("finish", [1000, 4, 0])
def test_trees_and_circles(spark, finish):
    check(spark, TREE, finish_rows=finish)


def test_random_forest(spark):
    rng = random.Random(3)
    check(spark, {i: rng.choice([None, i - 1, i - 1, rng.randrange(0, 80), 500]) for i in range(60)}, finish_rows=5)


def test_deep_chain_needs_few_rounds(spark):
    check(spark, {i: i - 1 if i else None for i in range(150)}, finish_rows=40)


def test_subtree_sizes_and_descendants(spark):
    t = hierarchy(nodes(spark, TREE))
    size = {r["id"]: r["subtree"] for r in t.collect()}
    assert (size[1], size[2], size[4], size[5], size[13], size[10]) == (5, 3, 2, 1, 2, None)
    d = {(r["ancestor"], r["descendant"]): r["distance"] for r in descendants(t).collect()}
    assert d[(1, 5)] == 3 and d[(2, 2)] == 0 and (10, 13) not in d


def test_valid_rows(spark):
    rows = [(1, None, "a", 1), (1, 2, "b", 2), (2, None, "c", None), (2, None, "c", None), (None, 1, "x", 3), (3, 1, None, 5)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "node long, up long, title string, at long, id int, NODE int")
    got = {r["id"]: (r["parent"], r["name"]) for r in valid_rows(df, "node", "up", "title", "at").collect()}
    assert got == {1: (2, "b"), 2: (None, "c"), 3: (1, None)}


def test_wide_parent_and_empty(spark):
    check(spark, {0: None} | {i: 0 for i in range(1, 400)}, finish_rows=50)
    assert hierarchy(nodes(spark, {1: None}).where("id > 5")).count() == 0


@pytest.mark.parametrize("finish", [1000, 4])
def test_descendants_on_and_below_circles(spark, finish):
    parent = TREE | {40: 41, 41: 42, 42: 43, 43: 40, 44: 42, 45: 44, 46: 44, 22: 21}
    want = set()
    for i in parent:
        x, n, seen = i, 0, set()
        while x in parent and x not in seen:
            seen.add(x)
            want.add((x, i, n))
            x, n = parent[x], n + 1
    got = [tuple(r) for r in descendants_of_all(nodes(spark, parent), finish_rows=finish).select("ancestor", "descendant", "distance").collect()]
    assert sorted(got) == sorted(want)
