"""Parent-child links to full hierarchies: path, depth, root, subtree size and descendants of every node, and cycles.

Bottom-up peeling: leaves are taken off round by round and hand their subtree sizes to their parents; what is never
peeled lies on circles. Reverse peel order assigns depth, root and path. A chain would need as many rounds as it has
nodes, so a round also takes out nodes with a single child that is no leaf (of neighbours only one, by a coin per node and round), whose
child then points past them and carries their ids; the number of rounds grows with the logarithm of the number of nodes.
Each round is written to the shared folder, which cuts the lineage. The last ``finish_rows`` nodes (two thousand; counted, so the bound is
proven) are peeled by one task in memory, as further rounds would cost more than they hold.

Defined results: repeated nodes: the row with the latest ``order`` value holds (ties: the larger parent); a null id is no
node; a null parent, or one without a row, makes a root with depth 0; a node on a circle or below one has depth -1, the
smallest id of the circle as root and no path, and on the circle no subtree size; a node that is its own parent is a circle of one; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import discard, materialize, pick, salted_join

TREE = "id long, root long, depth int, subtree long, path_ids array<long>, path_names array<string>"


def valid_rows(df: DataFrame, node: str, parent: str, name: str, order: str) -> DataFrame:
    """(id, parent, name) by the row of each node that was updated last; of equal times the larger parent and name."""
    df = pick(df, node, parent, name, order)
    row = F.struct(F.col(parent).cast("long").alias("parent"), F.col(name).alias("name"))
    key = F.struct(F.col(order), F.col(parent), F.col(name))
    return df.where(F.col(node).isNotNull()).groupBy(F.col(node).cast("long").alias("id")).agg(F.max_by(row, key).alias("r")).select("id", "r.parent", "r.name")


def links(nodes: DataFrame) -> DataFrame:
    """(id, name, up): up is null where the parent is null or has no row."""
    # only nodes that are a parent are looked up, so little is repeated for the salts
    parents = nodes.where("parent is not null").select("parent").distinct()
    known = parents.join(nodes.select(F.col("id").alias("parent")), "parent", "left_semi").withColumn("known", F.lit(True))
    return salted_join(nodes, known, "parent", "id").select("id", "name", F.when(F.col("known"), F.col("parent")).alias("up"))


def peel_in_memory(ids: np.ndarray, up: np.ndarray, hops: np.ndarray, acc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Peels leaves by rounds. up: positions, -1 for a root. Returns (order by peeling, depth, root position, subtree size).

    Nodes of a circle aren't in the order; they have depth -1 and the position of the smallest id of the circle."""
    n = len(ids)
    size, kids = acc.copy(), np.bincount(up[up >= 0], minlength=n)
    rounds, leaves = [], np.flatnonzero(kids == 0)
    while len(leaves):
        rounds.append(leaves)
        p = up[leaves]
        has = p >= 0
        np.add.at(size, p[has], size[leaves[has]])
        np.subtract.at(kids, p[has], 1)
        p = np.unique(p[has])
        leaves = p[kids[p] == 0]
    peeled = np.zeros(n, bool)
    for r in rounds:
        peeled[r] = True
    depth, root = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    seen = peeled.copy()
    for start in np.flatnonzero(~peeled):
        if not seen[start]:
            circle, x = [], start
            while not seen[x]:
                seen[x] = True
                circle.append(x)
                x = up[x]
            root[circle] = min(circle, key=lambda i: ids[i])
    order = np.concatenate(rounds[::-1]) if rounds else np.array([], np.int64)
    for r in reversed(rounds):
        p = up[r]
        top = p < 0
        root[r] = np.where(top, r, root[p])
        depth[r] = np.where(top, 0, np.where(depth[p] < 0, -1, depth[p] + hops[r]))
    return order, depth, root, size


def _finish(batches: Iterator[pd.DataFrame], paths: bool) -> Iterator[pd.DataFrame]:
    parts = list(batches)  # at most finish_rows rows
    df = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["id", "name", "up", "skip", "skip_names", "acc", "low"])
    if df.empty:
        return
    ids = df["id"].to_numpy(np.int64)
    at = pd.Series(np.arange(len(ids)), index=ids)
    up = df["up"].map(at).fillna(-1).to_numpy(np.int64)
    skips, names, skip_names = df["skip"].tolist(), df["name"].tolist(), df["skip_names"].tolist()
    hops = np.array([len(s) + 1 for s in skips], np.int64)
    _, depth, root, size = peel_in_memory(ids, up, hops, df["acc"].to_numpy(np.int64))
    # nodes that were taken out of a circle before have left their smallest id behind
    low = np.minimum(ids, df["low"].to_numpy(np.int64))
    circle_low = pd.Series(low).groupby(root).min()
    roots = np.where(depth < 0, 0, ids[root])
    # depth -1 covers nodes below a circle too, whose own ids do not count
    on = np.zeros(len(ids), bool)
    for s in np.unique(root[depth < 0]):
        x = s
        while not on[x]:
            on[x] = True
            x = up[x]
    if on.any():
        circle_low = pd.Series(low[on]).groupby(root[on]).min()
        roots = np.where(depth < 0, pd.Series(root).map(circle_low).fillna(0).to_numpy(np.int64), roots)
    kids: dict[int, list[int]] = {}
    if paths:
        for i in np.flatnonzero((up >= 0) & (depth >= 0)).tolist():
            kids.setdefault(int(up[i]), []).append(i)
    rows: list[tuple] = [(int(ids[i]), int(roots[i]), -1, None if on[i] else int(size[i]), None, None) for i in np.flatnonzero(depth < 0)]
    if not paths:
        rows += [(int(ids[i]), int(roots[i]), int(depth[i]), int(size[i]), None, None) for i in np.flatnonzero(depth >= 0)]
    cols = ["id", "root", "depth", "subtree", "path_ids", "path_names"]
    todo = [(int(i), [], []) for i in np.flatnonzero((up < 0) & (depth >= 0))] if paths else []
    while todo or rows:
        if len(rows) >= 5_000 or not todo:
            yield pd.DataFrame(rows, columns=cols, dtype=object)
            rows = []
            continue
        i, p, q = todo.pop()
        p, q = [*p, *skips[i], int(ids[i])], [*q, *skip_names[i], names[i]]
        rows.append((int(ids[i]), int(roots[i]), int(depth[i]), int(size[i]), p, q))
        todo += [(k, p, q) for k in kids.get(i, ())]


def hierarchy(nodes: DataFrame, paths: bool = True, finish_rows: int = 2_000) -> DataFrame:
    """(id, root, depth, subtree, path_ids, path_names) of every node of ``nodes`` (id, parent, name).

    ``path_ids`` runs from the root to the node itself; with ``paths=False`` both paths are null and less is moved."""
    name = F.col("name") if paths else F.lit(None).cast("string").alias("name")
    active = materialize(
        links(nodes).select("id", name, "up", F.array().cast("array<long>").alias("skip"), F.array().cast("array<string>").alias("skip_names"), F.lit(1).cast("long").alias("acc"), F.col("id").alias("low")),
        "links",
    )
    removed: list[DataFrame] = []
    written = [active]  # of no use once the result is written
    rings = False
    while not rings and active.count() > finish_rows:
        r = len(removed)
        coin = lambda c: F.pmod(F.xxhash64(c, F.lit(r)), F.lit(2)) == 1
        # partial aggregation: a parent with a third of all nodes as children is no hot key here
        inner = active.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.count("*").alias("kids"), F.min("id").alias("child"))
        a = active.join(inner, "id", "left")
        # is the only child a leaf itself?
        above = a.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.max(F.col("kids").isNotNull()).alias("deep"))
        a = a.join(above, "id", "left")
        ring = F.coalesce((F.col("kids") == 1) & ((F.col("up") == F.col("child")) | (F.col("up") == F.col("id"))), F.lit(False))  # a circle of two or one stays
        single = F.coalesce((F.col("kids") == 1) & F.col("up").isNotNull() & F.col("deep") & ~ring & coin("id") & ~coin("up"), F.lit(False))
        # no node's parent goes in the same round: a parent of leaves has a leaf as child, and of neighbours the coin takes one
        how = F.when(F.col("kids").isNull(), 0).when(single, 1)
        log = materialize(a.withColumn("how", how).withColumn("ring", ring).drop("deep"), "peel")
        written.append(log)
        out = log.where("how is not null")
        removed.append(out)
        bent = F.col("how") == 1
        give = out.where("up is not null").select(F.col("up").alias("id"), F.col("acc").alias("give"), F.lit(None).cast("long").alias("to"), F.lit(None).cast("array<long>").alias("ins"), F.lit(None).cast("array<string>").alias("ins_names"), F.lit(None).cast("long").alias("in_low"))
        bend = out.where(bent).select(
            F.col("child").alias("id"), F.lit(None).cast("long").alias("give"), F.col("up").alias("to"),
            F.concat("skip", F.array("id")).alias("ins"), F.concat("skip_names", F.array("name")).alias("ins_names"), F.col("low").alias("in_low"),
        )
        news = give.unionByName(bend).groupBy("id").agg(F.sum("give").alias("give"), F.max("to").alias("to"), F.max("ins").alias("ins"), F.max("ins_names").alias("ins_names"), F.min("in_low").alias("in_low"))
        rest = log.where("how is null")
        rings = rest.where(~F.col("ring")).isEmpty()
        active = materialize(
            rest.drop("how", "kids", "child", "ring").join(news, "id", "left").select(
                "id", "name", F.coalesce("to", "up").alias("up"),
                F.when(F.col("ins").isNotNull(), F.concat("ins", "skip")).otherwise(F.col("skip")).alias("skip"),
                F.when(F.col("ins_names").isNotNull(), F.concat("ins_names", "skip_names")).otherwise(F.col("skip_names")).alias("skip_names"),
                (F.col("acc") + F.coalesce("give", F.lit(0))).alias("acc"), F.least("low", "in_low").alias("low"),
            ), "links",
        )
        written.append(active)
    if rings and active.count() > finish_rows:  # nothing but circles of one or two: each knows its other half
        other = active.select(F.col("id").alias("up"), F.col("low").alias("low2"))
        done = active.join(other, "up", "left").select("id", F.least("low", "low2").alias("root"), F.lit(-1).alias("depth"), F.lit(None).cast("long").alias("subtree"), F.lit(None).cast("array<long>").alias("path_ids"), F.lit(None).cast("array<string>").alias("path_names"))
    else:
        done = active.coalesce(1).mapInPandas(lambda it: _finish(it, paths), TREE)  # at most finish_rows rows
    if not removed:
        return done
    done = materialize(done, "done")
    for out in reversed(removed):
        above = done.select(F.col("id").alias("up"), F.col("root").alias("r"), F.col("depth").alias("d"), F.col("path_ids").alias("pi"), F.col("path_names").alias("pn"))
        below = done.select(F.col("id").alias("child"), F.col("subtree").alias("s"))
        # a removed leaf has all of its subtree in acc; a node between two others has that of its child besides
        needed = above.join(out.select("up").distinct(), "up", "left_semi")
        here = salted_join(out, needed, "up", "id").join(below, "child", "left")
        cut = F.coalesce(F.col("d") < 0, F.lit(False))
        here = here.select(
            "id", F.coalesce("r", "id").alias("root"),
            F.when(F.col("up").isNull(), F.lit(0)).when(cut, F.lit(-1)).otherwise(F.col("d") + F.size("skip") + 1).cast("int").alias("depth"),
            F.when(F.col("how") == 1, F.col("acc") + F.col("s")).otherwise(F.col("acc")).alias("subtree"),
            *[
                (F.when(~cut, F.concat(F.coalesce(above_col, F.array().cast(kind)), skip, F.array(own))) if paths else F.lit(None).cast(kind)).alias(to)
                for above_col, skip, own, kind, to in (("pi", "skip", "id", "array<long>", "path_ids"), ("pn", "skip_names", "name", "array<string>", "path_names"))
            ],
        )
        before, done = done, materialize(done.unionByName(here), "done")
        discard(before)
    discard(*written)
    return done


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance): the descendant lists as rows, every node being its own at distance 0."""
    at = F.posexplode("path_ids").alias("at", "ancestor")
    return tree.where("path_ids is not null").select(F.col("id").alias("descendant"), "depth", at).select("ancestor", "descendant", (F.col("depth") - F.col("at")).cast("int").alias("distance"))


def descendants_of_all(nodes: DataFrame, finish_rows: int = 2_000) -> DataFrame:
    """(ancestor, descendant, distance) of every node of ``nodes`` (id, parent, name), those on and below circles too.

    A circle is cut above its smallest id, which makes a tree of it and of all below it. What a node has above it in that
    tree is one part of its ancestors; the other is what follows on the circle behind the cut. A node on a circle has all
    others of the circle as descendants, at the distance of the way along the links, and is its own at distance 0 only."""
    nodes = materialize(nodes, "nodes")
    tree = materialize(hierarchy(nodes, finish_rows=finish_rows).drop("path_names"), "tree")
    loose = tree.where("depth < 0").select("id", F.col("root").alias("low"), F.col("subtree").isNull().alias("ring"))
    cut = nodes.join(loose.select("id", "low"), "id").select("id", F.when(F.col("id") != F.col("low"), F.col("parent")).alias("parent"), "name")
    below = materialize(descendants(hierarchy(cut, finish_rows=finish_rows)), "below")
    ring = loose.where("ring").select(F.col("id").alias("ancestor"), "low")
    # the place of each on its circle: its distance from the cut
    at = below.join(ring.select(F.col("low").alias("ancestor")).distinct(), "ancestor", "left_semi").select(F.col("descendant").alias("ancestor"), F.col("distance").alias("at"))
    at = materialize(ring.join(at, "ancestor"), "ring")
    length = at.groupBy("low").agg((F.max("at") + 1).alias("length"))
    # where each node comes to the circle: the last place of it on its way down from the cut
    entry = below.join(at, "ancestor").groupBy("low", "descendant").agg(F.max("at").alias("entry"), F.min("distance").alias("hops"))
    behind = salted_join(entry, at.join(length, "low"), "low", "descendant", "inner").where("at > entry")
    behind = behind.select("ancestor", "descendant", (F.col("hops") + F.col("entry") - F.col("at") + F.col("length")).cast("int").alias("distance"))
    return descendants(tree).unionByName(below).unionByName(behind)
