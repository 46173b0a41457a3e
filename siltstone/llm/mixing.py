"""Mixing sources to target weights.

Documents are measured in tokens of a public tokenizer and summed by membership pattern, the set of target sources a
document belongs to. Patterns and sources form a small network: a pattern offers its tokens once per repetition, each
repetition at a higher cost, and every source takes up to its quota, its share of the size of all documents. A min-cost
flow through it fills the quotas with as few repetitions as possible; what a source can't get, it falls short of.
Documents are then selected by a seeded hash: per pattern the sources' allocations lie end to end around the circle of
its documents in hash order, so repetitions of two documents of a pattern differ by one at most, and no source gets a
document more often than it allows.

Only sums per pattern reach the driver, ``max_patterns`` at most (checked). Cumulative sizes are built in two levels, over hash
buckets and within them, so no source, however large, is ordered in one task.

Defined results: sources are compared in lower case without outer blanks; null or unlisted sources belong to no target
but count for the size of all documents; null and empty texts have no tokens and are never selected; rows without an id are left out; repeated
ids are documents of their own; repeated targets add their shares and allow the larger number of repetitions; null
shares are 0 and null repetitions 1; shares need not add up to one; empty documents give empty results, with all quotas 0.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.session import materialize, pick, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's authors cut text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 4096


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens). ``vocabulary`` is a file of ranks that every executor can read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding(os.path.basename(vocabulary), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]})

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("tokens", T.LongType())])
    clean = F.nullif(F.lower(F.trim("source")), F.lit(""))
    return spread(pick(documents, "doc_id", "source", "text").where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), clean.alias("source"), "text"), "doc_id").mapInPandas(run, schema)


def clean_targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """source: (share, most repetitions)."""
    rows = (
        pick(targets, "source", "target_share", "max_repeats").where("source is not null").groupBy(F.lower(F.trim("source")).alias("source"))
        .agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("most"))
    )
    return {r["source"]: (float(r["share"]), int(r["most"])) for r in rows.collect()}


def min_cost_flow(arcs: list[tuple[int, int, int, int]], source: int, sink: int, n: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost >= 0): the largest flow, and of those the cheapest. Successive shortest
    paths with potentials."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, cap, cost = [], [], []
    for u, v, c, w in arcs:
        graph[u].append(len(to))
        to.append(v), cap.append(c), cost.append(w)
        graph[v].append(len(to))
        to.append(u), cap.append(0), cost.append(-w)
    pot = [0] * n
    while True:
        dist, via = [None] * n, [-1] * n
        dist[source] = 0
        heap = [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for e in graph[u]:
                if cap[e] > 0:
                    x = d + cost[e] + pot[u] - pot[to[e]]
                    if dist[to[e]] is None or x < dist[to[e]]:
                        dist[to[e]], via[to[e]] = x, e
                        heapq.heappush(heap, (x, to[e]))
        if dist[sink] is None:
            break
        for v in range(n):
            if dist[v] is not None:
                pot[v] += dist[v]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        step = min(cap[e] for e in path)
        for e in path:
            cap[e] -= step
            cap[e ^ 1] += step
    return [cap[2 * i + 1] for i in range(len(arcs))]


def plan(sizes: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int) -> tuple[dict, dict]:
    """({(pattern, source): tokens}, {source: quota}) by the flow. Quotas are whole tokens, rounded up."""
    quota = {s: -int(-(share * total) // 1) for s, (share, _) in targets.items()}
    patterns, sources = sorted(sizes), sorted(targets)
    pat = {p: 1 + i for i, p in enumerate(patterns)}
    src = {s: 1 + len(patterns) + i for i, s in enumerate(sources)}
    sink = 1 + len(patterns) + len(sources)
    arcs, names = [], []
    for p in patterns:
        most = max((targets[s][1] for s in p), default=0)
        for r in range(most):  # convex: the next repetition costs more
            arcs.append((0, pat[p], sizes[p], r))
            names.append(None)
        for s in p:
            arcs.append((pat[p], src[s], sizes[p] * targets[s][1], 0))
            names.append((p, s))
    for s in sources:
        arcs.append((src[s], sink, quota[s], 0))
        names.append(None)
    flow = min_cost_flow(arcs, 0, sink, sink + 1)
    return {k: f for k, f in zip(names, flow) if k and f}, quota


class Mix:
    """A mix of ``documents`` (doc_id, source, text) by ``targets`` (source, target_share, max_repeats). ``memberships``
    (doc_id, source) gives documents further sources."""

    def __init__(self, documents: DataFrame, targets: DataFrame, memberships: DataFrame | None = None, seed: int = 0, vocabulary: str = VOCABULARY, max_patterns: int = 100_000):
        self.spark, self.seed = documents.sparkSession, seed
        self.targets = clean_targets(targets)
        listed = self.spark.createDataFrame([(s,) for s in self.targets] or [("",)], "source string")
        counts = token_counts(documents, vocabulary)
        own = counts.join(F.broadcast(listed.withColumn("listed", F.lit(True))), "source", "left")  # as many rows as targets
        self.documents = own.select("doc_id", "tokens", F.when(F.col("listed"), F.array("source")).otherwise(F.array().cast("array<string>")).alias("pattern"))
        if memberships is not None:
            more = pick(memberships, "doc_id", "source").select("doc_id", F.lower(F.trim("source")).alias("source")).join(F.broadcast(listed), "source").groupBy("doc_id").agg(F.collect_set("source").alias("more"))
            self.documents = self.documents.join(more, "doc_id", "left").select("doc_id", "tokens", F.array_sort(F.array_distinct(F.concat("pattern", F.coalesce("more", F.array().cast("array<string>"))))).alias("pattern"))
        self.documents = materialize(self.documents, "mix")
        sums = self.documents.groupBy("pattern").agg(F.sum("tokens").alias("tokens"))
        rows = sums.limit(max_patterns + 1).collect()
        if len(rows) > max_patterns:
            raise ValueError(f"more than {max_patterns} membership patterns")
        self.total = sum(r["tokens"] for r in rows)
        self.sizes = {tuple(r["pattern"]): int(r["tokens"]) for r in rows if r["pattern"]}
        self.flow, self.quota = plan(self.sizes, self.targets, self.total)

    def shortfalls(self) -> DataFrame:
        """(source, quota, reachable): sources that get less than their quota though every document is used as often as allowed."""
        got = {s: sum(f for (_, t), f in self.flow.items() if t == s) for s in self.targets}
        return self.spark.createDataFrame([(s, self.quota[s], got[s]) for s in sorted(got) if got[s] < self.quota[s]], "source string, quota long, reachable long")

    def selection(self) -> DataFrame:
        """(doc_id, source, tokens, copies): how often each document goes into the mix, and for which source."""
        arcs = []
        for p, size in self.sizes.items():
            at = 0
            for s in p:
                f = self.flow.get((p, s), 0)
                if f and size:
                    arcs.append((list(p), s, at, at + f, size))
                    at += f
        spans = self.spark.createDataFrame(arcs, "pattern array<string>, source string, lo long, hi long, size long")
        d = self.documents.where((F.size("pattern") > 0) & (F.col("tokens") > 0)).withColumn("h", F.xxhash64("doc_id", F.lit(self.seed)))
        d = d.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(BUCKETS)).cast("int"))
        by = d.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("t"))  # patterns x 4096 rows at most
        before = by.withColumn("base", F.sum("t").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("pattern", "bucket", F.coalesce("base", F.lit(0)).alias("base"))
        w = Window.partitionBy("pattern", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        d = d.withColumn("here", F.coalesce(F.sum("tokens").over(w), F.lit(0))).join(before, ["pattern", "bucket"])
        # a document's middle, once per round of the circle: it is taken by the source in whose allocation it falls
        mid = F.col("base") + F.col("here") + F.floor(F.col("tokens") / 2)
        x = d.join(F.broadcast(spans), "pattern").withColumn("mid", mid)
        rounds = lambda edge: F.ceil((F.col(edge) - F.col("mid")) / F.col("size"))  # noqa: E731  rounds whose middle lies below the edge
        x = x.withColumn("copies", (F.greatest(F.lit(0), rounds("hi")) - F.greatest(F.lit(0), rounds("lo"))).cast("int"))
        most = self.spark.createDataFrame([(s, m) for s, (_, m) in self.targets.items()] or [("", 0)], "source string, most int")
        x = x.join(F.broadcast(most), "source").withColumn("copies", F.least("copies", "most"))
        return x.where("copies > 0").select("doc_id", "source", "tokens", "copies")

    def shares(self) -> DataFrame:
        """(source, target_share, reached_tokens, reached_share): what the selection reaches, of the size of all documents."""
        want = self.spark.createDataFrame([(s, sh) for s, (sh, _) in sorted(self.targets.items())] or [("", 0.0)], "source string, target_share double")
        got = self.selection().groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t"))
        reached = F.coalesce("t", F.lit(0))
        return want.join(got, "source", "left").select("source", "target_share", reached.alias("reached_tokens"), (reached / F.lit(float(max(1, self.total)))).alias("reached_share"))
