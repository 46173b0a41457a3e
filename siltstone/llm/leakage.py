"""Evaluation texts leaking into training text.

The corpus is cut into shards of whole documents, and each shard gets an FM-index over all of its words: suffixes sorted by prefix
doubling, the Burrows-Wheeler transform in a wavelet matrix for ranks, and the suffix array sampled every ``SAMPLE`` text
positions. ``build_index`` writes the shards as a table, once; any test set is searched against it afterwards without reading
the corpus. All phrases of ``PHRASE`` words of the evaluation items are searched backwards at once, located by stepping to
a sampled position, and merged to spans along the items: a span goes on over small edits, and counts from ``SPAN`` words on, or from
the wanted share of an item so short that this is less. A document carries an item if spans cover at least half of the item's words.

Documents are whole in one shard, so neither building nor searching shuffles anything but the spreading of documents. Items are
broadcast in blocks of ``item_words`` words; a larger test set takes more passes over the index, not more memory.

Defined results: null and empty documents or items give nothing; an item of fewer than ``PHRASE`` words is carried where all of it
stands in one place; repeated documents and repeated items each get their own rows; rows without an id are left out; case, markup,
punctuation, soft hyphens, line breaks and quotation marks of lines don't matter.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import materialize, pick, spread

PHRASE = 4  # words of a searched phrase
SPAN = 6  # least words of a span: stock phrases that unrelated texts share are shorter
GAP, DRIFT = 4, 3  # words that an edit inside a span may replace, and by which it may shift the rest
SAMPLE = 8
SHARD = 400_000  # symbols, or one document if that is longer

TOKEN = re.compile(r"<[^<>\n]{1,60}>|&#?\w{2,8};|[^\W_]+(?:[­​⁠]+[^\W_]+|['’][^\W_]+|-[ \t]*\r?\n[ \t>#*|/-]*[^\W_]+)*")
INVISIBLE = re.compile(r"[­​⁠﻿]")


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The words in lower case without markup, and where they stand in the text."""
    words, at = [], []
    for m in TOKEN.finditer(text):
        w = m.group()
        if w[0] in "<&":
            continue
        if not w.isascii():
            w = unicodedata.normalize("NFKC", INVISIBLE.sub("", w)).replace("’", "'")
        if "\n" in w:
            w = re.sub(r"-\s[^\w]*", "", w)
        words.append(w.lower())
        at.append(m.span())
    return words, at


class FMIndex:
    """FM-index of an array of symbols >= 1; searches many patterns at once."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        t = np.append(text.astype(np.int64), 0)  # 0 ends the text and occurs nowhere else
        sa = self._suffixes(t)
        marked = sa % sample == 0
        self._ready(len(t), int(t.max()) + 1, self._planes(t[sa - 1], int(t.max()).bit_length()), marked, sa[marked])

    @staticmethod
    def _planes(bwt: np.ndarray, levels: int) -> list[np.ndarray]:
        """The bits of the wavelet matrix, the highest first."""
        out, cur = [], bwt
        for bit in range(max(1, levels) - 1, -1, -1):
            b = ((cur >> bit) & 1).astype(np.uint8)
            out.append(b)
            cur = np.concatenate((cur[b == 0], cur[b == 1]))
        return out

    def _ready(self, n: int, sigma: int, planes: list[np.ndarray], marked: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.sigma, self.levels, self.planes = n, sigma, len(planes), planes
        self.ones = [np.concatenate(([0], np.cumsum(b, dtype=np.int64))).astype(np.int32) for b in planes]
        self.zeros = [n - int(o[-1]) for o in self.ones]
        self.marked, self.samples = marked, samples.astype(np.int64)
        self.mark_rank = np.concatenate(([0], np.cumsum(marked)))
        every = np.arange(sigma)
        self.first = np.concatenate(([0], np.cumsum(self.rank(every, np.full(sigma, n, np.int64)))))

    def pack(self) -> dict:
        """What an index is stored as; the counts are made again when it is read."""
        return {"n": self.n, "sigma": self.sigma, "planes": [np.packbits(b).tobytes() for b in self.planes], "marked": np.packbits(self.marked).tobytes(), "samples": self.samples.astype(np.int32).tobytes()}

    @classmethod
    def unpack(cls, row) -> FMIndex:
        out, n = cls.__new__(cls), int(row["n"])
        bits = lambda x: np.unpackbits(np.frombuffer(x, np.uint8), count=n)
        out._ready(n, int(row["sigma"]), [bits(x) for x in row["planes"]], bits(row["marked"]).astype(bool), np.frombuffer(row["samples"], np.int32))
        return out

    @staticmethod
    def _suffixes(t: np.ndarray) -> np.ndarray:
        """The suffix array: first by as many symbols as fit one key, then by doubling, for the suffixes that are still equal only."""
        n, bits = len(t), max(1, int(t.max()).bit_length())
        k = max(1, 62 // bits)
        key = np.zeros(n, np.int64)
        for j in range(k):
            key <<= bits
            if j < n:
                key[: n - j] |= t[j:]
        sa = np.argsort(key, kind="stable")
        s = key[sa]
        rank = np.empty(n, np.int64)

        def settle(rows: np.ndarray, new: np.ndarray) -> np.ndarray:
            """Ranks of the suffixes in these rows by the first row of their group; returns the rows of groups that aren't single."""
            start = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
            rank[sa[rows]] = rows[start]
            single = new & np.append(new[1:], True)
            return rows[~single]

        rows = settle(np.arange(n), np.concatenate(([True], s[1:] != s[:-1])))
        while len(rows):
            at = sa[rows]
            one, two = rank[at], np.where(at + k < n, rank[np.minimum(at + k, n - 1)], -1)
            order = np.lexsort((two, one))
            sa[rows], one, two = at[order], one[order], two[order]
            rows = settle(rows, np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
            k *= 2
        return sa

    def symbols(self, rows: np.ndarray) -> np.ndarray:
        """The symbols of the transform in these rows."""
        out, at = np.zeros(len(rows), np.int64), rows.copy()
        for i in range(self.levels):
            bit = self.planes[i][at].astype(np.int64)
            ones = self.ones[i][at]
            at = np.where(bit == 1, self.zeros[i] + ones, at - ones)
            out = (out << 1) | bit
        return out

    def rank(self, symbols: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before the given row."""
        lo, hi = np.zeros_like(upto), upto.copy()
        for i in range(self.levels):
            ones, zeros = self.ones[i], self.zeros[i]
            bit = (symbols >> (self.levels - 1 - i)) & 1
            l1, h1 = ones[lo], ones[hi]
            lo = np.where(bit == 1, zeros + l1, lo - l1)
            hi = np.where(bit == 1, zeros + h1, hi - h1)
        return hi - lo

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [from, to) of the suffixes that start with each pattern (a row of symbols)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[:, j]
            ok = c < self.sigma
            s = np.where(ok, c, 0)
            lo, hi = self.first[s] + self.rank(s, lo), self.first[s] + self.rank(s, hi)
            hi = np.where(ok, hi, lo)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps to the next sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        out = np.full(len(rows), -1, np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            r = rows[todo]
            hit = self.marked[r]
            out[todo[hit]] = self.samples[self.mark_rank[r[hit]]] + steps[todo[hit]]
            todo, r = todo[~hit], r[~hit]
            c = self.symbols(r)
            rows[todo] = self.first[c] + self.rank(c, r)
            steps[todo] += 1
        return out % self.n


class Items:
    """A block of items as symbols: vocabulary, phrases and where they stand; items shorter than a phrase are phrases of their own."""

    def __init__(self, ids: list[int], texts: list[str]):
        words = [words_of(t)[0] for t in texts]
        self.ids = np.array(ids, np.int64)
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.words = sorted({x for w in words for x in w})
        number = {w: i for i, w in enumerate(self.words)}
        coded = [tuple(number[x] for x in w) for w in words]
        self.groups = []  # (phrases of one length, first source of each, item and place of the sources)
        for size in range(1, PHRASE + 1):
            rows = [(c[p : p + size], i, p) for i, c in enumerate(coded) if (len(c) >= PHRASE if size == PHRASE else len(c) == size) for p in range(len(c) - size + 1)]
            if not rows:
                continue
            phrases = sorted({r[0] for r in rows})
            place = {x: k for k, x in enumerate(phrases)}
            order = sorted((place[x], i, p) for x, i, p in rows)
            start = np.searchsorted(np.array([o[0] for o in order], np.int64), np.arange(len(phrases) + 1))
            self.groups.append((np.array(phrases, np.int64).reshape(-1, size), start, np.array([o[1] for o in order], np.int64), np.array([o[2] for o in order], np.int64)))


def spans(seeds: list[tuple[int, int]], size: int, least: int) -> list[tuple[set, int, int]]:
    """Merges seeds of ``size`` words (place in the document, place in the item) to spans (item places, first and last word of the
    document) of at least ``least`` words."""
    live: list[list] = []
    done: list[list] = []
    for q, p in sorted(seeds):
        keep = []
        for s in live:
            (keep if q - s[0] <= GAP + size else done).append(s)
        live = keep
        near = [s for s in live if p > s[1] and abs((q - p) - (s[0] - s[1])) <= DRIFT]
        s = min(near, key=lambda s: abs((q - p) - (s[0] - s[1])), default=None)
        if s is None:
            s = [q, p, set(), q]
            live.append(s)
        s[0], s[1] = q, p
        s[2].update(range(p, p + size))
    return [(s[2], s[3], s[0] + size - 1) for s in done + live if len(s[2]) >= least]


def make_shard(ids: list[int], words: list[list[str]]) -> dict:
    """The index of whole documents: symbol 1 stands after each of them, the words of the vocabulary from 2 on."""
    vocabulary = sorted({w for doc in words for w in doc})
    number = {w: i + 2 for i, w in enumerate(vocabulary)}
    text = np.fromiter((c for doc in words for c in (*map(number.__getitem__, doc), 1)), np.int64)
    starts = np.cumsum([0] + [len(doc) + 1 for doc in words[:-1]])
    return {"doc_ids": ids, "starts": starts.tolist(), "vocabulary": vocabulary, **FMIndex(text).pack()}


def search_shard(shard, items: Items, share: float) -> list[tuple[int, int, float, list]]:
    """(doc_id, item's place, share of the item's words, spans of the document's words)."""
    index, starts, ids = FMIndex.unpack(shard), np.array(shard["starts"], np.int64), np.array(shard["doc_ids"], np.int64)
    number = {w: i + 2 for i, w in enumerate(shard["vocabulary"])}
    symbol = np.array([number.get(w, 0) for w in items.words], np.int64)
    out = []
    for phrases, start, items_of, places_of in items.groups:
        size = phrases.shape[1]
        coded = symbol[phrases]
        here = np.flatnonzero((coded > 0).all(axis=1))
        if not len(here):
            continue
        lo, hi = index.search(coded[here])
        n = hi - lo
        rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        phrase, place = np.repeat(here, n), index.locate(rows)
        doc = np.searchsorted(starts, place, side="right") - 1
        order = np.argsort(doc, kind="stable")
        doc, phrase, inside = doc[order], phrase[order], (place - starts[doc])[order]
        width = int(items.sizes.max()) + PHRASE
        edges = np.flatnonzero(np.diff(doc)) + 1
        for group in np.split(np.arange(len(doc)), edges) if len(doc) else []:
            d = int(doc[group[0]])
            f, q = phrase[group], inside[group]
            many = start[f + 1] - start[f]
            src = np.repeat(start[f], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            item, p, q = items_of[src], places_of[src], np.repeat(q, many)
            # words of each item covered by any phrase: at least what its spans can cover
            cover = np.unique(np.concatenate([item * width + p + k for k in range(size)]))
            touched = np.bincount(cover // width, minlength=len(items.sizes))
            for i in np.flatnonzero((touched > 0) & (touched >= share * items.sizes)):
                mine = item == i
                least = min(SPAN, math.ceil(share * int(items.sizes[i])))
                found = spans(list(zip(q[mine].tolist(), p[mine].tolist())), size, least)
                got = set().union(*[s[0] for s in found])
                if found and len(got) >= share * items.sizes[i]:
                    out.append((int(ids[d]), int(i), len(got) / float(items.sizes[i]), [(s[1], s[2]) for s in found]))
    return out


SHARDS = "doc_ids array<long>, starts array<int>, vocabulary array<string>, n int, sigma int, planes array<binary>, marked binary, samples binary"
FOUND = "doc_id long, item_id long, share double, words array<struct<first: int, last: int>>"


def _build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ids: list[int] = []
    words: list[list[str]] = []
    size = 0
    for b in batches:
        for doc, text in zip(b["doc_id"].tolist(), b["text"].tolist()):
            w = words_of(text)[0]
            if not w:
                continue
            ids.append(doc)
            words.append(w)
            size += len(w) + 1
            if size >= SHARD:
                yield pd.DataFrame([make_shard(ids, words)])
                ids, words, size = [], [], 0
    if ids:
        yield pd.DataFrame([make_shard(ids, words)])


def build_index(documents: DataFrame, path: str | None = None) -> DataFrame:
    """The index of the corpus, one row per shard. Kept in ``path`` for later test sets, else in the shared folder."""
    docs = spread(pick(documents, "doc_id", "text").where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    shards = docs.mapInPandas(_build, SHARDS)
    if path is None:
        return materialize(shards, "fmindex")
    shards.write.mode("overwrite").parquet(path)
    return documents.sparkSession.read.schema(SHARDS).parquet(path)


def search_index(index: DataFrame, items: DataFrame, share: float = 0.48, item_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, share, words): every document and item it carries, with the first and last word of each place in the
    document. ``share`` is a little below half, as words are counted a little differently by everybody (hyphens, numbers)."""
    spark = index.sparkSession
    items = pick(items, "item_id", "text").where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-total // item_words))
    out = None
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        rows = part.collect()  # about item_words words
        shared = spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows]))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            it: Items = shared.value
            for batch in batches:
                for shard in batch.to_dict("records"):
                    rows = [(d, int(it.ids[i]), s, [{"first": a, "last": z} for a, z in where]) for d, i, s, where in search_shard(shard, it, share)]
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "share", "words"])

        one = index.mapInPandas(run, FOUND)
        out = one if out is None else out.unionByName(one)
    return out


def find_leaks(documents: DataFrame, items: DataFrame, share: float = 0.48, item_words: int = 2_000_000, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, item_id, share, words) by the given index of ``documents`` or by one that is built for it."""
    return search_index(index if index is not None else build_index(documents), items, share, item_words)


def leak_spans(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """(doc_id, start, stop): the character spans to be removed from each document, overlapping ones merged. Only documents that
    carry anything are read again; rows of one id with different texts are told apart by nothing, so ids should be unique here."""
    places = leaks.select("doc_id", F.explode("words").alias("w")).groupBy("doc_id").agg(F.collect_set("w").alias("words"))  # bounded by the document's length
    docs = pick(documents, "doc_id", "text").where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(places, "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text, words in zip(b["doc_id"], b["text"], b["words"]):
                at = words_of(text)[1]
                rows.append((doc, [{"start": at[w["first"]][0], "stop": at[w["last"]][1]} for w in words if w["last"] < len(at)]))
            yield pd.DataFrame(rows, columns=["doc_id", "spans"])

    return merged_spans(docs.mapInPandas(run, "doc_id long, spans array<struct<start: int, stop: int>>"))


def merged_spans(leaks: DataFrame) -> DataFrame:
    """(doc_id, start, stop): the spans to be removed from each document, overlapping ones merged. Spans of one document
    are bounded by its length."""
    s = leaks.select("doc_id", F.explode("spans").alias("s")).groupBy("doc_id").agg(F.array_sort(F.collect_set("s")).alias("s"))
    start = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("stop"))
    step = F.aggregate(
        "s", F.array().cast("array<struct<start:int,stop:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), start)["stop"] >= x["start"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["stop"], x["stop"]).alias("stop"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return s.select("doc_id", F.explode(step).alias("s")).select("doc_id", "s.start", "s.stop")
