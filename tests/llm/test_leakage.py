import random

import numpy as np
import pytest

from siltstone.llm.leakage import FMIndex, Items, build_index, find_leaks, leak_spans, make_shard, search_index, search_shard, words_of


@pytest.mark.parametrize("seed", range(4))
def test_index_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    t = rng.integers(1, 5, 400)
    t[100:200] = t[200:300]  # a long repeat
    ix = FMIndex.unpack(FMIndex(t).pack())
    assert FMIndex._suffixes(np.append(t, 0)).tolist() == sorted(range(401), key=lambda i: np.append(t, 0)[i:].tolist())
    pats = rng.integers(1, 7, (80, 4))
    for p, lo, hi in zip(pats, *ix.search(pats)):
        assert sorted(ix.locate(np.arange(lo, hi)).tolist()) == [i for i in range(len(t) - 3) if (t[i : i + 4] == p).all()]


def test_words():
    assert words_of("Re-\nad <em>On</em>ly&#44; it­em's 3 ＡＢ")[0] == ["read", "on", "ly", "item's", "3", "ab"]
    assert words_of("")[0] == []


rng = random.Random(5)
ITEM = " ".join(f"w{rng.randrange(500)}" for _ in range(80))
OTHER = " ".join(f"w{rng.randrange(500)}" for _ in range(80))
W = ITEM.split()
EDITED = " ".join(x if i % 17 else "zzz" for i, x in enumerate(W))
CASES = {
    1: ITEM, 2: "Intro.\n\n> " + ITEM.upper().replace(" ", ",\n> ") + "\nend", 3: EDITED, 4: " ".join(W[:42]) + " and so on", 5: " ".join(W[:20]) + " between them stands a lot of text here " + " ".join(W[50:72]),
    6: " ".join(W[:25]), 7: " ".join(reversed(W)), 8: "nothing", 9: "", 10: None, 11: ITEM + " " + OTHER, 12: ("a b c " * 40_000) + ITEM,
}


def test_documents_and_items(spark):
    docs = spark.createDataFrame([(k, v, 1, "x") for k, v in CASES.items()] + [(1, ITEM, 1, "x"), (None, ITEM, 1, "x")], "doc_id long, text string, item_id int, TEXT string")
    items = spark.createDataFrame([(70, ITEM, 1), (71, OTHER, 1), (72, "too short", 1), (73, None, 1), (74, "", 1), (75, ITEM, 1)], "item_id long, text string, spans int")
    want = {(d, 70) for d in (1, 2, 3, 4, 5, 11, 12)} | {(11, 71)}
    want |= {(d, 75) for d, i in want if i == 70}
    for words in (2_000_000, 30):  # one block of items, and several
        got = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, items, item_words=words).collect()}
        assert got == want
    assert find_leaks(docs.limit(0), items).count() == 0
    assert find_leaks(docs, items.limit(0)).count() == 0


def test_spans_are_merged(spark):
    text = "Before it. " + ITEM + " After it."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, " ".join(W[:60]))], "item_id long, text string")
    s = leak_spans(docs, find_leaks(docs, items)).collect()
    assert [text[r["start"] : r["stop"]] for r in s] == [ITEM]


def test_short_items_and_small_places(spark, tmp_path):
    twelve, half, places = " ".join(f"k{i}" for i in range(12)), " ".join(f"m{i}" for i in range(26)), " ".join(f"n{i}" for i in range(40))
    n = places.split()
    docs = [(1, f"Before it {twelve} after it."), (2, " ".join(half.split()[:13]) + " and else"), (3, " ".join(n[:12]) + " some words of its own stand here " + " ".join(n[20:32])), (4, "here is a Rare-ish, phrase."), (5, "here is a rare phrase"), (6, "k0 k1 k2 k3 k4 only"), (7, " ".join(n[:12]))]
    items = spark.createDataFrame([(1, twelve), (2, half), (3, places), (4, "rare ish phrase"), (5, "rare")], "item_id long, text string")
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string"), f"{tmp_path}/index")
    want = {(1, 1), (2, 2), (3, 3), (4, 4), (4, 5), (5, 5)}
    assert {(r["doc_id"], r["item_id"]) for r in search_index(index, items).collect()} == want
    # the stored index serves another test set without the documents
    assert {(r["doc_id"], r["item_id"]) for r in search_index(spark.read.parquet(f"{tmp_path}/index"), items.where("item_id = 3")).collect()} == {(3, 3)}


def test_against_brute_force(spark):
    """Random documents with pieces of items: found is what covers at least the share, by pieces of SPAN words and more."""
    g = random.Random(9)
    items = {i: [f"w{g.randrange(4000)}" for _ in range(g.randrange(20, 70))] for i in range(12)}
    docs, want = {}, set()
    for d in range(150):
        i = g.randrange(12)
        w, out, got, at = items[i], [], 0, 0
        while at < len(w):
            piece = g.choice([3, 8, 10, 15])
            if g.random() < 0.6:
                out += w[at : at + piece]
                got += len(w[at : at + piece]) if len(w[at : at + piece]) >= 6 else 0
            out += [f"z{g.randrange(9999)}" for _ in range(9)]
            at += piece + 1
        docs[d] = " ".join(out)
        if got >= 0.48 * len(w):
            want.add((d, i))
    found = find_leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want and len(want) > 20


def test_shard_of_one_long_document():
    it = Items([1], [ITEM])
    assert [(d, i) for d, i, _, _ in search_shard(make_shard([8, 9], [["x"], words_of(ITEM)[0]]), it, 0.48)] == [(9, 0)]
