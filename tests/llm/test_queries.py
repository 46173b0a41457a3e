from collections import Counter

import oracle
import pytest

from siltstone.llm.handwritten import text_kinds
from siltstone.llm.leakage import words_of
from siltstone.llm.mixing import Mix
from siltstone.llm.queries import ORACLE, QUERIES
from siltstone.llm.residue import hits


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, data, name):
    assert oracle.compare(spark, name, QUERIES[name], ORACLE[name], data) == ""


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.endswith("_found")))
def test_no_case_twice(spark, data, name):
    rows = [tuple(r) for r in QUERIES[name](spark, data).collect()]
    assert rows and len(set(rows)) == len(rows) and not any(None in r for r in rows)


def read(data, name):
    import pyarrow.parquet as pq

    return pq.read_table(f"{data}/{name}.parquet").to_pandas()


def test_p5_kinds(spark, data):
    """What the texts tell, counted without Spark, is what the query counts for kinds that only texts have."""
    own = Counter(k for t in read(data, "file_texts")["text"] if t for k in text_kinds(t))
    got = {r["kind"]: r["files"] for r in QUERIES["p5_kinds"](spark, data).collect()}
    for kind in ("made by a tool", "copied in", "minified layout", "uniform layout", "lock file"):
        assert own[kind] <= got.get(kind, 0) <= own[kind] + own["nearly " + kind]
    assert sum(got.values()) >= QUERIES["p5_found"](spark, data).count()


def test_p6_masked_changes_found_lines_only(spark, data):
    found = {tuple(r) for r in QUERIES["p6_found"](spark, data).collect()}
    before = dict(read(data, "file_texts")[["file_id", "text"]].itertuples(index=False))
    changed = set()
    for r in QUERIES["p6_masked"](spark, data).collect():
        a, b = (before[r["file_id"]] or "").split("\n"), (r["text"] or "").split("\n")
        assert len(a) == len(b) and all(len(x) == len(y) for x, y in zip(a, b))
        inside = False  # the body of a key belongs to the line where it begins
        for n, (x, y) in enumerate(zip(a, b), 1):
            if x != y and not inside:
                changed.add((r["file_id"], n))
            inside = ("PRIVATE KEY-----" in x and "BEGIN" in x) or (inside and "-----END" not in x)
    assert changed <= found and changed


def test_p7_spans(spark, data):
    """Spans lie in their texts, apart from each other, and hold at least the wanted share of an item's words."""
    texts, items = dict(read(data, "documents")[["doc_id", "text"]].itertuples(index=False)), dict(read(data, "eval_items")[["item_id", "text"]].itertuples(index=False))
    spans: dict = {}
    for r in QUERIES["p7_spans"](spark, data).collect():
        spans.setdefault(r["doc_id"], []).append((r["start"], r["stop"]))
    pairs = [tuple(r) for r in QUERIES["p7_found"](spark, data).collect()]
    assert set(spans) == {p[0] for p in pairs}
    for d, i in pairs:
        at = sorted(spans[d])
        assert all(0 <= a < b <= len(texts[d]) for a, b in at) and all(x[1] < y[0] for x, y in zip(at, at[1:]))
        have, want = Counter(w for a, b in at for w in words_of(texts[d][a:b])[0]), Counter(words_of(items[i])[0])
        assert sum((have & want).values()) >= 0.45 * sum(want.values())


def test_p8_mix_and_shares(spark, data):
    """Nobody is repeated too often, the shares are those of the selection, and each source gets what the flow gives it but for the documents at the edges."""
    t = read(data, "mix_targets")
    most = {s.strip().lower(): int(m) for s, m in zip(t["source"], t["max_repeats"])}
    mix = Mix(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/mix_targets.parquet"))
    got, largest = Counter(), 0
    for r in QUERIES["p8_mix"](spark, data).collect():
        assert 1 <= r["copies"] <= most[r["source"]]
        got[r["source"]] += r["tokens"] * r["copies"]
        largest = max(largest, r["tokens"])
    flow = Counter()
    for (_, s), f in mix.flow.items():
        flow[s] += f
    for r in QUERIES["p8_shares"](spark, data).collect():
        assert r["reached_tokens"] == got[r["source"]] and abs(got[r["source"]] - flow[r["source"]]) <= 2 * largest
        assert abs(r["reached_share"] - got[r["source"]] / mix.total) < 1e-9
    assert {r["source"] for r in QUERIES["p8_found"](spark, data).collect()} == {s for s in most if flow[s] < mix.quota[s]}


def test_p9_kinds(spark, data):
    """Every kind is counted for documents in which a detector of that kind hits, and all documents found are among these."""
    own = Counter(k for t in read(data, "documents")["text"] if t for k in {h[0] for h in hits(t)})
    got = {r["kind"]: r["documents"] for r in QUERIES["p9_kinds"](spark, data).collect()}
    assert got and all(n <= own[k] for k, n in got.items()) and sum(got.values()) >= QUERIES["p9_found"](spark, data).count()


def test_tokens_without_file_id_count(spark, tmp_path):
    spark.createDataFrame([(7, "a = 1\ndb_pass = 'p3bbl3!8201X'\n")], "file_id long, text string").write.parquet(f"{tmp_path}/file_texts.parquet")
    rows = [(7, "1/2:7", 2, "word"), (None, "1/2:7", 2, "word"), (None, "1/2:7", 1, "word"), (None, "1/7:8", 2, "string"), (None, "1:7", 2, "string")]
    spark.createDataFrame(rows, "file_id long, location_key string, line int, token_kind string").write.parquet(f"{tmp_path}/token_locations.parquet")
    assert sorted(map(tuple, QUERIES["p6_tokens"](spark, str(tmp_path)).collect())) == [("string", 1), ("word", 2)]
