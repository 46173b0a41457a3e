import random

from siltstone.operators.changelog import SortedRuns

SCHEMA = "seq long, rel_path string, change_type string, new_hash string, recorded_at timestamp_ntz, run int, PATH string"


def feed(spark, rows):
    return spark.createDataFrame([(*r, None, 1, "x") for r in rows], SCHEMA)


def alive(store):
    return {r["rel_path"]: (r["seq"], r["new_hash"]) for r in store.alive().collect()}


def test_out_of_order_runs_with_tombstones(spark):
    s = SortedRuns(spark, buckets=3)
    s.append(feed(spark, [(5, "a", "modified", "h5"), (1, "b", "created", "h1"), (7, "c", "deleted", None)]))
    s.append(feed(spark, [(2, "a", "created", "h2"), (3, ".\\b", "DELETED ", None), (6, "c", "modified", "h6"), (5, "a", "modified", "h5")]))
    s.append(feed(spark, [(9, None, None, "h9"), (None, "z", "created", "h"), (4, "d//e", "modify", None)]))
    want = {"a": (5, "h5"), "": (9, "h9"), "d/e": (4, None)}
    assert alive(s) == want
    s.compact()
    assert len(s.runs) == 1 and alive(s) == want
    s.append(feed(spark, [(6, "b", "created", "h6"), (2, "c", "created", "h2")]))  # older than the tombstone of c
    assert alive(s) == want | {"b": (6, "h6")}
    s.compact(drop_tombstones=True)
    assert alive(s) == want | {"b": (6, "h6")}


def test_random_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, f"p{rng.randrange(20)}" if rng.random() < 0.6 else "hot", rng.choice(["created", "modified", "deleted"]), f"h{i}") for i in range(300)]
    rng.shuffle(rows)
    s = SortedRuns(spark, buckets=2, fan_in=2)
    for k in range(5):
        s.append(feed(spark, rows[k::5] + rows[k : k + 5]))
    last = {}
    for r in sorted(rows):
        last[r[1]] = r
    assert alive(s) == {p: (r[0], r[3]) for p, r in last.items() if r[2] != "deleted"}
    assert [r["level"] for r in s.runs] == [2, 0]  # five runs, merged by twos
    assert len(s.folder.names("runs")) <= len(s.runs) + 2  # replaced ones are deleted


def test_opened_again(spark):
    s = SortedRuns(spark, buckets=2, fan_in=3)
    s.append(feed(spark, [(5, "a", "modified", "h5"), (1, "b", "created", "h1")]), "one")
    s.append_slices(feed(spark, [(3, "b", "deleted", None), (2, "c", "created", "h2")]), "recorded_at", 2)
    want = {"a": (5, "h5"), "c": (2, "h2")}
    for name in {r["name"] for r in s.runs}:
        spark.sql(f"DROP TABLE {name}")  # as in a new session; the files stay
    again = SortedRuns(spark, root=s.root, buckets=7)
    assert again.buckets == 2 and alive(again) == want
    again.append(feed(spark, [(9, "a", "deleted", None)]), "one")  # the same batch once more
    assert alive(again) == want
    again.append(feed(spark, [(9, "a", "deleted", None)]), "two")
    assert alive(SortedRuns(spark, root=s.root)) == {"c": (2, "h2")}


def test_broken_attempts_leave_nothing(spark, monkeypatch):
    s = SortedRuns(spark, buckets=2)
    s.append(feed(spark, [(1, "a", "created", "h1")]))
    monkeypatch.setattr(s.folder, "put", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    for attempt in (lambda: s.append(feed(spark, [(2, "a", "deleted", None)])), s.compact):
        try:
            attempt()
        except OSError:
            pass
    again = SortedRuns(spark, root=s.root)
    assert alive(again) == {"a": (1, "h1")} and len(again.folder.names("runs")) == 1


def test_merge_reads_runs_without_exchange(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        s = SortedRuns(spark, buckets=4)
        for k in range(2):
            s.append(feed(spark, [(k * 10 + i, f"p{i}", "modified", "h") for i in range(5)]))
        plan = s.alive()._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_empty(spark):
    s = SortedRuns(spark, buckets=2)
    assert s.alive().count() == 0
    s.append_slices(feed(spark, []), "recorded_at", 3)
    assert s.alive().count() == 0
