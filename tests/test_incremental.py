import datetime as dt

import pytest

from siltstone.operators.incremental import PRINTS, Broken, PartitionedIncrement, fingerprints

FEED = "seq long, rel_path string, change_type string, new_hash string, new_size long, recorded_at timestamp_ntz, bucket int, Seq string"
STATE = "rel_path string, hash string, size long, last_seq long, updated_ts string, PATH string"
T = lambda m: dt.datetime(2025, 1, 1, 0, m)


def feed(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], FEED)


def state(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], STATE)


ROWS = [
    (1, "a/x", "created", "h1", 1, T(1)), (1, "a\\x", "Created ", "h1", 1, T(2)), (2, "a/./x", "modified", "h2", 2, T(3)), (3, "b", "created", "h3", 3, T(4)),
    (4, "b", "deleted", None, None, T(5)), (None, "b", "modified", "h9", 9, T(6)), (5, None, "created", "h5", 5, T(7)), (6, "c", None, "h6", 6, None),
]


def test_first_run_takes_everything_once(spark):
    store = PartitionedIncrement(spark, buckets=4)
    got = sorted(r["seq"] for r in store.run(feed(spark, ROWS)).collect())
    assert got == [1, 2, 3, 4, 5, 6]
    assert store.run(feed(spark, ROWS)).count() == 0
    s = {r["path"]: (r["last_seq"], r["hash"]) for r in store.state().collect()}
    assert s == {"a/x": (2, "h2"), "b": (4, None), "": (5, "h5"), "c": (6, "h6")}


def test_only_changed_cells_are_recomputed(spark):
    store = PartitionedIncrement(spark, buckets=16)
    store.run(feed(spark, ROWS))
    more = [*ROWS, (7, "c", "modified", "h7", 7, T(9))]
    before = dict(store.manifest["state"])
    changed = store.changed_cells(fingerprints(store.feed(feed(spark, more)), ["bucket", "cell"], store.FEED), store._read("fingerprints", PRINTS))
    assert changed.count() == 1
    assert [r["seq"] for r in store.run(feed(spark, more)).collect()] == [7]
    assert sum(before.get(b) != r for b, r in store.manifest["state"].items()) == 1  # only that bucket was replaced


MORE = [(7, "c", "modified", "h7", 7, T(9)), (8, "d", "created", "h8", 8, T(9)), (9, "b", "created", "h9", 9, T(9))]


@pytest.mark.parametrize("where", ["taken", "half", "state", "fingerprints", "commit"])
def test_broken_runs_give_every_change_once(spark, where):
    """Whatever a run breaks off after, all attempts together hand out every change once, also by a store that was opened again."""
    store = PartitionedIncrement(spark, buckets=4)
    got = [r["seq"] for r in store.run(feed(spark, ROWS)).collect()]
    with pytest.raises(Broken):
        store.run(feed(spark, ROWS + MORE), fail_after=where)
    store = PartitionedIncrement(spark, root=store.root)
    last = (10, "e", "created", "h10", 10, T(10))
    got += [r["seq"] for r in store.run(feed(spark, [*ROWS, *MORE, last])).collect()]
    got += [r["seq"] for r in PartitionedIncrement(spark, root=store.root).run(feed(spark, [*ROWS, *MORE, last])).collect()]
    assert sorted(got) == list(range(1, 11))
    s = {r["path"]: (r["last_seq"], r["hash"]) for r in store.state().collect()}
    assert s == {"a/x": (2, "h2"), "b": (9, "h9"), "": (5, "h5"), "c": (7, "h7"), "d": (8, "h8"), "e": (10, "h10")}


def test_unacknowledged_runs_come_again(spark):
    store = PartitionedIncrement(spark, buckets=4)
    store.run(feed(spark, ROWS), run_id="one", acknowledge=False)
    store = PartitionedIncrement(spark, root=store.root)
    assert {k: sorted(r["seq"] for r in v.collect()) for k, v in store.waiting().items()} == {"one": [1, 2, 3, 4, 5, 6]}
    store.acknowledge(["one"])
    assert store.waiting() == {} and store.run(feed(spark, ROWS), run_id="one").count() == 0 and store.run(feed(spark, ROWS)).count() == 0


def test_appended_batches_add_their_fingerprints(spark):
    store = PartitionedIncrement(spark, buckets=4)
    store.run(feed(spark, ROWS[:4]), appended=True)
    store.run(feed(spark, ROWS[4:]), appended=True)
    assert store.run(feed(spark, ROWS)).count() == 0  # the fingerprints of both batches are those of the whole feed
    assert sorted(r["seq"] for r in store.run(feed(spark, ROWS + MORE)).collect()) == [7, 8, 9]


def test_a_given_state_seeds_the_fingerprints(spark):
    st = state(spark, [("a/x", "h2", 2, 2, "2025-01-01T00:03:00Z"), ("b", None, None, 4, "2025-01-01T00:05:00Z")])
    store = PartitionedIncrement(spark, rows_per_cell=1, buckets=4)
    rows = store.feed(feed(spark, ROWS))
    prints = fingerprints(rows, ["bucket", "cell"], store.FEED)
    changed = store.changed_cells(prints, store.seed(rows, store.valid_state(st), prints, store.FEED))
    assert changed.count() < prints.count()
    assert sorted(r["seq"] for r in store.plan(feed(spark, ROWS), st).collect()) == [5, 6]
    assert sorted(r["seq"] for r in store.run(feed(spark, ROWS), st).collect()) == [5, 6]
    assert sorted(r["seq"] for r in store.run(feed(spark, ROWS + MORE)).collect()) == [7, 8, 9]


def test_late_arrivals_and_rules(spark):
    st = state(spark, [("a/x", "h", 1, 10, "2025-01-01T00:02:00+00:00"), ("a/x", "h", 1, 1, "2024-12-31T23:59:59Z"), ("b", "h", 1, 10, "2025-01-01T02:10:00+02:00")])
    rows = [(1, "a/x", "m", "h", 1, T(1)), (2, "a/x", "m", "h", 1, T(3)), (11, "a/x", "m", "h", 1, T(1)), (3, "b", "m", "h", 1, T(9)), (4, "b", "m", "h", 1, T(11)), (5, "new", "m", "h", 1, T(0))]
    got = {r["seq"] for r in PartitionedIncrement(spark, buckets=4).plan(feed(spark, rows), st).collect()}
    assert got == {2, 11, 4, 5}


def test_hot_path_is_split(spark):
    rows = [(i, "hot", "m", "h", 1, T(1)) for i in range(500)] + [(1000 + i, f"p{i}", "m", "h", 1, T(1)) for i in range(50)]
    st = state(spark, [("hot", "h", 1, 249, "2025-01-01T00:30:00Z")])
    got = {r["seq"] for r in PartitionedIncrement(spark, buckets=4, rows_per_task=40).plan(feed(spark, rows), st).collect()}
    assert got == set(range(250, 500)) | set(range(1000, 1050))


def test_empty(spark):
    assert PartitionedIncrement(spark, buckets=4).plan(feed(spark, []), state(spark, [])).count() == 0
    assert PartitionedIncrement(spark, buckets=4).run(feed(spark, [])).count() == 0
