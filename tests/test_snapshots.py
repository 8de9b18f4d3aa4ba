"""Commits of several tables: all or nothing for readers, drift refuses everything, the loser of a race tries again."""

import threading

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import snapshots as S


@pytest.fixture
def store(spark, tmp_path):
    return S.Snapshots(spark, str(tmp_path / "store"))


def batches(spark, parents, children):
    return {
        "parents": S.Batch(spark.createDataFrame(parents, "id int, name string, tags map<string,string>"), ["id"]),
        "children": S.Batch(spark.createDataFrame(children, "id int, parent int, note string"), ["id", "parent"], ["note"]),
    }


def seen(store, version=None):
    return {name: sorted(r[0] for r in store.read(name, version).collect()) for name in store.tables(version)}


def test_all_tables_or_none(spark, store):
    assert store.version() == 0 and store.tables() == []
    with pytest.raises(KeyError):
        store.read("parents")
    first = store.commit(batches(spark, [(1, "a", {"x": "1"}), (2, "b", None), (1, "a", {"x": "1"})], [(10, 1, "n")]))
    assert (first.version, first.published, first.counts["parents"]) == (1, True, {"created": 2, "reused": 0, "drifted": 0})
    again = store.commit(batches(spark, [(1, "a", {"x": "1"})], [(10, 1, "n")]))
    assert (again.version, again.published, again.counts["children"]["reused"]) == (1, False, 1)
    more = store.commit(batches(spark, [(3, None, None)], [(10, 1, "n"), (10, 3, "m"), (None, 3, None)]))
    assert more.version == 2 and more.counts["children"] == {"created": 2, "reused": 1, "drifted": 0}
    assert seen(store, 1) == {"parents": [1, 2], "children": [10]} and store.read("parents").count() == 3 and store.read("children").count() == 3


def test_a_writer_that_dies_between_two_tables(spark, store, monkeypatch):
    store.commit(batches(spark, [(1, "a", None)], [(10, 1, "n")]))
    whole, staged = S.Snapshots._staged, []

    def dies(self, name, *rest):
        if staged:
            raise RuntimeError("lost")
        staged.append(name)
        return whole(self, name, *rest)

    monkeypatch.setattr(S.Snapshots, "_staged", dies)
    with pytest.raises(RuntimeError, match="lost"):
        store.commit(batches(spark, [(2, "b", None)], [(20, 2, "n")]))
    assert store.version() == 1 and seen(store) == {"parents": [1], "children": [10]}
    monkeypatch.setattr(S.Snapshots, "_staged", whole)
    assert len(store.orphans()) == 1
    store.commit(batches(spark, [(2, "b", None)], [(20, 2, "n")]))
    assert seen(store) == {"parents": [1, 2], "children": [10, 20]} and len(store.orphans()) == 1


def test_a_writer_that_dies_before_it_publishes(spark, store, monkeypatch):
    publish = S.Snapshots._publish
    monkeypatch.setattr(S.Snapshots, "_publish", lambda self, manifest: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        store.commit(batches(spark, [(1, "a", None)], [(10, 1, "n")]))
    monkeypatch.setattr(S.Snapshots, "_publish", publish)
    assert store.version() == 0 and len(store.orphans()) == 2
    assert store.commit(batches(spark, [(1, "a", None)], [(10, 1, "n")])).version == 1


@pytest.mark.parametrize("rows", [[(1, "z", None), (2, "b", None)], [(2, "b", None), (2, "c", None)], [(1, "a", {"x": "1"})], [(1, None, None)]])
def test_drift_refuses_the_whole_commit(spark, store, rows):
    """Other values than stored, two of the same batch, a map or a null that differs: nothing of any table is published."""
    store.commit(batches(spark, [(1, "a", None)], [(10, 1, "n")]))
    with pytest.raises(S.Drift) as why:
        store.commit(batches(spark, rows, [(30, 1, "new")]))
    assert why.value.counts == {"parents": 1, "children": 0} and store.version() == 1 and seen(store) == {"parents": [1], "children": [10]}
    told = {(r["table"], r["outcome"]): r.n for r in store.plan(batches(spark, rows, [(30, 1, "new")])).collect()}
    assert told["parents", "drifted"] == 1 and told["children", "created"] == 1


def test_of_two_writers_one_wins_and_the_other_tries_again(spark, store, monkeypatch):
    """Both stage on the same snapshot; the second to publish finds its rows stored and reuses them."""
    store.commit(batches(spark, [(1, "a", None)], [(10, 1, "n")]))
    publish, raced = S.Snapshots._publish, []

    def late(self, manifest):
        if not raced:
            raced.append(True)
            other = S.Snapshots(spark, self._folder)
            assert other.commit(batches(spark, [(2, "b", None), (3, "c", None)], [(10, 1, "n")])).version == 2
        return publish(self, manifest)

    monkeypatch.setattr(S.Snapshots, "_publish", late)
    done = store.commit(batches(spark, [(2, "b", None), (4, "d", None)], [(40, 1, "n")]))
    assert done.version == 3 and done.counts["parents"] == {"created": 1, "reused": 1, "drifted": 0}
    assert seen(store) == {"parents": [1, 2, 3, 4], "children": [10, 40]}
    monkeypatch.setattr(S.Snapshots, "_publish", lambda self, manifest: False)
    with pytest.raises(S.Contended):
        store.commit(batches(spark, [(9, "i", None)], [(10, 1, "n")]), attempts=2)


def test_writers_at_once(spark, store):
    """Threads that commit rows of their own and shared ones: every row once, as many versions as commits."""
    held = []

    def write(k):
        held.append(S.Snapshots(spark, store._folder).commit(batches(spark, [(0, "shared", None), (k, "own", None)], [(k, 0, "n")]), attempts=20).version)

    threads = [threading.Thread(target=write, args=(k,)) for k in (1, 2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert sorted(held) == [1, 2, 3] and seen(store) == {"parents": [0, 1, 2, 3], "children": [1, 2, 3]}


def test_empty_batches_and_compaction(spark, store):
    empty = batches(spark, [], [])
    assert store.commit(empty).version == 1 and store.read("parents").count() == 0 and store.commit(empty).published is False
    for k in range(3):
        store.commit(batches(spark, [(k, "a", None)], [(k, k, None)]))
    assert len(store.manifest()["tables"]["parents"]["parts"]) == 3
    store.compact("parents")
    assert len(store.manifest()["tables"]["parents"]["parts"]) == 1 and store.read("parents").count() == 3 and store.read("parents", 2).count() == 1
    assert store.commit(batches(spark, [(1, "a", None)], [(1, 1, None)])).published is False
    assert store.read("children").agg(F.sum("parent")).first()[0] == 3
