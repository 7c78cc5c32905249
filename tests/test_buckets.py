import random

import pytest

from quire.plans import flows
from quire.plans.flows import graphs
from quire.sources.snapshots import SnapshotStore, Transaction

SCHEMA = "k string, part int, v string"


def frame(spark, rows):
    return spark.createDataFrame([(*k, v) for k, v in rows.items()], SCHEMA)


def names(store):
    return {e["bucket"]: e["rows"] for e in store.content()["t"]}


def rows_of(store):
    return {(r.k, r.part): r.v for r in store.read("t", SCHEMA).collect()}


def put(store, spark, rows, gone=()):
    change = store.begin()
    changed = change.merge("t", frame(spark, rows), ["k", "part"], spark.createDataFrame(list(gone), "k string, part int") if gone else None, 8)
    found = {(r.k, r.part): r.v for r in changed.collect()}
    change.commit()
    return found


def test_only_buckets_with_a_change_are_written(spark, tmp_path):
    store, rng = SnapshotStore(spark, f"file://{tmp_path}/s"), random.Random(1)
    want = {(f"k{n}", n % 3): str(n) for n in range(200)}
    assert put(store, spark, want) == want and rows_of(store) == want
    before = names(store)
    assert sorted(before) == list(range(8))
    some = dict(rng.sample(sorted(want.items()), 50))
    assert put(store, spark, some) == {} and names(store) == before  # nothing differs
    more = {**some, ("k7", 1): "changed", ("new", 0): "n"}
    assert put(store, spark, more) == {("k7", 1): "changed", ("new", 0): "n"}
    want |= more
    assert rows_of(store) == want and 6 <= sum(before[b] == names(store)[b] for b in range(8)) < 8
    mid = names(store)
    assert put(store, spark, {("k8", 2): "8!"}, [("k9", 0), ("unknown", 5), ("k8", 2)]) == {("k8", 2): "8!"}
    want[("k8", 2)] = "8!"
    del want[("k9", 0)]
    assert rows_of(store) == want and sum(mid[b] == names(store)[b] for b in range(8)) >= 6
    store.expire(1)
    assert len(store.versions()) == 1 and rows_of(store) == want
    put(store, spark, {}, list(want))
    assert rows_of(store) == {}
    put(store, spark, {("k", 1): "again"})
    assert rows_of(store) == {("k", 1): "again"}


def test_other_tables_become_buckets(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    store.commit({"t": frame(spark, {("a", 1): "x", ("b", 2): "y"})})
    put(store, spark, {("b", 2): "z", ("c", 3): None})
    assert rows_of(store) == {("a", 1): "x", ("b", 2): "z", ("c", 3): None}
    with pytest.raises(ValueError, match="not unique"):
        store.begin().merge("t", frame(spark, {("a", 1): "x"}).union(frame(spark, {("a", 1): "y"})), ["k", "part"])
    assert rows_of(store)[("a", 1)] == "x"


def test_a_graph_leaves_unchanged_files(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, f"file://{tmp_path}/g")

    def built(entities):
        edges = [("Paper", "p", "USES", "Entity", f"Method\u001f{e}") for e in entities]
        rows = {"papers": [("p", "t")], "entities": [(e, "Method") for e in entities], "chunks": [], "results": [], "edges": edges}
        return graphs.Graph(**{n: spark.createDataFrame(rows[n], s) for n, s in flows.GRAPH_SCHEMAS.items()})

    def update(entities, **how):
        monkeypatch.setattr(flows.graphs, "build", lambda *_: built(entities))
        flows.update_graph(None, None, None, store, **how)
        return {n: {e.get("bucket"): e["rows"] for e in store.content()[n]} for n in flows.GRAPH_SCHEMAS}

    def found():
        return {r.name for r in store.read("entities", flows.GRAPH_SCHEMAS["entities"]).collect()}, store.read("edges", flows.GRAPH_SCHEMAS["edges"]).count()

    many = [f"m{k}" for k in range(90)]
    first = update(many)
    assert update(many) == first  # the same build writes no table
    second = update([*many, "one"])
    assert sum(first["entities"][b] != x for b, x in second["entities"].items()) == 1
    assert sum(first["edges"].get(b) != x for b, x in second["edges"].items()) == 1 and second["papers"] == first["papers"]
    update(many[:80])
    assert found() == ({*many, "one"}, 91)  # nothing is deleted
    update(many[:80], prune=True)
    assert found() == (set(many[:80]), 80)
    update(many[:5], reset=True)
    assert found() == (set(many[:5]), 5)


def test_a_first_merge_writes_rows_once_and_a_second_only_digests(spark, tmp_path, monkeypatch):
    store, written = SnapshotStore(spark, f"file://{tmp_path}/s"), []
    write = Transaction._write
    monkeypatch.setattr(Transaction, "_write", lambda self, name, df, partitions=(): (written.append((name, df.columns)), write(self, name, df, partitions))[1])
    want = {("a", 1): "x", ("b", 2): None, ("c", 3): "y"}
    put(store, spark, want)
    assert [name for name, _ in written] == ["t"]  # no spool beside the buckets
    written.clear()
    assert put(store, spark, want) == {} and rows_of(store) == want
    assert ("t.digests", ["__d1", "__d2"]) in written and "t" not in dict(written)
    # Nulls that change places are a change.
    table = "k string, a string, b string"
    for row in (("k", None, "v"), ("k", "v", None)):
        change = store.begin()
        change.merge("u", spark.createDataFrame([row], table), ["k"], buckets=2)
        change.commit()
        assert tuple(store.read("u", table).first()) == row
