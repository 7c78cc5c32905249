import numpy as np
import pyarrow as pa
import pytest

from quire.operators import pivots, search


def frame(spark, name, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"{name} string, embedding array<float>")


def brute(queries, vectors, k):
    out = []
    for q, v in queries:
        if v is None:
            continue
        near = sorted((float(((np.float32(v).astype(float) - np.float32(x).astype(float)) ** 2).sum()), i) for i, x in vectors if x is not None)[:k]
        out += [(q, i, n, round(d, 9)) for n, (d, i) in enumerate(near, 1)]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r.chunk_id, r["rank"], round(r.score, 9)) for r in df.collect())


def clustered(n, clusters, seed, size=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, size)) * 20
    return [(f"v{k:05d}", centres[k % clusters] + rng.normal(size=size)) for k in range(n)]


@pytest.fixture
def small(monkeypatch):
    for name, value in (("PIVOTS", 12), ("RINGS", 3), ("PART", 10), ("BLOCK", 16), ("GROUP", 7)):
        monkeypatch.setattr(pivots, name, value)


def test_equals_brute_force_and_skips(spark, small):
    vectors = clustered(600, 10, 1)
    vectors += [("twin1", vectors[3][1]), ("twin0", vectors[3][1]), ("none", None)]
    queries = vectors[::9] + [("far", np.full(8, 500.0)), ("nil", None)]
    index = pivots.build_index(frame(spark, "chunk_id", vectors))
    asked = frame(spark, "query_id", queries)
    for k in (1, 5):
        assert found(index.search(asked, k)) == brute(queries, vectors, k)
        report = index.skipped().collect()
        visited, all_ = sum(r.visited for r in report), sum(r.parts for r in report)
        print(f"k {k}: {all_ - visited} of {all_} parts skipped")
        assert visited < 0.5 * all_


def test_few_vectors_and_none(spark, small):
    vectors, queries = clustered(4, 2, 2), clustered(3, 2, 3)
    index = pivots.build_index(frame(spark, "chunk_id", vectors))
    assert found(index.search(frame(spark, "query_id", queries), 9)) == brute(queries, vectors, 9)
    assert index.search(frame(spark, "query_id", []), 3).collect() == []
    assert pivots.build_index(frame(spark, "chunk_id", [("x", None)])) is None


def test_a_crowded_part(spark, small):
    """Half of all vectors are one point, and every query is near it: the part has many blocks and groups."""
    vectors = [(f"c{k:04d}", np.ones(8)) for k in range(200)] + clustered(200, 10, 5)
    queries = [(f"q{k}", np.ones(8) + k / 1000) for k in range(40)]
    index = pivots.build_index(frame(spark, "chunk_id", vectors))
    assert max(r.subs for r in index.subs.collect()) > 5
    assert found(index.search(frame(spark, "query_id", queries), 6)) == brute(queries, vectors, 6)


def test_many_queries_take_the_table(spark, small, monkeypatch):
    vectors, queries = clustered(300, 6, 7), clustered(50, 6, 8)
    want = brute(queries, vectors, 4)
    assert found(search.vector_topk(frame(spark, "query_id", queries), frame(spark, "chunk_id", vectors), 4)) == want
    monkeypatch.setattr(search, "QUERY_BYTES", 100)
    assert found(search.vector_topk(frame(spark, "query_id", queries), frame(spark, "chunk_id", vectors), 4)) == want


def test_queries_that_skip_nothing_are_routed_in_bounded_batches():
    """Two thousand parts that no query can skip: a task makes its copies of the queries ROUTED at a time, each once."""
    rng = np.random.default_rng(2)
    parts = pivots.Parts(rng.normal(size=(256, 4)), np.repeat(np.arange(256), 8), np.zeros(2048), np.full(2048, 99.0), np.full(2048, 500))
    rows = pa.RecordBatch.from_arrays([pa.array([f"q{k}" for k in range(40)]), pa.array(list(rng.normal(size=(40, 4)))), pa.array(np.full(40, 1e9))], names=["query_id", "embedding", "reach"])
    made = list(pivots._route(iter([rows]), parts, 5))
    assert max(b.num_rows for b in made) <= pivots.ROUTED < sum(b.num_rows for b in made)
    visits = [(q, p) for b in made for q, p in zip(b["query_id"].to_pylist(), b["part"].to_pylist(), strict=True)]
    assert len(visits) == len(set(visits)) == 40 * 2047  # all but each one's home, which has been searched
