import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.functions.vectors import nearest
from quire.operators import ranked, traverse
from quire.plans import flow_queries, flows


def shuffled(spark):
    """Records that the stages of the session have written to shuffles so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


@pytest.mark.parametrize("hops", [1, 2])
def test_cut_lists_lose_nothing(spark, hops):
    """Hubs with and without common neighbours, entities of one name, edges given twice, nodes that are no entities."""
    rng = random.Random(hops)
    nodes = [f"n{k:03d}" for k in range(160)]
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(220)]
    pairs += [(f"n{h:03d}", x) for h in (0, 1, 2) for x in rng.sample(nodes, 60)] + [("n003", f"n{k:03d}") for k in range(100, 160)] + [("n003", "n000")]
    edges = spark.createDataFrame([(a, "USES", b) for a, b in pairs + pairs[:40]], "src string, rel_type string, dst string")
    names = spark.createDataFrame([(x, f"name{rng.randrange(40)}", rng.choice("ab")) for x in nodes if x[-1] != "7"], "entity string, name string, type string")
    rows = [(q, x) for q in range(60) for x in rng.sample(nodes, rng.randrange(1, 6)) + rng.choice(([], ["n000"], ["n003"], ["n001", "n003"]))]
    seeds = spark.createDataFrame(rows, "query_id long, entity string").distinct()
    want = traverse.expand_entities(seeds, edges, names, hops, ["USES"])
    for most, hub in ((1, 5), (7, 20), (7, 55), (40, 10), (40, 1000)):
        got = ranked.first_entities(seeds, traverse.turned(edges, ["USES"]), names, hops, most, hub=hub)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.filter(F.col("rank") <= most).collect()))


def test_no_row_for_each_query_and_neighbour(spark):
    """300 queries at a hub with 3,000 neighbours: before, 900,000 rows were shuffled."""
    links = spark.range(3000).select(F.lit("hub").alias("src"), F.lit("USES").alias("rel_type"), F.concat(F.lit("x"), "id").alias("dst"))
    links = links.unionByName(spark.range(300).select(F.concat(F.lit("s"), "id").alias("src"), F.lit("USES").alias("rel_type"), F.lit("hub").alias("dst")))
    names = links.select(F.col("dst").alias("entity"), F.col("dst").alias("name"), F.lit("k").alias("type")).distinct()
    seeds = spark.range(300).select(F.col("id").alias("query_id"), F.concat(F.lit("s"), "id").alias("entity"))
    before = shuffled(spark)
    got = traverse.expand_entities(seeds, links, names, 2, ["USES"], 40)
    assert got.count() == 300 * 40
    assert shuffled(spark) - before < 150_000


def test_no_seeds_and_no_cut(spark):
    edges = spark.createDataFrame([("a", "USES", "b")], "src string, rel_type string, dst string")
    names = spark.createDataFrame([("b", "b", "k")], "entity string, name string, type string")
    seeds = spark.createDataFrame([("q", "a")], "query_id string, entity string")
    assert [tuple(r) for r in traverse.expand_entities(seeds, edges, names, 2, ["USES"], 3).collect()] == [("q", "b", "b", "k", 1, 1, 1)]
    for s, n in ((seeds.limit(0), 3), (seeds, 0)):
        assert traverse.expand_entities(s, edges, names, 2, ["USES"], n).collect() == []
    assert traverse.expand_entities(seeds, edges, names, 2, [], 3).collect() == []


def test_nodes_on_the_way_are_no_rows_of_a_query(spark):
    """400 queries from 3 entities over 2,000 documents: before, each query had a row for each document."""
    n = F.col("id")
    links = spark.range(2000).select(F.concat(F.lit("d"), n).alias("src"), F.lit("USES").alias("rel_type"), F.explode(F.array(F.concat(F.lit("a"), n % 3), F.concat(F.lit("b"), n % 5))).alias("dst"))
    names = links.select(F.col("dst").alias("entity"), F.col("dst").alias("name"), F.lit("k").alias("type")).distinct()
    seeds = spark.range(400).select(n.alias("query_id"), F.explode(F.array(F.lit("a0"), F.lit("a1"), F.lit("b1"))).alias("entity"))
    before = shuffled(spark)
    got = traverse.expand_entities(seeds, links, names, 2, ["USES"], 40).filter("query_id = 7")
    assert {(r.entity, r.hop, r.n_seeds) for r in got.collect()} == {("a2", 2, 1), ("b0", 2, 2), ("b2", 2, 2), ("b3", 2, 2), ("b4", 2, 2)}
    assert shuffled(spark) - before < 60_000


def test_chunks_of_entities_are_not_compared_once_joined(spark):
    """Mentions are made distinct before the join: before, all rows of the result were held against each other after it."""
    x = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1)], "query_id long, entity string, rank int")
    m = spark.createDataFrame([("a", "c1"), ("a", "c1"), ("a", "c2"), ("b", "c1")], "entity string, chunk_id string")
    got = traverse.entity_chunks(x, m)
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1, "c1"), (1, "a", 1, "c2"), (1, "b", 2, "c1"), (2, "a", 1, "c1"), (2, "a", 1, "c2")]
    assert got._jdf.queryExecution().optimizedPlan().toString().startswith("Project")


def test_listings_tell_what_went_and_came(spark, sf_dir):
    old, new, gone, come = flow_queries._listings(spark, sf_dir)
    rows = [set(map(tuple, x.collect())) for x in (old, new, gone, come)]
    assert [x.count() for x in (old, new, gone, come)] == [len(x) for x in rows]
    assert rows[2] == rows[0] - rows[1] and rows[3] == rows[1] - rows[0] and all(rows)


def test_vectors_are_searched_once(spark, sf_dir, monkeypatch):
    """The hits of a retrieval are read by its seeds and by its merge; before, each read searched all vectors."""
    searched, search = spark.sparkContext.accumulator(0), flows.search.vector_topk

    def counted(queries, vectors, k):
        hits = search(queries, vectors, k)

        def passed(batches):
            for batch in batches:
                searched.add(batch.num_rows)
                yield batch

        return hits.mapInArrow(passed, hits.schema)

    monkeypatch.setattr(flows.search, "vector_topk", counted)
    found = flow_queries.QUERIES["retrieve_end_to_end"](spark, sf_dir)
    assert found.filter("source = 'vector'").count() == searched.value


def test_copies_are_no_candidates_each():
    """2,000 copies of a vector and 100 queries that are such copies: k rows of each query leave numpy, and ties go by key over all blocks."""
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(6000, 8)).astype(np.float32)
    rows[::3] = rows[0]
    keys = [f"{k:05d}" for k in rng.permutation(6000)]
    queries = np.concatenate((rows[:300:3], rows[1:300:3])).astype(np.float64)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + 2500]), pa.array(list(rows[k : k + 2500]))], names=["key", "embedding"]) for k in range(0, 6000, 2500)]
    got = pa.Table.from_batches(list(nearest(iter(batches), [str(q) for q in range(200)], queries, 7)))
    want = [(str(q), key) for q, x in enumerate(queries) for _, key in sorted(zip(((rows.astype(np.float64) - x) ** 2).sum(axis=1), keys))[:7]]
    assert list(zip(got["query_id"].to_pylist(), got["key"].to_pylist())) == want
