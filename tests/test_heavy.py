import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quire.operators import heavy, select, traverse


def test_join_with_heavy_keys(spark):
    rng = random.Random(1)
    left = [(0 if k % 2 else rng.randrange(60), k) for k in range(3000)]
    right = [(rng.choice((0, 1, 1, 1)) if k % 3 else rng.randrange(80), -k) for k in range(300)]
    one, two = spark.createDataFrame(left, "key long, a long"), spark.createDataFrame(right, "key long, b long")
    own = defaultdict(list)
    for k, b in right:
        own[k].append(b)
    want = Counter((k, a, b) for k, a in left for b in own[k])
    for most in (50, 10**6):
        assert Counter(map(tuple, heavy.heavy_join(one, two, "key", most).select("key", "a", "b").collect())) == want


def test_half_of_all_edges_at_one_node(spark):
    """The rows of a hub are dealt out, so that no cell of the join has many from either side."""
    left = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id")).alias("node"), F.col("id").alias("q"))
    right = spark.range(4000).select(F.when(F.col("id") % 2 == 1, F.lit(0)).otherwise(F.col("id")).alias("node"), F.col("id").alias("dst"))
    keys = heavy.heavy_keys(left, right, "node", 100)
    assert [(r.node, r.parts, r.blocks) for r in keys.collect()] == [(0, 20, 21)]
    for side, own, other, a, b in ((left, "part", "block", "parts", "blocks"), (right, "block", "part", "blocks", "parts")):
        cells = heavy._dealt(side, keys, "node", own, other, a, b).groupBy("node", "part", "block").count()
        assert cells.agg(F.max("count")).first()[0] < 160  # about 100 by a hash; 2,000 if the hub were one cell
    assert heavy.heavy_join(left, right, "node", 100).count() == left.join(right, "node").count() == 2000 * 2001


def test_few_keys_are_sent(spark, monkeypatch):
    monkeypatch.setattr(heavy, "KEYS", 3)
    one = spark.range(900).select((F.col("id") % 30).alias("key"), "id")
    two = spark.range(60).select((F.col("id") % 30).alias("key"), F.col("id").alias("b"))
    assert heavy.heavy_keys(one, two, "key", 10).count() <= 6
    assert heavy.heavy_join(one, two, "key", 10).count() == 1800


def test_more_seeds_than_one_word(spark):
    rng = random.Random(5)
    edges = sorted({(f"n{rng.randrange(300)}", "USES", f"n{rng.randrange(300)}") for _ in range(900)})
    names = [f"n{k}" for k in range(300)]
    seeds = {"a": names[:150], "b": names[140:280], "c": names[:1]}
    near = defaultdict(set)
    for a, _, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = set()
    for q, own in seeds.items():
        reached, first = defaultdict(set), {}
        for s in own:
            for x in near[s]:
                reached[x].add(s)
                first[x] = 1
        for s in own:
            for x in near[s]:
                for y in near[x] - {s}:
                    reached[y].add(s)
                    first.setdefault(y, 2)
        want |= {(q, n, first[n], len(s)) for n, s in reached.items() if n not in own}
    e = spark.createDataFrame(edges, "src string, rel_type string, dst string")
    s = spark.createDataFrame([(q, n) for q, own in seeds.items() for n in own], "query_id string, entity string")
    got = traverse.reach(s, e, 2, ["USES"]).collect()
    assert {(r.query_id, r.node, r.hop, r.n_seeds) for r in got} == want and len(got) == len(want)


def test_posting_lists_are_enough(spark):
    rng = random.Random(6)
    mentions = [(f"e{rng.randrange(12)}", f"c{rng.randrange(400):03d}") for _ in range(2000)] + [("hub", f"c{k % 400:03d}") for k in range(1500)]
    expanded = [(q, e, n) for q in range(20) for n, e in enumerate(rng.sample([f"e{k}" for k in range(12)] + ["hub"], 6), 1)]
    m = spark.createDataFrame(mentions, "entity string, chunk_id string").repartition(6)
    x = spark.createDataFrame(expanded, "query_id long, entity string, rank int")
    for quota, cap in ((3, 20), (1, 2), (2, 0)):
        posted = traverse.postings(m, select.needed(quota, cap))
        lists = {r.entity: r.chunk_ids for r in posted.collect()}
        assert all(v == sorted({c for e, c in mentions if e == k})[: select.needed(quota, cap)] for k, v in lists.items())
        whole = select.quota_select(traverse.entity_chunks(x, m), quota, cap)
        assert sorted(map(tuple, select.greedy(traverse.posted_chunks(x, posted), quota, cap).collect())) == sorted(map(tuple, whole.collect()))
    assert "WindowGroupLimit" in traverse.postings(m, 5)._jdf.queryExecution().executedPlan().toString()


def test_a_choice_looks_at_no_more_chunks_than_it_can_take(spark):
    """Forty entities with full lists: seven of them make the twenty, and each is looked at as far as others may have taken its chunks."""
    mentions = [(f"e{k:02d}", f"c{(5 * k + j) % 90:03d}") for k in range(40) for j in range(30)]
    posted = traverse.postings(spark.createDataFrame(mentions, "entity string, chunk_id string"), select.needed(3, 20))
    x = spark.createDataFrame([(q, f"e{(7 * q + r) % 40:02d}", r) for q in range(5) for r in range(1, 41)], "query_id long, entity string, rank int")
    cut, whole = traverse.posted_chunks(x, posted, limits=(3, 20)), traverse.posted_chunks(x, posted)
    assert {r["count"] for r in cut.groupBy("query_id").count().collect()} == {3 + 6 + 9 + 12 + 15 + 18 + 21}
    assert whole.count() == 5 * 40 * 22
    assert sorted(map(tuple, select.greedy(cut, 3, 20).collect())) == sorted(map(tuple, select.greedy(whole, 3, 20).collect()))


def test_the_cut_loses_nothing_where_lists_are_short(spark):
    rng = random.Random(8)
    mentions = [(f"e{rng.randrange(30)}", f"c{rng.randrange(25):02d}") for _ in range(140)] + [("hub", f"c{k:02d}") for k in range(25)]
    m = spark.createDataFrame(mentions, "entity string, chunk_id string")
    names = [*(f"e{k}" for k in range(30)), "hub", "unmentioned"]
    x = spark.createDataFrame([(q, e, n) for q in range(60) for n, e in enumerate(rng.sample(names, rng.randrange(1, 32)), 1)], "query_id long, entity string, rank int")
    for quota, cap in ((3, 20), (2, 7), (1, 2), (5, 3), (0, 4), (2, 0)):
        posted = traverse.postings(m, select.needed(quota, cap))
        cut, whole = (select.greedy(traverse.posted_chunks(x, posted, limits=limits), quota, cap) for limits in ((quota, cap), None))
        assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))
