import random
from collections import defaultdict

from pyspark.sql import functions as F

from quire.operators import graph, resolve, select, traverse
from quire.plans import flows
from quire.schemas import CHUNKS, EXTRACTIONS
from quire.sources.files import abbreviations


def papers(spark, rows):
    """rows: filename to (entities, relations, performances, mentions)."""
    return spark.createDataFrame(
        [(f, "h", t, 2, [{"type": a, "name": b} for a, b in e], [dict(zip(("head", "relation", "tail"), r)) for r in rel], [dict(zip(("chunk_index", "method", "metric", "value", "condition", "dataset"), p)) for p in perf], [{"chunk_index": k, "type": a, "name": b} for k, a, b in men], len(men), len(perf)) for f, t, e, rel, perf, men in rows],
        EXTRACTIONS,
    )


def chunk_rows(spark, ids):
    return spark.createDataFrame([(i, i.rsplit("::", 1)[0], int(i.rsplit("::", 1)[1]), "t", {}, "text") for i in ids], CHUNKS)


def short_forms(spark):
    return abbreviations(spark.createDataFrame([(0, "cnn", "Convolutional Neural Network")], "place int, short string, full_name string"))


def canon(spark, names):
    rows = spark.createDataFrame([(f, n, "Method") for f, n in names], "filename string, name string, type string")
    return {r.norm_key: r.canonical for r in resolve.entity_index(rows, short_forms(spark)).collect()}


def test_canonical_names(spark):
    assert canon(spark, [("a", "BERT"), ("a", "bert"), ("a", "Bert")]) == {"bert": "Bert"}
    assert canon(spark, [("a", "BERT"), ("a", "bert")]) == {"bert": "bert"}
    assert canon(spark, [("a", "bert"), ("b", "bert"), ("c", "bert"), ("d", "Bert")]) == {"bert": "bert"}
    got = canon(spark, [("f1", "CNN"), ("f1", "Convolutional Neural Network"), ("f2", "convolutional neural network")])
    assert got == {"convolutional neural network": "Convolutional Neural Network"}


def build(spark, rows, ids):
    return graph.build(papers(spark, rows), chunk_rows(spark, ids), short_forms(spark))


def test_fallback_is_the_first_met(spark):
    def names(a, b, results=()):
        rows = [("f1", "t", [], [("x", "USES", a)], list(results), []), ("f2", "t", [], [("x", "USES", b)], [], [])]
        return {r.name for r in build(spark, rows, []).entities.filter("type = 'Method'").collect()}

    assert names("LoRA", "lora") == {"LoRA"} and names("lora", "LoRA") == {"lora"}
    assert names("LoRA", "x", [(0, "LORA", "F1", "1", "", "")]) == {"LORA", "x"}


def test_dangling_rows_and_results(spark):
    rows = [
        ("p.md", "", [("Method", "M")], [("any", "USES", "m"), ("M", "EVALUATED_ON", "D"), ("M", "UNKNOWN", "D")], [(0, "M", "Acc", " 90.5% ", "", "D"), (0, "M", "Acc", " ", "", "D"), (0, "", "Acc", "7", "c", " "), (0, "M", "Acc", "90.5%", "", "D")], [(0, "Method", "m"), (0, "Method", "M"), (9, "Method", "M")]),
    ]
    g = build(spark, rows, ["p.md::0", "q.md::0"])
    edges = {(r.src_key.replace("\u001f", ":"), r.rel_type, r.dst_key.replace("\u001f", ":")) for r in g.edges.collect()}
    assert g.papers.first().title == "p.md" and [r.chunk_id for r in g.chunks.collect()] == ["p.md::0"]
    assert {e for e in edges if e[1] in ("USES", "EVALUATED_ON", "MENTIONED_IN", "PART_OF", "UNKNOWN")} == {("p.md", "USES", "Method:M"), ("Method:M", "EVALUATED_ON", "Dataset:D"), ("Method:M", "MENTIONED_IN", "p.md::0"), ("p.md::0", "PART_OF", "p.md")}
    results = {(r.value, r.value_num, r.condition, r.dataset) for r in g.results.collect()}
    assert results == {("90.5%", 90.5, "", "D"), ("7", 7.0, "c", "")}
    assert sum(e[1] == "ON_DATASET" for e in edges) == 1 and sum(e[1] == "HAS_RESULT" for e in edges) == 2
    assert ("Method:", "REPORTED") in {e[:2] for e in edges}  # an empty method is an entity with an empty name


def test_rebuilding_changes_nothing(spark):
    rows = [("p.md", "t", [("Method", "M"), ("Task", "T")], [("x", "USES", "M"), ("x", "TARGETS", "t")], [], [(0, "Method", "M")])]
    one = build(spark, rows, ["p.md::0"])
    two = graph.upsert_graph(one, build(spark, rows, ["p.md::0"]))
    for a, b in zip(one.tables().values(), two.tables().values()):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert {r.label: r.n for r in graph.node_counts(graph.node_keys(one)).collect()} == {"Paper": 1, "Entity": 2, "Chunk": 1}
    assert {r.rel_type: r.n for r in graph.edge_counts(one.edges).collect()} == {"USES": 1, "TARGETS": 1, "PART_OF": 1, "MENTIONED_IN": 1}


ALLOWED = ["USES", "TARGETS", "EVALUATED_ON", "REPORTED", "APPLIES_TO", "INVOLVES", "OF_METRIC", "ON_DATASET"]
SMALL = [("P1", "USES", "M1"), ("P1", "USES", "M2"), ("P1", "TARGETS", "T1"), ("M1", "EVALUATED_ON", "D1"), ("M2", "EVALUATED_ON", "D1"), ("M1", "REPORTED", "R1"), ("R1", "OF_METRIC", "A1"), ("R1", "ON_DATASET", "D1"), ("P1", "HAS_RESULT", "R1"), ("M3", "APPLIES_TO", "S1"), ("S1", "INVOLVES", "T1")]


def expand(spark, edges, names, seeds, hops, allowed=ALLOWED):
    e = spark.createDataFrame(edges, "src string, rel_type string, dst string")
    n = spark.createDataFrame([(x, x, "k") for x in names], "entity string, name string, type string")
    s = spark.createDataFrame([("q", x) for x in seeds], "query_id string, entity string")
    return [(r.name, r.hop, r.n_seeds) for r in traverse.expand_entities(s, e, n, hops, allowed).orderBy("rank").collect()]


def test_expansion(spark):
    names = ["M1", "M2", "M3", "T1", "D1", "A1", "S1"]
    assert expand(spark, SMALL, names, ["M1"], 1) == [("D1", 1, 1)]
    assert expand(spark, SMALL, names, ["M1"], 2) == [("D1", 1, 1), ("A1", 2, 1), ("M2", 2, 1), ("T1", 2, 1)]
    assert expand(spark, SMALL, names, ["M1", "T1"], 2) == [("D1", 1, 1), ("S1", 1, 1), ("M2", 2, 2), ("A1", 2, 1), ("M3", 2, 1)]
    assert expand(spark, SMALL, names, [], 2) == [] and expand(spark, SMALL, names, ["M1"], 2, []) == []
    assert expand(spark, SMALL, names, ["M1"], 5) == expand(spark, SMALL, names, ["M1"], 2)


def test_expansion_matches_path_enumeration(spark):
    rng = random.Random(1)
    nodes = [f"n{k}" for k in range(25)]
    edges = sorted({(rng.choice(nodes), "USES", rng.choice(nodes)) for _ in range(60)})
    edges = [e for k, e in enumerate(edges) if e[0] != e[2] and (e[2], "USES", e[0]) not in edges[:k]]
    names, seeds = nodes[:18], nodes[:3]
    near = defaultdict(list)
    for k, (a, _, b) in enumerate(edges):
        near[a].append((b, k))
        near[b].append((a, k))
    found = defaultdict(set)
    for s in seeds:
        for a, k in near[s]:
            found[a].add((s, 1))
            for b, j in near[a]:
                if j != k:
                    found[b].add((s, 2))
    want = sorted(((min(h for _, h in v), -len({s for s, _ in v}), n) for n, v in found.items() if n in names and n not in seeds))
    assert expand(spark, edges, names, seeds, 2) == [(n, h, -m) for h, m, n in want]


def greedy(rows: list[tuple], quota: int, cap: int) -> list[tuple]:
    """rows (rank, chunk_id, ...) in order: a chunk once, at most quota for each rank, at most cap in all."""
    taken, used, out = set(), {}, []
    for row in rows:
        if len(out) >= cap:
            break
        if row[1] in taken or used.get(row[0], 0) >= quota:
            continue
        taken.add(row[1])
        used[row[0]] = used.get(row[0], 0) + 1
        out.append(row)
    return out


def test_quota_selection(spark):
    given = [(0, "a::1"), (0, "a::2"), (0, "a::3"), (1, "a::2"), (1, "a::3"), (1, "b::0"), (2, "a::1"), (2, "c::0"), (2, "c::1")]
    df = spark.createDataFrame([("q", *r) for r in given], "query_id string, rank int, chunk_id string")
    got = [(r["rank"], r.chunk_id) for r in select.quota_select(df, 2, 4).orderBy("position").collect()]
    assert got == [(0, "a::1"), (0, "a::2"), (1, "a::3"), (1, "b::0")]


def test_quota_selection_matches_the_unpruned_walk(spark):
    rng = random.Random(2)
    cases = {q: sorted({(rng.randrange(6), f"f::{rng.randrange(12)}") for _ in range(40)}) for q in range(60)}
    df = spark.createDataFrame([(q, *r) for q, rows in cases.items() for r in rows], "query_id int, rank int, chunk_id string")
    for quota, cap in ((1, 2), (2, 5), (3, 20), (2, 0)):
        got = defaultdict(list)
        for r in select.quota_select(df, quota, cap).orderBy("query_id", "position").collect():
            got[r.query_id].append((r["rank"], r.chunk_id))
        assert dict(got) == {q: w for q, rows in cases.items() if (w := greedy(rows, quota, cap))}


def test_merge_rank_and_filter(spark):
    v = spark.createDataFrame([("q", "x", 0), ("q", "y", 1)], "query_id string, chunk_id string, position int")
    g = spark.createDataFrame([("q", "y", 0), ("q", "z", 1)], "query_id string, chunk_id string, position int")
    merged = select.merge_dedup(v, g)
    assert [(r.chunk_id, r.source) for r in merged.orderBy("merged_pos").collect()] == [("x", "vector"), ("y", "vector"), ("z", "graph")]
    assert tuple(select.source_counts(v, g).first()) == ("q", 2, 2)
    scored = merged.withColumn("rerank_score", F.when(F.col("chunk_id") == "y", 0.9).otherwise(0.2))
    assert [r.chunk_id for r in select.rank_by_score(scored).orderBy("rank").collect()] == ["y", "x", "z"]
    texts = ["NONE", "NONE。", " NONE.. ", "NONE of it", "FAIL: x", " FAIL: x", "good"]
    df = spark.createDataFrame([("q", k, t, "f") for k, t in enumerate(texts)], "query_id string, rank int, text string, filename string")
    kept = select.renumber(df.filter(select.is_relevant(F.col("text"), "NONE", "FAIL")))
    assert [(r.number, r.text) for r in kept.orderBy("number").collect()] == [(1, "NONE of it"), (2, " FAIL: x"), (3, "good")]
    assert select.cited_points(kept).first().points.startswith("[1] source: f\nNONE of it\n\n[2]")


def test_a_build_shuffles_no_edge_to_look_for_its_ends(spark):
    """Results with separators in their fields share an id, which stays one node; the others need no shuffle of their edges."""
    results = [(0, "a|b", "c", "1", "", ""), (0, "a", "b|c", "1", "", ""), (0, "M", "Acc", "2", "", "D"), (0, "M", "Acc", "2", "", "D")]
    g = build(spark, [("p.md", "t", [], [("M", "EVALUATED_ON", "D"), ("M", "EVALUATED_ON", "D")], results, [(0, "Method", "M"), (7, "Method", "M")])], ["p.md::0"])
    edges = [tuple(r) for r in g.edges.collect()]
    assert len(edges) == len(set(edges)) and set(edges) == {tuple(r) for r in graph.connected(g, g.edges).collect()}
    assert g.results.count() == 2 and sum(e[2] == "REPORTED" for e in edges) == 3 and sum(e[2] == "HAS_RESULT" for e in edges) == 2
    assert sum(e[2] == "MENTIONED_IN" for e in edges) == 1
    plan = g.edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 3  # papers of chunks, twice, and chunks of mentions


def test_the_first_place_is_that_of_whole_names(spark):
    """File names that begin alike, or are null-like short, are told apart by the rest."""
    rows = [(f, "t", [], [("x", "USES", name)], [], []) for f, name in (("a-long-name-2", "lora"), ("a-long-name-1", "LoRA"), ("b", "LORA"))]
    assert [r.name for r in build(spark, rows, []).entities.collect()] == ["LoRA"]
    order = ["", "a", "aé", "b", "é", "\U0001f600"]
    df = spark.createDataFrame([(x,) for x in [None, *order]], "f string")
    assert [r.f for r in df.orderBy(resolve.begin(F.col("f"))).collect()] == [None, *order]


def test_merge_shuffles_rows_once(spark):
    """Both windows of a merge are of a query; before, rows were shuffled by query and chunk, and then by query."""
    rows = spark.createDataFrame([("q", None, 2), ("q", "a", 1), ("q", "a", 3), ("q", None, 4), (None, "a", 1)], "query_id string, chunk_id string, position int")
    merged = select.merge_dedup(rows, rows.withColumn("position", F.col("position") + 10))
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(str, merged.select("query_id", "chunk_id", "source", "merged_pos").collect())) == sorted(map(str, spark.createDataFrame([("q", "a", "vector", 0), ("q", None, "vector", 1), (None, "a", "vector", 0)], "query_id string, chunk_id string, source string, merged_pos int").collect()))


def test_upsert_leaves_out_what_dangles_in_its_own_graph(spark):
    """The ends of an edge must be in the graph that names it, and edges are made distinct once, after that; before, each graph's were, and then both."""

    def made(entities, edges):
        nodes = {"papers": [("p", "t")], "entities": [(n, "Method") for n in entities], "chunks": [], "results": []}
        whole = {n: spark.createDataFrame(rows, flows.GRAPH_SCHEMAS[n]) for n, rows in nodes.items()}
        return graph.Graph(**whole, edges=spark.createDataFrame([("Paper", p, "USES", "Entity", f"Method\u001f{n}") for p, n in edges], flows.GRAPH_SCHEMAS["edges"]))

    old, new = made("ab", [("p", "a"), ("p", "a"), ("p", "c"), ("x", "a")]), made("bc", [("p", "a"), ("p", "b"), ("p", "b")])
    got = graph.upsert_graph(old, new, dangling=True).edges
    assert got._jdf.queryExecution().executedPlan().toString().count("HashAggregate") == 2
    assert sorted(r["dst_key"][-1] for r in got.collect()) == ["a", "b"]
