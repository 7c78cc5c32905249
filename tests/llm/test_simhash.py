import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from cases import SCHEMA, edge_docs, edge_rows, empty_docs, near_texts

from quire.llm import simhash
from quire.llm.components import _contract, components


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(nodes):
    """Smallest id reachable, over all pairs."""
    label = {k: k for k in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if (nodes[a] ^ nodes[b]).bit_count() <= 3 and label[a] < label[b]:
                    label[b], changed = label[a], True
    return label


def test_fingerprints_match_brute_force():
    for _, text, *_ in edge_rows():
        assert simhash.fingerprint(None if text is None else text.encode()) == brute_print(text)


@pytest.mark.parametrize("split", [simhash.SPLIT, 3])
def test_links_connect_what_brute_force_connects(spark, split):
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(12)]
    for base in list(values):
        for _ in range(12):
            x = base
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
            values.append(x)
    values = sorted(set(values + [0, 1, 7, 15, (1 << 64) - 1]))
    rows = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    links = simhash.link_buckets(spark.createDataFrame(rows, "fp long"), split=split)
    roots = {r.node: r.root for r in components(links).collect()}
    ids = {r[0]: v for r, v in zip(rows, values)}
    want = brute_classes(ids)
    assert {k: roots.get(k, k) for k in ids} == want


def test_documents_match_brute_force(spark):
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(near_texts(200))]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = {r[0]: brute_print(r[1]) for r in rows}
    want = brute_classes(prints)
    assert got == {k: (f"{prints[k]:016x}", want[k]) for k in prints}
    assert len(set(want.values())) < len(want)


def test_edge_rows_and_empty(spark):
    got = simhash.near_duplicates(edge_docs(spark)).collect()
    assert len(got) == len(edge_rows())
    by = {r.doc_id: r.component_id for r in got}
    assert by[1] == by[2] == by[3] == 1 and by[None] == 5 and by[139] == 100
    assert simhash.near_duplicates(empty_docs(spark)).collect() == []


def test_forest_spans_without_all_pairs():
    rng = np.random.default_rng(1)
    base = np.uint64(123456789)
    values = np.unique(base ^ (np.uint64(1) << rng.integers(0, 6, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 6, 400).astype(np.uint64)))
    left, _ = simhash.forest(values, np.empty(0, np.uint64))
    wide = np.stack([values, values], axis=1)
    assert len(simhash.forest(wide, wide[:3], 6)[0]) == len(values) + 2
    assert len(left) == len(values) - 1


def test_components_of_a_chain_and_a_hub(spark):
    links = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1300)] + [(5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long").repartition(6)).collect()}
    assert got == {k: 0 for k in range(1, 301)} | {k: 1000 for k in range(1001, 1300)}


@pytest.mark.parametrize("heavy", [1 << 20, 20, 3])
def test_components_with_heavy_nodes_dealt_out(spark, heavy):
    rng = random.Random(2)
    links = [(1000, k) for k in range(1001, 1200)] + [(k, 0) for k in range(1100, 1110)] + [(rng.randrange(5000, 6000), rng.randrange(5000, 6000)) for _ in range(800)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long").repartition(6), heavy=heavy).collect()}
    nodes = sorted({x for link in links for x in link})
    place = {x: k for k, x in enumerate(nodes)}
    roots = classes(len(nodes), [(place[a], place[b]) for a, b in links])
    assert got == {x: nodes[r] for x, r in zip(nodes, roots) if nodes[r] != x}


def test_contraction_gives_out_its_stars_when_full():
    links = [(k, k + 1) for k in range(0, 4000, 2)] + [(k, k + 2) for k in range(0, 3998, 2)]
    batches = [pa.RecordBatch.from_arrays([pa.array([a for a, _ in links[k : k + 100]]), pa.array([b for _, b in links[k : k + 100]])], names=["u", "v"]) for k in range(0, len(links), 100)]
    stars = [(a, b) for made in _contract(iter(batches), 500) for a, b in zip(*(c.to_pylist() for c in made.columns))]
    assert len(set(classes(4001, stars))) == 2  # the last node has no link


def wide_rows(values):
    return [(k, *np.array(v, dtype=np.uint64).view(np.int64).tolist()) for k, v in enumerate(values)]


@pytest.mark.parametrize("split", [simhash.WIDE_SPLIT, 20])
def test_wide_links_connect_classes(spark, split):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (25, 4), dtype=np.uint64)
    values, owner = [], []
    for k, b in enumerate(base):
        for _ in range(12):
            v = b.copy()
            for bit in rng.choice(256, rng.integers(0, 20), replace=False):
                v[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
            values.append(v)
            owner.append(k)
    links = simhash.wide_links(spark.createDataFrame(wide_rows(values), "id long, f0 long, f1 long, f2 long, f3 long").repartition(3), split=split)
    pairs = [tuple(r) for r in links.collect()]
    assert all((np.bitwise_count(values[u] ^ values[v]).sum() <= simhash.WIDE_DISTANCE) and owner[u] == owner[v] for u, v in pairs)
    roots = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    named = [roots.get(k, k) for k in range(len(values))]
    assert len(set(named)) == 25 and len({(a, b) for a, b in zip(named, owner)}) == len(set(named))


def test_representatives_follow_jaccard(spark):
    texts = near_texts(300, 7) + ["", None, "  ", "solo words", "solo words", "x" * 3000]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], SCHEMA)
    kept = {r.doc_id for r in simhash.representatives(docs).collect()}

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets = [shingles(t) for t in texts]
    similar = [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in range(len(texts)) for b in range(a) if sets[a] & sets[b]]
    caught = [a not in kept or b not in kept for a, b, j in similar if j >= 0.8]
    assert len(caught) > 100 and sum(caught) >= 0.97 * len(caught)
    lonely = set(range(len(texts))) - {k for a, b, j in similar if j >= 0.8 for k in (a, b)}
    assert lonely <= kept
    assert simhash.representatives(empty_docs(spark)).collect() == []
    assert simhash.representatives(edge_docs(spark)).columns == edge_docs(spark).columns


def test_a_dense_class_gives_few_candidates_and_stays_one_class(spark):
    """A thousand variants of one fingerprint: candidates grow with the rows, not with their square."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    values = []
    for _ in range(1000):
        v = base.copy()
        for bit in rng.choice(256, rng.integers(0, 12), replace=False):
            v[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        values.append(v)
    links = [tuple(r) for r in simhash.wide_links(spark.createDataFrame(wide_rows(values), "id long, f0 long, f1 long, f2 long, f3 long").distinct()).collect()]
    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert len(links) < 100 * len(values)
    assert set(roots.values()) == {0} and len(roots) == len(values) - 1


def sets_of(texts):
    words = [t.split() for t in texts]
    return [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]


def jaccard(a, b):
    return len(a & b) / len(a | b)


def classes(n, linked):
    """Smallest place reachable over the pairs."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return [root(k) for k in range(n)]


def hub_texts(variants, hub_at, edits=8, length=400, seed=4):
    """A text and variants of it, each with its own words at places far from each other."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**9)}" for _ in range(length)]
    texts = []
    for v in range(variants):
        words, shift = list(base), rng.randrange(length)
        for k in rng.sample(range(length // 10), edits):
            words[(10 * k + shift) % length] = f"v{v}x{k}"
        texts.append(" ".join(words))
    texts.insert(hub_at, " ".join(base))
    return texts


def test_a_hub_joins_variants_that_are_not_similar_to_each_other(spark):
    texts, hub = hub_texts(1000, 700), 700
    sets = sets_of(texts)
    assert all(0.8 <= jaccard(sets[hub], s) <= 0.87 for s in sets[:hub] + sets[hub + 1 :])
    assert all(jaccard(sets[k], sets[k + 1]) < 0.8 for k in range(0, hub - 1, 7))
    similar = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], SCHEMA)
    assert simhash.representatives(docs).count() == len(set(classes(len(texts), similar))) == 1


def test_variants_without_their_hub_stay(spark):
    texts = hub_texts(300, 0)[1:]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], SCHEMA)
    assert simhash.representatives(docs).count() == len(texts)


@pytest.mark.parametrize("most", [simhash.GROUP_BYTES, 20_000])
def test_exact_links_equal_brute_force(spark, most):
    texts = near_texts(200, 11) + hub_texts(40, 20, seed=5)
    sets = sets_of(texts)
    want = classes(len(texts), [(a, b) for a in range(len(sets)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8])
    rows = spark.createDataFrame([(k, t.encode()) for k, t in enumerate(texts)], "row long, text binary")
    groups = spark.createDataFrame([(k, k // 200) for k in range(len(texts))], "node long, root long")
    links = [tuple(r) for r in simhash.exact_links(groups, rows, most=most).collect()]
    assert all(jaccard(sets[a], sets[b]) >= 0.8 for a, b in links)
    split = [k // 200 for k in range(len(texts))]
    assert classes(len(texts), links) == want and all(split[a] == split[b] for a, b in links)


def loose_classes(values):
    """Over all pairs within the distance that have a segment equal up to one bit."""
    cut = simhash.segments(np.stack(values))
    linked = []
    for a in range(len(values)):
        near = np.bitwise_count(np.stack(values[:a] or [values[0]]) ^ values[a]).sum(axis=1) <= simhash.WIDE_DISTANCE
        for b in np.flatnonzero(near[:a]).tolist():
            if (np.bitwise_count(cut[a] ^ cut[b]) <= 1).any():
                linked.append((a, b))
    return classes(len(values), linked)


def spread_values():
    """Families around a few fingerprints, some of whose members lie just within the distance of few others."""
    rng = np.random.default_rng(8)
    values = []
    for base in rng.integers(0, 1 << 63, (8, 4), dtype=np.uint64):
        for k in range(40):
            v = base.copy()
            for bit in rng.choice(256, 2 * k, replace=False):
                v[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
            values.append(v)
    return values


def test_every_row_asks(spark):
    values = spread_values()
    frame = spark.createDataFrame(wide_rows(values), "id long, f0 long, f1 long, f2 long, f3 long").repartition(3)
    links = [tuple(r) for r in simhash.wide_links(frame).collect()]
    assert classes(len(values), links) == loose_classes(values)


@pytest.mark.parametrize("split", [200, 20, 6])
def test_crowded_buckets_are_split_without_loss(spark, split):
    """Equal classes at every split, also of a star, whose rows meet through the hub alone."""
    rng = np.random.default_rng(6)
    values, star = spread_values()[:160], rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    for _ in range(120):
        v = star.copy()
        for bit in rng.choice(256, 40, replace=False):
            v[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        values.append(v)
    values.append(star)
    frame = spark.createDataFrame(wide_rows(values), "id long, f0 long, f1 long, f2 long, f3 long").repartition(3)
    links = [tuple(r) for r in simhash.wide_links(frame, split=split).collect()]
    assert classes(len(values), links) == loose_classes(values)


def templated_texts(families, own, length=400, seed=3):
    """Texts of one template, each with a run of its own words in one place, and after each a copy with one word changed."""
    rng, texts = random.Random(seed), []
    base = [f"w{rng.randrange(10**9)}" for _ in range(length)]
    for v in range(families):
        words, at = list(base), 100
        words[at : at + own] = [f"u{v}x{k}" for k in range(own)]
        copy = list(words)
        copy[rng.randrange(length)] = f"c{v}"
        texts += [" ".join(words), " ".join(copy)]
    return texts


@pytest.mark.parametrize(("own", "mutual"), [(46, 0.776), (52, 0.752), (90, 0.616)])
def test_copies_within_one_template_are_found(spark, own, mutual):
    """3,000 texts that share a template, and a copy of each: the copies go, and texts that are not similar enough stay."""
    texts = templated_texts(3000, own)
    sets = sets_of(texts[:100])
    assert abs(jaccard(sets[0], sets[40]) - mutual) < 0.001
    assert min(jaccard(sets[k], sets[k + 1]) for k in range(0, 100, 2)) >= 0.95
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], SCHEMA).repartition(4)
    kept = {r.doc_id for r in simhash.representatives(docs).collect()}
    assert {k // 2 for k in kept} == set(range(3000)) and len(kept) <= 3030


def test_unequal_sets_with_equal_fingerprints_meet_in_a_group(spark):
    value = np.arange(4, dtype=np.uint64)
    frame = spark.createDataFrame(wide_rows([value, value, value + np.uint64(1 << 60)]), "id long, f0 long, f1 long, f2 long, f3 long")
    assert {r.node: r.root for r in simhash.loose_groups(frame).collect()} == {0: 0, 1: 0, 2: 0}


def test_columns_of_any_name_are_kept(spark):
    docs = edge_docs(spark)
    for name in ("near row", "NEAR ROW_", "row", "id", "d0", "f0", "group", "node", "root", "grace digest", "a.b"):
        docs = docs.withColumn(name, docs["doc_id"])
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert all(r["near row"] == r["NEAR ROW_"] == r["doc_id"] == r["a.b"] for r in kept.collect())
