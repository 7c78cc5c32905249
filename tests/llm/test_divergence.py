import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import edge_docs, empty_docs

from quire.llm import divergence
from quire.llm.terms import byte_class, coded_words


def brute(rows, least, most=50):
    """rows: (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = {k: k + 32 for k in range(65, 91)}
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)) for _, _, t in rows]
    df, n, groups = Counter(), Counter(), defaultdict(set)
    for (lang, source, _), ws in zip(rows, words):
        groups[lang].add(source)
        df.update((lang, w) for w in set(ws))
        n.update((lang, source, w) for w in ws)
    out = []
    for lang, sources in groups.items():
        kept = sorted((w for (x, w), k in df.items() if x == lang and k >= least), key=str.encode)

        def shares(count):
            whole = sum(count[w] for w in kept) + 5 * len(kept)
            return {w: 1 + 10**9 * (count[w] + 5) // whole for w in kept}

        p = {s: shares({w: n[lang, s, w] for w in kept}) for s in sources}
        q = shares({w: sum(n[lang, s, w] for s in sources) for w in kept})
        for s in sources:
            pairs = sorted(((sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((p[s][w] - q[w], w) for w in kept if n[lang, s, w] and p[s][w] > q[w]), key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, s, part, item, v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def audited(docs, *given):
    return sorted(map(tuple, divergence.audit(docs, *given).collect()))


def test_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("lang", "source", "text").collect()]
    assert audited(docs, 5) == brute(rows, 5)
    assert audited(docs) == brute(rows, 30)


def test_edge_rows(spark):
    docs = edge_docs(spark)
    rows = [tuple(r) for r in docs.select("lang", "source", "text").collect()]
    got = audited(docs, 2, 10)
    assert got == brute(rows, 2, 10)
    assert ("", "", "pair") not in {r[:3] for r in got}  # a source alone in its language has no pair
    assert {r[4] for r in audited(docs, 10**6)} == {0}  # nothing kept
    assert audited(empty_docs(spark)) == []


@pytest.mark.parametrize("width, block", [(8, 3), (64, 1)])
def test_chunks_and_blocks(spark, sf_dir, monkeypatch, width, block):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    rows = [tuple(r) for r in docs.select("lang", "source", "text").collect()]
    monkeypatch.setattr(divergence, "WIDTH", width)
    monkeypatch.setattr(divergence, "BLOCK", block)
    # The functions that workers import keep their own constants, so that they are given by value here.
    import types

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(divergence)
    try:
        assert isinstance(divergence, types.ModuleType) and audited(docs, 3) == brute(rows, 3)
    finally:
        cloudpickle.unregister_pickle_by_value(divergence)


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    count = rng.integers(0, 9 * 10**14, 200)
    total = count + rng.integers(0, 10**14, 200)
    got = divergence.share(count, total, 7, np.floor_divide)
    assert got.tolist() == [1 + 10**9 * (int(c) + 5) // (int(t) + 35) for c, t in zip(count, total)]


def test_words_of_bytes():
    import pyarrow as pa

    texts = pa.array(["x", None, "A1b c-D é漢字Σ", "", "aa", "aa!", " aa"]).slice(1)
    for ranges, pattern in (((), r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), ((("0", "9"),), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        codes, names, sizes = coded_words(texts, byte_class(*ranges))
        got = [names[int(c)].as_py().decode() for c in codes]
        want = [re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts.to_pylist()]
        assert got == sum(want, []) and sizes.tolist() == [len(w) for w in want]
