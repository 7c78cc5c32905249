import hashlib
import math
import re
from collections import Counter
from zlib import crc32

from cases import edge_docs, empty_docs

from quire.llm import resampling


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(feature):
    return crc32(feature.encode()) % 10_000


def brute(rows, target):
    """rows: (doc_id, text)."""
    s = Counter(bucket(f) for _, t in rows for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    out = []
    for k, text in rows:
        words, own = features(text)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    order = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for place, r in enumerate(order[: 25 * len(order) // 100], 1):
        r[4] = place
    return sorted(map(str, (tuple(r[:5]) for r in out)))


def drawn(docs, target):
    return sorted(str(tuple(r)) for r in resampling.resample(docs, target).collect())


def test_matches_brute_force(spark, sf_dir):
    docs, target = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    assert drawn(docs.repartition(7), target) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [r.text for r in target.collect()])


def test_edge_rows(spark):
    docs, target = edge_docs(spark), spark.createDataFrame([("the lazy dog runs",), (None,)], "text string")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert drawn(docs, target) == brute(rows, ["the lazy dog runs", None])
    assert drawn(docs, target.limit(0)) == brute(rows, [])
    assert drawn(empty_docs(spark), target) == []


def test_ties_and_repeats(spark):
    text = " ".join(f"w{k % 30}" for k in range(40))
    rows = [(k % 50 if k % 10 else None, text) for k in range(400)]
    got = drawn(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame([("w1 w2",)], "text string"))
    assert got == brute(rows, ["w1 w2"])


def test_features_are_counted_once_each(spark):
    texts = spark.createDataFrame([("A b a B",), ("a b",), (None,)], "text string")
    assert {r.feature: r.n for r in resampling.feature_counts(texts).collect()} == {"a": 3, "b": 3, "a b": 3, "b a": 1}


def test_the_draw_leans_to_the_target(spark):
    rows = [(k, " ".join(("likely" if k % 4 == 0 else "other") + str(j % 9) for j in range(30 + k % 5))) for k in range(400)]
    target = spark.createDataFrame([(rows[0][1],), (rows[4][1],)], "text string")
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), target).filter("rank is not null").collect()
    assert len(got) == 100 and sum(r.doc_id % 4 == 0 for r in got) > 60  # an even draw would have 25
