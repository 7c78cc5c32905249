import hashlib
import random
import re

from cases import LONG, edge_docs, edge_rows, empty_docs
from pyspark.sql import functions as F

from quire.llm import fingerprints as fp


def hashes(text):
    units = re.findall(r"[^\x20\x09-\x0D]{1,16}", text)
    codes = [int(hashlib.md5(u.encode()).hexdigest()[:10], 16) for u in units]
    codes += [0] * (fp.GRAM - len(codes)) * bool(codes)
    out = []
    for k in range(len(codes) - fp.GRAM + 1):
        h = 0
        for c in codes[k : k + fp.GRAM]:
            h = (h * fp.BASE + c) % fp.PRIME
        out.append(h)
    return out


def brute(text):
    """Kept (hash, position): of each window the least, the rightmost of equal ones, each once."""
    h, kept = hashes(text), []
    for k in range(max(1, len(h) - fp.WINDOW + 1)) if h else ():
        own = range(k, min(len(h), k + fp.WINDOW))
        at = min(own, key=lambda j: (h[j], -j))
        if not kept or kept[-1] != (h[at], at):
            kept.append((h[at], at))
    return kept


def alike(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def winnowed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: list(zip(r.hashes, r.positions)) for r in fp.fingerprints(df).collect()}


def test_winnowing_matches_brute_force(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [r[1] for r in edge_rows()]
    rng = random.Random(3)
    texts += [" ".join(rng.choice("ab") for _ in range(n)) for n in (*range(40), 300)] + ["same " * 200]
    got = winnowed(spark, texts)
    assert all(got[k] == brute(t or "") for k, t in enumerate(texts))


def test_shared_passages_share_a_kept_hash(spark):
    """Any run of GRAM + WINDOW - 1 units in two texts has a kept hash at the same place of the run."""
    rng = random.Random(4)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(fp.GRAM + fp.WINDOW - 1)]
    texts, starts = [], []
    for _ in range(60):
        before, after = ([f"x{rng.randrange(10**9)}" for _ in range(rng.randrange(30))] for _ in range(2))
        starts.append(len(before))
        texts.append(" ".join(before + passage + after))
    got = winnowed(spark, texts)
    for k in range(1, 60):
        one, two = ({(h, p - starts[j]) for h, p in got[j] if 0 <= p - starts[j] < fp.WINDOW} for j in (0, k))
        assert one & two


def audit_brute(rows):
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{'-' if r[0] is None else r[0]} {r[1]}".encode()).digest()))
    out = []
    for k, (doc, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = brute(text), brute(edited), brute(after)
        spell = lambda x: " ".join(f"{h:010x}" for h, _ in x)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), spell(a), spell(b), alike(a, b), alike(a, c)))
    return sorted(map(str, out))


def audited(docs):
    kept = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return sorted(str(tuple(r)) for r in fp.edit_audit(docs).select(kept).collect())


def test_audit_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id % 3 <> 1").repartition(5)
    assert audited(docs) == audit_brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_audit_of_edge_rows(spark):
    assert audited(edge_docs(spark)) == audit_brute([r[:2] for r in edge_rows()])
    assert audited(empty_docs(spark)) == []
    one = [(7, LONG[:5000])]
    assert audited(spark.createDataFrame(one, "doc_id long, text string")) == audit_brute(one)
    repeated = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words"), (None, None), (None, None), (2, "z")]
    assert audited(spark.createDataFrame(repeated, "doc_id long, text string")) == audit_brute(repeated)


def test_no_python_runs(spark, sf_dir):
    plan = fp.edit_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_equal_texts_have_equal_fingerprints(spark):
    df = spark.createDataFrame([(k, LONG[: 900 + k // 2]) for k in range(20)], "doc_id long, text string")
    got = fp.fingerprints(df).groupBy(F.floor(F.col("doc_id") / 2)).agg(F.countDistinct("fingerprint").alias("n")).collect()
    assert {r.n for r in got} == {1}
