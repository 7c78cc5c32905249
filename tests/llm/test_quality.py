import re
from collections import Counter

from cases import edge_docs, edge_rows, empty_docs

from quire.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), n < 10 or 100 * len(inside) > 20 * n)


def test_counts_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + k, r[1]) for k, r in enumerate(edge_rows())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:7] for r in quality.apply_policy(quality.ledger(df)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    assert got == {k: brute(t) for k, t in rows}


def test_clashes_and_empty(spark):
    assert quality.apply_policy(quality.ledger(edge_docs(spark))).count() == len(edge_rows())
    assert quality.apply_policy(quality.ledger(empty_docs(spark))).collect() == []


def test_policies_only_tighten_base(spark):
    book = quality.ledger(edge_docs(spark))
    for policy in quality.POLICIES:
        assert not quality.apply_policy(book, policy).filter("base_failed and kept").collect()


def test_ablation_matches_the_ledger(spark, sf_dir):
    book = quality.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    bits = [r.fail_bits for r in book.collect()]
    for r in quality.ablation(book).collect():
        mask, bit = quality.POLICIES[r.policy], quality.BIT[r.rule]
        assert r.failed == sum(b & bit > 0 for b in bits)
        assert r.only_this == sum(b & mask == bit for b in bits)
        assert r.rejected == sum(b & mask > 0 for b in bits) and r.documents == len(bits)


def test_labels_agree(spark):
    path = "/root/testdata/sf0.01"
    book = quality.apply_policy(quality.ledger(spark.read.parquet(f"{path}/documents.parquet")))
    rows = book.filter("n_words >= 10").join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").select("quality", "kept").collect()
    clean, junk = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert sum(clean) > 0.97 * len(clean) and sum(junk) < 0.2 * len(junk)
