import zlib

import numpy as np
import pytest
from cases import edge_docs, edge_rows, empty_docs

from quire.llm import langid


def slow_bits(training, text, depth=3):
    """Code length of text under a context tree of the training texts, byte by byte."""
    raw = langid.RAW
    seen = {int(raw[b]) for t in training for x in t.values() for b in x.encode()} | {0, 1, 2, 3}
    symbol = lambda b: int(raw[b]) if int(raw[b]) in seen else langid.OTHER
    out = {}
    for lang in training[0]:
        counts = {}
        for t in training:
            s = [0] * 3 + [symbol(b) for b in t[lang].encode()]
            for k in range(3, len(s)):
                for d in range(4):
                    own = counts.setdefault(tuple(s[k - d : k]), {})
                    own[s[k]] = own.get(s[k], 0) + 1
        s = [0] * 3 + [symbol(b) for b in text.encode()]
        total = 0.0
        for k in range(3, len(s)):
            p = 1.0
            for d in (*range(depth, -1, -1), None):
                own = counts.get(tuple(s[k - d : k])) if d is not None else None
                if d is None:
                    p *= 1 / len(seen)
                elif own:
                    n, kinds = sum(own.values()), len(own)
                    if s[k] in own:
                        p *= own[s[k]] / (n + kinds)
                        break
                    p *= kinds / (n + kinds)
            total -= np.log2(p / sum(symbol(b) == s[k] for b in range(256)))
        out[lang] = total
    return out


def test_code_lengths_match_a_walk_of_the_tree():
    training = [{"en": "The cat sat on the mat, then it ran!", "fr": "Le chat était là; où est-il allé ?"}, {"en": "There are 12 hats", "fr": "Ça va très bien"}]
    counts = {}
    for t in training:
        for lang, text in t.items():
            for g in langid._grams(langid.RAW[np.frombuffer(text.encode(), dtype=np.uint8)], 256).tolist():
                counts[lang, g] = counts.get((lang, g), 0) + 1
    depths = set()
    for most in (1 << 28, 60_000, 20_000, 2_000):
        model = langid.fit([(a, g, n) for (a, g), n in counts.items()], most)
        assert model.bits.nbytes + model.rows.nbytes <= most
        depths.add(model.depth)
        for text in ("the hat", "où est le chat", "漢字 zq 77 \x00", "t"):
            got, want = model.lengths(text.encode()), slow_bits(training, text, model.depth)
            assert np.allclose(got, [want[x] for x in model.languages], rtol=1e-5)
        # No text begins more cheaply than a code of bytes allows.
        assert all(sum(2.0 ** -model.lengths(bytes([b]))[k] for b in range(256)) <= 1 + 1e-6 for k in range(2))
    assert len(depths) > 2
    with pytest.raises(ValueError, match="don't fit"):
        langid.fit([(a, g, n) for (a, g), n in counts.items()], 10)


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError, match="more than 1"):
        langid.train(edge_docs(spark))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) > 0.98 * len(held)


def test_edge_rows_and_empty(spark):
    rows = langid.identify(edge_docs(spark)).collect()
    assert len(rows) == len(edge_rows())
    by = {r.doc_id: r for r in rows}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1, 2, 3, 11))
    assert not by[None].held_out
    assert langid.identify(empty_docs(spark)).collect() == []
    unlabelled = edge_docs(spark, False).withColumn("lang", langid.F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_accepted_keeps_rows_whole(spark):
    docs = edge_docs(spark)
    got = langid.accepted(docs, most_bits=30.0)
    assert got.schema == docs.schema
    ids = {r.doc_id for r in got.collect()}
    assert {5, 6, 7, 100} <= ids and not {1, 2, 3, 11} & ids


def test_labels_are_not_read_in_prediction(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = langid.F.crc32(langid.F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = docs.withColumn("lang", langid.F.when(held, langid.F.lit("zz")).otherwise(langid.F.col("lang")))
    a, b = (sorted(map(tuple, langid.identify(d).collect())) for d in (docs, other))
    assert a == b
