import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from cases import LONG, edge_docs, empty_docs
from test_bpe import random_texts
from tokenizers import Tokenizer

from quire.llm import packing

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    return own


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [1]


def check_pieces(rows, want, window=2048):
    """want: doc_id to a list of the ids of each row with that id."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == want.keys()
    for doc_id, texts in want.items():
        if len(texts) > 1:
            assert sum(r.length for r in by_doc[doc_id]) == sum(map(len, texts))
            continue
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(texts[0])
            assert r.ids_crc32 == zlib.crc32(np.array(texts[0][at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(texts[0])
    padded = total = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
        total += at
        padded += at if at & (at - 1) == 0 else window
    assert padded == total


def test_words_match_the_library(library):
    words = packing.WordIds(library)
    texts = random_texts(500) + ["ΣΑΣ σς", "İx", "can't WE'RE o''s 'S", "ǅ ǆ ŉ", LONG[:5000], "é ﬁ ½ x²", "<|endoftext|> a", ""]
    texts += ["".join(map(chr, range(a, a + 32))) for a in range(0, 0x180, 32)] + ["".join(f"a{chr(c)}b " for c in range(1, 0x180))]
    for text in texts:
        assert np.frombuffer(words.encode(text), dtype="<u2").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize(("shard", "terms"), [(packing.SHARD_TOKENS, None), (5000, None), (5000, 32)])
def test_every_token_once_without_padding(spark, sf_dir, library, shard, terms):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select((-1 - packing.F.col("doc_id")).alias("doc_id"), "text").unionByName(edge_docs(spark).select("doc_id", "text"))
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append(ids_of(library, r.text))
    check_pieces(packing.pack(docs, PATH, shard_tokens=shard, query_terms=terms).collect(), dict(want))


def test_empty(spark):
    assert packing.pack(empty_docs(spark), PATH).collect() == []


@pytest.mark.parametrize(("whole", "dense"), [(False, False), (True, False), (False, True), (True, True)])
def test_neighbours_follow_brute_force_scores(whole, dense, monkeypatch):
    """By all terms of whole texts, of which the rests may be a part."""
    monkeypatch.setattr(packing, "DENSE_GAIN", 1e9 if dense else 0)
    rng = np.random.default_rng(2)
    tails = [rng.zipf(1.4, rng.integers(1, 60)).clip(max=299).astype(np.int64) for _ in range(80)]
    idf = rng.random(300)
    mean = float(np.mean([len(t) for t in tails]))
    index = packing.Index([t[:2] if whole and k % 3 else t for k, t in enumerate(tails)], idf, mean, [np.unique(t, return_counts=True) if whole and k % 3 else None for k, t in enumerate(tails)])
    assert (index.scores is not None) == dense
    for seed in range(80):
        index.use(seed)
        want = {}
        for k, t in enumerate(tails):
            terms, tf = np.unique(t, return_counts=True)
            w = idf[terms] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
            score = sum(x for term, x in zip(terms, w) if term in tails[seed])
            if index.unused[k] and score > 0:
                want[k] = score
        assert index.neighbours(seed, 5) == index.neighbours(seed, 80)[:5]
        got = index.neighbours(seed, 80)
        assert set(got) == set(want)
        assert all(want[a] >= want[b] - 1e-5 for a, b in zip(got, got[1:]))


def test_windows_join_related_texts():
    """Two topics, dealt alternately, end up in windows of one topic each but for the seam."""
    rng = np.random.default_rng(4)
    tails = [rng.integers(0, 100, 60) + 100 * (k % 2) for k in range(200)]
    idf = np.ones(200)
    windows = list(packing.pack_tails(tails, idf, 60.0, 512))
    mixed = sum(len({k % 2 for k, _, _ in w}) > 1 for w in windows if sum(p[2] for p in w) == 512)
    assert mixed <= 2


def test_near_copies_are_neighbours_in_the_order():
    rng = np.random.default_rng(5)
    families = [np.unique(rng.integers(2, 49_000, 300)) for _ in range(60)]
    texts = [np.r_[f[rng.random(len(f)) < 0.97], rng.integers(2, 49_000, 5)] for f in families for _ in range(4)]
    order = sorted(range(len(texts)), key=lambda k: packing.order_key(texts[k]))
    assert sum(a // 4 == b // 4 for a, b in zip(order, order[1:])) > 0.7 * 180
    assert packing.order_key(np.array([7, 7])) != packing.order_key(np.array([8])) and packing.order_key(np.empty(0, np.int64))[0] == 1 << 16


def test_known_runs_are_not_searched_for_words(library, monkeypatch):
    """A text is parted at blanks, and what stands between is looked up whole, a comma or full stop after it by itself."""
    own, text = packing.WordIds(library), "The winnow, the sieve. Été à la plage.\nIt's 3.5 metres (or so), \"ok\", yes!"
    want = np.array(library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
    assert own.encode(text) == want
    plain = packing.WordIds(library)
    plain.encode("The winnow, the sieve. Été.\nIt's")
    assert {"winnow", "sieve", "été", ",", "."} <= plain.keys() and not {"winnow,", "sieve.", "été."} & plain.keys()

    class Unused:
        def findall(self, text):
            raise AssertionError(text)

    monkeypatch.setattr(packing, "_WORDS", Unused())
    monkeypatch.setattr(packing, "_ASCII_WORDS", Unused())
    assert own.encode(text) == want


def test_runs_match_the_library_at_odd_blanks_and_marks(library):
    own, alphabet = packing.WordIds(library), list("ab1'st.,, .  \n\t\x0b\x1c\x1f\x85\xa0éßØÅ½²-–€?!_ LL\r're")
    rng = np.random.default_rng(4)
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, rng.integers(14)))
        assert np.frombuffer(own.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
