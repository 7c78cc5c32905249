import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from cases import LONG, edge_docs, edge_rows, empty_docs

from quire.llm import bpe, edits

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(ids):
    return hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()


def random_texts(n, seed=5):
    rng = random.Random(seed)
    marks = ["'s", "'re", "'LL", " ", "  ", "\n", "\t ", "\x1c", "\x85", "\xa0", "é", "ß", "漢", "\U0001f600", "!!", "a", "the", "ation", "ing", "zz", "1", "22", "_", "-", " ", "İ", "q", "xq", "aaaaaaa", "@x.yz", "%%%"]
    return ["".join(rng.choice(marks) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_replay_matches_the_library(library):
    encoder = bpe.Encoder(bpe.Vocabulary(bpe.read_ranks(open(PATH, "rb").read())))
    texts = random_texts(600) + ["a" * 3000, "ab" * 999, LONG[:20000]]
    for text, ids in zip(texts, encoder.encode_all(texts), strict=True):
        assert digest(library.encode_ordinary(text)) == hashlib.sha256(ids).hexdigest(), text
        assert encoder.decode(ids) == text.encode()


def test_faster_patterns_split_alike():
    rng = random.Random(6)
    for text in random_texts(300, 9) + ["".join(chr(rng.randrange(1, 0x180)) for _ in range(50)) for _ in range(400)]:
        assert bpe.pretoken_list(text) == bpe._SPLIT.findall(text) == list(bpe.pretokens(text))


def test_a_lower_rank_that_appears_later_goes_first():
    """'aab' + 'b' only exists after a higher-ranked merge; the leftmost lowest pair must still win."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 260, b"ca": 299, b"cab": 258}
    words = [b"abcabcab", b"cabcab", b"abab"]

    def slow(word):
        parts = [bytes([b]) for b in word]
        while True:
            best = min(((ranks[parts[k] + parts[k + 1]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    assert bpe.Vocabulary(ranks).replay(words) == [slow(w) for w in words]


def test_query_rows(spark, sf_dir, library, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(edge_docs(spark).select("doc_id", "text"))
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(docs, PATH).collect())
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append(((r.doc_id is None, r.doc_id or 0), len(ids), digest(ids), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode_documents(empty_docs(spark), PATH).collect() == []


def test_long_texts_in_blocks(library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 1000)
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 77)
    encoder = bpe.Encoder(bpe.Vocabulary(bpe.read_ranks(open(PATH, "rb").read())))
    text = LONG[:9000]
    n, ids, out = next(bpe._digests(encoder, [text]))
    assert (n, ids, out) == (len(library.encode_ordinary(text)), digest(library.encode_ordinary(text)), hashlib.sha256(text.encode()).hexdigest())


def test_edits_match_a_full_count(library):
    encoder = bpe.Encoder(bpe.Vocabulary(bpe.read_ranks(open(PATH, "rb").read())))

    def count(piece):
        encoder.learn([piece])
        return len(encoder.known[piece]) // 4

    rng = random.Random(11)
    texts = random_texts(120, 8) + ["", LONG[:6000]]
    for text in texts:
        tree = edits.CountTree(bpe.pretoken_list(text), count)
        for _ in range(25):
            a = rng.randrange(len(text) + 1)
            b = min(len(text), a + rng.choice([0, 0, 1, 2, 9, 300]))
            new = rng.choice(["", "", *random_texts(3, rng.random())])[:40]
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text
            assert [p for leaf in tree.leaves for p in leaf] == bpe.pretoken_list(text)
            assert tree.n_tokens == len(library.encode_ordinary(text)) and tree.n_chars == len(text)


def test_edits_touch_little():
    text = LONG[:200_000]
    tree = edits.CountTree(bpe.pretoken_list(text), len)
    tree.edit(100_000, 100_010, "new words")
    assert tree.reencoded < 200


def test_edit_query(spark, library):
    rows = edge_rows() + [(500, "write to a.b@mail.org now!!! *** 123 456 789 0 %%", "en", "a", 1)]
    docs = edge_docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame([rows[-1][:2]], "doc_id long, text string"))
    texts = sorted((r[0] is None, r[0] or 0, r[1] or "") for r in rows)
    for r, (_, _, text) in zip(sorted(edits.edited_counts(docs, PATH).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_chars)), texts, strict=True):
        new = text
        for a, b, x in edits.mask_edits(text):
            new = new[:a] + x + new[b:]
        assert r.n_tokens_before == len(library.encode_ordinary(text))
        assert (r.n_tokens, r.text_sha256) == (len(library.encode_ordinary(new)), hashlib.sha256(new.encode()).hexdigest())
        if r.doc_id == 500:
            assert new == "write to [EMAIL] now! * [NUMBER] %"
    assert edits.edited_counts(empty_docs(spark), PATH).collect() == []
