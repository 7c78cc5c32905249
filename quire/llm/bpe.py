"""Byte-level BPE by merge replay over the distinct pre-tokens of a block of documents.

An inverted index maps each merge to the word positions where its pair stands. Merges are applied in rank order over
all words at once, and only the neighbours of a merged pair are looked at again. Words already replayed in a task are
kept, so each task pays once for a frequent word.

Defined cases: null counts as empty, which has no tokens; repeated rows are encoded one by one; an empty table gives an
empty result; other input columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.workspace import slices

#: Words kept between blocks and their characters, characters of text in a block, pre-tokens of a long text handled at once.
CACHE_WORDS, CACHE_CHARS, BLOCK_CHARS, BLOCK_WORDS = 400_000, 1 << 23, 1 << 20, 200_000
_ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: The same for text of Latin letters up to U+017F and general punctuation, where \p{L}, \p{N} and \s are these.
_LATIN, _DIGIT, _BLANK = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_LATIN_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[{_DIGIT}]+| ?[^{_BLANK}{_LATIN}{_DIGIT}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
_BEYOND = re.compile(r"[^\x00-ſ‐-‧€]")
_SPLIT = regex.compile(public_tokenizers.PATTERN)


def _pattern(text: str):
    return _ASCII_SPLIT if text.isascii() else _SPLIT if _BEYOND.search(text) else _LATIN_SPLIT


def pretokens(text: str) -> Iterator[str]:
    """Matches of the public pattern; its forms for fewer characters are only faster equals."""
    return (m[0] for m in _pattern(text).finditer(text))


def pretoken_list(text: str) -> list[str]:
    return _pattern(text).findall(text)


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.byte_pairs = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], dtype=np.int64)
        self._pairs: dict[int, int] = {}

    def _merged(self, key: int) -> int:
        """Rank of the token that two neighbours (left << 20 | right) make, -1 if none."""
        if len(self._pairs) > 1_000_000:
            self._pairs.clear()
        found = self._pairs[key] = self.ranks.get(self.tokens[key >> 20] + self.tokens[key & 0xFFFFF], -1)
        return found

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of every word."""
        out: list[list[int]] = [[]] * len(words)
        todo = []
        for k, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                out[k] = [whole]
            elif word:
                todo.append(k)
        if not todo:
            return out
        data = np.frombuffer(b"".join(words[k] for k in todo), dtype=np.uint8)
        n, stop = len(data), np.cumsum([len(words[k]) for k in todo])
        symbols, ends = self.single[data].tolist(), stop.tolist()
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[stop - 1] = -1
        before[np.r_[0, stop[:-1]]] = -1
        first = np.append(self.byte_pairs[data[:-1], data[1:]], -1)
        first[stop - 1] = -1
        order = np.argsort(first, kind="stable")
        kinds, at = np.unique(first[order], return_index=True)
        index = {r: own.tolist() for r, own in zip(kinds.tolist(), np.split(order, at[1:]), strict=True) if r >= 0}
        after, before, standing = after.tolist(), before.tolist(), first.tolist()
        queue, known = list(index), self._pairs.get
        heapify(queue)
        while queue:
            rank = heappop(queue)
            positions = index.pop(rank, None)
            if positions is None:
                continue
            positions.sort()
            later, skip_to, lower = [], -1, False
            for p in positions:
                if standing[p] != rank:
                    continue
                if p < skip_to:
                    later.append(p)
                    continue
                q = after[p]
                symbols[p], symbols[q], standing[q] = rank, -1, -1
                z = after[p] = after[q]
                if z >= 0:
                    before[z] = p
                    key = rank << 20 | symbols[z]
                    r = known(key)
                    if r is None:
                        r = self._merged(key)
                    standing[p] = r
                    if r >= 0:
                        own = index.get(r)
                        if own is None:
                            index[r] = [p]
                            heappush(queue, r)
                        else:
                            own.append(p)
                        lower = r < rank
                else:
                    standing[p] = -1
                a = before[p]
                if a >= 0:
                    key = symbols[a] << 20 | rank
                    r = known(key)
                    if r is None:
                        r = self._merged(key)
                    standing[a] = r
                    if r >= 0:
                        own = index.get(r)
                        if own is None:
                            index[r] = [a]
                            heappush(queue, r)
                        else:
                            own.append(a)
                        lower = lower or r < rank
                if lower:  # an earlier merge became possible: it goes first in this word
                    skip_to, lower = ends[bisect_right(ends, p)], False
            if later:
                own = index.setdefault(rank, [])
                if not own:
                    heappush(queue, rank)
                own.extend(later)
        start = 0
        for k, end in zip(todo, ends, strict=True):
            out[k] = [x for x in symbols[start:end] if x >= 0]
            start = end
        return out


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


@lru_cache(maxsize=2)
def _vocabulary(data: bytes) -> Vocabulary:
    return Vocabulary(read_ranks(data))


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.known: dict[str, bytes] = {}
        self.held = 0

    def learn(self, words: Iterable[str]) -> None:
        distinct = set(words)
        fresh = [w for w in distinct if w not in self.known]
        more = sum(map(len, fresh))
        if len(self.known) + len(fresh) > CACHE_WORDS or self.held + more > CACHE_CHARS:
            self.known.clear()
            fresh = list(distinct)
            self.held, more = 0, sum(map(len, fresh))
        self.held += more
        for word, ids in zip(fresh, self.vocabulary.replay([w.encode() for w in fresh]), strict=True):
            self.known[word] = array("I", ids).tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        split = [pretoken_list(t) for t in texts]
        self.learn(chain.from_iterable(split))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def encode_long(self, text: str) -> Iterator[bytes]:
        words = pretokens(text)
        while block := list(islice(words, BLOCK_WORDS)):
            self.learn(block)
            yield b"".join(map(self.known.__getitem__, block))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def encoder_of(data: bytes) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(_vocabulary(data))


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK_CHARS each; a longer text has a range of its own."""
    first, held = 0, 0
    for k, text in enumerate(texts):
        if held and held + len(text) > BLOCK_CHARS:
            yield first, k
            first, held = k, 0
        held += len(text)
    if first < len(texts):
        yield first, len(texts)


def _digests(encoder: Encoder, text_block: list[str]) -> Iterator[tuple[int, str, str]]:
    if len(text_block) == 1 and len(text_block[0]) > BLOCK_CHARS:
        ids_sha, out_sha, n = hashlib.sha256(), hashlib.sha256(), 0
        for ids in encoder.encode_long(text_block[0]):
            ids_sha.update(ids)
            out_sha.update(encoder.decode(ids))
            n += len(ids) // 4
        yield n, ids_sha.hexdigest(), out_sha.hexdigest()
        return
    for ids in encoder.encode_all(text_block):
        yield len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()


def _encoded(batches: Iterator[pa.RecordBatch], file: Broadcast) -> Iterator[pa.RecordBatch]:
    encoder = encoder_of(file.value)
    for batch in slices(batches, 2048):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        rows = [x for lo, hi in blocks(texts) for x in _digests(encoder, texts[lo:hi])]
        n, ids, out = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def vocabulary_file(path: str) -> bytes:
    """A vocabulary of bounded size (about 1 MB), read once by the driver and sent to the executors."""
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (of the bytes decoded from the ids)."""
    file = docs.sparkSession.sparkContext.broadcast(vocabulary_file(path))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _encoded(b, file), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
