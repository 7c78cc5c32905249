"""Lexical retrieval packing: windows of related documents from a sharded BM25 inverted index.

Whole windows of a document stand alone. What remains of each document (fewer tokens than a window) is packed: a seed
asks its shard's index for unused neighbours by BM25 score over all of its terms, and they fill the window in that order;
the one that doesn't fit is cut to fill it exactly, and its rest seeds the next window. Documents are indexed whole: terms
are token ids, and term counts, lengths and document frequencies are those of whole texts. The table of document
frequencies is bounded by the vocabulary.

Documents are ordered by weighted minhashes of their tokens, then by row, so lexical neighbours meet; a task takes a range of
that order and cuts it into shards by running sums of what a shard holds, so that neither the memory of a task nor the
number of tasks follows from the other. A hot key is cut by the row. The last tokens of a shard become sequences of powers
of two, which need no padding.

``query_terms`` limits a seed to its heaviest terms; the default, none, is exact.

Defined cases: null counts as empty, which is its end token alone; rows repeated with one doc_id are packed separately;
an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm.bpe import blocks, vocabulary_file
from quire.llm.workspace import materialise, slices

WINDOW, END_ID = 2048, 1
#: Tokens and terms that a shard holds, and shards of a task where the table is large; neighbours ranked at a time.
SHARD_TOKENS, TASK_SHARDS, NEIGHBOURS = 1_000_000, 128, 64
K1, B = 1.2, 0.75
#: Documents and cells (documents times terms) of a shard up to which all scores may be one matrix product, of which a step costs
#: about so many times less than one over postings.
DENSE_ROWS, DENSE_CELLS, DENSE_GAIN = 2048, 1 << 23, 32.0
#: Runs and words kept between texts, and characters of one that is kept.
CACHE_WORDS, WORD_CHARS = 500_000, 64
#: Text outside these characters is left to the tokenizer as a whole; they compose to nothing and lower-case one by one.
_RARE = re.compile(r"[^\x00-įı-ſ‐-‧€]")
_LETTERS, _NUMBERS = "a-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾"
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\t-\r \x85\xa0{_LETTERS}{_NUMBERS}]+")
#: Characters at which str.split() parts a text although they are parts of words here.
_NO_BLANKS = "\x1c\x1d\x1e\x1f"
#: A comma or full stop that ends a run and is one word with the marks before it.
_ASCII_MARKS = re.compile(r"[^\t-\r a-z0-9][,.][ \n]")
_MARKS = re.compile(rf"[^\t-\r \x85\xa0{_LETTERS}{_NUMBERS}][,.][ \n]")


@lru_cache(maxsize=2)
def _tokenizer(data: bytes) -> Tokenizer:
    own = Tokenizer.from_str(data.decode())
    own.encode_special_tokens = True  # the strings of special tokens are ordinary text
    return own


def _byte_letters() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return out


#: That character of each byte, by its place.
_BYTES = "".join(c for _, c in sorted(_byte_letters().items()))


class WordIds(dict):
    """Ids of words, and of runs of them between blanks, as little-endian unsigned 16-bit integers; a missing word is encoded by the vocabulary's merges.

    No word has a blank in it, so a text is parted at blanks and its runs are looked up whole; only those that are missing are parted
    further. Commas and full stops at the end of a run are made runs of their own, so that a word is kept once, with them or without.
    """

    def __init__(self, tokenizer: Tokenizer) -> None:
        if tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        super().__init__()
        self.tokenizer, self._merge = tokenizer, tokenizer.model.tokenize

    def __missing__(self, run: str) -> bytes:
        if not run.isalpha() and len(words := _WORDS.findall(run)) > 1:
            ids = b"".join(map(self.__getitem__, words))
        else:
            spelled = run if run.isascii() and run.isalnum() else charmap_decode(run.encode(), "strict", _BYTES)[0]
            ids = array("H", [t.id for t in self._merge(spelled)]).tobytes()
        if len(run) <= WORD_CHARS:
            self[run] = ids
        return ids

    def runs(self, text: str, marks: re.Pattern) -> list[str]:
        """What stands between the blanks of a lower-case text."""
        if not marks.search(text):
            text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
        return text.split()

    def encode(self, text: str) -> bytes:
        plain = text.isascii()
        if not plain and _RARE.search(text):
            return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        text = text.lower()
        if any(c in text for c in _NO_BLANKS):
            runs = (_ASCII_WORDS if plain else _WORDS).findall(text)
        else:
            runs = self.runs(text, _ASCII_MARKS if plain else _MARKS)
        if len(self) > CACHE_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, runs))


@lru_cache(maxsize=2)
def _word_ids(data: bytes) -> WordIds:
    """One for all tasks of a Python worker."""
    return WordIds(_tokenizer(data))


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _mixed(values: np.ndarray) -> np.ndarray:
    """A fixed mixing of integers into 63 bits."""
    x = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) >> np.uint64(1)




def _race() -> np.ndarray:
    """Places of all token ids in a race that later ids, the rarer merges, are likelier to win: a weighted minhash takes the first."""
    ids = np.arange(1 << 16)
    luck = (_mixed(ids).astype(np.float64) + 1) / 2.0**63
    places = np.empty(1 << 16, dtype=np.int32)
    places[np.argsort(-np.log(luck) / np.log(ids + 2.0), kind="stable")] = ids
    return places


_PLACES = _race()


def order_key(ids: np.ndarray) -> tuple[int, int]:
    """Numbers under which lexical neighbours meet: the winner of the race among a text's tokens, and the next two."""
    places, found = _PLACES[ids], []
    for _ in range(3):
        found.append(int(places.min()) if len(places) else 1 << 16)
        places = places[places != found[-1]]
    return found[0], found[1] << 20 | found[2]
_END = END_ID.to_bytes(2, "little")
TOKENS = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("crcs", pa.list_(pa.int64())), ("tail", pa.binary()), ("words", pa.binary()), ("times", pa.binary()), ("size", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
TOKENS_DDL = "rid long, doc_id long, n_tokens long, crcs array<long>, tail binary, words binary, times binary, size long, k1 long, k2 long, terms array<int>, counts array<long>"


def _tokens(batches: Iterator[pa.RecordBatch], file: Broadcast, window: int) -> Iterator[pa.RecordBatch]:
    """A row per document with its rest, the checksums of its whole windows and what it adds to a shard, and one row of the partition's term counts.

    Documents of a window or more also have their distinct terms (words) and how often they occur (times); others are all rest.
    """
    words = _word_ids(file.value)
    rid = TaskContext.get().partitionId() << 36
    frequency = np.zeros(words.tokenizer.get_vocab_size() + 1, dtype=np.int64)
    for batch in slices(batches):
        texts, ids_of = [t or "" for t in batch.column(1).to_pylist()], batch.column(0).to_pylist()
        for lo, hi in blocks(texts):
            rows = []
            for doc_id, text in zip(ids_of[lo:hi], texts[lo:hi], strict=True):
                ids = np.frombuffer(words.encode(text) + _END, dtype="<u2")
                whole = len(ids) // window
                tail = ids[whole * window :]
                frequency[ids] += 1  # once for each distinct token
                k1, k2 = order_key(ids)
                crcs = [crc_of(ids[k * window : (k + 1) * window]) for k in range(whole)]
                terms, times = np.unique(ids, return_counts=True) if whole else (None, None)
                size = len(tail) + (len(terms) + whole if whole else 0)
                rows.append((rid, doc_id, len(ids), crcs, tail.tobytes(), None if terms is None else terms.tobytes(), None if times is None else times.astype("<u4").tobytes(), size, k1, k2, None, None))
                rid += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), TOKENS, strict=True)], schema=TOKENS)
    seen = np.flatnonzero(frequency)
    row = (*[None] * 10, seen.tolist(), frequency[seen].tolist())
    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, TOKENS, strict=True)], schema=TOKENS)


#: Distinct terms of a document and how often each occurs in it.
Bag = tuple[np.ndarray, np.ndarray]


class Index:
    """BM25 postings of one shard. A document whose bag is not given has the terms of its rest."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean_tokens: float, bags: list[Bag | None] | None = None, query_terms: int | None = None) -> None:
        self.n, self.width, self.query_terms = len(tails), len(idf), query_terms
        bags = bags or [None] * self.n
        short = [k for k, bag in enumerate(bags) if bag is None]
        rests = [tails[k] for k in short]
        cells, tf = np.unique(np.repeat(np.array(short, dtype=np.int64), [len(t) for t in rests]) * self.width + np.concatenate([np.empty(0, np.int64), *rests]), return_counts=True)
        long = [k for k, bag in enumerate(bags) if bag is not None]
        if long:
            cells = np.concatenate([cells, *(k * self.width + bags[k][0] for k in long)])
            tf = np.concatenate([tf, *(bags[k][1] for k in long)])
            order = np.argsort(cells, kind="stable")
            cells, tf = cells[order], tf[order]
        self.doc, self.term = cells // self.width, cells % self.width
        lengths = np.bincount(self.doc, weights=tf, minlength=self.n)
        weight = idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.doc] / max(mean_tokens, 1)))
        self.weight = weight.astype(np.float32)
        self.doc_at = np.searchsorted(self.doc, np.arange(self.n + 1))
        self.unused, self.live = np.ones(self.n, dtype=bool), self.n
        order = np.argsort(self.term, kind="stable")
        self._post(self.doc[order], self.term[order], self.weight[order])
        self.scores = self._all_scores()

    def _all_scores(self) -> np.ndarray | None:
        """Scores of all documents for every seed, where postings are so long that a product of matrices costs less than walking them."""
        counts = np.bincount(self.term, minlength=self.width)
        terms = np.flatnonzero(counts)
        cells = self.n * len(terms)
        if self.query_terms is not None or self.n > DENSE_ROWS or cells > DENSE_CELLS or self.n * cells > DENSE_GAIN * (counts.astype(np.float64) ** 2).sum():
            return None
        weights = np.zeros((self.n, len(terms)), dtype=np.float32)
        weights[self.doc, np.searchsorted(terms, self.term)] = self.weight
        return (weights > 0).astype(np.float32) @ weights.T

    def _post(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        self.post_doc, self.post_term, self.post_weight, self.posted = doc, term, weight, self.live
        self.term_at = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=self.width))])

    def use(self, k: int) -> None:
        self.unused[k] = False
        self.live -= 1
        if 2 * self.live < self.posted:
            kept = self.unused[self.post_doc]
            self._post(self.post_doc[kept], self.post_term[kept], self.post_weight[kept])

    def neighbours(self, seed: int, most: int = NEIGHBOURS) -> list[int]:
        """The unused documents with the highest scores, if positive, best first, ties by place."""
        scores = self._walked(seed) if self.scores is None else self.scores[seed] * self.unused
        found = np.flatnonzero(scores > 0)
        if len(found) > most:
            # All that tie with the last are kept for the sort, so that ties go by place.
            least = np.partition(scores[found], len(found) - most)[len(found) - most]
            found = found[scores[found] >= least]
        return found[np.lexsort((found, -scores[found]))][:most].tolist()

    def _walked(self, seed: int) -> np.ndarray:
        """Scores by the postings of the seed's terms."""
        lo, hi = self.doc_at[seed], self.doc_at[seed + 1]
        terms = self.term[lo:hi]
        if self.query_terms is not None and len(terms) > self.query_terms:
            terms = terms[np.argpartition(-self.weight[lo:hi], self.query_terms)[: self.query_terms]]
        spans = list(zip(self.term_at[terms].tolist(), self.term_at[terms + 1].tolist(), strict=True))
        if not spans:
            return np.zeros(self.n)
        docs = np.concatenate([self.post_doc[a:b] for a, b in spans])
        scores = np.bincount(docs, weights=np.concatenate([self.post_weight[a:b] for a, b in spans]), minlength=self.n)
        return scores * self.unused


def pack_tails(tails: list[np.ndarray], idf: np.ndarray, mean_tokens: float, window: int = WINDOW, bags: list[Bag | None] | None = None, query_terms: int | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length); all but those at the end are exactly one window long."""
    index, order = Index(tails, idf, mean_tokens, bags, query_terms), 0
    lengths = [len(t) for t in tails]
    for k, n in enumerate(lengths):
        if not n:
            index.use(k)
    rest: tuple[int, int, int] | None = None
    while True:
        if rest is None:
            while order < index.n and not index.unused[order]:
                order += 1
            if order == index.n:
                return
            index.use(order)
            rest = (order, 0, lengths[order])
        pieces, room, seed = [rest], window - rest[2], rest[0]
        rest = None
        while room:
            ranked = index.neighbours(seed)
            if not ranked:
                while order < index.n and not index.unused[order]:
                    order += 1
                if order == index.n:
                    break
                ranked = [order]
            for k in ranked:
                index.use(k)
                pieces.append((k, 0, min(room, lengths[k])))
                if lengths[k] >= room:
                    rest = (k, room, lengths[k] - room) if lengths[k] > room else None
                    room = 0
                    break
                room -= lengths[k]
        if not room:
            yield pieces
            continue
        yield from _powers(pieces)
        return


def _powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The same tokens in sequences of decreasing powers of two."""
    left = sum(p[2] for p in pieces)
    queue = pieces[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        own = []
        while room:
            k, start, n = queue.pop()
            take = min(n, room)
            own.append((k, start, take))
            room -= take
            if take < n:
                queue.append((k, start + take, n - take))
        yield own


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packed(batches: Iterator[pa.RecordBatch], stats: Broadcast, window: int, shard_tokens: int, query_terms: int | None) -> Iterator[pa.RecordBatch]:
    """Pieces of the rows of a range, a shard at a time."""
    idf, mean_tokens = stats.value
    sequence = TaskContext.get().partitionId() << 36
    out: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PIECES, strict=True)], schema=PIECES)
        out.clear()
        return made

    def shard(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        nonlocal sequence
        tails = [np.frombuffer(r[3], dtype="<u2").astype(np.int64) for r in rows]
        bags = [None if r[4] is None else (np.frombuffer(r[4], dtype="<u2").astype(np.int64), np.frombuffer(r[5], dtype="<u4").astype(np.int64)) for r in rows]
        for doc_id, n, crcs, *_ in rows:
            for k, crc in enumerate(crcs):
                out.append((doc_id, k * window, window, crc, n, sequence, 0))
                sequence += 1
            if len(out) > 50_000:
                yield flushed()
        for pieces in pack_tails(tails, idf, mean_tokens, window, bags, query_terms):
            offset = 0
            for k, start, length in pieces:
                doc_id, n, crcs, *_ = rows[k]
                out.append((doc_id, len(crcs) * window + start, length, crc_of(tails[k][start : start + length]), n, sequence, offset))
                offset += length
            sequence += 1
            if len(out) > 50_000:
                yield flushed()

    rows, held = [], 0
    for batch in slices(batches):
        for *row, size in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            rows.append(row)
            held += size
            if held >= shard_tokens:
                yield from shard(rows)
                rows, held = [], 0
    yield from shard(rows)
    if out:
        yield flushed()


def pack(docs: DataFrame, path: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, query_terms: int | None = None) -> DataFrame:
    """One row per piece; every token of every document lies in exactly one."""
    context = docs.sparkSession.sparkContext
    file = context.broadcast(vocabulary_file(path))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = materialise(rows.mapInArrow(lambda b: _tokens(b, file, window), TOKENS_DDL), "tokens")
    total = tokens.agg(F.count("rid").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t"), F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()
    found = tokens.filter(F.col("rid").isNull()).select(F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    counted = found.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("df")).toArrow()  # at most one row per token of the vocabulary
    df = np.zeros(1 << 16, dtype=np.float64)
    df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    idf = np.log1p((total["n"] - df + 0.5) / (df + 0.5))
    stats = context.broadcast((idf, total["t"] / max(1, total["n"])))
    shards = max(1, -(-total["s"] // shard_tokens))
    ranges = max(-(-shards // TASK_SHARDS), min(shards, 4 * context.defaultParallelism))
    texts = tokens.filter(F.col("rid").isNotNull())
    dealt = texts.repartitionByRange(ranges, "k1", "k2", "rid").sortWithinPartitions("k1", "k2", "rid")
    return dealt.select("doc_id", "n_tokens", "crcs", "tail", "words", "times", "size").mapInArrow(lambda b: _packed(b, stats, window, shard_tokens, query_terms), PIECES_DDL)
