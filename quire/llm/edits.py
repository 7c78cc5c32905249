"""Edit-aware token counts: a segment tree of pre-tokens per document.

Leaves hold runs of pre-tokens with their characters and tokens; inner nodes hold sums. An edit re-encodes from the last
boundary that the split of the old text cannot have looked past, up to the first boundary after the edit that old and new
split share, and then updates the sums above the touched leaves. The result equals a full count of the edited text.

Defined cases: null counts as empty, which has no tokens; a document without edits keeps its count; repeated rows are
counted one by one; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bpe import BLOCK_CHARS, CACHE_WORDS, Encoder, encoder_of, pretoken_list, vocabulary_file
from quire.llm.bpe import blocks as text_blocks
from quire.llm.workspace import slices

LEAF = 16
#: A match of the pre-token pattern depends on at most so many characters after its end.
LOOKAHEAD = 2

#: The edits of the query, in this order of precedence: addresses and numbers are masked, runs of a mark are cut to one.
#: A pattern, its replacement, and a text that any match holds.
MASKS: tuple[tuple[str, str, str], ...] = ((r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "[EMAIL]", "@"), (r"\d[\d -]{6,}\d", "[NUMBER]", ""), (r"([!?*#$%&])\1+", r"\1", ""))


class CountTree:
    def __init__(self, pieces: list[str], count: Callable[[str], int]) -> None:
        self.count = count
        self.reencoded = 0
        self._build(pieces)

    def _build(self, pieces: list[str]) -> None:
        self.leaves = [pieces[k : k + LEAF] for k in range(0, len(pieces), LEAF)] or [[]]
        self.width = 1
        while self.width < len(self.leaves):
            self.width *= 2
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, leaf in enumerate(self.leaves):
            self.chars[self.width + k] = sum(map(len, leaf))
            self.tokens[self.width + k] = sum(map(self.count, leaf))
        for k in range(self.width - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def _add(self, leaf: int, chars: int, tokens: int) -> None:
        at = self.width + leaf
        while at:
            self.chars[at] += chars
            self.tokens[at] += tokens
            at //= 2

    def _replace(self, leaf: int, lo: int, hi: int, pieces: list[str]) -> None:
        """Put pieces in place of a leaf's pieces lo to hi, and the difference into the sums above."""
        own = self.leaves[leaf]
        old = own[lo:hi]
        own[lo:hi] = pieces
        self._add(leaf, sum(map(len, pieces)) - sum(map(len, old)), sum(map(self.count, pieces)) - sum(map(self.count, old)))

    def _find(self, position: int) -> tuple[int, int, int]:
        """Leaf, piece and offset of the piece that holds a character; the end of the text is the end of the last leaf."""
        at, start = 1, 0
        if position >= self.chars[1]:
            last = len(self.leaves) - 1
            return last, len(self.leaves[last]), self.chars[1]
        while at < self.width:
            at *= 2
            if position >= start + self.chars[at]:
                start += self.chars[at]
                at += 1
        leaf = at - self.width
        for k, piece in enumerate(self.leaves[leaf]):
            if position < start + len(piece):
                return leaf, k, start
            start += len(piece)
        raise AssertionError("a leaf's sum is wrong")

    def edit(self, start: int, end: int, text: str) -> None:
        """Replace the characters [start, end) of the current text."""
        if not 0 <= start <= end <= self.n_chars:
            raise ValueError(f"edit {start}:{end} of {self.n_chars} characters")
        leaf, k, origin = self._find(max(0, start - LOOKAHEAD))
        if self._edit_in_leaf(leaf, k, origin, start, end, text):
            return
        # What stands from origin on, read piece by piece: (text, leaf, index after it).
        taken, old_ends, upto = [], [], origin
        at = (leaf, k)
        wanted = 2
        while True:
            grown = 0
            while at is not None and (upto < end or grown < wanted):
                piece, at = self._next(at)
                if piece is None:
                    at = None
                    break
                taken.append(piece)
                upto += len(piece)
                if upto >= end:
                    old_ends.append((upto, at))
                    grown += 1
            old = "".join(taken)
            new = old[: start - origin] + text + old[end - origin :]
            complete = at is None or upto == self.n_chars
            shift = len(text) - (end - start)
            ends = {p + shift - origin: place for p, place in old_ends}
            pieces, place, offset = [], None, 0
            if not new:
                place = at
            safe = len(new) if complete else len(new) - LOOKAHEAD
            for piece in pretoken_list(new):
                offset += len(piece)
                pieces.append(piece)
                if offset > safe:
                    break
                if offset in ends:
                    place = ends[offset]
                    break
            if place is not None or complete:
                break
            wanted *= 8
        self.reencoded += sum(map(len, pieces))
        self._splice((leaf, k), place, pieces)

    def _edit_in_leaf(self, leaf: int, k: int, origin: int, start: int, end: int, text: str) -> bool:
        """Do the edit if it and the next boundary lie within one leaf and the two pieces after it."""
        own, upto, j = self.leaves[leaf], origin, k
        while upto < end and j < len(own):
            upto += len(own[j])
            j += 1
        if upto < end or j + 2 > len(own):
            return False
        old = "".join(own[k : j + 2])
        new = old[: start - origin] + text + old[end - origin :]
        shared = upto - origin + len(text) - (end - start)
        after, safe = shared + len(own[j]), len(new) - LOOKAHEAD
        offset = 0
        pieces = pretoken_list(new)
        for n, piece in enumerate(pieces, 1):
            offset += len(piece)
            if offset > safe:
                return False
            if offset == shared or offset == after:
                self.reencoded += offset
                self._replace(leaf, k, j if offset == shared else j + 1, pieces[:n])
                if len(own) > 8 * LEAF:
                    self._build([p for x in self.leaves for p in x])
                return True
        return False

    def _next(self, at: tuple[int, int]) -> tuple[str | None, tuple[int, int]]:
        leaf, k = at
        while leaf < len(self.leaves):
            if k < len(self.leaves[leaf]):
                return self.leaves[leaf][k], (leaf, k + 1)
            leaf, k = leaf + 1, 0
        return None, at

    def _splice(self, first: tuple[int, int], after: tuple[int, int] | None, pieces: list[str]) -> None:
        leaf, k = first
        last, rest = (len(self.leaves) - 1, len(self.leaves[-1])) if after is None else after
        if last == leaf:
            self._replace(leaf, k, rest, pieces)
        else:
            self._replace(leaf, k, len(self.leaves[leaf]), pieces)
            for other in range(leaf + 1, last):
                self._replace(other, 0, len(self.leaves[other]), [])
            self._replace(last, 0, rest, [])
        if len(self.leaves[leaf]) > 8 * LEAF:
            self._build([p for own in self.leaves for p in own])

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)


def mask_edits(text: str, masks: Iterable[tuple[str, str, str]] = MASKS) -> list[tuple[int, int, str]]:
    """Edits from the right to the left, so that each holds for the text that the ones before have left."""
    found = []
    for rank, (pattern, new, needs) in enumerate(masks):
        if needs not in text:
            continue
        for m in re.finditer(pattern, text):
            found.append((m.start(), rank, m.end(), m.expand(new) if "\\" in new else new))
    edits, at = [], 0
    for start, _, end, new in sorted(found):
        if start >= at and end > start:
            edits.append((start, end, new))
            at = end
    return edits[::-1]


class Counts(dict):
    """Tokens of pre-tokens, filled as they are asked for."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        ids = self.encoder.known.get(piece)
        if ids is None:
            self.encoder.learn([piece])
            ids = self.encoder.known[piece]
        n = self[piece] = len(ids) // 4
        return n


@lru_cache(maxsize=2)
def _counts_of(data: bytes) -> Counts:
    """One for all tasks of a Python worker."""
    return Counts(encoder_of(data))


def _counted(batches: Iterator[pa.RecordBatch], file: Broadcast, masks: tuple) -> Iterator[pa.RecordBatch]:
    counts = _counts_of(file.value)
    encoder, count = counts.encoder, counts.__getitem__
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens_before", pa.int64()), ("n_edits", pa.int64()), ("n_tokens", pa.int64()), ("n_chars", pa.int64()), ("reencoded_chars", pa.int64()), ("text_sha256", pa.string())])
    for batch in slices(batches, 2048):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        rows = []
        for lo, hi in text_blocks(texts):
            split = [pretoken_list(t) for t in texts[lo:hi]]
            if hi - lo > 1 or len(texts[lo]) <= BLOCK_CHARS:
                encoder.learn(chain.from_iterable(split))
            for text, pieces in zip(texts[lo:hi], split, strict=True):
                tree = CountTree(pieces, count)
                before, edits = tree.n_tokens, mask_edits(text, masks)
                for edit in edits:
                    tree.edit(*edit)
                rows.append((before, len(edits), tree.n_tokens, tree.n_chars, tree.reencoded, hashlib.sha256(tree.text().encode()).hexdigest()))
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)


def edited_counts(docs: DataFrame, path: str, masks: Iterable[tuple[str, str, str]] = MASKS) -> DataFrame:
    """Token counts of every document before and after its edits, with the characters that were encoded again."""
    file, masks = docs.sparkSession.sparkContext.broadcast(vocabulary_file(path)), tuple(masks)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ddl = "doc_id long, n_tokens_before long, n_edits long, n_tokens long, n_chars long, reencoded_chars long, text_sha256 string"
    return rows.mapInArrow(lambda b: _counted(b, file, masks), ddl)
