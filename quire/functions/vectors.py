"""Vector expressions, and the exact nearest-neighbour kernel."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    size = norm(vector)
    return F.when(size == 0, F.transform(vector, lambda x: x.cast("double"))).otherwise(F.transform(vector, lambda x: x.cast("double") / size))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


HITS = "query_id string, key string, distance double"


def matrix(column: pa.ListArray | pa.ChunkedArray, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(-1, width)


#: Distances that a task holds at a time, whatever the numbers of queries and rows.
DISTANCES = 1 << 18
#: Candidates of a query among a block of rows, as a multiple of k, beyond which the k-th of the block is looked for.
CANDIDATES = 4


def nearest(batches: Iterator[pa.RecordBatch], ids: list[str], queries: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k rows (key, embedding) of a partition nearest to each query.

    A matrix product finds candidates; those that may be among the k are measured again by plain differences,
    so that equal vectors have equal distances. Ties go by key. Memory: one batch, DISTANCES distances, and k hits for each query.
    Once k hits are known they alone tell which rows may be among the k; the k-th of a block is looked for only while they tell too little.
    """
    width, own = queries.shape[1], (queries**2).sum(axis=1)
    turned = -2 * queries
    best: list[list[tuple[float, str]]] = [[] for _ in ids]
    worst = np.full(len(ids), np.inf)  # distance of the k-th hit so far
    for batch in batches:
        held = batch.filter(batch.column(1).is_valid())
        if not held.num_rows:
            continue
        keys, rows = held.column(0).to_pylist(), matrix(held.column(1), width)
        sizes, place = (rows**2).sum(axis=1), np.empty(len(rows), np.int64)
        place[sorted(range(len(rows)), key=lambda i: (keys[i] is not None, keys[i] or ""))] = np.arange(len(rows))
        for lo in range(0, len(rows), 4096):
            part, size = rows[lo : lo + 4096], sizes[lo : lo + 4096]
            step = max(1, DISTANCES // len(part))
            for first in range(0, len(ids), step):
                block = slice(first, first + step)
                near = turned[block] @ part.T  # less the query's own square, which is on the side of the bound
                near += size
                slack = 1e-9 * (own[block] + size.max())
                close = near <= (worst[block] - own[block] + slack)[:, None]
                if len(part) > k and np.count_nonzero(close) > CANDIDATES * k * len(near):
                    bound = np.partition(near, k - 1, axis=1)[:, k - 1] + own[block]
                    close = near <= (np.minimum(bound, worst[block]) - own[block] + slack)[:, None]
                rows_at, at = np.nonzero(close)
                if not len(at):
                    continue
                exact = ((part[at] - queries[block][rows_at]) ** 2).sum(axis=1)
                if len(at) > k:  # of the many that may be equally near, the first k of each query
                    order = np.lexsort((place[lo + at], exact, rows_at))
                    rows_at, exact, at = rows_at[order], exact[order], at[order]
                    own_k = np.arange(len(at)) - np.searchsorted(rows_at, rows_at) < k
                    rows_at, exact, at = rows_at[own_k], exact[own_k], at[own_k]
                for q, hits in itertools.groupby(zip(rows_at.tolist(), exact.tolist(), at.tolist(), strict=True), key=lambda x: x[0]):
                    q += first
                    best[q] = sorted(best[q] + [(d, keys[lo + j]) for _, d, j in hits])[:k]
                    if len(best[q]) == k:
                        worst[q] = best[q][-1][0]
    for first in range(0, len(ids), 4096):
        hits = [(i, key, d) for i, own_hits in zip(ids[first : first + 4096], best[first : first + 4096], strict=True) for d, key in own_hits]
        if hits:
            q, key, d = zip(*hits, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(key), pa.array(d)], names=["query_id", "key", "distance"])


def most_shared(batches: Iterator[pa.RecordBatch], ids: list, wanted: list[list[str]], k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The k rows (key, words) of a partition with the highest share of each query's distinct words, if any; ties go by key.

    The queries' words are the index: a row looks up its own words, and no pair without a common word is made.
    """
    postings: dict[str, list[int]] = {}
    for q, words in enumerate(wanted):
        for word in words:
            postings.setdefault(word, []).append(q)
    index = {word: np.array(own) for word, own in postings.items()}
    number = np.array([max(1, len(words)) for words in wanted], dtype=np.float64)
    best: list[list[tuple[float, object]]] = [[] for _ in ids]
    floor = np.zeros(len(ids))  # share below which a row can't be among the k
    for batch in batches:
        for key, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = [index[w] for w in words or () if w in index]
            if not own:
                continue
            share = np.bincount(np.concatenate(own), minlength=len(ids)) / number
            for q in np.flatnonzero((share > 0) & (share >= floor)).tolist():
                heapq.heappush(best[q], (float(share[q]), _Last(key)))
                if len(best[q]) > k:
                    heapq.heappop(best[q])
                    floor[q] = best[q][0][0]
    rows = [(i, hit.key, share) for i, hits in zip(ids, best, strict=True) for share, hit in hits]
    for first in range(0, len(rows), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[first : first + (1 << 16)], strict=True), schema, strict=True)], schema=schema)


class _Last:
    """A key in reverse order, so that of equal shares the greatest key is dropped first."""

    __slots__ = ("key",)

    def __init__(self, key: object) -> None:
        self.key = key

    def __lt__(self, other: _Last) -> bool:
        return other.key < self.key

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Last) and self.key == other.key
