"""Exact nearest neighbours with the queries as a table: pivots, rings around them, and a grid of query and vector blocks.

A vector belongs to its nearest pivot and, by its distance, to one of RINGS rings around it: that is its part. By the triangle
inequality a query at distance d from a pivot is no nearer than low - d or d - high to a ring from low to high. Each query first
searches the parts of least bound that hold k vectors; the distance of its k-th hit then decides which other parts it must search,
and the rest is skipped without loss. A part is cut into blocks of vectors and groups of queries, which meet pair by pair; what is
sent to the tasks are the pivots and a row for each part, both bounded whatever the table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.vectors import HITS, matrix, nearest
from quire.operators.heavy import written

#: The most pivots, which are drawn by a hash of the id, the rings of each, and the vectors that a part should have on average.
PIVOTS, RINGS, PART = 256, 8, 512
#: Vectors of a block and queries of a group: what one task holds of a part at a time.
BLOCK, GROUP = 8192, 4096
#: Copies of queries that a task makes at a time.
ROUTED = 8192
#: Share of the compared distances by which a bound may be off in doubles.
SLACK = 1e-9

_ROUTED = "query_id string, embedding array<double>, part int"


@dataclass
class Parts:
    """Pivots, and of each part its pivot's number, its inner and outer distance, and how many vectors it has."""

    pivots: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray

    def least(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and part: a bound that no vector's distance is below, and the room that rounding asks for."""
        away = _distances(queries, self.pivots)[:, self.pivot]
        return np.maximum(0.0, np.maximum(away - self.high, self.low - away)), SLACK * (away + self.high)


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((rows - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _assign(batches: Iterable[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 4096):
            part = batch.slice(k, 4096)
            away = _distances(matrix(part.column(1), pivots.shape[1]), pivots)
            cell = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell])], names=["chunk_id", "embedding", "cell", "away"])


def _homes(bound: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """True for the parts of least bound that together hold k vectors."""
    order = np.argsort(bound, axis=1, kind="stable")
    before = np.cumsum(size[order], axis=1) - size[order]
    home = np.zeros(bound.shape, dtype=bool)
    np.put_along_axis(home, order, before < k, axis=1)
    return home


def _route(batches: Iterable[pa.RecordBatch], parts: Parts, k: int) -> Iterator[pa.RecordBatch]:
    """A row for each query (query_id, embedding, and the square of its k-th distance, if that is known) and part to search."""
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            rows = batch.slice(start, 512)
            bound, room = parts.least(matrix(rows.column(1), parts.pivots.shape[1]))
            wanted = _homes(bound, parts.size, k)
            if rows.num_columns > 2:
                reach = np.sqrt(rows.column(2).to_numpy(zero_copy_only=False))[:, None]
                wanted = ~wanted & (bound <= reach * (1 + SLACK) + room)
            query, part = np.nonzero(wanted)
            for lo in range(0, len(query), ROUTED):  # a query that skips nothing is copied to every part
                own = pa.array(query[lo : lo + ROUTED])
                yield pa.RecordBatch.from_arrays([*(rows.column(c).take(own) for c in (0, 1)), pa.array(part[lo : lo + ROUTED].astype(np.int32))], names=["query_id", "embedding", "part"])


def _meet(vectors: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k vectors of a block nearest to each query of a group."""
    schema = pa.schema([("query_id", pa.string()), ("key", pa.string()), ("distance", pa.float64())])
    if not vectors.num_rows or not queries.num_rows:
        return schema.empty_table()
    own = matrix(queries["embedding"].combine_chunks(), len(queries["embedding"][0]))
    found = list(nearest(iter(vectors.select(["chunk_id", "embedding"]).combine_chunks().to_batches()), queries["query_id"].to_pylist(), own, k))
    return pa.Table.from_batches(found).cast(schema) if found else schema.empty_table()


@dataclass
class VectorIndex:
    """Vectors by part and block, to be searched by any number of tables of queries."""

    vectors: DataFrame  # part, sub, chunk_id, embedding
    subs: DataFrame  # part, subs: at most PIVOTS * RINGS rows
    parts: Parts
    keep: Callable[[str, DataFrame], DataFrame] = written
    #: query_id, part of all that the last search looked at.
    visits: DataFrame | None = field(default=None)

    def _hits(self, routed: DataFrame, k: int) -> DataFrame:
        groups = routed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups")).join(F.broadcast(self.subs), "part")
        groups = F.broadcast(self.keep("knn-groups", groups))  # a row for each part
        left = self.vectors.join(groups.select("part", "groups"), "part").withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        group = F.pmod(F.xxhash64("query_id"), F.col("groups").cast("long")).cast("int").alias("grp")
        right = routed.join(groups, "part").select("part", group, F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), "query_id", "embedding")
        key = ["part", "sub", "grp"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda a, b: _meet(a, b, k), HITS)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, chunk_id, rank, score (squared distance) of the k nearest vectors of each query; ties go by chunk_id."""
        order = Window.partitionBy("query_id").orderBy("distance", "key")

        def first(hits: DataFrame) -> DataFrame:
            return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

        asked = queries.filter("embedding IS NOT NULL").select(F.col("query_id").cast("string").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        asked, sent = self.keep("knn-queries", asked), self.vectors.sparkSession.sparkContext.broadcast(self.parts)
        homes = self.keep("knn-homes", asked.mapInArrow(lambda b: _route(b, sent.value, k), _ROUTED))
        near = self.keep("knn-near", first(self._hits(homes, k)))
        reach = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(math.inf)).alias("reach"))
        known = asked.join(reach, "query_id", "left").select("query_id", "embedding", F.coalesce("reach", F.lit(math.inf)).alias("reach"))
        others = self.keep("knn-others", known.mapInArrow(lambda b: _route(b, sent.value, k), _ROUTED))
        self.visits = homes.select("query_id", "part").unionByName(others.select("query_id", "part"))
        ranked = first(near.drop("rank").unionByName(self._hits(others, k)))
        return ranked.select("query_id", F.col("key").alias("chunk_id"), "rank", F.col("distance").alias("score"))

    def skipped(self) -> DataFrame:
        """query_id, parts, visited of the last search: parts less visited were skipped."""
        return self.visits.groupBy("query_id").agg(F.lit(len(self.parts.size)).alias("parts"), F.count(F.lit(1)).alias("visited"))


def build_index(vectors: DataFrame, keep: Callable[[str, DataFrame], DataFrame] = written) -> VectorIndex | None:
    """Two passes over the vectors (chunk_id, embedding); None if there are none. Rows without a vector are left out."""
    rows = vectors.filter("embedding IS NOT NULL").select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    wanted = max(1, min(PIVOTS, -(-rows.count() // (RINGS * PART))))
    drawn = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(wanted).collect()
    if not drawn:
        return None
    pivots = np.array([r["embedding"] for r in drawn], dtype=np.float64)
    pivots = np.unique(pivots, axis=0)
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)
    coded = keep("knn-cells", rows.mapInArrow(lambda b: _assign(b, sent.value), "chunk_id string, embedding array<double>, cell int, away double"))
    spans = coded.groupBy("cell").agg(F.min("away").alias("inner"), F.max("away").alias("outer"))  # a row for each pivot
    width = F.col("outer") - F.col("inner")
    ring = F.when(width == 0, F.lit(0)).otherwise(F.least(F.lit(RINGS - 1), F.floor((F.col("away") - F.col("inner")) / width * RINGS))).cast("int")
    ringed = coded.join(F.broadcast(spans), "cell").select("chunk_id", "embedding", "away", (F.col("cell") * RINGS + ring).alias("ringed"))
    sizes = ringed.groupBy("ringed").agg(F.min("away").alias("low"), F.max("away").alias("high"), F.count(F.lit(1)).alias("n"))
    numbered = keep("knn-parts", sizes.withColumn("part", F.row_number().over(Window.orderBy("ringed")) - 1).withColumn("subs", F.ceil(F.col("n") / BLOCK).cast("int")))
    table = numbered.orderBy("part").collect()  # at most PIVOTS * RINGS rows
    parts = Parts(pivots, *(np.array([f(r) for r in table]) for f in (lambda r: r["ringed"] // RINGS, lambda r: r["low"], lambda r: r["high"], lambda r: r["n"])))
    sub = F.pmod(F.xxhash64("chunk_id"), F.col("subs").cast("long")).cast("int").alias("sub")
    placed = ringed.join(F.broadcast(numbered.select("ringed", "part", "subs")), "ringed").select("part", sub, "chunk_id", "embedding")
    return VectorIndex(keep("knn-vectors", placed), numbered.select("part", "subs"), parts, keep)
