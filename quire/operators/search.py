"""Exact nearest neighbours: few queries against every vector, with k hits per query and partition before the shuffle; many by pivots."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.vectors import HITS, l2_normalize, most_shared, nearest
from quire.operators.pivots import build_index

#: Bytes of queries sent to the executors at once.
QUERY_BYTES = 32 << 20


def _block(vectors: DataFrame, ids: list[str], rows: list, k: int) -> DataFrame:
    sent = vectors.sparkSession.sparkContext.broadcast((ids, np.array(rows, dtype=np.float64)))
    return vectors.mapInArrow(lambda b: nearest(b, *sent.value, k), HITS)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 5, normalize: bool = False) -> DataFrame:
    """query_id, chunk_id, rank, score (squared distance) of the k vectors nearest to each query; ties go by chunk_id.

    queries: query_id, embedding. vectors: chunk_id, embedding. With fewer than k vectors there are fewer hits. Queries of at most
    QUERY_BYTES, which are counted first, are sent to the vectors and searched in one pass; more stay a table (see pivots).
    """
    vector = l2_normalize(F.col("embedding")) if normalize else F.col("embedding").cast("array<double>")
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), vector.alias("embedding")).filter("embedding IS NOT NULL")
    size = asked.agg(F.sum(8 * F.size("embedding") + F.length("query_id")).alias("bytes")).first()["bytes"]
    if size is None:
        return vectors.sparkSession.createDataFrame([], "query_id string, chunk_id string, rank int, score double")
    if size > QUERY_BYTES:
        index = build_index(vectors)
        return vectors.sparkSession.createDataFrame([], "query_id string, chunk_id string, rank int, score double") if index is None else index.search(asked, k)
    rows = asked.collect()
    hits = _block(vectors.select(F.col("chunk_id").cast("string").alias("chunk_id"), "embedding"), [r["query_id"] for r in rows], [r["embedding"] for r in rows], k)
    order = Window.partitionBy("query_id").orderBy("distance", "key")
    ranked = hits.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("key").alias("chunk_id"), "rank", F.col("distance").alias("score"))


def lexical_topk(queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """query_id, key, score, rank: the k docs (key long, words) with the highest share of each query's words (query_id long, words); ties go by key.

    Queries go out in blocks of at most QUERY_BYTES, each of which is one pass over the docs; a partition gives k rows for each query.
    """
    found, ids, block, held = [], [], [], 0
    schema = pa.schema([("query_id", pa.int64()), ("key", pa.int64()), ("score", pa.float64())])

    def hits() -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast((list(ids), list(block)))
        return docs.mapInArrow(lambda b: most_shared(b, *sent.value, k, schema), "query_id long, key long, score double")

    docs = docs.select(F.col("key").cast("long").alias("key"), "words")
    for r in queries.select(F.col("query_id").cast("long").alias("q"), "words").toLocalIterator():
        ids.append(r["q"])
        block.append(r["words"] or [])
        held += 64 + sum(len(w) + 64 for w in block[-1])
        if held >= QUERY_BYTES:
            found.append(hits())
            ids, block, held = [], [], 0
    if ids:
        found.append(hits())
    if not found:
        return docs.sparkSession.createDataFrame([], "query_id long, key long, score double, rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def concat_context(ranked: DataFrame, order: str = "rank", separator: str = "\n\n") -> DataFrame:
    """query_id, n, context: the texts of each query joined in rank order; a query has at most its k rows."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("text", F.lit("")).alias("t"))))
    return ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(rows, lambda x: x["t"]), separator).alias("context"))
