"""Importance resampling towards a target: documents whose hashed word features are likelier in the target are drawn more often.

The features of the corpus are counted as strings: a task counts the distinct ones of what it reads and sends them, sorted and packed
in blocks, to shards, whose number follows the text. A shard makes one dictionary of its features and adds their counts; each
distinct string is then hashed once, its count goes to its bucket, and the gains of the buckets (a table of BUCKETS rows, whatever
the corpus) go back to the features of each document. The draw is by Gumbel noise that a hash of the id
fixes: rows are ordered by ranges and numbered from the sizes of the ranges, so that no task sees all of them.

Defined cases: a null, empty or wordless text has no features, weight 0 and is never drawn; ids that are null hash as '' and
come last among ties; repeated rows are drawn one by one; an empty corpus gives an empty result and an empty target counts
nothing; texts are read whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.terms import byte_class, coded_words, slices_of_bytes
from quire.llm.workspace import materialise, placed

BUCKETS = 10_000
MIN_WORDS = 20
DRAWN_PERCENT = 25
SEED = "7"

#: Bytes of text whose features are one shard, so that a task can hold its distinct ones.
SHARD_BYTES = 16 << 20

WORDS = byte_class(("0", "9"))
#: Odd factors that spread words and pairs over shards.
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def _features(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words and pairs (binary), their codes at each place of the batch, the text of each place, the words of each text,
    and a number of each distinct feature that its words alone decide."""
    codes, names, sizes = coded_words(texts, WORDS)
    row = np.repeat(np.arange(len(sizes)), sizes)
    paired = np.flatnonzero(row[1:] == row[:-1])
    pairs, places = np.unique(codes[paired] * max(1, len(names)) + codes[paired + 1], return_inverse=True)
    left, right = pairs // max(1, len(names)), pairs % max(1, len(names))
    joined = pc.binary_join_element_wise(names.take(pa.array(left)), names.take(pa.array(right)), pa.scalar(b" ", pa.large_binary()))
    of_word = np.fromiter(map(crc32, names.to_pylist()), np.uint64, len(names))
    spread = np.concatenate([of_word * _SPREAD[0], of_word[left] * _SPREAD[1] + of_word[right] * _SPREAD[2]]) >> np.uint64(24)
    return pa.concat_arrays([names, joined]), np.concatenate([codes, places + len(names)]), np.concatenate([row, row[paired]]), sizes, spread


def _blocks(batches: Iterable[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Distinct features and their counts, a block for each slice of text and shard: sorted, joined by line feeds (which no feature has) and packed."""
    for batch in slices_of_bytes(batches, 0):
        names, codes, _, _, spread = _features(batch.column(0))
        if not len(names):
            continue
        counts = np.bincount(codes, minlength=len(names)).astype("<u4")
        order = pc.sort_indices(names).to_numpy()
        shard = (spread % np.uint64(shards)).astype(np.int64)
        order = order[np.argsort(shard[order], kind="stable")]
        own, first = np.unique(shard[order], return_index=True)
        cuts = np.append(first, len(order)).astype(np.int64)
        lists = pa.LargeListArray.from_arrays(pa.array(cuts), names.take(pa.array(order)))
        joined = pc.binary_join(lists, pa.scalar(b"\n", pa.large_binary())).to_pylist()
        packed = [pa.compress(x, codec="zstd", asbytes=True) for x in joined]
        numbers = [counts[order[i:j]].tobytes() for i, j in zip(cuts, cuts[1:])]
        columns = [pa.array(own), pa.array([len(x) for x in joined], pa.int64()), pa.array(packed, pa.binary()), pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in numbers], pa.binary())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(cuts))], names=["shard", "size", "features", "counts", "n"])


def _dictionary(blocks: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The distinct features of a shard and their counts."""
    parts, counts = [], []
    for row in zip(*(blocks[c].to_pylist() for c in ("size", "features", "counts", "n")), strict=True):
        text = pa.decompress(row[1], row[0], codec="zstd", asbytes=True)
        parts.append(pc.split_pattern(pa.array([text], pa.large_binary()), b"\n").flatten())
        counts.append(np.frombuffer(pa.decompress(row[2], 4 * row[3], codec="zstd", asbytes=True), "<u4"))
    coded = pa.concat_arrays(parts).dictionary_encode()
    total = np.zeros(len(coded.dictionary), dtype=np.int64)
    np.add.at(total, coded.indices.to_numpy(), np.concatenate(counts).astype(np.int64))
    return coded.dictionary, total


def _hashed(features: pa.Array) -> np.ndarray:
    """The bucket of each feature; few are Python objects at a time."""
    parts = (features.slice(k, 65_536) for k in range(0, len(features), 65_536))
    return np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(crc32, x.to_pylist()), np.int64, len(x)) for x in parts)]) % BUCKETS


def _to_counts(blocks: pa.Table) -> pa.Table:
    features, total = _dictionary(blocks)
    return pa.table({"feature": features.cast(pa.large_string()).cast(pa.string()), "n": total})


def _to_buckets(blocks: pa.Table) -> pa.Table:
    features, total = _dictionary(blocks)
    by_bucket = np.zeros(BUCKETS, dtype=np.int64)
    np.add.at(by_bucket, _hashed(features), total)
    met = np.flatnonzero(by_bucket)
    return pa.table({"bucket": pa.array(met.astype(np.int32)), "n": by_bucket[met]})


def _sharded(texts: DataFrame):
    """Blocks of features by shard; there are as many shards as SHARD_BYTES go into the texts."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 + size // SHARD_BYTES
    return texts.select("text").mapInArrow(lambda b: _blocks(b, shards), "shard long, size long, features binary, counts binary, n long").groupBy("shard")


def feature_counts(texts: DataFrame) -> DataFrame:
    """feature, n: every distinct word and pair of neighbouring words of all texts, and how often it occurs."""
    return _sharded(texts).applyInArrow(_to_counts, "feature string, n long")


def bucket_counts(texts: DataFrame) -> DataFrame:
    """bucket, n: occurrences of the features of each bucket that has any. Each distinct feature of all texts is hashed once."""
    return _sharded(texts).applyInArrow(_to_buckets, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """bucket, gain (long) for all BUCKETS: thousandths of the log ratio of the smoothed shares in target and corpus."""
    spark = corpus.sparkSession
    s = bucket_counts(corpus).withColumn("t", F.lit(0).cast("long")).withColumnRenamed("n", "s")
    t = bucket_counts(target).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    met = materialise(s.unionByName(t).unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "resampling-buckets")
    every_bucket = Window.partitionBy()
    all_s, all_t = (F.sum(c).over(every_bucket).cast("double") + float(BUCKETS) for c in ("s", "t"))
    ratio = (F.col("t") + 1.0) * all_s / ((F.col("s") + 1.0) * all_t)
    return met.select("bucket", F.floor(1000.0 * F.log(ratio)).cast("long").alias("gain"))


def document_weights(docs: DataFrame, gains: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean gain of a document's features."""
    by_bucket = np.zeros(BUCKETS, dtype=np.int64)
    for r in gains.collect():
        by_bucket[r["bucket"]] = r["gain"]
    sent = docs.sparkSession.sparkContext.broadcast(by_bucket)

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of_bytes(batches, 1):
            names, codes, rows, sizes, _ = _features(batch.column(1))
            hashed = _hashed(names)
            order = np.argsort(rows, kind="stable")
            total = np.concatenate([[0], np.cumsum(sent.value[hashed][codes[order]])])
            n = np.bincount(rows, minlength=batch.num_rows)
            ends = np.cumsum(n)
            mean = (total[ends] - total[ends - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, n, mean))], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, least: int = MIN_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; the rank of those that are not drawn is null.

    ``percent`` of the documents with ``least`` words or more are drawn, rounded down, by the highest scores.
    """
    weighed = document_weights(docs, bucket_gains(docs, target))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = materialise(weighed.withColumn("score", F.col("weight") + noise), "resampling-scores")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    enough = placed(scored.filter(F.col("n_words") >= least), order, "resampling-order")
    drawn = percent * scored.filter(F.col("n_words") >= least).count() // 100
    ranked = enough.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    rest = scored.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*columns).unionByName(rest.select(*columns))
