"""Bounded expansion over the graph, for many queries at once.

The seeds of a query are numbered, and a reached node carries marks: bit k of word w is set if seed 64 w + k reaches it. One hop is a
join with both directions of the allowed edges and a bitwise OR over (query, word, node), so that a node has one row whatever the
number of seeds and paths; the number of seeds that reach it is a count of bits. Hubs are joined in parts (see heavy).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.heavy import heavy_join, written
from quire.operators.ranked import first_entities

MAX_HOPS = 2
#: Seeds whose marks share one long. Spark's own bitmap aggregates have 32,768 bits, 4 KB for each node.
WORD = 64
Keep = Callable[[str, DataFrame], DataFrame]


def clamp_hops(hops: int) -> int:
    return max(1, min(int(hops), MAX_HOPS))


def seed_entities(hits: DataFrame, mentions: DataFrame) -> DataFrame:
    """Distinct (query_id, entity) that the hit chunks mention. hits: query_id, chunk_id; mentions: entity, chunk_id."""
    return hits.select("query_id", "chunk_id").join(mentions.select("entity", "chunk_id"), "chunk_id").select("query_id", "entity").distinct()


def turned(edges: DataFrame, relations: list[str] | None) -> DataFrame:
    """src, dst in both directions of the edges (src, rel_type, dst) of the given types, with their repeats; no types, no edges."""
    allowed = edges.filter(F.col("rel_type").isin(*relations) if relations else F.lit(False)).filter("src <> dst")
    return allowed.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))


def both_ways(edges: DataFrame, relations: list[str] | None) -> DataFrame:
    """src, dst in both directions of the edges, each once."""
    return turned(edges, relations).distinct()


def seed_marks(seeds: DataFrame) -> DataFrame:
    """query_id, word, node, mark, hop 0: each seed with its own bit."""
    number = F.dense_rank().over(Window.partitionBy("query_id").orderBy("entity")) - 1
    return seeds.select("query_id", F.col("entity").alias("node"), number.alias("number")).select(
        "query_id", F.floor(F.col("number") / WORD).cast("int").alias("word"), "node", F.expr(f"shiftleft(1L, number % {WORD})").alias("mark"), F.lit(0).alias("hop")
    )


def one_hop(marks: DataFrame, near: DataFrame, hop: int, keep: Keep = written) -> DataFrame:
    """The marks of the neighbours of marked nodes, a row for each neighbour and edge. near: src, dst, shown."""
    found = heavy_join(marks.select("query_id", "word", "node", "mark"), near.select(F.col("src").alias("node"), "dst", "shown"), "node", keep=keep)
    return found.select("query_id", "word", F.col("dst").alias("node"), "mark", F.lit(hop).alias("hop"), "shown")


def merged(marks: DataFrame) -> DataFrame:
    """One row for each query, word and node: all marks, and the first hop that reached it."""
    return marks.groupBy("query_id", "word", "node").agg(F.bit_or("mark").alias("mark"), F.min("hop").alias("hop"), F.max("shown").alias("shown"))


def reach(seeds: DataFrame, edges: DataFrame, hops: int, relations: list[str] | None, keep: Keep = written, results: DataFrame | None = None) -> DataFrame:
    """query_id, node, hop, n_seeds of the nodes within the clamped number of hops by paths that use no edge twice, seeds left out.

    Within two hops only the way back to the seed would use an edge twice. That puts a mark on a seed, and seeds are no result.
    ``results`` (node) are the nodes that may be results, all if None: whether a neighbour is one is told by the edges, so that the
    last hop makes no row of any other and those of the first go no further than to be passed through.
    """
    near = both_ways(edges, relations)
    shown = near.withColumn("shown", F.lit(True)) if results is None else near.join(results.select(F.col("node").alias("dst"), F.lit(True).alias("shown")).distinct(), "dst", "left")
    near = keep("near", shown.select("src", "dst", F.coalesce("shown", F.lit(False)).alias("shown")))
    start = keep("seed-marks", seed_marks(seeds).withColumn("shown", F.lit(True)))
    if clamp_hops(hops) == 1:
        found = one_hop(start, near.filter("shown"), 1, keep)
    else:
        first = keep("first-hop", merged(one_hop(start, near, 1, keep)))
        found = first.filter("shown").unionByName(one_hop(first, near.filter("shown"), 2, keep))
    one = merged(start.unionByName(found))
    if not start.agg(F.max("word")).first()[0]:  # no query has more seeds than a word has bits
        return one.select("query_id", "node", "hop", F.bit_count("mark").cast("long").alias("n_seeds")).filter("hop > 0")
    found = one.groupBy("query_id", "node").agg(F.min("hop").alias("hop"), F.sum(F.bit_count("mark")).alias("n_seeds"))
    return found.filter("hop > 0")


def expand_entities(seeds: DataFrame, edges: DataFrame, entities: DataFrame, hops: int = 2, relations: list[str] | None = None, most: int | None = None, keep: Keep = written) -> DataFrame:
    """query_id, entity, hop, n_seeds, rank of the entities around the seeds, without the seeds.

    ``entities`` (entity, name, type) are the nodes that may be results; others are only passed through. Ranked by hop, then
    seeds reached from (most first), then name and type; ``most`` keeps the first of each query, for which no row is made of the others
    (see ranked).
    """
    if most is not None:
        return first_entities(seeds, turned(edges, relations), entities, clamp_hops(hops), most, keep)
    counted = reach(seeds, edges, hops, relations, keep, entities.select(F.col("entity").alias("node"))).withColumnRenamed("node", "entity")
    order = Window.partitionBy("query_id").orderBy("hop", F.desc("n_seeds"), "name", "type", "entity")
    ranked = counted.join(entities.select("entity", "name", "type"), "entity").withColumn("rank", F.row_number().over(order))
    return ranked.select("query_id", "entity", "name", "type", "hop", "n_seeds", "rank")


def entity_chunks(expanded: DataFrame, mentions: DataFrame) -> DataFrame:
    """Every chunk of every expanded entity, without text. An entity is once in a query, so that mentions made distinct leave no row twice."""
    return expanded.join(mentions.select("entity", "chunk_id").distinct(), "entity").select("query_id", "entity", "rank", "chunk_id")


def postings(mentions: DataFrame, most: int) -> DataFrame:
    """entity, chunk_ids: the first ``most`` chunks of each entity in order, whatever the query.

    A rank limit prunes each task's rows before they are shuffled, so that an entity with half of all mentions leaves ``most`` distinct
    chunks a task.
    """
    order = Window.partitionBy("entity").orderBy("chunk_id")
    first = mentions.select("entity", "chunk_id").withColumn("n", F.dense_rank().over(order)).filter(F.col("n") <= most)
    return first.groupBy("entity").agg(F.sort_array(F.collect_set("chunk_id")).alias("chunk_ids"))


def posted_chunks(expanded: DataFrame, posted: DataFrame, keep: Keep = written, limits: tuple[int, int] | None = None) -> DataFrame:
    """query_id, entity, rank, chunk_id of the posted chunks of the expanded entities: at most a posting list for each.

    With ``limits``, the quota and cap of the choice that follows, those are left out that it cannot take (see within_reach). Ranks are
    unique in a query then, and the lists are those of select.needed().
    """
    asked = expanded.select("query_id", "entity", "rank")
    if limits is None:
        found = heavy_join(asked, posted.select("entity", "chunk_ids"), "entity", keep=keep)
        return found.select("query_id", "entity", "rank", F.explode("chunk_ids").alias("chunk_id"))
    sized = asked.join(posted.select("entity", F.size("chunk_ids").alias("n")), "entity")
    found = heavy_join(keep("within-reach", within_reach(sized, *limits)), posted.select("entity", "chunk_ids"), "entity", keep=keep)
    return found.select("query_id", "entity", "rank", F.explode(F.slice("chunk_ids", F.lit(1), F.col("most"))).alias("chunk_id"))


def within_reach(sized: DataFrame, quota: int, cap: int) -> DataFrame:
    """query_id, entity, rank, most: the entities that a greedy choice can come to, and how many chunks of each it can look at.

    sized: query_id, entity, rank, n (its chunks). Before an entity at most ``before`` chunks are taken, fewer than ``cap`` of them if it
    is come to at all. So its first quota + before are enough, and of n chunks min(quota, n - before) are taken for sure. Once such
    sure ones make ``cap``, the choice has ended, and no later entity is looked at.
    """
    earlier = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    before = F.least(F.lit(max(0, cap - 1)), F.coalesce(F.sum(F.least("n", F.lit(quota))).over(earlier), F.lit(0)))
    sure = F.coalesce(F.sum(F.greatest(F.lit(0), F.least(F.lit(quota), F.col("n") - F.col("before")))).over(earlier), F.lit(0))
    kept = sized.withColumn("before", before).withColumn("sure", sure).filter(F.col("sure") < cap)
    return kept.select("query_id", "entity", "rank", (F.col("before") + quota).cast("int").alias("most"))
