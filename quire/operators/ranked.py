"""The first entities around the seeds of many queries, from lists that are made once for each seed.

A row for each query and neighbour is more than any table holds where queries share hubs. Here each node has a list of the entities
beside it, by their place in the order of names, and each seed one of those within its hops. Lists meet in their queries whole, as
arrays, and the first ``most`` of a query are counted there.

The lists of hubs, nodes with more than HUB entities, are cut without loss. Before an entity that only one hub brings come, by name,
all that the hub brings before it: they rank no lower, unless they are seeds. So ``most`` entities and the seeds of a query are
enough of them. Entities beside two hubs or more stay in the lists of all of these. An entity beside one hub carries its number, so
that one met in another list still counts the seeds that reach it through the hub.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.heavy import heavy_join, written
from quire.operators.resolve import small

#: Entities beside a node beyond which it is a hub, and entries of a list in one row.
HUB, BLOCK = 1000, 512
#: What a row of a seed's list holds: entities, entities with their only hub, hubs on the way, the seed itself.
ENTRY, TIED, VIA, OWN = range(4)
Keep = Callable[[str, DataFrame], DataFrame]


def first_entities(seeds: DataFrame, near: DataFrame, entities: DataFrame, hops: int, most: int, keep: Keep = written, hub: int = HUB) -> DataFrame:
    """query_id, entity, name, type, hop, n_seeds, rank of the first ``most`` of each query, as traverse.expand_entities() ranks them.

    near: src, dst in both directions, repeats allowed.
    """
    named = keep("named", entities.select("entity", "name", "type").orderBy("name", "type", "entity").withColumn("v", F.monotonically_increasing_id()))
    seeds = keep("seeds", seeds.select("query_id", "entity").distinct())
    names = keep("seed-names", seeds.select("entity").distinct().withColumn("s", F.monotonically_increasing_id()))
    lists = keep("lists", listed(near.join(named.select(F.col("entity").alias("dst"), "v"), "dst").select("src", "v")))
    made = keep("seed-lists", _seed_lists(seeds, names, near, named, lists, hops, most, keep, hub))
    asked = keep("asked", seeds.join(names, "entity").select("query_id", "s"))
    met = heavy_join(asked, made, "s", keep=keep).select("query_id", "s", "kind", "hop", "a", "b").repartition("query_id").sortWithinPartitions("query_id")
    kind = seeds.schema["query_id"].dataType.simpleString()
    top = met.mapInArrow(lambda b: _first(b, most), f"query_id {kind}, v long, hop int, n_seeds long, rank int")
    return top.join(named, "v").select("query_id", "entity", "name", "type", "hop", "n_seeds", "rank")


def listed(pairs: DataFrame) -> DataFrame:
    """src, block, vs: the distinct v of each src in order, at most BLOCK in a row. pairs: src, v."""
    place = F.dense_rank().over(Window.partitionBy("src").orderBy("v")) - 1
    blocks = pairs.withColumn("block", F.floor(place / BLOCK).cast("int"))
    return blocks.groupBy("src", "block").agg(F.sort_array(F.collect_set("v")).alias("vs"))


def _rows(kind: int, df: DataFrame, a: str, b: str | None = None, hop: int = 0) -> DataFrame:
    none = F.array().cast("array<bigint>")
    own_hop = F.col("hop") if "hop" in df.columns else F.lit(hop)
    return df.select("s", F.lit(kind).alias("kind"), own_hop.cast("int").alias("hop"), F.col(a).alias("a"), (none if b is None else F.col(b)).alias("b"))


def _cut(lists: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Long arrays in rows of at most BLOCK entries."""
    cuts = F.explode(F.sequence(F.lit(0), F.floor((F.size(columns[0]) - 1) / BLOCK).cast("int"))).alias("cut")
    return lists.select(*key, *columns, cuts).select(*key, *[F.slice(c, F.col("cut") * BLOCK + 1, BLOCK).alias(c) for c in columns])


def _seed_lists(seeds: DataFrame, names: DataFrame, near: DataFrame, named: DataFrame, lists: DataFrame, hops: int, most: int, keep: Keep, hub: int) -> DataFrame:
    """s, kind, hop, a, b: what each seed brings to its queries."""
    sizes = lists.groupBy(F.col("src").alias("node")).agg(F.sum(F.size("vs")).alias("n")).filter(F.col("n") > hub)
    hubs = keep("hubs", sizes.select("node", F.monotonically_increasing_id().alias("h")))
    any_hub = not hubs.isEmpty()
    light = lists.join(small(hubs.select(F.col("node").alias("src"))), "src", "left_anti") if any_hub else lists
    own = names.join(named.select("entity", "v"), "entity").groupBy("s").agg(F.collect_list("v").alias("v"))
    parts = [_rows(OWN, own, "v")]
    here = names.select(F.col("entity").alias("src"), "s")
    direct = light.join(here, "src").select("s", "vs")
    if hops == 1 and not any_hub:
        return reduce(DataFrame.unionByName, [_rows(ENTRY, direct, "vs", hop=1), *parts])
    found = [direct.select("s", F.explode("vs").alias("v"), F.lit(1).alias("hop"))]
    via = [here.join(small(hubs), F.col("src") == F.col("node")).select("s", "h", F.lit(1).alias("hop"))]
    if hops > 1:
        middles = keep("middles", near.join(here, "src").select("s", F.col("dst").alias("src")).distinct())
        found.append(heavy_join(middles, light if not any_hub else keep("light", light), "src", keep=keep).select("s", F.explode("vs").alias("v"), F.lit(2).alias("hop")))
        via.append(middles.join(small(hubs), F.col("src") == F.col("node")).select("s", "h", F.lit(2).alias("hop")))
    if any_hub:
        ways = keep("ways", reduce(DataFrame.unionByName, via).groupBy("s", "h").agg(F.min("hop").alias("hop")))
        parts.append(_rows(VIA, ways.groupBy("s", "hop").agg(F.collect_list("h").alias("h")), "h"))
        of_hubs = keep("of-hubs", lists.join(small(hubs.withColumnRenamed("node", "src")), "src").select("h", "block", "vs"))
        pairs = of_hubs.select("h", F.explode("vs").alias("v"))
        beside = keep("beside", pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("h")))
        many = pairs.join(beside.filter("n > 1").select("v"), "v", "left_semi")
        enough = most + (seeds.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0)
        begin = of_hubs.filter(F.col("block") * BLOCK < enough).select("h", F.explode(F.slice("vs", F.lit(1), F.lit(enough) - F.col("block") * BLOCK)).alias("v"))
        found.append(ways.join(many.unionByName(begin).distinct(), "h").select("s", "v", "hop"))
    entries = reduce(DataFrame.unionByName, found).groupBy("s", "v").agg(F.min("hop").alias("hop"))
    if any_hub:
        entries = keep("entries", entries)
        tied = entries.join(beside.filter("n = 1").select("v", "h"), "v").groupBy("s").agg(F.collect_list(F.struct("v", "h")).alias("x")).select("s", F.col("x.v").alias("v"), F.col("x.h").alias("h"))
        parts.append(_rows(TIED, _cut(tied, ["s"], ["v", "h"]), "v", "h"))
    whole = entries.groupBy("s", "hop").agg(F.sort_array(F.collect_list("v")).alias("v"))
    return reduce(DataFrame.unionByName, [_rows(ENTRY, _cut(whole, ["s", "hop"], ["v"]), "v"), *parts])


def _first(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The first of each query; rows come in groups of a query, which may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        query = _numbers(batch.column(0))
        last = int(np.flatnonzero(query == query[-1])[0])
        if held and batch.column(0)[0] != held[-1].column(0)[-1]:
            yield _ranked(held, most)
            held = []
        if last:
            yield _ranked([*held, batch.slice(0, last)], most)
            held = []
        held.append(batch.slice(last))
    if held:
        yield _ranked(held, most)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy()


def _ranked(batches: list[pa.RecordBatch], most: int) -> pa.RecordBatch:
    """query_id, v, hop, n_seeds, rank of whole queries."""
    table = pa.Table.from_batches(batches).combine_chunks()
    ids, kind, hop = table["query_id"].combine_chunks(), table["kind"].to_numpy(), table["hop"].to_numpy()
    query, seed = _numbers(ids), table["s"].to_numpy()

    def flat(which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, a and b of each entry of the rows of a kind."""
        rows = np.flatnonzero(kind == which)
        own = table.take(pa.array(rows))
        a, b = own["a"].combine_chunks(), own["b"].combine_chunks()
        return np.repeat(rows, np.diff(a.offsets.to_numpy())), a.flatten().to_numpy(), b.flatten().to_numpy()

    rows, v, _ = flat(ENTRY)
    q, s, h = query[rows], seed[rows], hop[rows]
    tied, tied_v, tied_h = flat(TIED)
    via, via_h, _ = flat(VIA)
    if len(tied) and len(via):
        _, numbers = np.unique(np.concatenate((tied_h, via_h)), return_inverse=True)
        n = numbers.max() + 1
        at, to = query[tied] * n + numbers[: len(tied)], query[via] * n + numbers[len(tied) :]
        order = np.argsort(to, kind="stable")
        begin, end = np.searchsorted(to[order], at, "left"), np.searchsorted(to[order], at, "right")
        many = end - begin
        each = via[order[np.repeat(begin - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())]]
        q, s, h, v = (np.concatenate(x) for x in ((q, np.repeat(query[tied], many)), (s, seed[each]), (h, hop[each]), (v, np.repeat(tied_v, many))))
    values, place = np.unique(v, return_inverse=True)
    node = q.astype(np.int64) * max(1, len(values)) + place
    if len(tied):  # a seed may reach an entity by its list and by a hub
        order = np.lexsort((h, s, node))
        first = np.ones(len(order), bool)
        first[1:] = (np.diff(node[order]) != 0) | (np.diff(s[order]) != 0)
        order = order[first]
    else:
        order = np.argsort(node, kind="stable")
    node, h = node[order], h[order]
    starts = np.flatnonzero(np.concatenate(([True], np.diff(node) != 0))) if len(node) else np.zeros(0, np.int64)
    count = np.diff(np.append(starts, len(node)))
    near = np.minimum.reduceat(h, starts) if len(starts) else h
    node = node[starts]
    rows, v, _ = flat(OWN)
    at = np.searchsorted(values, v)
    known = at < len(values)
    known[known] = values[at[known]] == v[known]
    free = ~np.isin(node, query[rows][known].astype(np.int64) * max(1, len(values)) + at[known])
    node, count, near = node[free], count[free], near[free]
    q, place = np.divmod(node, max(1, len(values)))
    order = np.lexsort((place, -count, near, q))
    q, place, count, near = q[order], place[order], count[order], near[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
    kept = rank <= most
    spot = np.unique(query, return_index=True)[1]
    columns = [ids.take(pa.array(spot[q[kept]])), pa.array(values[place[kept]], pa.int64()), pa.array(near[kept], pa.int32()), pa.array(count[kept], pa.int64()), pa.array(rank[kept], pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["query_id", "v", "hop", "n_seeds", "rank"])
