"""Connected components of a link table by alternating large and small stars, with no driver-side links.

Links are first contracted inside each partition, so that chains and dense groups reach the shuffles as stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.workspace import materialise

EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


#: Nodes that one contraction holds before it gives out its stars and starts anew.
HELD = 1 << 20
#: Neighbours of a node from which its join is dealt out over several tasks.
HEAVY = 1 << 20


def _contract(batches: Iterator[pa.RecordBatch], held: int = HELD) -> Iterator[pa.RecordBatch]:
    """Stars (member, smallest member) of the components of the partition's links, for about ``held`` nodes at a time."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def stars() -> Iterator[pa.RecordBatch]:
        star = [(x, root(x)) for x in parent]
        star = [(x, r) for x, r in star if x != r]
        for k in range(0, len(star), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*star[k : k + (1 << 16)], strict=True)], schema=EDGE)
        parent.clear()

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > held:
            yield from stars()
    yield from stars()


def _with_least(rows: DataFrame, heavy: int | None) -> DataFrame:
    """rows (u, v) with m, the smallest v of their u. With ``heavy``, the rows of a u that has more are dealt out over several tasks."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    if heavy is None:
        return rows.join(least.drop("n"), "u")
    least = materialise(least, "least")
    # One row at most for each ``heavy`` links; left to Spark to broadcast while it is small.
    large = materialise(least.filter(F.col("n") > heavy).select("u", F.ceil(F.col("n") / heavy).cast("int").alias("parts")), "heavy")
    part = F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = rows.join(large, "u", "left").select("u", "v", part.alias("part"))
    parts = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / heavy).cast("int") - 1))
    return dealt.join(least.select("u", "m", parts.alias("part")), ["u", "part"]).drop("part")


def _large_star(edges: DataFrame, heavy: int | None) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, heavy).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, heavy: int | None) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = _with_least(down, heavy)
    return moved.select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def components(links: DataFrame, max_rounds: int = 60, heavy: int = HEAVY) -> DataFrame:
    """(node, root) for every node with a link to another; root is the smallest node reachable.

    ``links`` has long columns u and v; repeats, both directions and self links are allowed. Without links the
    result is empty.
    """
    edges = materialise(links.select("u", "v").filter("u <> v").mapInArrow(_contract, "u long, v long").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        mark = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        state = (mark["n"], mark["h"])
        if state == before or not mark["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        if mark["n"] <= heavy // 2:  # no node has more links than that, in both directions
            edges = materialise(_small_star(_large_star(edges, None), None), "stars")
        else:
            edges = materialise(_small_star(materialise(_large_star(edges, heavy), "large-stars"), heavy), "stars")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
