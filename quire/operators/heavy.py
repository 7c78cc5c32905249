"""Equi-joins in which a few keys may hold a large share of the rows of either side.

Light keys are joined as Spark joins them. The rows of a heavy key are numbered into parts on the left and blocks on the right,
and only those rows are dealt out: each left row meets every block of its key and each right row every part, so that each pair is
made once and no task gets more than about MOST rows of one key from either side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.scratch import materialise

#: Rows of a key beyond which it is heavy, and the most heavy keys that are sent to the tasks.
MOST, KEYS = 100_000, 50_000


def written(name: str, df: DataFrame) -> DataFrame:
    """df as a table in the folder that all executors share."""
    return materialise(df, name)


def heavy_keys(left: DataFrame, right: DataFrame, key: str, most: int = MOST, keep: Callable[[str, DataFrame], DataFrame] = written) -> DataFrame | None:
    """key, parts, blocks of the keys in both sides with more than ``most`` rows in one; None if there are none.

    At most 2 * KEYS keys come back: with n rows of heavy keys there are no more than KEYS that have over n / KEYS on a side, and
    beyond that number the limit rises to n / KEYS.
    """
    if max(left.count(), right.count()) <= most:  # of written tables, a look at their footers
        return None
    both = left.groupBy(key).agg(F.count(F.lit(1)).alias("l")).join(right.groupBy(key).agg(F.count(F.lit(1)).alias("r")), key)
    found = keep("heavy", both.filter((F.col("l") > most) | (F.col("r") > most)))
    sums = found.agg(F.count(F.lit(1)).alias("n"), F.sum("l").alias("l"), F.sum("r").alias("r")).first()
    if not sums["n"]:
        return None
    limit = most if sums["n"] <= KEYS else max(most, -(-max(sums["l"], sums["r"]) // KEYS))
    found = found.filter((F.col("l") > limit) | (F.col("r") > limit))
    return found.select(key, F.ceil(F.col("l") / limit).cast("int").alias("parts"), F.ceil(F.col("r") / limit).cast("int").alias("blocks"))


def _dealt(rows: DataFrame, heavy: DataFrame, key: str, own: str, other: str, own_count: str, other_count: str) -> DataFrame:
    """rows with their own number within a heavy key, once for each number of the other side; light rows once, with numbers 0."""
    place: Column = F.pmod(F.xxhash64(*rows.columns), F.coalesce(F.col(own_count), F.lit(1)).cast("long")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other_count), F.lit(1)) - 1))
    return rows.join(F.broadcast(heavy), key, "left").withColumn(own, place).withColumn(other, every).drop("parts", "blocks")


def heavy_join(left: DataFrame, right: DataFrame, key: str, most: int = MOST, keep: Callable[[str, DataFrame], DataFrame] = written) -> DataFrame:
    """The inner join on ``key``. Both sides are read twice, once to count their keys: give written tables."""
    heavy = heavy_keys(left, right, key, most, keep)
    if heavy is None:
        return left.join(right, key)
    one, two = _dealt(left, heavy, key, "part", "block", "parts", "blocks"), _dealt(right, heavy, key, "block", "part", "blocks", "parts")
    return one.join(two, [key, "part", "block"]).drop("part", "block")
