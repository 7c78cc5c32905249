"""What the operators share: written tables, names, and slices of batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.scratch import materialise, shared_root

__all__ = ["materialise", "numbered", "placed", "shared_root", "slices", "unused"]

#: Bits of a row's number within its partition in monotonically_increasing_id().
ROW_BITS = 33


def unused(columns: Iterable[str], name: str) -> str:
    """The name, with marks added until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> DataFrame:
    """df with columns c0, c1, ..., as functions over batches neither take every name nor should clash with it."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that few texts at a time are Python objects beside their Arrow form."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def placed(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """df with ``place``, its row's number from 0 in the given order, found without bringing the rows into one task.

    The rows are dealt out by ranges and written in order; the only thing that is summed in one task has a row a partition.
    """
    table = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("slot", F.monotonically_increasing_id()), label)
    part = F.shiftright("slot", ROW_BITS)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = table.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.col("slot").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return table.withColumn("part", part).join(F.broadcast(before), "part").withColumn("place", F.col("before") + inside).drop("part", "before", "slot")
