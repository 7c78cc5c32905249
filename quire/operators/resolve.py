"""Canonical entity names: spellings that share a key and a kind are one entity.

Names are keyed once per distinct spelling, so the one Python function of the build sees each spelling once. Counts are
partial sums before the shuffle; a name that a third of the rows carry is one row after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import has_both_cases, norm_key

#: Rows and bytes of the abbreviation table up to which it is sent to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20


def small(df: DataFrame) -> DataFrame:
    """df (of strings) with a broadcast hint if it is measured to be small; else Spark joins it by a shuffle."""
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in df.columns), F.lit(0)).cast("long")).alias("bytes")).first()
    return F.broadcast(df) if size["n"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES else df


def expand_abbreviations(names: DataFrame, table: DataFrame) -> DataFrame:
    """names (distinct ``name``) with ``full``: the long form of an abbreviation, or the name; applied once."""
    keyed = names.select("name", norm_key("name").alias("norm_key"))
    full = F.coalesce(F.nullif("full_name", F.lit("")), F.col("name"))
    return keyed.join(small(table.select("norm_key", "full_name")), "norm_key", "left").select("name", full.alias("full"))


def keyed_names(names: DataFrame, table: DataFrame) -> DataFrame:
    """name, full, norm_key (of the full name) for every distinct name."""
    return expand_abbreviations(names.select("name").distinct(), table).withColumn("norm_key", norm_key("full"))


def canonical_by_count(counted: DataFrame) -> DataFrame:
    """counted (norm_key, type, name, n) to (norm_key, type, canonical): the most frequent spelling, then one with both cases, then the greatest."""
    rank = F.struct("n", has_both_cases(F.col("name")).alias("proper"), F.col("name").alias("spelling"))
    return counted.groupBy("norm_key", "type").agg(F.max_by("name", rank).alias("canonical"))


def name_counts(mentioned: DataFrame, table: DataFrame, sign: int = 1) -> DataFrame:
    """norm_key, type, name, n: papers that list each spelling, after abbreviations. mentioned: filename, name, type, one row per paper and spelling."""
    names = keyed_names(mentioned, table)
    counted = mentioned.groupBy("name", "type").agg(F.count(F.lit(1)).alias("k")).join(names, "name").filter("full <> ''")
    return counted.groupBy("norm_key", "type", F.col("full").alias("name")).agg((F.sum("k") * sign).alias("n"))


def entity_index(mentioned: DataFrame, table: DataFrame) -> DataFrame:
    """mentioned to the canonical name of each (norm_key, type)."""
    return canonical_by_count(name_counts(mentioned, table))


def count_changes(gone: DataFrame, come: DataFrame, table: DataFrame) -> DataFrame:
    """norm_key, type, name, n: by how much each spelling's count rises or falls, where it does; gone and come are rows as in name_counts()."""
    both = name_counts(come, table).unionByName(name_counts(gone, table, -1))
    return both.groupBy("norm_key", "type", "name").agg(F.sum("n").alias("n")).filter("n <> 0")


def touched_names(counts: DataFrame, index: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What changes in counts and index, resolved for the touched keys alone.

    The counts of the touched keys (norm_key, type, name, n), 0 where a spelling is gone; their canonical names; and ``renamed``
    (norm_key, type, old, canonical), old or canonical null where there was or is none.
    """
    key = ["norm_key", "type"]
    touched = changes.select(*key).distinct()
    own = counts.join(touched, key, "left_semi").select("norm_key", "type", "name", "n").unionByName(changes)
    own = own.groupBy("norm_key", "type", "name").agg(F.sum("n").alias("n"))
    now = canonical_by_count(own.filter("n > 0"))
    before = index.join(touched, key, "left_semi").select(*key, F.col("canonical").alias("old"))
    renamed = before.join(now, key, "full_outer").filter(~F.col("old").eqNullSafe(F.col("canonical")))
    return own, now, renamed


def moved(edges: DataFrame, renamed: DataFrame, entity_key) -> DataFrame:
    """Edges with the ends of renamed entities under their new names; an entity whose last spelling is gone takes its edges with it.

    Entities are few beside edges: the renamed ones are joined from each end, with a broadcast if they are measured to be small.
    """
    names = renamed.filter("old IS NOT NULL").select(entity_key(F.col("old"), F.col("type")).alias("was"), entity_key(F.col("canonical"), F.col("type")).alias("is"))
    names = small(names)
    for end in ("src", "dst"):
        own = names.select(F.col("was").alias("was_key"), F.col("is").alias("is_key"), F.lit("Entity").alias("was_label"))
        edges = edges.join(own, (F.col(f"{end}_key") == F.col("was_key")) & (F.col(f"{end}_label") == F.col("was_label")), "left")
        edges = edges.filter("was_key IS NULL OR is_key IS NOT NULL").withColumn(f"{end}_key", F.coalesce("is_key", f"{end}_key")).drop("was_key", "is_key", "was_label")
    return edges.distinct()


def add_fallbacks(index: DataFrame, references: DataFrame) -> DataFrame:
    """index with an entry for every reference (norm_key, type, full, place) that it lacks: the spelling at the first place.

    ``place`` is a struct that orders references as they are met.
    """
    lacking = references.join(index, ["norm_key", "type"], "left_anti")
    first = lacking.groupBy("norm_key", "type").agg(F.min_by("full", "place").alias("canonical"))
    return index.unionByName(first)


def place(filename: Column, phase: int, position: Column, slot: int) -> Column:
    """Order in which references are met: file, then mentions, results, relations, then their position and end."""
    return F.struct(filename.alias("filename"), F.lit(phase).alias("phase"), position.cast("long").alias("position"), F.lit(slot).alias("slot"))


def begin(filename: Column) -> Column:
    """The first seven bytes of a name as a number in the same order; -1 for null, which comes first."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(filename.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long"), F.lit(-1))
