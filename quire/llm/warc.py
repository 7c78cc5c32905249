"""Merkle fixity audit of WARC replicas.

A replica is a table of records (file, offset, length, digest). Ordered offset ranges of a file are the leaves of its tree:
a leaf hashes its records in order of their offset, an inner node hashes FANOUT children in order, up to one root for each
file. An audit compares roots, and goes down only into children of nodes that differ, so that records are compared in
corrupt ranges alone.

A range of RANGE bytes and a node of FANOUT children bound what any group gathers, however large a file is; rows whose
offsets clash inside a range still sort by length and digest.

Records are hashed where their pages are scanned, and only lengths and digests are shuffled. Equal records of one page id are one row
with a number of copies until their offsets are known, so neither a repeated page nor an id that many share fills a task. A file
has the pages of PAGES_PER_FILE ids; past CROWDED distinct records it is dealt out over several by their digests. Names and offsets
follow from the table alone.

Defined cases: null url or html counts as empty; pages with a null or repeated id are records of their own; two empty replicas
agree; a file or range that one replica lacks differs; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.workspace import materialise

RANGE, FANOUT = 1 << 18, 16
#: Pages of a WARC file by their id, and distinct records after which a crowded file is dealt out over several.
PAGES_PER_FILE, CROWDED = 512, 4096
NODE = ["file", "place"]


def record_bytes(url: Column, html: Column) -> Column:
    """A WARC/1.1 resource record; the record id is derived from its content, so replicas agree."""
    body = F.coalesce(html, F.lit(""))
    target = F.coalesce(url, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "),
        target,
        F.lit("\r\nWARC-Record-ID: <urn:sha1:"),
        F.sha1(F.concat(target, F.lit("\n"), body).cast("binary")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


#: Copies of one record that are written out as rows at a time.
COPIES = 4096


def layout(rows: DataFrame) -> DataFrame:
    """file and offset of rows (page_id, length, digest, and what depends on them), in order of page id and digest within each file."""
    key = ["page_id", "length", "digest"]
    more = [c for c in rows.columns if c not in key]
    runs = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in more])
    runs = materialise(runs.withColumn("base", F.coalesce(F.floor(F.col("page_id") / PAGES_PER_FILE), F.lit(-1)).cast("long")), "warc-runs")
    sizes = runs.groupBy("base").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWDED)
    # One row at most for each CROWDED records; written, so that Spark sees how many.
    crowded = materialise(sizes.select("base", F.ceil(F.col("n") / CROWDED).cast("long").alias("parts")), "crowded-files")
    part = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % F.coalesce("parts", F.lit(1))
    named = runs.join(crowded, "base", "left").withColumn("file", F.concat(F.lit("part-"), F.col("base").cast("string"), F.lit("."), part.cast("string"), F.lit(".warc")))
    before = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0))
    placed = named.withColumn("start", start).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    copy = F.explode(F.sequence(F.col("block"), F.least(F.col("block") + COPIES, F.col("copies")) - 1))
    return placed.withColumn("copy", copy).select("file", (F.col("start") + F.col("copy") * F.col("length")).alias("offset"), *key, *more)


def _hashed(record: Column) -> Column:
    return F.sha2(record.cast("binary"), 256)


def _records(pages: DataFrame) -> DataFrame:
    """page_id, record."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), record_bytes(F.col("url").cast("string"), F.col("html").cast("string")).alias("record"))


def _length(record: Column) -> Column:
    return F.octet_length(record).cast("long")


def write_records(pages: DataFrame) -> DataFrame:
    """(file, offset, length, page_id, record): pages as records of WARC files, in order of their id."""
    rows = _records(pages).select("page_id", _length(F.col("record")).alias("length"), _hashed(F.col("record")).alias("digest"), "record")
    return layout(rows).select("file", "offset", "length", "page_id", "record")


def fixity(records: DataFrame) -> DataFrame:
    """A replica's table of digests; only this scan reads record contents."""
    return records.select("file", "offset", "length", "page_id", _hashed(F.col("record")).alias("digest"))


def _hash_of(children: Column) -> Column:
    return F.sha2(F.array_join(children, "|"), 256)


def leaves(replica: DataFrame, size: int = RANGE) -> DataFrame:
    line = F.concat_ws(":", F.lpad(F.col("offset").cast("string"), 20, "0"), F.col("length").cast("string"), F.col("digest"))
    return replica.groupBy("file", F.floor(F.col("offset") / size).cast("long").alias("place")).agg(_hash_of(F.sort_array(F.collect_list(line))).alias("hash"))


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    line = F.concat_ws(":", F.lpad(F.col("place").cast("string"), 20, "0"), F.col("hash"))
    return nodes.groupBy("file", F.floor(F.col("place") / fanout).cast("long").alias("place")).agg(_hash_of(F.sort_array(F.collect_list(line))).alias("hash"))


def tree(replica: DataFrame, label: str, size: int = RANGE, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from leaves to roots, each written once; the number of levels follows the longest file."""
    last = replica.agg(F.coalesce(F.max("offset"), F.lit(0)).alias("x")).first()["x"] // size
    levels = [materialise(leaves(replica, size), f"{label}-0")]
    while last > 0:
        last //= fanout
        levels.append(materialise(parents(levels[-1], fanout), f"{label}-{len(levels)}"))
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    other = b.withColumnRenamed("hash", "other")
    return a.join(other, NODE, "full_outer").filter(~F.col("hash").eqNullSafe(F.col("other"))).select(*NODE)


def differing_ranges(one: list[DataFrame], two: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """Leaves that differ, found from the roots down; children are compared only below nodes that differ."""
    empty = one[0].limit(0)
    depth = max(len(one), len(two))
    one, two = one + [None] * (depth - len(one)), two + [None] * (depth - len(two))
    found = None
    for k in reversed(range(depth)):
        a, b = (empty if x is None else x for x in (one[k], two[k]))
        if found is not None:
            below = found.select("file", F.col("place").alias("parent"))
            a, b = (x.withColumn("parent", F.floor(F.col("place") / fanout).cast("long")).join(below, ["file", "parent"], "left_semi").drop("parent") for x in (a, b))
        found = materialise(_differing(a, b), f"differing-{k}")
    return found


def audit(first: DataFrame, second: DataFrame, size: int = RANGE, fanout: int = FANOUT) -> DataFrame:
    """A row per record that differs: file, offset, page_id, status (corrupt, missing or extra, as seen from first).

    Both arguments are tables of fixity(); they must be readable again, as materialised ones are.
    """
    ranges = differing_ranges(tree(first, "first", size, fanout), tree(second, "second", size, fanout), fanout)

    def inside(replica: DataFrame, name: str) -> DataFrame:
        placed = replica.withColumn("place", F.floor(F.col("offset") / size).cast("long")).join(ranges, NODE, "left_semi")
        # Equal records of one offset are told apart by their number.
        again = F.row_number().over(Window.partitionBy("file", "offset").orderBy("length", "digest", "page_id")).alias("again")
        return placed.select("file", "offset", again, F.struct("length", "digest").alias(name), F.col("page_id").alias(f"{name}_id"))

    both = inside(first, "one").join(inside(second, "two"), ["file", "offset", "again"], "full_outer")
    status = F.when(F.col("two").isNull(), "missing").when(F.col("one").isNull(), "extra").otherwise("corrupt")
    return both.filter(~F.col("one").eqNullSafe(F.col("two"))).select("file", "offset", F.coalesce("one_id", "two_id").alias("page_id"), status.alias("status"))


def _draw() -> Column:
    return F.conv(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 6), 16, 10).cast("long") % 1000


def _spoilt() -> Column:
    """The record, or with its last mark changed where the draw says so."""
    return F.when(_draw() < 20, F.concat(F.expr("left(record, length(record) - 5)"), F.lit("#"), F.lit("\r\n\r\n"))).otherwise(F.col("record"))


def _lost() -> Column:
    return F.coalesce(_draw().between(20, 24), F.lit(False))


def damaged(records: DataFrame) -> DataFrame:
    """A replica with faults planted by the hash of the page: about one record in 50 has its last mark changed, one in 200 is lost."""
    return records.filter(~_lost()).withColumn("record", _spoilt())


def fixity_audit(pages: DataFrame) -> DataFrame:
    """Audit of the pages' WARC files against a replica with planted faults, as damaged() plants them."""
    rows = _records(pages).select("page_id", _length(F.col("record")).alias("length"), _hashed(F.col("record")).alias("digest"), F.when(_draw() < 20, _hashed(_spoilt())).alias("spoilt"))
    placed = materialise(layout(rows), "warc")
    first = placed.select("file", "offset", "length", "page_id", "digest")
    second = placed.filter(~_lost()).select("file", "offset", "length", "page_id", F.coalesce("spoilt", "digest").alias("digest"))
    return audit(first, second)
