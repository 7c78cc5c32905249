"""Scans of Markdown folders, incremental differences, and JSON imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructType

from quire.functions.text import norm_key, text_of, title_of
from quire.schemas import EXTRACTIONS


#: Changed files up to which their paths are named to Spark one by one; of more, the whole folder is read and joined.
NAMED_FILES = 10_000


def _binary(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(paths)


def list_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """filename, path, length, modified of the folder's files, from their metadata: no content is read."""
    return _binary(spark, folder).select(F.substring_index("path", "/", -1).alias("filename"), "path", "length", F.col("modificationTime").alias("modified"))


def to_look_at(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Files of a listing whose size or time of change isn't that of the manifest; the others are taken as they were."""
    known = manifest.select("filename", "length", "modified").filter("length IS NOT NULL AND modified IS NOT NULL")
    return listing.join(known, ["filename", "length", "modified"], "left_anti")


def read_files(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The rows of scan_markdown() of the wanted files (path), which alone are read if they are at most NAMED_FILES."""
    paths = [r["path"] for r in wanted.select("path").limit(NAMED_FILES + 1).collect()]
    if not paths:
        return read_markdown(_binary(spark, folder).limit(0))
    if len(paths) <= NAMED_FILES:
        return read_markdown(_binary(spark, paths))
    return read_markdown(_binary(spark, folder).join(wanted.select("path"), "path", "left_semi"))


def scan_markdown(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """filename, title, content, text, md5 (of the bytes), text_md5; not recursive. ``limit`` takes the first names.

    Spark passes over names that begin with a dot or an underscore.
    """
    files = _binary(spark, folder)
    if limit is not None:
        # The names alone are ordered; a limit is a small number that the caller gives.
        first = list_markdown(spark, folder).orderBy("filename").limit(limit)
        files = files.join(F.broadcast(first.select("path")), "path", "left_semi")
    return read_markdown(files)


def read_markdown(files: DataFrame) -> DataFrame:
    """The rows of scan_markdown() of binary files (path, content)."""
    named = files.select(F.substring_index("path", "/", -1).alias("filename"), "content")
    text = text_of(F.col("content"))
    return named.select("filename", title_of(F.col("filename")).alias("title"), "content", text.alias("text"), F.md5("content").alias("md5"), F.md5(text.cast("binary")).alias("text_md5"))


def manifest_diff(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """filename, md5, old_md5, chunk_count, status in new, modified, removed, unchanged: one full join on the name."""
    old = manifest.select("filename", F.col("md5").alias("old_md5"), "chunk_count")
    status = F.when(F.col("old_md5").isNull(), "new").when(F.col("md5").isNull(), "removed").when(F.col("md5") != F.col("old_md5"), "modified").otherwise("unchanged")
    return old.join(listing.select("filename", "md5"), "filename", "full_outer").select("filename", "md5", "old_md5", "chunk_count", status.alias("status"))


def to_add(diff: DataFrame) -> DataFrame:
    return diff.filter(F.col("status").isin("new", "modified"))


def to_delete(diff: DataFrame) -> DataFrame:
    return diff.filter(F.col("status").isin("removed", "modified"))


def deleted_chunk_ids(diff: DataFrame) -> DataFrame:
    """filename, chunk_id of every chunk that the old manifest counts for a removed or modified file."""
    counted = to_delete(diff).filter("chunk_count > 0")
    return counted.select("filename", F.explode(F.sequence(F.lit(0), F.col("chunk_count").cast("int") - 1)).alias("k")).select("filename", F.concat("filename", F.lit("::"), F.col("k").cast("string")).alias("chunk_id"))


def cache_miss(files: DataFrame, cache: DataFrame, schema_version: int) -> DataFrame:
    """Files whose text or schema version the cache doesn't hold."""
    known = cache.select("filename", F.col("content_hash").alias("text_md5"), "schema_version").filter(F.col("schema_version") == schema_version).drop("schema_version")
    return files.join(known, ["filename", "text_md5"], "left_anti")


def read_abbreviations(spark: SparkSession, path: str) -> DataFrame:
    """norm_key, full_name from a JSON object; of keys that meet, the later wins."""
    return abbreviations(spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m")).select(F.posexplode("m").alias("place", "short", "full_name")))


def abbreviations(rows: DataFrame) -> DataFrame:
    """rows: place, short, full_name."""
    return rows.select(norm_key("short").alias("norm_key"), "full_name", "place").groupBy("norm_key").agg(F.max_by("full_name", "place").alias("full_name"))


#: Between two entries of an object that is written with an indent of two: a brace after exactly two blanks ends an entry, as
#: whatever is nested deeper has more before it, and a text has no line end of its own in JSON.
ENTRY_END = "\n  },\n"


def is_indented(spark: SparkSession, path: str) -> bool:
    """Whether the object's entries are told by ENTRY_END: the first two lines say so."""
    head = [r["value"] for r in spark.read.text(path).limit(2).collect()]
    return len(head) == 2 and head[0] == "{" and head[1].startswith('  "') and head[1].endswith("{")


def read_extraction_json(spark: SparkSession, path: str) -> DataFrame:
    """Papers of an extraction cache kept as one JSON object by filename; missing lists are empty, counts are those of the lists.

    A file that is written with an indent of two is split between its entries, so that many tasks read it; any other layout is one
    row of one task.
    """
    lists = ("entities", "relations", "performances", "mentions")
    fields = StructType([f for f in StructType.fromDDL(EXTRACTIONS) if f.name != "filename" and not f.name.startswith("n_")])
    if is_indented(spark, path):
        entries = spark.read.option("lineSep", ENTRY_END).text(path)
        # A piece lacks the brace of its last entry; the first has the object's own before it and the last after it.
        piece = F.regexp_replace("value", r"^\{\n", "")
        closed = F.when(piece.rlike(r"\n\}\s*$"), F.regexp_replace(piece, r"\}\s*$", "")).otherwise(F.concat(piece, F.lit("}")))
        objects = entries.select(F.concat(F.lit("{"), closed, F.lit("}")).alias("value"))
    else:
        objects = spark.read.text(path, wholetext=True)
    rows = objects.select(F.explode(F.from_json("value", MapType(StringType(), fields))).alias("filename", "e"))
    papers = rows.select("filename", *[F.coalesce(F.col(f"e.{f.name}"), F.array()).alias(f.name) if f.name in lists else F.col(f"e.{f.name}").alias(f.name) for f in fields])
    return papers.select("*", F.size("mentions").alias("n_mentions"), F.size("performances").alias("n_performances"))


def index_dump(chunks: DataFrame) -> DataFrame:
    """chunk_id, source, n_chars, text of every chunk."""
    return chunks.select("chunk_id", F.coalesce("source", F.lit("?")).alias("source"), F.length("text").alias("n_chars"), "text")
