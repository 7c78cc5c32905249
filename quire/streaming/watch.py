"""A streaming front end for the index: new files arrive as micro-batches, and each is one commit.

The file source reports paths it has not seen; changes and removals of known files show only in a full listing, so the
batch diff stays the truth, and a stream that has caught up should be followed by one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions.text import text_of, title_of
from quire.sources.files import scan_markdown

BINARY = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """filename, title, text, md5 of Markdown files as they arrive."""
    stream = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.md").option("maxFilesPerTrigger", files_per_batch).load(folder)
    named = stream.select(F.substring_index("path", "/", -1).alias("filename"), "content")
    return named.select("filename", title_of(F.col("filename")).alias("title"), text_of(F.col("content")).alias("text"), F.md5("content").alias("md5"))


def index_arrivals(spark: SparkSession, folder: str, checkpoint: str, update: Callable[[DataFrame], object], files_per_batch: int = 1000) -> StreamingQuery:
    """Run ``update`` on a full listing for every micro-batch until what has arrived is done.

    ``update`` is idempotent: a batch that is repeated after a failure finds nothing changed.
    """

    def step(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            update(scan_markdown(spark, folder))

    return arrivals(spark, folder, files_per_batch).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
