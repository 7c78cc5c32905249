"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one of our own only in local mode with the setting absent."""
    named = spark.conf.get(SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError(f"{SETTING} is not set; executors need a folder that all of them share")
    if "root" not in _own:
        _own["root"] = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, _own["root"], True)
    return "file://" + _own["root"]


#: Rows that Spark hands to a Python function at a time while a table is written: few, as they may be whole texts.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's tables; other applications that share the root have their own."""
    return f"{shared_root(spark)}/quire/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: a lost executor then costs a re-read, not a re-run."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete every table that this application has written with materialise(); frames that read them end with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
