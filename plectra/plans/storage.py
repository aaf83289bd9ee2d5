"""Tables that cut lineage, and folders for written files, below the folder that all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder's name below spark.checkpoint.dir.

    Where that setting is unset, a local master gets a temporary folder of its own; anywhere else that is an
    error, as executors would not see the driver's folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        base = _local_dir()
    return f"{base.rstrip('/')}/plectra-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Written to a new scratch folder and read back."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of stored tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if name.rsplit("/", 1)[-1].startswith("plectra-"):
                folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
                folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
