"""Shared helpers: scratch tables in the cluster's shared folder, connected components, word lists."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; whole texts travel in these batches, so they stay small.
ARROW_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of a Python worker by the rows of an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all machines share.

    Where that setting is unset, a local master gets a temporary folder of its own; anywhere else that is an
    error, as executors would not see the driver's folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        base = _local_dir()
    return f"{base.rstrip('/')}/plectra-{uuid.uuid4().hex}"


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes the rows to the shared folder and reads them back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


#: The folders of tables that are still referred to.
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() made and whose readers have all been stored themselves."""
    for table in tables:
        path = _paths.pop(table)
        jvm = table.sparkSession.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def released(spark: SparkSession) -> None:
    """Spark drops the shuffle files and broadcasts of ended jobs once their plans are garbage, which can take long on an idle driver."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (u long, v long): rows (node, root).

    Each round merges every node into the busiest node next to it (ties by a hash of node and round), so
    stars vanish in one round and paths shrink by a constant factor; every round is a grouped minimum
    with partial aggregation, nothing is collected. The root is any node of the component, the same for
    all its nodes. Nodes without an edge to another node do not appear.
    """
    live = stored(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct())
    maps: list[DataFrame] = []
    while not live.isEmpty():
        k = F.lit(len(maps))
        both = live.select("u", "v").union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        degree = stored(both.groupBy("u").agg(F.count("*").alias("d")))
        rank = F.struct((-F.col("d")).alias("d"), F.xxhash64("u", k).alias("h"), F.col("u").alias("m"))
        ranked = degree.select(F.col("u").alias("v"), rank.alias("r"))
        near = both.join(ranked, "v").groupBy("u").agg(F.min("r").alias("near"))
        best = stored(
            degree.select("u", rank.alias("own")).join(near, "u").select("u", F.least("own", "near").getField("m").alias("m"))
        )
        maps.append(best)
        after = stored(
            live.join(best, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("a"))
            .join(best, "u")
            .select(F.least("a", "m").alias("u"), F.greatest("a", "m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        discard(live, degree)
        live = after
    if not maps:
        return live.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = maps[0].select(F.col("u").alias("node"), F.col("m").alias("root"))
    for step in maps[1:]:
        out = out.join(step.select(F.col("u").alias("root"), "m"), "root", "left").select(
            "node", F.coalesce("m", "root").alias("root")
        )
    return stored(out) if len(maps) > 1 else out
