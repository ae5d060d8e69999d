"""Lineage cuts, shared storage and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta.llm.textblocks import give_back


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or an own one where that is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="prospecta-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, what: str) -> str:
    """A new URI in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` held in the shared folder: an eager checkpoint, which outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder, which outlives lost executors; the shuffle files that made it go once it is whole."""
    spark = df.sparkSession
    out, before = scratch(spark, what), spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(out)
    finally:
        spark.conf.set(_CLEANUP, before)
        give_back()
    table = spark.read.schema(df.schema).parquet(out)
    table._written = out
    return table


def dropped(result: DataFrame, *tables: DataFrame) -> DataFrame:
    """``result``, a written table, after the tables of written() that it no longer needs have been deleted."""
    spark = result.sparkSession
    for table in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._written)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return result


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reachable.

    Alternates large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and
    Beyond") until the edges stand still. A node's smallest neighbour is a hash aggregate, so a hub is
    combined before the shuffle. Self-loops and repeated edges are allowed; no edges give no rows.
    """
    held = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    held = cut(held)
    before = None
    while True:
        state = held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        held = small.select(F.col("m").alias("u"), "v").unionByName(small.select(F.col("m").alias("u"), F.col("u").alias("v")).where("u < v"))
        held = cut(held.where("u < v").distinct())
    roots = held.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "node")
    return roots.unionByName(held.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
