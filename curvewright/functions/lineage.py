"""Cutting lineage so that iterative plans stay short and survive lost executors."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether joins ask that their sides be dealt by all keys.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
#: Held while it is changed, so that queries side by side leave it as it was.
_setting = threading.Lock()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Only a local master, which has one machine, gets a folder of its own where none is set.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="curvewright-")
        context.setCheckpointDir(folder)
    return f"{folder}/curvewright-{context.applicationId}"


def settle(df: DataFrame, dealt: bool = False) -> DataFrame:
    """Write df once as a table in the shared folder and read it back.

    A written table keeps size statistics (so that later joins can be planned by size) and column access, which a
    checkpointed RDD does not. With ``dealt``, joins take sides that are both dealt by the same part of their keys as
    they are, where Spark would deal them anew by all keys; that holds while the table is written and no longer.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    write = df.write.option("compression", "zstd").parquet
    if not dealt:
        write(path)
        return spark.read.schema(df.schema).parquet(path)
    with _setting:
        before = spark.conf.get(ALL_KEYS)
        spark.conf.set(ALL_KEYS, "false")
        try:
            write(path)
        finally:
            spark.conf.set(ALL_KEYS, before)
    return spark.read.schema(df.schema).parquet(path)


def settle_points(points: DataFrame) -> DataFrame:
    """Settle points dealt over the cores: a compressed table of a few MB is read by one task, whatever grows from it."""
    return settle(points.repartition("cloud", "id"))


def clear(spark: SparkSession) -> None:
    """Delete the tables that this application settled; results that still read them can no longer be used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
