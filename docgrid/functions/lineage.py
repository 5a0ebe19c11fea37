"""Cutting lineage where one relation feeds many branches: tables written to the folder that driver and executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset, a temporary one on a local master, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{tempfile.gettempdir()}/docgrid-shared"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _path(spark: SparkSession, path: str):
    """A path and its file system, as Spark knows them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _path(spark, path)
    return system.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where, system = _path(spark, path)
    system.delete(where, True)


def scratch(spark: SparkSession) -> str:
    """The folder of this application in the shared one; it goes when the driver ends."""
    root = f"{shared_dir(spark)}/docgrid-{spark.sparkContext.applicationId}"
    where, system = _path(spark, root)
    if not system.exists(where):
        system.mkdirs(where)
        system.deleteOnExit(where)
    return root


def pinned(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written once (below `path`, or to the application's folder) and read back: cuts lineage, survives lost executors, has real statistics."""
    spark = df.sparkSession
    path = path or f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
