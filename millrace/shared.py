"""Folders that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, as in local tests, one beside the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return base.rstrip("/") if base else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_millrace_shared"


#: The setting by which the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, path: str) -> None:
    """Writes ``df`` as Parquet in place of what is there; its shuffle files go when it ends, as nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    try:
        conf.set(CLEANUP, "true")
        df.write.mode("overwrite").parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage is cut, and lost executors cost their own tasks only."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    save(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the files of a ``staged`` table that nothing reads any more."""
    path = getattr(df, "_millrace_path", None)
    if path:
        system, place = place_of(df.sparkSession, path)
        system.delete(place, True)


def place_of(spark: SparkSession, path: str):
    """(file system, path) of a path in any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place
