"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The setting by which the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Ways in which the rows of one key are spread before they meet.
SPREAD = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder; the path may belong to any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


#: Rows that go to a Python worker at once, and that the Parquet reader holds at once; texts may be long.
ARROW_ROWS, PARQUET_ROWS = 500, 512


def bounded_batches(spark: SparkSession) -> None:
    """From now on holds few rows at once, in sessions that leave the defaults.

    Batches of thousands of rows hold tens of MB of texts or signatures several times over.
    """
    for key, default, rows in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000, ARROW_ROWS),
        ("spark.sql.parquet.columnarReaderBatchSize", 4096, PARQUET_ROWS),
    ):
        if int(spark.conf.get(key)) == default:
            spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A folder that the driver and all executors can read and write.

    It lies in ``spark.checkpoint.dir``.  Where that is unset, as in local tests,
    a folder beside the warehouse is used, which in local mode is shared too.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_millrace_shared"
    return "/".join([base.rstrip("/"), *parts])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage.

    The files outlive every executor, so a lost executor costs only its own tasks.  The
    shuffles of the write go when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path = shared_dir(spark, f"{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the files of a ``written`` table that nothing reads any more."""
    path = getattr(df, "_millrace_path", None)
    if path:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def tidy(spark: SparkSession) -> None:
    """Lets go of what finished queries leave on the driver: plans, generated classes, broadcasts, freed memory of Python."""
    gc.collect()
    spark._jvm.System.gc()
    try:
        ctypes.CDLL(None).malloc_trim(0)  # freed memory goes back to the system, where the C library can do that
    except (AttributeError, OSError, TypeError):
        pass


def spread_of(column: str | Column, ways: int = SPREAD) -> Column:
    """A number below ``ways`` from a column that differs between the rows of a key."""
    c = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.xxhash64(c), F.lit(ways)).cast("int")


def join_spread(rows: DataFrame, found: DataFrame, key: str, by: str, ways: int = 64) -> DataFrame:
    """``rows`` joined with ``found``, which has a row per key, without bringing a hot key's rows together.

    Rows are spread by the column ``by`` within a key; ``found`` goes to the spreads that occur.
    """
    spread = rows.withColumn("_spread", spread_of(by, ways))
    few = spread.select(key, "_spread").distinct().join(found, key)
    return spread.join(few, [key, "_spread"]).drop("_spread")
