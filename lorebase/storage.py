"""Shared-folder storage: where intermediate tables go, so that any executor can be lost.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only when a session
names none (single-machine tests) a folder of our own is made and set on the context.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can read and write."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not own:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lorebase-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own under the shared one, removed with all in it when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/lorebase/{label}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go when it is, not when the driver's JVM next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, label: str, codec: str | None = None) -> str:
    """Write ``df`` as Parquet under the shared folder, by the session's codec or another; where it lies.

    The files are removed when the driver's JVM ends.
    """
    path = f"{new_folder(df.sparkSession, label)}/table"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path, compression=codec)
    return path


def materialise(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` under the shared folder and read it back.

    Cuts the lineage, keeps exact sizes for the optimiser and survives lost executors.
    """
    path = written(df, label, codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._own_files = path
    return out


def bucketed(df: DataFrame, label: str, *by: str) -> DataFrame:
    """:func:`materialise` laid out by a hash of some columns, sorted by them in each bucket, as many buckets as a shuffle has partitions.

    Joins and aggregates on those columns read it without a shuffle.  The table is known to the session under a name of its own.
    """
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"lorebase_{label.replace('-', '_')}_{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.repartition(n, *by).write.bucketBy(n, *by).sortBy(*by).format("parquet").option("path", f"{new_folder(spark, label)}/table").saveAsTable(name)
    return spark.table(name)


def released(df: DataFrame) -> None:
    """Remove the files of a table that :func:`materialise` returned and nothing reads any more, such as a round's before the last."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._own_files)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def globally_ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with the place of each row in one order over all rows, from 1, without sorting all in one task.

    Rows are dealt out by range of the order, ranked within their range, and moved up by the rows
    of the ranges before; the table of ranges has one row for each.
    """
    dealt = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranked")
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(sizes), "_range").withColumn(name, F.col("_ahead") + within).drop("_range", "_ahead")
