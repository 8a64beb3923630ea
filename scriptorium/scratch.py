"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_kept: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a local session gets a temporary one and a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="scratch-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def kept(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet and read again: several branches of a plan can use it without planning it twice. Removed when Python ends."""
    spark = df.sparkSession
    path = f"{folder(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _kept:
        atexit.register(_remove)
    _kept.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """`df` with `name`, the number of each row from 0 in order of `keys`, which tell all rows apart.

    Rows are dealt by ranges of the keys and written; each range is counted, and a row's
    number is its place in its range after the rows of the ranges before.
    """
    part = f"_range_of_{name}"
    dealt = kept(df.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()))
    # One row a range is ordered in one place.
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy(part).agg(F.count("*").alias("n")).select(part, before.alias("before"))
    own = F.row_number().over(Window.partitionBy(part).orderBy(*keys)) - 1
    return dealt.withColumn(name, own).join(F.broadcast(offsets), part).withColumn(name, (F.col("before") + F.col(name)).cast("long")).drop(part, "before")


def sorted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by shuffle and sort of two tables that grow with the corpus.

    Spark sizes a table by its files, before its rows are exploded: of packed files it
    would hand a table of many times their size to the driver for a broadcast.
    """
    return left.join(right.hint("merge"), on, how)


def _remove() -> None:
    for spark, path in _kept:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone; its folder belongs to the cluster
            return
