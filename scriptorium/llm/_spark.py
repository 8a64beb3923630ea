"""Session helpers of the operators: shared scratch tables and the contract's hash folds."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session, as in tests, gets a temporary one; a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="scratch-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, free: bool = False) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    `free`: shuffle files of large plans go with the driver's garbage, so collect it now;
    else they stay on the executors' disks for as long as the driver has memory.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove_all)
    _written.append((spark, path))
    if free:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """`written` for a plan that `make` builds; tables written on the way there are removed, as nothing else reads them."""
    before = {path for _, path in _written}
    out = written(make())
    for spark, path in [x for x in _written if x[1] not in before and x[1] != out._scratch_path]:
        _remove(spark, path)
    return out


def drop_written(*tables: DataFrame) -> None:
    """Removes tables of `written` that no later plan reads."""
    for df in tables:
        _remove(df.sparkSession, df._scratch_path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written[:] = [x for x in _written if x[1] != path]


def _remove_all() -> None:
    for spark, path in list(_written):
        try:
            _remove(spark, path)
        except Exception:  # the session is gone; its folder belongs to the cluster
            return


def crc32_remainder(doc_id: Column, by: int) -> Column:
    """crc32(doc_id as text) mod `by`; the fold of a labelled row."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table. Its rows hold whole texts, so Arrow batches get 2000 rows at most."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of at most `max_rows` labelled rows that satisfy `train`, chosen by a hash of doc_id.

    Only ids and labels are ordered; the bound makes the broadcast to the text scan safe.
    """
    rows = labels.filter(train & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
