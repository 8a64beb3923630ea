"""Incremental ingestion: new documents of a stream become chunks of a table.

An extra beside the batch operators: each micro-batch is cut into chunks and appended,
and a checkpoint makes a restarted stream go on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text
from ..operators import segment
from ..sources import paged


def section_parts(docs: DataFrame, limit: int) -> DataFrame:
    """doc_id, part, n_parts, text_raw, text_folded of (doc_id, text)."""
    lines = paged.text_lines(docs).select("doc_id", F.col("line_no").cast("long").alias("pos"), F.lit(1).alias("page"), "line")
    parts = segment.split_sections(lines, ["doc_id"], limit)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return parts.groupBy("doc_id", "part", "n_parts").agg(body.alias("text_raw")).withColumn("text_folded", text.fold("text_raw"))


def ingest_stream(stream: DataFrame, path: str, checkpoint: str, limit: int = 2500, once: bool = True) -> StreamingQuery:
    """Appends the parts of every new document of `stream` (doc_id, text) to the Parquet table at `path`.

    A batch that is written again after a failure replaces its own folder, so no part is
    doubled.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        section_parts(batch, limit).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
