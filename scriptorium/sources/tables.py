"""Chunk, embedding, question and result tables: schemas, readers, writers, guarded updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_SCHEMA = (
    "chunk_id string, doc_id long, collection string, section string, category string, group_id string, polarity string,"
    " page_start int, page_end int, part int, n_parts int, text_raw string, text_folded string, ordinal long"
)
EMBEDDING_SCHEMA = "chunk_id string, fingerprint string, model string, dim int, vec array<float>"
QUESTION_SCHEMA = "id string, category string, question string, expected_behavior string, reference_answer string, expected_chunk_ids array<string>, should_abstain boolean, variant_group string"


def read_table(spark: SparkSession, path: str, schema: str | None = None, kind: str = "parquet") -> DataFrame:
    reader = spark.read.format(kind)
    return (reader.schema(schema) if schema else reader).option("multiLine", "true").load(path) if kind == "json" else (reader.schema(schema) if schema else reader).load(path)


def spread(rows: DataFrame) -> DataFrame:
    """`rows` over all cores: a file that Spark reads in fewer splits than there are cores is dealt out, any larger table stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Overwrites the chunk table, one folder a collection, so that a filter on it prunes files."""
    chunks.write.mode("overwrite").partitionBy("collection").parquet(path)


def to_embed(chunks: DataFrame, stored: DataFrame, fingerprint) -> DataFrame:
    """Chunks whose current fingerprint is not stored: all that an interrupted or outdated build still needs."""
    current = chunks.withColumn("fingerprint", fingerprint)
    return current.join(stored.select("chunk_id", "fingerprint"), ["chunk_id", "fingerprint"], "left_anti")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at `path`, or one without rows if there is none yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def delete(spark: SparkSession, path: str) -> None:
    """Removes the table at `path` if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def append_embeddings(embedded: DataFrame, path: str) -> None:
    embedded.write.mode("append").parquet(path)


def apply_labels(questions: DataFrame, proposals: DataFrame, overrides: DataFrame) -> DataFrame:
    """Questions with `expected_chunk_ids` from overrides, else proposals; fails if a question has neither or a column would go."""
    joined = questions.join(proposals.select("id", F.col("chunk_ids").alias("__proposed")), "id", "left").join(overrides.select("id", F.col("chunk_ids").alias("__chosen")), "id", "left")
    found = F.coalesce("__chosen", "__proposed")
    label = F.when(found.isNull(), F.raise_error(F.concat(F.lit("no label for question "), F.col("id"))).cast("array<string>")).otherwise(found)
    out = joined.withColumn("expected_chunk_ids", label).drop("__proposed", "__chosen")
    if lost := set(questions.columns) - set(out.columns):
        raise ValueError(f"columns would be lost: {sorted(lost)}")
    return out


def append_run(rows: DataFrame, path: str, run_id: str, settings: dict[str, str]) -> None:
    """Appends the rows of one evaluation run, stamped with its settings."""
    stamp = F.create_map(*[F.lit(x) for pair in sorted(settings.items()) for x in pair]) if settings else F.lit(None).cast("map<string,string>")
    rows.withColumn("run_id", F.lit(run_id)).withColumn("settings", stamp).write.mode("append").parquet(path)


def latest_run(runs: DataFrame) -> DataFrame:
    """Rows of the run with the largest run_id."""
    return runs.join(F.broadcast(runs.agg(F.max("run_id").alias("run_id"))), "run_id").select(*runs.columns)


def backup_once(spark: SparkSession, path: str, backup: str) -> bool:
    """Copies the folder or file `path` to `backup` unless that is there already; whether it was copied."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(backup)
    to = target.getFileSystem(conf)
    if to.exists(target):
        return False
    return bool(jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, to, target, False, conf))


def rewrite_questions(questions: DataFrame, path: str, backup: str) -> None:
    """Replaces the JSON table of questions at `path`; the first rewrite leaves its former state in `backup`.

    Refused if a column or the id of a question would be lost. The new table is written
    beside the old one and takes its place when it is whole.
    """
    spark = questions.sparkSession
    old = spark.read.json(path)
    if lost := set(old.columns) - set(questions.columns):
        raise ValueError(f"columns would be lost: {sorted(lost)}")
    if not old.select("id").join(questions.select("id"), "id", "left_anti").isEmpty():
        raise ValueError("questions would be lost")
    backup_once(spark, path, backup)
    fresh = f"{path.rstrip('/')}.new"
    questions.write.mode("overwrite").option("ignoreNullFields", "false").json(fresh)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    here, there = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(fresh)
    files = here.getFileSystem(conf)
    files.delete(here, True)
    if not files.rename(there, here):
        raise OSError(f"{fresh} holds the new questions, {backup} the old ones")


def write_proposals(proposals: DataFrame, path: str) -> None:
    """Overwrites the JSON table of label proposals (id, chunk_ids, best_coverage, weak)."""
    proposals.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
