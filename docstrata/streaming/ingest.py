"""Incremental ingest: new files are chunked and encoded, and replace what the store had of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docstrata.operators import chunking


def ingest_stream(files: DataFrame, store: str, checkpoint: str, size: int = chunking.FLAT[0], overlap: int = chunking.FLAT[1], encode: Callable[[DataFrame], DataFrame] | None = None, at: str | None = None) -> StreamingQuery:
    """Start a query that keeps ``store`` up to date with a stream of (source_file, text), and ends when all is read.

    A batch appends its chunks, and a row for each file that says which batch it is now in; nothing that is stored is read or
    rewritten. ``current`` gives the chunks of each file's newest batch. In a batch the newest version of a file counts, by
    the column ``at`` or else the largest text. Each batch has folders of its own, so one that is run again writes the
    same rows, and a file that has become empty has no chunks any more."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        order = F.struct(*([F.col(at).alias("at")] if at else []), "text")
        latest = batch.groupBy("source_file").agg(F.max(order).alias("v")).select("source_file", "v.text")
        chunks = chunking.flat_chunks(latest, size, overlap)
        chunks = encode(chunks) if encode else chunks
        latest.select("source_file", F.lit(batch_id).cast("long").alias("version")).write.mode("overwrite").parquet(f"{store}/files/batch={batch_id}")
        chunks.withColumn("version", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{store}/chunks/batch={batch_id}")

    return files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, store: str) -> DataFrame | None:
    """The chunks of every file's newest version, or None before the first batch."""
    if not exists(spark, f"{store}/files"):
        return None
    newest = spark.read.parquet(f"{store}/files").groupBy("source_file").agg(F.max("version").alias("version"))
    return spark.read.parquet(f"{store}/chunks").drop("batch").join(newest, ["source_file", "version"], "left_semi").drop("version")


def compacted(spark: SparkSession, store: str, into: str) -> None:
    """Write what is current into a new store, for when many batches have passed."""
    rows = current(spark, store)
    if rows is not None:
        rows.withColumn("version", F.lit(-1).cast("long")).write.parquet(f"{into}/chunks/batch=-1")
        spark.read.parquet(f"{store}/files").select("source_file").distinct().withColumn("version", F.lit(-1).cast("long")).write.parquet(f"{into}/files/batch=-1")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
