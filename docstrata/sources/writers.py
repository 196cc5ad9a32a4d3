"""Writing results: overwritten tables, nested JSON, delimited tables, appended logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from docstrata.functions import text as X


def store(rows: DataFrame, path: str, partition_by: tuple[str, ...] = (), bucket_rows: int = 0) -> int:
    """Replace the table at ``path``; the number of rows written, counted while writing."""
    seen = Observation()
    out = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    writer = out.write.mode("overwrite")
    if bucket_rows:
        writer = writer.option("maxRecordsPerFile", bucket_rows)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return seen.get["n"]


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_chunked(documents: DataFrame, path: str, name: str = "file_path") -> None:
    """Chunked documents as JSON lines with their file names; ``_chunks.json`` takes the place of the suffix."""
    documents.withColumn("file_name", F.concat(X.stem(F.col(name)), F.lit("_chunks.json"))).write.mode("overwrite").json(path)


def write_embedded(documents: DataFrame, path: str, name: str = "file_path") -> None:
    """Embedded documents as JSON lines; ``_embedded.json`` takes the place of the suffix."""
    documents.withColumn("file_name", X.swap_suffix(X.file_name(F.col(name)), ".json", "_embedded.json")).write.mode("overwrite").json(path)


def write_packed(files: DataFrame, path: str, name: str = "file_name", value: str = "value") -> None:
    """Many small text files as rows (file_name, value) of a few large ones, for ``readers.read_packed``; every text comes back as it was."""
    files.select(F.col(name).cast("string").alias("file_name"), F.col(value).alias("value")).write.mode("overwrite").parquet(path)


def write_flat(chunks: DataFrame, path: str, file: str = "source_file", lines: bool = False) -> None:
    """A JSON file {"source_file": ..., "file_content": [{chunk, embedding}, ...]} for each source file, chunks in order; with ``lines`` a
    line for each, many in a file."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", F.col("content").alias("chunk"), "embedding"))), lambda x: F.struct(x["chunk"].alias("chunk"), x["embedding"].alias("embedding")))
    writer = chunks.groupBy(F.col(file).alias("source_file")).agg(entries.alias("file_content")).write.mode("overwrite")
    (writer if lines else writer.option("maxRecordsPerFile", 1)).json(path)


def write_repaired(checked: DataFrame, path: str) -> int:
    """The repaired copies of ``validation.checked_again`` as JSON lines (fixed_name, fixed); how many there are. Files that
    needed no repair, or allow none, are left out."""
    seen = Observation()
    fixed = checked.where(F.startswith("status", F.lit("fixed"))).select("fixed_name", "fixed").observe(seen, F.count(F.lit(1)).alias("n"))
    fixed.write.mode("overwrite").json(path)
    return seen.get["n"]


def write_results(results: DataFrame, path: str, column: str = "result") -> None:
    """One JSON line for each query."""
    results.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_lines(lines: DataFrame, path: str, by: tuple[str, ...] = ("doc_id", "table_id"), tables_together: int = 1000) -> None:
    """Rows of ``tables.delimited`` as tab-separated text (table, line): whole tables next to each other, lines in order, about
    ``tables_together`` tables in a file."""
    parts = max(1, -(-lines.select(*by).distinct().count() // tables_together))
    named = lines.select(F.concat_ws("/", *by).alias("table"), "row", "line").repartitionByRange(parts, "table").sortWithinPartitions("table", "row")
    named.select(F.concat_ws("\t", "table", "line").alias("value")).write.mode("overwrite").text(path)
