"""Reading document files. File names are columns; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from docstrata.functions import text as X

#: The nested document, fixed in depth: sections, subsections, subsubsections.
TABLES = "tables ARRAY<STRUCT<description STRING, `table number` INT, summary STRING, name STRING>>"
FIGURES = "figures_meta_data ARRAY<STRUCT<figure_id STRING, last_paragraph STRING>>"
SUBSUB = f"STRUCT<title STRING, text_content STRING, chunks ARRAY<STRING>, {FIGURES}, {TABLES}>"
SUB = f"STRUCT<title STRING, description STRING, summary STRING, text_content STRING, chunks ARRAY<STRING>, {TABLES}, {FIGURES}, subsubsections ARRAY<{SUBSUB}>>"
DOCUMENT = f"document_name STRING, content ARRAY<STRUCT<title STRING, description STRING, summary STRING, {TABLES}, {FIGURES}, subsections ARRAY<{SUB}>>>, _corrupt STRING"
FLAT = "source_file STRING, file_content ARRAY<STRUCT<chunk STRING, embedding ARRAY<FLOAT>>>"


def documents_with(reader: DataFrameReader | DataStreamReader, path: str, recursive: bool, lines: bool = False) -> DataFrame:
    reader = reader.schema(DOCUMENT).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json").option("recursiveFileLookup", recursive)
    return reader.json(path).select("*", F.col("_metadata.file_path").alias("file_path"))


def read_documents(spark: SparkSession, path: str, recursive: bool = True, lines: bool = False) -> DataFrame:
    """Document JSON files, one row each with ``file_path``; an unreadable file has its text in ``_corrupt``. With ``lines`` a file holds
    any number of documents, one a line: a corpus in a file for each document takes its time to create, list and open them."""
    return documents_with(spark.read, path, recursive, lines)


def stream_documents(spark: SparkSession, path: str, recursive: bool = True, batch_bytes: int = 1 << 30) -> DataFrame:
    """The same as a stream: each file once, in batches of about ``batch_bytes``."""
    return documents_with(spark.readStream.option("maxBytesPerTrigger", batch_bytes), path, recursive)


def split_unreadable(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable documents, quarantine(file_path, reason)). The frame is used twice: cache or store it if reading is dear."""
    bad = F.col("_corrupt").isNotNull()
    return documents.where(~bad).drop("_corrupt"), documents.where(bad).select("file_path", F.lit("unreadable JSON").alias("reason"))


def read_raw(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(file_name, value): whole files as text, for validation."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True).select(X.file_name(F.col("_metadata.file_path")).alias("file_name"), "value")


def read_markdown(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(source_file, text): whole Markdown files."""
    return read_raw(spark, path, glob).select(F.col("file_name").alias("source_file"), F.col("value").alias("text"))


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, value) of the files that ``writers.write_packed`` has put together."""
    return spark.read.schema("file_name string, value string").parquet(path)


def read_flat_embedded(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(source_file, chunk_idx, content, embedding) of flat files, each named as it says or else by its own name; entries without
    a chunk or a vector are left out. With ``lines`` a file holds one flat file a line."""
    files = spark.read.schema(FLAT).option("multiLine", not lines).option("pathGlobFilter", "*.json").json(path)
    rows = files.select(F.coalesce("source_file", X.file_name(F.col("_metadata.file_path"))).alias("source_file"), F.posexplode("file_content").alias("chunk_idx", "x"))
    return usable_chunks(rows.select("source_file", "chunk_idx", F.col("x.chunk").alias("content"), F.col("x.embedding").alias("embedding")))


def usable_chunks(rows: DataFrame, content: str = "content", vector: str = "embedding") -> DataFrame:
    return rows.where(F.col(content).isNotNull() & F.col(vector).isNotNull())


def first_files(rows: DataFrame, n: int = 50, file: str = "source_file") -> DataFrame:
    """Rows of the first n files by name."""
    return rows.join(rows.select(file).distinct().orderBy(file).limit(n), file, "left_semi")


def read_conversations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) tables below ``path``."""
    return spark.read.parquet(f"{path}/conversations"), spark.read.parquet(f"{path}/messages")


def latest_first(rows: DataFrame, key: str, at: str) -> DataFrame:
    """One row for each key, the newest: for tables that are only ever appended to."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).where("_n = 1").drop("_n")
