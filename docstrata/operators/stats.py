"""Statistics of documents, chunks and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.functions import text as X


def chunk_distribution(counts: DataFrame, n: str = "n") -> DataFrame:
    """documents, min, max, mean, median, p95, p99, std of a small table of counts; exact, interpolated percentiles."""
    p = F.percentile(F.col(n), F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return counts.agg(F.count("*").alias("documents"), F.min(n).alias("min"), F.max(n).alias("max"), F.avg(n).alias("mean"), p.alias("p"), F.stddev(n).alias("std")).select("documents", "min", "max", "mean", F.col("p")[0].alias("median"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"), "std")


def histogram(counts: DataFrame, width: int, n: str = "n") -> DataFrame:
    """(low, documents): how many counts lie in [low, low + width)."""
    return counts.groupBy((F.floor(F.col(n) / width) * width).cast("long").alias("low")).agg(F.count("*").alias("documents"))


def outliers(counts: DataFrame, n: str = "n") -> DataFrame:
    """Counts beyond the upper whisker of the box plot; the quartiles are one row."""
    q = counts.agg(F.percentile(F.col(n), F.array(F.lit(0.25), F.lit(0.75))).alias("q")).select((F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("whisker"))
    return counts.join(F.broadcast(q)).where(F.col(n) > F.col("whisker"))


def heavy_share(counts: DataFrame, percentile: float = 0.95, n: str = "n") -> DataFrame:
    """(threshold, share): how many documents reach the percentile of the counts."""
    t = counts.agg(F.percentile(F.col(n), F.lit(percentile)).alias("threshold"))
    return counts.join(F.broadcast(t)).groupBy("threshold").agg(F.avg((F.col(n) >= F.col("threshold")).cast("int")).alias("share"))


def token_lengths(chunks: DataFrame, limit: int, width: int = 100, text: str = "text") -> DataFrame:
    """(low, chunks, within): lengths in words by bucket, and how many of each are within the limit."""
    n = X.token_count(F.col(text))
    return chunks.select(n.alias("n")).groupBy((F.floor(F.col("n") / width) * width).cast("long").alias("low")).agg(F.count("*").alias("chunks"), F.count_if(F.col("n") <= limit).alias("within"))


def cluster_summary(vectors: DataFrame, cluster: str) -> DataFrame:
    """(clusters, mean_size, smallest, largest)."""
    return vectors.groupBy(cluster).count().agg(F.count("*").alias("clusters"), F.avg("count").alias("mean_size"), F.min("count").alias("smallest"), F.max("count").alias("largest"))


def counts_by(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def block_counts(assigned: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, figures, tables, paragraphs, headings) of each document's blocks."""
    images = F.when(F.col("images").isNotNull(), F.size("images")).otherwise(0) if "images" in assigned.columns else F.lit(0)
    return assigned.groupBy(doc).agg(F.sum(images).alias("figures"), F.count_if(F.col("kind") == "table").alias("tables"), F.count_if((F.col("kind") == "paragraph") & F.col("level").isNull()).alias("paragraphs"), F.count_if(F.col("level").isNotNull()).alias("headings"))


def distinct_vectors(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """Each vector once."""
    return vectors.select(vector).where(F.col(vector).isNotNull()).distinct()


def distinct_vector_count(vectors: DataFrame, exact: bool = True, vector: str = "vector") -> DataFrame:
    """(vectors): how many are distinct; by a sketch of their hashes if not ``exact``."""
    return vectors.agg((F.count_distinct(vector) if exact else F.approx_count_distinct(F.xxhash64(vector))).alias("vectors"))


def store_comparison(flat: DataFrame, tree: DataFrame, doc: str = "doc_id", vector: str = "vector") -> DataFrame:
    """One row for each of two stores of the same documents: vectors, vectors a document, bytes; and what the tree saves."""

    def one(df: DataFrame, p: str) -> DataFrame:
        return df.agg(F.count(vector).alias(f"{p}_vectors"), (F.count(vector) / F.count_distinct(doc)).alias(f"{p}_per_document"), F.sum(4 * F.size(vector)).cast("long").alias(f"{p}_bytes"))

    both = one(flat, "flat").join(F.broadcast(one(tree, "tree")))  # one row each
    return both.withColumn("saved_percent", 100 * (1 - F.col("tree_bytes") / F.col("flat_bytes")))
