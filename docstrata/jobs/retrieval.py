"""Retrieval over the node tables of a store, or over the node view of an embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.operators import search

#: Limits under which every level really prunes the small hierarchy.
LIMITS = search.Limits(3, 2, 2, 2, 2)


def node_view(embeddings: DataFrame) -> DataFrame:
    """A deterministic hierarchy over vectors: in every hundred one scope section, 4 sections, 12 subsections, 12
    subsubsections and 71 chunks; (id, doc_id, level, parent_id, vector)."""
    j = F.col("vec_id") % 100
    level = F.when(j == 0, "scope").when(j <= 4, "section").when(j <= 16, "subsection").when(j <= 28, "subsubsection").otherwise("chunk")
    parent = F.when(j <= 4, F.lit(None)).when(j <= 16, 1 + (j - 5) % 4).when(j <= 28, 5 + (j - 17) % 4).otherwise(5 + (j - 29) % 24)
    doc = F.floor(F.col("vec_id") / 100).cast("long")
    return embeddings.select(F.col("vec_id").alias("id"), doc.alias("doc_id"), level.alias("level"), (F.col("vec_id") - j + parent).alias("parent_id"), F.col("embedding").alias("vector"), "label")


def every_hundredth(nodes: DataFrame) -> DataFrame:
    """The vectors that serve as queries."""
    return nodes.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")


def search_tree(nodes: DataFrame, queries: DataFrame, limits: search.Limits = LIMITS) -> dict[str, DataFrame]:
    """Hits on all levels."""
    of = lambda level: nodes.where(F.col("level") == level)
    scopes = of("scope").select(F.col("doc_id").alias("id"), "vector")
    sections = of("section").select("id", F.col("doc_id").alias("parent_id"), "vector")
    below = [of(x).select("id", "parent_id", "vector") for x in ("subsection", "subsubsection", "chunk")]
    return search.hierarchical(queries, scopes, sections, *below, limits)


def hierarchical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks of every query, with all their parents."""
    nodes = node_view(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    hits = search_tree(nodes, every_hundredth(nodes))["chunks"]
    return hits.select("query_id", "parent_document", "parent_section", "parent_subsection", "parent_subsubsection", F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))
